"""Helpers that write DuckDB SQL for the oracle queries.

These render the same fixed values (labels, rules, fixture strings) as SQL
text, so the oracle is an independent statement of each query's semantics.
"""

from __future__ import annotations

from intentspark import domain
from intentspark.functions.text import WHITESPACE
from intentspark.plans.inputs import GENERATION_FIXTURE, N_FIXTURE, TURN_BASE


def lit(s: str) -> str:
    """A DuckDB expression equal to the Python string ``s``."""
    parts: list[str] = []
    run = ""
    for ch in s:
        if 32 <= ord(ch) < 127:
            run += ch
        else:
            if run:
                parts.append("'" + run.replace("'", "''") + "'")
                run = ""
            parts.append(f"chr({ord(ch)})")
    if run or not parts:
        parts.append("'" + run.replace("'", "''") + "'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


WS = lit(WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def clean(x: str) -> str:
    return strip(f"split_part(split_part({strip(x)}, chr(10), 1), '.', 1)")


def list_lit(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def fixture_pick(key: str) -> str:
    return f"list_extract({list_lit(GENERATION_FIXTURE)}, CAST(({key}) % {N_FIXTURE} AS INTEGER) + 1)"


def resolve_cases(lowered: str, keywords=domain.KEYWORDS) -> tuple[str, str]:
    """(category CASE, stage CASE) of the batch cascade over ``lowered``."""
    whens: list[tuple[str, str, str]] = []
    for c in domain.CATEGORIES:
        whens.append((f"starts_with({lowered}, {lit(c.lower())})", c, "prefix"))
    for c in domain.CATEGORIES:
        whens.append((f"contains({lowered}, {lit(c.lower())})", c, "contains"))
    for c in domain.CATEGORIES:
        kws = keywords.get(c, ())
        if kws:
            cond = " OR ".join(f"contains({lowered}, {lit(k)})" for k in kws)
            whens.append((f"({cond})", c, "keyword"))
    cat = "CASE " + " ".join(f"WHEN {w} THEN {lit(c)}" for w, c, _ in whens) + \
        f" ELSE {lit(domain.DEFAULT_CATEGORY)} END"
    stage = "CASE " + " ".join(f"WHEN {w} THEN '{s}'" for w, _, s in whens) + " ELSE 'default' END"
    return cat, stage


def api_case(lowered: str) -> str:
    return "CASE " + " ".join(
        f"WHEN contains({lowered}, {lit(c.lower())}) THEN {lit(c)}" for c in domain.CATEGORIES
    ) + f" ELSE {lit(domain.API_FALLBACK)} END"


GENS = f"(SELECT event_id, {fixture_pick('event_id')} AS generated FROM events)"

USER_TURNS = (f"(SELECT CAST(conv_id AS BIGINT) * {TURN_BASE} + turn AS Id, conv_id, turn, text AS Sentence "
              f"FROM conversations WHERE role = 'user')")

LABELLED_TURNS = (f"(SELECT *, list_extract({list_lit(domain.CATEGORIES)}, "
                  f"CAST(conv_id % {len(domain.CATEGORIES)} AS INTEGER) + 1) AS Category "
                  f"FROM {USER_TURNS})")


def resolved(source: str, key: str, generated: str = "generated") -> str:
    """SELECT key, cleaned, Category, resolved_by over ``source``."""
    cat, stage = resolve_cases("lowered")
    return (f"SELECT {key}, cleaned, {cat} AS Category, {stage} AS resolved_by FROM "
            f"(SELECT *, lower(cleaned) AS lowered FROM "
            f"(SELECT *, {clean(f"coalesce({generated}, '')")} AS cleaned "
            f"FROM {source}))")


def tokens(x: str) -> str:
    """Tokenizer: reserved tokens split out, cut on whitespace runs, no empties."""
    from intentspark.functions.text import SPECIAL_PATTERN, WHITESPACE_CLASS
    spaced = f"regexp_replace(coalesce({x}, ''), {lit('(' + SPECIAL_PATTERN + ')')}, ' \\1 ', 'g')"
    return (f"list_filter(regexp_split_to_array({strip(spaced)}, {lit(WHITESPACE_CLASS + '+')}), "
            f"lambda t: t <> '')")


SPLIT_FLAGGED = (
    "(SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) "
    "<= ceil(CAST(0.1 AS DOUBLE) * count(*) OVER ()) THEN 'eval' ELSE 'train' END AS split FROM documents)")


def naive_bayes_ctes() -> str:
    """CTEs tk, counts, classes, v, ev, pred over the documents split."""
    return f"""
tk AS (SELECT doc_id, lang, split, {tokens('text')} AS toks FROM {SPLIT_FLAGGED}),
counts AS (SELECT lang AS label, token, count(*) AS n_tok
           FROM (SELECT lang, unnest(toks) AS token FROM tk WHERE split = 'train') GROUP BY lang, token),
classes AS (SELECT lang AS label, count(*) AS docs, sum(len(toks)) AS n_class
            FROM tk WHERE split = 'train' GROUP BY lang),
v AS (SELECT count(DISTINCT token) AS vocab FROM counts),
ev AS (SELECT doc_id, lang, toks FROM tk WHERE split = 'eval'),
tf AS (SELECT doc_id, token, count(*) AS f FROM (SELECT doc_id, unnest(toks) AS token FROM ev)
       GROUP BY doc_id, token),
sums AS (SELECT tf.doc_id, c.label, sum(tf.f * ln(c.n_tok + 1.0)) AS s
         FROM tf JOIN counts c USING (token) GROUP BY tf.doc_id, c.label),
scores AS (SELECT ev.doc_id, cl.label,
                  ln(cl.docs) + coalesce(s.s, 0) - len(ev.toks) * ln(cl.n_class + 1.0 * v.vocab) AS score
           FROM ev CROSS JOIN classes cl CROSS JOIN v
           LEFT JOIN sums s ON s.doc_id = ev.doc_id AND s.label = cl.label),
pred AS (SELECT doc_id, label AS predicted FROM
         (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label ASC) AS rn FROM scores)
         WHERE rn = 1)"""


SPECIALS_VALUES = "(VALUES " + ", ".join(
    f"({lit(t)}, {i})" for t, i, _, _ in domain.SPECIAL_TOKENS) + ") AS sp(token, id)"


def vocab_sql(texts: str, text: str) -> str:
    """(token, id, n) of words, ranked, plus reserved tokens with null n."""
    specials = ", ".join(lit(t) for t, _, _, _ in domain.SPECIAL_TOKENS)
    return (f"SELECT token, CAST({domain.FIRST_WORD_ID - 1} + row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS id, n "
            f"FROM (SELECT token, count(*) AS n FROM (SELECT unnest({tokens(text)}) AS token FROM {texts}) "
            f"WHERE token NOT IN ({specials}) GROUP BY token) "
            f"UNION ALL SELECT token, CAST(id AS INTEGER), CAST(NULL AS BIGINT) FROM {SPECIALS_VALUES}")


def encoded_ids(texts: str, key: str, text: str, vocab: str, max_length: int = domain.MAX_LENGTH) -> str:
    """(key, ids) with ids of the first max_length tokens (unknown -> unk)."""
    return (f"SELECT t.{key}, coalesce(list(coalesce(v.id, {domain.UNK_ID}) ORDER BY e.pos) "
            f"FILTER (WHERE e.pos IS NOT NULL), []) AS ids "
            f"FROM (SELECT {key}, list_slice({tokens(text)}, 1, {max_length}) AS tt FROM {texts}) t "
            f"LEFT JOIN (SELECT {key}, unnest(tt) AS token, generate_subscripts(tt, 1) AS pos "
            f"FROM (SELECT {key}, list_slice({tokens(text)}, 1, {max_length}) AS tt FROM {texts})) e "
            f"ON e.{key} = t.{key} LEFT JOIN ({vocab}) v ON v.token = e.token GROUP BY t.{key}")


def pad_left(ids: str, max_length: int = domain.MAX_LENGTH, value: int = domain.PAD_ID) -> str:
    return f"list_concat(list_transform(range({max_length} - len({ids})), lambda x: {value}), {ids})"


def mask(ids: str, max_length: int = domain.MAX_LENGTH) -> str:
    return (f"list_concat(list_transform(range({max_length} - len({ids})), lambda x: 0), "
            f"list_transform(range(len({ids})), lambda x: 1))")


def ids_text(x: str) -> str:
    return f"array_to_string({x}, ' ')"
