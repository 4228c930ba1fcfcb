"""Chat formatting, hard negatives and importance resampling against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from intentspark.llm import chat, negatives, resampling, templates
from intentspark.llm.templates import Template, TemplateError

# 11 --- the template language


@pytest.mark.parametrize("source, expected", [
    ("a{{ 1 + 2 * 3 }}b", "a7b"),
    ("{{ 'x' ~ 1 ~ none }}", "x1"),
    ("{{ (1 + 2) * 3 }}{{ 7 // 2 }}{{ 7 % 4 }}{{ -2 }}", "933-2"),
    ("{{ 'yes' if 1 < 2 and not false else 'no' }}", "yes"),
    ("{{ 'b' in 'abc' }}{{ 'x' not in ['x', 'y'] }}", "TrueFalse"),
    ("{{ nothing is defined }}{{ none is none }}{{ 1 is not none }}", "FalseTrueTrue"),
    ("{{ not not 1 }}{{ 'a' == 'a' }}", "TrueTrue"),
    ("{{ \" A b \" | trim | upper }}", "A B"),
    ("{{ nothing | default('d') }}{{ 'abc' | length }}", "d3"),
    ("a  {{- ' b' -}}  c", "a bc"),
    ("a {# {{ not read }} #}b", "a b"),
    ("{{ '}}' }}{{ '%}' }}{{ 'a\\'b\\n' }}", "}}%}a'b\n"),
    ("{% if x %}1{% elif 2 > 1 %}2{% else %}3{% endif %}", "2"),
    ("{% set x = 'v' %}{{ x }}{% for i in [1, 2] %}{% set x = i %}{{ x }}{% endfor %}{{ x }}", "v12v"),
    ("{% for i in ['a', 'b'] %}{{ loop.index }}{{ i }}{{ '' if loop.last else ',' }}{% endfor %}", "1a,2b"),
    ("{{ [1, [2, 3]][1][0] }}{{ [1][5] }}{{ 'abc'[-1] }}", "2c"),
])
def test_template_expressions(source, expected):
    assert Template(source).render([])[0] == expected


@pytest.mark.parametrize("source", [
    "{{ 1", "{% if 1 %}", "{% for x %}{% endfor %}", "{{ 'a' | evil }}", "{% include 'x' %}", "{{ f() }}", "{{ 1 // 0 }}",
    "{{ 'a' * 9 }}", "{{ 1 + 'a' }}", "{{ [1] }}", "{# open", "{{ a b }}", "{{ 1 %}", "{% endfor %}", "{{ 1 < 'a' }}",
    "{{ " + "(" * 80 + "1" + ")" * 80 + " }}", "{% if 1 %}" * 80 + "{% endif %}" * 80, "x" * 100_001,
    "{{ 99999999999 * 99999999999 * 99999999999 }}", "{% for a in 'text' %}{% endfor %}",
])
def test_template_errors(source):
    with pytest.raises(TemplateError):
        Template(source).render([])


def test_template_is_closed():
    got = Template("{{ messages.__class__ }}{{ messages[0].__class__ }}{{ messages[0].text.upper }}|{{ ''.__len__ }}")
    assert got.render([{"text": "t"}])[0] == "|"
    endless = "{% for a in m %}" * 9 + "{% endfor %}" * 9
    with pytest.raises(TemplateError):
        Template("{% set m = " + str(list(range(50))) + " %}" + endless).render([])
    with pytest.raises(TemplateError):
        Template("{% set x = 'aaaaaaaa' %}" + "{% set x = x ~ x %}" * 40).render([])


def test_template_folding():
    t = Template("{{ bos }}-{% if gen %}{{ 'a' ~ 'b' }}{% else %}{{ messages }}{% endif %}-{{ 1 + 1 }}", {"bos": "<s>", "gen": True})
    assert t.tree == (templates.Node("text", ("<s>-ab-2",)),)
    assert Template("{{ true or messages }}").tree == (templates.Node("text", ("True",)),)
    t = Template("{% for bos in messages %}{{ bos.text }}{% endfor %}", {"bos": "<s>"})  # a loop's name hides a constant
    assert t.render([{"text": "x"}])[0] == "x"


def test_generation_spans():
    t = Template("{% for m in messages %}<{% generation %}{{ m.text }}{% generation %}!{% endgeneration %}{% endgeneration %}>{% endfor %}")
    text, spans = t.render([{"text": "ab"}, {"text": ""}])
    assert text == "<ab!><!>" and spans == [(1, 4), (6, 7)]


def test_turns_make_the_conversation():
    source = "{{ 'B' }}{% for m in messages %}{{ loop.index0 }}{{ m.text }}{% if loop.last %}.{% endif %}{% endfor %}E"
    t = Template(source)
    messages = [{"text": c} for c in "xyz"]
    assert t.by_turn and t.uses_place
    assert "".join(t.render_turn(m, i, 3)[0] for i, m in enumerate(messages)) == t.render(messages)[0] == "B0x1y2z.E"
    assert not Template("{% for m in messages %}{{ messages[0].text }}{% endfor %}").by_turn
    assert not Template(chat.CHAT, chat.CONSTANTS, {"guard": chat.guard}).uses_place


NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "[[INST]]", "<<s>s>", "</s></s>", "[INST", "[ROLE] x [/ROLE]",
         "", " ", "\n", "😀 [TEXT] é", "[\\INST]", "<s", "a\\"]


def test_guard_is_reversible_and_complete():
    rng = random.Random(3)
    parts = [*chat.CONTROLS, "\\", "<", "[", "/", "s>", "INST]", " ", "x", "é"]
    for text in NASTY + ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3000)]:
        guarded = chat.guard(text)
        assert not any(c in guarded for c in chat.CONTROLS)
        assert chat.unguard(guarded) == text


def brute_chat(rows):
    found = collections.defaultdict(list)
    for c, turn, role, text in rows:
        found[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    for c, turns in found.items():
        turns.sort()
        said = [(r, t) for _, _, r, _, t in turns]
        loss = "".join(t for r, t in said if r == "assistant")
        yield (c, len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(loss),
               hashlib.sha256(loss.encode()).hexdigest())


CONVERSATIONS = [(i, t, role, text) for i in range(4) for t, text in enumerate(NASTY)
                 for role in [("user", "assistant", "system", "tool [INST]")[(i + t) % 4]]]
CONVERSATIONS += [(None, None, None, None), (None, 1, "assistant", "x"), (7, 0, "assistant", "same"), (7, 0, "assistant", "same"),
                  (7, 0, "user", None), (8, 3, "", "[/ROLE]"), (9, 0, "assistant", "long <s> " * 30000)]
CONVERSATIONS += [(5, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(1000)]  # a hot conversation


@pytest.fixture(scope="module")
def talks(spark):
    rows = [(*r, "p", 3) for r in CONVERSATIONS]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, piece string, tie int").repartition(5)


def test_chat_round_trip(talks):
    got = {tuple(r)[:5] for r in chat.digests(chat.format_turns(talks)).collect()}
    assert got == set(brute_chat(CONVERSATIONS))
    assert chat.digests(chat.format_turns(talks.limit(0))).count() == 0


def test_chat_query(spark, sf):
    got = {r["conv_id"]: r for r in chat.op11_chat(spark, sf).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    expected = list(brute_chat(rows + chat.PROBE))
    assert len(got) == len(expected)
    assert all(tuple(got[e[0]])[:5] == e for e in expected)
    probe = "<s>[INST] <\\/s>[\\INST] ok [\\/INST] [/INST][TEXT] <\\/s>[\\INST] ok [\\/INST]</s>"
    assert got[-1]["formatted_chars"] == len(probe)


def test_chat_places(talks):
    template = "{% for m in messages %}{{ loop.index0 }}/{{ loop.length }}{{ m.role }};{% endfor %}{% if ask %}END{% endif %}"
    got = collections.defaultdict(list)
    for r in chat.format_turns(talks, template, {"ask": True}).orderBy("conv", "turn", "tie").collect():
        got[r["conv"]].append(r["piece"])
    said = collections.defaultdict(list)
    for c, t, role, text in CONVERSATIONS:
        said[c].append((t is not None, t or 0, role or "", hashlib.md5((text or "").encode()).hexdigest()))
    for c, turns in said.items():
        roles = [r for _, _, r, _ in sorted(turns)]
        expected = "".join(f"{i}/{len(roles)}{r};" for i, r in enumerate(roles)) + "END"
        assert sorted("".join(got[c])) == sorted(expected)
        assert c == 7 or "".join(got[c]) == expected  # wholly equal rows may swap places
    assert chat.format_turns(talks.limit(0), template).count() == 0
    with pytest.raises(TemplateError):
        chat.format_turns(talks, "{{ messages[0].text }}")


# 12 --- hard negatives

def brute_negatives(rows, most=5):
    """rows: (id, label, vec); each row stands for itself."""
    out = []
    for i, (a, label, vec) in enumerate(rows):
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vec, v)), b, lab, j) for j, (b, lab, v) in enumerate(rows) if j != i)
        for p, pid, lab, _ in [s for s in scored if s[2] == label][:most]:
            fit = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:most]
            out += [(a, pid, k, s[1], -p, -s[0]) for k, s in enumerate(fit, 1)]
    return sorted(out)


def vector_rows(n, dims, seed, top=20):
    rng = random.Random(seed)
    rows = [(i, rng.randint(0, 3), [rng.randint(-5, top) for _ in range(dims)]) for i in range(n)]
    hot = [3] * dims
    return [(i, lab, hot if i % 3 == 0 else v) for i, lab, v in rows]  # a third of all vectors are one


SCHEMA = "id bigint, label bigint, vec array<bigint>, tops string, key string, row int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "k", 1) for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("n, anchors, values", [(450, 1 << 22, 1 << 20), (450, 8, 256), (7, 8, 256)])
def test_negatives_match_brute_force(spark, monkeypatch, n, anchors, values):
    monkeypatch.setattr(negatives, "ANCHOR_VALUES", anchors)  # small: many blocks and cells
    monkeypatch.setattr(negatives, "ROW_VALUES", values)
    rows = vector_rows(n, 6, n)
    rows += [(200, rows[0][1], [4] * 6), (200, rows[0][1], [4] * 6), (5, 1, [4] * 6), (5, 1, [4] * 6)]  # repeated rows
    got = negatives.mine(frame(spark, rows), F.col("id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_negatives_odd_rows(spark):
    rows = [(0, 1, [1, 2]), (1, 1, [9]), (2, 2, [5, 1, 7]), (3, None, [1, 1]), (None, 1, [9, 9]), (4, 2, None), (6, 2, []),
            (5, 2, [1, None]), (100, 2, [-1, -1]), (8, 1, [2, 2])]
    got = negatives.mine(frame(spark, rows), F.col("id") % 100 == 0)
    whole = [(i, lab, v) for i, lab, v in rows if None not in (i, lab, v) and None not in v]
    padded = [(i, lab, (v + [0] * 3)[:3]) for i, lab, v in whole]
    assert sorted(map(tuple, got.collect())) == brute_negatives(padded)
    assert negatives.mine(frame(spark, rows[:1]).limit(0), F.lit(True)).count() == 0
    assert negatives.mine(frame(spark, rows), F.lit(False)).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(frame(spark, rows), F.lit(True), low=90, high=80)


def test_negatives_of_large_numbers(spark):
    big = 2 ** 30
    rows = [(0, 1, [big, 1]), (1, 1, [big, 3]), (2, 2, [big, 2]), (3, 2, [big - 1, 9]), (4, 2, [big, 3])]  # beyond a double
    got = negatives.mine(frame(spark, rows), F.col("id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_negative_keys_sort_as_read():
    import numpy as np
    n = np.array
    keys = [k.as_py() for k in negatives.pack(n([5, 5, -1]), n([0, 0, 1]), n([-3, 7, 2]), 0, n([4, 2, 9]), n([1, 2, 3]))]
    keys += [k.as_py() for k in negatives.pack(n([5]), n([0]), n([7]), 1, n([-4]), n([8]))]
    assert [negatives.unpack(k)[:5] for k in sorted(keys)] == [(-1, 1, 2, 0, 9), (5, 0, 7, 0, 2), (5, 0, 7, 1, -4), (5, 0, -3, 0, 4)]


def test_integer_vectors(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(7, 9, [0.5, -0.001]), (1, 3, [1.0]), (2, 1, [nan]), (3, 1, [inf]), (4, 1, None), (5, 1, [None]),
                                (14, None, [0.1])], "vec_id bigint, label int, embedding array<float>")
    got = {tuple(r)[:2]: list(r[2]) for r in negatives.integer_vectors(df).collect()}
    assert got == {(7, 0): [128, -1], (1, 3): [256], (14, None): [25]}


# 13 --- importance resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, runs):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i:i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)], len(words)


def brute_resample(rows, target, runs, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for x in xs for f in features(x, runs)[0]) for xs in ([x for _, x in rows], target))
    ns, nt = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for doc, text in rows:
        found, n = features(text, runs)
        gain = [math.floor(1000 * math.log((t[b] + 1) * ns / ((s[b] + 1) * nt))) for b in map(bucket, found)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(able[:len(able) * 10 // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


def same(a, b):
    return collections.Counter(map(tuple, a)) == collections.Counter(map(tuple, b))


def test_resampling_query(spark, sf, texts):
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    assert same(resampling.op13_resampling(spark, sf).collect(), brute_resample(texts, target, 1))


@pytest.mark.parametrize("runs, head, segment", [(1, 5, 64), (2, 300, 64), (3, 2, 1 << 20), (2, 0, 1 << 20)])
def test_resampling_runs_and_heads(spark, monkeypatch, texts, runs, head, segment):
    monkeypatch.setattr(resampling.word_lists, "__defaults__", (segment,))
    rows = [(i, t[:3000]) for i, t in texts[:60]] + [(1000, "The same old words, " * 200), (1001, "a b"), (1002, None)]
    target = [t for _, t in rows[5:9]] + ["the same old words", None]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, goal, runs=runs, head_size=head)
    assert same(got.collect(), brute_resample(rows, target, runs))


def test_resampling_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    goal = spark.createDataFrame([("one word call",)], "text string")
    assert same(resampling.resample(odd, goal).collect(), brute_resample(rows, ["one word call"], 1))
    assert resampling.resample(empty, goal).count() == 0
    assert same(resampling.resample(odd, goal.limit(0)).collect(), brute_resample(rows, [], 1))
    kept = resampling.resample(odd, goal, keep=("text", "copies"))
    assert kept.columns == ["doc_id", "n_features", "weight", "score", "rank", "kept"]
    assert same([(r["doc_id"], r["kept"]["text"]) for r in kept.collect()], rows)


def test_resampling_draws_exactly(spark):
    rows = [(i % 400 if i % 3 else None, "word " * (20 + i % 5)) for i in range(900)]  # a third without an id, others twice
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    ranks = [r["rank"] for r in resampling.resample(docs, docs.limit(3)).collect() if r["rank"]]
    assert sorted(ranks) == list(range(1, 91))


def test_summary_keeps_frequent_keys():
    counts = collections.Counter({f"w{i}": 1 for i in range(1000)} | {"hot": 500, "warm": 90})
    kept = resampling.trimmed(counts, 20)
    assert set(kept) >= {"hot", "warm"} and len(kept) <= 20
