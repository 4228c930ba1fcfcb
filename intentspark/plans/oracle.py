"""DuckDB SQL for each registered query (the correctness oracle).

Tables ``documents``, ``events``, ``conversations`` ... are views over the
same parquet files. Written independently of the Spark plans: only the
fixed values are shared.
"""

from __future__ import annotations

from intentspark import domain
from intentspark.functions.text import SKIPPED_SPECIAL_PATTERN
from intentspark.plans import sqltext as S
from intentspark.plans.inputs import GENERATION_FIXTURE, N_FIXTURE

ORACLE: dict[str, str] = {}

ORACLE["resolve_documents"] = S.resolved(
    "(SELECT doc_id, text AS generated FROM documents)", "doc_id")

ORACLE["resolve_generations"] = (
    f"SELECT r.event_id, g.generated, r.cleaned, r.Category, r.resolved_by "
    f"FROM ({S.resolved(S.GENS, 'event_id')}) r JOIN {S.GENS} g USING (event_id)")

ORACLE["resolve_rule_table"] = (
    f"SELECT event_id, Category, resolved_by FROM ({S.resolved(S.GENS, 'event_id')})")

ORACLE["resolve_rule_table_join"] = S.resolved(
    f"(SELECT Id, Sentence AS generated FROM {S.USER_TURNS})", "Id")

_WORD_RULES = (
    f"(SELECT keyword, length(keyword) % {len(domain.CATEGORIES)} AS ord FROM (SELECT DISTINCT "
    f"unnest(regexp_extract_all(lower(Sentence), '[a-zà-ÿ]{{4,}}')) AS keyword FROM {S.USER_TURNS}))")
_NO_RULES, _NO_STAGES = S.resolve_cases("lowered", keywords={})
ORACLE["resolve_rules_documents"] = (
    f"WITH t AS (SELECT doc_id, cleaned, lowered, {_NO_RULES} AS c, {_NO_STAGES} AS stage FROM (SELECT *, lower(cleaned) AS lowered FROM "
    f"(SELECT doc_id, {S.clean('coalesce(text, ' + chr(39) * 2 + ')')} AS cleaned FROM documents))), "
    f"hits AS (SELECT doc_id, min(ord) AS ord FROM t JOIN {_WORD_RULES} r ON contains(t.lowered, r.keyword) "
    f"WHERE stage = 'default' GROUP BY doc_id) "
    f"SELECT doc_id, cleaned, CASE WHEN ord IS NULL THEN c ELSE list_extract({S.list_lit(domain.CATEGORIES)}, ord + 1) END AS Category, "
    f"CASE WHEN ord IS NULL THEN stage ELSE 'keyword' END AS resolved_by FROM t LEFT JOIN hits USING (doc_id)")

ORACLE["resolve_api"] = (
    f"SELECT event_id, {S.api_case(S.strip('lower(coalesce(generated, ' + chr(39) * 2 + '))'))} AS Category "
    f"FROM {S.GENS}")

_RESOLVED_GENS = f"(SELECT event_id AS Id, Category FROM ({S.resolved(S.GENS, 'event_id')}))"

ORACLE["category_counts"] = (
    f"SELECT Category, count(*) AS count FROM {_RESOLVED_GENS} GROUP BY Category")

ORACLE["submission_preview"] = (
    f"SELECT CAST(Id AS BIGINT) AS Id, Category FROM {_RESOLVED_GENS} ORDER BY Id LIMIT 5")


_PROMPT = f"({S.lit(domain.PROMPT_PREFIX)} || coalesce(Sentence, {S.lit(domain.NULL_SENTENCE)}) || {S.lit(domain.PROMPT_SUFFIX)})"

ORACLE["prompt_inference"] = f"SELECT Id, {_PROMPT} AS prompt FROM {S.USER_TURNS}"

ORACLE["prompt_training"] = f"SELECT Id, {_PROMPT} || Category AS text FROM {S.LABELLED_TURNS}"

ORACLE["label_ids"] = (
    f"SELECT Id, Category, CAST(list_position({S.list_lit(domain.CATEGORIES)}, Category) - 1 AS INTEGER) AS label_id, "
    f"list_extract({S.list_lit(domain.CATEGORIES)}, list_position({S.list_lit(domain.CATEGORIES)}, Category)) AS label "
    f"FROM {S.LABELLED_TURNS}")


def _chat(tail: str) -> str:
    piece = "CASE " + " ".join(
        f"WHEN role = '{r}' THEN {S.lit(f'<|{r}|>' + chr(10))} || coalesce(text, '') || {S.lit(domain.CHAT_TURN_END)}"
        for r in domain.CHAT_ROLES) + " ELSE '' END"
    return (f"SELECT conv_id, string_agg({piece}, '' ORDER BY turn) || {S.lit(tail)} AS text "
            f"FROM conversations GROUP BY conv_id")


ORACLE["render_chat_generation"] = _chat(domain.CHAT_GENERATION_TAIL)
ORACLE["render_chat_training"] = _chat(domain.EOS_TOKEN)

ORACLE["strip_special"] = (
    f"SELECT conv_id, regexp_replace(text, {S.lit(SKIPPED_SPECIAL_PATTERN)}, '', 'g') AS text "
    f"FROM ({_chat(domain.CHAT_GENERATION_TAIL)})")

ORACLE["split_documents"] = (
    "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) "
    "<= ceil(CAST(0.1 AS DOUBLE) * count(*) OVER ()) THEN 'eval' ELSE 'train' END AS split FROM documents")

ORACLE["split_sizes"] = (
    f"SELECT split, count(*) AS n FROM ({ORACLE['split_documents']}) GROUP BY split")

ORACLE["submission_csv"] = f"SELECT CAST(Id AS BIGINT) AS Id, Category FROM {_RESOLVED_GENS}"

ORACLE["sentences_csv_round_trip"] = f"SELECT Id, Sentence, Category FROM {S.LABELLED_TURNS}"

_TURN_GENS = (f"(SELECT Id, regexp_replace({S.fixture_pick('Id')}, {S.lit(SKIPPED_SPECIAL_PATTERN)}, '', 'g') "
              f"AS generated FROM {S.USER_TURNS})")

ORACLE["batch_predict"] = (
    f"SELECT r.Id, g.generated, r.Category, r.resolved_by "
    f"FROM ({S.resolved(_TURN_GENS, 'Id')}) r JOIN {_TURN_GENS} g USING (Id)")

ORACLE["batch_predict_errors"] = (
    f"SELECT r.Id, CASE WHEN r.Id % {N_FIXTURE} = {N_FIXTURE - 1} THEN NULL ELSE g.generated END AS generated, "
    f"CASE WHEN r.Id % {N_FIXTURE} = {N_FIXTURE - 1} THEN NULL ELSE r.Category END AS Category, "
    f"r.Id % {N_FIXTURE} = {N_FIXTURE - 1} AS failed "
    f"FROM ({S.resolved(_TURN_GENS, 'Id')}) r JOIN {_TURN_GENS} g USING (Id)")

_NB = "WITH " + S.naive_bayes_ctes()

ORACLE["intent_model_counts"] = f"{_NB} SELECT label AS lang, token, n_tok FROM counts"
ORACLE["model_save_load"] = ORACLE["intent_model_counts"]
ORACLE["intent_model_predict"] = f"{_NB} SELECT doc_id, predicted FROM pred"
ORACLE["intent_model_confusion"] = (
    f"{_NB} SELECT ev.lang AS truth, pred.predicted, count(*) AS n "
    f"FROM ev JOIN pred USING (doc_id) GROUP BY ev.lang, pred.predicted")
ORACLE["intent_model_metrics"] = (
    f"{_NB}, pairs AS (SELECT ev.lang AS truth, pred.predicted FROM ev JOIN pred USING (doc_id)), "
    f"m AS (SELECT 'accuracy' AS metric, avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END) AS value FROM pairs "
    f"UNION ALL SELECT 'recall:' || truth, avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END) FROM pairs GROUP BY truth) "
    f"SELECT metric, round(CAST(value AS DOUBLE), 6) AS value, printf('%s: %.4f', metric, CAST(value AS DOUBLE)) AS line FROM m")

ORACLE["intent_model_best"] = (
    f"{_NB}, g AS (SELECT unnest([0.01, 0.1, 0.3, 1.0, 3.0])::DOUBLE AS alpha), "
    f"gs AS (SELECT alpha, doc_id, label, sum(f * (ln(n_tok + alpha) - ln(alpha))) AS s FROM tf JOIN counts USING (token), g "
    f"GROUP BY alpha, doc_id, label), "
    f"gp AS (SELECT alpha, ev.doc_id, ev.lang AS truth, cl.label AS predicted FROM ev, classes cl, v, g "
    f"LEFT JOIN gs ON gs.alpha = g.alpha AND gs.doc_id = ev.doc_id AND gs.label = cl.label "
    f"QUALIFY row_number() OVER (PARTITION BY g.alpha, ev.doc_id ORDER BY ln(cl.docs) + coalesce(gs.s, 0) "
    f"- len(ev.toks) * ln(cl.n_class + g.alpha * v.vocab) DESC, cl.label) = 1), "
    f"top AS (SELECT alpha FROM gp GROUP BY alpha ORDER BY count(*) FILTER (truth = predicted) DESC, alpha LIMIT 1) "
    f"SELECT alpha, truth, predicted, count(*) AS n FROM gp JOIN top USING (alpha) GROUP BY ALL").replace(
        "SELECT alpha, ev.doc_id", "SELECT g.alpha, ev.doc_id")

ORACLE["vocab"] = f"SELECT token, id, n FROM ({S.vocab_sql(S.USER_TURNS, 'Sentence')}) WHERE n IS NOT NULL"

_TEXTS = (f"(SELECT Id, {_PROMPT} || Category AS text, {_PROMPT} AS prompt FROM {S.LABELLED_TURNS})")
_TVOCAB = S.vocab_sql(_TEXTS, "text")
_PIDS = S.encoded_ids(_TEXTS, "Id", "prompt", _TVOCAB)
_TIDS = S.encoded_ids(_TEXTS, "Id", "text", _TVOCAB)

ORACLE["encode_prompts"] = (
    f"SELECT Id, {S.ids_text(S.pad_left('ids'))} AS input_ids, {S.ids_text(S.mask('ids'))} AS attention_mask "
    f"FROM ({_PIDS})")

ORACLE["encode_training"] = (
    f"SELECT Id, {S.ids_text('padded')} AS input_ids, {S.ids_text(S.mask('ids'))} AS attention_mask, "
    f"{S.ids_text('list_transform(padded, lambda x, i: CASE WHEN i - 1 < hidden THEN -100 ELSE x END)')} AS labels "
    f"FROM (SELECT i.Id, i.ids, {S.pad_left('i.ids')} AS padded, "
    f"{domain.MAX_LENGTH} - len(i.ids) + least(len(list_slice({S.tokens('t.prompt')}, 1, {domain.MAX_LENGTH})), len(i.ids)) AS hidden "
    f"FROM ({_TIDS}) i JOIN {_TEXTS} t USING (Id))")

ORACLE["collate_causal"] = (
    f"SELECT Id, {S.ids_text('list_transform(' + S.pad_left('ids') + f', lambda x: CASE WHEN x = {domain.PAD_ID} THEN -100 ELSE x END)')} AS labels "
    f"FROM ({_TIDS})")

ORACLE["truncation_report"] = (
    f"SELECT lang, count(*) AS rows, CAST(sum(CASE WHEN len({S.tokens('text')}) > {domain.MAX_LENGTH} THEN 1 ELSE 0 END) AS BIGINT) AS truncated, "
    f"CAST(max(len({S.tokens('text')})) AS BIGINT) AS max_tokens FROM documents GROUP BY lang")

_API_TURNS = f"(SELECT Id, {S.api_case(S.strip('lower(coalesce(generated, ' + chr(39) * 2 + '))'))} AS Category FROM {_TURN_GENS})"

ORACLE["stream_predict"] = f"SELECT Id, Category FROM {_API_TURNS}"

ORACLE["request_validation"] = (
    "SELECT conv_id, turn, role = 'user' AS valid, CASE WHEN role = 'user' THEN text END AS sentence "
    "FROM conversations")

_SERVED = (
    f"(SELECT Id, role = 'user' AND Id % {N_FIXTURE} <> {N_FIXTURE - 1} AS good, CASE role WHEN 'user' THEN "
    f"'generation failed: RuntimeError: generation failed' WHEN 'assistant' THEN 'no string field sentence' ELSE 'not JSON' END AS why, "
    f"regexp_replace({S.fixture_pick('Id')}, {S.lit(SKIPPED_SPECIAL_PATTERN)}, '', 'g') AS generated "
    f"FROM (SELECT CAST(conv_id AS BIGINT) * {S.TURN_BASE} + turn AS Id, role FROM conversations))")

ORACLE["stream_requests"] = (
    f"SELECT Id, CASE WHEN good THEN 'answered' ELSE 'rejected' END AS status, "
    f"CASE WHEN good THEN {S.api_case(S.strip('lower(generated)'))} END AS category, CASE WHEN NOT good THEN why END AS reason "
    f"FROM {_SERVED}")

ORACLE["stream_totals"] = (
    f"SELECT count(*) AS rows, count(*) FILTER (good) AS answered, count(*) FILTER (NOT good) AS rejected FROM {_SERVED}")

ORACLE["json_round_trip"] = (
    f"SELECT event_id, '{{\"category\":\"' || Category || '\"}}' AS response, Category AS category FROM "
    f"(SELECT event_id, {S.api_case(S.strip('lower(coalesce(generated, ' + chr(39) * 2 + '))'))} AS Category FROM {S.GENS})")

_HYG = (f"(SELECT Id, conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 0 THEN {S.lit(' ' + chr(9) + chr(0x3000) + ' ')} "
        f"WHEN (conv_id + turn) % 5 = 3 THEN {S.lit(' Exit' + chr(10))} "
        f"ELSE ' ' || Sentence || chr(10) END AS text FROM {S.USER_TURNS})")

ORACLE["clean_requests"] = (
    f"SELECT Id, {S.strip('text')} AS request FROM {_HYG} WHERE {S.strip('text')} <> ''")

ORACLE["until_exit"] = (
    f"SELECT Id, {S.strip('text')} AS request FROM "
    f"(SELECT *, min(CASE WHEN lower({S.strip('text')}) = 'exit' THEN turn END) OVER (PARTITION BY conv_id) AS exit_at FROM {_HYG}) "
    f"WHERE (exit_at IS NULL OR turn < exit_at) AND {S.strip('text')} <> ''")

ORACLE["table_round_trip"] = f"SELECT Id, Sentence, Category FROM {S.LABELLED_TURNS}"

_PROMPT_GENS = (f"(SELECT Id, regexp_replace(list_extract({S.list_lit(GENERATION_FIXTURE)}, "
                f"CAST(length({_PROMPT}) % {N_FIXTURE} AS INTEGER) + 1), {S.lit(SKIPPED_SPECIAL_PATTERN)}, '', 'g') "
                f"AS generated FROM {S.USER_TURNS})")

ORACLE["batch_predict_distinct"] = (
    f"SELECT r.Id, g.generated, r.Category, r.resolved_by "
    f"FROM ({S.resolved(_PROMPT_GENS, 'Id')}) r JOIN {_PROMPT_GENS} g USING (Id)")

ORACLE["batch_predict_resumed"] = ORACLE["batch_predict_distinct"]
ORACLE["until_exit_stream"] = ORACLE["until_exit"]
ORACLE["prompt_label_table"] = ORACLE["prompt_inference"]
ORACLE["unlabelled_csv"] = f"SELECT Id, Sentence FROM {S.LABELLED_TURNS}"
ORACLE["submission_order"] = (
    f"SELECT CAST(Id AS BIGINT) AS Id, Category, row_number() OVER (ORDER BY Id) - 1 AS place FROM {_RESOLVED_GENS}")

_BATCHES = (
    f"WITH e AS (SELECT Id, ids, len(ids) AS n_tokens, len(ids) // 16 AS b, "
    f"md5('42:1:' || Id || ':' || md5({S.ids_text('ids')})) AS h FROM ({_TIDS})), "
    f"p AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY h, Id) - 1 AS i FROM e), "
    f"g AS (SELECT b, i // 16 AS no, max(n_tokens) AS longest FROM p GROUP BY b, i // 16), "
    f"o AS (SELECT *, row_number() OVER (ORDER BY md5('42:1:' || b || ':' || no), b, no) - 1 AS batch FROM g), "
    f"r AS (SELECT p.*, o.longest, o.batch FROM p JOIN o ON o.b = p.b AND o.no = p.i // 16) ")
ORACLE["epoch_batches"] = _BATCHES + (
    f"SELECT Id, batch, CAST(i % 16 AS INTEGER) AS place, CAST(n_tokens AS INTEGER) AS n_tokens, CAST(longest AS INTEGER) AS longest, "
    f"{S.ids_text(f'list_concat(list_transform(range(longest - n_tokens), lambda x: {domain.PAD_ID}), ids)')} AS input_ids, "
    f"{S.ids_text('list_concat(list_transform(range(longest - n_tokens), lambda x: 0), list_transform(range(n_tokens), lambda x: 1))')} AS attention_mask FROM r")
ORACLE["batch_padding"] = _BATCHES + (
    f"SELECT rows, batches, tokens, padding, round(padding / (tokens + padding), 6) AS share, "
    f"round((rows * {domain.MAX_LENGTH} - tokens) / (rows * {domain.MAX_LENGTH}), 6) AS fixed_share FROM ("
    f"SELECT count(*) AS rows, count(*) FILTER (i % 16 = 0) AS batches, CAST(sum(n_tokens) AS BIGINT) AS tokens, "
    f"CAST(sum(longest - n_tokens) AS BIGINT) AS padding FROM r)")
