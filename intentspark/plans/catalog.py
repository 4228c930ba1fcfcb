"""Registered queries: one per operator group of the inventory.

Each takes ``(spark, sf_dir)``, reads the whole provided tables (or data
Spark derives from them) and returns a lazy DataFrame. Column names match
the oracle SQL in :mod:`intentspark.plans.oracle`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentspark import domain
from intentspark.functions import text as text_fn
from intentspark.operators import batches, prompts, report, resolve as res, scoring
from intentspark.operators import encode as encode_op
from intentspark.operators import model as model_op
from intentspark.operators import softmax
from intentspark.operators import split as split_op
from intentspark.operators.indexing import with_row_index
from intentspark.plans import inputs
from intentspark.session import scratch_path
from intentspark.sources import csv as csv_io
from intentspark.sources import intents_table as intents
from intentspark.sources.tables import read_table
from intentspark.streaming import hygiene, serving
from intentspark.streaming import requests as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


# -- label resolution (RES-1..7) -------------------------------------------

@register
def resolve_documents(spark, sf_dir):
    """RES-1..5 + RES-7 over every document text."""
    docs = inputs.documents(spark, sf_dir).select("doc_id", F.col("text").alias("generated"))
    return res.resolve(docs).select("doc_id", "cleaned", "Category", "resolved_by")


@register
def resolve_generations(spark, sf_dir):
    """RES-1..5 + RES-7 over the generation fixture spread on ``events``."""
    return res.resolve(inputs.generations(spark, sf_dir)).select(
        "event_id", "generated", "cleaned", "Category", "resolved_by")


@register
def resolve_rule_table(spark, sf_dir):
    """RES-4 variant: keyword stage driven by the rule table."""
    out = res.resolve_with_rule_table(inputs.generations(spark, sf_dir), domain.keyword_table(spark))
    return out.select("event_id", "Category", "resolved_by")


@register
def resolve_rule_table_join(spark, sf_dir):
    """RES-4 variant over user turns: every text is its own sentence, met by the fixed keywords."""
    turns = inputs.user_turns(spark, sf_dir).select("Id", F.col("Sentence").alias("generated"))
    return res.resolve_with_rule_table(turns, domain.keyword_table(spark)).select("Id", "cleaned", "Category", "resolved_by")


@register
def resolve_rules_documents(spark, sf_dir):
    """RES-2..5 over every document text, with thousands of rules: each longer
    word of the user turns is a keyword."""
    docs = inputs.documents(spark, sf_dir).select("doc_id", F.col("text").alias("generated"))
    return res.resolve_with_rule_table(docs, inputs.word_rules(spark, sf_dir)).select(
        "doc_id", "cleaned", "Category", "resolved_by")


@register
def resolve_api(spark, sf_dir):
    """RES-6: request-path resolution."""
    return res.resolve_api(inputs.generations(spark, sf_dir)).select("event_id", "Category")


# -- reports (RPT-1..4) -----------------------------------------------------

def _resolved_gens(spark, sf_dir) -> DataFrame:
    return res.resolve(inputs.generations(spark, sf_dir), audit=False).select(
        F.col("event_id").alias("Id"), "Category")


@register
def category_counts(spark, sf_dir):
    """RPT-4 over the resolved generations."""
    return report.category_counts(_resolved_gens(spark, sf_dir))


@register
def submission_preview(spark, sf_dir):
    """RPT-1..3: cast, sort, first five rows."""
    return report.preview(report.submission(_resolved_gens(spark, sf_dir)), 5)


# -- prompts and labels (PRJ-2..6) ------------------------------------------

@register
def prompt_inference(spark, sf_dir):
    """PRJ-4 + PRJ-5: inference prompt per user turn."""
    return prompts.with_prompt(inputs.user_turns(spark, sf_dir)).select("Id", "prompt")


@register
def prompt_label_table(spark, sf_dir):
    """PRJ-4 + PRJ-5 with the category list joined from the label table."""
    listed = prompts.categories_string(domain.label_table(spark)).first()[0]  # one row
    turns = inputs.user_turns(spark, sf_dir)
    return turns.select("Id", prompts.prompt_expr("Sentence", categories_string=listed).alias("prompt"))


@register
def prompt_training(spark, sf_dir):
    """PRJ-6: prompt + label, no end marker."""
    return prompts.with_training_text(inputs.labelled_turns(spark, sf_dir)).select("Id", "text")


@register
def label_ids(spark, sf_dir):
    """PRJ-2 + PRJ-3: label -> ordinal -> label."""
    df = prompts.with_label_id(inputs.labelled_turns(spark, sf_dir))
    df = prompts.with_label(df, out="label")
    return df.select("Id", "Category", "label_id", "label")


# -- chat rendering and special tokens (PRJ-8, ENC-9) -----------------------

def _conversations(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations")


@register
def render_chat_generation(spark, sf_dir):
    """PRJ-8 with the generation tail."""
    return prompts.render_chat(_conversations(spark, sf_dir), add_generation_prompt=True)


@register
def render_chat_training(spark, sf_dir):
    """PRJ-8 ending with the end token."""
    return prompts.render_chat(_conversations(spark, sf_dir), add_generation_prompt=False)


@register
def strip_special(spark, sf_dir):
    """ENC-9: special tokens removed from rendered chats; ``</s>`` kept."""
    chats = prompts.render_chat(_conversations(spark, sf_dir), add_generation_prompt=True)
    return chats.select("conv_id", text_fn.strip_special("text").alias("text"))


# -- split (SPL-1, SPL-2) -----------------------------------------------------

@register
def split_documents(spark, sf_dir):
    """SPL-1: exact 10 % validation cut in seeded hash order."""
    docs = inputs.documents(spark, sf_dir).select("doc_id")
    return split_op.with_split(docs, "doc_id")


@register
def split_sizes(spark, sf_dir):
    """SPL-2: sizes of the two parts."""
    return split_op.split_sizes(split_documents(spark, sf_dir))


# -- CSV sources and sinks (SRC-1/2, SNK-1/2) --------------------------------

@register
def submission_csv(spark, sf_dir):
    """SNK-2 then SRC-2: write the sorted submission, read it back."""
    path = scratch_path(spark, "submission")
    csv_io.write_submission(_resolved_gens(spark, sf_dir), path)
    return csv_io.read_sentences(spark, path, columns=("Id", "Category"))


@register
def sentences_csv_round_trip(spark, sf_dir):
    """SNK-1 then SRC-1: labelled sentences (with newlines, commas, quotes)
    through CSV and back."""
    path = scratch_path(spark, "sentences")
    csv_io.write_csv(inputs.labelled_turns(spark, sf_dir).select("Id", "Sentence", "Category"), path)
    return csv_io.read_sentences(spark, path, labelled=True)


@register
def unlabelled_csv(spark, sf_dir):
    """SRC-2: sentences read without a label column, from files that order their
    columns differently and hold quoted newlines."""
    path = scratch_path(spark, "unlabelled")
    rows = inputs.labelled_turns(spark, sf_dir)
    csv_io.write_csv(rows.filter("turn < 3").select("Id", "Sentence"), path)
    csv_io.write_csv(rows.filter("turn >= 3").select("Category", "Sentence", "Id"), path, mode="append")
    return csv_io.read_sentences(spark, path, labelled=False)


@register
def submission_order(spark, sf_dir):
    """RPT-2: the place of every row in the submission's order."""
    return with_row_index(report.submission(_resolved_gens(spark, sf_dir)), ["Id"], out="place")


# -- batch scoring (MOD-1, MOD-7, path A) -------------------------------------

@register
def batch_predict(spark, sf_dir):
    """PRJ-5 -> MOD-1 (generator in mapInPandas) -> ENC-9 -> RES-1..5."""
    pred = scoring.predict(inputs.user_turns(spark, sf_dir), inputs.FixtureGeneratorFactory("Id"))
    return pred.select("Id", "generated", "Category", "resolved_by")


@register
def batch_predict_distinct(spark, sf_dir):
    """MOD-1 over distinct prompts: each distinct prompt is generated once
    and joined back to every row carrying it."""
    pred = scoring.predict(inputs.user_turns(spark, sf_dir), inputs.PromptFixtureGeneratorFactory(),
                           dedupe=True)
    return pred.select("Id", "generated", "Category", "resolved_by")


@register
def batch_predict_resumed(spark, sf_dir):
    """MOD-1 with a store of texts by prompt: a first run fills it, the second
    finds every prompt there and generates none."""
    store = scratch_path(spark, "texts")
    turns = inputs.user_turns(spark, sf_dir)
    scoring.predict(turns, inputs.PromptFixtureGeneratorFactory(), store=store).select("Id").count()
    pred = scoring.predict(turns, inputs.PromptFixtureGeneratorFactory(), store=store)
    return pred.select("Id", "generated", "Category", "resolved_by")


@register
def batch_predict_errors(spark, sf_dir):
    """MOD-7: a generator failing on some rows gives null there, not a crash."""
    pred = scoring.predict(inputs.user_turns(spark, sf_dir),
                           inputs.FixtureGeneratorFactory("Id", fail_on=inputs.N_FIXTURE - 1),
                           on_error="null")
    return pred.select("Id", "generated", "Category", F.col("error").isNotNull().alias("failed"))


# -- count model (MOD-2..5, SNK-3) --------------------------------------------

def _doc_split(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir).select("doc_id", "text", "lang")
    return split_op.with_split(docs, "doc_id")


def _fitted(spark, sf_dir):
    flagged = _doc_split(spark, sf_dir)
    train = flagged.filter(F.col("split") == "train")
    return flagged, model_op.fit_intent_model(train, label="lang", text="text")


@register
def intent_model_counts(spark, sf_dir):
    """MOD-2: token counts per label on the train part (label = lang)."""
    _, m = _fitted(spark, sf_dir)
    return m.counts.select(F.col("label").alias("lang"), "token", "n_tok")


@register
def intent_model_predict(spark, sf_dir):
    """MOD-3: predicted label of every held-out document."""
    flagged, m = _fitted(spark, sf_dir)
    ev = flagged.filter(F.col("split") == "eval")
    return model_op.score_intent_model(ev, m, key="doc_id", text="text")


def _evaluated(spark, sf_dir):
    flagged, m = _fitted(spark, sf_dir)
    ev = flagged.filter(F.col("split") == "eval")
    pred = model_op.score_intent_model(ev, m, key="doc_id", text="text", carry=["lang"])
    return model_op.evaluate_scored(pred, "lang")


@register
def intent_model_confusion(spark, sf_dir):
    """MOD-4: confusion counts on the held-out part."""
    return _evaluated(spark, sf_dir)[0]


@register
def intent_model_metrics(spark, sf_dir):
    """MOD-4 + MOD-5: accuracy and per-label recall, printed with 4 decimals."""
    lines = model_op.format_metrics(_evaluated(spark, sf_dir)[1])
    return lines.select("metric", F.round("value", 6).alias("value"), "line")


@register
def intent_model_best(spark, sf_dir):
    """MOD-4, keeping the best: smoothing chosen by the held-out part, and its confusion counts."""
    flagged, m = _fitted(spark, sf_dir)
    _, grid = model_op.best_smoothing(m, flagged.filter(F.col("split") == "eval"), "lang", "text")
    return grid.filter("best").select("alpha", "truth", "predicted", "n")


@register
def intent_softmax(spark, sf_dir):
    """MOD-2 + MOD-4 iteratively: softmax regression over ten epochs, the best by
    the held-out part kept; its predictions there."""
    flagged = _doc_split(spark, sf_dir)
    held = flagged.filter(F.col("split") == "eval")
    m = softmax.fit_softmax(flagged.filter(F.col("split") == "train"), held, "lang", "text")
    return softmax.score_softmax(held, m, key="doc_id", text="text", carry=["lang"])


@register
def model_save_load(spark, sf_dir):
    """SNK-3: the fitted tables written as parquet and read back."""
    _, m = _fitted(spark, sf_dir)
    path = scratch_path(spark, "model")
    model_op.save_model(m, path)
    back = model_op.load_model(spark, path)
    return back.counts.select(F.col("label").alias("lang"), "token", "n_tok")


# -- encoding (ENC-1..8) ------------------------------------------------------

@register
def vocab(spark, sf_dir):
    """ENC-1: word vocabulary of the user-turn sentences (reserved tokens
    keep their fixed ids; words ranked by count desc, token)."""
    v = encode_op.build_vocab(inputs.user_turns(spark, sf_dir), "Sentence")
    return v.filter(F.col("n").isNotNull())


def _training_texts(spark, sf_dir):
    df = prompts.with_training_text(inputs.labelled_turns(spark, sf_dir))
    return prompts.with_prompt(df)


@register
def encode_prompts(spark, sf_dir):
    """ENC-7 (= ENC-2 + ENC-3 on the inference prompt)."""
    texts = _training_texts(spark, sf_dir)
    enc = encode_op.encode(texts, encode_op.build_vocab(texts, "text"), key="Id", text="prompt")
    return encode_op.ids_as_text(enc, ["input_ids", "attention_mask"])


@register
def encode_training(spark, sf_dir):
    """ENC-2..5: prompt + label ids, mask, and the intended loss labels."""
    texts = _training_texts(spark, sf_dir)
    enc = encode_op.encode_training(texts, encode_op.build_vocab(texts, "text"), key="Id",
                                    text="text", prompt="prompt")
    return encode_op.ids_as_text(enc, ["input_ids", "attention_mask", "labels"])


@register
def collate_causal(spark, sf_dir):
    """ENC-6: labels the collator rebuilds from ids (pad id -> -100)."""
    texts = _training_texts(spark, sf_dir)
    enc = encode_op.encode(texts, encode_op.build_vocab(texts, "text"), key="Id", text="text")
    out = encode_op.collate_causal(enc)
    return encode_op.ids_as_text(out.select("Id", "labels"), ["labels"])


def _batches(spark, sf_dir):
    texts = _training_texts(spark, sf_dir)
    ids = encode_op.token_ids(texts, encode_op.build_vocab(texts, "text"), "Id", "text")
    return batches.epoch_batches(ids, "Id", epoch=1)


@register
def epoch_batches(spark, sf_dir):
    """ENC-6: an epoch's batches by length, each padded to its longest row."""
    return encode_op.ids_as_text(_batches(spark, sf_dir), ["input_ids", "attention_mask"])


@register
def batch_padding(spark, sf_dir):
    """ENC-6: how much of an epoch's batches is padding, and would be at a fixed length."""
    return batches.padding_report(_batches(spark, sf_dir))


@register
def truncation_report(spark, sf_dir):
    """ENC-8: documents longer than 256 tokens, per language."""
    return encode_op.truncation_report(inputs.documents(spark, sf_dir), by="lang", text="text")


# -- request path (SRC-6, SNK-4, MOD-6) and client hygiene (HYG-1, HYG-2) ----

def _request_bodies(spark, sf_dir):
    """One JSON body per user turn, carrying its Id for the join back."""
    turns = inputs.user_turns(spark, sf_dir)
    return turns.select("Id", F.to_json(F.struct(F.col("Id"), F.col("Sentence").alias("sentence")))
                        .alias("value"))


@register
def stream_predict(spark, sf_dir):
    """MOD-6: request files -> Structured Streaming (availableNow) -> validate
    -> prompt -> generator -> RES-6 -> JSON response -> parquet sink."""
    base = scratch_path(spark, "stream")
    src, out, ckpt = f"{base}/requests", f"{base}/responses", f"{base}/checkpoint"
    _request_bodies(spark, sf_dir).select("value").write.mode("overwrite").text(src)
    reqs = (spark.readStream.format("text").load(src)
            .withColumn("Id", F.get_json_object("value", "$.Id").cast("long")))
    resp = streams.stream_predict(reqs, inputs.FixtureGeneratorFactory("Id"), keep=("Id",))
    q = (resp.writeStream.format("parquet").option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    return streams.read_response(spark.read.parquet(out)).select("Id", F.col("category").alias("Category"))


def _serve(spark, sf_dir):
    """Every conversation row as a request, answered or rejected by the stream
    in micro-batches of two files; returns the sinks and the ledger's folder.

    User turns are good bodies, assistant turns have a number for a sentence,
    others are broken JSON; the generator fails where Id % 26 is 25."""
    base = scratch_path(spark, "serve")
    rows = _conversations(spark, sf_dir).select(
        (F.col("conv_id").cast("long") * inputs.TURN_BASE + F.col("turn")).alias("Id"), "turn", "role", "text")
    body = (F.when(F.col("role") == "user", F.to_json(F.struct("Id", F.col("text").alias("sentence"))))
            .when(F.col("role") == "assistant", F.to_json(F.struct("Id", F.col("turn").alias("sentence"))))
            .otherwise(F.concat(F.lit('{"Id":'), F.col("Id"))))
    rows.select(body.alias("value")).repartition(5).write.text(f"{base}/requests")
    ledger = serving.ProgressLedger(spark, f"{base}/ledger")
    spark.streams.addListener(ledger)
    try:
        reqs = serving.request_files(spark, f"{base}/requests", max_files=2) \
            .withColumn("Id", F.regexp_extract("value", r'"Id":(-?\d+)', 1).cast("long"))
        q = serving.serve_requests(reqs, inputs.FixtureGeneratorFactory("Id", fail_on=inputs.N_FIXTURE - 1),
                                   f"{base}/responses", f"{base}/rejects", f"{base}/checkpoint", keep=("Id",))
        q.awaitTermination()
        ledger.wait(q)
    finally:
        spark.streams.removeListener(ledger)
    return f"{base}/responses", f"{base}/rejects", f"{base}/ledger"


@register
def stream_requests(spark, sf_dir):
    """SRC-6 + MOD-6 + MOD-7 + SNK-4: a stream with bad bodies and failing rows;
    each request is in exactly one of the two sinks."""
    responses, rejects, _ = _serve(spark, sf_dir)
    good = streams.read_response(spark.read.parquet(responses)).select(
        "Id", F.lit(serving.ANSWERED).alias("status"), "category", F.lit(None).cast("string").alias("reason"))
    bad = spark.read.parquet(rejects).select(
        "Id", F.lit(serving.REJECTED).alias("status"), F.lit(None).cast("string").alias("category"), "reason")
    return good.unionByName(bad)


@register
def stream_totals(spark, sf_dir):
    """RPT-5 on a stream: rows by the ledger, answers and rejects by the sinks."""
    responses, rejects, ledger = _serve(spark, sf_dir)
    sinks = serving.request_totals(spark, responses, rejects).agg(
        F.sum("answered").alias("answered"), F.sum("rejected").alias("rejected"))
    counted = serving.stream_progress(spark, ledger).agg(F.sum("rows").alias("rows"))
    # two rows of one line each, put side by side by a grouping
    both = sinks.withColumn("rows", F.lit(None).cast("long")).unionByName(
        counted.select(F.lit(None).cast("long").alias("answered"), F.lit(None).cast("long").alias("rejected"), "rows"))
    return both.agg(*[F.max(c).alias(c) for c in ("rows", "answered", "rejected")])


@register
def request_validation(spark, sf_dir):
    """SRC-6: bodies with a string ``sentence`` pass; a number (assistant
    turns here) or a missing field (system turns) is rejected."""
    conv = _conversations(spark, sf_dir)
    body = (F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("sentence"))))
            .when(F.col("role") == "assistant", F.to_json(F.struct(F.col("turn").alias("sentence"))))
            .otherwise(F.to_json(F.struct(F.col("text").alias("note")))))
    return streams.read_requests(conv.select("conv_id", "turn", body.alias("value"))) \
        .select("conv_id", "turn", "valid", "sentence")


@register
def json_round_trip(spark, sf_dir):
    """SNK-4: response JSON built and its field read back."""
    resolved = res.resolve_api(inputs.generations(spark, sf_dir))
    return streams.read_response(streams.to_response(resolved)) \
        .select("event_id", "response", "category")


def _hygiene_input(spark, sf_dir):
    """User turns with whitespace around them; every turn where
    (conv_id + turn) % 5 = 0 is blank, every one where it is 3 says ' Exit '."""
    t = inputs.user_turns(spark, sf_dir)
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    text = (F.when(k == 0, F.lit(" \t　 "))
            .when(k == 3, F.lit(" Exit\n"))
            .otherwise(F.concat(F.lit(" "), F.col("Sentence"), F.lit("\n"))))
    return t.select("Id", "conv_id", "turn", text.alias("text"))


@register
def clean_requests(spark, sf_dir):
    """HYG-1: strip, drop blanks."""
    return hygiene.clean_requests(_hygiene_input(spark, sf_dir)).select("Id", "request")


@register
def until_exit(spark, sf_dir):
    """HYG-2 then HYG-1: per conversation, inputs before the first 'exit'."""
    kept = hygiene.until_exit(_hygiene_input(spark, sf_dir), session="conv_id", order="turn")
    return hygiene.clean_requests(kept).select("Id", "request")


@register
def until_exit_stream(spark, sf_dir):
    """HYG-2 then HYG-1 on a stream with state: early turns arrive first, later
    turns after a restart from the checkpoint."""
    base = scratch_path(spark, "sessions")
    turns = _hygiene_input(spark, sf_dir)
    schema = turns.schema
    for wave in (F.col("turn") < 3, F.col("turn") >= 3):
        turns.filter(wave).write.mode("append").parquet(f"{base}/in")
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{base}/in")
        kept = hygiene.clean_requests(hygiene.until_exit_stream(arriving, session="conv_id", order="turn"))
        kept.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint") \
            .trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("Id", "request")


# -- intents table (SRC-4, SRC-5) ---------------------------------------------

@register
def table_round_trip(spark, sf_dir):
    """SRC-5 then SRC-4: replace a catalog table with declared column types,
    read it back through the SQL projection."""
    name = "intents_" + uuid.uuid4().hex[:10]
    loc = scratch_path(spark, "intents")
    df = inputs.labelled_turns(spark, sf_dir).select("Id", "Sentence", "Category")
    intents.replace_table(df, name, loc)
    return intents.read_table_query(spark, name).select(
        F.col("Id").cast("long").alias("Id"), "Sentence", "Category")
