"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose statistic is above a cutoff. The cutoffs
are learned per stratum from labelled good documents: a sequence of cutoffs is
walked from the most lenient to the strictest, and a step is accepted as long
as the exact binomial test rejects "the true rate of false rejections is above
alpha" (P[Bin(n, alpha) <= k] <= delta, which is the Clopper-Pearson upper
bound being at most alpha). The walk stops at the first step that fails
(fixed-sequence testing), so a walk is one test. The strata share delta
(Bonferroni). Within a stratum, of any size, the rules walk together along
``SEQUENCE``, whose steps move one rule, in turn, to its next cutoff. What any
rule rejects is tested at the whole alpha and the stratum's delta.

With probability 1 - delta no stratum loses more than alpha of its good
documents to the rules. Where even no false rejection would not do (below 217
labelled good documents for four strata) the first step fails, so a stratum
gets no cutoffs and loses nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentspark.llm.common import SPACES, documents, prepare, window_hashes, word_hashes, written
from intentspark.sources.tables import read_table

ALPHA = 0.02
DELTA = 0.05
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WIDTH = 5
SYMBOLS = "#*$%&|<>"

#: Rule -> cutoffs from the most lenient to the strictest; a document is rejected above its cutoff.
RULES = {
    "symbols_per_word": [round(float(x), 4) for x in np.geomspace(2.0, 0.01, 40)],
    "dup_line_ratio": [round(float(x), 4) for x in np.linspace(0.98, 0.02, 40)],
    "bangs_per_word": [round(float(x), 4) for x in np.geomspace(2.0, 0.01, 40)],
    "capital_ratio": [round(float(x), 4) for x in np.linspace(0.98, 0.05, 40)],
    "repeat_ratio": [round(float(x), 4) for x in np.linspace(0.2, 0.005, 40)],
}
#: (rule, cutoff) step by step; the grids are equally long.
SEQUENCE = [step for level in zip(*RULES.values(), strict=True) for step in zip(RULES, level)]
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_capitals")


def measure(text: str | None) -> tuple:
    """The counts of ``_COUNTS`` for one whole text; all 0 for null.

    Words are runs of anything but the six ASCII white-space characters;
    lines count when they hold a word; a line is a repeat if an equal one
    stands before it; a word repeats if it lies in a window of five words that
    the text holds twice or more.
    """
    if not text:
        return (0,) * len(_COUNTS)
    data = text.encode("utf-8")
    words = word_hashes(data)
    n, repeat = len(words), 0
    h = window_hashes(words, REPEAT_WIDTH)
    if len(h) > 1:
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if same.any():
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for k in range(REPEAT_WIDTH):
                covered[k:k + len(h)] |= twice
            repeat = int(np.count_nonzero(covered))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    raw = np.frombuffer(data, np.uint8)
    capitals = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeat, len(lines), text.count("!"), capitals)


def _measured(batches):
    for batch in batches:
        names = batch.schema.names
        rows = [measure(t) for t in batch.column(names.index("_text")).to_pylist()]
        cols = [batch.column(i) for i, c in enumerate(names) if c != "_text"]
        counts = np.array(rows, np.int64).reshape(len(rows), len(_COUNTS))
        yield pa.RecordBatch.from_arrays(
            [*cols, *(pa.array(counts[:, i]) for i in range(len(_COUNTS)))],
            [*(c for c in names if c != "_text"), *(f"_{c}" for c in _COUNTS)])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the counts of :func:`measure` as ``_n_words`` ..."""
    prepare(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]
    src = docs.select(*rest, F.col(text).alias("_text"))
    schema = T.StructType([*docs.select(*rest).schema.fields, *(T.StructField(f"_{c}", T.LongType()) for c in _COUNTS)])
    return src.mapInArrow(_measured, schema)


def statistics() -> dict:
    """The rules' statistics as expressions over :func:`measured`."""
    words, lines = F.greatest(F.col("_n_words"), F.lit(1)), F.greatest(F.col("_n_lines"), F.lit(1))
    return {
        "symbols_per_word": F.col("_n_symbols") / words,
        "dup_line_ratio": F.col("_n_dup_lines") / lines,
        "bangs_per_word": F.col("_n_bangs") / words,
        "capital_ratio": F.col("_n_capitals") / F.greatest(F.col("_word_chars"), F.lit(1)),
        "repeat_ratio": F.col("_n_repeat_words") / words,
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P[Bin(n, p) <= k], summed exactly from the largest term down."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p)
            + (n - i) * math.log1p(-p) for i in range(k, -1, -1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose_cutoff(false_rejections, n: int, alpha: float, delta: float) -> int:
    """How many cutoffs of a grid (lenient to strict) pass: the walk stops at the first that does not."""
    passed = 0
    for k in false_rejections:
        # beyond the mean the tail is over delta anyway; that also bounds the sum
        if k > alpha * n or binomial_tail(int(k), n, alpha) > delta:
            break
        passed += 1
    return passed


def learn_cutoffs(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, <rule> ...): one row per stratum with a cutoff or null for each rule.

    ``good``: labelled good documents, with ``stratum`` and the statistics.
    The counts behind the tests are one aggregation with a fixed number of
    columns; each stratum's row is tested by itself.
    """
    strata = max(1, good.agg(F.count_distinct(F.struct("stratum"))).first()[0])

    def first_step(no: int, rule: str):
        grid = F.array(*[F.lit(c) for c in RULES[rule]])
        return F.when(F.col(rule) > F.lit(RULES[rule][-1]),
                      F.size(F.filter(grid, lambda c: c >= F.col(rule))) * len(RULES) + no)

    # the first step that rejects a document; all later ones do too
    first = F.least(*[first_step(no, rule) for no, rule in enumerate(RULES)])
    per = good.withColumn("first", first).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.count_if(F.col("first") <= F.lit(i)) for i in range(len(SEQUENCE))]).alias("together"))

    def cutoffs(row) -> dict:
        # of a rule's steps the last holds
        return dict(SEQUENCE[:choose_cutoff(row["together"], int(row["n"]), alpha, delta / strata)])

    def pick(pdfs):
        for pdf in pdfs:
            cuts = [cutoffs(row) for row in pdf.to_dict("records")]
            yield pd.DataFrame({"stratum": pdf["stratum"]} | {
                r: pd.Series([c.get(r) for c in cuts], dtype="float64") for r in RULES})

    return per.mapInPandas(pick, "stratum string, " + ", ".join(f"{r} double" for r in RULES))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA,
          delta: float = DELTA) -> DataFrame:
    """``docs`` (doc_id, text, the stratum, any more) without the text, with
    the base counts, ``base_failed``, ``rejected_by`` and ``kept``.

    ``labels``: (doc_id, quality); rows with a null in either are not used,
    and a doc_id labelled both ways is not used as good. The holdout is the
    good documents that pass the base rules. A null text counts as empty (it
    fails the base), a null stratum is a stratum of its own, repeated rows
    are judged alike, an empty table gives an empty result. A column of a
    result's name (``_n_words`` ..., ``base_failed``, ``rejected_by``,
    ``kept``) is replaced; any other name is the caller's.
    """
    result = (*(f"_{c}" for c in _COUNTS), "base_failed", "rejected_by", "kept")
    kept = [c for c in docs.columns if c != "text" and c.lower() not in result]
    packed = docs.select(F.struct(*kept).alias("row"), F.col("doc_id").alias("id"),
                         F.col(stratum).cast("string").alias("stratum"), "text")
    m = written(measured(packed), "rules-measured")
    m = m.withColumn("base_failed", (F.col("_n_words") < MIN_WORDS)
                     | (100 * F.col("_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_n_words")))
    m = m.withColumns(statistics())
    good = (labels.filter("doc_id is not null and quality is not null").groupBy("doc_id")
            .agg(F.min("quality").alias("q")).filter("q = 1").select(F.col("doc_id").alias("id")))
    held = m.filter(~F.col("base_failed")).join(good, "id", "left_semi")
    cuts = written(learn_cutoffs(held.select("stratum", *RULES), alpha, delta), "rules-cutoffs")
    cut = F.col("c.cut")
    j = m.alias("m").join(cuts.select("stratum", F.struct(*RULES).alias("cut")).alias("c"),
                          F.col("m.stratum").eqNullSafe(F.col("c.stratum")), "left")
    broken = F.array_compact(F.array(*[F.when(F.col(f"m.{r}") > cut[r], F.lit(r)) for r in RULES]))
    j = j.select("m.*", F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(broken).alias("rejected_by"))
    return j.select(*[F.col("row")[c].alias(c) for c in kept], *result[:-2], "rejected_by",
                    (F.size("rejected_by") == 0).alias("kept"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all documents; strata are the languages."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.col("lang").alias("stratum"))
    out = judge(docs, read_table(spark, sf_dir, "labels"), "stratum")
    base = [F.col(f"_{c}").alias(c) for c in _COUNTS[:5]]
    return out.select("doc_id", *base, "base_failed", "kept", F.concat_ws(",", "rejected_by").alias("rejected_by"))
