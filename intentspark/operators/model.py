"""Count-based intent model as DataFrame aggregations (MOD-2..MOD-5, SNK-3).

Multinomial naive Bayes with additive smoothing ``alpha``:

    score(doc, c) = ln(docs_c) + sum_t f(doc,t) * ln(n(c,t) + alpha)
                    - len(doc) * ln(n_c + alpha * V)

``n(c,t)`` token count in class ``c``, ``n_c`` all tokens of ``c``, ``V`` the
vocabulary size, ``len(doc)`` all tokens of the document (unseen ones too).
The predicted label is the arg-max (ties: smallest label).

Fitting tokenizes the training text once into the count table; class
totals, sizes and the vocabulary size are aggregates over it. Per-token
weights are taken relative to ln(alpha), so only matched tokens need rows:
each text is exploded where it is read, joined with the weights and summed per
row before anything is shuffled, so no text and no token crosses a shuffle when
the weights fit a broadcast.

Weights are rounded to multiples of 2^-24 and summed as integers, so a sum is
the same in any order and for any number of equal rows, and ties are decided
alike everywhere.

* Up to ``PIVOT_LABELS`` labels, a token's weights stand side by side in one row,
  a row's sums come from one aggregate, and the labels' lines are literals.
* With more labels, sums are per row and label. Labels that a row doesn't match
  at all score by their line ln(docs_c) - len * ln(n_c + alpha * V), which
  depends on the length alone, so the best of these is found once per distinct
  length.

Several smoothing values can be scored in one pass (:func:`best_smoothing`).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentspark.functions.text import tokenize
from intentspark.operators.indexing import repeated
from intentspark.operators.sizing import ROW_OVERHEAD, broadcast_budget, fits_broadcast
from intentspark.session import local_table, stored

PIVOT_LABELS = 32
SCALE = 1 << 24  # weights are multiples of 1 / SCALE
MARK = " "  # tokens hold no white space, so a blank is no token

META_SCHEMA = T.StructType([T.StructField("alpha", T.DoubleType()),
                            T.StructField("vocab_size", T.LongType()),
                            T.StructField("n_docs", T.LongType()),
                            T.StructField("n_counts", T.LongType()),
                            T.StructField("counts_bytes", T.LongType())])


@dataclass
class IntentModel:
    counts: DataFrame    # label, token, n_tok
    classes: DataFrame   # label, docs, n_class
    meta: DataFrame      # one row: alpha, vocab_size, n_docs, n_counts, counts_bytes

    def meta_row(self):
        return self.meta.first()


def _row_bytes(*cols: str) -> Column:
    """Estimated bytes of a row of the count table in a hashed relation."""
    return F.lit(ROW_OVERHEAD + 24) + sum((F.octet_length(c) for c in cols), F.lit(0))


def fit_intent_model(train: DataFrame, label: str, text: str,
                     alpha: float = 1.0) -> IntentModel:
    """MOD-2: token counts per label, class totals and vocabulary size.

    One pass over the text: it is tokenized, with a mark for each row (so the
    marks count the rows of a label), and aggregated into the count table, which
    is written to the shared folder; the class table (one row per label) and the
    vocabulary size are aggregates over that. Nothing is left cached. A training
    row without a label is an error."""
    spark = train.sparkSession
    tokens = F.concat(F.array(F.lit(MARK)), tokenize(text))
    every = stored(train.select(F.col(label).alias("label"), F.explode(tokens).alias("token"))
                   .groupBy("label", "token").agg(F.count(F.lit(1)).alias("n_tok")), "model-counts")
    is_mark = F.col("token") == MARK
    classes = stored(every.groupBy("label").agg(
        F.sum(F.when(is_mark, F.col("n_tok"))).alias("docs"),
        F.sum(F.when(is_mark, F.lit(0)).otherwise(F.col("n_tok"))).alias("n_class"),
        F.count_if(~is_mark).alias("rows"),
        F.sum(F.when(is_mark, F.lit(0)).otherwise(_row_bytes("token", "label"))).alias("bytes")), "model-classes")
    sums = classes.agg(F.sum("docs").alias("docs"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"),
                       F.sum(F.when(F.col("label").isNull(), F.col("docs"))).alias("unlabelled")).first()
    if sums["unlabelled"]:
        raise ValueError(f"{sums['unlabelled']} training rows have no label")
    counts = every.filter(~is_mark)
    vocab_size = counts.select("token").distinct().count()
    meta = local_table(spark, [(float(alpha), int(vocab_size), int(sums["docs"] or 0), int(sums["rows"] or 0),
                                int(sums["bytes"] or 0))], META_SCHEMA)
    return IntentModel(counts, classes.select("label", "docs", "n_class"), meta)


def _split_weights(weights: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """(head, tail) of ``weights`` (token, _n, ...): the head holds the most
    frequent tokens and is within ``budget`` bytes.

    The cut is a power of two in the token's count over all labels, so the
    driver sees one row for each of at most 64 sizes."""
    size = F.floor(F.log2("_total")).cast("int")
    fixed = 8 * len(weights.columns)
    strings = [f.name for f in weights.schema.fields if isinstance(f.dataType, T.StringType)]
    totals = weights.groupBy("token").agg(F.sum("_n").alias("_total"), F.sum(_row_bytes(*strings) + fixed).alias("_bytes"))
    totals = totals.select("token", "_bytes", size.alias("_size"))
    cut, held = 64, 0
    for r in sorted(totals.groupBy("_size").agg(F.sum("_bytes").alias("b")).collect(), reverse=True):
        held += int(r["b"])
        if held > budget:
            break
        cut = r["_size"]
    sized = weights.join(totals.select("token", "_size"), "token")
    return tuple(sized.filter(side).drop("_size", "_n") for side in (F.col("_size") >= cut, F.col("_size") < cut))


def _matched(exploded: DataFrame, weights: DataFrame, size: int, ids: list[str], values: list[str]) -> DataFrame:
    """(*ids, *values, _mark): the exploded tokens that have weights, and the
    marks. Weights of at most the broadcast budget meet the tokens where those
    are; of larger tables the most frequent tokens do, the others are
    shuffle-joined (few rows a token)."""
    budget = broadcast_budget(exploded)
    head, rest = (weights.drop("_n"), None) if size <= budget else _split_weights(weights, budget)
    is_mark = F.col("token") == MARK
    met = exploded.join(F.broadcast(head) if budget > 0 else head, "token", "left") \
        .filter(F.col(values[0]).isNotNull() | is_mark).select(*ids, *values, is_mark.alias("_mark"))
    if rest is not None:
        met = met.unionByName(exploded.join(rest, "token").select(*ids, *values, F.lit(False).alias("_mark")))
    return met


def _fixed(n: Column, alpha: float) -> Column:
    """The weight of a token seen ``n`` times, in units of 1 / SCALE."""
    return F.round((F.log(n + F.lit(alpha)) - F.lit(math.log(alpha))) * SCALE).cast("long")


def _line(alpha: float, vocab: int) -> tuple[Column, Column]:
    """(prior, fall per token) of a label."""
    return F.log("docs"), F.log(F.col("n_class") + F.lit(alpha * vocab))


def _cost(matched: Column, prior, fall) -> Column:
    """Orders labels by descending score."""
    return -(prior + matched.cast("double") / SCALE - F.col("_len") * fall)


def _by_pivot(exploded, model, meta, alphas, ids, lines: dict) -> DataFrame:
    """(*ids, _times, _label0, ...) for few labels, whose lines are at hand."""
    labels = sorted(lines)
    names = [[f"_w{i}_{k}" for i in range(len(labels))] for k in range(len(alphas))]
    flat = [n for ns in names for n in ns]
    weights = model.counts.groupBy("token").agg(
        F.sum("n_tok").alias("_n"),
        *[F.coalesce(F.max(F.when(F.col("label") == lab, _fixed(F.col("n_tok"), a))), F.lit(0)).alias(names[k][i])
          for k, a in enumerate(alphas) for i, lab in enumerate(labels)])
    # a token's labels share its row
    size = meta["counts_bytes"] + meta["n_counts"] * 8 * len(flat)
    met = _matched(exploded, weights, size, ids, flat)
    sums = met.groupBy(*ids).agg(F.count_if("_mark").alias("_times"), *[F.sum(n).alias(n) for n in flat])
    chosen = []
    for k in range(len(alphas)):
        entries = [F.struct(_cost(F.expr(f"coalesce({names[k][i]}, 0) div _times"), F.lit(lines[lab][f"p{k}"]),
                                  F.lit(lines[lab][f"f{k}"])).alias("cost"), F.lit(lab).alias("label"))
                   for i, lab in enumerate(labels)]
        chosen.append(F.array_min(F.array(*entries))["label"].alias(f"_label{k}"))
    return sums.select(*ids, "_times", *chosen)


def _by_label(exploded, model, meta, alphas, ids) -> DataFrame:
    """(*ids, _times, _label0, ...) for any number of labels."""
    ks = range(len(alphas))
    weights = model.counts.select("token", "label", F.col("n_tok").alias("_n"),
                                  *[_fixed(F.col("n_tok"), a).alias(f"_w{k}") for k, a in enumerate(alphas)])
    size = meta["counts_bytes"] + meta["n_counts"] * 8 * len(alphas)
    met = _matched(exploded, weights, size, ids, ["label", *[f"_w{k}" for k in ks]])
    sums = met.groupBy(*ids, "label").agg(F.count_if("_mark").alias("_times"), *[F.sum(f"_w{k}").alias(f"_s{k}") for k in ks])
    # at most one entry a label; written, as both the lengths and the rows come from it
    grouped = stored(sums.groupBy(*ids).agg(
        F.max("_times").alias("_times"),
        F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", *[f"_s{k}" for k in ks]))).alias("_m")), "model-sums")
    lines = model.classes.select("label", *[c.alias(f"_{x}{k}") for k, a in enumerate(alphas) for x, c in zip(
        ("p", "f"), _line(a, meta["vocab_size"]))])
    small = fits_broadcast(lines)

    def best(matched):
        return [F.min(F.when(F.col("label").isNotNull(), F.struct(_cost(matched(k), F.col(f"_p{k}"), F.col(f"_f{k}")).alias("cost"), "label")))
                for k in ks]

    flat = grouped.select(*ids, "_times", F.explode_outer("_m").alias("_e")).select(
        *ids, "_times", "_e.label", *[F.expr(f"_e._s{k} div _times").alias(f"_s{k}") for k in ks])
    own = flat.join(F.broadcast(lines) if small else lines, "label", "left").groupBy(*ids, "_times").agg(
        *[c.alias(f"_best{k}") for k, c in zip(ks, best(lambda k: F.col(f"_s{k}")))])
    # every length meets every label, by an equi-join on a bucket of the labels; only the best a length leaves the task
    buckets = int(exploded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = grouped.select("_len").distinct().withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    bucketed = lines.withColumn("_b", F.pmod(F.xxhash64("label"), F.lit(buckets)).cast("int"))
    base = spread.join(F.broadcast(bucketed) if small else bucketed, "_b").groupBy("_len").agg(
        *[c.alias(f"_base{k}") for k, c in zip(ks, best(lambda k: F.lit(0)))])
    return own.join(base, "_len").select(*ids, "_times", *[F.least(f"_best{k}", f"_base{k}")["label"].alias(f"_label{k}") for k in ks])


def _predictions(df: DataFrame, model: IntentModel, key: str, text: str, carry, alphas) -> DataFrame:
    """(_key, _c0, ..., _times, _label0, ...): one row for rows of ``df`` that hold
    the same, with their number, and a label for each smoothing value."""
    meta = model.meta_row()
    by = ["_key", *[f"_c{i}" for i in range(len(carry))]]
    ids = [*by, "_h", "_len"]
    rows = (df.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
                      F.coalesce(text, F.lit("")).alias("_text"))
            .select(*by, F.md5("_text").alias("_h"), tokenize("_text").alias("_toks"))
            .select(*by, "_h", F.size("_toks").alias("_len"), "_toks"))
    exploded = rows.select(*ids, F.explode(F.concat(F.array(F.lit(MARK)), "_toks")).alias("token"))
    some = model.classes.select("label", *[c.alias(f"{x}{k}") for k, a in enumerate(alphas) for x, c in zip(
        ("p", "f"), _line(a, meta["vocab_size"]))]).limit(PIVOT_LABELS + 1).collect()
    if 0 < len(some) <= PIVOT_LABELS:
        found = _by_pivot(exploded, model, meta, alphas, ids, {r["label"]: r for r in some})
    else:
        found = _by_label(exploded, model, meta, alphas, ids)
    return found.select(*ids, "_times", *[f"_label{k}" for k in range(len(alphas))])


def score_intent_model(df: DataFrame, model: IntentModel, key: str, text: str,
                       out: str = "predicted", carry=()) -> DataFrame:
    """MOD-3: ``(key, *carry, predicted)``, one row for every row of ``df``
    (empty text included: its score is the class prior). The key need not be
    unique; ``carry`` names further columns to keep, e.g. the true label.

    Rows are told apart by what they hold (key, carried columns and a hash of
    the text). A token that no row holds marks each row: the number of marks
    is the number of equal rows, whose common sum is an integer multiple of
    one row's, and rows without any matching token are kept by it."""
    found = _predictions(df, model, key, text, carry, [model.meta_row()["alpha"]])
    return repeated(found, ["_h"]).select(F.col("_key").alias(key), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
                                          F.col("_label0").alias(out))


def best_smoothing(model: IntentModel, held: DataFrame, label: str, text: str,
                   alphas=(0.01, 0.1, 0.3, 1.0, 3.0)) -> tuple[IntentModel, DataFrame]:
    """MOD-4, keeping the best: ``(model, report)``.

    The counts don't depend on the smoothing, so one pass over the held-out
    rows scores all of ``alphas``; the model returned has the value with the
    highest accuracy there (the smaller one of ties). report: ``(alpha, truth,
    predicted, n, best)``. Held-out rows without a label count as wrong."""
    alphas = sorted(set(map(float, alphas)))
    if not alphas or alphas[0] <= 0:
        raise ValueError("give smoothing values above 0")
    pairs = held.withColumn("_none", F.lit(None).cast("int"))
    found = _predictions(pairs, model, "_none", text, [label], alphas)
    each = found.select(F.col("_c0").alias("truth"), "_times", F.explode(F.array(*[
        F.struct(F.lit(a).alias("alpha"), F.col(f"_label{k}").alias("predicted")) for k, a in enumerate(alphas)])).alias("_e"))
    confusion = stored(each.groupBy("_e.alpha", "truth", "_e.predicted").agg(F.sum("_times").alias("n")), "model-grid")
    hits = confusion.groupBy("alpha").agg(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    best = min(((-r["hit"], r["alpha"]) for r in hits.collect()), default=(0, alphas[0]))[1]  # one row a value
    meta = model.meta.withColumn("alpha", F.lit(best))
    return IntentModel(model.counts, model.classes, meta), confusion.withColumn("best", F.col("alpha") == F.lit(best))


def evaluate(pred: DataFrame, truth: DataFrame, key: str, label: str,
             predicted: str = "predicted") -> tuple[DataFrame, DataFrame]:
    """MOD-4: ``(confusion, metrics)``.

    confusion: ``(truth, predicted, n)``; metrics (long form):
    ``accuracy`` and ``recall:<label>`` with their ``value``. Both come from
    one join on the key, which must be unique, and one small aggregate over
    (truth, predicted); :func:`evaluate_scored` needs neither join nor key."""
    pairs = (truth.select(F.col(key), F.col(label).alias("truth"))
             .join(pred.select(key, F.col(predicted).alias("predicted")), key))
    return evaluate_scored(pairs, "truth", "predicted")


def evaluate_scored(scored: DataFrame, truth: str, predicted: str = "predicted") -> tuple[DataFrame, DataFrame]:
    """MOD-4 over rows that carry their true label (``score_intent_model(carry=...)``)."""
    pairs = scored.select(F.col(truth).alias("truth"), F.col(predicted).alias("predicted"))
    confusion = pairs.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    per_truth = confusion.groupBy("truth").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    recall = per_truth.select(F.concat(F.lit("recall:"), F.col("truth")).alias("metric"),
                              (F.col("hit") / F.col("total")).alias("value"))
    accuracy = per_truth.agg((F.sum("hit") / F.sum("total")).alias("value")) \
        .select(F.lit("accuracy").alias("metric"), "value")
    return confusion, accuracy.unionByName(recall)


def format_metrics(metrics: DataFrame) -> DataFrame:
    """MOD-5: ``name: value`` lines with four decimals."""
    return metrics.select("metric", "value",
                          F.format_string("%s: %.4f", F.col("metric"), F.col("value")).alias("line"))


def save_model(model: IntentModel, path: str) -> None:
    """SNK-3: the model as three parquet tables under ``path``."""
    model.counts.write.mode("overwrite").parquet(f"{path}/counts")
    model.classes.write.mode("overwrite").parquet(f"{path}/classes")
    model.meta.write.mode("overwrite").parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> IntentModel:
    """SNK-3: read a saved model back."""
    return IntentModel(spark.read.parquet(f"{path}/counts"),
                       spark.read.parquet(f"{path}/classes"),
                       spark.read.parquet(f"{path}/meta"))
