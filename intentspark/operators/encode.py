"""Fixed-length integer features (ENC-1..ENC-8; ENC-9 is a text function).

Tokens are the whitespace words of the text, with reserved tokens split out
(:func:`intentspark.functions.text.tokenize`). The vocabulary is built by
Spark from the corpus; reserved tokens keep their fixed ids and words are
numbered after them by frequency. Every row is cut to ``max_length``
tokens *before* any join, padded on the left with the pad id, and carries
an attention mask of its real length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentspark import domain
from intentspark.functions.text import tokenize
from intentspark.operators.indexing import distinct_rows, repeated, with_row_index
from intentspark.operators.sizing import broadcast_budget, estimate_bytes, fits_broadcast
from intentspark.session import local_table

RESERVED_SCHEMA = T.StructType([T.StructField("token", T.StringType()), T.StructField("id", T.IntegerType())])

SPECIAL_TOKEN_STRINGS = [t for t, _, _, _ in domain.SPECIAL_TOKENS]


def build_vocab(df: DataFrame, text: str, min_count: int = 1,
                max_size: int | None = None) -> DataFrame:
    """ENC-1: ``(token, id, n)``; reserved tokens first with their fixed ids
    (``n`` null), then words ranked by (count desc, token) from
    ``FIRST_WORD_ID``. Counting is a map-side-combined aggregate; the ranking
    is a distributed sort (no single-partition window)."""
    words = (df.select(F.explode(tokenize(text)).alias("token"))
             .filter(~F.col("token").isin(SPECIAL_TOKEN_STRINGS))
             .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") >= min_count))
    ranked = with_row_index(words, [F.desc("n"), F.asc("token")], out="_rank")
    if max_size is not None:
        ranked = ranked.filter(F.col("_rank") < max_size)
    ranked = ranked.select("token", (F.col("_rank") + domain.FIRST_WORD_ID).cast("int").alias("id"),
                           F.col("n").cast("long").alias("n"))
    spark = df.sparkSession
    reserved = (local_table(spark, [(t, i) for t, i, _, _ in domain.SPECIAL_TOKENS], RESERVED_SCHEMA)
                .withColumn("n", F.lit(None).cast("long")))
    return reserved.unionByName(ranked)


def _ids_text(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), " ")


def _looked_up(exploded: DataFrame, lookup: DataFrame) -> DataFrame:
    """``exploded`` with ``_id`` of its ``token`` by the table ``(token, _id)``."""
    budget = broadcast_budget(exploded)
    rows, size = estimate_bytes(lookup)
    if size <= budget:
        return exploded.join(F.broadcast(lookup), "token", "left")
    # ids follow the rank by frequency: as many of the first as fit by their average size
    first = domain.FIRST_WORD_ID + rows * budget // (2 * size)
    head = lookup.filter(F.col("_id") < first)
    small = fits_broadcast(head)
    known = exploded.join(F.broadcast(head) if small else head, "token", "left")
    if not small:  # long words first: no head
        return exploded.join(lookup, "token", "left")
    # what the head knows meets nothing (no token holds a blank) and is dealt evenly by its row's hash
    rest = lookup.filter(F.col("_id") >= first).select(F.col("token").alias("_token"), F.col("_id").alias("_late"))
    asked = F.when(F.col("_id").isNull(), F.col("token")).otherwise(F.concat(F.lit(" "), F.col("_h")))
    return (known.withColumn("_asked", asked).join(rest, F.col("_asked") == F.col("_token"), "left")
            .withColumn("_id", F.coalesce("_id", "_late")).drop("_asked", "_token", "_late"))


def token_ids(df: DataFrame, vocab: DataFrame, key: str, text: str,
              max_length: int = domain.MAX_LENGTH, out: str = "ids",
              carry: dict | None = None) -> DataFrame:
    """ENC-2: ``(key, [carried columns,] ids)``, one row per row of ``df``:
    ids of the first ``max_length`` tokens (unknown tokens -> unk id). The
    key need not be unique. Rows are told apart by what they hold
    (:func:`distinct_rows`, the one shuffle when the vocabulary's measured
    size fits the broadcast budget). Of a larger vocabulary the first words,
    which are the most frequent, are broadcast, so that no hot token is shuffled;
    the others are shuffle-joined. ``carry`` maps names to per-row expressions
    kept alongside."""
    carry = carry or {}
    by = [key, *carry]
    cut = df.select(F.col(key), *[v.alias(k) for k, v in carry.items()],
                    F.array_join(F.slice(tokenize(text), 1, max_length), " ").alias("_t"))
    rows = distinct_rows(cut, by, "_t")  # tokens hold no white space
    same = [*by, "_h", "_pid", "_times"]
    exploded = rows.select(*same, F.posexplode_outer(
        F.array_remove(F.split("_t", " "), F.lit(""))).alias("_pos", "token"))
    lookup = vocab.select("token", F.col("id").alias("_id"))
    joined = _looked_up(exploded, lookup)
    item = F.when(F.col("_pos").isNotNull(),
                  F.struct(F.col("_pos"), F.coalesce(F.col("_id"), F.lit(domain.UNK_ID)).alias("_id")))
    ids = joined.groupBy(*same).agg(F.array_sort(F.collect_list(item)).getField("_id").alias(out))
    return repeated(ids).select(*by, out)


def pad_left(ids: Column, max_length: int = domain.MAX_LENGTH, value: int = domain.PAD_ID) -> Column:
    """ENC-3: left padding to ``max_length``."""
    return F.concat(F.array_repeat(F.lit(value), F.lit(max_length) - F.size(ids)), ids)


def attention_mask(ids: Column, max_length: int = domain.MAX_LENGTH) -> Column:
    """ENC-3: 0 for padding, 1 for the real tokens (by length, not by id)."""
    n = F.size(ids)
    return F.concat(F.array_repeat(F.lit(0), F.lit(max_length) - n), F.array_repeat(F.lit(1), n))


def encode(df: DataFrame, vocab: DataFrame, key: str, text: str,
           max_length: int = domain.MAX_LENGTH) -> DataFrame:
    """ENC-2 + ENC-3 (+ PRJ-7): ``(key, input_ids, attention_mask)``, each of
    length ``max_length``; source columns are dropped."""
    ids = token_ids(df, vocab, key, text, max_length)
    return ids.select(key, pad_left(F.col("ids"), max_length).alias("input_ids"),
                      attention_mask(F.col("ids"), max_length).alias("attention_mask"))


def encode_training(df: DataFrame, vocab: DataFrame, key: str, text: str, prompt: str,
                    max_length: int = domain.MAX_LENGTH) -> DataFrame:
    """ENC-2..5: ``(key, input_ids, attention_mask, labels)``.

    ``labels`` is the *intended* loss mask: ids of the target tokens, -100
    on padding and on the prompt's tokens (prompt length counted with the
    same tokenizer and cut)."""
    both = token_ids(df, vocab, key, text, max_length,
                     carry={"_np": F.size(F.slice(tokenize(prompt), 1, max_length))})
    n = F.size(F.col("ids"))
    hidden = (F.lit(max_length) - n) + F.least(F.col("_np"), n)
    padded = pad_left(F.col("ids"), max_length)
    # -100 for the first `hidden` positions, then the ids (array functions,
    # no per-element lambda)
    labels = F.concat(F.array_repeat(F.lit(domain.IGNORE_INDEX), hidden),
                      F.slice(F.col("ids"), F.least(F.col("_np"), n) + 1, F.lit(max_length)))
    return both.select(
        key, padded.alias("input_ids"), attention_mask(F.col("ids"), max_length).alias("attention_mask"),
        labels.alias("labels"))


def collate_causal(df: DataFrame, ids: str = "input_ids", out: str = "labels",
                   pad_id: int = domain.PAD_ID) -> DataFrame:
    """ENC-6: the labels a causal-LM collator trains on: ids, with every
    position whose id equals the pad id set to -100."""
    return df.withColumn(out, F.transform(
        F.col(ids), lambda x: F.when(x == F.lit(pad_id), F.lit(domain.IGNORE_INDEX)).otherwise(x)))


def truncation_report(df: DataFrame, by: str, text: str,
                      max_length: int = domain.MAX_LENGTH) -> DataFrame:
    """ENC-8: per group, rows, rows longer than ``max_length`` tokens (cut
    silently by encoding) and the longest row."""
    n = F.size(tokenize(text))
    return (df.select(F.col(by), n.alias("_n")).groupBy(by)
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.sum(F.when(F.col("_n") > max_length, 1).otherwise(0)).cast("long").alias("truncated"),
                 F.max("_n").cast("long").alias("max_tokens")))


def ids_as_text(df: DataFrame, cols) -> DataFrame:
    """Array columns as space-joined strings (for printing and comparison)."""
    for c in cols:
        df = df.withColumn(c, _ids_text(F.col(c)))
    return df
