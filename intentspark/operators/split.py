"""Deterministic exact-size train/validation split (SPL-1, SPL-2).

Rows are ordered by ``md5("<seed>:<key>")`` (null keys first); the first
``ceil(fraction * n)`` rows are the validation part. The cut is found with a
distributed radix select on the hash: a histogram of hash prefixes (at most
4,096 buckets, so the driver only ever sees bucket counts), a walk to the
bucket holding the k-th row, and, if that bucket is still large, the same on
the next prefix digits. The split is then one comparison with literals: no
join, no shuffle, no sort, the same rows under any partitioning.

A key that several rows share may straddle the cut. Only then its rows are
ordered by a hash of the whole row, by the same select; and if wholly equal
rows straddle it, which can't be told apart, the number of them that goes to
either part is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intentspark import domain

PREFIX_STEP = 3          # hex digits per histogram round -> 4,096 buckets
HASH_DIGITS = 32
SMALL_BUCKET = 4_096     # count by whole hash once the boundary bucket is this small
NULL_HASH = "0" * HASH_DIGITS
COPY_STEP = 1 << 16      # equal rows that a task writes out from one row


def split_hash(key: str | Column, seed: int = domain.SPLIT_SEED) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string"))), F.lit(NULL_HASH))


def row_hash(columns: Iterable[str]) -> Column:
    """A hash of all that a row holds; nulls count."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}))


def eval_size(n: int, fraction: float = domain.SPLIT_TEST_FRACTION) -> int:
    """Validation rows for ``n`` rows: ``ceil(fraction * n)``."""
    return int(math.ceil(fraction * n)) if n else 0


def _histogram(hashes: DataFrame, prefix: str, width: int) -> list[tuple[str, int]]:
    part = hashes if not prefix else hashes.filter(F.col("_h").startswith(prefix))
    return sorted((r[0], r[1]) for r in
                  part.groupBy(F.substring("_h", 1, width).alias("_b")).count().collect())


def _cut(hashes: DataFrame, hist: list[tuple[str, int]], k: int) -> tuple[str, int, int]:
    """(hash of the k-th smallest row, rows with that hash, how many of these
    are among the first k), starting from the first round's histogram."""
    need = k
    while True:
        for bucket, cnt in hist:
            if cnt >= need:
                break
            need -= cnt
        if len(bucket) == HASH_DIGITS:
            return bucket, cnt, need
        width = HASH_DIGITS if cnt <= SMALL_BUCKET else min(len(bucket) + PREFIX_STEP, HASH_DIGITS)
        hist = _histogram(hashes, bucket, width)


def with_split(df: DataFrame, key: str, fraction: float = domain.SPLIT_TEST_FRACTION,
               seed: int = domain.SPLIT_SEED, out: str = "split") -> DataFrame:
    """SPL-1: add ``split`` = ``eval`` for the first ``ceil(fraction*n)`` rows
    in hash order, else ``train``. The size is exact for any keys: repeated
    ones and null included (null keys come first).

    Jobs: one histogram (which also gives ``n``) and one or a few on the
    boundary bucket; as many again if the key at the cut has more rows than
    are wanted of it."""
    h = split_hash(key, seed)
    hashes = df.select(h.alias("_h"))
    hist = _histogram(hashes, "", PREFIX_STEP)
    k = eval_size(sum(c for _, c in hist), fraction)
    if k == 0:
        return df.withColumn(out, F.lit("train"))

    def side(is_eval: Column) -> Column:
        return F.when(is_eval, F.lit("eval")).otherwise(F.lit("train"))

    cut, cnt, need = _cut(hashes, hist, k)
    if need == cnt:
        return df.withColumn(out, side(h <= F.lit(cut)))
    at_cut = h == F.lit(cut)
    whole = row_hash(df.columns)
    tied = df.filter(at_cut).select(whole.alias("_h"))
    last, cnt, need = _cut(tied, _histogram(tied, "", PREFIX_STEP), need)
    flagged = df.withColumn(out, side((h < F.lit(cut)) | (at_cut & (whole <= F.lit(last)))))
    if need == cnt:
        return flagged
    equal = at_cut & (whole == F.lit(last))
    return flagged.filter(~equal).unionByName(_copies(df.filter(equal).limit(1), need, cnt, out))


def _copies(row: DataFrame, n_eval: int, n: int, out: str) -> DataFrame:
    """The one row of ``row`` n times, ``n_eval`` of them held out; large
    numbers are written out by several tasks."""
    parts = -(-n // COPY_STEP)
    at = F.struct(*[F.col(f"`{c}`") for c in row.columns]).alias("_row")
    blocks = row.select(at, F.explode(F.sequence(F.lit(0), F.lit(parts - 1).cast("long"))).alias("_block"))
    if parts > 1:
        blocks = blocks.repartition(parts, "_block")
    first = F.col("_block") * COPY_STEP
    copies = blocks.select("_row", F.explode(F.sequence(
        first, F.least(first + COPY_STEP, F.lit(n)) - 1)).alias("_i"))
    return copies.select("_row.*", F.when(F.col("_i") < n_eval, F.lit("eval")).otherwise(F.lit("train")).alias(out))


def train_eval_split(df: DataFrame, key: str, fraction: float = domain.SPLIT_TEST_FRACTION,
                     seed: int = domain.SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    """SPL-1 as two DataFrames ``(train, eval)``."""
    flagged = with_split(df, key, fraction, seed, out="_split")
    return (flagged.filter(F.col("_split") == "train").drop("_split"),
            flagged.filter(F.col("_split") == "eval").drop("_split"))


def split_sizes(flagged: DataFrame, split: str = "split") -> DataFrame:
    """SPL-2: rows per part."""
    return flagged.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
