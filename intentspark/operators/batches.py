"""Training batches of an epoch (ENC-6): a seeded permutation with length buckets.

Rows of similar length share a batch, so padding to a batch's longest row wastes
little; which rows meet and the order of the batches change with the epoch and
follow from hashes, so any partitioning gives the same batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentspark import domain
from intentspark.operators.indexing import with_row_index
from intentspark.operators.sizing import fits_broadcast

BATCH_SIZE = 16
WIDTH = 16  # lengths that share a bucket


def epoch_batches(df: DataFrame, key: str, ids: str = "ids", batch_size: int = BATCH_SIZE, epoch: int = 0,
                  seed: int = domain.SPLIT_SEED, width: int = WIDTH, pad_id: int = domain.PAD_ID) -> DataFrame:
    """``(key, batch, place, n_tokens, longest, input_ids, attention_mask)``: every
    row of ``df`` (key, ids) once, in batches 0, 1, 2, ... of at most
    ``batch_size`` rows, at a place 0, 1, ... of its batch; ids and mask are
    padded on the left to the batch's longest row.

    Rows are sorted by (length bucket, hash of seed, epoch, key and ids) over
    all tasks; each bucket is cut into batches (its last one may be smaller), and
    the batches are put in the order of a hash of their own. The key may repeat
    or be null; wholly equal rows are interchangeable.
    """
    if batch_size < 1 or width < 1:
        raise ValueError("batch_size and width are 1 or more")
    n = F.size(ids)
    name = F.concat_ws(":", F.lit(f"{seed}:{epoch}"), F.coalesce(F.col(key).cast("string"), F.lit("")),
                       F.md5(F.array_join(F.col(ids).cast("array<string>"), " ")))
    rows = df.select(F.col(key), F.col(ids).alias("_ids"), n.alias("n_tokens"), F.floor(n / width).cast("long").alias("_bucket"),
                     F.md5(name).alias("_h"))
    ranked = with_row_index(rows, ["_bucket", "_h", F.col(key)], out="_index")
    first = ranked.groupBy("_bucket").agg(F.min("_index").alias("_first"))  # a row a bucket of lengths
    placed = ranked.join(F.broadcast(first) if fits_broadcast(first) else first, "_bucket").select(
        key, "_ids", "n_tokens", "_bucket", F.expr(f"(_index - _first) div {batch_size}").alias("_no"),
        ((F.col("_index") - F.col("_first")) % batch_size).cast("int").alias("place"))
    groups = placed.groupBy("_bucket", "_no").agg(F.max("n_tokens").alias("longest"))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}:{epoch}"), F.col("_bucket").cast("string"), F.col("_no").cast("string")))
    batches = with_row_index(groups.withColumn("_o", order), ["_o", "_bucket", "_no"], out="batch").drop("_o")
    found = placed.join(F.broadcast(batches) if fits_broadcast(batches) else batches, ["_bucket", "_no"])
    pad = F.col("longest") - F.col("n_tokens")
    return found.select(
        key, "batch", "place", "n_tokens", "longest",
        F.concat(F.array_repeat(F.lit(pad_id), pad), F.col("_ids")).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(0), pad), F.array_repeat(F.lit(1), F.col("n_tokens"))).alias("attention_mask"))


def padding_report(batches: DataFrame, max_length: int = domain.MAX_LENGTH) -> DataFrame:
    """One row: ``rows, batches, tokens, padding`` and the shares of padding in
    batches and when all rows are padded to ``max_length``."""
    out = batches.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("place") == 0).alias("batches"),
                      F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"),
                      F.coalesce(F.sum(F.col("longest") - F.col("n_tokens")), F.lit(0)).alias("padding"))
    fixed = F.col("rows") * max_length
    return (out.withColumn("share", F.round(F.try_divide("padding", F.col("tokens") + F.col("padding")), 6))
            .withColumn("fixed_share", F.round(F.try_divide(fixed - F.col("tokens"), fixed), 6)))
