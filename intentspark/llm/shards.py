"""Sharding by proportional stratified interleaving.

Rows are shuffled with a seed within each source, each row gets its
fractional rank (rank + 1/2) / (rows of the source), all rows are put in the
order of that fraction, and the order is cut into equal runs. Any run then
holds nearly the same share of every source.

Ranks come from :func:`intentspark.llm.common.with_index` (range partitions
plus offsets), so a source that holds a third of the rows is sorted by many
tasks. Only the key columns and the sizes are sorted; the texts are read once
to measure them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentspark.llm.common import documents, with_index, written

SEED = 20240917
SHARDS = 16


def interleave(rows: DataFrame, source: str, key: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with the columns ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``source`` names the stratum, ``key`` the column whose seeded hash
    shuffles a stratum. A null source is a stratum of its own; null keys are
    shuffled together as one value. Rows that repeat a key are adjacent in
    the shuffle, in the order of a digest of the row, so only wholly equal rows
    are interchangeable; each gets a place of its own, and neither a hot key
    nor a hot row is one task's. An empty table gives an empty result; other columns are
    carried along, also ones of the names used here inside.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    packed = rows.select(
        F.struct("*").alias("row"), F.col(source).alias("stratum"), F.col(key).cast("string").alias("k"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))).alias("h"),
        F.md5(F.to_json(F.struct(F.struct("*").alias("row")))).alias("content"), F.monotonically_increasing_id().alias("at"))
    packed = written(packed, "shard-rows")
    ranked = with_index(packed, ["stratum", "h", "k", "content", "at"], "g")
    strata = ranked.groupBy("stratum").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("n"))
    on = F.col("r.stratum").eqNullSafe(F.col("s.stratum"))
    placed = (ranked.alias("r").join(strata.alias("s"), on)
              .select("r.row", "r.stratum", "r.h", "r.k",
                      ((F.col("g") - F.col("first") + F.lit(0.5)) / F.col("n")).alias("fraction")))
    ordered = with_index(placed, ["fraction", "h", "k", "stratum"], "g")
    total = packed.count()
    # shard i holds the positions from ceil(i * total / shards) on
    shard = F.expr(f"int((g * {shards}L) div {max(total, 1)}L)")
    slot = F.expr(f"g - ((shard * {total}L + {shards - 1}L) div {shards}L)")
    ordered = ordered.select("row", "g", shard.alias("shard")).withColumn("slot", slot)
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    return ordered.select(*[F.col("row")[c].alias(c) for c in kept], "shard", "slot")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: law ``rows`` (shard counts are at most one apart)."""
    text = F.col("text")
    docs = documents(spark, sf_dir).select(
        "doc_id", "source", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    out = interleave(docs, "source", "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                      F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                      "source")
