"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentspark.session import local_table, scratch_path, ship_package
from intentspark.sources.tables import read_table

#: Words of the contracts: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

MASK64 = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def prepare(spark: SparkSession) -> None:
    """Make this package importable by the Python workers."""
    ship_package(spark)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives the
    loss of executors, and is computed once however often it is read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_offsets(sizes: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """(key, out): the sum of ``value`` over the smaller keys, as a small local
    table. ``sizes`` holds one row a partition of a written table, with a
    unique integer key, so the driver adds up one number a partition."""
    pdf = sizes.select(F.col(key).cast("long"), F.col(value).cast("long")).toPandas().sort_values(key)
    n = pdf[value].to_numpy("int64")
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField(out, T.LongType())])
    return local_table(sizes.sparkSession, zip(pdf[key].tolist(), (np.cumsum(n) - n).tolist()), schema)


def with_index(df: DataFrame, order: list, out: str = "index") -> DataFrame:
    """Add the 0-based position of each row in ``order`` without a task that
    holds all rows: rows are dealt by range and sorted, the sorted table is
    written, and each partition's offset (one row per partition) is joined
    back on the partition's number.

    ``df`` should be narrow. Rows that agree on all of ``order`` are put next
    to each other in no fixed order.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    at = F.monotonically_increasing_id()  # partition number above bit 33, position in it below
    fixed = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                    .withColumn("_mono", at), "ranked")
    fixed = (fixed.withColumn("_pid", F.shiftright("_mono", 33))
             .withColumn("_pos", F.col("_mono").bitwiseAND((1 << 33) - 1)))
    offsets = running_offsets(fixed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")), "_pid", "_n", "_off")
    return (fixed.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + F.col("_pos"))
            .drop("_pid", "_pos", "_mono", "_off"))


def in_blocks(batch: pa.RecordBatch, column: int, limit: int):
    """Slices of a batch whose ``column`` holds about ``limit`` bytes."""
    sizes = np.cumsum(np.array(pc.binary_length(batch.column(column)).fill_null(0), np.int64))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 ``data``; bytes.split() cuts at the
    six ASCII white-space characters only."""
    words = data.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n])
    return h


def name_free(df: DataFrame, wanted: str) -> str:
    """``wanted``, or it with underscores before it, so that it clashes with no column."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = "_" + wanted
    return wanted
