"""Global row index in sort order without a single-partition window.

``row_number() OVER (ORDER BY ...)`` with no partition runs in one task.
Here the rows are range-partitioned and sorted by Spark, the sorted result
is checkpointed to the shared folder (so partition membership cannot change
between the two passes below, and a lost executor recomputes nothing), the
per-partition row counts (one row per partition) give each partition's
offset, and the index is offset + position within the partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentspark.session import checkpoint_dir, local_table

OFFSET_SCHEMA = T.StructType([T.StructField("_pid", T.IntegerType()), T.StructField("_offset", T.LongType())])


def with_row_index(df: DataFrame, order, out: str = "index", start: int = 0) -> DataFrame:
    """Add ``out`` = ``start`` + 0-based position of the row in ``order``."""
    checkpoint_dir(df.sparkSession)
    fixed = (df.orderBy(*order)
             .withColumn("_pid", F.spark_partition_id())
             .withColumn("_mono", F.monotonically_increasing_id())
             .checkpoint(eager=True))
    total, offsets = start, []
    for pid, cnt in sorted((r[0], r[1]) for r in fixed.groupBy("_pid").count().collect()):
        offsets.append((pid, total))
        total += cnt
    small = local_table(df.sparkSession, offsets, OFFSET_SCHEMA)  # one row per partition
    pos = F.col("_mono") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (fixed.join(F.broadcast(small), "_pid").withColumn(out, F.col("_offset") + pos)
            .drop("_pid", "_mono", "_offset"))


def distinct_rows(df: DataFrame, by: list, value: str) -> DataFrame:
    """``(*by, _h, _pid, value, _times)``: rows that agree on ``by`` and on the
    string ``value`` as one row a partition of ``df``, with their number ``_times``.

    For work that regroups exploded rows: ``(*by, _h, _pid)`` identifies a row
    by what it holds (``_h`` is the hash of ``value``), so a repeated key merges
    nothing and a retried task names its rows alike. Equal rows of a partition
    are combined before the one shuffle; those of different partitions go on
    apart, so that no row's copies are all written by one task. Later groupings
    that include these columns reuse the partitioning. :func:`repeated` gives
    the copies back.
    """
    return (df.withColumn("_h", F.md5(value)).withColumn("_pid", F.spark_partition_id()).groupBy(*by, "_h", "_pid")
            .agg(F.max(value).alias(value), F.count(F.lit(1)).alias("_times")))


COPY_STEP = 1 << 16  # copies of a row made at once


def repeated(df: DataFrame, spread: list | None = None) -> DataFrame:
    """Each row ``_times`` times, without ``_times``. Copies are made in blocks of
    ``COPY_STEP``; with ``spread``, the blocks are dealt to tasks by these columns
    and their number, so that a row of any number of copies is written by many."""
    last = f"(_times - 1) div {COPY_STEP}"
    blocks = df.withColumn("_block", F.explode(F.expr(f"sequence(0L, {last})")))
    if spread:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = blocks.repartition(n, *spread, "_block")
    copies = F.expr(f"sequence(1, int(least({COPY_STEP}, _times - _block * {COPY_STEP})))")
    return blocks.withColumn("_copy", F.explode(copies)).drop("_times", "_block", "_copy")
