"""Parquet input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Inputs at least this large that scan as fewer partitions than the cluster
# has cores (a single large row group, say) are spread round-robin first.
REBALANCE_MIN_BYTES = 4 << 20


def path_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the files under ``path`` (Hadoop file system API, so it
    works for any scheme the cluster can read)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())


def rebalanced(df: DataFrame, path: str) -> DataFrame:
    """``df`` itself when its scan already gives every core a partition (the
    normal case for large, multi-file inputs); otherwise round-robin spread
    over the default parallelism so per-row work is not bound to one task.
    Projections and filters are still pushed below the spread into the scan."""
    spark = df.sparkSession
    try:
        par = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() >= par or path_bytes(spark, path) < REBALANCE_MIN_BYTES:
            return df
    except Exception:  # no JVM context (e.g. a remote session): leave the scan as it is
        return df
    return df.repartition(par)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a scale-factor folder (columns are pruned and
    filters pushed into the scan by Catalyst)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return rebalanced(spark.read.parquet(path), path)
