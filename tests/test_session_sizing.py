"""Session helpers and size checks."""

from pyspark.sql import types as T

from intentspark.operators import sizing
from intentspark.session import local_table, scale_settings


def test_scale_settings():
    big = scale_settings(100 * 2**40, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 819200
    small = scale_settings(10 << 20, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 24  # at least three waves
    assert big["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == str(128 << 20)


def test_local_table_and_estimate(spark):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    df = local_table(spark, [("ab", 1), ("cde", 2), (None, 3)], schema)
    assert sorted(tuple(r) for r in df.collect() if r[0]) == [("ab", 1), ("cde", 2)]
    rows, size = sizing.estimate_bytes(df)
    assert rows == 3 and size >= 5 + 3 * 8
    assert sizing.fits_broadcast(df) and not sizing.fits_broadcast(df, budget=10)
