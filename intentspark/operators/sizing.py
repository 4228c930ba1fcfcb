"""Size checks that guard every broadcast.

A side is broadcast only when an aggregate over it (one small job) shows
that its estimated in-memory size is within the budget; otherwise the
caller takes the shuffle path. The budget defaults to 64 MiB and can be set
with ``spark.intentspark.broadcastBytes``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUDGET_CONF = "spark.intentspark.broadcastBytes"
DEFAULT_BUDGET = 64 * 1024 * 1024
ROW_OVERHEAD = 48  # hashed-relation entry + row header, per row


def broadcast_budget(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(BUDGET_CONF, str(DEFAULT_BUDGET)))


def estimate_bytes(df: DataFrame) -> tuple[int, int]:
    """(rows, estimated bytes) of ``df``: strings by their bytes, other
    fixed-width columns by their type size."""
    str_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    fixed = sum(f.dataType.defaultSize() if hasattr(f.dataType, "defaultSize") else 8
                for f in df.schema.fields if not isinstance(f.dataType, T.StringType))
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.sum(F.octet_length(F.col(c))).alias(f"_len{i}") for i, c in enumerate(str_cols)]
    r = df.agg(*aggs).first()
    rows = int(r["_rows"])
    octets = sum(int(r[f"_len{i}"] or 0) for i in range(len(str_cols)))
    return rows, rows * (ROW_OVERHEAD + fixed + 8 * len(str_cols)) + octets


def fits_broadcast(df: DataFrame, budget: int | None = None) -> bool:
    """True when ``df`` is small enough to broadcast to every executor."""
    _, size = estimate_bytes(df)
    return size <= (budget if budget is not None else broadcast_budget(df))
