"""Submission shaping and reports (RPT-1..RPT-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def submission(pred: DataFrame, key: str = "Id", label: str = "Category") -> DataFrame:
    """RPT-1 + RPT-2: ``(Id LONG, Category)`` sorted by ``Id``.

    The cast is ANSI (a non-integer Id fails the job). The sort is a
    range-partitioned distributed sort, so every output partition holds a
    contiguous, ordered Id range.
    """
    return (pred.select(F.col(key).cast("long").alias("Id"), F.col(label).alias("Category"))
            .orderBy("Id"))


def preview(pred: DataFrame, n: int = 5, key: str = "Id") -> DataFrame:
    """RPT-3: first ``n`` rows by ``Id`` (planned as TakeOrderedAndProject:
    a per-partition top-n, then one merge of n rows per partition)."""
    return pred.orderBy(key).limit(n)


def category_counts(pred: DataFrame, label: str = "Category") -> DataFrame:
    """RPT-4: rows per label, most frequent first (ties by label).

    Partial counts are combined map-side, so a label holding most rows costs
    one row per partition in the shuffle.
    """
    return (pred.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc(label)))


def with_progress(pred: DataFrame, label: str = "Category",
                  name: str = "progress") -> tuple[DataFrame, Observation]:
    """RPT-5: progress metrics gathered while the job runs (no extra pass).

    Returns the pass-through DataFrame and an ``Observation`` whose ``get``
    holds ``rows`` and ``labelled`` once an action on the DataFrame ends.
    """
    obs = Observation(name)
    out = pred.observe(obs, F.count(F.lit(1)).alias("rows"),
                       F.count(F.col(label)).alias("labelled"))
    return out, obs
