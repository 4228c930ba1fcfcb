"""Contract checks on inputs (CHK-1..CHK-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame


class ContractError(ValueError):
    """An input does not meet the column or row contract."""


def require_columns(df: DataFrame, columns, what: str = "input") -> DataFrame:
    """CHK-1: fail naming the expected and the actual column lists when a
    required column is missing. Uses the analysed schema only (no job)."""
    actual = list(df.columns)
    missing = [c for c in columns if c not in actual]
    if missing:
        raise ContractError(
            f"{what}: missing column(s) {missing}; expected {list(columns)}, actual {actual}")
    return df


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """CHK-3: fail when there are no rows (a limit-1 job)."""
    if df.isEmpty():
        raise ContractError(f"{what}: no rows")
    return df
