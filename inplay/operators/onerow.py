"""Attaching the single row of an ungrouped aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """df with the columns of `row`, the result of an aggregation without groups: exactly one row, so it
    is broadcast and the size of df does not change."""
    return df.join(F.broadcast(row))
