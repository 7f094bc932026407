"""Order of all rows by a numeric id without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_points(df: DataFrame, key: str, buckets: int) -> list[int]:
    """At most buckets - 1 ascending values that deal the non-null `key` values into ranges of like size.
    One aggregation; its result has `buckets` numbers, whatever the size of the table."""
    at = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(key, F.array(*[F.lit(a) for a in at]), F.lit(20 * buckets)).alias("cuts")).first() if at else None
    return sorted(set(row["cuts"] or [])) if row else []


def range_bucket(key: Column, cuts: list[int]) -> Column:
    """How many cut points lie below `key` (null: -1, so nulls come first). Searched in two steps, a block
    of cut points and then within the block, so the cost is twice the root of their number."""
    if not cuts:
        return F.when(key.isNull(), -1).otherwise(0)
    step = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    table = F.array(*[F.array(*[F.lit(c) for c in b]) for b in blocks])
    last = F.array(*[F.lit(b[-1]) for b in blocks])
    full = F.size(F.filter(last, lambda c: c < key))
    inside = F.size(F.filter(F.coalesce(F.get(table, full), F.array().cast("array<bigint>")), lambda c: c < key))
    return F.when(key.isNull(), -1).otherwise(full * step + inside)
