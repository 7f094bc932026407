"""Ordered scans (running max, fill, lag, ...) that survive a hot entity.

A plain window runs one entity in one task. Entities that hot_entities() finds with more rows
than `spark.inplay.sliceRows` are cut into consecutive slices of their order key; each slice is
scanned on its own, one summary row per slice carries the state forward, and the two are combined.
Where no entity is hot the plan is the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from inplay.session import slice_rows

SLICE = "__slice"
BROADCAST_BYTES = 64 << 20  # size up to which the quantiles of hot entities are broadcast
MOST_KNOTS = 4096  # quantiles kept of an entity
TASK_ROWS = 100_000  # rows of a base table that one task scans
_UNB, _END = Window.unboundedPreceding, Window.unboundedFollowing


@dataclass(frozen=True)
class Spec:
    """One scanned output: `kind` over `value`; `inclusive` counts the current row."""

    kind: str
    value: Column
    inclusive: bool = True


def running_max(c, inclusive: bool = True) -> Spec:
    return Spec("max", _col(c), inclusive)


def running_sum(c, inclusive: bool = True) -> Spec:
    return Spec("sum", _col(c), inclusive)


def row_number() -> Spec:
    """1-based position within the entity."""
    return Spec("sum", F.lit(1).cast("bigint"), True)


def ffill(c, inclusive: bool = True) -> Spec:
    """Last non-null value at or before (or strictly before) the row."""
    return Spec("ffill", _col(c), inclusive)


def bfill(c, inclusive: bool = True) -> Spec:
    """First non-null value at or after (or strictly after) the row."""
    return Spec("bfill", _col(c), inclusive)


def lag(c) -> Spec:
    return Spec("lag", F.struct(_col(c).alias("v")), False)


def lead(c) -> Spec:
    return Spec("lead", F.struct(_col(c).alias("v")), False)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric_key(df: DataFrame, name: str) -> Column:
    """The order column as a number (timestamps as microseconds)."""
    kind = df.schema[name].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.col(name)


def hot_entities(df: DataFrame, by: Sequence[str], order: str, rows: int | None = None) -> DataFrame | None:
    """Entities of a base table with more rows than a slice should hold, with quantiles of their order key, by which they
    are cut into slices of about equal numbers of rows however their keys lie; None if there are none. This measures the
    table once (one narrow aggregation, like gathering statistics, and for hot entities alone a mergeable quantile
    sketch) so that plans over evenly spread data stay plain windows. The result holds at most total rows / slice
    rows entries. Up to MOST_KNOTS / 2 slices an entity, no slice holds more than twice its share, unless rows share one
    exact key; beyond, keys are spread evenly between neighbouring quantiles."""
    rows = rows or slice_rows(df.sparkSession)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > rows).persist()
    n, most = sizes.agg(F.count(F.lit(1)), F.max("__n")).first()
    if not n:
        sizes.unpersist()
        return None
    knots = min(MOST_KNOTS, max(64, 1 << (2 * -(-most // rows) - 1).bit_length()))
    step = max(1, round(knots ** 0.5))
    few = n * knots * 8 <= BROADCAST_BYTES
    x = numeric_key(df, order).cast("double")
    at = F.array(*[F.lit(i / knots) for i in range(knots + 1)])
    sketch = df.select(*by, x.alias("__x")).join(F.broadcast(sizes) if few else sizes, list(by)).groupBy(*by, "__n").agg(F.percentile_approx("__x", at, F.lit(50 * knots)).alias("__q"))
    heads = F.filter("__inner", lambda _, i: (i + 1) % step == 0)
    hot = sketch.withColumn("__inner", F.slice("__q", 2, knots - 1)).select(*by, "__q", "__inner", heads.alias("__heads"), F.lit(step).alias("__width"), F.ceil(F.col("__n") / F.lit(rows)).alias("__slices")).persist()
    return F.broadcast(hot) if few else hot


def dealt(df: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """df with its entities dealt to tasks of about TASK_ROWS rows each, where its base table has `rows` rows. Scans, as-of
    joins and sums by these entities all stay in such a task, which holds their sorts at once; left to itself, adaptive
    execution merges tasks by compressed bytes, and few of those can be many rows. A table of one task stays as it is."""
    tasks = -(-rows // TASK_ROWS)
    return df if tasks <= 1 else df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *by)


def with_slices(df: DataFrame, by: Sequence[str], order: str, hot: DataFrame | None) -> DataFrame:
    """Add the slice number of hot entities, a non-decreasing function of the order key (null elsewhere): the key's
    rank by the entity's quantiles, between two of them in proportion, times the number of slices."""
    if hot is None:
        return df
    keys = [c for c in hot.columns if c in by]
    x = numeric_key(df, order).cast("double")
    full = F.size(F.filter("__heads", lambda q: q <= x)) * F.col("__width")
    cell = (full + F.size(F.filter(F.slice("__inner", full + 1, F.col("__width")), lambda q: q <= x))).cast("int")
    low, high = F.get("__q", F.col("__cell")), F.get("__q", F.col("__cell") + 1)
    inside = F.when(high > low, F.least(F.greatest((F.col("__x") - low) / (high - low), F.lit(0.0)), F.lit(0.999999))).otherwise(0.0)
    at = F.floor((F.col("__cell") + inside) / (F.size("__q") - 1) * F.col("__slices"))
    ranked = df.join(hot, keys, "left").withColumns({"__x": x, "__cell": cell})
    return ranked.withColumn(SLICE, F.when(F.col("__slices").isNotNull(), F.coalesce(at, F.lit(-(2 ** 40)))).cast("bigint")).drop(
        "__q", "__inner", "__heads", "__width", "__slices", "__x", "__cell")


def scan(df: DataFrame, by: Sequence[str], order: Sequence[str], hot: DataFrame | None = None, **specs: Spec) -> DataFrame:
    """df with one column per spec, scanned over `order` within `by`.

    hot  hot_entities() of the table behind df, on the same key axis as order[0] (any subset of `by`);
         None where every entity is known to fit one task
    """
    by, order = list(by), list(order)
    base = with_slices(df, by, order[0], hot).withColumns({f"__in_{n}": s.value for n, s in specs.items()})
    part = by if hot is None else [*by, SLICE]
    w = Window.partitionBy(*part).orderBy(*order)
    local = base.withColumns({f"__at_{n}": _local(s, F.col(f"__in_{n}"), w) for n, s in specs.items()})
    if hot is None:
        carry_of = {n: None for n in specs}
        both = local
    else:
        key = F.struct(*order)
        ends = base.filter(F.col(SLICE).isNotNull()).groupBy(*part).agg(
            *[_summary(s, F.col(f"__in_{n}"), key).alias(f"__sm_{n}") for n, s in specs.items()])
        wc = Window.partitionBy(*by).orderBy(SLICE)  # one row per slice
        carry = ends.select(*part, *[_carry(s, F.col(f"__sm_{n}"), wc).alias(f"__cy_{n}") for n, s in specs.items()])
        both = local.join(carry, part, "left")
        carry_of = {n: F.col(f"__cy_{n}") for n in specs}
    out = both.withColumns({n: _combine(s, F.col(f"__at_{n}"), carry_of[n]) for n, s in specs.items()})
    return out.drop(SLICE, *[f"{p}_{n}" for n in specs for p in ("__in", "__at", "__cy")])


def _local(s: Spec, c: Column, w) -> Column:
    upto = w.rowsBetween(_UNB, 0 if s.inclusive else -1)
    onward = w.rowsBetween(0 if s.inclusive else 1, _END)
    return {
        "max": lambda: F.max(c).over(upto),
        "sum": lambda: F.sum(c).over(upto),
        "ffill": lambda: F.last(c, ignorenulls=True).over(upto),
        "bfill": lambda: F.first(c, ignorenulls=True).over(onward),
        "lag": lambda: F.lag(c).over(w),
        "lead": lambda: F.lead(c).over(w),
    }[s.kind]()


def _summary(s: Spec, c: Column, key: Column) -> Column:
    present = F.when(c.isNotNull(), key)
    return {
        "max": lambda: F.max(c),
        "sum": lambda: F.sum(c),
        "ffill": lambda: F.max_by(c, present),
        "bfill": lambda: F.min_by(c, present),
        "lag": lambda: F.max_by(c, key),
        "lead": lambda: F.min_by(c, key),
    }[s.kind]()


def _carry(s: Spec, c: Column, wc) -> Column:
    before, after = wc.rowsBetween(_UNB, -1), wc.rowsBetween(1, _END)
    return {
        "max": lambda: F.max(c).over(before),
        "sum": lambda: F.sum(c).over(before),
        "ffill": lambda: F.last(c, ignorenulls=True).over(before),
        "bfill": lambda: F.first(c, ignorenulls=True).over(after),
        "lag": lambda: F.lag(c).over(wc),
        "lead": lambda: F.lead(c).over(wc),
    }[s.kind]()


def _combine(s: Spec, at: Column, carried: Column | None) -> Column:
    if s.kind == "max":
        return at if carried is None else F.greatest(at, carried)
    if s.kind == "sum":
        zero = F.lit(0)
        total = F.coalesce(at, zero)
        return total if carried is None else total + F.coalesce(carried, zero)
    both = at if carried is None else F.coalesce(at, carried)
    return both["v"] if s.kind in ("lag", "lead") else both


def neighbours(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, k: int, out: str = "neighbours",
               hot: DataFrame | None = None) -> DataFrame:
    """Add an array of the up-to-k non-null values of `value` on each side of every row whose own
    value is not null (positions count valid rows only; the row itself is left out)."""
    by, order = list(by), list(order)
    base = with_slices(df, by, order[0], hot).withColumn("__ok", F.col(value).isNotNull())
    part = [*by, "__ok"] if hot is None else [*by, SLICE, "__ok"]
    w = Window.partitionBy(*part).orderBy(*order)
    local = base.withColumns({
        "__before": F.collect_list(value).over(w.rowsBetween(-k, -1)),
        "__after": F.collect_list(value).over(w.rowsBetween(1, k)),
    })
    if hot is None:
        around = F.concat("__before", "__after")
    else:
        # the k outermost valid values of every slice, handed to the slices next to it
        down = Window.partitionBy(*part).orderBy(*[F.desc(o) for o in order])
        ends = base.filter(F.col(SLICE).isNotNull() & F.col("__ok")).withColumns({
            "__i": F.row_number().over(w), "__j": F.row_number().over(down)}).filter(
            (F.col("__i") <= k) | (F.col("__j") <= k))
        item = F.struct(*order, F.col(value).alias("__v"))
        edge = ends.groupBy(*by, SLICE).agg(
            F.array_sort(F.collect_list(F.when(F.col("__i") <= k, item))).alias("__head"),
            F.array_sort(F.collect_list(F.when(F.col("__j") <= k, item))).alias("__tail"))
        wc = Window.partitionBy(*by).orderBy(SLICE)
        carry = edge.select(
            *by, SLICE, F.flatten(F.collect_list("__tail").over(wc.rowsBetween(-k, -1)))["__v"].alias("__cb"),
            F.flatten(F.collect_list("__head").over(wc.rowsBetween(1, k)))["__v"].alias("__ca"))
        empty = F.array().cast(local.schema["__before"].dataType)
        local = local.join(carry, [*by, SLICE], "left").withColumns({
            "__before": F.concat(F.coalesce("__cb", empty), "__before"),
            "__after": F.concat("__after", F.coalesce("__ca", empty))})
        last_k = F.slice("__before", F.greatest(F.size("__before") - k + 1, F.lit(1)), k)
        around = F.concat(last_k, F.slice("__after", 1, k))
    return local.withColumn(out, F.when(F.col("__ok"), around)).drop(SLICE, "__ok", "__before", "__after", "__cb", "__ca")
