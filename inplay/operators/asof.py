"""As-of joins as one union and one ordered scan: a single shuffle on the entity, no nested loop."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from inplay.operators.scan import bfill, ffill, numeric_key, running_max, scan


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str,
              direction: str = "backward", tie: str | None = None, exact: bool = True,
              tolerance: float | None = None, columns: Sequence[str] | None = None,
              hot: DataFrame | None = None, suffix: str | None = None) -> DataFrame:
    """left with the columns of the nearest right row at or before (backward) or at or after
    (forward) its key, per entity; nulls where there is none.

    tie        right column that decides between right rows with the same key (highest wins
               backward, lowest forward)
    exact      whether an equal key matches
    tolerance  largest key distance (seconds for timestamps)
    suffix     added to right columns whose names the left has; without one such columns are an error
    """
    by = list(by)
    columns = list(columns or [c for c in right.columns if c not in by])
    clash = [c for c in columns if c in left.columns]
    if clash and suffix is None:
        raise ValueError(f"both sides have columns {clash}: pick `columns`, rename, or give a suffix")
    right = right.withColumns({f"{c}{suffix}": F.col(c) for c in clash})
    taken = [f"{c}{suffix}" if c in clash else c for c in columns]
    forward = direction == "forward"
    # among equal keys the right row must come before the left row to match backward,
    # after it to match forward
    right_first = exact != forward
    tie_col = F.col(tie) if tie else F.lit(0)
    payload = F.struct(*[F.col(c).alias(c) for c in taken], numeric_key(right, right_on).alias("__k"))
    lhs = left.select(*by, numeric_key(left, left_on).alias("__k"), F.lit(1 if right_first else 0).alias("__side"),
                      F.struct(*[F.col(c) for c in left.columns if c not in by]).alias("__l"))
    rhs = right.select(*by, numeric_key(right, right_on).alias("__k"),
                       F.lit(0 if right_first else 1).alias("__side"),
                       payload.alias("__r"), tie_col.alias("__tie")).filter(F.col("__k").isNotNull())
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    op = bfill if forward else ffill
    got = scan(both, by, ["__k", "__side", "__tie"], hot=hot, __m=op("__r")).filter(F.col("__l").isNotNull())
    if tolerance is not None:
        scale = 1_000_000 if _is_time(left, left_on) else 1
        far = F.abs(F.col("__k") - F.col("__m")["__k"]) > F.lit(tolerance * scale)
        got = got.withColumn("__m", F.when(~far, F.col("__m")))
    return got.select(*by, *[F.col("__l")[c].alias(c) for c in left.columns if c not in by],
                      *[F.col("__m")[c].alias(c) for c in taken])


def asof_many(left: DataFrame, by: Sequence[str], left_on: str, rights: Sequence[tuple[DataFrame, str, str]],
              hot: DataFrame | None = None) -> DataFrame:
    """Inclusive backward as-of against several right tables, (frame, key, tie) each, in one
    union and one scan: all keys lie on the same axis, so one shuffle serves them all."""
    by = list(by)
    both = left.select(*by, numeric_key(left, left_on).alias("__k"), F.lit(1).alias("__side"),
                       F.struct(*[F.col(c) for c in left.columns if c not in by]).alias("__l"))
    specs, outs = {}, []
    for i, (right, on, tie) in enumerate(rights):
        cols = [c for c in right.columns if c not in by]
        side = right.select(*by, numeric_key(right, on).alias("__k"), F.lit(0).alias("__side"),
                            F.struct(*cols).alias(f"__r{i}"), F.col(tie).cast("bigint").alias("__tie"))
        both = both.unionByName(side.filter(F.col("__k").isNotNull()), allowMissingColumns=True)
        specs[f"__m{i}"] = ffill(f"__r{i}")
        outs += [F.col(f"__m{i}")[c].alias(c) for c in cols]
    got = scan(both, by, ["__k", "__side", "__tie"], hot=hot, **specs).filter(F.col("__l").isNotNull())
    return got.select(*by, *[F.col("__l")[c].alias(c) for c in left.columns if c not in by], *outs)


def _is_time(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName().startswith("timestamp")


def seconds(n) -> Column:
    """A day-time interval of n seconds (column or number)."""
    return F.make_dt_interval(secs=(n if isinstance(n, Column) else F.lit(n)).cast("decimal(18,6)"))


def with_known_time(prices: DataFrame, delta: Column | float, by: Sequence[str] = ("game_id",),
                    order: str = "order", hot: DataFrame | None = None) -> DataFrame:
    """t_known: when each quote reaches the engine. A pregame quote is known at once, every
    other one `delta` seconds after its event; never earlier than the quote before it."""
    delta = delta if isinstance(delta, Column) else F.lit(float(delta))
    lag_s = F.when(F.col("kind") == "pregame", F.lit(0.0)).otherwise(delta)
    raw = prices.withColumn("__t", F.col("t") + seconds(lag_s))
    # the log's order follows its times, so sorting by (time, order) keeps the slices on the time axis;
    # a log whose times were replaced carries the recorded ones in logged_t
    at = "logged_t" if "logged_t" in prices.columns else "t"
    return scan(raw, by, [at, order], hot=hot, t_known=running_max("__t")).drop("__t")


def model_asof(prices: DataFrame, times: DataFrame, delta: Column | float, by: Sequence[str] = ("game_id",),
               columns: Sequence[str] = ("order", "p_home", "p_tie", "kind", "qtr", "game_seconds_remaining",
                                         "n_sims"),
               hot: DataFrame | None = None) -> DataFrame:
    """times with the model's last quote known by t. Quotes known at the same moment: the
    latest in the log counts."""
    known = with_known_time(prices, delta, by, hot=hot)
    return asof_join(times, known.select(*by, "t_known", *columns), by, "t", "t_known", tie="order", hot=hot)


def outside_intervals(times: DataFrame, intervals: DataFrame, by: Sequence[str] = ("game_id",), t: str = "t",
                      start: str = "start", stop: str = "stop", hot: DataFrame | None = None) -> DataFrame:
    """times without the rows inside [start, stop) of the latest interval that began by then."""
    j = asof_join(times, intervals.select(*by, start, stop), by, t, start, tie=stop, hot=hot)
    return j.filter(F.col(stop).isNull() | (F.col(t) >= F.col(stop))).drop(start, stop)


def reviews(prices: DataFrame, delta: Column | float, by: Sequence[str] = ("game_id",)) -> DataFrame:
    """Spans in which a ruling was pending: from the play's end until the engine hears it."""
    delta = delta if isinstance(delta, Column) else F.lit(float(delta))
    return prices.filter(F.col("timing") == "review").select(
        *by, F.col("t_play_end").alias("start"), (F.col("t") + seconds(delta)).alias("stop"))
