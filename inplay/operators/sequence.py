"""Cleaning one entity's event sequence: wild and missing times, monotone repair, scores, known time."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from inplay.operators.asof import seconds
from inplay.operators.scan import bfill, ffill, lag, neighbours, row_number, running_max, running_sum, scan

# fixed values
OUTLIER_S = 45 * 60
MAX_PLAY_S = 120
NEIGHBOURS = 4
FALLBACK_DURATION_S = 5.0
ADMIN_DURATION_S = 0.0
TICKS = 1 << 22  # a second
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z?$"

GAME = ("game_id",)


def epoch_seconds(c: str) -> Column:
    """Wall-clock ISO text to epoch seconds (milliseconds kept); bare clock strings become null."""
    text = F.when(F.col(c).rlike(ISO_TIME), F.regexp_replace(c, "Z$", ""))
    return F.unix_millis(F.try_to_timestamp(text)) / 1000.0


def median_of(values: Column) -> Column:
    """Median of a short array without nulls."""
    s, n = F.array_sort(values), F.size(values)
    half = F.floor(n / 2).cast("int")
    return F.when(n == 0, None).when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2)


def flag_wild(df: DataFrame, by: Sequence[str] = GAME, order: str = "play_id", snap: str = "snap_raw",
              limit_s: float = OUTLIER_S, hot: DataFrame | None = None) -> DataFrame:
    """snap_wild: the time is further than the limit from the median of its valid neighbours (games
    with at least three valid times, i.e. two neighbours)."""
    n = neighbours(df, by, [order], snap, NEIGHBOURS, "__near", hot=hot)
    far = (F.size("__near") >= 2) & (F.abs(F.col(snap) - median_of(F.col("__near"))) > limit_s)
    return n.withColumn("snap_wild", F.coalesce(far, F.lit(False))).drop("__near")


def bad_end(snap: Column, end: Column) -> Column:
    """End times not to trust: missing, without a snap, before it, or too long after it."""
    return end.isNull() | snap.isNull() | (end < snap) | (end - snap > MAX_PLAY_S)


def type_durations(df: DataFrame, play_type: str = "play_type", snap: str = "snap_raw", end: str = "end_raw") -> DataFrame:
    """Median observed length per play type. Lengths are at most two minutes at millisecond
    resolution, so a type's value counts stay small."""
    d = F.col(end) - F.col(snap)
    ok = df.filter(F.col(play_type).isNotNull() & (d >= 0) & (d <= MAX_PLAY_S))
    return ok.groupBy(play_type).agg(F.percentile(F.round(d, 3), F.lit(0.5)).alias("dur"))


def with_durations(df: DataFrame, play_type: str = "play_type", snap: str = "snap_raw", end: str = "end_raw") -> DataFrame:
    """Fallback length per row: the type's median, 0 for rows without a type, 5 s for unseen types."""
    table = F.broadcast(type_durations(df, play_type, snap, end))  # one row per play type
    return df.join(table, play_type, "left").withColumn(
        "duration", F.when(F.col(play_type).isNull(), ADMIN_DURATION_S).otherwise(
            F.coalesce("dur", F.lit(FALLBACK_DURATION_S)))).drop("dur")


def repair_times(df: DataFrame, by: Sequence[str] = GAME, order: str = "play_id", hot: DataFrame | None = None) -> DataFrame:
    """t_snap and t_end (epoch seconds) from columns snap, end, duration, bad and next_valid, by the recursion

    s = the snap, or the previous end where it is missing; never before the previous snap
    e = the end, or s plus the usual length where the end is bad; never before s or the previous end

    from e = the game's first valid snap. It is solved in closed form, so that running sums and maxima (which slices of a
    hot game share) do all of it. A row without a snap starts a stretch: there s = e and e grows by its length d0.
    Ends are counted less the lengths of such rows so far. Within a stretch that began at end p, s is the largest of p and
    the snaps since; a row moves the end to its own end, to the largest snap plus its length, or to p + its length, which is
    d - d0 more than what the stretch began with. So a stretch maps p to max(p + g, h), with g the largest such excess
    (at least 0) and h the largest of the other two, and over stretches p = G + max(first, max(h - G)), G the sum of g.
    All times are whole TICKs on the way, the spacing of doubles between 2004 and 2038, so that these sums equal the ones
    which the recursion makes in doubles, to the last bit."""
    by = list(by)
    ticks = lambda c: F.rint(F.col(c) * TICKS).cast("bigint")
    none = F.lit(None).cast("bigint")
    work = df.withColumns({"__snap": ticks("snap"), "__end": ticks("end"), "__d": ticks("duration"), "__gap": F.col("snap").isNull()})
    went = F.when(F.col("__gap"), F.col("__d"))
    work = scan(work, by, [order], hot=hot, __run=running_sum(F.col("__gap").cast("bigint")), __off=running_sum(F.coalesce(went, F.lit(0))), __d0=ffill(went), __row=row_number())
    of_run = lambda c: F.when(c.isNotNull(), F.struct(F.col("__run").alias("run"), c.alias("v")))
    here = lambda c: F.when(F.col(c)["run"] == F.col("__run"), F.col(c)["v"])
    work = scan(work, by, [order], hot=hot, __m=running_max(of_run(F.col("__snap"))), __first=ffill(F.when(F.col("__row") == 1, ticks("next_valid"))))
    moved = F.when(~F.col("bad"), F.col("__end")).when(~F.col("__gap"), here("__m") + F.col("__d")) - F.col("__off")
    excess = F.when(F.col("bad") & ~F.col("__gap") & (F.col("__run") > 0), F.col("__d") - F.col("__d0"))
    work = scan(work, by, [order], hot=hot, __h=running_max(of_run(moved)), __g=running_max(of_run(F.when(excess > 0, excess))))
    work = work.withColumns({"__snaps": here("__m"), "__h": here("__h"), "__g": F.coalesce(here("__g"), F.lit(0))}).drop("__m")
    work = scan(work, by, [order], hot=hot, __h1=lag("__h"), __g1=lag("__g"))
    work = scan(work, by, [order], hot=hot, __sum=running_sum(F.when(F.col("__gap"), F.coalesce("__g1", F.lit(0))).otherwise(F.lit(0))))
    work = scan(work, by, [order], hot=hot, __most=running_max(F.when(F.col("__gap"), F.col("__h1") - F.col("__sum")).otherwise(none)))
    began = F.greatest("__first", "__most") + F.col("__sum")
    begins = F.when(F.col("__run") > 0, F.greatest(began + F.col("__off") - F.col("__d0"), "__snaps")).otherwise(F.col("__snaps"))
    done = work.withColumns({"t_snap": begins / TICKS, "t_end": (F.greatest(began + F.col("__g"), "__h") + F.col("__off")) / TICKS})
    return done.drop("__snap", "__end", "__d", "__gap", "__run", "__off", "__d0", "__row", "__first", "__h", "__g", "__snaps", "__h1", "__g1", "__sum", "__most")


def clean_times(df: DataFrame, by: Sequence[str] = GAME, order: str = "play_id", limit_s: float = OUTLIER_S,
                hot: DataFrame | None = None, scores: bool = False) -> DataFrame:
    """From snap_raw, end_raw and play_type: t_snap, t_end (epoch seconds) and the four quality flags;
    with scores=True also the columns of with_scores, from the same scan."""
    w = flag_wild(with_durations(df), by, order, limit_s=limit_s, hot=hot)
    w = w.withColumn("snap", F.when(~F.col("snap_wild"), F.col("snap_raw"))).withColumnRenamed("end_raw", "end")
    w = w.withColumn("bad", bad_end(F.col("snap"), F.col("end")))
    more = score_specs() if scores else {}
    s = scan(w, by, [order], hot=hot, __seen=running_max("snap", inclusive=False), next_valid=bfill("snap"), **more)
    s = s.withColumn("snap_out_of_order", F.coalesce(F.col("snap") < F.col("__seen"), F.lit(False)))
    s = finish_scores(s) if scores else s
    t = repair_times(s.drop("__seen"), by, order, hot)
    return t.withColumns({"snap_imputed": F.col("snap").isNull(), "end_imputed": F.col("bad")}).withColumnRenamed(
        "end", "end_raw").drop("snap", "bad", "duration", "next_valid")


def ms_timestamp(sec: Column) -> Column:
    """Epoch seconds to a timestamp, rounded to milliseconds half to even."""
    return F.timestamp_millis(F.rint(sec * 1000).cast("bigint"))


def score_specs() -> dict:
    home, away = "total_home_score", "total_away_score"
    return dict(__rn=row_number(), __hp=running_max(home), __ap=running_max(away), __hb=running_max(home, inclusive=False),
                __ab=running_max(away, inclusive=False))


def finish_scores(s: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    up = lambda c: F.greatest(F.coalesce(c, zero), zero)
    return s.withColumns({"seq": F.col("__rn") - 1, "home_score_post": up("__hp"), "away_score_post": up("__ap"),
                          "home_score_pre": up("__hb"), "away_score_pre": up("__ab")}).drop("__rn", "__hp", "__ap", "__hb", "__ab")


def with_scores(df: DataFrame, by: Sequence[str] = GAME, order: str = "play_id", hot: DataFrame | None = None) -> DataFrame:
    """seq (0-based), and scores that never fall: after each row the highest total so far, before it
    the previous row's."""
    return finish_scores(scan(df, by, [order], hot=hot, **score_specs()))


def build_play_events(pbp: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Raw play rows to cleaned play events, one row per input row. Post-play values keep a _post
    suffix and outcomes a final_ prefix, so that a leak into features is visible."""
    raw = pbp.withColumns({"snap_raw": epoch_seconds("time_of_day"), "end_raw": epoch_seconds("end_clock_time")})
    t = clean_times(raw, hot=hot, scores=True).withColumns({
        "t_snap": ms_timestamp(F.col("t_snap")), "t_end": ms_timestamp(F.col("t_end"))})
    return t.select(
        "game_id", "season", "week", "season_type", "home_team", "away_team", "play_id", "seq", "play_type", "desc",
        "t_snap", "t_end", "snap_imputed", "snap_wild", "snap_out_of_order", "end_imputed", "qtr",
        "game_seconds_remaining", "half_seconds_remaining", "game_half", "posteam",
        (F.col("posteam") == F.col("home_team")).alias("posteam_is_home"), "down", "ydstogo", "yardline_100",
        "goal_to_go", F.col("home_timeouts_remaining").alias("home_timeouts"),
        F.col("away_timeouts_remaining").alias("away_timeouts"), "home_score_pre", "away_score_pre",
        "home_score_post", "away_score_post", F.col("spread_line").alias("pregame_spread"),
        F.col("total_line").alias("pregame_total"), "home_opening_kickoff", F.col("result").alias("final_margin_home"),
        F.col("total").alias("final_total"))


def with_known_times(events: DataFrame, delta_s: float = 0.0, by: Sequence[str] = GAME, order: str = "seq",
                     hot: DataFrame | None = None) -> DataFrame:
    """t_known: when a row's result counts as public, its end plus the delay, never falling; null
    where the end is null."""
    raw = events.withColumn("__t", F.col("t_end") + seconds(round(delta_s * 1000) / 1000))
    s = scan(raw, by, [order], hot=hot, __k=running_max("__t"))
    return s.withColumn("t_known", F.when(F.col("__t").isNotNull(), F.col("__k"))).drop("__t", "__k")


def timing_summary(events: DataFrame) -> DataFrame:
    """Timestamp quality per season over real plays. Games are counted from per-game partial rows."""
    plays = events.filter(F.col("play_type").isNotNull())
    per_game = plays.groupBy("season", "game_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("snap_imputed")).alias("snap"),
        F.count_if(~F.col("end_imputed")).alias("end"), F.count_if("snap_out_of_order").alias("ooo"),
        F.count_if("snap_wild").alias("wild"), F.count_if(F.col("t_snap").isNull()).alias("untimed"))
    n = F.sum("n")
    return per_game.groupBy("season").agg(
        F.count(F.lit(1)).alias("games"), n.alias("plays"), (F.sum("snap") / n).alias("snap_raw"),
        (F.sum("end") / n).alias("end_raw"), (F.sum("ooo") / n).alias("out_of_order"), F.sum("wild").alias("wild"),
        (F.sum("untimed") / n).alias("untimed"))


def pre_snap(events: DataFrame) -> DataFrame:
    """The state known at each snap."""
    return events.select(
        "game_id", F.col("season").cast("int").alias("season"), "season_type", F.col("home_team").alias("home"),
        F.col("away_team").alias("away"), F.col("home_score_pre").cast("int").alias("home_score"),
        F.col("away_score_pre").cast("int").alias("away_score"), F.col("qtr").cast("int").alias("qtr"),
        F.col("game_seconds_remaining").cast("double").alias("game_seconds_remaining"),
        F.col("half_seconds_remaining").cast("double").alias("half_seconds_remaining"), "posteam",
        *[F.col(c).cast("int").alias(c) for c in ("down", "ydstogo", "yardline_100", "home_timeouts", "away_timeouts")],
        (F.col("home_opening_kickoff") == 0).alias("home_receives_2h_kickoff"), "pregame_spread", "pregame_total",
        (F.col("posteam") == F.col("home_team")).alias("posteam_is_home"), "seq")


# ------------------------------------------------------------------ islands


def possession_runs(rows: DataFrame, is_snap: Column, team: str = "posteam", by: Sequence[str] = GAME,
                    order: str = "seq", hot: DataFrame | None = None) -> DataFrame:
    """runs_before: completed runs of snaps by one team before each row, a run by the row's own team
    that is still going left out."""
    held = rows.withColumn("__team", F.when(is_snap, F.col(team)))
    s = scan(held, by, [order], hot=hot, __last=ffill("__team", inclusive=False))
    starts = F.col("__team").isNotNull() & (F.col("__last").isNull() | (F.col("__last") != F.col("__team")))
    s = s.withColumn("__new", F.when(starts, 1).otherwise(0).cast("bigint"))
    s = scan(s, by, [order], hot=hot, __runs=running_sum("__new", inclusive=False))
    going = F.when(F.col("__last") == F.col(team), 1).otherwise(0)
    return s.withColumn("runs_before", F.col("__runs") - going).drop("__team", "__last", "__new", "__runs")
