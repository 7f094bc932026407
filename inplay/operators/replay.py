"""Play rows to the sequence of events a live engine would have seen, each at its public time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inplay.operators.asof import seconds
from inplay.operators.scan import lead, row_number, running_max, scan
from inplay.operators.sequence import possession_runs

# fixed values
MAX_PLAY_SECONDS = 40.0
SNAP_EVENT_HALF_SECONDS = 300
END_QUANTILE = 0.99
DEFAULT_END_BOUND_S = 20.0
PENALTY_LAG_S = 60.0
REVIEW_LAG_S = 240.0
REVIEW = "(?i)replay official|challenged|reviewed|reversed|upheld"
PENALTY = "(?i)penalty"


def nearest_quantile(df: DataFrame, group: str, value: str, q: float, out: str) -> DataFrame:
    """Quantile per group as the element at round(q * (n - 1)) of the sorted values. Works on value
    counts, so a group costs its distinct values, not its rows."""
    from pyspark.sql import Window

    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("__c"))
    upto = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"__cum": F.sum("__c").over(upto), "__n": F.sum("__c").over(Window.partitionBy(group))})
    return ranked.filter(F.col("__cum") > F.floor(F.lit(q) * (F.col("__n") - 1) + 0.5)).groupBy(group).agg(
        F.min(value).alias(out))


def end_bounds(events: DataFrame, q: float = END_QUANTILE) -> DataFrame:
    """Longest usual length (whole seconds) of each play type, over rows whose times are both raw."""
    ok = events.filter(F.col("play_type").isNotNull() & ~F.col("snap_imputed") & ~F.col("end_imputed"))
    d = ((F.unix_micros("t_end") - F.unix_micros("t_snap")) / 1000000).cast("bigint")
    return nearest_quantile(ok.withColumn("__d", d), "play_type", "__d", q, "bound_s")


def is_kickoff(play_type: Column, down: Column, desc: Column) -> Column:
    """Kickoffs, including one called back by a penalty (logged as no_play without a down)."""
    return F.coalesce(play_type == "kickoff", F.lit(False)) | F.coalesce(
        (play_type == "no_play") & down.isNull() & F.coalesce(desc, F.lit("")).contains(" kicks "), F.lit(False))


def is_try(play_type: Column, down: Column, desc: Column) -> Column:
    """Every other row without a down is a try after a touchdown."""
    return down.isNull() & ~is_kickoff(play_type, down, desc)


def phase_of(play_type: Column, down: Column, desc: Column) -> Column:
    return F.when(is_kickoff(play_type, down, desc), "kickoff").when(is_try(play_type, down, desc), "pat").otherwise("snap")


def play_length(t_snap: Column, t_end: Column, qtr: Column, gsr: Column, hsr: Column) -> Column:
    """Game clock a play used: its wall length, at most 40 s and at most the clock left."""
    wall = (F.unix_micros(t_end) - F.unix_micros(t_snap)) / 1e6
    s = F.least(F.greatest(wall, F.lit(0.0)), F.lit(MAX_PLAY_SECONDS))
    return F.least(s, F.when(qtr <= 4, hsr).otherwise(gsr))


def clock_left(t_snap: Column, t_end: Column, qtr: Column, gsr: Column, hsr: Column) -> Column:
    left = F.when(qtr <= 4, hsr).otherwise(gsr)
    return F.greatest(left - play_length(t_snap, t_end, qtr, gsr, hsr), F.lit(0.0))


def public_time(bound_s: Column, period_over: Column, cap: Column, left: Column) -> tuple[Column, Column]:
    """(time, rule) when a play's result became public, for columns t_snap, t_end, end_imputed, desc.
    `cap` is the next snap's own time (null where there is none to trust), `left` the clock left."""
    t_snap, t_end, desc = F.col("t_snap"), F.col("t_end"), F.coalesce(F.col("desc"), F.lit(""))
    runs_out = F.coalesce(period_over & (left > 0), F.lit(False))
    base = F.when(F.col("end_imputed"), t_snap + seconds(F.coalesce(bound_s, F.lit(DEFAULT_END_BOUND_S)))).otherwise(t_end)
    base = F.when(runs_out, base + seconds(left)).otherwise(base)
    waits = runs_out | F.col("end_imputed")
    base = F.when(waits & cap.isNotNull(), F.least(base, cap)).otherwise(base)
    reviewed, flagged = desc.rlike(REVIEW), desc.rlike(PENALTY)
    ruled = t_end + seconds(PENALTY_LAG_S)
    t = (F.when(reviewed, F.greatest(base, F.coalesce(cap, t_end + seconds(REVIEW_LAG_S))))
         .when(flagged, F.greatest(base, F.least(ruled, cap))).otherwise(base))
    rule = (F.when(reviewed, "review").when(flagged, "penalty").when(runs_out, "clock")
            .when(F.col("end_imputed"), "imputed").otherwise("end"))
    return F.greatest(t, t_end), rule


NEXT = ("seq", "play_type", "posteam", "down", "ydstogo", "yardline_100", "desc", "t_snap", "snap_imputed", "qtr",
        "game_seconds_remaining", "half_seconds_remaining", "game_half", "home_timeouts", "away_timeouts",
        "home_score_pre", "away_score_pre", "runs_before")


def with_next(rows: DataFrame, bounds: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Real plays with the next play as a struct, the type's length bound, and overtime runs."""
    ot = (F.col("qtr") >= 5) & F.col("down").isNotNull() & F.col("posteam").isNotNull()
    runs = possession_runs(rows, ot, hot=hot)
    plays = runs.filter(F.col("play_type").isNotNull() & F.col("posteam").isNotNull() & F.col("t_end").isNotNull())
    s = scan(plays, ["game_id"], ["seq"], hot=hot, nxt=lead(F.struct(*NEXT)), __rn=row_number())
    return s.withColumn("is_first", F.col("__rn") == 1).drop("__rn").join(
        F.broadcast(bounds), "play_type", "left")  # one row per play type


def with_public_time(plays: DataFrame) -> DataFrame:
    """t_public, timing and the clock a play used, for the output of with_next."""
    q, g, h = F.col("qtr"), F.col("game_seconds_remaining"), F.col("half_seconds_remaining")
    length = play_length(F.col("t_snap"), F.col("t_end"), q, g, h)
    left = clock_left(F.col("t_snap"), F.col("t_end"), q, g, h)
    last = F.col("nxt").isNull()
    decided = (q >= 5) & (F.col("home_score_post") != F.col("away_score_post"))
    over = F.when(last, ~decided).otherwise(F.col("nxt.game_half") != F.col("game_half"))
    cap = F.when(~last & ~F.col("nxt.snap_imputed"), F.col("nxt.t_snap"))
    t, rule = public_time(F.col("bound_s").cast("double"), over, cap, left)
    return plays.withColumns({"t_public": t, "timing": rule, "length": length})


def replay_events(rows: DataFrame, bounds: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Pregame, play, snap and final events of every game, in time order, with the new state."""
    p = with_public_time(with_next(rows, bounds, hot))
    nx = lambda c: F.col(f"nxt.{c}")
    last = F.col("nxt").isNull()
    kicks = nx("posteam") != F.col("home_team")
    phase = phase_of(nx("play_type"), nx("down"), nx("desc"))
    new_period = nx("game_half") != F.col("game_half")
    toss = new_period & (nx("qtr") >= 5) & (F.col("qtr") <= 4)
    kicker = F.when((phase == "kickoff"), kicks)
    opening = F.when(F.col("home_opening_kickoff").isNotNull(), F.col("home_opening_kickoff") == 0)
    own_home = F.col("posteam") == F.col("home_team")
    home_pts = F.col("home_score_post") - F.col("home_score_pre")
    away_pts = F.col("away_score_post") - F.col("away_score_pre")
    safety = F.when(own_home, (away_pts == 2) & (home_pts == 0)).otherwise((home_pts == 2) & (away_pts == 0))
    free = (phase == "kickoff") & ~is_try(F.col("play_type"), F.col("down"), F.col("desc")) & safety
    runs_on = ~new_period & (phase == "snap")
    ot = F.when(nx("qtr") >= 5, nx("runs_before")).otherwise(0)
    null = F.lit(None)

    def event(pos, kind, seq, t, timing, t_play_end, phase_, kicker_, free_, ot_, qtr, gsr, hsr, hs, aw, pos_team, down,
              togo, yl, hto, ato) -> Column:
        return F.struct(
            F.lit(pos).alias("pos"), F.lit(kind).alias("kind"), seq.cast("bigint").alias("ev_seq"), t.alias("t_raw"),
            timing.alias("ev_timing"), t_play_end.cast("timestamp").alias("t_play_end"), phase_.alias("phase"),
            kicker_.cast("boolean").alias("kicker_home"), free_.cast("boolean").alias("free_kick"),
            ot_.cast("bigint").alias("ot_possessions"), qtr.cast("bigint").alias("ev_qtr"),
            gsr.cast("double").alias("ev_gsr"), hsr.cast("double").alias("ev_hsr"), hs.cast("bigint").alias("home_score"),
            aw.cast("bigint").alias("away_score"), pos_team.cast("string").alias("ev_posteam"),
            down.cast("bigint").alias("ev_down"), togo.cast("bigint").alias("ev_ydstogo"),
            yl.cast("bigint").alias("ev_yardline"), hto.cast("bigint").alias("ev_home_timeouts"),
            ato.cast("bigint").alias("ev_away_timeouts"))

    pregame = event(0, "pregame", F.lit(-1), F.col("t_snap"), F.lit("pregame"), null, F.lit("kickoff"), opening, F.lit(False),
                    F.lit(0), F.lit(1), F.lit(3600.0), F.lit(1800.0), F.lit(0), F.lit(0), null, null, null, null, F.lit(3), F.lit(3))
    play = event(1, "play", F.col("seq"), F.col("t_public"), F.col("timing"), F.col("t_end"), phase,
                 F.when(~toss, kicker), free, ot, nx("qtr"),
                 F.when(runs_on, F.col("game_seconds_remaining") - F.col("length")).otherwise(nx("game_seconds_remaining")),
                 F.when(runs_on, F.col("half_seconds_remaining") - F.col("length")).otherwise(nx("half_seconds_remaining")),
                 F.col("home_score_post"), F.col("away_score_post"), nx("posteam"), nx("down"), nx("ydstogo"),
                 nx("yardline_100"), F.when(new_period, nx("home_timeouts")).otherwise(F.col("home_timeouts")),
                 F.when(new_period, nx("away_timeouts")).otherwise(F.col("away_timeouts")))
    snap = event(2, "snap", nx("seq"), nx("t_snap"), F.lit("snap"), null, phase, F.when(toss, kicker), F.lit(False), ot,
                 nx("qtr"), nx("game_seconds_remaining"), nx("half_seconds_remaining"), nx("home_score_pre"),
                 nx("away_score_pre"), nx("posteam"), nx("down"), nx("ydstogo"), nx("yardline_100"), nx("home_timeouts"),
                 nx("away_timeouts"))
    final = event(1, "final", F.col("seq"), F.col("t_public"), F.col("timing"), F.col("t_end"), F.lit("snap"), null,
                  F.lit(False), F.lit(0), F.col("qtr"), F.lit(0.0), F.lit(0.0), F.col("home_score_post"),
                  F.col("away_score_post"), F.col("posteam"), F.col("down"), F.col("ydstogo"), F.col("yardline_100"),
                  F.col("home_timeouts"), F.col("away_timeouts"))
    late_snap = (nx("qtr") >= 4) | ((nx("qtr") == 2) & (nx("half_seconds_remaining") <= SNAP_EVENT_HALF_SECONDS))
    shows = ~last & nx("t_snap").isNotNull() & ~nx("snap_imputed") & (toss | ((phase == "snap") & late_snap))
    found = F.filter(F.array(F.when(F.col("is_first"), pregame), F.when(last, final).otherwise(play),
                             F.when(shows, snap)), lambda e: e.isNotNull())
    flat = p.select("game_id", "home_team", F.col("seq").alias("row_seq"), F.explode(found).alias("e")).select(
        "game_id", "home_team", "row_seq", "e.*")
    s = scan(flat, ["game_id"], ["row_seq", "pos"], hot=hot, t=running_max("t_raw"), __rn=row_number())
    return s.select(
        "game_id", (F.col("__rn") - 1).alias("order"), F.col("ev_seq").alias("seq"), "kind", "t",
        F.col("ev_timing").alias("timing"), "t_play_end", "phase", "kicker_home", "free_kick", "ot_possessions",
        F.col("ev_qtr").alias("qtr"), F.col("ev_gsr").alias("game_seconds_remaining"),
        F.col("ev_hsr").alias("half_seconds_remaining"), "home_score", "away_score", F.col("ev_posteam").alias("posteam"),
        (F.col("ev_posteam") == F.col("home_team")).alias("posteam_is_home"), F.col("ev_down").alias("down"),
        F.col("ev_ydstogo").alias("ydstogo"), F.col("ev_yardline").alias("yardline_100"),
        F.col("ev_home_timeouts").alias("home_timeouts"), F.col("ev_away_timeouts").alias("away_timeouts"))


def price_frame(priced: DataFrame, n_sims: int = 2000) -> DataFrame:
    """Typed price-log rows. The final whistle is not simulated: its price is the result, with zero
    games behind it. Columns that an input lacks (priors, knobs, timings) become null."""
    from inplay.sources.tables import conform

    final = F.col("kind") == "final"
    won = F.when(F.col("home_score") > F.col("away_score"), 1.0).when(F.col("home_score") == F.col("away_score"), 0.5).otherwise(0.0)
    rows = priced.withColumns({
        "p_home": F.when(final, won).otherwise(F.col("p_home")),
        "p_tie": F.when(final, (F.col("home_score") == F.col("away_score")).cast("double")).otherwise(F.col("p_tie")),
        "n_sims": F.when(final, 0).otherwise(n_sims)})
    key = rows.schema["game_id"].dataType.simpleString()
    return conform(rows, LOG_SCHEMA.format(key=key))


# fixed values: columns of the price log
LOG_SCHEMA = ("game_id {key}, `order` INT, seq BIGINT, kind STRING, t TIMESTAMP, timing STRING, t_play_end TIMESTAMP, "
              "phase STRING, qtr INT, game_seconds_remaining DOUBLE, home_score INT, away_score INT, posteam_is_home BOOLEAN, "
              "down TINYINT, ydstogo SMALLINT, yardline_100 SMALLINT, home_timeouts INT, away_timeouts INT, p_home DOUBLE, "
              "p_tie DOUBLE, margin_mean DOUBLE, total_mean DOUBLE, cdf_margin ARRAY<FLOAT>, cdf_total ARRAY<FLOAT>, "
              "wp_direct_home DOUBLE, seconds DOUBLE, n_sims INT, prior_home_win DOUBLE, prior_total DOUBLE, "
              "prior_win_source STRING, prior_total_source STRING, knob_spread DOUBLE, knob_total DOUBLE, "
              "knob_home_win DOUBLE, knob_total_median DOUBLE, knob_converged BOOLEAN")
