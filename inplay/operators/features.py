"""Model features and labels as column expressions; only whitelisted pre-snap inputs are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inplay.operators.distributions import one_hot, search_left, search_right
from inplay.operators.segments import RESULTS

# fixed values
MISSING_SPREAD = 1.5
WP_FEATURES = ("receive_2h_ko", "home", "half_seconds_remaining", "game_seconds_remaining", "Diff_Time_Ratio",
               "score_differential", "down", "ydstogo", "yardline_100", "posteam_timeouts_remaining",
               "defteam_timeouts_remaining")
WP_SPREAD_FEATURES = ("receive_2h_ko", "spread_time", *WP_FEATURES[1:])
FEATURE_INPUTS = ("game_id", "season", "seq", "qtr", "game_seconds_remaining", "half_seconds_remaining", "posteam",
                  "home_team", "away_team", "down", "ydstogo", "yardline_100", "home_timeouts", "away_timeouts",
                  "home_score_pre", "away_score_pre", "pregame_spread")
LABEL_INPUTS = ("final_margin_home",)
DURATION_EDGES = (0, 6, 10, 15, 22, 32, 44, 56, 70, 85, 100, 118, 138, 160, 186, 216, 250, 300, 380, 900)
N_BINS = len(DURATION_EDGES) - 1
TIMED = tuple(r for r in RESULTS if r != "end_half")
END_HALF = len(TIMED) * N_BINS
DIFF_BUCKETS = (-8.5, -3.5, -0.5, 0.5, 3.5, 8.5)
ERA_BASE, ERA_SCALE, TOTAL_BASE = 2016, 8.0, 44.0
N_QUANTILES = 33


def wp_features(events: DataFrame) -> DataFrame:
    """Win-probability features of rows with a possession, and the label (null for a tie). The team that
    kicked off is the other one than the first with the ball, found per game by an aggregation."""
    e = events.select(*FEATURE_INPUTS, *LABEL_INPUTS)
    first = e.groupBy("game_id").agg(F.min_by("posteam", F.when(F.col("posteam").isNotNull(), F.col("seq"))).alias("__first"))
    e = e.filter(F.col("posteam").isNotNull()).join(first, "game_id")
    kicked = F.when(F.col("__first") == F.col("home_team"), F.col("away_team")).otherwise(F.col("home_team"))
    home = F.col("posteam") == F.col("home_team")
    decay = F.exp(-4 * (3600 - F.col("game_seconds_remaining")) / 3600)
    margin = F.col("home_score_pre") - F.col("away_score_pre")
    spread = F.coalesce("pregame_spread", F.lit(MISSING_SPREAD))
    final = F.col("final_margin_home")
    e = e.withColumns({
        "receive_2h_ko": ((F.col("qtr") <= 2) & (F.col("posteam") == kicked)).cast("tinyint"), "home": home.cast("tinyint"),
        "score_differential": F.when(home, margin).otherwise(-margin),
        "posteam_timeouts_remaining": F.when(home, F.col("home_timeouts")).otherwise(F.col("away_timeouts")),
        "defteam_timeouts_remaining": F.when(home, F.col("away_timeouts")).otherwise(F.col("home_timeouts")),
        "spread_time": F.when(home, spread).otherwise(-spread) * decay,
        "label": F.when(final == 0, None).when(home, (final > 0).cast("tinyint")).otherwise((final < 0).cast("tinyint"))})
    return e.withColumn("Diff_Time_Ratio", F.col("score_differential") / decay).select(
        "game_id", "season", "seq", "qtr", "posteam", "home_team", *WP_SPREAD_FEATURES, "label")


def training_frame(features: DataFrame, extra: DataFrame) -> DataFrame:
    """Features with the raw columns (game_id, seq, play_type, ep) joined, and the training row filters."""
    j = features.join(extra, ["game_id", "seq"])
    keep = F.col("qtr") <= 4
    for c in ("label", "play_type", "ep", "yardline_100", "posteam_timeouts_remaining", "defteam_timeouts_remaining"):
        keep = keep & F.col(c).isNotNull()
    return j.filter(keep)


def drive_features(season_cap: int | None = None) -> Column:
    """The 25 drive-model inputs of a snap row as an array (offense's view)."""
    y = F.col("yardline_100").cast("double")
    clip = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    down = clip(F.col("down").cast("int"), 1, 4)
    togo = clip(F.col("ydstogo").cast("double"), 1.0, 30.0)
    t = clip(F.col("half_seconds_remaining").cast("double"), 0.0, 1800.0)
    diff = F.col("score_diff").cast("double")
    season = F.col("season") if season_cap is None else F.least(F.col("season"), F.lit(season_cap))
    flag = lambda c: c.cast("double")
    head = F.array(y / 100, *[flag(down == k) for k in (1, 2, 3, 4)], F.log1p(togo) / F.log(F.lit(31.0)), flag(togo >= y),
                   t / 1800, F.least(t, F.lit(300.0)) / 300, flag(t <= 120), flag(F.col("game_half") != "Half1"),
                   clip(diff, -35.0, 35.0) / 14)
    tail = F.array(F.col("timeouts_off") / 3, F.col("timeouts_def") / 3, F.coalesce("spread_off", F.lit(0.0)) / 7,
                   (F.coalesce("pregame_total", F.lit(TOTAL_BASE)) - TOTAL_BASE) / 7, (season - ERA_BASE) / ERA_SCALE,
                   flag(F.col("season_type") == "POST"))
    return F.concat(head, one_hot(search_left(DIFF_BUCKETS, diff), len(DIFF_BUCKETS) + 1), tail)


def duration_bin(seconds: Column) -> Column:
    return F.least(F.greatest(search_right(DURATION_EDGES, seconds) - 1, F.lit(0)), F.lit(N_BINS - 1))


def class_label(result: Column, seconds: Column) -> Column:
    """(result, duration bin) as one class; drives that end the half are one class of their own."""
    timed = F.array_position(F.array(*[F.lit(r) for r in TIMED]), result) - 1
    return F.when(result == "end_half", END_HALF).when(timed >= 0, timed * N_BINS + duration_bin(seconds)).cast("int")


def training_snaps(snaps: DataFrame) -> DataFrame:
    keep = F.col("game_half") != "Overtime"
    for c in ("result", "seconds", "half_seconds_remaining", "score_diff", "timeouts_off", "timeouts_def"):
        keep = keep & F.col(c).isNotNull()
    return snaps.filter(keep)


def bin_quantiles(snaps: DataFrame) -> DataFrame:
    """33 quantiles of the drive duration per duration bin; a bin without data gets even steps. Game
    clocks are whole seconds, so a bin's value counts are few."""
    q = [i / (N_QUANTILES - 1) for i in range(N_QUANTILES)]
    got = snaps.filter(F.col("result") != "end_half").groupBy(duration_bin(F.col("seconds")).alias("bin")).agg(
        F.percentile("seconds", F.array(*[F.lit(x) for x in q])).alias("q"))
    spark = snaps.sparkSession
    lo = F.element_at(F.array(*[F.lit(float(e)) for e in DURATION_EDGES]), F.col("bin") + 1)
    hi = F.element_at(F.array(*[F.lit(float(e)) for e in DURATION_EDGES]), F.col("bin") + 2)
    even = F.transform(F.sequence(F.lit(0), F.lit(N_QUANTILES - 1)), lambda i: lo + (hi - lo) * i / (N_QUANTILES - 1))
    bins = spark.range(N_BINS).select(F.col("id").cast("int").alias("bin"))
    return bins.join(got, "bin", "left").select("bin", F.coalesce("q", even).alias("q"))


def quantile_value(q: Column, u: Column) -> Column:
    """Seconds at uniform u from a bin's quantile row."""
    pos = u * (N_QUANTILES - 1)
    lo = F.least(F.floor(pos), F.lit(N_QUANTILES - 2)).cast("int")
    return F.get(q, lo) + (pos - lo) * (F.get(q, lo + 1) - F.get(q, lo))


def recency_weight(season: Column, last: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), (last - season) / half_life)
