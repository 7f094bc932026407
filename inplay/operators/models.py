"""Win-probability and outcome models, and their scoring tables."""

from __future__ import annotations

from dataclasses import replace
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from inplay.operators import boosting
from inplay.operators.boosting import Settings, Trees
from inplay.operators.bootstrap import entity_sums, resample
from inplay.operators.features import END_HALF, N_BINS, TIMED, WP_FEATURES, WP_SPREAD_FEATURES
from inplay.operators.metrics import brier_row, calibration_error, log_loss_row, summary
from inplay.operators.segments import RESULTS
from inplay.operators.onerow import with_row
from inplay.session import all_cores

# fixed values: tree settings of the two model variants. The spread model may only rise with the lead and the own time-outs and
# only fall with down, distance, field position and the other side's time-outs.
MODELS = {
    "wp": {"features": WP_FEATURES, "trees": Settings(rounds=65, step=0.2, depth=4, row_share=0.8, column_share=0.8)},
    "wp_spread": {"features": WP_SPREAD_FEATURES, "trees": Settings(
        rounds=534, step=0.05, depth=5, row_share=0.9224245, column_share=5 / 12, split_penalty=0.79012017, leaf_weight=7,
        signs=(0, 0, 0, 0, 0, 1, 1, -1, -1, -1, 1, -1))},
}
PUBLISHED = {"wp": 0.0055, "wp_spread": 0.0066}
GATE_TOLERANCE = 0.001


def fit(frame: DataFrame, kind: str = "wp_spread", rounds: int | None = None) -> Trees:
    """Boosted trees on the variant's features, with its constraints and samples."""
    m = MODELS[kind]
    settings = m["trees"] if rounds is None else replace(m["trees"], rounds=rounds)
    return boosting.fit(frame, m["features"], "label", settings)


def predict(model: Trees, frame: DataFrame, kind: str = "wp_spread", out: str = "wp") -> DataFrame:
    return frame.withColumn(out, boosting.predict(model, [F.col(c) for c in MODELS[kind]["features"]]))


def season_facts(scored: DataFrame, p: str = "wp", label: str = "label") -> DataFrame:
    """Per season: rows, games, labels of one, log loss of the season's own base rate, that of the scores, and whether all
    scores are probabilities."""
    y = F.col(label).cast("double")
    per = scored.groupBy("season", "game_id").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(log_loss_row(F.col(p), y)).alias("l"),
                                                  F.min(F.col(p).between(0, 1)).alias("ok"))
    all_ = per.groupBy("season").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("games"), F.sum("s").alias("s"), F.sum("l").alias("l"), F.min("ok").alias("in_unit_interval"))
    share = F.col("s") / F.col("rows")
    base = -(share * F.log(share) + (1 - share) * F.log(1 - share))
    return all_.select("season", "rows", "games", F.col("s").cast("bigint").alias("positives"), base.alias("base_loss"), (F.col("l") / F.col("rows")).alias("loss"), "in_unit_interval")


def forward_report(scored: DataFrame, a: str, b: str, label: str = "label", by: str = "game_id", n_boot: int = 1000) -> DataFrame:
    """Two forecasts of the same rows in one row: Brier and log loss of each, the differences a - b and their 90%
    intervals from resampling games, all under the same draws."""
    y = F.col(label).cast("double")
    sums = {f"{m}_{side}": row(F.col(c), y) for m, row in (("brier", brier_row), ("log_loss", log_loss_row)) for side, c in (("a", a), ("b", b))}
    stats = entity_sums(scored, by, n=F.lit(1.0), **sums)
    total = stats.agg(F.sum("n").cast("bigint").alias("rows"), F.count(F.lit(1)).alias("games"), *[(F.sum(c) / F.sum("n")).alias(c) for c in sums])
    total = total.withColumns({f"{m}_diff": F.col(f"{m}_a") - F.col(f"{m}_b") for m in ("brier", "log_loss")})
    reps = resample(stats, by, ["n", *sums], n_boot)
    return total.transform(with_row, reps.agg(*[F.percentile((F.col(f"{m}_a") - F.col(f"{m}_b")) / F.col("n"), F.lit(q)).alias(f"{m}_diff_{tag}")
                                                for m in ("brier", "log_loss") for tag, q in (("p05", 0.05), ("p95", 0.95))]))


def loso_cv(frame: DataFrame, seasons: Sequence[int], kind: str = "wp_spread", rounds: int | None = None) -> DataFrame:
    """Leave one season out: each season scored by a model trained on the others. One fit per season; the
    seasons are a short, fixed list. One pass over the rows scores all seasons."""
    data = frame.filter(F.col("season").isin(*seasons))
    features = MODELS[kind]["features"]
    models = {s: fit(data.filter(F.col("season") != s), kind, rounds) for s in seasons}

    @F.pandas_udf(DoubleType())
    def score(season: pd.Series, *columns: pd.Series) -> pd.Series:
        x, out = np.stack([c.to_numpy(dtype="float64", na_value=np.nan) for c in columns], 1), np.full(len(season), np.nan)
        for s, model in models.items():
            own = (season == s).to_numpy()
            out[own] = model.probabilities(x[own])
        return pd.Series(out)

    return data.withColumn("wp", score("season", *[F.col(c).cast("double") for c in features]))


def with_external(frame: DataFrame, ids: DataFrame, external: DataFrame, column: str) -> DataFrame:
    """Attach another source's predictions by (game_id, play_id); rows it left blank are dropped."""
    pred = external.select("game_id", "play_id", F.col(column).alias("external"))
    return frame.join(ids.select("game_id", "seq", "play_id"), ["game_id", "seq"]).join(pred, ["game_id", "play_id"], "left").filter(
        F.col("external").isNotNull())


def cv_report(cv: DataFrame, kind: str, n_boot: int = 1000) -> DataFrame:
    """Pooled scores, how much resampling games moves the calibration error, and the range over seasons.
    Replicates reweight per-game cells, never rows."""
    pooled = summary(cv, "wp", "label", "qtr")
    cells = cv.groupBy("game_id", F.col("qtr").cast("bigint").alias("qtr"), F.rint(F.col("wp") / 0.05).alias("b")).agg(
        F.sum(F.lit(1.0)).alias("n_plays"), F.sum((F.col("label") == 1).cast("double")).alias("n_wins")).persist()

    def error(c: DataFrame, groups: list[str]) -> DataFrame:
        t = c.groupBy(*groups, "qtr", "b").agg(F.sum("n_plays").alias("n_plays"), F.sum("n_wins").alias("n_wins"))
        return calibration_error(t.withColumn("cal_diff", F.abs(F.col("b") * 0.05 - F.col("n_wins") / F.col("n_plays"))), groups)

    reps = resample(cells, "game_id", ["n_plays", "n_wins"], n_boot, ["qtr", "b"])
    sd = error(reps, ["rep"]).agg(F.stddev_samp("calibration_error").alias("calibration_error_sd"))
    by_season = summary(cv, "wp", "label", "qtr", ["season"]).agg(F.min("calibration_error").alias("season_min"), F.max("calibration_error").alias("season_max"))
    return pooled.transform(with_row, sd).transform(with_row, by_season).withColumn("gate", F.col("calibration_error") <= PUBLISHED[kind] + GATE_TOLERANCE)


def fit_outcomes(frame: DataFrame, weight: str = "w", iterations: int = 50):
    """Multinomial regression over (result, duration bin) classes with recency weights: the linear
    baseline of the network (Spark ML's network takes neither weights nor this activation), as a Spark ML model. Every iteration
    passes over all rows, which are few bytes and much work (rows x classes x features), so they are dealt to all cores first.
    softmax.fit is the same regression by matrix products, for many rows."""
    data = frame.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"), F.col(weight).alias("w"))
    data = data.repartition(all_cores(frame.sparkSession))
    return LogisticRegression(family="multinomial", weightCol="w", maxIter=iterations, regParam=1e-4).fit(data)


def network_scores(x: Column, weights_: Sequence[np.ndarray], biases: Sequence[np.ndarray]) -> Column:
    """Class probabilities of a ReLU network with a softmax, from its weight tables (they are small and
    travel with the task)."""
    ws, bs = [np.asarray(w, dtype="float64") for w in weights_], [np.asarray(b, dtype="float64") for b in biases]

    @F.pandas_udf(ArrayType(DoubleType()))
    def score(rows: pd.Series) -> pd.Series:
        h = np.stack([np.asarray(r, dtype="float64") for r in rows]) if len(rows) else np.zeros((0, ws[0].shape[0]))
        for w, b in zip(ws[:-1], bs[:-1]):
            h = np.maximum(h @ w + b, 0.0)
        z = h @ ws[-1] + bs[-1]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return pd.Series(list(z / z.sum(axis=1, keepdims=True)))

    return score(x)


def result_probs(p: Column) -> Column:
    """Probabilities per result, summed over duration bins, in the order of RESULTS."""
    one = {r: F.aggregate(F.slice(p, i * N_BINS + 1, N_BINS), F.lit(0.0), lambda a, v: a + v) for i, r in enumerate(TIMED)}
    return F.array(*[one[r] if r in one else F.get(p, F.lit(END_HALF)) for r in RESULTS])


# fixed values: outcome groups of the drive report
OUTCOMES = {"touchdown": ("td0", "td1", "td2"), "field goal made": ("fg",), "field goal missed": ("fg_miss",), "punt": ("punt",),
            "turnover": ("turnover", "opp_td"), "turnover on downs": ("downs",), "end of half": ("end_half",), "safety": ("safety",)}


def outcome_rows(snaps: DataFrame, probs: str = "rp") -> DataFrame:
    """One row per snap and outcome group: predicted probability p and whether it happened, y."""
    items = [F.struct(F.lit(name).alias("outcome"), sum((F.get(probs, F.lit(RESULTS.index(r))) for r in rs), F.lit(0.0)).alias("p"),
                      F.col("result").isin(*rs).cast("double").alias("y")) for name, rs in OUTCOMES.items()]
    return snaps.withColumn("o", F.explode(F.array(*items))).select("*", "o.*").drop("o")


def clock_pit(p: Column, quantiles: Column, clock: Column, actual: Column) -> tuple[Column, Column]:
    """(PIT, mean) of a drive's clock: duration bins with their quantile rows (an array of arrays), and the
    mass of drives that end the half; a drive that runs the clock out counts at the middle of its mass."""
    from inplay.operators.distributions import interp
    from inplay.operators.features import N_QUANTILES

    a = F.least(actual, clock)
    levels = F.transform(F.sequence(F.lit(0), F.lit(N_QUANTILES - 1)), lambda i: i / (N_QUANTILES - 1))
    mass = F.transform(F.sequence(F.lit(0), F.lit(N_BINS - 1)), lambda b: F.aggregate(
        F.sequence(F.lit(0), F.lit(len(TIMED) - 1)), F.lit(0.0), lambda s, r: s + F.get(p, r * N_BINS + b)))
    share = F.zip_with(mass, quantiles, lambda m, q: m * F.when(a < F.get(q, F.lit(0)), 0.0).otherwise(interp(a, q, levels)))
    below = F.aggregate(share, F.lit(0.0), lambda s, v: s + v)
    mids = lambda q: F.zip_with(F.slice(q, 1, N_QUANTILES - 1), F.slice(q, 2, N_QUANTILES - 1), lambda x, y: F.least((x + y) / 2, clock))
    avg = lambda q: F.aggregate(mids(q), F.lit(0.0), lambda s, v: s + v) / (N_QUANTILES - 1)
    mean = F.aggregate(F.zip_with(mass, quantiles, lambda m, q: m * avg(q)), F.lit(0.0), lambda s, v: s + v) + F.get(p, F.lit(END_HALF)) * clock
    return F.when(a >= clock - 1e-6, below + 0.5 * (1 - below)).otherwise(below), mean


def score_events(model, events: DataFrame, rows: DataFrame, kind: str = "wp_spread") -> DataFrame:
    """The direct model's home price at the events a scrimmage snap follows in regulation, null elsewhere.
    `rows` supplies each game's first possession, which the kickoff feature needs."""
    from inplay.operators.features import FEATURE_INPUTS, LABEL_INPUTS, wp_features

    ok = (F.col("kind").isin("play", "snap") & (F.col("phase") == "snap") & F.col("down").isNotNull() & F.col("posteam").isNotNull() & (F.col("qtr") <= 4))
    base = 1 << 40  # past every sequence number, so a game's own first row stays first
    cols = [*FEATURE_INPUTS, *LABEL_INPUTS]
    first = rows.filter(F.col("posteam").isNotNull()).groupBy("game_id").agg(F.min_by(F.struct(*[c for c in cols if c != "game_id"]), "seq").alias("r")).select("game_id", "r.*")
    fixed = first.select("game_id", "season", "home_team", "away_team", "pregame_spread", "final_margin_home")
    pseudo = events.filter(ok).withColumns({"seq": F.col("order") + base, "home_score_pre": F.col("home_score"), "away_score_pre": F.col("away_score")}).drop(
        "season", "home_team", "away_team", "pregame_spread", "final_margin_home").join(fixed, "game_id")
    f = wp_features(first.select(*cols).unionByName(pseudo.select(*cols))).filter(F.col("seq") >= base)
    p = predict(model, f, kind)
    home = F.when(F.col("posteam") == F.col("home_team"), F.col("wp")).otherwise(1 - F.col("wp"))
    scored = p.select("game_id", (F.col("seq") - base).alias("order"), home.alias("wp_direct_home"))
    return events.drop("wp_direct_home").join(scored, ["game_id", "order"], "left")
