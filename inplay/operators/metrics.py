"""Probability scores. Weights mean repetition: a row of weight 2 counts as two equal rows."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BIN = 0.05  # fixed value: calibration bins are multiples of 5 points, rounded half to even
PRICE_CLIP = 0.01  # fixed value: prices are clipped to one tick for log loss


def calibration_table(df: DataFrame, p: str, label: str, qtr: str, groups: Sequence[str] = (),
                      weight: str | None = None) -> DataFrame:
    """Per group, quarter and bin: (weighted) rows, wins, win rate and its distance from the bin."""
    w = F.col(weight) if weight else F.lit(1.0)
    return (
        df.groupBy(*groups, F.col(qtr).cast("bigint").alias("qtr"),
                   F.rint(F.col(p) / BIN).cast("bigint").alias("bin_no"))
        .agg(F.sum(w).alias("n_plays"), F.sum(w * (F.col(label) == 1).cast("double")).alias("n_wins"))
        .filter(F.col("n_plays") > 0)
        .withColumn("bin", F.col("bin_no") * BIN)
        .withColumn("actual", F.col("n_wins") / F.col("n_plays"))
        .withColumn("cal_diff", F.abs(F.col("bin") - F.col("actual")))
    )


def calibration_error(table: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Bins weighted by plays within a quarter, quarters weighted by wins."""
    per_q = table.groupBy(*groups, "qtr").agg(
        (F.sum(F.col("cal_diff") * F.col("n_plays")) / F.sum("n_plays")).alias("err"), F.sum("n_wins").alias("wins"))
    return per_q.groupBy(*groups).agg(F.try_divide(F.sum(F.col("err") * F.col("wins")), F.sum("wins")).alias("calibration_error"))


def log_loss_row(p: Column, y: Column, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def brier_row(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def wrong_row(p: Column, y: Column) -> Column:
    return ((p > 0.5) != (y == 1)).cast("double")


def weighted_mean(c: Column, w: Column | None = None) -> Column:
    return F.avg(c) if w is None else F.sum(w * c) / F.sum(w)


def summary(df: DataFrame, p: str, label: str, qtr: str, groups: Sequence[str] = (),
            weight: str | None = None) -> DataFrame:
    """Calibration error, log loss, Brier, error rate and rows in one row per group. Every score is
    a sum over (quarter, bin) cells, so one aggregation of the rows serves all four."""
    w = F.col(weight) if weight else F.lit(1.0)
    pc, y = F.col(p), F.col(label)
    cells = df.groupBy(*groups, F.col(qtr).cast("bigint").alias("__q"), F.rint(pc / BIN).cast("bigint").alias("__b")).agg(
        F.sum(w).alias("w"), F.sum(w * (y == 1).cast("double")).alias("wins"), F.count(F.lit(1)).alias("n"),
        F.sum(w * log_loss_row(pc, y)).alias("ll"), F.sum(w * brier_row(pc, y)).alias("br"),
        F.sum(w * wrong_row(pc, y)).alias("er"))
    diff = F.when(F.col("w") > 0, F.abs(F.col("__b") * BIN - F.col("wins") / F.col("w")) * F.col("w")).otherwise(0.0)
    per_q = cells.groupBy(*groups, "__q").agg(F.sum(diff).alias("d"), *[F.sum(c).alias(c) for c in
                                                                        ("w", "wins", "n", "ll", "br", "er")])
    err = F.when(F.col("w") > 0, F.col("d") / F.col("w")).otherwise(0.0)
    return per_q.groupBy(*groups).agg(
        F.try_divide(F.sum(err * F.col("wins")), F.sum("wins")).alias("calibration_error"),
        (F.sum("ll") / F.sum("w")).alias("log_loss"), (F.sum("br") / F.sum("w")).alias("brier"),
        (F.sum("er") / F.sum("w")).alias("error_rate"), F.sum("n").alias("n"))
