"""Distributions on an integer grid, their scores, and contract prices read from them."""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

# fixed values
MARGIN_GRID = (-60, 60)
TOTAL_GRID = (0, 120)
EVAL_MARGIN_GRID = (-100, 100)
EVAL_TOTAL_GRID = (0, 160)


# ------------------------------------------------------------------ small array helpers


def search_right(edges: Sequence[float], x: Column) -> Column:
    """How many edges are at or below x."""
    out = F.lit(0)
    for e in edges:
        out = out + (F.lit(e) <= x).cast("int")
    return out


def search_left(edges: Sequence[float], x: Column) -> Column:
    """How many edges are below x."""
    out = F.lit(0)
    for e in edges:
        out = out + (F.lit(e) < x).cast("int")
    return out


def one_hot(i: Column, n: int) -> Column:
    return F.array(*[(i == j).cast("double") for j in range(n)])


def interp(x: Column, xs: Column, ys: Column) -> Column:
    """Linear interpolation of sorted arrays, flat outside."""
    i = F.size(F.filter(xs, lambda v: v <= x))
    lo, hi = F.greatest(i, F.lit(1)), F.least(F.greatest(i, F.lit(1)) + 1, F.size(xs))
    x0, x1, y0, y1 = F.element_at(xs, lo), F.element_at(xs, hi), F.element_at(ys, lo), F.element_at(ys, hi)
    return F.when((i == 0) | (x1 <= x0), y0).otherwise(y0 + (x - x0) / (x1 - x0) * (y1 - y0))


# ------------------------------------------------------------------ CDFs


def histogram(df: DataFrame, by: Sequence[str], value: Column, out: str) -> DataFrame:
    """Sorted (v, c) counts per group: samples reduce on the map side to their distinct values."""
    counts = df.groupBy(*by, value.cast("int").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias(out))


def hist_total(hist: Column) -> Column:
    return F.aggregate(hist, F.lit(0).cast("bigint"), lambda a, e: a + e["c"])


def hist_share(hist: Column, keep) -> Column:
    """Share of samples whose value satisfies keep(v)."""
    hit = F.aggregate(hist, F.lit(0).cast("bigint"), lambda a, e: a + F.when(keep(e["v"]), e["c"]).otherwise(0))
    return hit / hist_total(hist)


def hist_mean(hist: Column) -> Column:
    return F.aggregate(hist, F.lit(0.0), lambda a, e: a + e["v"] * e["c"]) / hist_total(hist)


@F.pandas_udf(ArrayType(DoubleType()))
def _step_cdf(values: pd.Series, counts: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
    out = []
    for v, c, a, b in zip(values, counts, lo, hi):
        upto = np.concatenate([[0], np.cumsum(c)])
        out.append(upto[np.searchsorted(v, np.arange(a, b + 1), side="right")] / upto[-1])
    return pd.Series(out)


def cdf_from_hist(hist: Column, grid: tuple[int, int]) -> Column:
    """F(z) = share of samples <= z for every z of the grid, as an array."""
    return _step_cdf(hist["v"], hist["c"], F.lit(grid[0]), F.lit(grid[1]))


@F.pandas_udf(DoubleType())
def norm_cdf(x: pd.Series) -> pd.Series:
    """Standard normal CDF."""
    return pd.Series([0.5 * math.erfc(-v * math.sqrt(0.5)) for v in x], dtype="float64")


@F.pandas_udf(ArrayType(DoubleType()))
def _normal_grid(mu: pd.Series, sigma: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
    out = []
    for m, s, a, b in zip(mu, sigma, lo, hi):
        k = math.sqrt(0.5) / max(s, 1e-6)
        out.append([0.5 * math.erfc((m - z - 0.5) * k) for z in range(a, b + 1)])
    return pd.Series(out)


def cdf_normal(mu: Column, sigma: Column, grid: tuple[int, int]) -> Column:
    """A normal forecast rounded to integers, on the grid."""
    return _normal_grid(mu, sigma, F.lit(grid[0]), F.lit(grid[1]))


def crps(cdf: Column, grid: tuple[int, int], y: Column) -> Column:
    sq = F.transform(cdf, lambda f, i: F.pow(f - ((i + grid[0]) >= y).cast("double"), F.lit(2)))
    return F.aggregate(sq, F.lit(0.0), lambda a, v: a + v)


def pit(cdf: Column, grid: tuple[int, int], y: Column, v: Column) -> Column:
    """Randomized probability integral transform; outcomes off the grid count at its ends."""
    i = F.least(F.greatest(y - grid[0], F.lit(0)), F.lit(grid[1] - grid[0])).cast("int")
    below = F.when(i > 0, F.get(cdf, i - 1)).otherwise(0.0)
    return below + v * (F.get(cdf, i) - below)


def covered(p: Column, level: float) -> Column:
    lo = (1 - level) / 2
    return ((p > lo) & (p < 1 - lo)).cast("double")


# ------------------------------------------------------------------ pricing


def at(cdf: Column, grid: tuple[int, int], z: Column) -> Column:
    """F(z), 0 below and 1 above the grid."""
    return F.when(z < grid[0], 0.0).when(z > grid[1], 1.0).otherwise(F.get(cdf, (z - grid[0]).cast("int")).cast("double"))


def contract_price(kind: Column, side: Column, strike: Column, p_home: Column, cdf_margin: Column, cdf_total: Column) -> Column:
    """Fair YES price. Strikes are half points: the home side covers k.5 with 1 - F(k), the away side
    with F(-k - 1), and a total goes over with 1 - F(k)."""
    k = F.floor(strike)
    return (F.when(kind == "winner", F.when(side == "home", p_home).otherwise(1 - p_home))
            .when(kind == "spread", F.when(side == "home", 1 - at(cdf_margin, MARGIN_GRID, k)).otherwise(at(cdf_margin, MARGIN_GRID, -k - 1)))
            .when(kind == "total", 1 - at(cdf_total, TOTAL_GRID, k)))


def quotes_from_samples(samples: DataFrame, by: Sequence[str], home: str = "home", away: str = "away") -> DataFrame:
    """p_home (ties half), p_tie, means and both CDFs per state, from final-score samples."""
    m = histogram(samples, by, F.col(home) - F.col(away), "hm")
    t = histogram(samples, by, F.col(home) + F.col(away), "ht")
    hm, ht = F.col("hm"), F.col("ht")
    tie = hist_share(hm, lambda v: v == 0)
    return m.join(t, list(by)).select(
        *by, (hist_share(hm, lambda v: v > 0) + 0.5 * tie).alias("p_home"), tie.alias("p_tie"), hist_mean(hm).alias("margin_mean"),
        hist_mean(ht).alias("total_mean"), cdf_from_hist(hm, MARGIN_GRID).cast("array<float>").alias("cdf_margin"),
        cdf_from_hist(ht, TOTAL_GRID).cast("array<float>").alias("cdf_total"), hist_total(hm).alias("n"), "hm", "ht")


def price_ladder(samples: DataFrame, contracts: DataFrame, by: Sequence[str], home: str = "home", away: str = "away") -> DataFrame:
    """Contracts priced straight from samples: counts per final margin and total first, then each
    contract reads the counts of its state, so samples and strikes are never multiplied."""
    m = histogram(samples, by, F.col(home) - F.col(away), "hm")
    t = histogram(samples, by, F.col(home) + F.col(away), "ht")
    hm, k = F.col("hm"), F.col("strike")
    win = lambda sign: hist_share(hm, lambda v: sign * v > 0) + 0.5 * hist_share(hm, lambda v: v == 0)
    price = (F.when(F.col("kind") == "winner", F.when(F.col("side") == "away", win(-1)).otherwise(win(1)))
             .when(F.col("kind") == "spread", F.when(F.col("side") == "away", hist_share(hm, lambda v: -v > k)).otherwise(
                 hist_share(hm, lambda v: v > k)))
             .when(F.col("kind") == "total", hist_share(F.col("ht"), lambda v: v > k)))
    return contracts.join(m.join(t, list(by)), list(by)).withColumn("price", price).drop("hm", "ht")


@F.pandas_udf(ArrayType(DoubleType()))
def pav_decreasing(values: pd.Series) -> pd.Series:
    """Non-increasing least-squares fit of each (short) ladder by pooling adjacent violators."""

    def fit(p):
        blocks: list[list[float]] = []
        for v in p:
            blocks.append([float(v), 1])
            while len(blocks) > 1 and blocks[-2][0] < blocks[-1][0]:
                v2, n2 = blocks.pop()
                v1, n1 = blocks.pop()
                blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2])
        return [v for v, n in blocks for _ in range(int(n))]

    return values.map(lambda p: None if p is None else fit(p))


def crossing(strikes: Column, p: Column) -> Column:
    """Strike at which a falling ladder crosses 50%, interpolated; null unless two rungs straddle it."""
    i = F.size(F.filter(p, lambda v: v >= 0.5))
    lo, hi = F.get(p, i - 1), F.get(p, i)
    k0, k1 = F.get(strikes, i - 1), F.get(strikes, i)
    return F.when((i == 0) | (i == F.size(p)), None).otherwise(F.when(lo > hi, k0 + (lo - 0.5) / (lo - hi) * (k1 - k0)).otherwise(k0))


def ladder_median(strikes: Column, p_over: Column) -> Column:
    """The 50% strike of a quoted ladder (arrays sorted by strike), made monotone first."""
    return crossing(strikes, pav_decreasing(p_over))


def median_total(hist: Column) -> Column:
    """The total with a 50% chance of being exceeded, on the half-point ladder of a score histogram
    (already monotone)."""
    lo, hi = EVAL_TOTAL_GRID
    p = F.transform(cdf_from_hist(hist, (lo, hi)), lambda f: 1 - f)
    strikes = F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda z: z + 0.5)
    return crossing(strikes, p)


# ------------------------------------------------------------------ exact quantiles at scale


def exact_quantile(df: DataFrame, by: Sequence[str], value: str, q: float, out: str) -> DataFrame:
    """Linearly interpolated quantile per group from value counts and a running sum over the distinct
    values; a group with very many distinct values is summed slice by slice."""
    from inplay.operators.scan import hot_entities, running_sum, scan

    by = list(by) or ["__all"]
    base = df if by != ["__all"] else df.withColumn("__all", F.lit(0))
    counts = base.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    run = scan(counts, by, ["__v"], hot=hot_entities(counts, by, "__v"), __cum=running_sum("__c"))
    n = counts.groupBy(*by).agg(F.sum("__c").alias("__n"))
    pos = F.lit(q) * (F.col("__n") - 1)
    j = run.join(n, by).filter(F.col("__cum") > F.floor(pos))
    lo = F.min_by("__v", "__cum")
    hi = F.min(F.when(F.col("__cum") > F.ceil(pos), F.col("__v")))
    frac = F.min(pos - F.floor(pos))
    got = j.groupBy(*by).agg((lo + frac * (hi - lo)).alias(out))
    return got.drop("__all")


# ------------------------------------------------------------------ scoring states


def forecast_record(states: DataFrame, samples: DataFrame, by: str, sd_margin: Column, sd_total: Column, v1: Column, v2: Column) -> DataFrame:
    """Per state: win, tie, cover and over probabilities, CRPS and PIT of the sampled distribution and of a
    normal baseline whose spread shrinks with the share of the game left.

    states: current margin and total, spread and total lines, share_left, final y_margin and y_total
    """
    hm = histogram(samples, [by], F.col("home") - F.col("away"), "hm")
    ht = histogram(samples, [by], F.col("home") + F.col("away"), "ht")
    mg, tg = EVAL_MARGIN_GRID, EVAL_TOTAL_GRID
    spread, line, f = F.coalesce("spread", F.lit(0.0)), F.coalesce("line", F.lit(44.0)), F.col("share_left")
    root = F.sqrt(F.greatest(f, F.lit(1e-4)))
    j = states.join(hm, by).join(ht, by).withColumns({"cm": cdf_from_hist(F.col("hm"), mg), "ct": cdf_from_hist(F.col("ht"), tg)})
    j = j.withColumns({"bm": cdf_normal(F.col("margin") + spread * f, sd_margin * root, mg),
                       "bt": cdf_normal(F.col("total") + line * f, sd_total * root, tg)})
    ym, yt = F.col("y_margin"), F.col("y_total")
    tie = hist_share(F.col("hm"), lambda v: v == 0)
    return j.withColumns({
        "wp": hist_share(F.col("hm"), lambda v: v > 0) + 0.5 * tie, "p_tie": tie,
        "margin_mean": hist_mean(F.col("hm")), "total_mean": hist_mean(F.col("ht")),
        "p_home_cover": hist_share(F.col("hm"), lambda v: v > spread), "p_over": hist_share(F.col("ht"), lambda v: v > line),
        "crps_margin": crps(F.col("cm"), mg, ym), "crps_total": crps(F.col("ct"), tg, yt),
        "pit_margin": pit(F.col("cm"), mg, ym, v1), "pit_total": pit(F.col("ct"), tg, yt, v2),
        "crps_margin_base": crps(F.col("bm"), mg, ym), "crps_total_base": crps(F.col("bt"), tg, yt),
        "pit_margin_base": pit(F.col("bm"), mg, ym, v1), "pit_total_base": pit(F.col("bt"), tg, yt, v2)}).drop(
        "cm", "ct", "bm", "bt", "hm", "ht")


# fixed values: tolerances of the calibration gate
GATE_COVERAGE_TOL, GATE_WP_MAE, GATE_WP_LOGLOSS = 0.03, 0.03, 0.01


def gate_verdict(records: DataFrame, direct: Column, y_home: Column) -> DataFrame:
    """One row: interval coverage, CRPS against the baseline, agreement with the direct model, and whether
    each part and the whole pass."""
    from inplay.operators.metrics import log_loss_row

    aggs = []
    for what in ("margin", "total"):
        for tag in ("", "_base"):
            aggs += [F.avg(covered(F.col(f"pit_{what}{tag}"), 0.5)).alias(f"{what}{tag}_cov50"),
                     F.avg(covered(F.col(f"pit_{what}{tag}"), 0.9)).alias(f"{what}{tag}_cov90"),
                     F.avg(f"crps_{what}{tag}").alias(f"{what}{tag}_crps")]
    ok = direct.isNotNull() & y_home.isNotNull()
    aggs += [F.count(F.lit(1)).alias("states"), F.avg(F.when(ok, F.abs(F.col("wp") - direct))).alias("wp_mae"),
             F.avg(F.when(ok, log_loss_row(F.col("wp"), y_home))).alias("ll_sim"), F.avg(F.when(ok, log_loss_row(direct, y_home))).alias("ll_direct")]
    r = records.agg(*aggs)
    cov = F.lit(True)
    for what in ("margin", "total"):
        for lvl in (50, 90):
            cov = cov & (F.abs(F.col(f"{what}_cov{lvl}") - lvl / 100) <= GATE_COVERAGE_TOL)
    better = (F.col("margin_crps") < F.col("margin_base_crps")) & (F.col("total_crps") < F.col("total_base_crps"))
    agree = (F.col("wp_mae") <= GATE_WP_MAE) & (F.col("ll_sim") <= F.col("ll_direct") + GATE_WP_LOGLOSS)
    return r.withColumns({"ok_coverage": cov, "ok_crps": better, "ok_wp": agree}).withColumn(
        "passed", F.col("ok_coverage") & F.col("ok_crps") & F.col("ok_wp"))


def at_least(p: Column, k: Column) -> Column:
    """P(at least k successes) from an array of independent chances (a short list)."""
    start = F.transform(F.sequence(F.lit(0), F.size(p)), lambda i: (i == 0).cast("double"))
    dist = F.aggregate(p, start, lambda d, x: F.transform(d, lambda v, i: v * (1 - x) + F.when(i > 0, F.get(d, i - 1)).otherwise(0.0) * x))
    return F.aggregate(F.transform(dist, lambda v, i: F.when(i >= k, v).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)


def _merged(a: Column, b: Column, k: Column) -> Column:
    """The law of a sum from two laws of counts 0..k-1 and `k or more` (the last cell)."""
    low = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.aggregate(
        F.sequence(F.lit(0), j), F.lit(0.0), lambda t, i: t + F.get(a, i) * F.get(b, j - i)))
    low = F.when(k > 0, low).otherwise(F.array().cast("array<double>"))
    return F.concat(low, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(low, F.lit(0.0), lambda t, v: t + v))))


def tail_by_group(df: DataFrame, by: Sequence[str], p: Column, k: int | Column, out: str, slices: int = 16) -> DataFrame:
    """P(at least k successes) per group, for chances p of independent trials: by, n, k, out. `k` is a number or an
    aggregate of the group (its observed successes, say); null chances are no trials.

    Each group is dealt into `slices` shares; a share's trials fold, one by one, into the law of their count cut off
    at k, of non-negative terms only, and the shares' laws are multiplied together."""
    k = F.lit(k) if isinstance(k, int) else k
    share = F.pmod(F.monotonically_increasing_id(), F.lit(slices)).cast("int")
    parts = df.groupBy(*by, share.alias("__s")).agg(F.collect_list(p.cast("double")).alias("__p"))
    size = df.groupBy(*by).agg(F.count(p).alias("n"), F.greatest(F.lit(0), k).cast("int").alias("k"))
    law = F.aggregate(
        "__p", F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: (i == 0).cast("double")),
        lambda d, x: F.transform(d, lambda v, i: F.when(i < F.col("k"), v * (1 - x)).otherwise(v) + F.when(i > 0, F.get(d, i - 1)).otherwise(0.0) * x))
    keys = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    laws = parts.join(size.withColumnsRenamed({c: f"__{c}" for c in by}), keys).select(*by, "n", "k", law.alias("__law"))
    sure = F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: (i == 0).cast("double"))
    whole = laws.groupBy(*by, "n", "k").agg(F.collect_list("__law").alias("__laws"))  # `slices` laws at most
    whole = whole.withColumn("__law", F.aggregate("__laws", sure, lambda a, b: _merged(a, b, F.col("k"))))
    return whole.select(*by, "n", "k", F.element_at("__law", -1).alias(out))
