"""Boosted trees: constraints, missing values, and the same trees wherever their histograms are added up."""

import time

import numpy as np
import pyarrow as pa
import pytest

from inplay.operators import boosting, models as md

NAMES = ["a", "b", "c"]


def sample(spark, n=1200):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (n, 3))
    chance = 1 / (1 + np.exp(-(3 * x[:, 0] - 2 * x[:, 1] + np.sin(9 * x[:, 2]))))
    y = (rng.random(n) < chance).astype(int)
    rows = [(*[float(v) for v in r], int(k)) for r, k in zip(x, y)] + [(None, 0.1, float("nan"), 1), (0.1, 0.2, 0.3, None)]
    return spark.createDataFrame(rows, "a double, b double, c double, label int"), x, chance


def test_signs_hold_on_a_grid(spark):
    df, x, chance = sample(spark)
    s = boosting.Settings(rounds=60, step=0.2, depth=4, row_share=0.8, column_share=0.7, split_penalty=0.1, leaf_weight=2, signs=(1, -1, 0))
    trees = boosting.fit(df, NAMES, "label", s)
    steps, rest = np.linspace(-1.1, 1.1, 90), np.random.default_rng(1).uniform(-1, 1, (40, 3))
    for f, sign in ((0, 1), (1, -1)):
        for r in rest:
            line = np.repeat(r[None], 90, 0)
            line[:, f] = steps
            assert (sign * np.diff(trees.probabilities(line)) >= -1e-12).all()
    p = trees.probabilities(x)
    assert np.abs(p - chance).mean() < 0.1 and np.corrcoef(p, chance)[0, 1] > 0.93
    free = boosting.fit(df, NAMES, "label", boosting.Settings(rounds=60, step=0.2, depth=4))
    line = np.repeat(rest[:1], 90, 0)
    line[:, 0] = steps
    assert (np.diff(free.probabilities(line)) < -1e-6).any()


def test_missing_values_and_single_labels(spark):
    df, _, _ = sample(spark)
    trees = boosting.fit(df, NAMES, "label", boosting.Settings(rounds=5, step=0.3, depth=3))
    scored = df.withColumn("p", boosting.predict(trees, [df[n] for n in NAMES])).collect()
    assert all(0 < r.p < 1 for r in scored)
    low = trees.probabilities(np.array([[np.nan, 0.5, 0.5], [-9.0, 0.5, 0.5]]))
    assert low[0] == low[1]  # a missing value goes with the least
    ones = boosting.fit(df.filter("label = 1"), NAMES, "label", boosting.Settings(rounds=3, step=0.3, depth=2))
    assert (ones.probabilities(np.zeros((1, 3))) > 0.99).all()
    assert boosting.fit(df.limit(0), NAMES, "label", boosting.Settings(rounds=2, step=0.3, depth=2)).probabilities(np.zeros((1, 3)))[0] == pytest.approx(0.5)


def test_tasks_of_a_barrier_stage_grow_the_drivers_trees(spark):
    df, x, _ = sample(spark, 300)
    s = boosting.Settings(rounds=3, step=0.3, depth=2, row_share=0.7, column_share=0.7, signs=(1, 0, 0))
    alone, together = boosting.fit(df, NAMES, "label", s), boosting.fit(df, NAMES, "label", s, held=10, workers=3)
    assert (alone.feature == together.feature).all() and alone.probabilities(x) == pytest.approx(together.probabilities(x))


def test_best_split_by_hand():
    g, h = np.zeros((2, boosting.BINS)), np.zeros((2, boosting.BINS))
    g[0, :2], h[0, :2] = [-3.0, 5.0], [2.0, 4.0]
    g[1, :2], h[1, :2] = [1.0, 1.0], [3.0, 3.0]
    s = boosting.Settings(rounds=1, step=1, depth=1)
    gain, f, b, left, right = boosting.best_split(g, h, -np.inf, np.inf, s, np.zeros(2))
    assert (f, b, left, right) == (0, 0, 1.0, -1.0) and gain == pytest.approx((9 / 3 + 25 / 5 - 4 / 7) / 2)
    assert boosting.best_split(g, h, -np.inf, np.inf, s, np.array([1, 1]))[0] <= 0  # would fall where it must rise
    assert boosting.best_split(g, h, -0.2, 0.2, s, np.zeros(2))[3:] == (0.2, -0.2)


def test_published_settings():
    spread, plain = md.MODELS["wp_spread"]["trees"], md.MODELS["wp"]["trees"]
    assert (plain.rounds, spread.rounds, spread.depth, len(spread.signs)) == (65, 534, 5, len(md.WP_SPREAD_FEATURES))
    assert {n: s for n, s in zip(md.WP_SPREAD_FEATURES, spread.signs) if s} == {
        "Diff_Time_Ratio": 1, "score_differential": 1, "down": -1, "ydstogo": -1, "yardline_100": -1, "posteam_timeouts_remaining": 1, "defteam_timeouts_remaining": -1}


def test_spread_rows_take_no_barrier_exchanges(spark):
    """A barrier exchange takes a second, whatever its size: sixty levels would take a minute."""
    df, x, _ = sample(spark, 300)
    s = boosting.Settings(rounds=20, step=0.3, depth=3, row_share=0.7)
    boosting.fit(df, NAMES, "label", s, held=10, workers=3)  # workers start
    began = time.perf_counter()
    together = boosting.fit(df, NAMES, "label", s, held=10, workers=3)
    assert time.perf_counter() - began < 40
    assert boosting.fit(df, NAMES, "label", s).probabilities(x) == pytest.approx(together.probabilities(x))


@pytest.mark.parametrize("share", [1.0, 0.4])  # histograms of single columns and of pairs
def test_scores_are_those_the_fit_ends_with(share):
    """A threshold is the edge below its bin, and a cut after the missing values' bin sends all others to the right."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (4000, 6))
    x[:300, 0] = np.nan
    y = (np.nan_to_num(x[:, 0], nan=3.0) + x[:, 1] > 0).astype(float)
    edges = [np.unique(np.nanquantile(c, np.arange(1, 63) / 63)) for c in x.T]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, x.T), pa.array(y), pa.array(rng.integers(0, 2**60, len(x)))], names=[*"abcdef", "y", "key"])
    rows = boosting.Rows(*boosting._rows_of([batch], edges), 0.1)
    s = boosting.Settings(rounds=6, step=0.3, depth=3, column_share=share)
    trees = list(boosting._boost(rows, np.array([len(e) + 2 for e in edges]), s))
    model = boosting.thresholds(0.1, 3, trees, edges)
    assert model.probabilities(x) == pytest.approx(1 / (1 + np.exp(-rows.odds)))
    assert (np.array([t[1] for t in trees]) == 0).any()


def test_pairs_of_columns_give_both_sides_of_a_cut():
    rng = np.random.default_rng(2)
    sizes, columns = [3, 64, 5, 64, 12], np.arange(5)
    binned = np.stack([rng.integers(0, n, 3000) for n in sizes], 1).astype(np.uint8)
    g, h, node = rng.normal(size=3000), rng.random(3000), rng.integers(0, 2, 3000).astype(np.uint8)
    sets = boosting.together(sizes, 2)
    assert all(any({a, b} <= set(one) for one in sets) for a in range(5) for b in range(a)) and len(sets) < 10
    hist = boosting.Histograms(boosting.level_sums(binned, node, g, h, columns, sizes, sets, 1), sizes, sets, 1)
    for side, rows in ((None, node == 1), ((3, slice(0, 31)), (node == 1) & (binned[:, 3] <= 30)), ((0, slice(2, None)), (node == 1) & (binned[:, 0] > 1))):
        for c in range(5):
            for got, v in zip(hist.columns(1, side), (g, h)):
                assert got[c] == pytest.approx(np.bincount(binned[rows, c], v[rows], boosting.BINS))


def test_rows_are_held_in_pieces(spark, monkeypatch):
    df, x, _ = sample(spark, 500)
    monkeypatch.setattr(boosting, "PIECE", 60)
    s = boosting.Settings(rounds=4, step=0.3, depth=3, row_share=0.7)
    assert boosting.fit(df, NAMES, "label", s, held=10, workers=2).probabilities(x) == pytest.approx(boosting.fit(df, NAMES, "label", s).probabilities(x))
