"""Resampling as a blocked product against plain loops."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inplay.functions.hashing import PRIME, poisson_weights, uniform
from inplay.operators import bootstrap as bs


def test_weights_are_the_columns_uniforms(spark):
    df = spark.range(0, 40).select((F.col("id") * 77_777_777).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("rep"))
    rows = df.select("k", "rep", uniform(5, F.col("k"), F.col("rep")).alias("u")).collect()
    keys = np.array(sorted({r.k % PRIME for r in rows}))
    w = poisson_weights(5, keys, 7)
    at = {k: i for i, k in enumerate(keys)}
    edges = [sum(math.exp(-1) / math.factorial(i) for i in range(j + 1)) for j in range(10)]
    assert all(w[at[r.k % PRIME], r.rep] == sum(r.u >= e for e in edges) for r in rows)
    assert abs(poisson_weights(1, np.arange(3000), 50).mean() - 1) < 0.02


@pytest.mark.parametrize("kind", ["long", "string"])
def test_product_equals_row_by_row_sums(spark, kind):
    rng = np.random.default_rng(8)
    rows = [(g, -5 + 3 * k, float(x), int(10 * x), None if k % 4 == 0 else float(y)) for g in ("a", None, "b") for k, (x, y) in enumerate(rng.normal(0, 1, (30, 2)))]
    rows += [("lone", 2, 1.5, 7, None), ("a", None, 99.0, 99, 99.0)]
    df = spark.createDataFrame([(g, k if kind == "long" or k is None else f"game {k}", *v) for g, k, *v in rows], f"g string, game {kind}, x double, n long, y double").repartition(5)
    w = {(r.game, r.rep): r.w for r in bs.weights(df.filter("game is not null"), "game", 60).collect()}
    want = defaultdict(lambda: [0.0, 0, None])
    for r in df.filter("game is not null").collect():
        for rep in range(60):
            k = w.get((r.game, rep), 0)
            if k:
                t = want[r.g, rep]
                t[0] += k * r.x
                t[1] += k * r.n
                t[2] = t[2] if r.y is None else (t[2] or 0.0) + k * r.y
    out = bs.resample(df, "game", ["x", "n", "y"], 60, ["g"])
    assert [f.dataType.simpleString() for f in out.schema] == ["string", "int", "double", "bigint", "double"]
    got = {(r.g, r.rep): r for r in out.collect()}
    assert set(got) == set(want) and 0 < sum(k[0] == "lone" for k in got) < 60
    for k, (x, n, y) in want.items():
        assert got[k].x == pytest.approx(x) and got[k].n == n and (got[k].y is None if y is None else got[k].y == pytest.approx(y))


def test_more_groups_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(bs, "GROUPS_HELD", 3)
    df = spark.range(400).select((F.col("id") % 40).alias("g"), (F.col("id") % 50).alias("game"), F.lit(1.0).alias("x"))
    got = Counter({(r.g, r.rep): r.x for r in bs.resample(df, "game", ["x"], 9, ["g"]).collect()})
    w = {(r.game, r.rep): r.w for r in bs.weights(df, "game", 9).collect()}
    want = Counter()
    for i in range(400):
        for rep in range(9):
            want[i % 40, rep] += w.get((i % 50, rep), 0)
    assert got == +want
    assert bs.resample(df.limit(0), "game", ["x"], 9, ["g"]).count() == 0


def test_infinite_sums_count_only_where_drawn(spark):
    df = spark.createDataFrame([(k, math.inf if k == 3 else 1.0) for k in range(6)], "game long, x double")
    w = {(r.game, r.rep): r.w for r in bs.weights(df, "game", 40).collect()}
    got = {r.rep: r.x for r in bs.resample(df, "game", ["x"], 40).collect()}
    assert all(math.isinf(x) == ((3, rep) in w) for rep, x in got.items()) and len({math.isinf(x) for x in got.values()}) == 2


def test_exact_draws_are_made_by_all_cores(spark):
    """Few entities are few bytes, which adaptive execution would leave to one task with all their draws."""
    stats = spark.range(300).select(F.col("id").alias("game_id"), F.lit(1.0).alias("n"))
    picks = bs._picks(bs._numbered(stats, "game_id", []), [], 10, 1)
    assert picks.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert picks.count() == 3000


def test_exact_draws_sum_their_entities(spark, monkeypatch):
    """Draws and entities meet by block, here of two entities; a missing id counts last, as in the SQL twin."""
    monkeypatch.setattr(bs, "MET", 5)
    monkeypatch.setattr(bs, "BLOCK", 7)
    ids = [*range(-3, 20, 2), 70, 64, 128, None]
    rows = [(g, k, float(i), i - 4 if i % 3 else None, 2**55 + i) for g, n in (("a", 3), (None, 16), ("b", 16)) for i, k in enumerate(ids[-n:])]
    df = spark.createDataFrame(rows, "g string, game long, x double, n long, big long").repartition(3)
    got = {(r.g, r.rep): r for r in bs.resample(df, "game", ["x", "n", "big"], 10, ["g"], method="multinomial").collect()}
    assert len(got) == 30
    for g in ("a", None, "b"):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, math.fmod(r[1] or 0, 64), r[1] or 0))
        u = spark.range(1, len(order) + 1).select(F.array(*[uniform(bs.SEED, F.col("id"), F.lit(rep)) for rep in range(10)])).collect()
        for rep in range(10):
            drawn = [order[int(r[0][rep] * len(order))] for r in u]
            n = [r[3] for r in drawn if r[3] is not None]
            assert (got[g, rep].x, got[g, rep].n, got[g, rep].big) == (sum(r[2] for r in drawn), sum(n) if n else None, sum(r[4] for r in drawn))
    assert bs.resample(df.limit(0), "game", ["x"], 9, method="multinomial").count() == 0


def test_exact_draws_broadcast_no_entities(spark):
    stats = spark.range(300).select(F.col("id").alias("game_id"), F.lit(1.0).alias("n"))
    reps = bs.resample(stats, "game_id", ["n"], 10, method="multinomial")
    assert [r.n for r in reps.collect()] == [300.0] * 10
    assert "Broadcast" not in reps._jdf.queryExecution().executedPlan().toString()
