"""Sliced scans equal plain scans, whatever the slice size and wherever the nulls are."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from inplay.operators import scan as sc, sequence as sq
from inplay.operators.asof import asof_join


def frame(spark, seed, n=120):
    rng = random.Random(seed)
    # one entity holds most of the rows
    return spark.createDataFrame(
        [(1 if rng.random() < 0.8 else rng.randint(2, 4), i, rng.choice([None, rng.randint(0, 50)])) for i in range(n)],
        "g long, i long, x long")


def specs():
    return dict(mx=sc.running_max("x"), mb=sc.running_max("x", inclusive=False), sm=sc.running_sum("x"), sb=sc.running_sum("x", inclusive=False),
                rn=sc.row_number(), ff=sc.ffill("x"), fb=sc.ffill("x", inclusive=False), bf=sc.bfill("x"), bb=sc.bfill("x", inclusive=False),
                lg=sc.lag("x"), ld=sc.lead("x"))


@pytest.mark.parametrize("rows", [1, 3, 7, 40])
def test_sliced_scan_equals_plain_scan(spark, rows):
    df = frame(spark, rows)
    hot = sc.hot_entities(df, ["g"], "i", rows)
    assert hot is not None
    plain = sorted(map(tuple, sc.scan(df, ["g"], ["i"], **specs()).collect()), key=str)
    cut = sorted(map(tuple, sc.scan(df, ["g"], ["i"], hot=hot, **specs()).collect()), key=str)
    assert plain == cut


@pytest.mark.parametrize("shape", ["bunched", "tiny", "outlier", "even"])
def test_slices_hold_like_numbers_of_rows(spark, shape):
    rng = random.Random(shape)
    key = {"bunched": lambda i: 1e6 + i / 7 if i % 10 else rng.uniform(0, 1e9), "tiny": lambda i: 5 + i * 1e-7, "outlier": lambda i: float(i) if i else 1e15, "even": float}[shape]
    df = spark.createDataFrame([("hot", key(i)) for i in range(3000)] + [("cold", 1.0), ("cold", 7.0)], "g string, x double")
    hot = sc.hot_entities(df, ["g"], "x", 100)
    rows = sc.with_slices(df, ["g"], "x", hot).collect()
    assert {r.g for r in rows if r[sc.SLICE] is None} == {"cold"}
    cut = sorted((r.x, r[sc.SLICE]) for r in rows if r.g == "hot")
    numbers = [n for _, n in cut]
    assert numbers == sorted(numbers) and 15 <= len(set(numbers)) <= 31
    assert max(numbers.count(n) for n in set(numbers)) <= 200


@pytest.mark.parametrize("rows", [2, 6])
def test_sliced_neighbours_equal_plain(spark, rows):
    df = frame(spark, 9)
    hot = sc.hot_entities(df, ["g"], "i", rows)
    a = sorted(map(str, sc.neighbours(df, ["g"], ["i"], "x", 4).collect()))
    b = sorted(map(str, sc.neighbours(df, ["g"], ["i"], "x", 4, hot=hot).collect()))
    assert a == b


def test_evenly_spread_tables_keep_the_plain_window(spark):
    df = frame(spark, 1)
    assert sc.hot_entities(df, ["g"], "i", 1000) is None
    plan = sc.scan(df, ["g"], ["i"], mx=sc.running_max("x"))._jdf.queryExecution().toString()
    assert "Join" not in plan


def repaired(rows):
    """The repair rules, row by row."""
    first = next((r["snap"] for r in rows if r["snap"] is not None), None)
    s, e, out = None, first, []
    for r in rows:
        if first is None:
            out.append((None, None))
            continue
        a = r["snap"] if r["snap"] is not None else e
        s = a if s is None else max(a, s)
        b = s + r["duration"] if r["bad"] else r["end"]
        e = max(b, s, e)
        out.append((s, e))
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 60)), st.integers(0, 9), st.booleans()), min_size=8, max_size=40), st.integers(1, 6))
def test_repair_equals_the_rules_however_it_is_sliced(spark, rows, per_slice):
    data = [dict(g=1, i=i, snap=None if s is None else float(s), duration=float(d), bad=b or s is None, end=None if s is None else float(s + d))
            for i, (s, d, b) in enumerate(rows)]
    df = spark.createDataFrame(data, "g long, i long, snap double, duration double, bad boolean, end double")
    df = sc.scan(df, ["g"], ["i"], next_valid=sc.bfill("snap"))
    hot = sc.hot_entities(df, ["g"], "i", per_slice)
    got = sq.repair_times(df, ["g"], "i", hot).orderBy("i").select("t_snap", "t_end").collect()
    assert [tuple(r) for r in got] == repaired(data)


def test_asof_directions_ties_and_tolerance(spark):
    left = spark.createDataFrame([("G", t) for t in (0, 5, 10, 30)], "g string, t long")
    right = spark.createDataFrame([("G", 5, "a", 1), ("G", 5, "b", 2), ("G", 20, "c", 3), ("H", 1, "z", 4)], "g string, k long, v string, o long")

    def values(**kw):
        return [r.v for r in asof_join(left, right, ["g"], "t", "k", tie="o", columns=["v"], **kw).orderBy("t").collect()]

    assert values() == [None, "b", "b", "c"]
    assert values(exact=False) == [None, None, "b", "c"]
    assert values(direction="forward") == ["a", "a", "c", None]
    assert values(direction="forward", exact=False) == ["a", "c", "c", None]
    assert values(tolerance=4) == [None, "b", None, None]


def test_asof_has_no_nested_loop(spark):
    left = spark.range(10).select(F.col("id").alias("g"), F.col("id").alias("t"))
    plan = asof_join(left, left.select("g", F.col("t").alias("k"), F.lit(1).alias("v")), ["g"], "t", "k")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_asof_names_clashing_columns(spark):
    left = spark.createDataFrame([("a", 5, "l")], "g string, t int, kind string")
    right = spark.createDataFrame([("a", 3, "r")], "g string, k int, kind string")
    with pytest.raises(ValueError, match="kind"):
        asof_join(left, right, ["g"], "t", "k")
    r = asof_join(left, right, ["g"], "t", "k", suffix="_right").collect()[0]
    assert (r.kind, r.kind_right, r.k) == ("l", "r", 3)
