"""Scans, sinks, reports and streaming edges."""

import pytest
from pyspark.sql import functions as F

from inplay.functions.parsing import parse_seasons
from inplay.sources import tables as tb
from inplay.streaming import live as lv
from tests.conftest import at


def test_seasons_with_drifting_types(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(tb.season_path(root, "pbp", 2000))
    spark.createDataFrame([(1.5, "x")], "a double, c string").write.parquet(tb.season_path(root, "pbp", 2001))
    df = tb.load_seasons(spark, root, "pbp", [2000, 2001])
    assert df.schema.simpleString() == "struct<a:double,b:int,c:string>" and df.count() == 2
    assert tb.load_seasons(spark, root, "pbp", [2000, 2001], ["a"]).columns == ["a"]
    with pytest.raises(FileNotFoundError, match="1999"):
        tb.load_seasons(spark, root, "pbp", [1999, 2000])
    assert parse_seasons("1999-2001,2025") == [1999, 2000, 2001, 2025]


def test_scans_prune_columns_and_push_filters(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select("id", (F.col("id") * 2).alias("x"), F.lit("z").alias("y")).write.parquet(path)
    plan = spark.read.parquet(path).filter("id > 3").select("x")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,3)]" in plan and "ReadSchema: struct<id:bigint,x:bigint>" in plan


def test_price_log_is_idempotent_and_resumable(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("A", 0, 0.5), ("A", 1, 0.6), ("B", 0, 0.4)], "game_id string, order int, p_home double")
    tb.write_price_log(rows, path)
    tb.write_price_log(rows.filter("game_id = 'A'").withColumn("p_home", F.lit(0.9)), path, 2)
    got = {(r.game_id, r.order): r.p_home for r in tb.load_price_log(spark, path, ["p_home"]).collect()}
    assert got == {("A", 0): 0.9, ("A", 1): 0.9, ("B", 0): 0.4}
    left = tb.todo(spark.createDataFrame([("A",), ("C",)], "game_id string"), tb.load_price_log(spark, path))
    assert [r.game_id for r in left.collect()] == ["C"]


def test_price_log_keeps_text_ids_and_order(spark, tmp_path):
    path = str(tmp_path / "log")
    tb.write_price_log(spark.createDataFrame([("012", 1, 0.4), ("007", 2, 0.6), ("007", 1, 0.5)], "game_id string, order int, p_home double"), path)
    assert [(r.game_id, r.order) for r in tb.load_price_log(spark, path).collect()] == [("007", 1), ("007", 2), ("012", 1)]


def test_consolidation_widens_drifting_types(spark, tmp_path):
    spark.createDataFrame([("A", 1)], "game_id string, p int").write.parquet(str(tmp_path / "g" / "A" / "t.parquet"))
    spark.createDataFrame([("B", 1.5, 2)], "game_id string, p double, extra int").write.parquet(str(tmp_path / "g" / "B" / "t.parquet"))
    tb.consolidate(spark, str(tmp_path / "g" / "*" / "t.parquet"), str(tmp_path / "out"))
    assert sorted((r.game_id, r.p, r.extra) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("A", 1.0, None), ("B", 1.5, 2)]
    with pytest.raises(Exception):
        tb.consolidate(spark, str(tmp_path / "none" / "*"), str(tmp_path / "out2"))


def test_derived_tables_by_season_and_consolidation(spark, tmp_path):
    path = str(tmp_path / "ev")
    tb.save_by_season(spark.createDataFrame([(1, 2000), (2, 2001)], "x int, season int"), path)
    tb.save_by_season(spark.createDataFrame([(3, 2001)], "x int, season int"), path)
    assert sorted(r.x for r in tb.load_by_season(spark, path).collect()) == [1, 3]
    assert [r.x for r in tb.load_by_season(spark, path, [2000]).collect()] == [1]
    for g in ("A", "B"):
        spark.createDataFrame([(g, "t1", 1.0)], "game_id string, trade_id string, p double").write.parquet(str(tmp_path / "games" / g / "trades.parquet"))
    tb.consolidate(spark, str(tmp_path / "games" / "*" / "trades.parquet"), str(tmp_path / "trades"), ["trade_id", "absent"])
    out = spark.read.parquet(str(tmp_path / "trades"))
    assert out.count() == 2 and out.columns == ["game_id", "p"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2)], "k string, x double, n int")
    assert {r.path: r.value for r in tb.flatten_report(df, ["k"], "r").collect()} == {"r/a/x": 1.0, "r/a/n": 2.0}
    tb.write_report(df, str(tmp_path / "rep"))
    assert spark.read.text(str(tmp_path / "rep")).collect()[0].value == '{"k":"a","x":1.0,"n":2}'


def test_conform_and_dedupe(spark):
    df = tb.conform(spark.createDataFrame([(1, "x")], "a int, junk string"), "a double, b string")
    assert df.schema.simpleString() == "struct<a:double,b:string>"
    d = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "k int, at int, v string")
    assert {r.k: r.v for r in tb.dedupe_last(d, ["k"], ["at"]).collect()} == {1: "new", 2: "only"}


def batches(spark, tmp_path, schema, *rows):
    """A stream that reads one file per micro-batch."""
    for i, r in enumerate(rows):
        spark.createDataFrame(r, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def run(stream, tmp_path, spark):
    lv.use_rocksdb(spark)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()


def test_late_trades_never_reach_a_closed_bar(spark, tmp_path):
    schema = "ticker string, trade_id long, ts timestamp, yes_price double, count double"
    s = batches(spark, tmp_path, schema, [("T", 1, at(1), 0.5, 1.0), ("T", 2, at(3600), 0.6, 1.0)], [("T", 5, at(3700), 0.8, 1.0)],
                [("T", 3, at(2), 0.9, 1.0)], [("T", 4, at(7200), 0.7, 1.0)])
    got = {r.bar: (r.n, r.vwap) for r in run(lv.live_bars(s), tmp_path, spark)}
    assert got[at(0).replace(tzinfo=None)] == (1, 0.5) and (1, 0.7) not in got.values()


def test_repair_state_spans_batches(spark, tmp_path):
    schema = "game_id long, play_id long, snap double, end double, duration double, bad boolean, home double, away double, last boolean"
    s = batches(spark, tmp_path, schema, [(1, 1, None, None, 5.0, True, None, None, False), (1, 2, 100.0, 106.0, 5.0, False, 6.0, None, False)],
                [(1, 3, None, None, 5.0, True, 0.0, 3.0, False), (1, 4, 90.0, 95.0, 5.0, False, 7.0, None, True)])
    got = {r.play_id: (r.t_snap, r.t_end, r.home_score, r.away_score) for r in run(lv.live_repair(s, 2.0), tmp_path, spark)}
    assert got[1] == (100.0, 105.0, 0.0, 0.0) and got[2][:2] == (100.0, 106.0)
    assert got[2][2] == 6.0 and got[3][2:] == (6.0, 3.0) and got[4][2] == 7.0
    snaps = [got[i][0] for i in (1, 2, 3, 4)]
    assert snaps == sorted(snaps) and got[3][0] == got[2][1]


def test_log_sink_replays_without_duplicates(spark, tmp_path):
    schema = "game_id string, order int, t timestamp, p_home double"
    s = batches(spark, tmp_path, schema, [("A", 0, at(0), 0.5)], [("A", 0, at(0), 0.5), ("A", 1, at(5), 0.6)])
    q = lv.price_log_sink(s, str(tmp_path / "log"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = sorted((r.game_id, r.order, r.p_home) for r in lv.load_live_log(spark, str(tmp_path / "log")).collect())
    assert got == [("A", 0, 0.5), ("A", 1, 0.6)]
