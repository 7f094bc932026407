"""Streaming operators run to completion over the given tables and compared with their batch results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, functions as F

from inplay.operators import replay as rp, sequence as sq
from inplay.plans import sequences
from inplay.plans.registry import ROLE_SQL, query
from inplay.plans.roles import Tables, r6, us
from inplay.streaming import live as lv


def shared_dir(spark) -> str:
    """The cluster's shared folder. Only a local session, whose driver and executors are one machine, may go
    without it and gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="spark-live-")


def finish(t: Tables, stream: DataFrame) -> DataFrame:
    """Run the stream over what is there and read back what it wrote."""
    lv.use_rocksdb(t.spark)
    home = f"{shared_dir(t.spark)}/live-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{home}/data").option("checkpointLocation", f"{home}/state").trigger(
        availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{home}/data")


def streamed(t: Tables) -> Tables:
    """The same roles over a stream of the events table."""
    source = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    s = Tables(t.spark, t.dir)
    s.__dict__["events"] = source
    return s


MARK = "(SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM events WHERE event_type {what})"


@query("live_bars", f"""SELECT game_id, epoch_us(date_trunc('day', make_timestamp(ts))) AS bar_us, count(*) AS n, sum(cnt) AS contracts, round(sum(yes_price*cnt)/sum(cnt), 6) AS vwap,
    round(arg_max(yes_price, trade_id), 6) AS last FROM trades GROUP BY game_id, bar_us HAVING bar_us + 86400000000 <= {MARK.format(what="= 'purchase'")}""")
def live_bars(t: Tables):
    b = finish(t, lv.live_bars(streamed(t).trades, every="1 day", by=["game_id"]))
    return b.select("game_id", us("bar").alias("bar_us"), "n", "contracts", r6("vwap").alias("vwap"), r6("last").alias("last"))


@query("live_dedupe", "SELECT trade_id, game_id, round(price, 6) AS price FROM trades")
def live_dedupe(t: Tables):
    """Every trade sent twice arrives once."""
    tr = streamed(t).trades
    d = finish(t, lv.live_dedupe(tr.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")))
    return d.select("trade_id", "game_id", r6("price").alias("price"))


@query("live_repair", """WITH RECURSIVE b AS (SELECT game_id, play_id, CASE WHEN play_id % 11 <> 0 THEN t/1e6 END::DOUBLE AS snap, end_raw, 5.0::DOUBLE AS duration, total_home_score AS h,
      row_number() OVER (PARTITION BY game_id ORDER BY play_id) AS i FROM plays),
    c AS (SELECT *, end_raw IS NULL OR snap IS NULL OR end_raw < snap OR end_raw - snap > 120 AS bad,
      first_value(snap IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY play_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fv FROM b),
    rec AS (SELECT game_id, i, play_id, coalesce(snap, fv) AS s, greatest(CASE WHEN bad THEN coalesce(snap, fv) + duration ELSE end_raw END, coalesce(snap, fv)) AS e FROM c WHERE i = 1
      UNION ALL SELECT p.game_id, p.i, p.play_id, greatest(coalesce(p.snap, r.e), r.s),
      greatest(CASE WHEN p.bad THEN greatest(coalesce(p.snap, r.e), r.s) + p.duration ELSE p.end_raw END, greatest(coalesce(p.snap, r.e), r.s), r.e) FROM rec r JOIN c p ON p.game_id = r.game_id AND p.i = r.i + 1)
    SELECT r.game_id, r.play_id, round(r.s, 3) AS t_snap, round(r.e, 3) AS t_end, round(r.e + 5, 3) AS t_known,
      greatest(coalesce((SELECT max(h) FROM b WHERE b.game_id = r.game_id AND b.i <= r.i), 0), 0) AS home_score FROM rec r""")
def live_repair(t: Tables):
    s = streamed(t)
    raw = s.plays.select("game_id", "play_id", F.when(F.col("play_id") % 11 != 0, F.unix_micros("t") / 1e6).alias("snap"), F.col("end_raw").alias("end"),
                         F.lit(5.0).alias("duration"), F.col("total_home_score").alias("home"), F.col("total_away_score").alias("away"), F.lit(False).alias("last"))
    raw = raw.withColumn("bad", sq.bad_end(F.col("snap"), F.col("end")))
    out = finish(t, lv.live_repair(raw, 5.0))
    return out.select("game_id", "play_id", *[F.round(c, 3).alias(c) for c in ("t_snap", "t_end", "t_known")], "home_score")


# the replay roles with a fixed length bound
for _name in ("np", "pt0", "pt1", "pt2", "pub"):
    _text = ROLE_SQL[_name].replace("b.bound_s", "30 AS bound_s").replace("LEFT JOIN bounds b ON b.play_type = p.play_type", "")
    for _dep in ("np", "pt0", "pt1", "pt2"):
        _text = _text.replace(f"FROM {_dep}", f"FROM l{_dep}")
    ROLE_SQL[f"l{_name}"] = _text
ROLE_SQL["lreplayed"] = sequences.REPLAY.replace("FROM pub", "FROM lpub")


@query("live_events", "SELECT game_id, seq, kind, t_us, timing FROM lreplayed WHERE kind <> 'final'")
def live_events(t: Tables):
    """Events emitted play by play; the table has no end-of-game row, so no final event."""
    p = streamed(t).play_rows.filter("play_type IS NOT NULL AND posteam IS NOT NULL AND t_end IS NOT NULL")
    sec = lambda c: (F.unix_micros(c) / 1e6).alias(c)
    rows = p.select("game_id", "seq", sec("t_snap"), sec("t_end"), "snap_imputed", "end_imputed", F.lit(30.0).alias("bound_s"), "desc", "qtr", "game_half",
                    F.col("game_seconds_remaining").alias("gsr"), F.col("half_seconds_remaining").alias("hsr"),
                    rp.phase_of(F.col("play_type"), F.col("down"), F.col("desc")).alias("phase"), F.col("home_score_post").alias("home_post"),
                    F.col("away_score_post").alias("away_post"), F.lit(False).alias("last"))
    out = finish(t, lv.live_events(rows))
    return out.select("game_id", "seq", "kind", F.round(F.col("t") * 1e6).cast("bigint").alias("t_us"), "timing")


@query("live_asof", f"""SELECT m.game_id, m.t AS t_us, q.event_id AS quote_order, round(q.p, 6) AS p_home FROM (SELECT * FROM ev WHERE event_type = 'view' AND t < {MARK.format(what="IN ('view', 'signup')")}) m
    ASOF LEFT JOIN (SELECT game_id, event_id, t, value/(value + 50) AS p FROM ev WHERE event_type = 'signup') q ON q.game_id = m.game_id AND m.t >= q.t""")
def live_asof(t: Tables):
    """Each minute with the latest quote known by then, released once the watermark has passed it."""
    e = streamed(t).ev
    q = e.filter("event_type = 'signup'").select("game_id", F.col("t").alias("t_known"), F.col("event_id").alias("order"), (F.col("value") / (F.col("value") + 50)).alias("p_home"))
    m = e.filter("event_type = 'view'").select("game_id", "t", F.col("k").cast("double").alias("market"))
    out = finish(t, lv.live_asof(q, m))
    return out.select("game_id", us("t").alias("t_us"), "quote_order", r6("p_home").alias("p_home"))
