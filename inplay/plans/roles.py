"""The given tables in the roles of the domain: play rows, price log, market minutes, trades,
contracts, score samples. Each role is a DataFrame over whole tables plus the same thing as a
SQL CTE, so that a query and its SQL twin start from equal rows.

Times are timestamps on the Spark side and epoch microseconds in SQL; results show microseconds.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from inplay.operators.scan import dealt, hot_entities
from inplay.plans.registry import ROLE_SQL

DAY0_S = 1704067200  # 2024-01-01T00:00:00Z, the first day of `events`


def us(c: str | Column) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


_HOT: dict[tuple, DataFrame | None] = {}
_ROWS: dict[tuple, int] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                    "documents", "pages", "benchmark", "labels", "conversations"):
            return self.read(name)
        raise AttributeError(name)

    def hot(self, table: str, by: str, order: str) -> DataFrame | None:
        """Hot entities of a given table, measured once per session."""
        key = (self.spark.sparkContext.applicationId, self.dir, table, by, order,
               self.spark.conf.get("spark.inplay.sliceRows", ""))
        if key not in _HOT:
            _HOT[key] = hot_entities(getattr(self, table), [by], order)
        return _HOT[key]

    @property
    def hot_games(self) -> DataFrame | None:
        return self.hot("ev", "game_id", "t")

    @property
    def hot_games_by_id(self) -> DataFrame | None:
        return self.hot("ev", "game_id", "event_id")

    def by_game(self, df: DataFrame) -> DataFrame:
        """Rows of `events` dealt to tasks by game. Where a game is hot they are left alone: its slices are tasks of their own."""
        key = (self.spark.sparkContext.applicationId, self.dir)
        if key not in _ROWS:
            _ROWS[key] = self.events.count()
        return dealt(df, ["game_id"], _ROWS[key]) if self.hot_games is None else df

    @cached_property
    def ev(self) -> DataFrame:
        """Events with the user as the game."""
        return self.events.select(
            "event_id", F.col("user_id").alias("game_id"), F.col("ts").cast("timestamp").alias("t"),
            "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))

    @cached_property
    def prices(self) -> DataFrame:
        """Price log: click, signup and error rows; a user's first is the pregame, the last the final."""
        q = self.ev.filter(F.col("event_type").isin("click", "signup", "error") & F.col("game_id").isNotNull())
        lo, hi = F.min("event_id"), F.max("event_id")
        if self.hot_games is None:  # in the order of the scans that follow, so that these need no sort of their own
            w = Window.partitionBy("game_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            q = self.by_game(q).withColumns({"lo": lo.over(w), "hi": hi.over(w)})
        else:
            q = q.join(q.groupBy("game_id").agg(lo.alias("lo"), hi.alias("hi")), "game_id")
        elapsed = (F.unix_micros("t") / 1e6 - DAY0_S) / 720
        ruled = F.element_at(F.array(*[F.lit(x) for x in ("review", "penalty", "imputed", "clock")]),
                             (F.col("k") % 4 + 1).cast("int"))
        kind = (F.when(F.col("event_id") == F.col("lo"), "pregame").when(F.col("event_id") == F.col("hi"), "final")
                .when(F.col("event_type") == "signup", "snap").otherwise("play"))
        final = F.col("kind") == "final"
        return (
            q.withColumn("kind", kind)
            .select(
                "game_id", F.col("event_id").alias("order"), F.col("event_id").alias("seq"), "kind", "t",
                F.when(F.col("kind") == "pregame", "pregame").when(final, "end")
                .when(F.col("kind") == "snap", "snap").when(F.col("event_type") == "error", ruled)
                .otherwise("end").alias("timing"),
                F.when(F.col("kind").isin("play", "final"),
                       F.col("t") - F.make_dt_interval(secs=(F.floor("value") * 60).cast("decimal(18,6)")))
                .alias("t_play_end"),
                F.element_at(F.array(F.lit("snap"), F.lit("kickoff"), F.lit("pat"), F.lit("snap")),
                             (F.col("k") % 4 + 1).cast("int")).alias("phase"),
                (F.floor(elapsed / 880) + 1).alias("qtr"),
                F.greatest(3600 - F.floor(elapsed), F.lit(0)).cast("double").alias("game_seconds_remaining"),
                (F.floor("value") % 31).alias("home_score"), (F.col("k") % 31).alias("away_score"),
                (F.col("k") % 2 == 0).alias("posteam_is_home"), (F.col("k") % 4 + 1).alias("down"),
                (F.col("k") % 10 + 1).alias("ydstogo"), (F.col("event_id") % 99 + 1).alias("yardline_100"),
                (F.col("value") / (F.col("value") + 50)).alias("p_home"), (F.col("k") / 2000).alias("p_tie"),
                F.when(F.col("k") % 4 == 0, (F.col("k") + 1) / 102.0).alias("wp_direct_home"),
                F.when(final, 0).otherwise(2000).cast("bigint").alias("n_sims"),
            )
        )

    @cached_property
    def minutes(self) -> DataFrame:
        """Market minutes: view rows with a home price and a book width."""
        return self.by_game(self.ev.filter(F.col("event_type") == "view").select(
            "game_id", "t", ((F.col("k") + 0.5) / 101).alias("market"),
            ((F.col("event_id") % 8) / 100.0).alias("spread")))

    @cached_property
    def trades(self) -> DataFrame:
        """Trades: purchase rows as contracts of either side, with the price from the home side."""
        home = F.col("event_id") % 2 == 0
        p = F.col("value") / (F.col("value") + 50)
        return self.ev.filter(F.col("event_type") == "purchase").select(
            "game_id", F.col("event_id").alias("trade_id"), F.col("t").alias("ts"),
            F.when(home, "home").otherwise("away").alias("side"), p.alias("yes_price"),
            F.when(home, p).otherwise(1 - p).alias("price"), (F.col("k") + 1).cast("double").alias("count"))

    @cached_property
    def plays(self) -> DataFrame:
        """Raw play rows with holes and wild values in their times (epoch seconds)."""
        s = (F.unix_micros("t") / 1e6)
        pid = F.col("event_id")
        snap = (F.when(pid % 11 == 0, F.lit(None)).when(pid % 7 == 0, s - 864000.0)
                .when(pid % 13 == 0, s - 90000.0).otherwise(s))
        return self.ev.select(
            "game_id", F.col("event_id").alias("play_id"), F.year("t").cast("bigint").alias("season"),
            F.when(F.col("k") % 10 != 9, F.col("event_type")).alias("play_type"),
            snap.cast("double").alias("snap_raw"),
            F.when(pid % 5 != 0, s + F.col("value")).cast("double").alias("end_raw"),
            F.when(F.col("event_type") == "purchase", F.floor(F.col("value"))).cast("double").alias("total_home_score"),
            F.when(F.col("event_type") == "click", F.floor(F.col("value"))).cast("double").alias("total_away_score"),
            "t", "k", "value")

    @cached_property
    def snaps(self) -> DataFrame:
        """Play rows with possessions, drives of two days, points per drive and a pregame line."""
        e = self.ev.withColumn("fixed_drive", F.floor((F.unix_micros("t") / 1e6 - DAY0_S) / 172800) + 1)
        by_drive = e.groupBy("game_id", "fixed_drive").agg(F.max("event_id").alias("last_id")).withColumns({
            "h": (F.col("game_id") * 7 + F.col("fixed_drive") * 5) % 11,
            "offense_home": (F.col("game_id") + F.col("fixed_drive")) % 2 == 0,
        })
        pts = (F.when(F.col("h") <= 2, F.col("h") + 6).when(F.col("h") <= 4, 3).otherwise(0))
        dpts = F.when(F.col("h") == 9, 2).when(F.col("h") == 10, 7).otherwise(0)
        by_drive = by_drive.withColumns({
            "pts_home": F.when(F.col("offense_home"), pts).otherwise(dpts),
            "pts_away": F.when(F.col("offense_home"), dpts).otherwise(pts)})
        # a game has at most one row per two days here, so these windows are short
        w = Window.partitionBy("game_id").orderBy("fixed_drive")
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy("game_id")
        d = by_drive.select(
            "game_id", "fixed_drive", "last_id", "h", "offense_home", "pts_home", "pts_away",
            F.coalesce(F.sum("pts_home").over(before), F.lit(0)).alias("hp"),
            F.coalesce(F.sum("pts_away").over(before), F.lit(0)).alias("ap"),
            F.sum("pts_home").over(whole).alias("fh"), F.sum("pts_away").over(whole).alias("fa"))
        last = F.col("event_id") == F.col("last_id")
        elapsed = (F.unix_micros("t") / 1e6 - DAY0_S) / 720
        gsr = F.greatest(3600 - F.floor(elapsed), F.lit(0)).cast("double")
        snap_row = F.col("event_type").isin("view", "click", "purchase", "error")
        raw = F.element_at(F.array(*[F.lit(x) for x in RAW_RESULTS]), (F.col("h") + 1).cast("int"))
        return e.join(d, ["game_id", "fixed_drive"]).select(
            "game_id", F.col("event_id").alias("seq"), F.col("event_id").alias("play_id"), "t",
            (F.lit(2000) + F.col("game_id") % 6).alias("season"),
            F.when(F.col("game_id") % 9 == 0, "POST").otherwise("REG").alias("season_type"),
            F.concat(F.lit("H"), F.col("game_id") % 32).alias("home_team"),
            F.concat(F.lit("A"), F.col("game_id") % 32).alias("away_team"),
            "fixed_drive", raw.alias("fixed_drive_result"),
            F.when(F.col("k") % 20 != 19, F.when(F.col("offense_home"), F.concat(F.lit("H"), F.col("game_id") % 32))
                   .otherwise(F.concat(F.lit("A"), F.col("game_id") % 32))).alias("posteam"),
            F.when(snap_row, F.col("k") % 4 + 1).alias("down"),
            (F.col("k") % 10 + 1).alias("ydstogo"),
            F.when(snap_row, F.col("event_id") % 99 + 1).alias("yardline_100"),
            F.col("event_type").alias("play_type"),
            F.least(F.floor((3600 - gsr) / 900) + 1, F.lit(4)).alias("qtr"),
            F.when(gsr > 1800, "Half1").otherwise("Half2").alias("game_half"),
            gsr.alias("game_seconds_remaining"),
            F.when(gsr > 1800, gsr - 1800).otherwise(gsr).alias("half_seconds_remaining"),
            (3 - F.floor(F.col("k") / 34)).alias("home_timeouts"), (3 - F.col("k") % 3).alias("away_timeouts"),
            F.col("hp").cast("double").alias("home_score_pre"), F.col("ap").cast("double").alias("away_score_pre"),
            (F.col("hp") + F.when(last, F.col("pts_home")).otherwise(0)).cast("double").alias("home_score_post"),
            (F.col("ap") + F.when(last, F.col("pts_away")).otherwise(0)).cast("double").alias("away_score_post"),
            F.when(F.col("game_id") % 10 != 3, (F.col("game_id") % 15 - 7).cast("double")).alias("pregame_spread"),
            F.when(F.col("game_id") % 10 != 4, (F.col("game_id") % 12 + 38).cast("double")).alias("pregame_total"),
            (F.col("fh") - F.col("fa")).cast("double").alias("final_margin_home"),
            (F.col("fh") + F.col("fa")).cast("double").alias("final_total"),
            (F.col("game_id") % 2).cast("double").alias("home_opening_kickoff"))

    @cached_property
    def play_rows(self) -> DataFrame:
        """Cleaned play rows with ids, downs, texts and clocks, overtime included."""
        k, pid, kind = F.col("k"), F.col("event_id"), F.col("event_type")
        elapsed = (F.unix_micros("t") / 1e6 - DAY0_S) / 720
        e = self.ev.withColumn("gsr", F.greatest(3600 - F.floor(elapsed), F.lit(0)).cast("double"))
        e = e.withColumn("qtr", F.when(F.col("gsr") <= 200, 5).otherwise(F.floor((3600 - F.col("gsr")) / 900) + 1).cast("bigint"))
        qtr = F.col("qtr")
        home, away = F.concat(F.lit("H"), F.col("game_id")), F.concat(F.lit("A"), F.col("game_id"))
        names = {"signup": "kickoff", "error": "no_play", "click": "pass", "purchase": "run", "view": "punt"}
        typed = F.lit(None).cast("string")
        for event, name in names.items():
            typed = F.when(kind == event, name).otherwise(typed)
        no_down = (kind == "signup") | ((kind == "error") & (k % 3 == 0)) | ((kind == "purchase") & (k % 25 == 0))
        hp, ap = k % 31, pid % 29
        return e.select(
            "game_id", pid.alias("seq"), F.when(k % 10 != 9, typed).alias("play_type"),
            F.when(k % 20 != 19, F.when(pid % 3 == 0, home).otherwise(away)).alias("posteam"),
            home.alias("home_team"), away.alias("away_team"), F.col("t").alias("t_snap"),
            F.when(pid % 37 != 0, F.col("t") + F.make_dt_interval(
                secs=F.least(F.floor("value"), F.lit(60)).cast("decimal(18,6)"))).alias("t_end"),
            (pid % 11 == 0).alias("snap_imputed"), (pid % 5 == 0).alias("end_imputed"),
            F.when(k % 17 == 0, "the ruling was Upheld").when(k % 13 == 0, "PENALTY on the defense")
            .when(k % 7 == 0, "team kicks 65 yards").otherwise("play").alias("desc"),
            qtr, F.col("gsr").alias("game_seconds_remaining"),
            F.when(qtr <= 2, F.col("gsr") - 1800).otherwise(F.col("gsr")).alias("half_seconds_remaining"),
            F.when(qtr <= 2, "Half1").when(qtr <= 4, "Half2").otherwise("Overtime").alias("game_half"),
            F.when(~no_down, k % 4 + 1).alias("down"), (k % 10 + 1).alias("ydstogo"), (pid % 99 + 1).alias("yardline_100"),
            (3 - F.floor(k / 34)).alias("home_timeouts"), (3 - k % 3).alias("away_timeouts"),
            hp.alias("home_score_pre"), ap.alias("away_score_pre"), (hp + F.when(k % 9 == 0, 2).otherwise(0)).alias("home_score_post"),
            (ap + F.when(k % 8 == 0, 2).otherwise(0)).alias("away_score_post"),
            F.when(F.col("game_id") % 10 != 7, (F.col("game_id") % 2).cast("double")).alias("home_opening_kickoff"),
            (F.lit(2000) + F.col("game_id") % 6).alias("season"))

    @cached_property
    def forecasts(self) -> DataFrame:
        """One forecast per line item: p, label, quarter, the order as the game."""
        return self.lineitem.select(
            F.col("l_orderkey").alias("game_id"), ((F.col("l_quantity") * 2 - 1) / 100).alias("p"),
            (F.col("l_returnflag") == "R").cast("bigint").alias("label"),
            F.quarter("l_shipdate").cast("bigint").alias("qtr"),
            (F.col("l_linenumber") % 3).cast("double").alias("w"), F.year("l_shipdate").cast("bigint").alias("season"))

    @cached_property
    def samples(self) -> DataFrame:
        """Final-score samples: line items of one supplier are the samples of one state."""
        return self.lineitem.select(
            F.col("l_suppkey").alias("state_id"), F.col("l_quantity").cast("bigint").alias("home"),
            (F.col("l_partkey") % 50 + 1).alias("away"))

    @cached_property
    def contracts(self) -> DataFrame:
        """Contracts: twelve slots per supplier (two winners, five spread rungs, five totals)."""
        slot = F.col("l_partkey") % 12
        return self.lineitem.select(F.col("l_suppkey").alias("game_id"), slot.alias("slot")).distinct().select(
            "game_id", (F.col("game_id") * 12 + F.col("slot")).alias("ticker"),
            F.when(F.col("slot") < 2, "winner").when(F.col("slot") < 7, "spread").otherwise("total").alias("kind"),
            F.when(F.col("slot") < 7, F.when(F.col("slot") % 2 == 0, "home").otherwise("away")).alias("side"),
            F.when(F.col("slot") < 2, F.lit(None)).when(F.col("slot") < 7, F.col("slot") * 2 - 5.5)
            .otherwise(36.5 + 3 * (F.col("slot") - 7)).cast("double").alias("strike"),
            F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("scalar"), F.lit("")),
                         ((F.col("game_id") + F.col("slot")) % 4 + 1).cast("int")).alias("result"))

    @cached_property
    def candles(self) -> DataFrame:
        """Candles: one per line item, bid and ask from quantity and discount."""
        bid = (F.col("l_quantity") - 1) / 52
        ask = bid + F.col("l_discount") / 1.5
        ok = (bid > 0) & (bid <= ask) & (ask < 1)
        slot = F.col("l_partkey") % 12
        return self.lineitem.select(
            F.col("l_suppkey").alias("game_id"), (F.col("l_suppkey") * 12 + slot).alias("ticker"),
            (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(
                mins=F.col("l_linenumber"), secs=F.pmod("l_orderkey", F.lit(60)).cast("decimal(18,6)"))).alias("end_ts"),
            F.col("l_orderkey").alias("row_id"), F.col("l_extendedprice").alias("row_tie"),
            bid.alias("bid_close"), ask.alias("ask_close"), F.when(ok, (bid + ask) / 2).alias("mid_close"),
            F.when(ok, ask - bid).alias("spread_close"), F.col("l_quantity").alias("volume"))

    @cached_property
    def kickoffs(self) -> DataFrame:
        """Kickoff time and fallback lines per supplier."""
        return self.supplier.select(
            F.col("s_suppkey").alias("game_id"),
            F.timestamp_seconds(F.lit(883612800) + F.col("s_suppkey") % 900 * 86400).alias("kickoff"),
            F.when(F.col("s_suppkey") % 7 != 0, (F.col("s_suppkey") % 15 - 7).cast("double")).alias("spread_line"),
            F.when(F.col("s_suppkey") % 5 != 0, (F.col("s_suppkey") % 11 + 39).cast("double")).alias("total_line"))


RAW_RESULTS = ("Touchdown", "Touchdown", "Touchdown", "Field goal", "Field goal", "Punt", "Turnover",
               "Turnover on downs", "End of half", "Safety", "Opp touchdown")

ROLE_SQL.update({
    "ev": """SELECT event_id, user_id AS game_id, epoch_us(ts) AS t, event_type, value,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "q0": """SELECT *, (t/1e6 - 1704067200)/720 AS elapsed, min(event_id) OVER (PARTITION BY game_id) AS lo,
        max(event_id) OVER (PARTITION BY game_id) AS hi FROM ev WHERE event_type IN ('click','signup','error')""",
    "q1": """SELECT *, CASE WHEN event_id = lo THEN 'pregame' WHEN event_id = hi THEN 'final'
        WHEN event_type = 'signup' THEN 'snap' ELSE 'play' END AS kind FROM q0""",
    "prices": """SELECT game_id, event_id AS ord, event_id AS seq, kind, t,
        CASE WHEN kind = 'pregame' THEN 'pregame' WHEN kind = 'final' THEN 'end' WHEN kind = 'snap' THEN 'snap'
          WHEN event_type = 'error' THEN CASE k % 4 WHEN 0 THEN 'review' WHEN 1 THEN 'penalty' WHEN 2 THEN 'imputed'
          ELSE 'clock' END ELSE 'end' END AS timing,
        CASE WHEN kind IN ('play','final') THEN t - CAST(floor(value) AS BIGINT) * 60000000 END AS t_play_end,
        CASE k % 4 WHEN 1 THEN 'kickoff' WHEN 2 THEN 'pat' ELSE 'snap' END AS phase,
        CAST(floor(elapsed / 880) AS BIGINT) + 1 AS qtr,
        greatest(3600 - floor(elapsed), 0)::DOUBLE AS game_seconds_remaining,
        CAST(floor(value) AS BIGINT) % 31 AS home_score, k % 31 AS away_score, k % 2 = 0 AS posteam_is_home,
        k % 4 + 1 AS down, k % 10 + 1 AS ydstogo, event_id % 99 + 1 AS yardline_100,
        value / (value + 50) AS p_home, k / 2000.0::DOUBLE AS p_tie,
        CASE WHEN k % 4 = 0 THEN (k + 1) / 102.0::DOUBLE END AS wp_direct_home,
        CASE WHEN kind = 'final' THEN 0 ELSE 2000 END::BIGINT AS n_sims FROM q1""",
    "minutes": """SELECT game_id, t, (k + 0.5::DOUBLE) / 101 AS market, (event_id % 8) / 100.0::DOUBLE AS spread
        FROM ev WHERE event_type = 'view'""",
    "trades": """SELECT game_id, event_id AS trade_id, t AS ts,
        CASE WHEN event_id % 2 = 0 THEN 'home' ELSE 'away' END AS side, value / (value + 50) AS yes_price,
        CASE WHEN event_id % 2 = 0 THEN value / (value + 50) ELSE 1 - value / (value + 50) END AS price,
        (k + 1)::DOUBLE AS cnt FROM ev WHERE event_type = 'purchase'""",
    "plays": """SELECT game_id, event_id AS play_id, year(make_timestamp(t))::BIGINT AS season,
        CASE WHEN k % 10 <> 9 THEN event_type END AS play_type,
        CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN t/1e6 - 864000.0
          WHEN event_id % 13 = 0 THEN t/1e6 - 90000.0 ELSE t/1e6 END::DOUBLE AS snap_raw,
        CASE WHEN event_id % 5 <> 0 THEN t/1e6 + value END::DOUBLE AS end_raw,
        CASE WHEN event_type = 'purchase' THEN floor(value) END::DOUBLE AS total_home_score,
        CASE WHEN event_type = 'click' THEN floor(value) END::DOUBLE AS total_away_score, t, k, value FROM ev""",
    "sd0": """SELECT *, CAST(floor((t/1e6 - 1704067200)/172800) AS BIGINT) + 1 AS fixed_drive FROM ev""",
    "sd1": """SELECT game_id, fixed_drive, max(event_id) AS last_id, (game_id*7 + fixed_drive*5) % 11 AS h,
        (game_id + fixed_drive) % 2 = 0 AS offense_home FROM sd0 GROUP BY game_id, fixed_drive""",
    "sd2": """SELECT *, CASE WHEN offense_home THEN op ELSE dp END AS pts_home,
        CASE WHEN offense_home THEN dp ELSE op END AS pts_away FROM (SELECT *,
        CASE WHEN h <= 2 THEN h + 6 WHEN h <= 4 THEN 3 ELSE 0 END AS op,
        CASE WHEN h = 9 THEN 2 WHEN h = 10 THEN 7 ELSE 0 END AS dp FROM sd1)""",
    "sd3": """SELECT *,
        coalesce(sum(pts_home) OVER (PARTITION BY game_id ORDER BY fixed_drive ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hp,
        coalesce(sum(pts_away) OVER (PARTITION BY game_id ORDER BY fixed_drive ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ap,
        sum(pts_home) OVER (PARTITION BY game_id) AS fh, sum(pts_away) OVER (PARTITION BY game_id) AS fa FROM sd2""",
    "sd4": """SELECT e.*, d.last_id, d.h, d.offense_home, d.pts_home, d.pts_away, d.hp, d.ap, d.fh, d.fa,
        greatest(3600 - floor((e.t/1e6 - 1704067200)/720), 0)::DOUBLE AS gsr,
        e.event_type IN ('view','click','purchase','error') AS snap_row
        FROM sd0 e JOIN sd3 d ON e.game_id = d.game_id AND e.fixed_drive = d.fixed_drive""",
    "snaps": """SELECT game_id, event_id AS seq, event_id AS play_id, t, 2000 + game_id % 6 AS season,
        CASE WHEN game_id % 9 = 0 THEN 'POST' ELSE 'REG' END AS season_type,
        'H' || (game_id % 32) AS home_team, 'A' || (game_id % 32) AS away_team, fixed_drive,
        (['Touchdown','Touchdown','Touchdown','Field goal','Field goal','Punt','Turnover','Turnover on downs',
          'End of half','Safety','Opp touchdown'])[h + 1] AS fixed_drive_result,
        CASE WHEN k % 20 <> 19 THEN CASE WHEN offense_home THEN 'H' ELSE 'A' END || (game_id % 32) END AS posteam,
        CASE WHEN snap_row THEN k % 4 + 1 END AS down, k % 10 + 1 AS ydstogo,
        CASE WHEN snap_row THEN event_id % 99 + 1 END AS yardline_100, event_type AS play_type,
        least(CAST(floor((3600 - gsr)/900) AS BIGINT) + 1, 4) AS qtr,
        CASE WHEN gsr > 1800 THEN 'Half1' ELSE 'Half2' END AS game_half, gsr AS game_seconds_remaining,
        CASE WHEN gsr > 1800 THEN gsr - 1800 ELSE gsr END AS half_seconds_remaining,
        3 - CAST(floor(k / 34.0) AS BIGINT) AS home_timeouts, 3 - k % 3 AS away_timeouts,
        hp::DOUBLE AS home_score_pre, ap::DOUBLE AS away_score_pre,
        (hp + CASE WHEN event_id = last_id THEN pts_home ELSE 0 END)::DOUBLE AS home_score_post,
        (ap + CASE WHEN event_id = last_id THEN pts_away ELSE 0 END)::DOUBLE AS away_score_post,
        CASE WHEN game_id % 10 <> 3 THEN (game_id % 15 - 7)::DOUBLE END AS pregame_spread,
        CASE WHEN game_id % 10 <> 4 THEN (game_id % 12 + 38)::DOUBLE END AS pregame_total,
        (fh - fa)::DOUBLE AS final_margin_home, (fh + fa)::DOUBLE AS final_total,
        (game_id % 2)::DOUBLE AS home_opening_kickoff FROM sd4""",
    "forecasts": """SELECT l_orderkey AS game_id, (l_quantity*2 - 1)/100 AS p, (l_returnflag = 'R')::BIGINT AS label,
        quarter(l_shipdate)::BIGINT AS qtr, (l_linenumber % 3)::DOUBLE AS w, year(l_shipdate)::BIGINT AS season FROM lineitem""",
    "samples": """SELECT l_suppkey AS state_id, l_quantity::BIGINT AS home, l_partkey % 50 + 1 AS away FROM lineitem""",
    "contracts": """SELECT game_id, game_id * 12 + slot AS ticker,
        CASE WHEN slot < 2 THEN 'winner' WHEN slot < 7 THEN 'spread' ELSE 'total' END AS kind,
        CASE WHEN slot < 7 THEN CASE WHEN slot % 2 = 0 THEN 'home' ELSE 'away' END END AS side,
        CASE WHEN slot < 2 THEN NULL WHEN slot < 7 THEN slot * 2 - 5.5 ELSE 36.5 + 3 * (slot - 7) END::DOUBLE AS strike,
        (['yes','no','scalar',''])[(game_id + slot) % 4 + 1] AS result
        FROM (SELECT DISTINCT l_suppkey AS game_id, l_partkey % 12 AS slot FROM lineitem)""",
    "candles": """SELECT game_id, ticker, end_ts, row_id, row_tie, bid AS bid_close, ask AS ask_close,
        CASE WHEN bid > 0 AND bid <= ask AND ask < 1 THEN (bid + ask)/2 END AS mid_close,
        CASE WHEN bid > 0 AND bid <= ask AND ask < 1 THEN ask - bid END AS spread_close, volume
        FROM (SELECT l_suppkey AS game_id, l_suppkey * 12 + l_partkey % 12 AS ticker,
          epoch_us(l_shipdate) + l_linenumber * 60000000::BIGINT + (l_orderkey % 60) * 1000000 AS end_ts,
          l_orderkey AS row_id, l_extendedprice AS row_tie,
          (l_quantity - 1)/52 AS bid, (l_quantity - 1)/52 + l_discount/1.5::DOUBLE AS ask, l_quantity AS volume FROM lineitem)""",
    "kickoffs": """SELECT s_suppkey AS game_id, (883612800 + s_suppkey % 900 * 86400) * 1000000 AS kickoff,
        CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey % 15 - 7)::DOUBLE END AS spread_line,
        CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey % 11 + 39)::DOUBLE END AS total_line FROM supplier""",
    "pr0": """SELECT *, greatest(3600 - floor((t/1e6 - 1704067200)/720), 0)::DOUBLE AS gsr,
        event_type = 'signup' OR (event_type = 'error' AND k % 3 = 0) OR (event_type = 'purchase' AND k % 25 = 0) AS no_down FROM ev""",
    "pr1": """SELECT *, CASE WHEN gsr <= 200 THEN 5 ELSE CAST(floor((3600 - gsr)/900) AS BIGINT) + 1 END::BIGINT AS qtr FROM pr0""",
    "play_rows": """SELECT game_id, event_id AS seq, CASE WHEN k % 10 <> 9 THEN CASE event_type WHEN 'signup' THEN 'kickoff'
          WHEN 'error' THEN 'no_play' WHEN 'click' THEN 'pass' WHEN 'purchase' THEN 'run' WHEN 'view' THEN 'punt' END END AS play_type,
        CASE WHEN k % 20 <> 19 THEN CASE WHEN event_id % 3 = 0 THEN 'H' ELSE 'A' END || game_id END AS posteam,
        'H' || game_id AS home_team, 'A' || game_id AS away_team, t AS t_snap,
        CASE WHEN event_id % 37 <> 0 THEN t + least(CAST(floor(value) AS BIGINT), 60) * 1000000 END AS t_end,
        event_id % 11 = 0 AS snap_imputed, event_id % 5 = 0 AS end_imputed,
        CASE WHEN k % 17 = 0 THEN 'the ruling was Upheld' WHEN k % 13 = 0 THEN 'PENALTY on the defense'
          WHEN k % 7 = 0 THEN 'team kicks 65 yards' ELSE 'play' END AS "desc",
        qtr, gsr AS game_seconds_remaining, CASE WHEN qtr <= 2 THEN gsr - 1800 ELSE gsr END AS half_seconds_remaining,
        CASE WHEN qtr <= 2 THEN 'Half1' WHEN qtr <= 4 THEN 'Half2' ELSE 'Overtime' END AS game_half,
        CASE WHEN NOT no_down THEN k % 4 + 1 END AS down, k % 10 + 1 AS ydstogo, event_id % 99 + 1 AS yardline_100,
        3 - CAST(floor(k / 34.0) AS BIGINT) AS home_timeouts, 3 - k % 3 AS away_timeouts,
        k % 31 AS home_score_pre, event_id % 29 AS away_score_pre, k % 31 + CASE WHEN k % 9 = 0 THEN 2 ELSE 0 END AS home_score_post,
        event_id % 29 + CASE WHEN k % 8 = 0 THEN 2 ELSE 0 END AS away_score_post,
        CASE WHEN game_id % 10 <> 7 THEN (game_id % 2)::DOUBLE END AS home_opening_kickoff, 2000 + game_id % 6 AS season FROM pr1""",
})
