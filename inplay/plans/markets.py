"""Joins, set operations, market tables, coverage, priors, distributions and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inplay.functions import teams as tm
from inplay.functions.hashing import uniform, uniform_sql
from inplay.operators import distributions as ds, evaluate as ev, quotes as qt, replay as rp
from inplay.operators.asof import asof_join, seconds
from inplay.operators.scan import row_number, scan
from inplay.plans.evaluation import PAIR_DOUBLES, rounded
from inplay.plans.normalization import schedule, tickers
from inplay.plans import sequences  # noqa: F401  (roles of the replay)
from inplay.plans.registry import ROLE_SQL, query
from inplay.plans.roles import DAY0_S, Tables, r6, us
from inplay.plans.sqlkit import N_BOOT, cols6, paired_sql
from inplay.sources import tables as tb
from inplay.operators.onerow import with_row

# ------------------------------------------------------------------ joins


@query("join_inner", """SELECT p.game_id, p.ord AS "order", s.down AS snap_down FROM prices p JOIN snaps s ON p.game_id = s.game_id AND p.seq = s.seq""")
def join_inner(t: Tables):
    return t.prices.join(t.snaps.select("game_id", "seq", F.col("down").alias("snap_down")), ["game_id", "seq"]).select("game_id", "order", "snap_down")


@query("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n, round(sum(o.o_totalprice), 2) AS total FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
def join_left(t: Tables):
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return t.customer.select("c_custkey").join(per, "c_custkey", "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.round("total", 2).alias("total"))


@query("resume_anti", "SELECT DISTINCT game_id FROM prices WHERE game_id NOT IN (SELECT game_id FROM trades WHERE price > 0.8)")
def resume_anti(t: Tables):
    return tb.todo(t.prices.select("game_id").distinct(), t.trades.filter("price > 0.8"))


@query("join_semi", "SELECT trade_id, game_id FROM trades WHERE game_id IN (SELECT game_id FROM prices WHERE kind = 'final' AND p_home > 0.5)")
def join_semi(t: Tables):
    return t.trades.join(t.prices.filter("kind = 'final' AND p_home > 0.5").select("game_id"), "game_id", "left_semi").select("trade_id", "game_id")


@query("join_full_coalesce", """SELECT coalesce(a.game_id, b.game_id) AS game_id, coalesce(a.t, b.t) AS t_us, strftime(make_timestamp(coalesce(a.t, b.t)), '%H:%M') AS hm,
    round(coalesce(a.market, b.market), 6) AS market, round(a.model, 6) AS model_0, round(b.model, 6) AS model_20
    FROM (SELECT * FROM grid0 WHERE qtr = 4) a FULL JOIN (SELECT * FROM grid20 WHERE qtr = 4) b ON a.game_id = b.game_id AND a.t = b.t""")
def join_full_coalesce(t: Tables):
    """Late minutes at two delays side by side; either side may be missing."""
    def one(d):
        g = ev.winner_grid(t.prices, t.minutes, float(d), hot=t.hot_games).filter("qtr = 4")
        return g.select("game_id", "t", F.col("market").alias(f"market_{d}"), F.col("model").alias(f"model_{d}"))

    j = one(0).join(one(20), ["game_id", "t"], "full")
    return j.select("game_id", us("t").alias("t_us"), F.date_format("t", "HH:mm").alias("hm"), r6(F.coalesce("market_0", "market_20")).alias("market"),
                    r6("model_0").alias("model_0"), r6("model_20").alias("model_20"))


STALE_S = 60 * 86400
ROLE_SQL["last_q"] = f"""SELECT c.game_id, c.ticker, c.end_ts, c.mid_close, c.spread_close FROM candles c JOIN kickoffs k USING (game_id)
    WHERE c.end_ts <= k.kickoff AND c.mid_close IS NOT NULL AND c.end_ts >= k.kickoff - {STALE_S}000000
    QUALIFY row_number() OVER (PARTITION BY c.ticker ORDER BY c.end_ts DESC, c.row_id DESC, c.row_tie DESC) = 1"""


def keyed_candles(t: Tables) -> DataFrame:
    return t.candles.withColumn("tie", F.struct("row_id", "row_tie"))


@query("last_before", "SELECT game_id, ticker, end_ts AS end_us, round(mid_close, 6) AS mid, round(spread_close, 6) AS width FROM last_q")
def last_before(t: Tables):
    q = qt.last_quotes(keyed_candles(t), t.kickoffs, STALE_S, "tie")
    return q.select("game_id", "ticker", us("end_ts").alias("end_us"), r6("mid_close").alias("mid"), r6("spread_close").alias("width"))


ROLE_SQL.update({
    "pairs": """SELECT p.row_id, p.event_ticker, p.day, CASE WHEN s.n = 1 THEN s.away END AS away, CASE WHEN s.n = 1 THEN s.home END AS home
        FROM parsed p LEFT JOIN splits s ON s.row_id = p.row_id AND p.d IS NOT NULL""",
    "evt": "SELECT event_ticker, min(day) AS day, min(away) AS away, min(home) AS home FROM pairs GROUP BY event_ticker",
    "matches": """SELECT e.event_ticker, e.day, CASE WHEN e.away IS NOT NULL THEN split_part(e.event_ticker, '-', 2) END AS suffix,
        CASE WHEN count(g.game_id) = 1 THEN min(g.game_id) END AS game_id,
        CASE WHEN e.away IS NULL THEN 'unparsed' WHEN count(g.game_id) = 0 THEN 'no_game' WHEN count(g.game_id) = 1 THEN 'matched' ELSE 'ambiguous' END AS status
        FROM evt e LEFT JOIN schedule g ON least(g.away_team, g.home_team) = least(e.away, e.home) AND greatest(g.away_team, g.home_team) = greatest(e.away, e.home)
          AND abs(date_diff('day', g.gameday, e.day)) <= 1 GROUP BY e.event_ticker, e.day, e.away""",
})


def matched(t: Tables) -> DataFrame:
    return qt.match_events(tickers(t).select("event_ticker").distinct(), schedule(t))


@query("match_pair_date", "SELECT event_ticker, day, suffix, game_id, status FROM matches")
def match_pair_date(t: Tables):
    return matched(t)


@query("catalog", """WITH m AS (SELECT x.*, count(*) OVER (PARTITION BY game_id) > 1 AS duplicate FROM matches x WHERE status = 'matched')
    SELECT s.game_id, s.game_type, m.status, m.event_ticker, m.duplicate FROM m JOIN schedule s USING (game_id)
    UNION ALL SELECT game_id, game_type, 'championship', NULL, NULL FROM schedule WHERE game_type IN ('CON','SB') AND game_id NOT IN (SELECT game_id FROM m)""")
def catalog(t: Tables):
    return qt.build_catalog(matched(t), schedule(t)).select("game_id", "game_type", "status", "event_ticker", "duplicate")


CHAMPS = """SELECT game_id, away_team, home_team, e.pos, e.ev AS event_ticker FROM schedule, LATERAL (SELECT 0 AS pos, 'KXNFLAFCCHAMP-' || lpad((season % 100)::VARCHAR, 2, '0') AS ev WHERE game_type = 'CON'
    UNION ALL SELECT 1, 'KXNFLNFCCHAMP-' || lpad((season % 100)::VARCHAR, 2, '0') WHERE game_type = 'CON' UNION ALL SELECT 0, 'KXSB-' || lpad(((season + 1) % 100)::VARCHAR, 2, '0') WHERE game_type = 'SB') e"""


@query("pick_two", f"""WITH c AS ({CHAMPS}), te AS (SELECT DISTINCT event_ticker FROM c),
    mk AS (SELECT event_ticker, team FROM te, (SELECT row_number() OVER (ORDER BY i) AS i, team FROM (SELECT unnest(range(32)) AS i, unnest({"[" + ", ".join(f"'{x}'" for x in tm.TEAMS) + "]"}) AS team)) tt
      WHERE NOT (event_ticker LIKE '%AFC%' AND (i - 1) % 4 = 3) AND NOT (event_ticker LIKE '%NFC%' AND (i - 1) % 4 = 0)),
    j AS (SELECT c.*, mk.team FROM c JOIN mk USING (event_ticker) WHERE mk.team = c.home_team OR mk.team = c.away_team),
    f AS (SELECT game_id, arg_min(event_ticker, pos) AS event_ticker FROM (SELECT game_id, pos, event_ticker FROM j GROUP BY ALL HAVING count(*) = 2) GROUP BY game_id)
    SELECT j.game_id, j.event_ticker, j.team FROM j JOIN f USING (game_id, event_ticker)""")
def pick_two(t: Tables):
    """Of championship events that list many teams, each game's first one with both of its teams."""
    games = schedule(t).select("game_id", "away_team", "home_team", F.posexplode(
        tm.championship_events(F.col("game_type"), F.col("season"))).alias("pos", "event_ticker"))
    listed = games.select("event_ticker").distinct().select("event_ticker", F.posexplode(F.array(*[F.lit(x) for x in tm.TEAMS])).alias("i", "team"))
    e = F.col("event_ticker")
    listed = listed.filter(~(F.contains(e, F.lit("AFC")) & (F.col("i") % 4 == 3)) & ~(F.contains(e, F.lit("NFC")) & (F.col("i") % 4 == 0)))
    return qt.pick_pair(listed.drop("i"), games).select("game_id", "event_ticker", "team")


@query("first_nonempty", """WITH c AS (SELECT g.game_id, s.pos, strftime(g.gameday, '%y') || upper(strftime(g.gameday, '%b')) || strftime(g.gameday, '%d') || CASE WHEN s.pos = 0 THEN g.away_team || g.home_team ELSE g.home_team || g.away_team END AS suffix
      FROM schedule g, (VALUES (0), (1)) s(pos) WHERE g.away_team NOT IN ('JAX','LA') AND g.home_team NOT IN ('JAX','LA')),
    r AS (SELECT DISTINCT split_part(event_ticker, '-', 2) AS suffix FROM tickers)
    SELECT game_id, arg_min(suffix, pos) AS suffix FROM c JOIN r USING (suffix) GROUP BY game_id""")
def first_nonempty(t: Tables):
    s = schedule(t).filter(~F.col("away_team").isin("JAX", "LA") & ~F.col("home_team").isin("JAX", "LA"))
    cands = s.select("game_id", F.posexplode(tm.candidate_suffixes(F.col("gameday"), F.col("away_team"), F.col("home_team"))).alias("pos", "suffix"))
    rows = tickers(t).select(F.substring_index("event_ticker", "-", -1).alias("suffix"))
    return qt.first_with_rows(cands, rows, "suffix")


@query("window_filter", """SELECT c.game_id, count(*) AS n, round(sum(c.volume), 2) AS volume FROM candles c JOIN kickoffs k USING (game_id)
    WHERE c.end_ts BETWEEN k.kickoff - 2592000000000 AND k.kickoff + 5184000000000 GROUP BY c.game_id""")
def window_filter(t: Tables):
    w = qt.near_kickoff(t.candles, t.kickoffs, "end_ts", 30 * 86400, 60 * 86400)
    return w.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("volume"), 2).alias("volume"))


def volumes(t: Tables) -> DataFrame:
    v = t.candles.groupBy("ticker").agg(F.sum("volume").alias("volume"))
    return t.contracts.join(v, "ticker")


ROLE_SQL["mkv"] = "SELECT c.*, v.volume FROM contracts c JOIN (SELECT ticker, sum(volume) AS volume FROM candles GROUP BY ticker) v USING (ticker)"


@query("dedupe_rung", """SELECT game_id, kind, side, floor(strike/4) + 0.5 AS strike, ticker, volume FROM mkv WHERE kind <> 'winner'
    QUALIFY row_number() OVER (PARTITION BY game_id, kind, side, floor(strike/4) ORDER BY volume DESC, ticker DESC) = 1""")
def dedupe_rung(t: Tables):
    m = volumes(t).filter("kind <> 'winner'").withColumn("strike", F.floor(F.col("strike") / 4) + 0.5)
    return qt.one_per_rung(m).select("game_id", "kind", "side", F.col("strike").cast("double").alias("strike"), "ticker", "volume")


@query("union_all", """SELECT game_id, 'quote' AS what, p_home AS p FROM prices UNION ALL SELECT game_id, 'minute', market FROM minutes UNION ALL SELECT game_id, 'trade', price FROM trades""")
def union_all(t: Tables):
    a = t.prices.select("game_id", F.lit("quote").alias("what"), F.col("p_home").alias("p"))
    b = t.minutes.select("game_id", F.lit("minute").alias("what"), F.col("market").alias("p"))
    c = t.trades.select("game_id", F.lit("trade").alias("what"), F.col("price").alias("p"))
    return a.unionByName(b).unionByName(c)


# ------------------------------------------------------------------ sets, sorts, limits


@query("first_row", "SELECT game_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) AS value FROM ev GROUP BY game_id")
def first_row(t: Tables):
    return t.ev.groupBy("game_id").agg(F.min("event_id").alias("event_id"), F.min_by(F.struct("event_type", "value"), "event_id").alias("r")).select(
        "game_id", "event_id", "r.event_type", "r.value")


@query("dup_report", """SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def dup_report(t: Tables):
    by_part = t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return by_part.groupBy("l_orderkey", "l_linenumber").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).filter("n > 1")


@query("set_intersect", "SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity = 50 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def set_intersect(t: Tables):
    return t.lineitem.filter("l_quantity = 50").select(F.col("l_suppkey").alias("k")).intersect(
        t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("k")))


@query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def set_except(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("k")))


@query("every_kth", "SELECT game_id, event_id FROM ev QUALIFY (row_number() OVER (PARTITION BY game_id ORDER BY event_id) - 1) % 5 = 0")
def every_kth(t: Tables):
    """Systematic sample: every fifth row of each game (the sampling operator itself)."""
    s = scan(t.ev.select("game_id", "event_id"), ["game_id"], ["event_id"], hot=t.hot_games_by_id, rn=row_number())
    return s.filter((F.col("rn") - 1) % 5 == 0).select("game_id", "event_id")


# ------------------------------------------------------------------ market tables


@query("settle_decode", "SELECT ticker, kind, side, strike, CASE result WHEN 'yes' THEN 1.0 WHEN 'no' THEN 0.0 WHEN 'scalar' THEN 0.5 END::DOUBLE AS y FROM contracts")
def settle_decode(t: Tables):
    return t.contracts.select("ticker", "kind", "side", "strike", qt.settled(F.col("result")).alias("y"))


@query("pivot_minutes", """WITH c AS (SELECT c.game_id, c.end_ts AS t, m.side, c.mid_close, c.spread_close FROM candles c JOIN contracts m USING (ticker) WHERE m.kind = 'winner' AND c.mid_close IS NOT NULL),
    w AS (SELECT game_id, t, max(CASE WHEN side = 'home' THEN mid_close END) AS h, max(CASE WHEN side = 'away' THEN mid_close END) AS a, max(spread_close) AS s FROM c GROUP BY game_id, t)
    SELECT game_id, t AS t_us, round(h, 6) AS home_mid, round(a, 6) AS away_mid, round(CASE WHEN h IS NULL THEN 1 - a WHEN a IS NULL THEN h ELSE (h + 1 - a)/2 END, 6) AS market, round(s, 6) AS spread FROM w""")
def pivot_minutes(t: Tables):
    w = qt.winner_minutes(t.candles, t.contracts)
    return w.select("game_id", us("t").alias("t_us"), *[r6(c).alias(c) for c in ("home_mid", "away_mid", "market", "spread")])


@query("orient_trades", """SELECT c.game_id, c.end_ts AS t_us, round(CASE WHEN m.side = 'home' THEN c.bid_close ELSE 1 - c.bid_close END, 6) AS price, c.volume AS "count", m.side
    FROM candles c JOIN contracts m USING (ticker) WHERE m.kind = 'winner'""")
def orient_trades(t: Tables):
    tr = t.candles.select("game_id", "ticker", F.col("end_ts").alias("ts"), F.col("bid_close").alias("yes_price"), F.col("volume").alias("count"))
    return qt.winner_trades(tr, t.contracts).select("game_id", us("ts").alias("t_us"), r6("price").alias("price"), "count", "side")


@query("rung_minutes", """SELECT c.game_id, c.ticker, c.end_ts AS t_us, round(c.mid_close, 6) AS market, m.kind, m.side, m.strike,
    CASE m.result WHEN 'yes' THEN 1.0 WHEN 'no' THEN 0.0 WHEN 'scalar' THEN 0.5 END::DOUBLE AS y FROM candles c JOIN contracts m USING (ticker)
    WHERE m.kind IN ('spread','total') AND c.mid_close IS NOT NULL AND c.spread_close <= 0.05::DOUBLE + 1e-9""")
def rung_minutes(t: Tables):
    return qt.rung_minutes(t.candles, t.contracts).select("game_id", "ticker", us("t").alias("t_us"), r6("market").alias("market"), "kind", "side", "strike", "y")


@query("bars_vwap", """SELECT game_id, epoch_us(date_trunc('day', make_timestamp(ts))) AS bar_us, count(*) AS n, sum(cnt) AS contracts, round(sum(yes_price*cnt)/sum(cnt), 6) AS vwap,
    round(arg_min(yes_price, trade_id), 6) AS open, round(max(yes_price), 6) AS high, round(min(yes_price), 6) AS low, round(arg_max(yes_price, trade_id), 6) AS last FROM trades GROUP BY game_id, bar_us""")
def bars_vwap(t: Tables):
    b = qt.bars(t.trades, ["game_id"], "1 day")
    return b.select("game_id", us("bar").alias("bar_us"), "n", "contracts", *[r6(c).alias(c) for c in ("vwap", "open", "high", "low", "last")])


@query("per_entity_timing", """SELECT game_id, round(avg(CASE WHEN snap_imputed THEN 0.0 ELSE 1.0 END), 6) AS snap_raw, min(t_snap) AS first_us, max(t_end) AS last_us
    FROM play_rows WHERE play_type IS NOT NULL GROUP BY game_id""")
def per_entity_timing(t: Tables):
    return qt.per_game_timing(t.play_rows).select("game_id", r6("snap_raw").alias("snap_raw"), us("first_snap").alias("first_us"), us("last_end").alias("last_us"))


@query("coverage", """WITH mk AS (SELECT game_id, count(*) FILTER (kind = 'winner') AS winner_markets, count(*) FILTER (kind = 'spread') AS spread_rungs, count(*) FILTER (kind = 'total') AS total_rungs,
      count(*) FILTER (kind <> 'winner' AND volume > 0) AS traded_rungs, max(CASE WHEN kind = 'winner' AND side = 'home' THEN ticker END) AS ht FROM mkv GROUP BY game_id),
    lv AS (SELECT k.game_id, count(*) FILTER (c.bid_close > 0 OR c.ask_close < 1) AS q, count(c.mid_close) AS m FROM mk JOIN kickoffs k USING (game_id)
      LEFT JOIN candles c ON c.ticker = mk.ht AND c.end_ts > k.kickoff AND c.end_ts <= k.kickoff + 8640000000000 GROUP BY k.game_id)
    SELECT mk.game_id, winner_markets, spread_rungs, total_rungs, traded_rungs, round(least(q/144000.0::DOUBLE, 1), 9) AS in_game_quote_share, round(least(m/144000.0::DOUBLE, 1), 9) AS two_sided_share,
    (SELECT count(*) FROM lineitem WHERE l_suppkey = mk.game_id AND l_linestatus = 'F') AS trades FROM mk LEFT JOIN lv USING (game_id)""")
def coverage(t: Tables):
    timing = t.kickoffs.select("game_id", F.col("kickoff").alias("first_snap"), (F.col("kickoff") + seconds(100 * 86400)).alias("last_end"))
    c = qt.coverage(volumes(t), t.candles, t.lineitem.filter("l_linestatus = 'F'").select(F.col("l_suppkey").alias("game_id")), timing)
    return c.withColumns({k: F.round(k, 9) for k in ("in_game_quote_share", "two_sided_share")})


@query("gate_report", """WITH x AS (SELECT s_suppkey AS g, (50 - s_suppkey % 10)/50.0::DOUBLE AS snap_raw, 2 - (s_suppkey % 13 = 0)::INT AS wm, (70 + s_suppkey % 31)/100.0::DOUBLE AS qs, s_acctbal > -300 AS pulled FROM supplier)
    SELECT count(*) AS played, round(avg(CASE WHEN snap_raw >= 0.9 THEN 1.0 ELSE 0.0 END), 6) AS share_timed, round(avg(CASE WHEN pulled AND wm = 2 AND qs >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS share_quoted,
    count(*) FILTER (NOT pulled) AS missing, count(*) FILTER (NOT pulled OR qs < 0.8) AS thin, false AS passed FROM x""")
def gate_report(t: Tables):
    s = F.col("s_suppkey")
    games = t.supplier.select(s.alias("game_id"))
    timing = t.supplier.select(s.alias("game_id"), ((F.lit(50) - s % 10) / 50).alias("snap_raw"))
    cov = t.supplier.filter("s_acctbal > -300").select(s.alias("game_id"), (2 - (s % 13 == 0).cast("int")).alias("winner_markets"), ((F.lit(70) + s % 31) / 100).alias("in_game_quote_share"))
    return rounded(qt.gate(games, timing, cov), ["share_timed", "share_quoted"])


@query("count_by", """SELECT kind, timing, count(*) AS n, round(avg((t - t_play_end)/1e6), 6) AS wait_s, round(avg(CASE WHEN n_sims = 0 THEN 1.0 ELSE 0.0 END), 6) AS unsimulated
    FROM prices GROUP BY GROUPING SETS ((kind), (kind, timing), ())""")
def count_by(t: Tables):
    """Counts, waits and shares by kind, by kind and timing, and overall, in one pass."""
    g = t.prices.groupingSets([["kind"], ["kind", "timing"], []], "kind", "timing")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((us("t") - us("t_play_end")) / 1e6), 6).alias("wait_s"),
                 F.round(F.avg((F.col("n_sims") == 0).cast("double")), 6).alias("unsimulated"))


@query("prior_summary", """WITH p AS (SELECT *, p_home + (game_id % 7 - 3)/100.0::DOUBLE AS prior, CASE WHEN game_id % 3 = 0 THEN 'line' ELSE 'market' END AS src FROM prices WHERE kind = 'pregame')
    SELECT count(*) AS games, count(*) FILTER (src = 'market') AS from_market, round(avg(abs(p_home - prior)), 6) AS gap_mean, round(stddev_samp(p_home - prior), 6) AS gap_sd FROM p""")
def prior_summary(t: Tables):
    p = t.prices.filter("kind = 'pregame'").withColumns({"prior": F.col("p_home") + (F.col("game_id") % 7 - 3) / 100, "src": F.when(F.col("game_id") % 3 == 0, "line").otherwise("market")})
    gap = F.col("p_home") - F.col("prior")
    return p.agg(F.count(F.lit(1)).alias("games"), F.count_if(F.col("src") == "market").alias("from_market"), F.round(F.avg(F.abs(gap)), 6).alias("gap_mean"), F.round(F.stddev_samp(gap), 6).alias("gap_sd"))


# ------------------------------------------------------------------ priors and ladders

ROLE_SQL.update({
    "totals": """SELECT q.game_id, c.strike, q.mid_close AS p, row_number() OVER (PARTITION BY q.game_id ORDER BY c.strike, q.mid_close) AS i FROM last_q q JOIN contracts c USING (ticker)
        WHERE c.kind = 'total' AND q.spread_close <= 0.1::DOUBLE + 1e-9""",
    "seg": "SELECT a.game_id, a.i AS a, b.i AS b, (SELECT avg(p) FROM totals x WHERE x.game_id = a.game_id AND x.i BETWEEN a.i AND b.i) AS m FROM totals a JOIN totals b ON b.game_id = a.game_id AND b.i >= a.i",
    "iso": """SELECT t.game_id, t.i, t.strike, (SELECT min(mx) FROM (SELECT s.a, max(s.m) AS mx FROM seg s WHERE s.game_id = t.game_id AND s.a <= t.i AND s.b >= t.i GROUP BY s.a)) AS p FROM totals t""",
    "cross50": """SELECT game_id, CASE WHEN p0 > p1 THEN k0 + (p0 - 0.5)/(p0 - p1)*(k1 - k0) ELSE k0 END AS total FROM (SELECT game_id, strike AS k0, p AS p0, lead(strike) OVER w AS k1, lead(p) OVER w AS p1 FROM iso
        WINDOW w AS (PARTITION BY game_id ORDER BY i)) WHERE p0 >= 0.5 AND p1 < 0.5""",
})


def ladders(t: Tables) -> DataFrame:
    q = qt.last_quotes(keyed_candles(t), t.kickoffs, STALE_S, "tie").join(t.contracts.select("ticker", "kind", "strike"), "ticker").filter(
        (F.col("kind") == "total") & (F.col("spread_close") <= 0.1 + 1e-9))
    # at most five totals per game
    return q.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("strike", "mid_close"))).alias("r"))


@query("isotonic_ladder", "SELECT game_id, strike, round(p, 6) AS p FROM iso")
def isotonic_ladder(t: Tables):
    z = F.arrays_zip(F.col("r.strike").alias("strike"), ds.pav_decreasing(F.col("r.mid_close")).alias("p"))
    return ladders(t).select("game_id", F.inline(z)).select("game_id", "strike", r6("p").alias("p"))


@query("ladder_median", "SELECT g.game_id, round(c.total, 6) AS total FROM (SELECT DISTINCT game_id FROM totals) g LEFT JOIN cross50 c USING (game_id)")
def ladder_median(t: Tables):
    return ladders(t).select("game_id", r6(ds.ladder_median(F.col("r.strike"), F.col("r.mid_close"))).alias("total"))


@query("priors", """WITH w AS (SELECT q.game_id, max(CASE WHEN side = 'home' THEN mid_close END) AS h, max(CASE WHEN side = 'away' THEN mid_close END) AS a, max(CASE WHEN side = 'home' THEN end_ts END) AS ht,
      max(CASE WHEN side = 'away' THEN end_ts END) AS at_ FROM last_q q JOIN contracts c USING (ticker) WHERE c.kind = 'winner' GROUP BY q.game_id),
    n AS (SELECT game_id, count(*) AS n FROM totals GROUP BY game_id)
    SELECT k.game_id, round(CASE WHEN h IS NOT NULL AND a IS NOT NULL THEN (h + 1 - a)/2 END, 6) AS home_win, round(coalesce(CASE WHEN n.n >= 2 THEN c.total END, k.total_line, 44.0), 6) AS total,
    CASE WHEN h IS NOT NULL AND a IS NOT NULL THEN 'market' ELSE 'line' END AS win_source, CASE WHEN n.n >= 2 AND c.total IS NOT NULL THEN 'market' ELSE 'line' END AS total_source,
    CASE WHEN h IS NOT NULL AND a IS NOT NULL THEN least(ht, at_) END AS quoted_us, k.spread_line AS home_spread
    FROM kickoffs k LEFT JOIN w USING (game_id) LEFT JOIN n USING (game_id) LEFT JOIN cross50 c USING (game_id)""")
def priors(t: Tables):
    p = qt.priors(keyed_candles(t), t.contracts, t.kickoffs, STALE_S, "tie")
    return p.select("game_id", r6("home_win").alias("home_win"), r6("total").alias("total"), "win_source", "total_source", us("quoted_at").alias("quoted_us"), "home_spread")


# ------------------------------------------------------------------ distributions


@query("cdf_samples", """SELECT state_id, z.z, round(avg(CASE WHEN home - away <= z.z THEN 1.0 ELSE 0.0 END), 6) AS f FROM samples, (SELECT unnest(range(-60, 61))::INT AS z) z GROUP BY state_id, z.z""")
def cdf_samples(t: Tables):
    h = ds.histogram(t.samples, ["state_id"], F.col("home") - F.col("away"), "h")
    c = h.select("state_id", F.posexplode(ds.cdf_from_hist(F.col("h"), ds.MARGIN_GRID)).alias("i", "f"))
    return c.select("state_id", (F.col("i") + ds.MARGIN_GRID[0]).alias("z"), r6("f").alias("f"))


# Phi(x) by its series x^(2j+1) / (2j+1)!!, which converges for every x of interest
PHI = """CASE WHEN abs({x}) > 9 THEN ({x} > 0)::INT::DOUBLE WHEN {x} = 0 THEN 0.5 ELSE 0.5 + sign({x}) * exp(-({x})*({x})/2) / sqrt(2*pi()) *
    (SELECT sum(exp((2*j + 1)*ln(abs({x})) - (lgamma(2*j + 2) - j*ln(2) - lgamma(j + 1)))) FROM range(250) s(j)) END"""


@query("cdf_normal", f"SELECT s_suppkey AS state_id, z.z, round({PHI.format(x='x')}, 6) AS f FROM (SELECT s_suppkey, z, (z + 0.5 - (s_suppkey % 30 - 15))/(3 + s_suppkey % 11) AS x FROM supplier, (SELECT unnest(range(-60, 61))::INT AS z) z) z")
def cdf_normal(t: Tables):
    s = F.col("s_suppkey")
    c = t.supplier.select(s.alias("state_id"), ds.cdf_normal((s % 30 - 15).cast("double"), (3 + s % 11).cast("double"), ds.MARGIN_GRID).alias("c"))
    return c.select("state_id", F.posexplode("c").alias("i", "f")).select("state_id", (F.col("i") + ds.MARGIN_GRID[0]).alias("z"), r6("f").alias("f"))


STATE_CDF = """WITH f AS (SELECT state_id, z.z, avg(CASE WHEN home - away <= z.z THEN 1.0 ELSE 0.0 END) AS f FROM samples, (SELECT unnest(range(-60, 61)) AS z) z GROUP BY ALL), y AS (SELECT s_suppkey AS state_id, s_suppkey % 41 - 20 AS y FROM supplier)"""


def state_cdf(t: Tables) -> DataFrame:
    h = ds.histogram(t.samples, ["state_id"], F.col("home") - F.col("away"), "h")
    y = t.supplier.select(F.col("s_suppkey").alias("state_id"), (F.col("s_suppkey") % 41 - 20).alias("y"))
    return h.select("state_id", ds.cdf_from_hist(F.col("h"), ds.MARGIN_GRID).alias("cdf")).join(y, "state_id")


@query("crps", STATE_CDF + " SELECT state_id, round(sum(pow(f - (z >= y)::INT, 2)), 6) AS crps FROM f JOIN y USING (state_id) GROUP BY state_id")
def crps(t: Tables):
    return state_cdf(t).select("state_id", r6(ds.crps(F.col("cdf"), ds.MARGIN_GRID, F.col("y"))).alias("crps"))


ROLE_SQL["state_pit"] = STATE_CDF + f""" SELECT y.state_id, coalesce(b.f, 0) + {uniform_sql(5, 'y.state_id')} * (a.f - coalesce(b.f, 0)) AS pit FROM y JOIN f a ON a.state_id = y.state_id AND a.z = y.y LEFT JOIN f b ON b.state_id = y.state_id AND b.z = y.y - 1"""


def state_pit(t: Tables) -> DataFrame:
    return state_cdf(t).withColumn("pit", ds.pit(F.col("cdf"), ds.MARGIN_GRID, F.col("y"), uniform(5, F.col("state_id"))))


@query("pit", "SELECT state_id, round(pit, 6) AS pit FROM state_pit")
def pit(t: Tables):
    return state_pit(t).select("state_id", r6("pit").alias("pit"))


@query("coverage_pit", "SELECT round(avg(CASE WHEN pit > 0.25 AND pit < 0.75 THEN 1.0 ELSE 0.0 END), 6) AS cov50, round(avg(CASE WHEN pit > 0.05 AND pit < 0.95 THEN 1.0 ELSE 0.0 END), 6) AS cov90 FROM state_pit")
def coverage_pit(t: Tables):
    return state_pit(t).agg(F.round(F.avg(ds.covered(F.col("pit"), 0.5)), 6).alias("cov50"), F.round(F.avg(ds.covered(F.col("pit"), 0.9)), 6).alias("cov90"))


@query("pit_hist", "SELECT floor(pit*10)::BIGINT AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM state_pit WHERE pit < 1 GROUP BY 1")
def pit_hist(t: Tables):
    """Ten equal bins; a value of exactly one falls in none."""
    h = state_pit(t).filter("pit < 1").groupBy(F.floor(F.col("pit") * 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.transform(with_row, h.agg(F.sum("n").alias("all_n"))).select("bin", "n", r6(F.col("n") / F.col("all_n")).alias("share"))


@query("quote_from_samples", """SELECT state_id, round(avg(CASE WHEN home > away THEN 1.0 WHEN home = away THEN 0.5 ELSE 0 END), 6) AS p_home, round(avg(CASE WHEN home = away THEN 1.0 ELSE 0 END), 6) AS p_tie,
    round(avg(home - away), 6) AS margin_mean, round(avg(home + away), 6) AS total_mean, round(avg(CASE WHEN home - away <= 7 THEN 1.0 ELSE 0 END), 5) AS f7, round(avg(CASE WHEN home + away <= 44 THEN 1.0 ELSE 0 END), 5) AS t44, count(*) AS n FROM samples GROUP BY state_id""")
def quote_from_samples(t: Tables):
    q = ds.quotes_from_samples(t.samples, ["state_id"])
    return q.select("state_id", *[r6(c).alias(c) for c in ("p_home", "p_tie", "margin_mean", "total_mean")],
                    F.round(F.get("cdf_margin", F.lit(67)).cast("double"), 5).alias("f7"), F.round(F.get("cdf_total", F.lit(44)).cast("double"), 5).alias("t44"), "n")


@query("price_contract", """SELECT c.ticker, round(2 * n * CASE c.kind WHEN 'winner' THEN CASE WHEN side = 'home' THEN p ELSE 1 - p END WHEN 'spread' THEN CASE WHEN side = 'home' THEN
      (SELECT avg(CASE WHEN home - away > strike THEN 1.0 ELSE 0 END) FROM samples s WHERE s.state_id = c.game_id) ELSE (SELECT avg(CASE WHEN away - home > strike THEN 1.0 ELSE 0 END) FROM samples s WHERE s.state_id = c.game_id) END
      ELSE (SELECT avg(CASE WHEN home + away > strike THEN 1.0 ELSE 0 END) FROM samples s WHERE s.state_id = c.game_id) END)::BIGINT AS half_hits
    FROM contracts c JOIN (SELECT state_id, count(*) AS n, avg(CASE WHEN home > away THEN 1.0 WHEN home = away THEN 0.5 ELSE 0 END) AS p FROM samples GROUP BY state_id) q ON q.state_id = c.game_id""")
def price_contract(t: Tables):
    """Contracts read off stored CDFs, shown as twice the number of winning samples."""
    q = ds.quotes_from_samples(t.samples, ["state_id"]).select(F.col("state_id").alias("game_id"), "p_home", "cdf_margin", "cdf_total", "n")
    p = ds.contract_price(F.col("kind"), F.col("side"), F.col("strike"), F.col("p_home"), F.col("cdf_margin"), F.col("cdf_total"))
    return t.contracts.join(q, "game_id").select("ticker", F.round(p * F.col("n") * 2).cast("bigint").alias("half_hits"))


@query("price_ladder", """SELECT c.ticker, round(avg(CASE kind WHEN 'winner' THEN CASE WHEN (CASE WHEN side = 'home' THEN home - away ELSE away - home END) > 0 THEN 1.0 WHEN home = away THEN 0.5 ELSE 0 END
      WHEN 'spread' THEN CASE WHEN (CASE WHEN side = 'home' THEN home - away ELSE away - home END) > strike THEN 1.0 ELSE 0 END ELSE CASE WHEN home + away > strike THEN 1.0 ELSE 0 END END), 9) AS price
    FROM contracts c JOIN samples s ON s.state_id = c.game_id GROUP BY c.ticker""")
def price_ladder(t: Tables):
    return ds.price_ladder(t.samples.withColumnRenamed("state_id", "game_id"), t.contracts, ["game_id"]).select("ticker", F.round("price", 9).alias("price"))


@query("median_total", """WITH l AS (SELECT state_id, k.z + 0.5 AS k, avg(CASE WHEN home + away > k.z + 0.5 THEN 1.0 ELSE 0 END) AS p FROM samples, (SELECT unnest(range(0, 161)) AS z) k GROUP BY ALL),
    n AS (SELECT *, lead(p) OVER (PARTITION BY state_id ORDER BY k) AS p1 FROM l) SELECT state_id, round(k + (p - 0.5)/(p - p1), 6) AS total FROM n WHERE p >= 0.5 AND p1 < 0.5""")
def median_total(t: Tables):
    h = ds.histogram(t.samples, ["state_id"], F.col("home") + F.col("away"), "h")
    return h.select("state_id", r6(ds.median_total(F.col("h"))).alias("total"))


@query("empirical_price", """SELECT season, round(avg(CASE WHEN m > 0 THEN 1.0 WHEN m = 0 THEN 0.5 ELSE 0 END), 6) AS winner, round(avg(CASE WHEN m > 3.5 THEN 1.0 ELSE 0 END), 6) AS spread_3, count(*) AS games FROM (
    SELECT game_id, min(season) AS season, min(final_margin_home) AS m, min(pregame_spread) AS line FROM snaps GROUP BY game_id) WHERE line BETWEEN 2.5 AND 5.5 GROUP BY season""")
def empirical_price(t: Tables):
    g = t.snaps.groupBy("game_id").agg(F.min("season").alias("season"), F.min("final_margin_home").alias("m"), F.min("pregame_spread").alias("line"))
    m = F.col("m")
    return g.filter(F.col("line").between(2.5, 5.5)).groupBy("season").agg(
        F.round(F.avg(F.when(m > 0, 1.0).when(m == 0, 0.5).otherwise(0.0)), 6).alias("winner"), F.round(F.avg((m > 3.5).cast("double")), 6).alias("spread_3"), F.count(F.lit(1)).alias("games"))


# ------------------------------------------------------------------ scored states

REC = f"""SELECT s.state_id, p.p_home AS wp, p.over AS p_over, sum(CASE WHEN z.z BETWEEN -100 AND 100 THEN pow(fm - (z.z >= ym)::INT, 2) END) AS crps_margin,
    sum(CASE WHEN z.z BETWEEN 0 AND 160 THEN pow(ft - (z.z >= yt)::INT, 2) END) AS crps_total,
    sum(CASE WHEN z.z BETWEEN -100 AND 100 THEN pow(bm - (z.z >= ym)::INT, 2) END) AS crps_margin_base, sum(CASE WHEN z.z BETWEEN 0 AND 160 THEN pow(bt - (z.z >= yt)::INT, 2) END) AS crps_total_base,
    max(CASE WHEN z.z = ym - 1 THEN fm END) AS m0, max(CASE WHEN z.z = ym THEN fm END) AS m1, max(CASE WHEN z.z = yt - 1 THEN ft END) AS t0, max(CASE WHEN z.z = yt THEN ft END) AS t1,
    max(CASE WHEN z.z = ym - 1 THEN bm END) AS bm0, max(CASE WHEN z.z = ym THEN bm END) AS bm1, max(CASE WHEN z.z = yt - 1 THEN bt END) AS bt0, max(CASE WHEN z.z = yt THEN bt END) AS bt1"""
ROLE_SQL.update({
    "st": """SELECT s_suppkey AS state_id, (s_suppkey % 15 - 7)::DOUBLE AS margin, (s_suppkey % 20 + 10)::DOUBLE AS total, CASE WHEN s_suppkey % 6 <> 0 THEN (s_suppkey % 9 - 4)::DOUBLE END AS spread,
        CASE WHEN s_suppkey % 8 <> 0 THEN (s_suppkey % 10 + 40)::DOUBLE END AS line, (s_suppkey % 10)/10.0::DOUBLE AS share_left, s_suppkey % 41 - 20 AS ym, s_suppkey % 50 + 20 AS yt FROM supplier""",
    "zz": "SELECT unnest(range(-100, 161)) AS z",
    "sz": """SELECT st.*, zz.z, (zz.z + 0.5 - (margin + coalesce(spread, 0)*share_left))/(13*sqrt(greatest(share_left, 1e-4))) AS xm, (zz.z + 0.5 - (total + coalesce(line, 44)*share_left))/(12*sqrt(greatest(share_left, 1e-4))) AS xt FROM st, zz""",
    "fz": "SELECT state_id, zz.z, avg(CASE WHEN home - away <= zz.z THEN 1.0 ELSE 0 END) AS fm, avg(CASE WHEN home + away <= zz.z THEN 1.0 ELSE 0 END) AS ft FROM samples, zz GROUP BY ALL",
    "pz": "SELECT s.state_id, avg(CASE WHEN home > away THEN 1.0 WHEN home = away THEN 0.5 ELSE 0 END) AS p_home, avg(CASE WHEN home + away > coalesce(line, 44) THEN 1.0 ELSE 0 END) AS over FROM samples s JOIN st USING (state_id) GROUP BY s.state_id",
    "rec0": REC + f" FROM (SELECT *, {PHI.format(x='xm')} AS bm, {PHI.format(x='xt')} AS bt FROM sz) s JOIN fz z ON z.state_id = s.state_id AND z.z = s.z JOIN pz p ON p.state_id = s.state_id GROUP BY s.state_id, p.p_home, p.over",
    "rec": f"""SELECT *, m0 + v1*(m1 - m0) AS pit_margin, t0 + v2*(t1 - t0) AS pit_total, bm0 + v1*(bm1 - bm0) AS pit_margin_base, bt0 + v2*(bt1 - bt0) AS pit_total_base
        FROM (SELECT *, {uniform_sql(21, 'state_id')} AS v1, {uniform_sql(22, 'state_id')} AS v2 FROM rec0)""",
})


def records(t: Tables) -> DataFrame:
    s = F.col("s_suppkey")
    st = t.supplier.select(
        s.alias("state_id"), (s % 15 - 7).cast("double").alias("margin"), (s % 20 + 10).cast("double").alias("total"),
        F.when(s % 6 != 0, (s % 9 - 4).cast("double")).alias("spread"), F.when(s % 8 != 0, (s % 10 + 40).cast("double")).alias("line"),
        (s % 10 / 10).alias("share_left"), (s % 41 - 20).alias("y_margin"), (s % 50 + 20).alias("y_total"))
    return ds.forecast_record(st, t.samples, "state_id", F.lit(13.0), F.lit(12.0), uniform(21, F.col("state_id")), uniform(22, F.col("state_id")))


RECORD_COLUMNS = ["wp", "p_over", "crps_margin", "crps_total", "crps_margin_base", "crps_total_base", "pit_margin", "pit_total", "pit_margin_base", "pit_total_base"]


@query("forecast_eval", f"SELECT state_id, {cols6(RECORD_COLUMNS)} FROM rec")
def forecast_eval(t: Tables):
    return records(t).select("state_id", *[r6(c).alias(c) for c in RECORD_COLUMNS])


COV = ", ".join(f"avg(CASE WHEN pit_{w}{b} > {lo} AND pit_{w}{b} < {1 - lo} THEN 1.0 ELSE 0.0 END) AS {w}{b}_cov{n}" for w in ("margin", "total") for b in ("", "_base") for lo, n in ((0.25, 50), (0.05, 90)))
CR = ", ".join(f"avg(crps_{w}{b}) AS {w}{b}_crps" for w in ("margin", "total") for b in ("", "_base"))
GATE_DOUBLES = [f"{w}{b}_{x}" for w in ("margin", "total") for b in ("", "_base") for x in ("cov50", "cov90", "crps")] + ["wp_mae", "ll_sim", "ll_direct"]


@query("gate_verdict", f"""WITH r AS (SELECT *, 0.5 + (state_id % 40 - 20)/100.0::DOUBLE AS d, (state_id % 3 = 0)::INT AS y FROM rec),
    g AS (SELECT count(*) AS states, {COV}, {CR}, avg(abs(wp - d)) AS wp_mae, avg(-(y*ln(wp) + (1-y)*ln(1-wp))) AS ll_sim, avg(-(y*ln(d) + (1-y)*ln(1-d))) AS ll_direct FROM r),
    o AS (SELECT *, abs(margin_cov50 - 0.5) <= 0.03 AND abs(margin_cov90 - 0.9) <= 0.03 AND abs(total_cov50 - 0.5) <= 0.03 AND abs(total_cov90 - 0.9) <= 0.03 AS ok_coverage,
      margin_crps < margin_base_crps AND total_crps < total_base_crps AS ok_crps, wp_mae <= 0.03 AND ll_sim <= ll_direct + 0.01 AS ok_wp FROM g)
    SELECT states, {cols6(GATE_DOUBLES)}, ok_coverage, ok_crps, ok_wp, ok_coverage AND ok_crps AND ok_wp AS passed FROM o""")
def gate_verdict(t: Tables):
    d = 0.5 + (F.col("state_id") % 40 - 20) / 100
    return rounded(ds.gate_verdict(records(t), d, (F.col("state_id") % 3 == 0).cast("int")), GATE_DOUBLES)


# ------------------------------------------------------------------ rung grid and price log

RUNGS = """SELECT game_id, t, event_id AS rung_id, (k + 0.5::DOUBLE)/101 AS market, CASE WHEN event_id % 2 = 0 THEN 'spread' ELSE 'total' END AS kind, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'home' ELSE 'away' END END AS side,
    CASE WHEN event_id % 2 = 0 THEN k % 20 - 9.5 ELSE k % 60 + 20.5 END::DOUBLE AS strike, game_id * 100 + k % 7 AS ticker, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS y FROM ev WHERE event_type = 'view'"""
LOGIT = "1/(1 + exp(-({z} - ({mu}))/{s}))"
ROLE_SQL.update({
    "rungs": RUNGS,
    "rg0": """SELECT r.*, s.kickoff, s.t_final FROM rungs r JOIN spans s USING (game_id) WHERE r.t >= s.kickoff AND r.t < s.t_final AND r.y IS NOT NULL""",
    "rg1": "SELECT g.* FROM rg0 g ASOF LEFT JOIN held5 h ON g.game_id = h.game_id AND g.t >= h.start WHERE h.stop IS NULL OR g.t >= h.stop",
    "rg2": f"""SELECT g.*, q.ord, q.n_sims, CASE WHEN g.kind = 'total' THEN 1 - {LOGIT.format(z='floor(strike)', mu='q.p_home*80', s='9.0::DOUBLE')}
        WHEN g.side = 'home' THEN 1 - {LOGIT.format(z='floor(strike)', mu='(q.p_home - 0.5)*40', s='8.0::DOUBLE')} ELSE {LOGIT.format(z='(-floor(strike) - 1)', mu='(q.p_home - 0.5)*40', s='8.0::DOUBLE')} END AS model
        FROM rg1 g ASOF LEFT JOIN quotes5 q ON g.game_id = q.game_id AND g.t >= q.t_known""",
    "rung_grid_t": "SELECT *, CASE WHEN n_sims > 0 THEN model*(1 - model)/n_sims ELSE 0 END AS var_mc FROM rg2",
})


def rungs(t: Tables) -> DataFrame:
    i, k = F.col("event_id"), F.col("k")
    spread = i % 2 == 0
    return t.ev.filter(F.col("event_type") == "view").select(
        "game_id", "t", i.alias("rung_id"), ((k + 0.5) / 101).alias("market"), F.when(spread, "spread").otherwise("total").alias("kind"),
        F.when(spread, F.when(i % 3 == 0, "home").otherwise("away")).alias("side"), F.when(spread, k % 20 - 9.5).otherwise(k % 60 + 20.5).cast("double").alias("strike"),
        (F.col("game_id") * 100 + k % 7).alias("ticker"), F.when(i % 5 == 0, None).when(i % 5 == 1, 0.5).when(i % 5 == 2, 0.0).otherwise(1.0).alias("y"))


def prices_with_cdfs(t: Tables) -> DataFrame:
    """The price log with a logistic margin and total distribution per quote."""
    def logistic(grid, mu, scale):
        return F.transform(F.sequence(F.lit(grid[0]), F.lit(grid[1])), lambda z: 1 / (1 + F.exp(-(z - mu) / scale)))

    return t.prices.withColumns({"cdf_margin": logistic(ds.MARGIN_GRID, (F.col("p_home") - 0.5) * 40, 8.0),
                                 "cdf_total": logistic(ds.TOTAL_GRID, F.col("p_home") * 80, 9.0)})


def rung_table(t: Tables) -> DataFrame:
    return ev.rung_grid(prices_with_cdfs(t), rungs(t), 5.0, hot=t.hot_games)


@query("rung_grid", "SELECT game_id, rung_id, kind, ord AS quote_order, round(model, 6) AS model, round(var_mc, 9) AS var_mc, y FROM rung_grid_t")
def rung_grid(t: Tables):
    return rung_table(t).select("game_id", "rung_id", "kind", F.col("order").alias("quote_order"), r6("model").alias("model"), F.round("var_mc", 9).alias("var_mc"), "y")


@query("rung_score", f"""WITH sc AS (SELECT * FROM ({paired_sql('rung_grid_t', ['kind'])})), n AS (SELECT kind, count(DISTINCT ticker) AS contracts FROM rung_grid_t GROUP BY kind) SELECT sc.*, n.contracts FROM sc JOIN n USING (kind)""")
def rung_score(t: Tables):
    return rounded(ev.rung_accuracy(rung_table(t), N_BOOT), PAIR_DOUBLES)


@query("price_log", """SELECT r.game_id, r."order", r.kind, r.t_us, CASE WHEN r.kind = 'final' THEN 0 ELSE 2000 END AS n_sims, round(CASE WHEN r.kind = 'final' THEN CASE WHEN r.home_score > r.away_score THEN 1.0 WHEN r.home_score = r.away_score THEN 0.5 ELSE 0.0 END ELSE q.p END, 6) AS p_home, round(q.m, 6) AS margin_mean
    FROM replayed r LEFT JOIN (SELECT state_id, avg(CASE WHEN home > away THEN 1.0 WHEN home = away THEN 0.5 ELSE 0 END) AS p, avg(home - away) AS m FROM samples GROUP BY state_id) q ON q.state_id = r.game_id % 100""")
def price_log(t: Tables):
    """Replay events with the quote of their state: the typed rows that the price log stores."""
    e = rp.replay_events(t.play_rows, rp.end_bounds(t.play_rows), t.hot_games_by_id).withColumn("state_id", F.col("game_id") % 100)
    q = ds.quotes_from_samples(t.samples, ["state_id"]).drop("hm", "ht", "n")
    log = rp.price_frame(e.join(q, "state_id", "left"))
    return log.select("game_id", "order", "kind", us("t").alias("t_us"), "n_sims", r6("p_home").alias("p_home"), r6("margin_mean").alias("margin_mean"))


# ------------------------------------------------------------------ series


@query("score_changes", "SELECT game_id, seq, home_score_pre, home_score_post FROM play_rows WHERE home_score_pre <> home_score_post OR away_score_pre <> away_score_post")
def score_changes(t: Tables):
    return t.play_rows.filter("home_score_pre <> home_score_post OR away_score_pre <> away_score_post").select("game_id", "seq", "home_score_pre", "home_score_post")


@query("event_relative", """WITH a AS (SELECT game_id, min(t) AS t0 FROM ev WHERE event_type = 'error' GROUP BY game_id),
    r AS (SELECT x.game_id, x.ts, x.price, (x.ts - a.t0)/1e6 AS s FROM trades x JOIN a USING (game_id) WHERE x.ts >= a.t0)
    SELECT game_id, count(*) AS n, round(min(s), 6) AS first_s, round(min(CASE WHEN price > 0.6 THEN s END), 6) AS cross_s FROM r GROUP BY game_id""")
def event_relative(t: Tables):
    """Trades in seconds from each game's anchor event, and the lag until the price first passes a level."""
    anchor = t.ev.filter("event_type = 'error'").groupBy("game_id").agg(F.min("t").alias("t0"))
    s = (us("ts") - us("t0")) / 1e6
    r = t.trades.join(anchor, "game_id").filter(F.col("ts") >= F.col("t0"))
    return r.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min(s), 6).alias("first_s"), F.round(F.min(F.when(F.col("price") > 0.6, s)), 6).alias("cross_s"))


@query("series_pair", "SELECT game_id, t AS t_us, 'model' AS source, round(p_home, 6) AS p FROM prices UNION ALL SELECT game_id, t, 'market', round(market, 6) FROM minutes")
def series_pair(t: Tables):
    a = t.prices.select("game_id", us("t").alias("t_us"), F.lit("model").alias("source"), r6("p_home").alias("p"))
    return a.unionByName(t.minutes.select("game_id", us("t").alias("t_us"), F.lit("market").alias("source"), r6("market").alias("p")))
