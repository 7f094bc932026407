"""Late-game diagnostics, conditional aggregates and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inplay.operators import bootstrap as bs, distributions as ds, evaluate as ev, late as lt, pools as pl
from inplay.operators.replay import nearest_quantile
from inplay.plans import drives as dp
from inplay.plans.evaluation import PAIR_DOUBLES, rounded
from inplay.plans.registry import ROLE_SQL, query
from inplay.plans.roles import Tables, r6, us
from inplay.plans.sqlkit import N_BOOT, asof_tables, boot_ctes, brier, cols6, interval_sql, mc_var, paired_sql, q05, q95

for _d in (0, 20):
    ROLE_SQL[f"lgrid{_d}"] = f"""SELECT g.*, p.phase, p.timing, p.posteam_is_home, p.down, p.yardline_100, p.home_score - p.away_score AS margin,
        abs(p.home_score - p.away_score) <= 8 AS "close", (g.t - g.t_known)/1e6 AS age FROM grid{_d} g JOIN prices p ON p.game_id = g.game_id AND p.ord = g.ord"""
EXCESS = f"({brier('model')} - var_mc - {brier('market')})"
ROLE_SQL["late0"] = "SELECT * FROM lgrid0 WHERE qtr = 4 AND game_seconds_remaining <= 300"


def grid(t: Tables, delta: float = 0.0) -> DataFrame:
    return lt.grid(t.prices, t.minutes, delta, t.hot_games)


@query("quote_age", """SELECT game_id, t AS t_us, margin, "close", phase, round(age, 6) AS age FROM lgrid20""")
def quote_age(t: Tables):
    return grid(t, 20.0).select("game_id", us("t").alias("t_us"), "margin", "close", "phase", r6("age").alias("age"))


@query("gap_by_window", paired_sql("""(SELECT * FROM (SELECT *, unnest(['all', CASE WHEN "close" THEN 'close' ELSE 'not_close' END]) AS "which" FROM (SELECT *, unnest([CASE WHEN game_seconds_remaining > 600 AND game_seconds_remaining <= 900 THEN '15:00 to 10:00' END,
    CASE WHEN game_seconds_remaining > 300 AND game_seconds_remaining <= 600 THEN '10:00 to 5:00' END, CASE WHEN game_seconds_remaining > 120 AND game_seconds_remaining <= 300 THEN '5:00 to 2:00' END,
    CASE WHEN game_seconds_remaining > -1 AND game_seconds_remaining <= 120 THEN '2:00 to 0:00' END, CASE WHEN game_seconds_remaining <= 300 THEN 'last 5 minutes' END]) AS "window" FROM lgrid0 WHERE qtr = 4)) WHERE "window" IS NOT NULL)""",
    ['"window"', '"which"']))
def gap_by_window(t: Tables):
    return rounded(lt.gap_by_window(grid(t), N_BOOT), PAIR_DOUBLES)


@query("topk_excess", f"""WITH pg AS (SELECT game_id, sum({EXCESS}) AS excess, count(*) AS minutes, min(y) AS y FROM late0 GROUP BY game_id),
    tt AS (SELECT sum(excess) AS excess_total, count(*) AS games, count(*) FILTER (excess > 0) AS positive_games FROM pg)
    SELECT game_id, round(excess, 6) AS excess, minutes, y, round(excess_total, 6) AS excess_total, games, positive_games, round(excess/excess_total, 4) AS share FROM pg, tt ORDER BY pg.excess DESC, game_id LIMIT 10""")
def topk_excess(t: Tables):
    c = lt.concentration(lt.late(grid(t)))
    return c.withColumn("share", F.round("share", 4)).withColumns({k: r6(k) for k in ("excess", "excess_total")})


@query("staleness", f"""WITH b AS (SELECT *, CASE WHEN a2 <= 15 THEN 'up to 15 s' WHEN a2 <= 30 THEN '15 to 30 s' WHEN a2 <= 60 THEN '30 to 60 s' ELSE 'over 60 s' END AS bucket FROM (SELECT *, age/1000 AS a2 FROM lgrid0 WHERE qtr = 4))
    SELECT bucket, count(*) AS rows, round(avg({EXCESS}), 6) AS gap, round(count(*) / (SELECT count(*) FROM b), 6) AS share FROM b GROUP BY bucket""")
def staleness(t: Tables):
    """Fourth-quarter minutes by age of the price (thousands of seconds here: quotes are hours apart)."""
    return rounded(lt.staleness(grid(t).filter("qtr = 4").withColumn("age", F.col("age") / 1000)), ["gap", "share"])


ROLE_SQL["nxt_ev"] = """SELECT game_id, ord, lead(kind) OVER w AS nxt_kind, lead(t_play_end) OVER w AS nxt_end, lead(t) OVER w AS nxt_public FROM prices WINDOW w AS (PARTITION BY game_id ORDER BY ord)"""


@query("waiting_for", f"""WITH w AS (SELECT g.*, CASE WHEN g.event_kind = 'snap' THEN CASE WHEN nxt_end IS NULL OR g.t < nxt_end THEN 'play under way' WHEN g.t < nxt_public THEN 'held by the rules' ELSE 'feed delay' END
      WHEN nxt_public IS NOT NULL AND g.t >= nxt_public THEN 'feed delay' WHEN phase = 'snap' THEN 'between plays' WHEN phase = 'kickoff' THEN 'kickoff' WHEN phase = 'pat' THEN 'try' ELSE 'other' END AS waiting
      FROM lgrid20 g LEFT JOIN nxt_ev n ON n.game_id = g.game_id AND n.ord = g.ord)
    SELECT waiting, count(*) AS rows, round(sum({EXCESS}), 5) AS excess_sum FROM w GROUP BY waiting""")
def waiting_for(t: Tables):
    log = lt.with_next_event(t.prices, t.hot_games)
    rows = ev.in_game(t.prices, t.minutes).filter(F.col("spread") <= 0.05 + 1e-9)
    g = ev.priced(log, rows, 20.0, columns=(*ev.QUOTE_COLUMNS, "phase", "nxt_end", "nxt_public"), hot=t.hot_games)
    g = g.withColumnRenamed("p_home", "model").withColumn("var_mc", ev.mc_var(F.col("model"), F.col("p_tie"), F.col("n_sims")))
    w = lt.waiting_for(F.col("t"), F.col("kind"), F.col("phase"), F.col("nxt_end"), F.col("nxt_public"))
    return g.groupBy(w.alias("waiting")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(ev.excess()), 5).alias("excess_sum"))


ROLE_SQL.update({
    "oracle_log": """SELECT game_id, ord, kind, CASE WHEN kind IN ('play','final') THEN t_play_end ELSE t END AS t, CASE WHEN swap THEN np ELSE p_home END AS p_home, CASE WHEN swap THEN nt ELSE p_tie END AS p_tie,
        CASE WHEN swap THEN nn ELSE n_sims END AS n_sims FROM (SELECT *, lead(p_home) OVER w AS np, lead(p_tie) OVER w AS nt, lead(n_sims) OVER w AS nn,
        kind = 'play' AND phase = 'snap' AND coalesce(lead(kind) OVER w = 'snap', false) AS swap FROM prices WINDOW w AS (PARTITION BY game_id ORDER BY ord))""",
})
asof_tables(0, "oracle_log", "cf")


@query("counterfactual", f"""WITH j AS (SELECT g.game_id, {brier('q.p_home')} - CASE WHEN q.n_sims > 0 THEN greatest(q.p_home*(1 - q.p_home) - 0.25::DOUBLE*q.p_tie, 0)/q.n_sims ELSE 0 END - {brier('market')} AS d1, {EXCESS} AS d0, q.p_home AS pc, g.model
      FROM (SELECT * EXCLUDE (p_tie, n_sims) FROM lgrid0 WHERE qtr >= 3) g ASOF LEFT JOIN quotescf0 q ON q.game_id = g.game_id AND g.t >= q.t_known),
    l AS (SELECT game_id, 'gap' AS what, d1 AS v FROM j UNION ALL SELECT game_id, 'change', d1 - d0 FROM j UNION ALL SELECT game_id, 'moved', CASE WHEN abs(pc - model) > 1e-9 THEN 1.0 ELSE 0.0 END FROM j),
    {interval_sql('l', 'v', ['what'])} SELECT what, {cols6(['mean', 'p05', 'p95'])}, rows, games FROM iv""")
def counterfactual(t: Tables):
    """The gap if the next snap's clock were known at the whistle and no ruling delayed a result."""
    base = grid(t).filter("qtr >= 3")
    cf = lt.fast_timing(lt.oracle_clock(t.prices, t.hot_games))
    return rounded(lt.counterfactual(base, cf, 0.0, N_BOOT, t.hot_games), ["mean", "p05", "p95"])


CLOCK = """SELECT *, game_seconds_remaining - ng AS runoff, np - p_home AS jump, home_score - away_score AS margin, (np - p_home)*sign(home_score - away_score) AS to_leader FROM (
    SELECT *, lead(kind) OVER w AS nk, lead(p_home) OVER w AS np, lead(game_seconds_remaining) OVER w AS ng FROM prices WINDOW w AS (PARTITION BY game_id ORDER BY ord)) WHERE kind = 'play' AND phase = 'snap' AND nk = 'snap'"""


@query("lead_pairs", f"""WITH p AS ({CLOCK}), j AS (SELECT qtr, abs(jump) AS aj, row_number() OVER (PARTITION BY qtr ORDER BY abs(jump)) AS i, count(*) OVER (PARTITION BY qtr) AS n FROM p)
    SELECT p.qtr, count(*) AS pairs, round(median(runoff), 6) AS runoff_median, round(avg(runoff), 6) AS runoff_mean, round(avg(abs(jump)), 6) AS abs_jump_mean,
    round(avg(CASE WHEN margin <> 0 THEN to_leader END), 6) AS to_leader_mean, round((SELECT min(aj) FROM j WHERE j.qtr = p.qtr AND j.i > floor(0.9::DOUBLE*(j.n - 1) + 0.5)), 6) AS abs_jump_p90 FROM p GROUP BY p.qtr""")
def lead_pairs(t: Tables):
    """Plays followed by a snap: clock run off and price jump per quarter (exact median and nearest p90)."""
    p = lt.clock_pairs(t.prices, t.hot_games).withColumn("aj", F.abs("jump"))
    a = p.groupBy("qtr").agg(F.count(F.lit(1)).alias("pairs"), r6(F.avg("runoff")).alias("runoff_mean"), r6(F.avg("aj")).alias("abs_jump_mean"),
                             r6(F.avg(F.when(F.col("margin") != 0, F.col("to_leader")))).alias("to_leader_mean"))
    med = ds.exact_quantile(p, ["qtr"], "runoff", 0.5, "m").select("qtr", r6("m").alias("runoff_median"))
    p90 = nearest_quantile(p, "qtr", "aj", 0.9, "q").select("qtr", r6("q").alias("abs_jump_p90"))
    return a.join(med, "qtr").join(p90, "qtr")


ROLE_SQL["moments"] = f"""SELECT s.*, s.p_home AS model, x.price AS market, (s.t - x.ts)/1e6 AS trade_age, home_score - away_score AS margin, {mc_var()} AS var_mc, abs(home_score - away_score) <= 8 AS "close"
    FROM (SELECT p.*, sp.y, p.t - 1000000 AS tg FROM prices p JOIN spans sp USING (game_id) WHERE kind = 'snap' AND qtr = 4) s ASOF JOIN trades x ON x.game_id = s.game_id AND s.tg >= x.ts"""


def moments(t: Tables) -> DataFrame:
    return lt.snap_moments(t.prices, t.trades, ev.spans(t.prices), t.hot_games)


@query("snap_score", f"""WITH w AS (SELECT *, unnest(['all', CASE WHEN game_seconds_remaining <= 300 THEN 'last 5 minutes' END, CASE WHEN game_seconds_remaining <= 300 AND "close" THEN 'last 5 minutes, close' END]) AS w FROM moments)
    SELECT w AS "window", count(*) AS rows, round(avg({brier('model')} - var_mc), 6) AS brier_model, round(avg({brier('market')}), 6) AS brier_market, round(median(trade_age), 6) AS age_median FROM w WHERE w IS NOT NULL GROUP BY w""")
def snap_score(t: Tables):
    gsr = F.col("game_seconds_remaining")
    s = lt.labelled(moments(t), "window", [("all", F.lit(True)), ("last 5 minutes", gsr <= 300), ("last 5 minutes, close", (gsr <= 300) & F.col("close"))])
    y = F.col("y")
    a = s.groupBy("window").agg(F.count(F.lit(1)).alias("rows"), r6(F.avg((F.col("model") - y) ** 2 - F.col("var_mc"))).alias("brier_model"),
                                r6(F.avg((F.col("market") - y) ** 2)).alias("brier_market"))
    return a.join(ds.exact_quantile(s, ["window"], "trade_age", 0.5, "m").select("window", r6("m").alias("age_median")), "window")


AGAINST = ["won", "model", "market", "brier_diff", "game_won", "game_model", "game_market", "model_minus_won_p05", "model_minus_won_p95",
           "market_minus_won_p05", "market_minus_won_p95", "game_model_minus_won_p05", "game_model_minus_won_p95"]


def against_sql(source: str, group: str) -> str:
    return f"""st AS (SELECT {group}, game_id, *, 1.0::DOUBLE AS one, won/n AS e_won, pm/n AS e_pm, pk/n AS e_pk FROM (SELECT {group}, game_id, count(*)::DOUBLE AS n, sum(won) AS won, sum(p_model) AS pm, sum(p_market) AS pk,
      sum({brier('p_model', 'won')} - var_mc - {brier('p_market', 'won')}) AS bd FROM {source} GROUP BY {group}, game_id)),
    {boot_ctes('st', [group], ['n', 'won', 'pm', 'pk', 'bd', 'one', 'e_won', 'e_pm'])},
    tot AS (SELECT {group}, sum(n)::BIGINT AS rows, count(*) AS games, sum(won)/sum(n) AS won, sum(pm)/sum(n) AS model, sum(pk)/sum(n) AS market, sum(bd)/sum(n) AS brier_diff, avg(e_won) AS game_won, avg(e_pm) AS game_model, avg(e_pk) AS game_market FROM st GROUP BY {group}),
    bd AS (SELECT {group}, {q05('(pm-won)/n')} AS model_minus_won_p05, {q95('(pm-won)/n')} AS model_minus_won_p95, {q05('(pk-won)/n')} AS market_minus_won_p05, {q95('(pk-won)/n')} AS market_minus_won_p95,
      {q05('(e_pm-e_won)/one')} AS game_model_minus_won_p05, {q95('(e_pm-e_won)/one')} AS game_model_minus_won_p95 FROM reps GROUP BY {group})
    SELECT {group}, rows, games, {cols6(AGAINST)} FROM tot JOIN bd USING ({group})"""


SIDE = "CASE WHEN {h} THEN y ELSE 1 - y END AS won, CASE WHEN {h} THEN model ELSE 1 - model END AS p_model, CASE WHEN {h} THEN market ELSE 1 - market END AS p_market"


@query("equal_weight", f"""WITH v AS (SELECT *, 'leader' AS side, {SIDE.format(h='margin > 0')} FROM moments WHERE margin <> 0), {against_sql('v', 'side')}""")
def equal_weight(t: Tables):
    """Leaders at the snap: snaps weighted equally and games weighted equally."""
    v = lt.leader_view(moments(t)).withColumn("side", F.lit("leader"))
    return rounded(lt.against_outcome(v, ["side"], N_BOOT), AGAINST)


SPOTS = [("tied or down 1-3", "om BETWEEN -3 AND 0"), ("tied or down 1-2, in field-goal range", "om BETWEEN -2 AND 0 AND yardline_100 <= 35"), ("tied or down 1-2, outside field-goal range", "om BETWEEN -2 AND 0 AND yardline_100 > 35"),
         ("down 3", "om = -3"), ("down 4-8", "om BETWEEN -8 AND -4"), ("ahead 1-8", "om BETWEEN 1 AND 8")]
OFF = ", ".join(f"CASE WHEN {c} AND {g} THEN '{n} {s}' END" for n, c in (("last 2 minutes, offense", "game_seconds_remaining <= 120"),
                ("5:00 to 2:00, offense", "game_seconds_remaining > 120 AND game_seconds_remaining <= 300")) for s, g in SPOTS)
LEADS = ", ".join(f"CASE WHEN {c} AND ld BETWEEN {a} AND {b} THEN '{n}, lead {a}-{b}' END" for n, c, a, b in (
    ("last 5 minutes", "game_seconds_remaining <= 300", 1, 3), ("last 5 minutes", "game_seconds_remaining <= 300", 4, 8), ("last 5 minutes", "game_seconds_remaining <= 300", 9, 16),
    ("15:00 to 5:00", "game_seconds_remaining > 300", 1, 3), ("15:00 to 5:00", "game_seconds_remaining > 300", 4, 8)))


@query("situations", f"""WITH v AS (SELECT * FROM (SELECT game_id, unnest([{LEADS}]) AS situation, won, p_model, p_market, var_mc FROM (SELECT *, abs(margin) AS ld, {SIDE.format(h='margin > 0')} FROM moments WHERE margin <> 0)
      UNION ALL SELECT game_id, unnest([{OFF}]), won, p_model, p_market, var_mc FROM (SELECT *, CASE WHEN posteam_is_home THEN margin ELSE -margin END AS om, {SIDE.format(h='posteam_is_home')} FROM moments WHERE posteam_is_home IS NOT NULL)) WHERE situation IS NOT NULL),
    {against_sql('v', 'situation')}""")
def situations(t: Tables):
    return rounded(lt.against_outcome(lt.situations(moments(t)), ["situation"], N_BOOT), AGAINST)


SLOPE = "(sxy - sx*sy/n)/(sxx - sx*sx/n)"


@query("surprise_reg", f"""WITH pre AS (SELECT game_id, (p_home - 0.5)*20 AS pre_margin FROM prices WHERE kind = 'pregame'),
    d AS (SELECT g.game_id, (margin - pre_margin*(3600 - game_seconds_remaining)/3600)/7 AS x, y - model AS rm, y - market AS rk FROM lgrid0 g JOIN pre USING (game_id) WHERE qtr = 4),
    l AS (SELECT game_id, 'model' AS who, x, rm AS r FROM d UNION ALL SELECT game_id, 'market', x, rk FROM d),
    st AS (SELECT who, game_id, count(*)::DOUBLE AS n, sum(x) AS sx, sum(r) AS sy, sum(x*x) AS sxx, sum(x*r) AS sxy FROM l GROUP BY who, game_id),
    {boot_ctes('st', ['who'], ['n', 'sx', 'sy', 'sxx', 'sxy'])},
    f AS (SELECT who, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM st GROUP BY who)
    SELECT f.who, f.n::BIGINT AS rows, round({SLOPE.replace('sx', 'f.sx').replace('sy', 'f.sy').replace('/n', '/f.n')}, 6) AS slope, (SELECT round({q05(SLOPE)}, 6) FROM reps r WHERE r.who = f.who) AS p05, (SELECT round({q95(SLOPE)}, 6) FROM reps r WHERE r.who = f.who) AS p95 FROM f""")
def surprise_reg(t: Tables):
    p = t.prices.withColumn("margin_mean", (F.col("p_home") - 0.5) * 20)
    return rounded(lt.surprise(grid(t).filter("qtr = 4"), p, N_BOOT), ["slope", "p05", "p95"])


@query("comeback_split", f"""WITH g AS (SELECT * FROM lgrid0 WHERE qtr = 4),
    pg AS (SELECT game_id, sum({EXCESS}) AS excess, count(*) AS minutes, arg_min(margin, t) AS m0, min(y) AS y FROM g GROUP BY game_id)
    SELECT CASE WHEN m0 = 0 THEN 'tied' WHEN (m0 > 0 AND y = 1) OR (m0 < 0 AND y = 0) THEN 'leader held on' ELSE 'leader did not win' END AS how, count(*) AS games, sum(minutes)::BIGINT AS minutes, round(sum(excess), 6) AS excess,
    round(sum(excess)/sum(minutes), 6) AS excess_per_minute, count(*) FILTER (excess > 0) AS positive_games FROM pg GROUP BY how""")
def comeback_split(t: Tables):
    return rounded(lt.comebacks(grid(t).filter("qtr = 4")), ["excess", "excess_per_minute"])


# ------------------------------------------------------------------ conditional aggregates


@query("cond_means", """SELECT year(l_shipdate)::BIGINT AS season, count(*) AS attempts, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS made, round(avg(l_quantity), 6) AS distance,
    round(avg(CASE WHEN l_quantity BETWEEN 40 AND 49 THEN CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END END), 6) AS made_40_49, count(*) FILTER (l_quantity >= 50) AS long_attempts,
    round(avg(CASE WHEN l_linenumber = 4 THEN CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END END), 6) AS go_rate FROM lineitem GROUP BY season""")
def cond_means(t: Tables):
    """Season trends: conditional rates and counts in one aggregation instead of three joined ones."""
    made, q = (F.col("l_returnflag") == "R").cast("double"), F.col("l_quantity")
    return t.lineitem.groupBy(F.year("l_shipdate").cast("bigint").alias("season")).agg(
        F.count(F.lit(1)).alias("attempts"), r6(F.avg(made)).alias("made"), r6(F.avg(q)).alias("distance"), r6(F.avg(F.when(q.between(40, 49), made))).alias("made_40_49"),
        F.count_if(q >= 50).alias("long_attempts"), r6(F.avg(F.when(F.col("l_linenumber") == 4, (F.col("l_linestatus") == "O").cast("double")))).alias("go_rate"))


@query("first_in_window", """WITH f AS (SELECT * FROM snap_rows WHERE qtr = 4 AND game_seconds_remaining <= 600 AND abs(score_diff) <= 8 AND result IS NOT NULL QUALIFY row_number() OVER (PARTITION BY game_id, fixed_drive ORDER BY seq) = 1)
    SELECT season, count(*) AS drives, round(avg(CASE WHEN result IN ('td0','td1','td2') THEN 1.0 ELSE 0 END), 6) AS touchdown, round(avg(CASE WHEN result = 'punt' THEN 1.0 ELSE 0 END), 6) AS punt,
    count(*) FILTER (score_diff BETWEEN -3 AND 0) AS close_drives, round(avg(CASE WHEN score_diff BETWEEN -3 AND 0 THEN CASE WHEN result IN ('td0','td1','td2','fg') THEN 1.0 ELSE 0 END END), 6) AS close_scored FROM f GROUP BY season""")
def first_in_window(t: Tables):
    s = dp.snap_rows(t).filter("result IS NOT NULL")
    f = lt.first_in_window(s, (F.col("qtr") == 4) & (F.col("game_seconds_remaining") <= 600) & (F.abs("score_diff") <= 8))
    r, near = F.col("result"), F.col("score_diff").between(-3, 0)
    rate = lambda c: r6(F.avg(c.cast("double")))
    return f.groupBy("season").agg(F.count(F.lit(1)).alias("drives"), rate(r.isin("td0", "td1", "td2")).alias("touchdown"), rate(r == "punt").alias("punt"),
                                   F.count_if(near).alias("close_drives"), r6(F.avg(F.when(near, r.isin("td0", "td1", "td2", "fg").cast("double")))).alias("close_scored"))


@query("any_after_first", """WITH s AS (SELECT game_id, fixed_drive, min(seq) AS seq0 FROM snaps WHERE ydstogo <= 3 AND yardline_100 <= 60 GROUP BY ALL)
    SELECT s.game_id, s.fixed_drive, s.seq0, bool_or(x.play_type = 'purchase') AS hit FROM s JOIN snaps x ON x.game_id = s.game_id AND x.fixed_drive = s.fixed_drive AND x.seq >= s.seq0 GROUP BY ALL""")
def any_after_first(t: Tables):
    return lt.any_after_first(t.snaps, (F.col("ydstogo") <= 3) & (F.col("yardline_100") <= 60), F.col("play_type") == "purchase", ["game_id", "fixed_drive"])


@query("pattern_then", """WITH a AS (SELECT game_id, posteam, min(seq) AS first_seq FROM play_rows WHERE play_type = 'punt' AND qtr >= 2 AND posteam IS NOT NULL GROUP BY ALL)
    SELECT a.game_id, a.posteam, a.first_seq, min(b.seq) AS then_seq FROM a JOIN play_rows b ON b.game_id = a.game_id AND b.posteam = a.posteam AND b.play_type = 'run' AND b.seq > a.first_seq GROUP BY ALL""")
def pattern_then(t: Tables):
    return lt.pattern_then(t.play_rows.filter("posteam IS NOT NULL"), (F.col("play_type") == "punt") & (F.col("qtr") >= 2), F.col("play_type") == "run")


@query("poisson_binomial", """WITH RECURSIVE p AS (SELECT l_orderkey AS g, l_quantity/(l_quantity + 7.3::DOUBLE) AS p, l_returnflag = 'R' AS hit,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS i FROM lineitem),
    d AS (SELECT g, 0 AS i, 0 AS h, 1.0::DOUBLE AS m FROM (SELECT DISTINCT g FROM p) UNION ALL
      SELECT d.g, d.i + 1, d.h + x.x, d.m * CASE WHEN x.x = 1 THEN p.p ELSE 1 - p.p END FROM d JOIN p ON p.g = d.g AND p.i = d.i + 1, (VALUES (0), (1)) x(x)),
    n AS (SELECT g, max(i) AS n, count(*) FILTER (WHERE hit) AS k FROM p GROUP BY g)
    SELECT d.g, n.n, n.k::INT AS k, round(sum(CASE WHEN h >= k THEN m ELSE 0 END), 9) AS p_as_many FROM d JOIN n ON n.g = d.g AND d.i = n.n GROUP BY d.g, n.n, n.k""")
def poisson_binomial(t: Tables):
    """P(as many returns as there were, or more) per order from its lines' chances."""
    chance = F.col("l_quantity") / (F.col("l_quantity") + 7.3)
    p = ds.tail_by_group(t.lineitem.withColumnRenamed("l_orderkey", "g"), ["g"], chance, F.count_if(F.col("l_returnflag") == "R"), "p_as_many")
    return p.withColumn("p_as_many", F.round("p_as_many", 9))


@query("cond_median", """SELECT l_returnflag AS flag, count(*) AS snaps, count(DISTINCT l_orderkey) AS games, round(median(l_extendedprice), 4) AS price_median, min(l_extendedprice) AS price_min FROM lineitem WHERE l_quantity <= 10 GROUP BY flag""")
def cond_median(t: Tables):
    """Exact medians by value counts, distinct games by a two-step count."""
    s = t.lineitem.filter("l_quantity <= 10").select(F.col("l_returnflag").alias("flag"), "l_orderkey", "l_extendedprice")
    g = s.groupBy("flag", "l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("lo")).groupBy("flag").agg(
        F.sum("n").alias("snaps"), F.count(F.lit(1)).alias("games"), F.min("lo").alias("price_min"))
    return g.join(ds.exact_quantile(s, ["flag"], "l_extendedprice", 0.5, "m").select("flag", F.round("m", 4).alias("price_median")), "flag")


@query("pool_vs_now", """WITH k AS (SELECT bucket, season < 2005 AS pool, same, yardline FROM kicks)
    SELECT bucket, count(*) FILTER (pool) AS pool_kicks, round(avg(CASE WHEN pool THEN same::INT END), 6) AS pool_keeps, round(avg(CASE WHEN pool AND NOT same THEN yardline END), 6) AS pool_start,
    count(*) FILTER (NOT pool) AS season_kicks, round(avg(CASE WHEN NOT pool THEN same::INT END), 6) AS season_keeps, round(avg(CASE WHEN NOT pool AND NOT same THEN yardline END), 6) AS season_start FROM k GROUP BY bucket""")
def pool_vs_now(t: Tables):
    k = pl.kick_pool(dp.drives(t)).withColumn("pool", F.col("season") < 2005)
    same = F.col("same").cast("int")

    def side(name, cond):
        return [F.count_if(cond).alias(f"{name}_kicks"), r6(F.avg(F.when(cond, same))).alias(f"{name}_keeps"), r6(F.avg(F.when(cond & ~F.col("same"), F.col("yardline")))).alias(f"{name}_start")]

    return k.groupBy("bucket").agg(*side("pool", F.col("pool")), *side("season", ~F.col("pool")))


@query("try_calib", """WITH td AS (SELECT *, ((least(greatest(l, -16), 16) + 16)*2 + late::INT)::BIGINT AS ctx, substr(result, 3, 1)::INT AS pts FROM (SELECT *, (CASE WHEN offense = home_team THEN home_pre - away_pre ELSE away_pre - home_pre END + 6)::BIGINT AS l,
      half = 'Half2' AND end_gsr <= 900 AS late FROM drives WHERE result IN ('td0','td1','td2'))),
    pt AS (SELECT c AS ctx, q AS pts, ((SELECT count(*) FROM td WHERE season < 2005 AND ctx = c AND pts = q) + 20 * (SELECT count(*) FROM td WHERE season < 2005 AND pts = q) / (SELECT count(*) FROM td WHERE season < 2005)) / ((SELECT count(*) FROM td WHERE season < 2005 AND ctx = c) + 20) AS p FROM range(66) a(c), range(3) b(q)),
    now AS (SELECT *, CASE WHEN l < 0 THEN 'trailing' WHEN l <= 2 THEN 'level' ELSE 'leading' END AS lead_band FROM td WHERE season = 2005)
    SELECT lead_band, pt.pts::INT AS points, count(*) AS touchdowns, round(avg(pt.p), 6) AS predicted, round(avg((now.pts = pt.pts)::INT), 6) AS actual FROM now JOIN pt ON pt.ctx = now.ctx GROUP BY lead_band, pt.pts""")
def try_calib(t: Tables):
    """Tries of the season against the shrunk table of earlier seasons, by the scorer's lead."""
    td = pl.tries(dp.drives(t)).withColumn("ctx", pl.pat_context(F.col("lead6"), F.col("late")))
    table = pl.shrunk_table(td.filter("season < 2005"), "ctx", "points", 66, 3)
    now = td.filter("season = 2005").select("ctx", F.col("points").alias("got"), F.when(F.col("lead6") < 0, "trailing").when(F.col("lead6") <= 2, "level").otherwise("leading").alias("lead_band"))
    return now.join(table, "ctx").groupBy("lead_band", "points").agg(
        F.count(F.lit(1)).alias("touchdowns"), r6(F.avg("p")).alias("predicted"), r6(F.avg((F.col("got") == F.col("points")).cast("int"))).alias("actual"))


@query("season_drift", """WITH s AS (SELECT season, avg(p - label) AS v FROM forecasts WHERE qtr = 4 AND p BETWEEN 0.2 AND 0.8 GROUP BY season)
    SELECT round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM s""")
def season_drift(t: Tables):
    s = t.forecasts.filter("qtr = 4 AND p BETWEEN 0.2 AND 0.8").groupBy("season").agg(F.avg(F.col("p") - F.col("label")).alias("v"))
    return rounded(lt.season_drift(s, "v"), ["mean", "sd", "lo", "hi"])


@query("band_calib", f"""WITH f AS (SELECT game_id, seq, unnest(['all', CASE WHEN d < 40 THEN 'under 40 yards' END, CASE WHEN d BETWEEN 40 AND 49 THEN '40-49 yards' END, CASE WHEN d >= 50 THEN '50+ yards' END]) AS band, made - share AS v, made, share FROM (
      SELECT *, yardline_100 % 45 + 17 AS d, (result = 'fg')::INT::DOUBLE AS made, (0.95 - (yardline_100 % 45)/100.0)::DOUBLE AS share FROM snap_rows WHERE result IN ('fg', 'punt'))),
    g AS (SELECT * FROM f WHERE band IS NOT NULL), {interval_sql('g', 'v', ['band'])}, m AS (SELECT band, avg(made) AS made, avg(share) AS model FROM g GROUP BY band)
    SELECT band, rows AS kicks, games, {cols6(['made', 'model', 'mean', 'p05', 'p95'])} FROM iv JOIN m USING (band)""")
def band_calib(t: Tables):
    """Made against modelled share of kicks by distance band, with intervals."""
    d = F.col("yardline_100") % 45 + 17
    s = dp.snap_rows(t).filter(F.col("result").isin("fg", "punt")).withColumns({
        "made": (F.col("result") == "fg").cast("double"), "share": 0.95 - (F.col("yardline_100") % 45) / 100})
    g = lt.labelled(s, "band", [("all", F.lit(True)), ("under 40 yards", d < 40), ("40-49 yards", d.between(40, 49)), ("50+ yards", d >= 50)])
    iv = bs.interval(g, F.col("made") - F.col("share"), groups=["band"], n_boot=N_BOOT)
    m = g.groupBy("band").agg(F.avg("made").alias("made"), F.avg("share").alias("model"))
    return rounded(iv.withColumnRenamed("rows", "kicks").join(m, "band"), ["made", "model", "mean", "p05", "p95"])
