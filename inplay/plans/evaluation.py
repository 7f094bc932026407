"""As-of joins, paired scores, bootstrap, information test, event study, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inplay.operators import bootstrap as bs, evaluate as ev, metrics as mt
from inplay.operators.asof import asof_join, model_asof, outside_intervals, reviews, seconds
from inplay.plans.registry import query
from inplay.plans.roles import Tables, r6, us
from inplay.plans.sqlkit import (N_BOOT, STAGE, boot_ctes, brier, cols6, interval_sql, log_loss, mc_var, paired_sql, weight_ctes,
                                 q05, q95)
from inplay.operators.onerow import with_row

PAIR_DOUBLES = ["brier_model", "brier_model_corrected", "brier_market", "log_loss_model", "log_loss_market",
                "brier_diff", "brier_corrected_diff", "log_loss_diff", "brier_diff_p05", "brier_diff_p95",
                "brier_corrected_diff_p05", "brier_corrected_diff_p95", "log_loss_diff_p05", "log_loss_diff_p95"]


def rounded(df: DataFrame, names) -> DataFrame:
    return df.withColumns({c: r6(c) for c in names})


def staged(g: DataFrame) -> DataFrame:
    return g.withColumn("stage", ev.stage(F.col("qtr"), F.col("game_seconds_remaining")))


@query("paired_score", paired_sql(f"(SELECT *, {STAGE} AS stage FROM grid5)", ["stage"]))
def paired_score(t: Tables):
    g = staged(ev.winner_grid(t.prices, t.minutes, 5.0, hot=t.hot_games))
    return rounded(ev.paired(g, ["stage"], n_boot=N_BOOT), PAIR_DOUBLES)


@query("asof_quote", """SELECT m.game_id, m.t AS t_us, q.ord AS quote_order, round(q.p_home, 6) AS p_home, q.t_known AS known_us
    FROM minutes m ASOF LEFT JOIN quotes5 q ON m.game_id = q.game_id AND m.t >= q.t_known""")
def asof_quote(t: Tables):
    j = model_asof(t.prices, t.minutes.select("game_id", "t"), 5.0, hot=t.hot_games)
    return j.select("game_id", us("t").alias("t_us"), F.col("order").alias("quote_order"), r6("p_home").alias("p_home"),
                    us("t_known").alias("known_us"))


@query("interval_exclude", """SELECT g.game_id, g.t AS t_us, round(g.market, 6) AS market FROM minutes g
    ASOF LEFT JOIN held10 h ON g.game_id = h.game_id AND g.t >= h.start WHERE h.stop IS NULL OR g.t >= h.stop""")
def interval_exclude(t: Tables):
    kept = outside_intervals(t.minutes, reviews(t.prices, 10.0), hot=t.hot_games)
    return kept.select("game_id", us("t").alias("t_us"), r6("market").alias("market"))


@query("asof_guard", """SELECT s.game_id, s.ord AS snap_order, round(x.price, 6) AS price, round((s.t - x.ts)/1e6, 6) AS trade_age
    FROM (SELECT *, t - 1000000 AS tg FROM prices WHERE kind = 'snap') s
    ASOF JOIN trades x ON s.game_id = x.game_id AND s.tg >= x.ts""")
def asof_guard(t: Tables):
    """Last trade at least one second before each snap, and its age."""
    s = t.prices.filter("kind = 'snap'").select("game_id", "order", "t", (F.col("t") - seconds(1)).alias("tg"))
    j = asof_join(s, t.trades, ["game_id"], "tg", "ts", tie="trade_id", columns=["price", "ts"], hot=t.hot_games)
    j = j.filter(F.col("ts").isNotNull())
    return j.select("game_id", F.col("order").alias("snap_order"), r6("price").alias("price"),
                    F.round((us("t") - us("ts")) / 1e6, 6).alias("trade_age"))


@query("asof_forward", """SELECT round(avg(CASE WHEN x.ts - m.t <= 3600000000 THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS moves
    FROM (SELECT * FROM prices WHERE kind = 'play' AND game_id IN (SELECT game_id FROM trades)) m
    ASOF LEFT JOIN trades x ON m.game_id = x.game_id AND m.t <= x.ts""")
def asof_forward(t: Tables):
    """Share of plays after which a trade followed within the hour."""
    return rounded(ev.traded_within(t.prices.filter("kind = 'play'"), t.trades, 3600.0, t.hot_games), ["share"])


@query("in_span", """SELECT game_id, count(*) AS minutes, round(sum(market), 6) AS market FROM in_game GROUP BY game_id""")
def in_span(t: Tables):
    return ev.in_game(t.prices, t.minutes).groupBy("game_id").agg(
        F.count(F.lit(1)).alias("minutes"), F.round(F.sum("market"), 6).alias("market"))


@query("spans", """SELECT game_id, kickoff AS kickoff_us, t_final AS final_us, y, final_margin, final_total FROM spans""")
def spans(t: Tables):
    return ev.spans(t.prices).select("game_id", us("kickoff").alias("kickoff_us"), us("t_final").alias("final_us"), "y",
                                     "final_margin", "final_total")


@query("mc_var", f"SELECT game_id, ord AS quote_order, round({mc_var()}, 9) AS var_mc FROM prices")
def mc_var_query(t: Tables):
    return t.prices.select("game_id", F.col("order").alias("quote_order"), F.round(
        ev.mc_var(F.col("p_home"), F.col("p_tie"), F.col("n_sims")), 9).alias("var_mc"))


@query("winner_grid", """SELECT game_id, t AS t_us, ord AS quote_order, round(market, 6) AS market, round(model, 6) AS model, y,
    round(var_mc, 9) AS var_mc FROM grid5""")
def winner_grid(t: Tables):
    return ev.winner_grid(t.prices, t.minutes, 5.0, hot=t.hot_games).select(
        "game_id", us("t").alias("t_us"), F.col("order").alias("quote_order"), r6("market").alias("market"),
        r6("model").alias("model"), "y", F.round("var_mc", 9).alias("var_mc"))


WINDOWS = (("15:00 to 10:00", 600, 900), ("10:00 to 5:00", 300, 600), ("5:00 to 2:00", 120, 300),
           ("2:00 to 0:00", -1, 120))  # fixed values: clock windows (lo, hi]


def windowed(g: DataFrame) -> DataFrame:
    """One row per row and window it falls in; windows overlap, so labels are exploded."""
    gsr = F.col("game_seconds_remaining")
    labels = [F.when((gsr > lo) & (gsr <= hi), name) for name, lo, hi in WINDOWS]
    labels += [F.when(gsr <= 300, "last 5 minutes")]
    return g.withColumn("window", F.explode(F.filter(F.array(*labels), lambda x: x.isNotNull())))


WINDOWED_SQL = """(SELECT * FROM (SELECT *, unnest([CASE WHEN game_seconds_remaining > 600 AND game_seconds_remaining <= 900 THEN '15:00 to 10:00' END,
    CASE WHEN game_seconds_remaining > 300 AND game_seconds_remaining <= 600 THEN '10:00 to 5:00' END,
    CASE WHEN game_seconds_remaining > 120 AND game_seconds_remaining <= 300 THEN '5:00 to 2:00' END,
    CASE WHEN game_seconds_remaining > -1 AND game_seconds_remaining <= 120 THEN '2:00 to 0:00' END,
    CASE WHEN game_seconds_remaining <= 300 THEN 'last 5 minutes' END]) AS "window" FROM {source}) WHERE "window" IS NOT NULL)"""


@query("paired_by_window", paired_sql(WINDOWED_SQL.format(source="grid0"), ['"window"']))
def paired_by_window(t: Tables):
    g = windowed(ev.winner_grid(t.prices, t.minutes, 0.0, hot=t.hot_games))
    return rounded(ev.paired(g, ["window"], n_boot=N_BOOT), PAIR_DOUBLES)


@query("subset_score", paired_sql("""(SELECT *, w AS "which" FROM grid0, (VALUES ('direct', false), ('direct_last5', true)) v(w, late)
    WHERE wp_direct_home IS NOT NULL AND (NOT late OR game_seconds_remaining <= 300))""", ['"which"'],
    "wp_direct_home", "0.0::DOUBLE"))
def subset_score(t: Tables):
    """The direct model on the minutes it can price, and on the last five minutes of those."""
    g = ev.winner_grid(t.prices, t.minutes, 0.0, hot=t.hot_games).filter("wp_direct_home IS NOT NULL")
    late = F.col("game_seconds_remaining") <= 300
    g = g.withColumn("which", F.explode(F.filter(F.array(F.lit("direct"), F.when(late, "direct_last5")),
                                                 lambda x: x.isNotNull())))
    return rounded(ev.paired(g, ["which"], model="wp_direct_home", var=None, n_boot=N_BOOT), PAIR_DOUBLES)


DELTA_GRID = "(" + " UNION ALL ".join(
    f"SELECT {d}.0::DOUBLE AS delta, * FROM grid{d}" for d in (0, 5, 10, 20)) + ")"


@query("delta_sweep", paired_sql(DELTA_GRID, ["delta"]))
def delta_sweep(t: Tables):
    """Scores at four feed delays in one pass."""
    return rounded(ev.paired(ev.sweep(t.prices, t.minutes, hot=t.hot_games), ["delta"], n_boot=N_BOOT), PAIR_DOUBLES)


# ------------------------------------------------------------------ metrics


@query("calib_table", """SELECT qtr, CAST(round_even(p/0.05, 0) AS BIGINT) AS bin_no, sum(w) AS n_plays, sum(w*label) AS n_wins,
    round(sum(w*label)/sum(w), 6) AS actual, round(abs(round_even(p/0.05, 0)*0.05 - sum(w*label)/sum(w)), 6) AS cal_diff
    FROM forecasts GROUP BY qtr, round_even(p/0.05, 0) HAVING sum(w) > 0""")
def calib_table(t: Tables):
    c = mt.calibration_table(t.forecasts, "p", "label", "qtr", weight="w")
    return c.select("qtr", "bin_no", "n_plays", "n_wins", r6("actual").alias("actual"), r6("cal_diff").alias("cal_diff"))


CELLS = """SELECT {g} qtr, round_even(p/0.05, 0)*0.05 AS bin, sum({w}) AS n, sum({w}*label) AS wins FROM forecasts GROUP BY {g} qtr, bin"""
PER_Q = """SELECT {g} qtr, sum(abs(bin - wins/n)*n)/sum(n) AS err, sum(wins) AS wins FROM cells WHERE n > 0 GROUP BY {g} qtr"""


@query("calib_error", f"""WITH cells AS ({CELLS.format(g='season,', w='1.0::DOUBLE')}), pq AS ({PER_Q.format(g='season,')})
    SELECT season, round(sum(err*wins)/sum(wins), 6) AS calibration_error FROM pq GROUP BY season""")
def calib_error(t: Tables):
    c = mt.calibration_table(t.forecasts, "p", "label", "qtr", ["season"])
    return rounded(mt.calibration_error(c, ["season"]), ["calibration_error"])


@query("log_loss", f"""SELECT qtr, round(avg({log_loss('p', 'label', '1e-15')}), 6) AS log_loss,
    round(avg({log_loss('p', 'label')}), 6) AS log_loss_clipped FROM forecasts GROUP BY qtr""")
def log_loss_query(t: Tables):
    p, y = F.col("p"), F.col("label")
    return t.forecasts.groupBy("qtr").agg(F.round(F.avg(mt.log_loss_row(p, y)), 6).alias("log_loss"),
                                          F.round(F.avg(mt.log_loss_row(p, y, 0.01)), 6).alias("log_loss_clipped"))


@query("brier_error", f"""SELECT qtr, round(sum(w*{brier('p', 'label')})/sum(w), 6) AS brier,
    round(sum(w*CASE WHEN (p > 0.5) <> (label = 1) THEN 1.0 ELSE 0.0 END)/sum(w), 6) AS error_rate FROM forecasts GROUP BY qtr""")
def brier_error(t: Tables):
    p, y, w = F.col("p"), F.col("label"), F.col("w")
    return t.forecasts.groupBy("qtr").agg(F.round(mt.weighted_mean(mt.brier_row(p, y), w), 6).alias("brier"),
                                          F.round(mt.weighted_mean(mt.wrong_row(p, y), w), 6).alias("error_rate"))


@query("metric_summary", f"""WITH cells AS ({CELLS.format(g='', w='1.0::DOUBLE')}), pq AS ({PER_Q.format(g='')})
    SELECT round((SELECT sum(err*wins)/sum(wins) FROM pq), 6) AS calibration_error,
    round(avg({log_loss('p', 'label', '1e-15')}), 6) AS log_loss, round(avg({brier('p', 'label')}), 6) AS brier,
    round(avg(CASE WHEN (p > 0.5) <> (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS error_rate, count(*) AS n FROM forecasts""")
def metric_summary(t: Tables):
    return rounded(mt.summary(t.forecasts, "p", "label", "qtr"),
                   ["calibration_error", "log_loss", "brier", "error_rate"])


# ------------------------------------------------------------------ bootstrap


@query("boot_weights", f"""WITH st AS (SELECT DISTINCT game_id FROM ev), {weight_ctes('st')} SELECT * FROM wt""")
def boot_weights(t: Tables):
    return bs.weights(t.ev, "game_id", N_BOOT).select(F.col("rep").cast("bigint").alias("rep"), "game_id", "w")


BOOT_STATS = "SELECT game_id, count(*)::DOUBLE AS n, sum(value) AS sx FROM ev GROUP BY game_id"


@query("boot_spread", f"""WITH st AS ({BOOT_STATS}), {boot_ctes('st', [], ['n', 'sx'], prefix='a_', method='multinomial')},
    {boot_ctes('st', [], ['n', 'sx'], prefix='b_', method='poisson')}
    SELECT 'multinomial' AS method, round(stddev_samp(sx/n), 6) AS m_sd, round(avg(sx/n), 6) AS m_mean,
      round({q05('sx/n')}, 6) AS m_p05, round({q95('sx/n')}, 6) AS m_p95 FROM a_reps
    UNION ALL SELECT 'poisson', round(stddev_samp(sx/n), 6), round(avg(sx/n), 6), round({q05('sx/n')}, 6),
      round({q95('sx/n')}, 6) FROM b_reps""")
def boot_spread(t: Tables):
    stats = bs.entity_sums(t.ev, "game_id", n=F.lit(1.0), sx=F.col("value"))
    out = None
    for method in ("multinomial", "poisson"):
        reps = bs.resample(stats, "game_id", ["n", "sx"], N_BOOT, method=method)
        one = bs.spread(reps, m=F.col("sx") / F.col("n")).select(F.lit(method).alias("method"), "*")
        out = one if out is None else out.unionByName(one)
    return rounded(out, ["m_sd", "m_mean", "m_p05", "m_p95"])


@query("boot_paired", f"""WITH st AS (SELECT game_id, count(*)::DOUBLE AS n, sum({brier('model')}) AS ba, sum({brier('market')}) AS bb,
      sum({log_loss('model', eps='1e-15')}) AS la, sum({log_loss('market', eps='1e-15')}) AS lb FROM grid0 WHERE y <> 0.5 GROUP BY game_id),
    {boot_ctes('st', [], ['n', 'ba', 'bb', 'la', 'lb'])},
    tot AS (SELECT (sum(ba)-sum(bb))/sum(n) AS brier_diff, (sum(la)-sum(lb))/sum(n) AS log_loss_diff FROM st),
    bd AS (SELECT {q05('(ba-bb)/n')} AS brier_p05, {q95('(ba-bb)/n')} AS brier_p95, {q05('(la-lb)/n')} AS log_loss_p05,
      {q95('(la-lb)/n')} AS log_loss_p95 FROM reps)
    SELECT {cols6(['brier_diff', 'brier_p05', 'brier_p95', 'log_loss_diff', 'log_loss_p05', 'log_loss_p95'])} FROM tot, bd""")
def boot_paired(t: Tables):
    """Differences of two forecasts' scores with common resamples."""
    g = ev.winner_grid(t.prices, t.minutes, 0.0, hot=t.hot_games).filter("y <> 0.5")
    y = F.col("y")
    stats = bs.entity_sums(g, "game_id", n=F.lit(1.0), ba=mt.brier_row(F.col("model"), y),
                           bb=mt.brier_row(F.col("market"), y), la=mt.log_loss_row(F.col("model"), y),
                           lb=mt.log_loss_row(F.col("market"), y))
    d = {"brier": (F.col("ba") - F.col("bb")) / F.col("n"), "log_loss": (F.col("la") - F.col("lb")) / F.col("n")}
    tot = stats.agg(((F.sum("ba") - F.sum("bb")) / F.sum("n")).alias("brier_diff"),
                    ((F.sum("la") - F.sum("lb")) / F.sum("n")).alias("log_loss_diff"))
    reps = bs.resample(stats, "game_id", ["n", "ba", "bb", "la", "lb"], N_BOOT)
    band = bs.spread(reps, **d).drop("brier_sd", "brier_mean", "log_loss_sd", "log_loss_mean")
    out = tot.transform(with_row, band)
    return rounded(out, out.columns)


CALIB_CELLS = """SELECT game_id, least(qtr, 4) AS q, who, round_even(p/0.05, 0)*0.05 AS bin, count(*)::DOUBLE AS n, sum(y) AS wins
    FROM (SELECT game_id, qtr, y, 'market' AS who, market AS p FROM grid0 WHERE y <> 0.5
      UNION ALL SELECT game_id, qtr, y, 'model', model FROM grid0 WHERE y <> 0.5) GROUP BY ALL"""


@query("calib_paired", f"""WITH cells AS ({CALIB_CELLS}),
    tot AS (SELECT who, sum(err*w)/nullif(sum(w), 0) AS e FROM (SELECT who, q, sum(abs(bin - wins/n)*n)/sum(n) AS err, sum(wins) AS w
      FROM (SELECT who, q, bin, sum(n) AS n, sum(wins) AS wins FROM cells GROUP BY ALL) GROUP BY ALL) GROUP BY who),
    gm AS (SELECT DISTINCT game_id FROM cells),
    {weight_ctes('gm')},
    rc AS (SELECT rep, who, q, bin, sum(w*n) AS n, sum(w*wins) AS wins FROM cells JOIN wt USING (game_id) GROUP BY ALL),
    re AS (SELECT rep, who, sum(err*w)/nullif(sum(w), 0) AS e FROM (SELECT rep, who, q, sum(abs(bin - wins/n)*n)/sum(n) AS err, sum(wins) AS w
      FROM rc GROUP BY ALL) GROUP BY ALL),
    df AS (SELECT rep, max(CASE WHEN who = 'market' THEN e END) - max(CASE WHEN who = 'model' THEN e END) AS d FROM re GROUP BY rep)
    SELECT round(max(CASE WHEN who = 'market' THEN e END), 6) AS market, round(max(CASE WHEN who = 'model' THEN e END), 6) AS model,
    round((SELECT {q05('d')} FROM df), 6) AS diff_p05, round((SELECT {q95('d')} FROM df), 6) AS diff_p95 FROM tot""")
def calib_paired(t: Tables):
    """Calibration error of market and model with common resamples; per-game cells, not rows, are
    reweighted, so a replicate costs one row per cell."""
    g = ev.winner_grid(t.prices, t.minutes, 0.0, hot=t.hot_games).filter("y <> 0.5")
    both = g.select("game_id", F.least("qtr", F.lit(4)).alias("q"), "y", F.explode(F.array(
        F.struct(F.lit("market").alias("who"), F.col("market").alias("p")),
        F.struct(F.lit("model").alias("who"), F.col("model").alias("p")))).alias("f")).select("*", "f.*")
    cells = both.groupBy("game_id", "who", "q", F.rint(F.col("p") / mt.BIN).alias("b")).agg(
        F.sum(F.lit(1.0)).alias("n_plays"), F.sum("y").alias("n_wins")).persist()

    def error(c: DataFrame, groups: list[str]) -> DataFrame:
        tab = c.groupBy(*groups, F.col("q").alias("qtr"), "b").agg(F.sum("n_plays").alias("n_plays"),
                                                                   F.sum("n_wins").alias("n_wins"))
        tab = tab.withColumn("cal_diff", F.abs(F.col("b") * mt.BIN - F.col("n_wins") / F.col("n_plays")))
        e = mt.calibration_error(tab, groups)
        rest = [x for x in groups if x != "who"]
        return e.groupBy(*rest).agg(*[F.max(F.when(F.col("who") == x, F.col("calibration_error"))).alias(x)
                                      for x in ("market", "model")])

    reps = bs.resample(cells, "game_id", ["n_plays", "n_wins"], N_BOOT, ["who", "q", "b"])
    band = error(reps, ["rep", "who"]).agg(
        F.percentile(F.col("market") - F.col("model"), F.lit(0.05)).alias("diff_p05"),
        F.percentile(F.col("market") - F.col("model"), F.lit(0.95)).alias("diff_p95"))
    out = error(cells, ["who"]).transform(with_row, band)
    return rounded(out, out.columns)


@query("long_shots", """WITH d AS (SELECT game_id, market AS price, y AS won, model FROM grid0 WHERE y <> 0.5 AND market < 0.1
      UNION ALL SELECT game_id, 1 - market, 1 - y, 1 - model FROM grid0 WHERE y <> 0.5 AND market > 1 - 0.1::DOUBLE)
    SELECT count(*) AS minutes, round(avg(price), 6) AS price, round(avg(won), 6) AS won, round(avg(model), 6) AS model,
    count(DISTINCT game_id) AS games, (SELECT sum(m)::BIGINT FROM (SELECT max(won) AS m FROM d GROUP BY game_id)) AS games_won FROM d""")
def long_shots(t: Tables):
    return rounded(ev.long_shots(ev.winner_grid(t.prices, t.minutes, 0.0, hot=t.hot_games)), ["price", "won", "model"])


# ------------------------------------------------------------------ regressions

WLS = """cxx AS (SELECT *, sxx - sx*sx/n AS vxx, scc - sc*sc/n AS vcc, sxc - sx*sc/n AS vxc, sxy - sx*sy/n AS vxy, scy - sc*sy/n AS vcy FROM {src}),
    dt AS (SELECT *, vxx*vcc - vxc*vxc AS det, vxx*vcc - vxc*vxc > 1e-12*vxx*vcc AS ok, (vxx + vcc)*(vxx + vcc) AS s2 FROM cxx),
    sol AS (SELECT *, CASE WHEN ok THEN (vxy*vcc - vcy*vxc)/det WHEN s2 > 0 THEN (vxx*vxy + vxc*vcy)/s2 ELSE 0 END AS bx,
      CASE WHEN ok THEN (vcy*vxx - vxy*vxc)/det WHEN s2 > 0 THEN (vxc*vxy + vcc*vcy)/s2 ELSE 0 END AS bc FROM dt)"""


@query("wls3", """WITH m AS (SELECT season, sum(w) AS n, sum(w*x) AS sx, sum(w*c) AS sc, sum(w*x*x) AS sxx, sum(w*x*c) AS sxc,
      sum(w*c*c) AS scc, sum(w*y) AS sy, sum(w*x*y) AS sxy, sum(w*c*y) AS scy
      FROM (SELECT year(l_shipdate)::BIGINT AS season, l_quantity AS x, l_discount AS c, l_extendedprice/1000 AS y,
        (1 + l_linenumber % 3)::DOUBLE AS w FROM lineitem) GROUP BY season), """ + WLS.format(src="m") + """
    SELECT season, round((sy - bx*sx - bc*sc)/n, 6) AS intercept, round(bx, 6) AS slope_x, round(bc, 6) AS slope_c FROM sol""")
def wls3(t: Tables):
    """Weighted least squares on (1, x, c) per season."""
    d = t.lineitem.select(F.year("l_shipdate").cast("bigint").alias("season"), F.col("l_quantity").alias("x"),
                          F.col("l_discount").alias("c"), (F.col("l_extendedprice") / 1000).alias("y"),
                          (F.lit(1) + F.col("l_linenumber") % 3).cast("double").alias("w"))
    x, c, y, w = (F.col(n) for n in "xcyw")
    terms = dict(n=w, sx=w * x, sc=w * c, sxx=w * x * x, sxc=w * x * c, scc=w * c * c, sy=w * y, sxy=w * x * y, scy=w * c * y)
    m = d.groupBy("season").agg(*[F.sum(e).alias(n) for n, e in terms.items()])
    b0, bx, bc = ev.solve3(*[F.col(n) for n in ev.MOMENTS])
    return m.select("season", r6(b0).alias("intercept"), r6(bx).alias("slope_x"), r6(bc).alias("slope_c"))


# daily means stand in for the one-minute grid: shifts need equally spaced rows
ROLE = """SELECT game_id, h * 60000000 AS t, avg(model) AS model, avg(market) AS market, max(t_final) AS t_final
    FROM (SELECT *, t // 86400000000 AS h FROM grid0) GROUP BY game_id, h"""


def daily_grid(t: Tables) -> DataFrame:
    """Daily means of the grid, one day mapped to one minute, so that rows are equally spaced."""
    day = F.floor(us("t") / 86400000000)
    g = ev.winner_grid(t.prices, t.minutes, 0.0, hot=t.hot_games)
    return g.groupBy("game_id", day.alias("h")).agg(F.avg("model").alias("model"), F.avg("market").alias("market"),
                                                    F.max("t_final").alias("t_final")).withColumn(
        "t", F.timestamp_micros(F.col("h") * 60000000)).drop("h")


PAIRS_SQL = f"""dg AS ({ROLE}),
    pr AS (SELECT g.*, f.market AS m_fut, f.model AS p_fut, p.market AS m_past, p.model AS p_past FROM dg g
      JOIN dg f ON g.game_id = f.game_id AND f.t = g.t + 120000000 JOIN dg p ON p.game_id = g.game_id AND p.t = g.t - 60000000
      WHERE g.t + 120000000 < g.t_final)"""


@query("shift_selfjoin", f"""WITH {PAIRS_SQL} SELECT game_id, t AS t_us, {cols6(['market', 'm_fut', 'm_past', 'p_fut', 'p_past'])} FROM pr""")
def shift_selfjoin(t: Tables):
    p = ev.shifted_pairs(daily_grid(t), 2)
    return rounded(p.select("game_id", us("t").alias("t_us"), "market", "m_fut", "m_past", "p_fut", "p_past"),
                   ["market", "m_fut", "m_past", "p_fut", "p_past"])


MOM = ", ".join(["count(*)::DOUBLE AS n", "sum(x) AS sx", "sum(c) AS sc", "sum(x*x) AS sxx", "sum(x*c) AS sxc",
                 "sum(c*c) AS scc", "sum(y) AS sy", "sum(x*y) AS sxy", "sum(c*y) AS scy"])
SUM_MOM = ", ".join(f"sum({m}) AS {m}" for m in ev.MOMENTS)


@query("info_test", f"""WITH {PAIRS_SQL},
    bo AS (SELECT game_id, 'market_toward_model' AS direction, m_fut - market AS y, model - market AS x, m_past - market AS c FROM pr
      UNION ALL SELECT game_id, 'model_toward_market', p_fut - model, market - model, p_past - model FROM pr),
    st AS (SELECT direction, game_id, {MOM} FROM bo GROUP BY direction, game_id),
    {boot_ctes('st', ['direction'], list(ev.MOMENTS))},
    al AS (SELECT direction, -1 AS rep, {SUM_MOM} FROM st GROUP BY direction UNION ALL SELECT direction, rep, {', '.join(ev.MOMENTS)} FROM reps),
    {WLS.format(src='al')}
    SELECT direction, 2::BIGINT AS k_minutes, max(CASE WHEN rep = -1 THEN n END)::BIGINT AS rows,
      round(max(CASE WHEN rep = -1 THEN bx END), 6) AS slope, round(max(CASE WHEN rep = -1 THEN bc END), 6) AS reversal,
      round(max(CASE WHEN rep = -1 THEN sqrt(sxx/n - (sx/n)*(sx/n)) END), 6) AS gap_sd,
      round(quantile_cont(bx, 0.05) FILTER (rep >= 0), 6) AS p05, round(quantile_cont(bx, 0.95) FILTER (rep >= 0), 6) AS p95
    FROM sol GROUP BY direction""")
def info_test(t: Tables):
    out = ev.info_test(ev.shifted_pairs(daily_grid(t), 2), 2, n_boot=N_BOOT)
    return rounded(out, ["slope", "reversal", "gap_sd", "p05", "p95"])


DAY_GRID = " UNION ALL ".join(f"""SELECT {d}.0::DOUBLE AS delta, game_id, t // 86400000000 * 60000000 AS t, avg(model) AS model, avg(market) AS market, max(t_final) AS t_final
    FROM grid{d} GROUP BY game_id, t // 86400000000""" for d in (0, 5, 10, 20))
SWEEP_PAIRS = " UNION ALL ".join(f"""SELECT g.*, {k} AS k, f.market AS m_fut, f.model AS p_fut, p.market AS m_past, p.model AS p_past FROM dg g
    JOIN dg f ON g.delta = f.delta AND g.game_id = f.game_id AND f.t = g.t + {k} * 60000000 JOIN dg p ON p.delta = g.delta AND p.game_id = g.game_id AND p.t = g.t - 60000000
    WHERE g.t + {k} * 60000000 < g.t_final""" for k in (1, 2, 5))


@query("info_sweep", f"""WITH dg AS ({DAY_GRID}), pr AS ({SWEEP_PAIRS}),
    bo AS (SELECT delta, k, game_id, 'market_toward_model' AS direction, m_fut - market AS y, model - market AS x, m_past - market AS c FROM pr
      UNION ALL SELECT delta, k, game_id, 'model_toward_market', p_fut - model, market - model, p_past - model FROM pr),
    st AS (SELECT delta, k, direction, game_id, {MOM} FROM bo GROUP BY ALL),
    {boot_ctes('st', ['delta', 'k', 'direction'], list(ev.MOMENTS))},
    al AS (SELECT delta, k, direction, -1 AS rep, {SUM_MOM} FROM st GROUP BY ALL UNION ALL SELECT delta, k, direction, rep, {', '.join(ev.MOMENTS)} FROM reps),
    {WLS.format(src='al')}
    SELECT delta, k::BIGINT AS k_minutes, direction, max(CASE WHEN rep = -1 THEN n END)::BIGINT AS rows,
      round(max(CASE WHEN rep = -1 THEN bx END), 6) AS slope, round(max(CASE WHEN rep = -1 THEN bc END), 6) AS reversal,
      round(quantile_cont(bx, 0.05) FILTER (rep >= 0), 6) AS p05, round(quantile_cont(bx, 0.95) FILTER (rep >= 0), 6) AS p95
    FROM sol GROUP BY delta, k, direction""")
def info_sweep(t: Tables):
    """The information test at four feed delays and three horizons: one grid for all delays, one scan of it for all horizons."""
    day = F.floor(us("t") / 86400000000)
    g = ev.sweep(t.prices, t.minutes, hot=t.hot_games).groupBy("delta", "game_id", day.alias("h")).agg(
        F.avg("model").alias("model"), F.avg("market").alias("market"), F.max("t_final").alias("t_final"))
    pairs = ev.offset_pairs(g.withColumn("t", F.timestamp_micros(F.col("h") * 60000000)).drop("h"), by=("delta", "game_id"))
    out = ev.info_table(pairs, ["delta", "k"], n_boot=N_BOOT).drop("gap_sd")
    return rounded(out.withColumn("k", F.col("k").cast("bigint")).withColumnRenamed("k", "k_minutes"), ["slope", "reversal", "p05", "p95"])


# ------------------------------------------------------------------ event study

SNAP_TIMES = "(SELECT game_id, seq, t - (seq % 90) * 1000000 AS t_snap FROM snaps)"
MOVES = f"""lg AS (SELECT *, p_home - lag(p_home) OVER (PARTITION BY game_id ORDER BY ord) AS dp FROM prices),
    mv AS (SELECT l.game_id, l.ord, l.kind, l.t, l.dp, s.t_snap FROM lg l JOIN {SNAP_TIMES} s
      ON l.game_id = s.game_id AND l.seq = s.seq WHERE l.kind IN ('play','final') AND l.timing = 'end' AND abs(l.dp) >= 0.05)"""


def snap_times(t: Tables) -> DataFrame:
    return t.ev.select("game_id", F.col("event_id").alias("seq"),
                       (F.col("t") - seconds(F.col("event_id") % 90)).alias("t_snap"))


@query("big_moves", f"WITH {MOVES} SELECT game_id, ord AS quote_order, kind, round(dp, 6) AS dp, t_snap AS snap_us FROM mv")
def big_moves(t: Tables):
    m = ev.big_moves(t.prices, snap_times(t), hot=t.hot_games)
    return m.select("game_id", F.col("order").alias("quote_order"), "kind", r6("dp").alias("dp"), us("t_snap").alias("snap_us"))


TAUS, UNIT_S = tuple(range(-60, 181)), 720  # a minute before to three minutes after; a second of a game is 720 s of the given tables
PATHS = MOVES + """,
    ms AS (SELECT mv.*, s.y FROM mv JOIN spans s USING (game_id)),
    ba AS (SELECT m.game_id, m.ord, x.price AS base FROM ms m ASOF JOIN trades x ON m.game_id = x.game_id AND m.t_snap >= x.ts),
    tz AS (SELECT m.*, k AS tau, m.t + k * 720000000 AS at FROM ms m, range(-60, 181) v(k)),
    pa AS (SELECT z.*, x.price AS px, b.base, (x.price - b.base)/z.dp AS share FROM tz z JOIN ba b ON b.game_id = z.game_id AND b.ord = z.ord
      ASOF LEFT JOIN trades x ON z.game_id = x.game_id AND z.at >= x.ts)"""


def moves(t: Tables) -> DataFrame:
    return ev.big_moves(t.prices, snap_times(t), hot=t.hot_games).join(ev.spans(t.prices).select("game_id", "y"), "game_id")


def paths(t: Tables) -> DataFrame:
    return ev.market_paths(moves(t), t.trades, TAUS, unit_s=UNIT_S, hot=t.hot_games)


def runs(t: Tables) -> DataFrame:
    return ev.market_runs(moves(t), t.trades, TAUS, unit_s=UNIT_S, hot=t.hot_games)


@query("event_path", f"WITH {PATHS} SELECT game_id, ord AS quote_order, tau::BIGINT AS tau, round(base, 6) AS base, round(px, 6) AS px FROM pa")
def event_path(t: Tables):
    return paths(t).select("game_id", F.col("order").alias("quote_order"), F.col("tau").cast("bigint").alias("tau"),
                           r6("base").alias("base"), r6("px").alias("px"))


@query("event_study", f"""WITH {PATHS}, st AS (SELECT tau, game_id, count(*)::DOUBLE AS n, sum(share) AS s FROM pa WHERE share IS NOT NULL GROUP BY tau, game_id),
    {boot_ctes('st', ['tau'], ['n', 's'])},
    tot AS (SELECT tau, sum(s)/sum(n) AS share, sum(n)::BIGINT AS moves FROM st GROUP BY tau),
    bd AS (SELECT tau, {q05('s/n')} AS p05, {q95('s/n')} AS p95 FROM reps GROUP BY tau)
    SELECT tau::BIGINT AS tau, moves, round(share, 6) AS share, round(p05, 6) AS p05, round(p95, 6) AS p95,
      (SELECT min(tau)::BIGINT FROM tot WHERE share >= 0.5) AS first_cross FROM tot JOIN bd USING (tau)""")
def event_study(t: Tables):
    """Response curve around big moves, and the first offset at which it crosses a level."""
    curve = ev.event_curve(runs(t), n_boot=N_BOOT)
    cross = curve.filter("share >= 0.5").agg(F.min("tau").cast("bigint").alias("first_cross"))
    return rounded(curve.transform(with_row, cross).withColumn("tau", F.col("tau").cast("bigint")), ["share", "p05", "p95"])


@query("event_summary", f"""WITH {PATHS}, st AS (SELECT tau, game_id, count(*)::DOUBLE AS n, sum(share) AS s FROM pa WHERE share IS NOT NULL GROUP BY tau, game_id),
    {boot_ctes('st', ['tau'], ['n', 's'])},
    tot AS (SELECT tau, sum(s)/sum(n) AS share FROM st GROUP BY tau),
    hv AS (SELECT rep, min(tau) FILTER (s/n >= 0.5) AS half FROM reps GROUP BY rep),
    pm AS (SELECT DISTINCT p.game_id, p.ord, m.kind, m.dp FROM pa p JOIN ms m ON m.game_id = p.game_id AND m.ord = p.ord),
    tw AS (SELECT avg(CASE WHEN x.ts - m.t <= 720000000 THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT * FROM ms WHERE game_id IN (SELECT game_id FROM trades)) m
      ASOF LEFT JOIN trades x ON m.game_id = x.game_id AND m.t <= x.ts)
    SELECT count(*) AS moves, count(DISTINCT game_id) AS games, count(*) FILTER (kind = 'final') AS final_whistles, round(quantile_cont(abs(dp), 0.5), 6) AS median_abs_move,
      (SELECT min(tau)::BIGINT FROM tot WHERE share >= 0.5) AS half_move, (SELECT round(max(share), 6) FROM tot WHERE tau = 0) AS share_at_0,
      (SELECT round(max(share), 6) FROM tot WHERE tau = 120) AS share_at_120, round((SELECT quantile_cont(half::DOUBLE, 0.05) FROM hv), 6) AS half_move_p05,
      round((SELECT quantile_cont(half::DOUBLE, 0.95) FROM hv), 6) AS half_move_p95, round((SELECT share FROM tw), 6) AS traded_within FROM pm""")
def event_summary(t: Tables):
    """The event study in one row."""
    out = ev.event_summary(runs(t), moves(t), t.trades, within_s=UNIT_S, n_boot=N_BOOT, hot=t.hot_games).withColumn("half_move", F.col("half_move").cast("bigint"))
    return rounded(out, ["median_abs_move", "share_at_0", "share_at_120", "half_move_p05", "half_move_p95", "traded_within"])


@query("event_delay", f"""WITH {PATHS}, st AS (SELECT tau, game_id, count(*)::DOUBLE AS n, sum(share) AS share, sum((1-share)*abs(dp)) AS "left",
      sum(sign(dp)*(y-px)) AS pnl, sum(sign(dp)*(y-px) - 0.07::DOUBLE*px*(1-px)) AS net FROM pa WHERE px IS NOT NULL GROUP BY tau, game_id),
    {boot_ctes('st', ['tau'], ['n', '"left"', 'pnl', 'net'])},
    tot AS (SELECT tau, sum(n)::BIGINT AS moves, sum(share)/sum(n) AS share, sum("left")/sum(n)*100 AS left_cents,
      sum(pnl)/sum(n)*100 AS pnl_cents, sum(net)/sum(n)*100 AS net_cents FROM st GROUP BY tau),
    bd AS (SELECT tau, {q05('"left"/n')}*100 AS left_p05, {q95('"left"/n')}*100 AS left_p95, {q05('pnl/n')}*100 AS pnl_p05,
      {q95('pnl/n')}*100 AS pnl_p95, {q05('net/n')}*100 AS net_p05, {q95('net/n')}*100 AS net_p95 FROM reps GROUP BY tau)
    SELECT tau::BIGINT AS tau, moves, {cols6(['share', 'left_cents', 'pnl_cents', 'net_cents', 'left_p05', 'left_p95', 'pnl_p05', 'pnl_p95', 'net_p05', 'net_p95'])}
    FROM tot JOIN bd USING (tau)""")
def event_delay(t: Tables):
    """What is left of a move, and what trading it would earn, by delay."""
    d = ev.delay_table(runs(t), n_boot=N_BOOT).withColumn("tau", F.col("tau").cast("bigint"))
    return rounded(d, [c for c in d.columns if c not in ("tau", "moves")])
