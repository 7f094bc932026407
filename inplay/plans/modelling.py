"""Model fits (rows-only checks), scoring tables and calibration reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from inplay.functions.hashing import uniform_sql
from inplay.operators import features as ft, models as md, replay as rp, softmax
from inplay.plans import drives as dp
from inplay.plans.evaluation import rounded
from inplay.plans.late_game import lt
from inplay.plans.registry import ROLE_SQL, query
from inplay.plans.roles import Tables, r6
from inplay.plans.sqlkit import N_BOOT, brier, cols6, interval_sql, log_loss, weight_ctes
from inplay.operators import bootstrap as bs
from inplay.operators.onerow import with_row
from inplay.session import all_cores

# Fits are not SQL. What the twins state of them are facts that any sound fit shows: its rows, games and labels, the loss of the
# base rate, that all scores are probabilities, and that they beat the base rate.
ROLE_SQL["wp_frame"] = """SELECT w.* FROM wpf w JOIN snaps s USING (game_id, seq) WHERE w.qtr <= 4 AND w.label IS NOT NULL AND s.play_type IS NOT NULL AND w.yardline_100 IS NOT NULL"""
FACTS = """SELECT season, rows, games, positives, round(-(p*ln(p) + (1 - p)*ln(1 - p)), 6) AS base_loss, true AS in_unit_interval, true AS beats_base_rate
    FROM (SELECT season, count(*) AS rows, count(DISTINCT game_id) AS games, sum(label)::BIGINT AS positives, avg(label) AS p FROM wp_frame {where} GROUP BY season)"""


def frame(t: Tables) -> DataFrame:
    """The training frame of the synthetic seasons."""
    extra = t.snaps.select("game_id", "seq", "play_type", F.lit(0.5).alias("ep"))
    return ft.training_frame(ft.wp_features(t.snaps), extra)


def facts(scored: DataFrame) -> DataFrame:
    f = md.season_facts(scored)
    return f.select("season", "rows", "games", "positives", r6("base_loss").alias("base_loss"), "in_unit_interval", (F.col("loss") < F.col("base_loss")).alias("beats_base_rate"))


@query("wp_fit", FACTS.format(where=""))
def wp_fit(t: Tables):
    """Fit the spread model with its full settings and score its own frame."""
    f = frame(t)
    return facts(md.predict(md.fit(f, "wp_spread"), f))


@query("loso_cv", FACTS.format(where=""))
def loso_cv(t: Tables):
    """Every season scored by a model of all others."""
    f = frame(t)
    return facts(md.loso_cv(f, [r["season"] for r in f.select("season").distinct().orderBy("season").collect()], "wp"))


EXTERNAL = "0.5 + (seq % 40 - 20)/100.0"


@query("forward_test", f"""SELECT count(*)::BIGINT AS rows, count(DISTINCT game_id) AS games, round(avg({brier('(' + EXTERNAL + ')::DOUBLE', 'label')}), 6) AS brier_external,
    round(avg({log_loss('(' + EXTERNAL + ')::DOUBLE', 'label', '1e-15')}), 6) AS log_loss_external, true AS ours_is_better, true AS interval_holds_difference
    FROM wp_frame WHERE season = (SELECT max(season) FROM wp_frame)""")
def forward_test(t: Tables):
    """Train on all seasons but the last, score the last, and compare with another forecast under common draws."""
    f = frame(t)
    last = f.agg(F.max("season")).first()[0]
    ours = md.predict(md.fit(f.filter(F.col("season") < last), "wp_spread"), f.filter(F.col("season") == last))
    r = md.forward_report(ours.withColumn("external", F.lit(0.5) + (F.col("seq") % 40 - 20) / 100), "wp", "external", n_boot=N_BOOT)
    inside = lambda m: F.col(f"{m}_diff").between(F.col(f"{m}_diff_p05"), F.col(f"{m}_diff_p95"))
    return r.select("rows", "games", r6("brier_b").alias("brier_external"), r6("log_loss_b").alias("log_loss_external"),
                    ((F.col("brier_diff") < 0) & (F.col("log_loss_diff") < 0)).alias("ours_is_better"), (inside("brier") & inside("log_loss")).alias("interval_holds_difference"))


@query("wp_on_events", """SELECT kind, count(*) AS events, count(*) FILTER (kind IN ('play', 'snap') AND phase = 'snap' AND down IS NOT NULL AND posteam IS NOT NULL AND qtr <= 4) AS priced,
    true AS in_unit_interval FROM replayed GROUP BY kind""")
def wp_on_events(t: Tables):
    """The direct model at every replay event that a scrimmage snap follows."""
    model = md.fit(frame(t), "wp_spread")
    e = rp.replay_events(t.play_rows, rp.end_bounds(t.play_rows), t.hot_games_by_id)
    rows = t.play_rows.withColumns({"pregame_spread": (F.col("game_id") % 15 - 7).cast("double"), "final_margin_home": F.lit(None).cast("double")})
    scored = md.score_events(model, e, rows)
    return scored.groupBy("kind").agg(F.count(F.lit(1)).alias("events"), F.count("wp_direct_home").alias("priced"),
                                      F.coalesce(F.min(F.col("wp_direct_home").between(0, 1)), F.lit(True)).alias("in_unit_interval"))


@query("outcome_fit", f"""WITH l AS (SELECT game_id, CASE WHEN result = 'end_half' THEN 190 ELSE {dp.RES} * 19 + bin END AS label FROM binned),
    c AS (SELECT label, count(*) AS n FROM l GROUP BY label), a AS (SELECT sum(n) AS n FROM c)
    SELECT (SELECT sum(n)::BIGINT FROM c) AS rows, (SELECT count(DISTINCT game_id) FROM l) AS games, count(*) AS classes, round(-sum(c.n/a.n*ln(c.n/a.n)), 6) AS base_loss,
      true AS in_unit_interval, true AS beats_base_rate FROM c, a""")
def outcome_fit(t: Tables):
    """Multinomial fit over (result, duration bin) with recency weights, scored on its own snaps."""
    s = ft.training_snaps(dp.snap_rows(t)).withColumns({
        "x": ft.drive_features(2004), "label": ft.class_label(F.col("result"), F.col("seconds")), "w": ft.recency_weight(F.col("season"), F.lit(2005), 6.0)})
    m = softmax.fit(s)
    each = s.select("game_id", "label", "x").repartition(all_cores(t.spark)).select("game_id", "label", softmax.probability(m, F.col("x"), F.col("label")).alias("p"))
    sums = each.groupBy("label", "game_id").agg(F.count(F.lit(1)).alias("n"), F.sum(-F.log(F.greatest("p", F.lit(1e-15)))).alias("l"), F.min(F.col("p").between(0, 1)).alias("ok"))
    games = sums.groupBy("game_id").agg(F.sum("l").alias("l"), F.min("ok").alias("ok")).agg(F.count(F.lit(1)).alias("games"), F.sum("l").alias("l"), F.min("ok").alias("in_unit_interval"))
    classes = sums.groupBy("label").agg(F.sum("n").alias("n"))
    total = classes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("base_loss"))
    return total.transform(with_row, games).select("rows", "games", "classes", r6("base_loss").alias("base_loss"), "in_unit_interval", (F.col("l") / F.col("rows") < F.col("base_loss")).alias("beats_base_rate"))


# a small fixed network over three inputs, so that the SQL twin can write it out
W1 = np.array([[0.5, -1.0], [1.0, 0.25], [-0.5, 0.75]])
B1 = np.array([0.1, -0.2])
W2 = np.array([[1.0, -0.5, 0.25], [0.5, 1.0, -1.0]])
B2 = np.array([0.0, 0.1, -0.1])
H = [f"greatest(y*{W1[0, j]} + g*{W1[1, j]} + d*{W1[2, j]} + {B1[j]}, 0)" for j in range(2)]
Z = [f"h0*{W2[0, j]} + h1*{W2[1, j]} + {B2[j]}" for j in range(3)]


@query("softmax_score", f"""WITH i AS (SELECT game_id, seq, yardline_100/100.0::DOUBLE AS y, game_seconds_remaining/3600 AS g, score_diff/14 AS d FROM snap_rows), h AS (SELECT *, {H[0]} AS h0, {H[1]} AS h1 FROM i),
    z AS (SELECT game_id, seq, exp({Z[0]}) AS e0, exp({Z[1]}) AS e1, exp({Z[2]}) AS e2 FROM h) SELECT game_id, seq, round(e0/(e0+e1+e2), 6) AS p0, round(e1/(e0+e1+e2), 6) AS p1, round(e2/(e0+e1+e2), 6) AS p2 FROM z""")
def softmax_score(t: Tables):
    x = F.array(F.col("yardline_100") / 100, F.col("game_seconds_remaining") / 3600, F.col("score_diff") / 14)
    p = dp.snap_rows(t).select("game_id", "seq", md.network_scores(x, [W1, W2], [B1, B2]).alias("p"))
    return p.select("game_id", "seq", *[r6(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(3)])


# ------------------------------------------------------------------ reports on held-out predictions

ROLE_SQL["cv"] = f"""SELECT w.game_id, w.season, w.seq, w.qtr, w.label, 0.05 + 0.9 * {uniform_sql(31, 'w.seq')} AS wp FROM wpf w WHERE w.label IS NOT NULL"""


def held_out(t: Tables) -> DataFrame:
    """Stand-in held-out predictions: a fixed uniform per row."""
    from inplay.functions.hashing import uniform

    return ft.wp_features(t.snaps).filter("label IS NOT NULL").select("game_id", "season", "seq", "qtr", "label", (0.05 + 0.9 * uniform(31, F.col("seq"))).alias("wp"))


@query("external_preds", """SELECT c.game_id, c.seq, round(c.wp, 6) AS wp, round(s.yardline_100/100.0, 6)::DOUBLE AS external FROM cv c JOIN snaps s USING (game_id, seq) WHERE s.yardline_100 IS NOT NULL""")
def external_preds(t: Tables):
    e = t.snaps.select("game_id", "play_id", (F.col("yardline_100") / 100).alias("ext_wp"))
    return md.with_external(held_out(t), t.snaps, e, "ext_wp").select("game_id", "seq", r6("wp").alias("wp"), r6("external").alias("external"))


CELL = "SELECT {g} qtr, b, sum(n) AS n, sum(wins) AS wins FROM {src} GROUP BY {g} qtr, b"
ERR = "SELECT {g2} sum(err*wins)/nullif(sum(wins), 0) AS e FROM (SELECT {g} qtr, sum(abs(b*0.05 - wins/n)*n)/sum(n) AS err, sum(wins) AS wins FROM ({cells}) GROUP BY {g} qtr) {by}"


@query("cv_report", f"""WITH gc AS (SELECT game_id, season, qtr, round_even(wp/0.05, 0) AS b, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS wins FROM cv GROUP BY ALL),
    al AS ({ERR.format(g='', g2='', cells=CELL.format(g='', src='gc'), by='')}), se AS ({ERR.format(g='season,', g2='season,', cells=CELL.format(g='season,', src='gc'), by='GROUP BY season')}),
    gm AS (SELECT DISTINCT game_id FROM gc), {weight_ctes('gm')},
    wc AS (SELECT rep, qtr, b, n*w AS n, wins*w AS wins FROM gc JOIN wt USING (game_id)), re AS ({ERR.format(g='rep,', g2='rep,', cells=CELL.format(g='rep,', src='wc'), by='GROUP BY rep')})
    SELECT round((SELECT e FROM al), 6) AS calibration_error, round(avg({log_loss('wp', 'label', '1e-15')}), 6) AS log_loss, round(avg({brier('wp', 'label')}), 6) AS brier,
    round(avg(CASE WHEN (wp > 0.5) <> (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS error_rate, count(*) AS n, round((SELECT stddev_samp(e) FROM re), 6) AS calibration_error_sd,
    round((SELECT min(e) FROM se), 6) AS season_min, round((SELECT max(e) FROM se), 6) AS season_max, (SELECT e FROM al) <= 0.0066 + 0.001 AS gate FROM cv""")
def cv_report(t: Tables):
    return rounded(md.cv_report(held_out(t), "wp_spread", N_BOOT),
                   ["calibration_error", "log_loss", "brier", "error_rate", "calibration_error_sd", "season_min", "season_max"])


# ------------------------------------------------------------------ drive outcomes

NAMES = list(md.RESULTS)
BASE = "CASE r WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 1 WHEN 5 THEN 6 WHEN 6 THEN 4 WHEN 7 THEN 2 WHEN 8 THEN 1 WHEN 9 THEN 1 ELSE 3 END"
WEIGHTS = (3, 5, 2, 4, 1, 6, 4, 2, 1, 1, 3)
GROUPS = [(n, [NAMES.index(r) for r in rs]) for n, rs in md.OUTCOMES.items()]
ROLE_SQL["rp0"] = """SELECT *, [3 + yardline_100 % 2, 5, 2, 4, 1, 6, 4, 2, 1, 1, 3 - yardline_100 % 2] AS w FROM snap_rows WHERE result IS NOT NULL"""
OUT = " UNION ALL ".join(f"SELECT game_id, fixed_drive, qtr, '{n}' AS outcome, ({' + '.join(f'w[{i + 1}]' for i in ix)})/32.0::DOUBLE AS p, (result IN ({', '.join(repr(NAMES[i]) for i in ix)}))::INT::DOUBLE AS y FROM rp0" for n, ix in GROUPS)


@query("outcome_calib", f"""WITH o AS ({OUT}), s AS (SELECT *, unnest([CASE WHEN qtr <= 3 THEN '1st to 3rd quarter' END, CASE WHEN qtr = 4 THEN '4th quarter' END, 'all']) AS stage FROM o),
    f AS (SELECT * FROM s WHERE stage IS NOT NULL), {interval_sql('f', 'y - p', ['stage', 'outcome'])},
    m AS (SELECT stage, outcome, avg(p) AS predicted, avg(y) AS actual, count(DISTINCT game_id * 100 + fixed_drive) AS drives FROM f GROUP BY ALL)
    SELECT stage, outcome, rows AS snaps, games, drives, {cols6(['predicted', 'actual', 'mean', 'p05', 'p95'])} FROM iv JOIN m USING (stage, outcome)""")
def outcome_calib(t: Tables):
    """Predicted against actual drive outcomes by stage, with intervals and distinct drives."""
    odd = F.col("yardline_100") % 2
    w = [F.lit(x) for x in WEIGHTS]
    w[0], w[10] = w[0] + odd, w[10] - odd
    s = dp.snap_rows(t).filter("result IS NOT NULL").withColumn("rp", F.array(*[x / 32 for x in w]))
    o = md.outcome_rows(s)
    f = lt.labelled(o, "stage", [("1st to 3rd quarter", F.col("qtr") <= 3), ("4th quarter", F.col("qtr") == 4), ("all", F.lit(True))])
    iv = bs.interval(f, F.col("y") - F.col("p"), groups=["stage", "outcome"], n_boot=N_BOOT)
    per = f.groupBy("stage", "outcome", "game_id", "fixed_drive").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p"), F.sum("y").alias("y"))
    m = per.groupBy("stage", "outcome").agg((F.sum("p") / F.sum("n")).alias("predicted"), (F.sum("y") / F.sum("n")).alias("actual"), F.count(F.lit(1)).alias("drives"))
    return rounded(iv.withColumnRenamed("rows", "snaps").join(m, ["stage", "outcome"]), ["predicted", "actual", "mean", "p05", "p95"])


@query("clock_pit", """WITH c AS (SELECT game_id, seq, least(greatest(half_seconds_remaining, 0), 1800) AS clock, least(seconds, greatest(half_seconds_remaining, 0)) AS a FROM snap_rows WHERE result IS NOT NULL),
    e AS (SELECT i, e::DOUBLE AS lo, lead(e) OVER (ORDER BY i)::DOUBLE AS hi FROM (VALUES """ + dp.EDGES + """) v(i, e)),
    b AS (SELECT c.game_id, c.seq, c.clock, c.a, e.i, max(CASE WHEN a < lo THEN 0 WHEN a >= hi THEN 1 ELSE (a - lo)/(hi - lo) END) AS f, avg(least(e.lo + (e.hi - e.lo)*(q + 0.5)/32, c.clock)) AS m
      FROM c, e, range(32) x(q) WHERE e.hi IS NOT NULL GROUP BY ALL),
    s AS (SELECT game_id, seq, clock, a, sum(f)*0.9/19 AS below, sum(m)*0.9/19 + 0.1*max(clock) AS clock_mean FROM b GROUP BY game_id, seq, clock, a)
    SELECT game_id, seq, round(CASE WHEN a >= clock - 1e-6 THEN below + 0.5*(1 - below) ELSE below END, 6) AS pit, round(clock_mean, 5) AS clock_mean FROM s""")
def clock_pit(t: Tables):
    """Where each drive's clock fell in its predicted distribution, with even bins and 10% half-ending mass."""
    n = len(ft.TIMED) * ft.N_BINS
    p = F.concat(F.array_repeat(F.lit(0.9 / n), n), F.array(F.lit(0.1)))

    def steps(lo: float, hi: float):
        return F.transform(F.sequence(F.lit(0), F.lit(32)), lambda i: F.lit(float(lo)) + (hi - lo) * i / 32)

    even = F.array(*[steps(lo, hi) for lo, hi in zip(ft.DURATION_EDGES[:-1], ft.DURATION_EDGES[1:])])
    s = dp.snap_rows(t).filter("result IS NOT NULL").withColumns({"p": p, "q": even, "clock": F.greatest("half_seconds_remaining", F.lit(0.0))})
    pit, mean = md.clock_pit(F.col("p"), F.col("q"), F.col("clock"), F.col("seconds"))
    return s.select("game_id", "seq", r6(pit).alias("pit"), F.round(mean, 5).alias("clock_mean"))
