"""Segments, features, labels, buckets and pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from inplay.functions.hashing import uniform, uniform_sql
from inplay.operators import distributions as ds, features as ft, pools as pl, segments as sg
from inplay.operators.scan import hot_entities
from inplay.plans.registry import ROLE_SQL, query
from inplay.plans.roles import Tables, r6

SNAP = "(posteam IS NOT NULL AND down IS NOT NULL AND yardline_100 IS NOT NULL)"
HOME_OFF = "offense = home_team"
LEAD = "CASE WHEN is_home THEN home_score_pre - away_score_pre ELSE away_score_pre - home_score_pre END"
ROLE_SQL.update({
    "dr0": f"""SELECT game_id, fixed_drive, arg_min(season, seq) AS season, arg_min(home_team, seq) AS home_team, min(seq) AS first_seq,
        count(*) FILTER ({SNAP}) AS n_snaps, count(DISTINCT CASE WHEN {SNAP} THEN posteam END) AS n_offenses,
        arg_min(posteam, seq) FILTER ({SNAP}) AS offense, arg_min(game_half, seq) AS half, arg_min(game_half, seq) FILTER ({SNAP}) AS snap_half,
        arg_min(game_seconds_remaining, seq) AS gsr_start, arg_min(game_seconds_remaining, seq) FILTER ({SNAP}) AS snap_gsr,
        arg_min(yardline_100, seq) FILTER ({SNAP}) AS snap_yardline, arg_min(home_score_pre, seq) FILTER ({SNAP}) AS snap_home_pre,
        arg_min(away_score_pre, seq) FILTER ({SNAP}) AS snap_away_pre, arg_min(home_timeouts, seq) FILTER ({SNAP}) AS snap_home_timeouts,
        arg_min(away_timeouts, seq) FILTER ({SNAP}) AS snap_away_timeouts, min(seq) FILTER ({SNAP}) AS snap_seq,
        arg_min(fixed_drive_result, seq) AS result_raw, arg_min(home_score_pre, seq) AS home_pre, arg_min(away_score_pre, seq) AS away_pre,
        arg_max(home_score_post, seq) AS home_post, arg_max(away_score_post, seq) AS away_post,
        arg_min((final_margin_home + final_total)/2, seq) AS final_home, arg_min((final_total - final_margin_home)/2, seq) AS final_away
        FROM snaps GROUP BY game_id, fixed_drive""",
    "dr1": f"""SELECT *, CASE WHEN lead(half) OVER w = half THEN lead(gsr_start) OVER w WHEN half = 'Half1' THEN 1800.0 ELSE 0.0 END AS end_gsr,
        CASE WHEN {HOME_OFF} THEN home_post - home_pre ELSE away_post - away_pre END AS off_points,
        CASE WHEN {HOME_OFF} THEN away_post - away_pre ELSE home_post - home_pre END AS def_points
        FROM dr0 WINDOW w AS (PARTITION BY game_id ORDER BY first_seq)""",
    "dr2": """SELECT *, CASE WHEN result_raw = 'Touchdown' AND off_points IN (6,7,8) AND def_points = 0 THEN 'td' || (off_points - 6)::INT
          WHEN result_raw = 'Field goal' AND off_points = 3 AND def_points = 0 THEN 'fg' WHEN result_raw = 'Punt' AND off_points = 0 AND def_points = 0 THEN 'punt'
          WHEN result_raw = 'Turnover' AND off_points = 0 AND def_points = 0 THEN 'turnover' WHEN result_raw = 'Turnover on downs' AND off_points = 0 AND def_points = 0 THEN 'downs'
          WHEN result_raw = 'End of half' AND off_points = 0 AND def_points = 0 THEN 'end_half' WHEN result_raw = 'Safety' AND off_points = 0 AND def_points = 2 THEN 'safety'
          WHEN result_raw = 'Opp touchdown' AND off_points = 0 AND def_points IN (6,7,8) THEN 'opp_td' END AS result FROM dr1""",
    "dr3": f"""SELECT *, lead(offense) OVER w IS NULL AS is_last, lead(offense) OVER w AS n_off, lead(snap_half) OVER w AS n_half, lead(snap_yardline) OVER w AS next_yardline,
        lead(snap_gsr) OVER w AS next_gsr,
        CASE WHEN lead(offense) OVER w IS NULL THEN final_home ELSE lead(snap_home_pre) OVER w END - home_post AS gap_home,
        CASE WHEN lead(offense) OVER w IS NULL THEN final_away ELSE lead(snap_away_pre) OVER w END - away_post AS gap_away
        FROM dr2 WHERE n_snaps > 0 AND n_offenses = 1 WINDOW w AS (PARTITION BY game_id ORDER BY first_seq)""",
    "drives": f"""SELECT *, CASE WHEN is_last THEN 'game_end' WHEN n_half = snap_half THEN 'same_half' ELSE 'next_half' END AS next_kind,
        n_off = offense AS next_same_offense, CASE WHEN n_half = snap_half THEN end_gsr - next_gsr END AS gap_seconds,
        CASE WHEN {HOME_OFF} THEN gap_home ELSE gap_away END AS gap_points_off, CASE WHEN {HOME_OFF} THEN gap_away ELSE gap_home END AS gap_points_def FROM dr3""",
    "sn0": f"""SELECT *, posteam = home_team AS is_home FROM snaps WHERE {SNAP}""",
    "snap_rows": f"""SELECT s.*, {LEAD} AS score_diff, CASE WHEN is_home THEN home_timeouts ELSE away_timeouts END AS timeouts_off,
        CASE WHEN is_home THEN away_timeouts ELSE home_timeouts END AS timeouts_def, CASE WHEN is_home THEN pregame_spread ELSE -pregame_spread END AS spread_off,
        d.result, d.end_gsr, d.def_points, d.next_kind, d.next_same_offense, d.next_yardline, d.next_gsr, d.gap_seconds, d.gap_points_off, d.gap_points_def,
        greatest(s.game_seconds_remaining - d.end_gsr, 0) AS seconds, s.seq = d.snap_seq AS drive_start
        FROM sn0 s JOIN drives d USING (game_id, fixed_drive)""",
})


def drives(t: Tables):
    return sg.build_drives(t.snaps)


def snap_rows(t: Tables):
    return sg.snap_rows(t.snaps, drives(t))


@query("segment_table", """SELECT game_id, fixed_drive, season, first_seq, n_snaps, n_offenses, offense, half, snap_half, gsr_start, end_gsr, off_points, def_points,
    home_post, final_home FROM dr1""")
def segment_table(t: Tables):
    return sg.drive_table(t.snaps).select(
        "game_id", "fixed_drive", "season", "first_seq", "n_snaps", F.col("n_offenses").cast("bigint").alias("n_offenses"), "offense",
        "half", "snap_half", "gsr_start", "end_gsr", "off_points", "def_points", "home_post", "final_home")


@query("segment_label", "SELECT game_id, fixed_drive, result_raw, result FROM dr2")
def segment_label(t: Tables):
    return sg.label_results(sg.drive_table(t.snaps)).select("game_id", "fixed_drive", "result_raw", "result")


@query("segment_transition", """SELECT game_id, fixed_drive, next_kind, next_same_offense, next_yardline, next_gsr, gap_seconds, gap_points_off, gap_points_def FROM drives""")
def segment_transition(t: Tables):
    return drives(t).select("game_id", "fixed_drive", "next_kind", "next_same_offense", "next_yardline", "next_gsr", "gap_seconds",
                            "gap_points_off", "gap_points_def")


@query("segment_rows", """SELECT game_id, seq, fixed_drive, drive_start, is_home, score_diff, timeouts_off, spread_off, result, seconds, gap_points_off FROM snap_rows""")
def segment_rows(t: Tables):
    return snap_rows(t).select("game_id", "seq", "fixed_drive", "drive_start", "is_home", "score_diff", "timeouts_off", "spread_off",
                               "result", "seconds", "gap_points_off")


def pts(col: str) -> str:
    return f"CASE {col} WHEN 'td0' THEN 6 WHEN 'td1' THEN 7 WHEN 'td2' THEN 8 WHEN 'fg' THEN 3 ELSE 0 END"


@query("audit_rebuild", f"""WITH d AS (SELECT *, CASE WHEN result = 'fg' AND game_id % 3 = 0 THEN 'punt' ELSE result END AS lab FROM drives),
    e AS (SELECT *, {pts('lab')} + gap_points_off AS o, CASE WHEN lab = 'opp_td' THEN def_points WHEN lab = 'safety' THEN 2 ELSE 0 END + gap_points_def AS f FROM d),
    p AS (SELECT game_id, sum(CASE WHEN {HOME_OFF} THEN o ELSE f END) + arg_min(snap_home_pre, first_seq) AS home,
      sum(CASE WHEN {HOME_OFF} THEN f ELSE o END) + arg_min(snap_away_pre, first_seq) AS away, arg_min(final_home, first_seq) AS final_home,
      arg_min(final_away, first_seq) AS final_away, count(*) FILTER (lab IS NULL) AS bad FROM e GROUP BY game_id)
    SELECT * FROM p WHERE home <> final_home OR away <> final_away""")
def audit_rebuild(t: Tables):
    """Games whose labels do not rebuild the score, after some field goals were relabelled as punts."""
    d = drives(t).withColumn("result", F.when((F.col("result") == "fg") & (F.col("game_id") % 3 == 0), "punt").otherwise(F.col("result")))
    return sg.check_scores(d)


# ------------------------------------------------------------------ features

ROLE_SQL["wpf"] = """SELECT e.game_id, e.season, e.seq, e.qtr, e.posteam, (qtr <= 2 AND posteam = CASE WHEN fp = home_team THEN away_team ELSE home_team END)::INT AS receive_2h_ko,
    (posteam = home_team)::INT AS home, CASE WHEN posteam = home_team THEN m ELSE -m END AS score_differential, dec AS decay,
    CASE WHEN posteam = home_team THEN sp ELSE -sp END * dec AS spread_time, CASE WHEN posteam = home_team THEN m ELSE -m END / dec AS ratio,
    down, ydstogo, yardline_100, half_seconds_remaining, game_seconds_remaining,
    CASE WHEN posteam = home_team THEN home_timeouts ELSE away_timeouts END AS pto, CASE WHEN posteam = home_team THEN away_timeouts ELSE home_timeouts END AS dto,
    CASE WHEN final_margin_home = 0 THEN NULL WHEN posteam = home_team THEN (final_margin_home > 0)::INT ELSE (final_margin_home < 0)::INT END AS label
    FROM (SELECT *, home_score_pre - away_score_pre AS m, exp(-4 * (3600 - game_seconds_remaining)/3600) AS dec, coalesce(pregame_spread, 1.5) AS sp FROM snaps) e
    JOIN (SELECT game_id, arg_min(posteam, seq) AS fp FROM snaps WHERE posteam IS NOT NULL GROUP BY game_id) f USING (game_id) WHERE posteam IS NOT NULL"""


@query("wp_features", """SELECT game_id, seq, receive_2h_ko, round(spread_time, 6) AS spread_time, home, round(ratio, 6) AS "Diff_Time_Ratio", score_differential,
    pto AS posteam_timeouts_remaining, dto AS defteam_timeouts_remaining, label FROM wpf""")
def wp_features(t: Tables):
    return ft.wp_features(t.snaps).select(
        "game_id", "seq", "receive_2h_ko", r6("spread_time").alias("spread_time"), "home", r6("Diff_Time_Ratio").alias("Diff_Time_Ratio"),
        "score_differential", "posteam_timeouts_remaining", "defteam_timeouts_remaining", "label")


@query("training_frame", """SELECT w.game_id, w.seq, w.label, s.play_type FROM wpf w JOIN snaps s USING (game_id, seq) WHERE w.qtr <= 4 AND w.label IS NOT NULL
    AND s.play_type <> 'error' AND w.yardline_100 IS NOT NULL AND s.seq % 4 <> 0""")
def training_frame(t: Tables):
    extra = t.snaps.select("game_id", "seq", F.when(F.col("play_type") != "error", F.col("play_type")).alias("play_type"),
                           F.when(F.col("seq") % 4 != 0, 0.5).alias("ep"))
    return ft.training_frame(ft.wp_features(t.snaps), extra).select("game_id", "seq", "label", "play_type")


CLIPPED = """least(greatest(score_diff, -35), 35)/14"""


@query("feature_vector", f"""SELECT game_id, seq, round(yardline_100/100.0, 6)::DOUBLE AS f0, (down = 2)::INT::DOUBLE AS f2, round(ln(1 + least(greatest(ydstogo, 1), 30))/ln(31), 6) AS f5,
    (least(greatest(ydstogo, 1), 30) >= yardline_100)::INT::DOUBLE AS f6, round(least(greatest(half_seconds_remaining, 0), 1800)/1800, 6) AS f7,
    round({CLIPPED}, 6) AS f11, (score_diff = 0)::INT::DOUBLE AS f15, round(coalesce(spread_off, 0)/7, 6) AS f21, round((coalesce(pregame_total, 44) - 44)/7, 6) AS f22,
    round((least(season, 2003) - 2016)/8.0, 6)::DOUBLE AS f23, (season_type = 'POST')::INT::DOUBLE AS f24, 25 AS n FROM snap_rows""")
def feature_vector(t: Tables):
    f = snap_rows(t).withColumn("x", ft.drive_features(2003))
    return f.select("game_id", "seq", *[r6(F.get("x", F.lit(i))).alias(f"f{i}") for i in (0, 2, 5, 6, 7, 11, 15, 21, 22, 23, 24)],
                    F.size("x").alias("n"))


EDGES = ", ".join(f"({i}, {e})" for i, e in enumerate(ft.DURATION_EDGES))
BIN = "greatest((SELECT max(i) FROM (VALUES " + EDGES + ") b(i, e) WHERE e <= seconds AND i < 19), 0)"
RES = "CASE result " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(ft.TIMED)) + " END"
TRAIN = """SELECT * FROM snap_rows WHERE result IS NOT NULL"""
ROLE_SQL["binned"] = f"SELECT s.*, (SELECT max(b.i) FROM (VALUES {EDGES}) b(i, e) WHERE b.e <= s.seconds AND b.i < 19) AS bin FROM ({TRAIN}) s"


@query("class_label", f"SELECT game_id, seq, CASE WHEN result = 'end_half' THEN 190 ELSE {RES} * 19 + bin END::INT AS label FROM binned")
def class_label(t: Tables):
    return ft.training_snaps(snap_rows(t)).select("game_id", "seq", ft.class_label(F.col("result"), F.col("seconds")).alias("label"))


QS = "[" + ", ".join(str(i / 32) for i in range(33)) + "]"


@query("bin_quantiles", f"""SELECT b.i AS bin, round(coalesce(g.q[1], b.e), 6) AS q0, round(coalesce(g.q[9], b.e + (n.e - b.e)*8/32.0), 6) AS q8, round(coalesce(g.q[17], b.e + (n.e - b.e)*16/32.0), 6) AS q16,
    round(coalesce(g.q[33], n.e), 6) AS q32 FROM (SELECT i, e::DOUBLE AS e FROM (VALUES {EDGES}) v(i, e)) b JOIN (SELECT i, e::DOUBLE AS e FROM (VALUES {EDGES}) v(i, e)) n ON n.i = b.i + 1
    LEFT JOIN (SELECT bin, quantile_cont(seconds, {QS}) AS q FROM binned WHERE result <> 'end_half' GROUP BY bin) g ON g.bin = b.i""")
def bin_quantiles(t: Tables):
    q = ft.bin_quantiles(ft.training_snaps(snap_rows(t)))
    return q.select("bin", *[r6(F.get("q", F.lit(i))).alias(f"q{i}") for i in (0, 8, 16, 32)])


@query("quantile_lookup", f"""SELECT game_id, seq, round(q[lo + 1] + (pos - lo)*(q[lo + 2] - q[lo + 1]), 6) AS drawn FROM (
    SELECT b.game_id, b.seq, g.q, u * 32 AS pos, least(floor(u * 32)::INT, 31) AS lo FROM (SELECT *, {uniform_sql(11, 'seq')} AS u FROM binned) b
    JOIN (SELECT bin, quantile_cont(seconds, {QS}) AS q FROM binned WHERE result <> 'end_half' GROUP BY bin) g USING (bin))""")
def quantile_lookup(t: Tables):
    """A duration drawn from the quantile row of each snap's bin."""
    s = ft.training_snaps(snap_rows(t)).withColumn("bin", ft.duration_bin(F.col("seconds")))
    q = F.broadcast(ft.bin_quantiles(s))  # 19 bins
    # bins without any timed drive give even steps; they match no rows in the SQL twin
    seen = F.broadcast(s.filter("result <> 'end_half'").select("bin").distinct())
    return s.join(q, "bin").join(seen, "bin", "left_semi").select("game_id", "seq", r6(ft.quantile_value(F.col("q"), uniform(11, F.col("seq")))).alias("drawn"))


@query("recency_weight", "SELECT game_id, seq, round(pow(0.5, (2005 - season)/6.0), 6) AS w FROM snaps")
def recency_weight(t: Tables):
    return t.snaps.select("game_id", "seq", r6(ft.recency_weight(F.col("season"), F.lit(2005), 6.0)).alias("w"))


# ------------------------------------------------------------------ pools

PRES = "CASE result WHEN 'punt' THEN 0 WHEN 'turnover' THEN 1 WHEN 'downs' THEN 2 WHEN 'fg_miss' THEN 3 END"
YBIN = "least(greatest((yardline_100 - 1)//5, 0), 19)"


@query("bucket_id", f"""SELECT game_id, seq, ({PRES} * 20 + {YBIN}) * 2 + (down >= 3)::INT AS possession,
    ((CASE WHEN half_seconds_remaining > 120 THEN 1 ELSE 0 END + CASE WHEN half_seconds_remaining > 300 THEN 1 ELSE 0 END + CASE WHEN half_seconds_remaining > 600 THEN 1 ELSE 0 END) * 5 +
     (CASE WHEN score_diff > -8.5 THEN 1 ELSE 0 END + CASE WHEN score_diff > -0.5 THEN 1 ELSE 0 END + CASE WHEN score_diff > 0.5 THEN 1 ELSE 0 END + CASE WHEN score_diff > 8.5 THEN 1 ELSE 0 END)) * 2 + (game_half = 'Half2')::INT AS timeout,
    ((least(greatest(score_diff, -16), 16) + 16) * 2 + (game_seconds_remaining <= 900)::INT)::BIGINT AS pat FROM snap_rows""")
def bucket_id(t: Tables):
    s = snap_rows(t)
    return s.select("game_id", "seq", pl.possession_bucket(F.when(F.col("result").isin(*pl.POSSESSION_RESULTS), pl.result_index(F.col("result"))), F.col("yardline_100"), F.col("down")).alias("possession"),
                    pl.timeout_bucket(F.col("half_seconds_remaining"), F.col("score_diff"), F.col("game_half") == "Half2").alias("timeout"),
                    pl.pat_context(F.col("score_diff"), F.col("game_seconds_remaining") <= 900).alias("pat"))


ROLE_SQL.update({
    "kicks": """SELECT CASE WHEN result = 'safety' THEN 2 WHEN result = 'opp_td' THEN CASE WHEN late AND lead > 0 THEN 1 ELSE 0 END WHEN late AND lead < 0 THEN 1 ELSE 0 END AS bucket,
        CASE WHEN result = 'opp_td' THEN NOT next_same_offense ELSE next_same_offense END AS same, next_yardline AS yardline, gap_seconds AS seconds,
        CASE WHEN result = 'opp_td' THEN gap_points_def ELSE gap_points_off END AS points_a, CASE WHEN result = 'opp_td' THEN gap_points_off ELSE gap_points_def END AS points_b, season, game_id, first_seq
        FROM (SELECT *, CASE WHEN offense = home_team THEN home_post - away_post ELSE away_post - home_post END AS lead, half = 'Half2' AND end_gsr <= 300 AS late FROM drives)
        WHERE next_kind = 'same_half' AND gap_points_off >= 0 AND gap_points_def >= 0 AND result IN ('td0','td1','td2','fg','opp_td','safety')""",
    "poss": f"""SELECT ({PRES} * 20 + {YBIN}) * 2 + (down >= 3)::INT AS bucket, {PRES} AS r, {YBIN} AS y, gap_seconds AS seconds, game_id, seq, season FROM snap_rows
        WHERE result IN ('punt','turnover','downs','fg_miss') AND next_kind = 'same_half' AND season <= 2005 AND season > 1997 AND gap_points_off >= 0 AND gap_points_def >= 0""",
    "thin": """SELECT g.b, g.r, g.y, (SELECT count(*) FROM poss WHERE bucket = g.b) >= 40 AS own,
        coalesce((SELECT min(w) FROM range(20) x(w) WHERE (SELECT count(*) FROM poss p WHERE p.r = g.r AND abs(p.y - g.y) <= w) >= 40), 19) AS w
        FROM (SELECT b, b // 40 AS r, (b // 2) % 20 AS y FROM range(160) q(b)) g""",
    "filled": """SELECT g.b AS bucket, p.r, p.y, p.seconds, p.game_id, p.seq FROM thin g JOIN poss p ON p.r = g.r AND (CASE WHEN g.own THEN p.bucket = g.b ELSE abs(p.y - g.y) <= g.w END)""",
})


@query("pool_kicks", "SELECT bucket, same, yardline, seconds, points_a, points_b, game_id, first_seq FROM kicks")
def pool_kicks(t: Tables):
    return pl.kick_pool(drives(t)).select("bucket", "same", "yardline", "seconds", "points_a", "points_b", "game_id", "first_seq")


@query("lookback_filter", """SELECT bucket, season, count(*) AS n FROM kicks WHERE season <= 2004 AND season > 2004 - CASE bucket WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 10 END GROUP BY ALL""")
def lookback_filter(t: Tables):
    return pl.look_back(pl.kick_pool(drives(t)), 2004).groupBy("bucket", "season").agg(F.count(F.lit(1)).alias("n"))


@query("bucket_borrow", "SELECT bucket, count(*) AS n, round(avg(seconds), 6) AS seconds, min(seq) AS lo, max(seq) AS hi FROM filled GROUP BY bucket")
def bucket_borrow(t: Tables):
    p = pl.fill_thin(pl.possession_pool(snap_rows(t), 2005))
    return p.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("seconds"), 6).alias("seconds"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))


@query("hotdeck_draw", f"""WITH pool AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY seq) - 1 AS slot, count(*) OVER (PARTITION BY bucket) AS n FROM poss),
    nb AS (SELECT bucket, count(*) AS n FROM poss GROUP BY bucket)
    SELECT r.event_id, r.bucket, p.slot, p.seq FROM (SELECT event_id, event_id % 160 AS bucket, {uniform_sql(3, 'event_id')} AS u FROM ev) r JOIN nb ON nb.bucket = r.bucket
    JOIN pool p ON p.bucket = r.bucket AND p.slot = least(floor(r.u * nb.n)::BIGINT, nb.n - 1)""")
def hotdeck_draw(t: Tables):
    pool = pl.possession_pool(snap_rows(t), 2005)
    lay = pl.pool_layout(pool, ["seq"], hot=hot_entities(pool, ["bucket"], "seq"))
    req = t.ev.select("event_id", (F.col("event_id") % 160).alias("bucket"))
    return pl.draw(req, lay, uniform(3, F.col("event_id"))).select("event_id", "bucket", "slot", "seq")


@query("pool_timeouts", """WITH d AS (SELECT *, snap_home_timeouts - lead(snap_home_timeouts) OVER w AS uh, snap_away_timeouts - lead(snap_away_timeouts) OVER w AS ua, lead(snap_half) OVER w = snap_half AS same,
      CASE WHEN offense = home_team THEN snap_home_pre - snap_away_pre ELSE snap_away_pre - snap_home_pre END AS lead, CASE WHEN snap_half = 'Half1' THEN snap_gsr - 1800 ELSE snap_gsr END AS hs
      FROM dr2 WHERE season <= 2005 AND season > 1997 AND n_snaps > 0 WINDOW w AS (PARTITION BY game_id ORDER BY first_seq))
    SELECT game_id, first_seq, ((CASE WHEN hs > 120 THEN 1 ELSE 0 END + CASE WHEN hs > 300 THEN 1 ELSE 0 END + CASE WHEN hs > 600 THEN 1 ELSE 0 END) * 5 +
     (CASE WHEN lead > -8.5 THEN 1 ELSE 0 END + CASE WHEN lead > -0.5 THEN 1 ELSE 0 END + CASE WHEN lead > 0.5 THEN 1 ELSE 0 END + CASE WHEN lead > 8.5 THEN 1 ELSE 0 END)) * 2 + (snap_half = 'Half2')::INT AS bucket,
     least(greatest(CASE WHEN offense = home_team THEN uh ELSE ua END, 0), 3) AS points_a, least(greatest(CASE WHEN offense = home_team THEN ua ELSE uh END, 0), 3) AS points_b
    FROM d WHERE same AND uh IS NOT NULL AND ua IS NOT NULL""")
def pool_timeouts(t: Tables):
    return pl.timeout_pool(sg.label_results(sg.drive_table(t.snaps)), 2005).select("game_id", "first_seq", "bucket", "points_a", "points_b")


@query("shrunk_table", """WITH td AS (SELECT ((least(greatest(l, -16), 16) + 16)*2 + late::INT)::BIGINT AS ctx, substr(result, 3, 1)::INT AS points FROM (SELECT *, (CASE WHEN offense = home_team THEN home_pre - away_pre ELSE away_pre - home_pre END + 6)::BIGINT AS l,
      half = 'Half2' AND end_gsr <= 900 AS late FROM drives WHERE result IN ('td0','td1','td2') AND season > 1999)),
    ov AS (SELECT points, count(*) / (SELECT count(*) FROM td) AS p FROM td GROUP BY points)
    SELECT c AS ctx, q AS points, round(((SELECT count(*) FROM td WHERE ctx = c AND points = q) + 20 * (SELECT p FROM ov WHERE points = q)) / ((SELECT count(*) FROM td WHERE ctx = c) + 20), 6) AS p
    FROM range(66) a(c), (SELECT x::INT AS q FROM range(3) b(x))""")
def shrunk_table(t: Tables):
    td = pl.tries(drives(t)).filter(F.col("season") > 2005 - pl.PAT_SEASONS).withColumn("ctx", pl.pat_context(F.col("lead6"), F.col("late")))
    s = pl.shrunk_table(td, "ctx", "points", 66, 3)
    return s.select("ctx", "points", r6("p").alias("p"))


@query("residual_sd", """SELECT season, round(stddev_samp(final_margin_home - pregame_spread), 6) AS sd_margin, round(stddev_samp(final_total - pregame_total), 6) AS sd_total FROM (
    SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY seq) = 1) WHERE pregame_spread IS NOT NULL AND pregame_total IS NOT NULL GROUP BY season""")
def residual_sd(t: Tables):
    """Spread of finals around the lines per season, one row per game."""
    cols = ["season", "final_margin_home", "final_total", "pregame_spread", "pregame_total"]
    g = t.snaps.groupBy("game_id").agg(F.min_by(F.struct(*cols), "seq").alias("r")).select("game_id", "r.*").filter(
        "pregame_spread IS NOT NULL AND pregame_total IS NOT NULL")
    return g.groupBy("season").agg(F.round(F.stddev_samp(F.col("final_margin_home") - F.col("pregame_spread")), 6).alias("sd_margin"),
                                   F.round(F.stddev_samp(F.col("final_total") - F.col("pregame_total")), 6).alias("sd_total"))


@query("bucket_price", """WITH f AS (SELECT p.bucket, s.final_margin_home AS m, s.final_total AS tt FROM filled p JOIN (SELECT DISTINCT game_id, final_margin_home, final_total FROM snaps) s USING (game_id))
    SELECT bucket, count(*) AS n, round(avg(CASE WHEN m > 0 THEN 1.0 WHEN m = 0 THEN 0.5 ELSE 0 END), 6) AS p_home, round(avg(CASE WHEN m = 0 THEN 1.0 ELSE 0 END), 6) AS p_tie,
    round(avg(m), 6) AS margin_mean, round(avg(tt), 6) AS total_mean, round(avg(CASE WHEN m <= 3 THEN 1.0 ELSE 0 END), 6) AS cdf_margin_3 FROM f GROUP BY bucket""")
def bucket_price(t: Tables):
    """Prices of a state from the finals of historical states in its (filled) bucket."""
    games = t.snaps.groupBy("game_id").agg(F.min("final_margin_home").alias("m"), F.min("final_total").alias("tt"))
    pool = pl.fill_thin(pl.possession_pool(snap_rows(t), 2005)).join(games, "game_id").withColumns(
        {"home": (F.col("tt") + F.col("m")) / 2, "away": (F.col("tt") - F.col("m")) / 2})
    q = ds.quotes_from_samples(pool, ["bucket"])
    return q.select("bucket", "n", r6("p_home").alias("p_home"), r6("p_tie").alias("p_tie"), r6("margin_mean").alias("margin_mean"),
                    r6("total_mean").alias("total_mean"), r6(ds.at(F.col("cdf_margin").cast("array<double>"), ds.MARGIN_GRID, F.lit(3))).alias("cdf_margin_3"))
