"""Cleaning and replaying event sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from inplay.operators import replay as rp, sequence as sq
from inplay.operators.scan import bfill, row_number, running_max, scan
from inplay.plans.registry import ROLE_SQL, query
from inplay.plans.roles import Tables, r6, us

LIMIT_S = 432000.0  # users act hours apart, so "wild" is five days here

ROLE_SQL.update({
    "pv": """SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY play_id) AS vi, count(*) OVER (PARTITION BY game_id) AS vn
        FROM plays WHERE snap_raw IS NOT NULL""",
    "wild": f"""SELECT v.game_id, v.play_id, abs(v.snap_raw - median(o.snap_raw)) > {LIMIT_S} AS wild FROM pv v JOIN pv o
        ON o.game_id = v.game_id AND o.vi BETWEEN v.vi - 4 AND v.vi + 4 AND o.vi <> v.vi WHERE v.vn >= 3
        GROUP BY v.game_id, v.play_id, v.snap_raw""",
    "durs": """SELECT play_type, median(round(end_raw - snap_raw, 3)) AS dur FROM plays WHERE play_type IS NOT NULL
        AND end_raw - snap_raw BETWEEN 0 AND 120 GROUP BY play_type""",
    "cl0": """SELECT p.*, coalesce(w.wild, false) AS snap_wild, CASE WHEN NOT coalesce(w.wild, false) THEN snap_raw END AS snap,
        CASE WHEN p.play_type IS NULL THEN 0.0 ELSE coalesce(d.dur, 5.0) END AS duration,
        row_number() OVER (PARTITION BY p.game_id ORDER BY p.play_id) AS i
        FROM plays p LEFT JOIN wild w USING (game_id, play_id) LEFT JOIN durs d ON d.play_type = p.play_type""",
    "cl1": """SELECT *, end_raw IS NULL OR snap IS NULL OR end_raw < snap OR end_raw - snap > 120 AS bad,
        coalesce(snap < max(snap) OVER (PARTITION BY game_id ORDER BY play_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ooo,
        first_value(snap IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY play_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fv
        FROM cl0""",
})
REPAIR = """WITH RECURSIVE rec AS (
    SELECT game_id, i, play_id, coalesce(snap, fv) AS s, greatest(CASE WHEN bad THEN coalesce(snap, fv) + duration ELSE end_raw END, coalesce(snap, fv)) AS e
      FROM cl1 WHERE i = 1
    UNION ALL SELECT p.game_id, p.i, p.play_id, greatest(coalesce(p.snap, r.e), r.s),
      greatest(CASE WHEN p.bad THEN greatest(coalesce(p.snap, r.e), r.s) + p.duration ELSE p.end_raw END, greatest(coalesce(p.snap, r.e), r.s), r.e)
      FROM rec r JOIN cl1 p ON p.game_id = r.game_id AND p.i = r.i + 1)"""


def cleaned(t: Tables):
    return sq.clean_times(t.plays, limit_s=LIMIT_S, hot=t.hot_games_by_id)


@query("outlier_median", "SELECT game_id, play_id, coalesce(wild, false) AS snap_wild FROM plays LEFT JOIN wild USING (game_id, play_id)")
def outlier_median(t: Tables):
    return sq.flag_wild(t.plays, limit_s=LIMIT_S, hot=t.hot_games_by_id).select("game_id", "play_id", "snap_wild")


@query("out_of_order", """SELECT game_id, play_id, coalesce(snap_raw < max(snap_raw) OVER (PARTITION BY game_id ORDER BY play_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS out_of_order FROM plays""")
def out_of_order(t: Tables):
    s = scan(t.plays, ["game_id"], ["play_id"], hot=t.hot_games_by_id, seen=running_max("snap_raw", inclusive=False))
    return s.select("game_id", "play_id", F.coalesce(F.col("snap_raw") < F.col("seen"), F.lit(False)).alias("out_of_order"))


@query("bad_end", """SELECT game_id, play_id, end_raw IS NULL OR snap_raw IS NULL OR end_raw < snap_raw OR end_raw - snap_raw > 120 AS bad_end FROM plays""")
def bad_end(t: Tables):
    return t.plays.select("game_id", "play_id", sq.bad_end(F.col("snap_raw"), F.col("end_raw")).alias("bad_end"))


@query("fill_backward", """SELECT game_id, play_id, round(first_value(snap_raw IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY play_id
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 3) AS next_valid FROM plays""")
def fill_backward(t: Tables):
    s = scan(t.plays, ["game_id"], ["play_id"], hot=t.hot_games_by_id, next_valid=bfill("snap_raw"))
    return s.select("game_id", "play_id", F.round("next_valid", 3).alias("next_valid"))


@query("type_median", """SELECT p.play_id, CASE WHEN p.play_type IS NULL THEN 0.0 ELSE coalesce(d.dur, 5.0) END::DOUBLE AS duration
    FROM plays p LEFT JOIN durs d ON d.play_type = p.play_type""")
def type_median(t: Tables):
    return sq.with_durations(t.plays).select("play_id", "duration")


@query("monotone_repair", REPAIR + " SELECT game_id, play_id, round(s, 3) AS t_snap, round(e, 3) AS t_end FROM rec")
def monotone_repair(t: Tables):
    ms = lambda c: (F.round(F.col(c) * 1000) / 1000).alias(c)
    return cleaned(t).select("game_id", "play_id", ms("t_snap"), ms("t_end"))


@query("seq_rownum", "SELECT play_id, row_number() OVER (PARTITION BY game_id ORDER BY play_id) - 1 AS seq FROM plays")
def seq_rownum(t: Tables):
    return scan(t.plays, ["game_id"], ["play_id"], hot=t.hot_games_by_id, rn=row_number()).select(
        "play_id", (F.col("rn") - 1).alias("seq"))


SCORES = """SELECT play_id, row_number() OVER (PARTITION BY game_id ORDER BY play_id) - 1 AS seq,
    greatest(coalesce(max(total_home_score) OVER w1, 0), 0) AS home_score_post, greatest(coalesce(max(total_away_score) OVER w1, 0), 0) AS away_score_post,
    greatest(coalesce(max(total_home_score) OVER w0, 0), 0) AS home_score_pre, greatest(coalesce(max(total_away_score) OVER w0, 0), 0) AS away_score_pre
    FROM plays WINDOW w1 AS (PARTITION BY game_id ORDER BY play_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    w0 AS (PARTITION BY game_id ORDER BY play_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query("score_repair", SCORES)
def score_repair(t: Tables):
    return sq.with_scores(t.plays, hot=t.hot_games_by_id).select(
        "play_id", "seq", "home_score_post", "away_score_post", "home_score_pre", "away_score_pre")


@query("play_events", REPAIR + f""", sc AS ({SCORES})
    SELECT c.game_id, c.play_id, sc.seq, round_even(r.s * 1000, 0)::BIGINT AS snap_ms, round_even(r.e * 1000, 0)::BIGINT AS end_ms,
    c.snap IS NULL AS snap_imputed, c.snap_wild, c.ooo AS snap_out_of_order, c.bad AS end_imputed, sc.home_score_pre, sc.home_score_post,
    sc.away_score_pre, sc.away_score_post FROM cl1 c JOIN rec r USING (game_id, i) JOIN sc ON sc.play_id = c.play_id""")
def play_events(t: Tables):
    """The cleaned event table: times, flags, sequence numbers and scores together."""
    e = sq.clean_times(t.plays, limit_s=LIMIT_S, hot=t.hot_games_by_id, scores=True)
    ms = lambda c: F.rint(F.col(c) * 1000).cast("bigint")
    return e.select("game_id", "play_id", "seq", ms("t_snap").alias("snap_ms"), ms("t_end").alias("end_ms"), "snap_imputed",
                    "snap_wild", "snap_out_of_order", "end_imputed", "home_score_pre", "home_score_post",
                    "away_score_pre", "away_score_post")


@query("known_time", """SELECT game_id, seq, CASE WHEN t_end IS NOT NULL THEN max(t_end + 5000000) OVER (PARTITION BY game_id ORDER BY seq
    ROWS UNBOUNDED PRECEDING) END AS known_us FROM play_rows""")
def known_time(t: Tables):
    return sq.with_known_times(t.play_rows, 5.0, hot=t.hot_games_by_id).select("game_id", "seq", us("t_known").alias("known_us"))


@query("timing_summary", """SELECT season, count(DISTINCT game_id) AS games, count(*) AS plays,
    round(avg(CASE WHEN snap_imputed THEN 0.0 ELSE 1.0 END), 6) AS snap_raw, round(avg(CASE WHEN end_imputed THEN 0.0 ELSE 1.0 END), 6) AS end_raw,
    round(avg(CASE WHEN seq % 17 = 0 THEN 1.0 ELSE 0.0 END), 6) AS out_of_order, sum(CASE WHEN seq % 23 = 0 THEN 1 ELSE 0 END)::BIGINT AS wild,
    round(avg(CASE WHEN t_end IS NULL THEN 1.0 ELSE 0.0 END), 6) AS untimed FROM play_rows WHERE play_type IS NOT NULL GROUP BY season""")
def timing_summary(t: Tables):
    e = t.play_rows.withColumns({"snap_out_of_order": F.col("seq") % 17 == 0, "snap_wild": F.col("seq") % 23 == 0,
                                 "t_snap": F.col("t_end")})
    s = sq.timing_summary(e)
    return s.withColumns({c: r6(c) for c in ("snap_raw", "end_raw", "out_of_order", "untimed")})


@query("state_project", """SELECT game_id, seq, season, season_type, home_team AS home, away_team AS away, home_score_pre::INT AS home_score,
    away_score_pre::INT AS away_score, qtr, game_seconds_remaining, posteam, down, yardline_100, home_opening_kickoff = 0 AS home_receives_2h_kickoff,
    posteam = home_team AS posteam_is_home FROM snaps""")
def state_project(t: Tables):
    s = sq.pre_snap(t.snaps)
    return s.select("game_id", "seq", "season", "season_type", "home", "away", "home_score", "away_score", "qtr",
                    "game_seconds_remaining", "posteam", "down", "yardline_100", "home_receives_2h_kickoff", "posteam_is_home")


KICK = """(coalesce({p}play_type = 'kickoff', false) OR coalesce({p}play_type = 'no_play' AND {p}down IS NULL AND contains(coalesce({p}"desc", ''), ' kicks '), false))"""


@query("play_flags", f"""SELECT game_id, seq, play_type IS NOT NULL AND posteam IS NOT NULL AS is_play, {KICK.format(p='')} AS is_kickoff,
    down IS NULL AND NOT {KICK.format(p='')} AS is_try FROM play_rows""")
def play_flags(t: Tables):
    a = (F.col("play_type"), F.col("down"), F.col("desc"))
    return t.play_rows.select("game_id", "seq", (F.col("play_type").isNotNull() & F.col("posteam").isNotNull()).alias("is_play"),
                              rp.is_kickoff(*a).alias("is_kickoff"), rp.is_try(*a).alias("is_try"))


BOUNDS = """SELECT play_type, min(d) AS bound_s FROM (SELECT *, sum(c) OVER (PARTITION BY play_type ORDER BY d) AS cum,
    sum(c) OVER (PARTITION BY play_type) AS n FROM (SELECT play_type, (t_end - t_snap) // 1000000 AS d, count(*) AS c FROM play_rows
    WHERE play_type IS NOT NULL AND NOT snap_imputed AND NOT end_imputed AND t_end IS NOT NULL GROUP BY ALL))
    WHERE cum > floor(0.99::DOUBLE * (n - 1) + 0.5) GROUP BY play_type"""


@query("quantile_nearest", BOUNDS)
def quantile_nearest(t: Tables):
    return rp.end_bounds(t.play_rows)


# one struct per next play, as in the Spark plan
ROLE_SQL.update({
    "bounds": BOUNDS,
    "ot0": """SELECT *, CASE WHEN qtr >= 5 AND down IS NOT NULL THEN posteam END AS tm FROM play_rows""",
    "ot1": """SELECT *, last_value(tm IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lt FROM ot0""",
    "ot2": """SELECT *, coalesce(sum(CASE WHEN tm IS NOT NULL AND (lt IS NULL OR lt <> tm) THEN 1 ELSE 0 END) OVER
        (PARTITION BY game_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - CASE WHEN lt = posteam THEN 1 ELSE 0 END AS runs_before FROM ot1""",
    "np": f"""SELECT p.*, b.bound_s, row_number() OVER w AS rn, lead(seq) OVER w IS NULL AS is_last,
        lead(seq) OVER w AS n_seq, lead(p.posteam) OVER w AS n_posteam, lead(down) OVER w AS n_down, lead(ydstogo) OVER w AS n_ydstogo,
        lead(yardline_100) OVER w AS n_yl, lead(t_snap) OVER w AS n_snap, lead(snap_imputed) OVER w AS n_imp, lead(qtr) OVER w AS n_qtr,
        lead(game_seconds_remaining) OVER w AS n_gsr, lead(half_seconds_remaining) OVER w AS n_hsr, lead(game_half) OVER w AS n_half,
        lead(home_timeouts) OVER w AS n_hto, lead(away_timeouts) OVER w AS n_ato, lead(home_score_pre) OVER w AS n_hs, lead(away_score_pre) OVER w AS n_as,
        lead(runs_before) OVER w AS n_runs,
        lead(CASE WHEN {KICK.format(p='p.')} THEN 'kickoff' WHEN down IS NULL THEN 'pat' ELSE 'snap' END) OVER w AS n_phase,
        down IS NULL AND NOT {KICK.format(p='p.')} AS is_try,
        least(least(greatest((t_end - t_snap)/1e6, 0), 40), CASE WHEN qtr <= 4 THEN half_seconds_remaining ELSE game_seconds_remaining END) AS len
        FROM (SELECT * FROM ot2 WHERE play_type IS NOT NULL AND posteam IS NOT NULL AND t_end IS NOT NULL) p LEFT JOIN bounds b ON b.play_type = p.play_type
        WINDOW w AS (PARTITION BY game_id ORDER BY seq)""",
    "pt0": """SELECT *, greatest(CASE WHEN qtr <= 4 THEN half_seconds_remaining ELSE game_seconds_remaining END - len, 0) AS lft,
        CASE WHEN is_last THEN NOT (qtr >= 5 AND home_score_post <> away_score_post) ELSE n_half <> game_half END AS over,
        CASE WHEN NOT is_last AND NOT n_imp THEN n_snap END AS cap FROM np""",
    "pt1": """SELECT *, coalesce(over AND lft > 0, false) AS runs_out,
        CASE WHEN end_imputed THEN t_snap + coalesce(bound_s, 20) * 1000000 ELSE t_end END AS b0 FROM pt0""",
    "pt2": """SELECT *, CASE WHEN (runs_out OR end_imputed) AND cap IS NOT NULL THEN least(b1, cap) ELSE b1 END AS b2 FROM (SELECT *,
        b0 + CASE WHEN runs_out THEN CAST(round(lft * 1000000) AS BIGINT) ELSE 0 END AS b1 FROM pt1)""",
    "pub": """SELECT *, greatest(CASE WHEN regexp_matches("desc", '(?i)replay official|challenged|reviewed|reversed|upheld') THEN greatest(b2, coalesce(cap, t_end + 240000000))
          WHEN regexp_matches("desc", '(?i)penalty') THEN greatest(b2, least(t_end + 60000000, cap)) ELSE b2 END, t_end) AS t_public,
        CASE WHEN regexp_matches("desc", '(?i)replay official|challenged|reviewed|reversed|upheld') THEN 'review'
          WHEN regexp_matches("desc", '(?i)penalty') THEN 'penalty' WHEN runs_out THEN 'clock' WHEN end_imputed THEN 'imputed' ELSE 'end' END AS timing FROM pt2""",
})


@query("phase_lead", """SELECT game_id, seq, n_phase AS phase, CASE WHEN n_phase = 'kickoff' THEN n_posteam <> home_team END AS kicker_home
    FROM np WHERE NOT is_last""")
def phase_lead(t: Tables):
    n = rp.with_next(t.play_rows, rp.end_bounds(t.play_rows), t.hot_games_by_id).filter("nxt IS NOT NULL")
    phase = rp.phase_of(F.col("nxt.play_type"), F.col("nxt.down"), F.col("nxt.desc"))
    return n.select("game_id", "seq", phase.alias("phase"),
                    F.when(phase == "kickoff", F.col("nxt.posteam") != F.col("home_team")).alias("kicker_home"))


@query("clamp", """SELECT game_id, seq, round(l, 6) AS length, round(greatest(left_ - l, 0), 6) AS clock_left FROM (SELECT *,
    CASE WHEN qtr <= 4 THEN half_seconds_remaining ELSE game_seconds_remaining END AS left_,
    least(least(greatest((t_end - t_snap)/1e6, 0), 40), CASE WHEN qtr <= 4 THEN half_seconds_remaining ELSE game_seconds_remaining END) AS l
    FROM play_rows WHERE t_end IS NOT NULL)""")
def clamp(t: Tables):
    a = [F.col(c) for c in ("t_snap", "t_end", "qtr", "game_seconds_remaining", "half_seconds_remaining")]
    return t.play_rows.filter("t_end IS NOT NULL").select("game_id", "seq", r6(rp.play_length(*a)).alias("length"),
                                                          r6(rp.clock_left(*a)).alias("clock_left"))


@query("public_time", "SELECT game_id, seq, timing, t_public AS public_us FROM pub")
def public_time(t: Tables):
    p = rp.with_public_time(rp.with_next(t.play_rows, rp.end_bounds(t.play_rows), t.hot_games_by_id))
    return p.select("game_id", "seq", "timing", us("t_public").alias("public_us"))


TOSS = "(n_half <> game_half AND n_qtr >= 5 AND qtr <= 4)"
REPLAY = f"""SELECT game_id, row_number() OVER w - 1 AS "order", seq, kind, max(t_raw) OVER w AS t_us, timing, phase, kicker_home, free_kick,
      ot_possessions, qtr, gsr AS game_seconds_remaining, home_score, away_score, posteam, down, home_timeouts FROM (
    SELECT game_id, seq AS rs, 0 AS pos, -1 AS seq, 'pregame' AS kind, t_snap AS t_raw, 'pregame' AS timing, 'kickoff' AS phase,
      home_opening_kickoff = 0 AS kicker_home, false AS free_kick, 0 AS ot_possessions, 1 AS qtr, 3600.0 AS gsr, 0 AS home_score, 0 AS away_score,
      NULL AS posteam, NULL AS down, 3 AS home_timeouts FROM pub WHERE rn = 1
    UNION ALL SELECT game_id, seq, 1, seq, 'play', t_public, timing, n_phase,
      CASE WHEN n_phase = 'kickoff' AND NOT {TOSS} THEN n_posteam <> home_team END,
      n_phase = 'kickoff' AND NOT is_try AND CASE WHEN posteam = home_team THEN away_score_post - away_score_pre = 2 AND home_score_post = home_score_pre
        ELSE home_score_post - home_score_pre = 2 AND away_score_post = away_score_pre END,
      CASE WHEN n_qtr >= 5 THEN n_runs ELSE 0 END, n_qtr,
      CASE WHEN n_half = game_half AND n_phase = 'snap' THEN game_seconds_remaining - len ELSE n_gsr END, home_score_post, away_score_post,
      n_posteam, n_down, CASE WHEN n_half <> game_half THEN n_hto ELSE home_timeouts END FROM pub WHERE NOT is_last
    UNION ALL SELECT game_id, seq, 2, n_seq, 'snap', n_snap, 'snap', n_phase, CASE WHEN {TOSS} AND n_phase = 'kickoff' THEN n_posteam <> home_team END, false,
      CASE WHEN n_qtr >= 5 THEN n_runs ELSE 0 END, n_qtr, n_gsr, n_hs, n_as, n_posteam, n_down, n_hto FROM pub
      WHERE NOT is_last AND NOT n_imp AND ({TOSS} OR (n_phase = 'snap' AND (n_qtr >= 4 OR (n_qtr = 2 AND n_hsr <= 300))))
    UNION ALL SELECT game_id, seq, 1, seq, 'final', t_public, timing, 'snap', NULL, false, 0, qtr, 0.0, home_score_post, away_score_post, posteam, down,
      home_timeouts FROM pub WHERE is_last) WINDOW w AS (PARTITION BY game_id ORDER BY rs, pos ROWS UNBOUNDED PRECEDING)"""
ROLE_SQL["replayed"] = REPLAY


@query("replay_events", """SELECT game_id, "order", seq, kind, t_us, timing, phase, kicker_home, free_kick, ot_possessions::BIGINT AS ot_possessions,
    qtr, round(game_seconds_remaining, 6)::DOUBLE AS game_seconds_remaining, home_score, away_score, posteam, down, home_timeouts FROM replayed""")
def replay_events(t: Tables):
    e = rp.replay_events(t.play_rows, rp.end_bounds(t.play_rows), t.hot_games_by_id)
    return e.select("game_id", "order", "seq", "kind", us("t").alias("t_us"), "timing", "phase", "kicker_home", "free_kick",
                    "ot_possessions", "qtr", r6("game_seconds_remaining").alias("game_seconds_remaining"), "home_score",
                    "away_score", "posteam", "down", "home_timeouts")


@query("islands_count", """SELECT game_id, seq, runs_before::BIGINT AS runs_before FROM ot2""")
def islands_count(t: Tables):
    ot = (F.col("qtr") >= 5) & F.col("down").isNotNull() & F.col("posteam").isNotNull()
    return sq.possession_runs(t.play_rows, ot, hot=t.hot_games_by_id).select("game_id", "seq", "runs_before")


@query("entity_list", """SELECT game_id, min(event_id) AS first_id FROM ev GROUP BY game_id ORDER BY 2 LIMIT 25""")
def entity_list(t: Tables):
    """The first 25 games in order of appearance (a listing of entities, the operator's own limit)."""
    return t.ev.groupBy("game_id").agg(F.min("event_id").alias("first_id")).orderBy("first_id").limit(25)
