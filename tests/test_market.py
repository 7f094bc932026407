"""Market JSON, tickers, matching, classification, coverage, priors."""

import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from inplay.functions import parsing as ps, teams as tm
from inplay.operators import quotes as qt
from inplay.sources import tables as tb
from tests.conftest import T0, at, since

OLD = {"ticker": "Q", "end_period_ts": 1759000020, "volume": "88.00", "open_interest": "1250.00", "price": {"close": "0.4100", "mean": "0.4050"},
       "yes_bid": {"close": "0.4000"}, "yes_ask": {"open": "0.4000", "close": "0.4300"}}
ONE_SIDED = {"ticker": "Q", "end_period_ts": 1759000320, "price": {"close": "0.0200"}, "yes_bid": {"close": "0.0000"}, "yes_ask": {"close": "0.0300"}}
LIVE = {"ticker": "Q", "end_period_ts": 1790001000, "volume_fp": "7.50", "open_interest_fp": "52.25", "price": {"mean_dollars": "0.3275", "close_dollars": "0.3300"},
        "yes_bid": {"close_dollars": "0.3100"}, "yes_ask": {"close_dollars": "0.3500"}}
MARKET = {"ticker": "KXNFLGAME-24OCT13DENNYJ-DEN", "title": "Denver at New York J", "yes_sub_title": "Denver", "close_time": "2024-10-13T23:58:01Z",
          "settlement_ts": "2024-10-14T00:10:30.5Z", "settlement_value_dollars": "0.0000", "result": "no", "volume_fp": "412.25"}


def lines(tmp_path, *rows):
    path = tmp_path / "rows.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_both_spellings_give_the_same_columns(spark, tmp_path):
    old, thin, live = tb.read_candles(spark, lines(tmp_path, LIVE, OLD, ONE_SIDED)).orderBy("end_ts").collect()
    assert (old.bid_close, old.ask_open, old.ask_close, old.trade_close, old.trade_mean, old.volume, old.open_interest) == (0.40, 0.40, 0.43, 0.41, 0.405, 88.0, 1250.0)
    assert (old.mid_close, old.spread_close) == (pytest.approx(0.415), pytest.approx(0.03))
    assert (live.bid_close, live.ask_close, live.trade_close, live.trade_mean, live.volume, live.open_interest) == (0.31, 0.35, 0.33, 0.3275, 7.5, 52.25)
    assert (thin.bid_close, thin.ask_close, thin.mid_close, thin.spread_close) == (0.0, 0.03, None, None)
    assert old.end_ts == dt.datetime.fromtimestamp(1759000020, dt.timezone.utc).replace(tzinfo=None)


def test_trades_and_markets(spark, tmp_path):
    trade = {"ticker": "Q", "trade_id": "z9", "created_time": "2024-10-13T20:01:02.5Z", "yes_price_dollars": "0.1500", "count_fp": "3.00", "taker_side": "no"}
    r = tb.read_trades(spark, lines(tmp_path, trade)).collect()[0].asDict()
    assert (r["yes_price"], r["count"], r["taker_side"], r["is_block_trade"], r["ts"]) == (0.15, 3.0, "no", False, dt.datetime(2024, 10, 13, 20, 1, 2, 500000))
    m = tb.read_markets(spark, lines(tmp_path, MARKET)).collect()[0]
    assert (m.series_ticker, m.event_ticker, m.result, m.settlement_value, m.volume) == ("KXNFLGAME", "KXNFLGAME-24OCT13DENNYJ", "no", 0.0, 412.25)
    assert (m.settlement_ts - m.close_time).total_seconds() == 749.5


def test_price_units(spark):
    def parsed(fn, *texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, j string").orderBy("i")
        return [r[0] for r in df.select(fn(F.parse_json("j"))).collect()]

    assert parsed(ps.price, "5", '"0.0500"', '""', "null", '"1.0000"') == [0.05, 0.05, None, None, 1.0]
    assert parsed(ps.quantity, "12", '"12.50"') == [12.0, 12.5]
    assert parsed(ps.timestamp, "86400", '"2024-02-29T12:00:00.25Z"') == [dt.datetime(1970, 1, 2), dt.datetime(2024, 2, 29, 12, 0, 0, 250000)]
    with pytest.raises(PySparkException):
        parsed(ps.price, "false")


@pytest.mark.parametrize("bid,ask,ok", [(0.05, 0.95, True), (0.3, 0.3, True), (0.31, 0.3, False), (0.0, 0.1, False), (0.9, 1.0, False), (0.2, None, False), (None, None, False)])
def test_valid_quote(spark, bid, ask, ok):
    df = spark.createDataFrame([(bid, ask)], "b double, a double")
    assert df.select(ps.valid_quote(F.col("b"), F.col("a"))).collect()[0][0] is ok


def values(spark, inputs, fn):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_pairs_tokens_and_tickers(spark):
    pairs = {"DENNYJ": ("DEN", "NYJ"), "KCLV": ("KC", "LV"), "LVKC": ("LV", "KC"), "HOUJAC": ("HOU", "JAX"), "LARDAL": ("LA", "DAL"), "LALAC": ("LA", "LAC"), "GBNE": ("GB", "NE"), "DENXXX": None, "": None}
    got = values(spark, list(pairs), tm.split_pair)
    assert {k: p and tuple(p) for k, p in zip(pairs, got)} == pairs
    tokens = {"KC": "KC", "JAC": "JAX", "LAR": "LA", "CHICAGO": "CHI", "GREENBAY": "GB", "NEWYORKJ": "NYJ", "LOSANGELESR": "LA", "UNKNOWN": None}
    assert dict(zip(tokens, values(spark, list(tokens), tm.team_from_token))) == tokens
    good, month, junk = values(spark, ["KXNFLGAME-24DEC01PITCIN", "KXNFLGAME-24QQQ01PITCIN", "PITCIN"], tm.parse_event_ticker)
    assert tuple(good) == ("KXNFLGAME", dt.date(2024, 12, 1), "24DEC01PITCIN", "PIT", "CIN") and month is None and junk is None
    assert not set(tm.NAMES) ^ set(tm.TEAMS)


@pytest.mark.parametrize("text,pair,team", [
    ("Will Denver win by 6.5?", ("DEN", "NYJ"), "DEN"), ("New York J by over 9.5", ("DEN", "NYJ"), "NYJ"), ("New York by 1", ("DEN", "NYJ"), "NYJ"),
    ("New York by 1", ("NYG", "NYJ"), None), ("Los Angeles R by 4.5", ("LA", "LAC"), "LA"), ("Both score 30", ("KC", "LV"), None)])
def test_text_names_one_team(spark, text, pair, team):
    got = spark.range(1).select(tm.team_from_text(F.lit(text), F.array(F.lit(pair[0]), F.lit(pair[1])))).collect()[0][0]
    assert got == team


def test_suffixes_and_championships(spark):
    def one(c):
        return spark.range(1).select(c).collect()[0][0]

    def suffixes(day, a, h):
        return one(tm.candidate_suffixes(F.lit(day).cast("date"), F.lit(a), F.lit(h)))

    assert suffixes("2023-11-05", "KC", "MIA") == ["23NOV05KCMIA", "23NOV05MIAKC"]
    assert sorted(suffixes("2022-12-18", "DAL", "JAX")) == sorted(f"22DEC18{p}" for p in ("DALJAX", "JAXDAL", "DALJAC", "JACDAL"))
    by_type = {g: one(tm.championship_events(F.lit(g), F.lit(2022))) for g in ("REG", "CON", "SB")}
    assert by_type == {"REG": [], "CON": ["KXNFLAFCCHAMP-22", "KXNFLNFCCHAMP-22"], "SB": ["KXSB-23"]}


def classify(spark, ticker, series, strike, home, away, sub=None, title=None):
    args = [F.lit(x) if x is not None else F.lit(None).cast(t) for x, t in ((ticker, "string"), (series, "string"), (strike, "double"), (home, "string"), (away, "string"), (sub, "string"), (title, "string"))]
    return tuple(spark.range(1).select(tm.classify(*args).alias("c")).select("c.*").collect()[0])


def test_classification(spark):
    game = "24OCT13DENNYJ"
    assert classify(spark, f"KXNFLGAME-{game}-DEN", "KXNFLGAME", None, "NYJ", "DEN")[:3] == ("winner", "away", None)
    assert classify(spark, f"KXNFLSPREAD-{game}-NYJ7", "KXNFLSPREAD", None, "NYJ", "DEN")[:3] == ("spread", "home", 7.5)
    assert classify(spark, f"KXNFLSPREAD-{game}-DEN7", "KXNFLSPREAD", 6.5, "NYJ", "DEN")[:3] == ("spread", "away", 6.5)
    assert classify(spark, f"KXNFLSPREAD-{game}-NEWYORKJ3", "KXNFLSPREAD", 3.5, "NYJ", "DEN")[1] == "home"
    assert classify(spark, "KXNFLSPREAD-X-YY9", "KXNFLSPREAD", 9.5, "NYJ", "DEN", "Denver by over 9.5 points")[1] == "away"
    assert classify(spark, f"KXNFLTOTAL-{game}-38", "KXNFLTOTAL", 38.5, "NYJ", "DEN")[:3] == ("total", None, 38.5)
    assert classify(spark, "KXSB-23-PHI", "KXSB", None, "PHI", "KC")[:2] == ("winner", "home")
    assert classify(spark, f"KXNFLGAME-{game}-CHI", "KXNFLGAME", None, "NYJ", "DEN")[3] == "neither team"
    with pytest.raises(PySparkException):
        c = tm.classify(F.lit(f"KXNFLGAME-{game}-CHI"), F.lit("KXNFLGAME"), F.lit(None).cast("double"), F.lit("NYJ"), F.lit("DEN"), F.lit(""), F.lit(""))
        spark.range(1).select(tm.checked(c)).collect()


def test_matching(spark):
    games = [("a1", "REG", dt.date(2024, 10, 13), "DEN", "NYJ"), ("a2", "REG", dt.date(2024, 12, 2), "HOU", "JAX"), ("a3", "SB", dt.date(2025, 2, 9), "KC", "PHI")]
    sched = spark.createDataFrame(games, "game_id string, game_type string, gameday date, away_team string, home_team string")
    want = {"24OCT13DENNYJ": ("a1", "matched"), "24DEC01JACHOU": ("a2", "matched"), "25FEB09PHIKC": ("a3", "matched"), "24NOV13DENNYJ": (None, "no_game"),
            "24OCT13QQQNYJ": (None, "unparsed")}
    m = qt.match_events(spark.createDataFrame([(f"KXNFLGAME-{n}",) for n in want], "event_ticker string"), sched)
    assert {r.event_ticker.split("-")[1]: (r.game_id, r.status) for r in m.collect()} == want
    assert sorted({r.game_id for r in qt.build_catalog(m, sched).collect()}) == ["a1", "a2", "a3"]


def test_coverage(spark):
    markets = [("g", "w1", "winner", "home", 9.0), ("g", "w2", "winner", "away", 4.0), ("g", "s1", "spread", "away", 0.0), ("g", "s2", "spread", "away", 1.0), ("g", "t1", "total", None, 3.0)]
    mk = spark.createDataFrame(markets, "game_id string, ticker string, kind string, side string, volume double")
    quotes = {1: (0.2, 0.3, 0.25), 2: (0.2, 0.3, 0.25), 3: (0.2, 0.3, 0.25), 4: (0.0, 0.1, None), 9: (0.2, 0.3, 0.25)}
    cd = spark.createDataFrame([("g", "w1", at(60 * i), *q) for i, q in quotes.items()], "game_id string, ticker string, end_ts timestamp, bid_close double, ask_close double, mid_close double")
    timing = spark.createDataFrame([("g", 1.0, T0, at(300))], "game_id string, snap_raw double, first_snap timestamp, last_end timestamp")
    c = qt.coverage(mk, cd, spark.createDataFrame([("g",)] * 3, "game_id string"), timing).collect()[0]
    assert (c.winner_markets, c.traded_rungs, c.trades) == (2, 2, 3)
    assert (c.in_game_quote_share, c.two_sided_share) == (pytest.approx(4 / 5), pytest.approx(3 / 5))


def test_priors(spark):
    markets = [("h", "winner", "home", None), ("a", "winner", "away", None), *[(f"t{k}", "total", None, k + 0.5) for k in (37, 38, 39)], ("x38", "total", None, 38.5)]
    mk = spark.createDataFrame(markets, "ticker string, kind string, side string, strike double")
    # minutes before kickoff: the last two-sided quote counts, one after kickoff does not, nor does a wide one
    rows = [("g", "h", 9, 0.30, 0.02), ("g", "h", 2, 0.34, 0.02), ("g", "h", -3, 0.70, 0.02), ("g", "a", 2, 0.64, 0.02), ("g", "t37", 2, 0.60, 0.02), ("g", "t38", 2, 0.52, 0.02),
            ("g", "t39", 2, 0.42, 0.02), ("u", "x38", 2, 0.45, 0.40)]
    cd = spark.createDataFrame([(g, t, at(-60 * m), p, w) for g, t, m, p, w in rows], "game_id string, ticker string, end_ts timestamp, mid_close double, spread_close double")
    ko = spark.createDataFrame([("g", T0, -1.5, 38.0), ("u", T0, 6.0, 47.5)], "game_id string, kickoff timestamp, spread_line double, total_line double")
    g, u = qt.priors(cd, mk, ko).orderBy("game_id").collect()
    assert (g.home_win, g.total) == (pytest.approx((0.34 + 1 - 0.64) / 2), pytest.approx(38.5 + 0.02 / 0.10))
    assert (g.win_source, g.total_source, since(g.quoted_at)) == ("market", "market", -120)
    assert (u.home_win, u.win_source, u.home_spread, u.total, u.total_source) == (None, "line", 6.0, 47.5, "line")
