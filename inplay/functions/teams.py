"""Team codes, names and contract series as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: schedule team codes
TEAMS = ("ARI", "ATL", "BAL", "BUF", "CAR", "CHI", "CIN", "CLE", "DAL", "DEN", "DET", "GB", "HOU", "IND", "JAX", "KC",
         "LA", "LAC", "LV", "MIA", "MIN", "NE", "NO", "NYG", "NYJ", "PHI", "PIT", "SEA", "SF", "TB", "TEN", "WAS")
# fixed values: ticker spellings of schedule codes
ALIASES = {"JAC": "JAX", "LAR": "LA", "WSH": "WAS", "LVR": "LV"}
SPELLINGS = {"JAX": ("JAC", "JAX"), "LA": ("LA", "LAR")}
# fixed values: place and nickname per code
NAMES = {
    "ARI": ("Arizona", "Cardinals"), "ATL": ("Atlanta", "Falcons"), "BAL": ("Baltimore", "Ravens"),
    "BUF": ("Buffalo", "Bills"), "CAR": ("Carolina", "Panthers"), "CHI": ("Chicago", "Bears"),
    "CIN": ("Cincinnati", "Bengals"), "CLE": ("Cleveland", "Browns"), "DAL": ("Dallas", "Cowboys"),
    "DEN": ("Denver", "Broncos"), "DET": ("Detroit", "Lions"), "GB": ("Green Bay", "Packers"),
    "HOU": ("Houston", "Texans"), "IND": ("Indianapolis", "Colts"), "JAX": ("Jacksonville", "Jaguars"),
    "KC": ("Kansas City", "Chiefs"), "LA": ("Los Angeles R", "Rams"), "LAC": ("Los Angeles C", "Chargers"),
    "LV": ("Las Vegas", "Raiders"), "MIA": ("Miami", "Dolphins"), "MIN": ("Minnesota", "Vikings"),
    "NE": ("New England", "Patriots"), "NO": ("New Orleans", "Saints"), "NYG": ("New York G", "Giants"),
    "NYJ": ("New York J", "Jets"), "PHI": ("Philadelphia", "Eagles"), "PIT": ("Pittsburgh", "Steelers"),
    "SEA": ("Seattle", "Seahawks"), "SF": ("San Francisco", "49ers"), "TB": ("Tampa Bay", "Buccaneers"),
    "TEN": ("Tennessee", "Titans"), "WAS": ("Washington", "Commanders"),
}
SHARED_CITY = ("NYG", "NYJ", "LA", "LAC")  # fixed values
# fixed values: contract series
GAME_SERIES, SPREAD_SERIES, TOTAL_SERIES = "KXNFLGAME", "KXNFLSPREAD", "KXNFLTOTAL"
CONFERENCE_SERIES = ("KXNFLAFCCHAMP", "KXNFLNFCCHAMP")
FINAL_SERIES = "KXSB"
WINNER_SERIES = (GAME_SERIES, *CONFERENCE_SERIES, FINAL_SERIES)
# fixed values: months and the form of an event ticker
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
EVENT_PATTERN = r"^([A-Z0-9]+)-(\d{2})([A-Z]{3})(\d{2})([A-Z]+)$"


def squash(text: str) -> str:
    return "".join(ch for ch in text.upper() if ch.isascii() and ch.isalnum())


def normalized(c: Column) -> Column:
    """Upper case without spaces and punctuation."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def code_map() -> dict[str, str]:
    return {**{t: t for t in TEAMS}, **ALIASES}


def name_map() -> dict[str, str]:
    return {squash(n): code for code, names in NAMES.items() for n in names}


def to_code(c: Column) -> Column:
    """Schedule code of a ticker code; null where unknown."""
    return F.try_element_at(_map(code_map()), c)


def team_from_token(c: Column) -> Column:
    """Code of a ticker's team token, by code or by spelled-out name."""
    return F.coalesce(to_code(c), F.try_element_at(_map(name_map()), normalized(c)))


def team_from_text(text: Column, candidates: Column) -> Column:
    """The one candidate that a text names; a city that two teams share counts only as a last resort
    and only if one candidate has it. Null if none or several."""
    words = normalized(F.coalesce(text, F.lit("")))
    full = F.create_map(*[x for code, names in NAMES.items()
                          for x in (F.lit(code), F.array(*[F.lit(squash(n)) for n in names]))])
    city = _map({c: squash(NAMES[c][0])[:-1] for c in SHARED_CITY})

    def named(code: Column) -> Column:
        return F.coalesce(F.exists(F.try_element_at(full, code), lambda n: F.contains(words, n)), F.lit(False))

    def in_city(code: Column) -> Column:
        return ~named(code) & F.coalesce(F.contains(words, F.try_element_at(city, code)), F.lit(False))

    exact, loose = F.filter(candidates, named), F.filter(candidates, in_city)
    return F.when(F.size(exact) == 1, F.get(exact, F.lit(0))).when(F.size(loose) == 1, F.get(loose, F.lit(0)))


def split_pair(c: Column) -> Column:
    """struct(away, home) of two joined codes, if exactly one split gives two different teams."""
    cuts = F.when(F.length(c) >= 4, F.sequence(F.lit(2), F.length(c) - 2)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(cuts, lambda i: F.struct(to_code(F.substring(c, F.lit(1), i)).alias("away"),
                                                 to_code(F.substring(c, i + 1, F.length(c))).alias("home")))
    good = F.filter(pairs, lambda p: p["away"].isNotNull() & p["home"].isNotNull() & (p["away"] != p["home"]))
    return F.when(F.size(good) == 1, F.get(good, F.lit(0)))


def parse_event_ticker(c: Column) -> Column:
    """struct(series, day, suffix, away, home); null unless the form and the date are valid."""
    part = lambda i: F.regexp_extract(c, EVENT_PATTERN, i)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(3))
    day = F.to_date(F.try_to_timestamp(F.concat(F.lit("20"), part(2), F.lit("-"), F.lpad(month.cast("string"), 2, "0"),
                                                F.lit("-"), part(4)), F.lit("yyyy-MM-dd")))
    pair = split_pair(part(5))
    ok = c.rlike(EVENT_PATTERN) & (month > 0) & day.isNotNull()
    return F.when(ok, F.struct(part(1).alias("series"), day.alias("day"), F.regexp_extract(c, "-(.*)$", 1).alias("suffix"),
                               pair["away"].alias("away"), pair["home"].alias("home")))


def candidate_suffixes(gameday: Column, away: Column, home: Column) -> Column:
    """Suffixes to try for a game: every spelling of both codes, in both orders, without repeats."""
    spell = F.create_map(*[x for code, s in SPELLINGS.items() for x in (F.lit(code), F.array(*[F.lit(v) for v in s]))])
    forms = lambda c: F.coalesce(F.try_element_at(spell, c), F.array(c))
    date = F.concat(F.date_format(gameday, "yy"), F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(gameday)),
                    F.date_format(gameday, "dd"))
    return F.array_distinct(F.flatten(F.flatten(F.transform(forms(away), lambda a: F.transform(
        forms(home), lambda h: F.array(F.concat(date, a, h), F.concat(date, h, a)))))))


def championship_events(game_type: Column, season: Column) -> Column:
    """Events, in the order to try, that settle on a championship game's winner."""
    yy = lambda s: F.lpad((s % 100).cast("string"), 2, "0")
    conf = F.array(*[F.concat(F.lit(f"{s}-"), yy(season)) for s in CONFERENCE_SERIES])
    return F.when(game_type == "CON", conf).when(game_type == "SB", F.array(F.concat(F.lit(f"{FINAL_SERIES}-"), yy(season + 1)))
                                                 ).otherwise(F.array().cast("array<string>"))


def last_token(ticker: Column) -> Column:
    return F.substring_index(ticker, "-", -1)


def classify(ticker: Column, series: Column, floor_strike: Column, home: Column, away: Column, sub_title: Column,
             title: Column) -> Column:
    """struct(kind, side, strike, problem): what a contract pays on. `problem` says why a row cannot be
    classified; callers either quarantine those rows or raise."""
    tail = last_token(ticker)
    rung = r"^([A-Z]+?)(\d+)$"
    winner, spread, total = series.isin(*WINNER_SERIES), series == SPREAD_SERIES, series == TOTAL_SERIES
    has_rung = tail.rlike(rung)
    token = F.when(winner, tail).when(spread & has_rung, F.regexp_extract(tail, rung, 1))
    number = F.when(spread & has_rung, F.regexp_extract(tail, rung, 2)).when(total & tail.rlike(r"^\d+$"), tail)
    kind = F.when(winner, "winner").when(spread, "spread").when(total, "total")
    strike = F.when(~winner, F.coalesce(floor_strike, number.cast("double") + 0.5))
    both = F.array(home, away)
    team = team_from_token(token)
    team = F.when(team.isin(home, away), team).otherwise(F.coalesce(team_from_text(sub_title, both), team_from_text(title, both)))
    side = F.when(kind != "total", F.when(team == home, "home").when(team == away, "away"))
    problem = F.when(kind.isNull(), "not a game market").when((kind != "total") & side.isNull(), "neither team")
    return F.struct(kind.alias("kind"), side.alias("side"), strike.alias("strike"), problem.alias("problem"))


def checked(classified: Column) -> Column:
    """The classification, failing the job on the first row with a problem."""
    return F.when(classified["problem"].isNotNull(), F.raise_error(classified["problem"])).otherwise(classified)
