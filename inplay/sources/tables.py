"""Scans and sinks: seasonal tables, landing-zone JSON, the append-only price log, reports."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StringType, StructType

from inplay.functions.parsing import normalize_candles, normalize_markets, normalize_trades

# fixed values: schemas of the normalized market tables
CANDLE_SCHEMA = ("game_id STRING, ticker STRING, end_ts TIMESTAMP, bid_open DOUBLE, bid_high DOUBLE, bid_low DOUBLE, "
                 "bid_close DOUBLE, ask_open DOUBLE, ask_high DOUBLE, ask_low DOUBLE, ask_close DOUBLE, trade_open DOUBLE, "
                 "trade_high DOUBLE, trade_low DOUBLE, trade_close DOUBLE, trade_mean DOUBLE, volume DOUBLE, "
                 "open_interest DOUBLE, mid_close DOUBLE, spread_close DOUBLE")
TRADE_SCHEMA = ("game_id STRING, trade_id STRING, ticker STRING, ts TIMESTAMP, yes_price DOUBLE, count DOUBLE, "
                "taker_side STRING, is_block_trade BOOLEAN")
MARKET_SCHEMA = ("game_id STRING, ticker STRING, event_ticker STRING, series_ticker STRING, kind STRING, side STRING, "
                 "strike DOUBLE, title STRING, yes_sub_title STRING, status STRING, result STRING, open_time TIMESTAMP, "
                 "close_time TIMESTAMP, settlement_ts TIMESTAMP, settlement_value DOUBLE, strike_type STRING, "
                 "floor_strike DOUBLE, cap_strike DOUBLE, volume DOUBLE, open_interest DOUBLE, last_price DOUBLE, "
                 "rules_primary STRING, rules_secondary STRING")


def schema_of(ddl: str | StructType) -> StructType:
    return StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl


def conform(df: DataFrame, schema: str | StructType) -> DataFrame:
    """Project onto a declared schema: unknown columns dropped, missing ones null, the rest cast."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema_of(schema).fields])


_WIDTH = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def _supertype(types: list[DataType]) -> DataType:
    names = {t.simpleString() for t in types}
    if len(names) == 1:
        return types[0]
    real = [t for t in types if t.simpleString() != "void"]
    if real and all(t.simpleString() in _WIDTH for t in real):
        return max(real, key=lambda t: _WIDTH.index(t.simpleString()))
    if len({t.simpleString() for t in real}) == 1:
        return real[0]
    return StringType()


def union_relaxed(frames: Sequence[DataFrame], schema: str | StructType | None = None) -> DataFrame:
    """Union by name; each column takes the widest type any frame gives it (or the declared one), and
    frames without it give nulls."""
    if schema is not None:
        return reduce(DataFrame.unionByName, [conform(f, schema) for f in frames])
    types: dict[str, list[DataType]] = {}
    for f in frames:
        for c in f.schema.fields:
            types.setdefault(c.name, []).append(c.dataType)
    wide = {n: _supertype(t) for n, t in types.items()}
    cast = [f.select(*[F.col(c).cast(wide[c]).alias(c) for c in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def season_path(root: str, name: str, season: int) -> str:
    return f"{root}/{name}_{season}.parquet"


def missing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Paths that do not exist, on whatever file system they name."""
    def absent(path: str) -> bool:
        try:
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).schema
            return False
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return True

    return [p for p in paths if absent(p)]


def load_seasons(spark: SparkSession, root: str, name: str, seasons: Sequence[int],
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Seasons of a table whose column types drift, pruned to `columns`; fails naming absent seasons."""
    paths = {s: season_path(root, name, s) for s in seasons}
    gone = set(missing_paths(spark, list(paths.values())))
    if gone:
        raise FileNotFoundError(f"{name}: no data for seasons {[s for s, p in paths.items() if p in gone]}")
    frames = [spark.read.parquet(p) for p in paths.values()]
    if columns:
        frames = [f.select(*[c for c in columns if c in f.columns]) for f in frames]
    return union_relaxed(frames)


def load_schedules(df: DataFrame, seasons: Sequence[int], column: str = "season", date: str | None = None) -> DataFrame:
    """Rows of the seasons, by a season column or, where there is none, by ranges of a date column (calendar
    years), which the scan can skip files and row groups by."""
    if date is None:
        return df.filter(F.col(column).isin(*seasons))
    day = lambda y: F.lit(f"{y}-01-01").cast(df.schema[date].dataType)
    spans = [(F.col(date) >= day(y)) & (F.col(date) < day(y + 1)) for y in seasons]
    return df.filter(reduce(lambda a, b: a | b, spans, F.lit(False)))


def save_by_season(df: DataFrame, path: str, column: str = "season") -> None:
    """Write a derived table one folder per season, replacing only the seasons it holds."""
    df.repartition(F.col(column), F.pmod(F.xxhash64(df.columns[0]), F.lit(16))).write.mode(
        "overwrite").partitionBy(column).option("partitionOverwriteMode", "dynamic").parquet(path)


def load_by_season(spark: SparkSession, path: str, seasons: Sequence[int] | None = None, column: str = "season") -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col(column).isin(*seasons)) if seasons else df


# ------------------------------------------------------------------ landing zone


def read_variant(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as one variant column v, so that 72 and "72" stay different."""
    return spark.read.option("singleVariantColumn", "v").json(path)


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    raw = read_variant(spark, path).withColumn("ticker", F.try_variant_get("v", "$.ticker", "string"))
    return normalize_candles(raw)


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    return normalize_trades(read_variant(spark, path))


def read_markets(spark: SparkSession, path: str) -> DataFrame:
    return normalize_markets(read_variant(spark, path))


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by `order`: an aggregation with map-side partials, so a key repeated many
    times costs no window."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return last.select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def consolidate(spark: SparkSession, pattern: str, out: str, drop: Sequence[str] = ()) -> None:
    """Files of finished games (a glob) to one table, without the listed columns. Column types may drift from file
    to file: files are grouped by their own schema, read group by group, and united by supertypes."""
    files = [r["path"] for r in spark.read.format("binaryFile").load(pattern).select("path").toLocalIterator()]
    if not files:
        raise FileNotFoundError(pattern)
    groups: dict[str, list[str]] = {}
    for f in files:
        groups.setdefault(spark.read.parquet(f).schema.json(), []).append(f)
    union_relaxed([spark.read.parquet(*g) for _, g in sorted(groups.items())]).drop(*drop).write.mode("overwrite").parquet(out)


# ------------------------------------------------------------------ price log and reports


def write_price_log(df: DataFrame, path: str, parts_per_game: int = 1) -> None:
    """Append-only log, one folder per game. A rerun replaces exactly the games it carries; more than
    one part per game spreads games too large for one writer."""
    spread = F.pmod("order", F.lit(parts_per_game))
    df.repartition(F.col("game_id"), spread).sortWithinPartitions("game_id", "order").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("game_id").parquet(path)


def load_price_log(spark: SparkSession, path: str, columns: Sequence[str] | None = None, key: str = "STRING") -> DataFrame:
    """The log with its declared types (game ids are text, so 007 stays 007), in the order of game and event."""
    from inplay.operators.replay import LOG_SCHEMA

    held = {f.name for f in spark.read.parquet(path).schema.fields}
    df = spark.read.schema(StructType([f for f in schema_of(LOG_SCHEMA.format(key=key)).fields if f.name in held])).parquet(path)
    if columns:
        df = df.select(*dict.fromkeys(["game_id", "order", *columns]))
    return df.orderBy("game_id", "order")


def todo(df: DataFrame, done: DataFrame, key: str = "game_id") -> DataFrame:
    """Rows of entities that are not in the log yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def flatten_report(df: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """Wide result rows to (path, value): one row per number, the path joined from the keys and the
    column name."""
    values = [c for c in df.columns if c not in keys]
    head = [F.lit(prefix)] if prefix else []
    pairs = F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in values])
    return df.select(*keys, F.explode(pairs).alias("p")).select(
        F.concat_ws("/", *head, *[F.col(k).cast("string") for k in keys], F.col("p.m")).alias("path"), F.col("p.v").alias("value"))


def write_report(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
