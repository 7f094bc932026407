"""Prices, quantities and times from raw market JSON (variant columns), and quote rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def field(v: Column, *paths: str) -> Column:
    """The first of the JSON paths that is present, as a variant."""
    return F.coalesce(*[F.try_variant_get(v, f"$.{p}", "variant") for p in paths])


def text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "string")


def pick(v: Column, group: str, name: str) -> Column:
    """A field of a nested group in either spelling, the dollar one first."""
    return field(v, f"{group}.{name}_dollars", f"{group}.{name}")


def price(v: Column) -> Column:
    """Dollars: text is dollars, a bare integer is cents, empty is null, a boolean is an error."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return (F.when(kind == "BIGINT", number / 100.0)
            .when(kind == "BOOLEAN", F.raise_error(F.lit("bool is not a price")))
            .when(kind == "STRING", F.nullif(F.try_variant_get(v, "$", "string"), F.lit("")).cast("double"))
            .otherwise(number))


def quantity(v: Column) -> Column:
    """A count, never divided; fractions allowed, empty is null."""
    return F.nullif(F.try_variant_get(v, "$", "string"), F.lit("")).cast("double")


def timestamp(v: Column) -> Column:
    """Epoch seconds or ISO text with Z to a timestamp."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.to_timestamp(F.nullif(F.try_variant_get(v, "$", "string"), F.lit("")))).otherwise(
        F.timestamp_micros(F.rint(F.try_variant_get(v, "$", "double") * 1000000).cast("bigint")))


def valid_quote(bid: Column, ask: Column) -> Column:
    """A two-sided book: an empty side shows as 0 or 1 and is no quote."""
    return F.coalesce((bid > 0) & (bid <= ask) & (ask < 1), F.lit(False))


def mid(bid: Column, ask: Column) -> Column:
    return F.when(valid_quote(bid, ask), (bid + ask) / 2)


def width(bid: Column, ask: Column) -> Column:
    return F.when(valid_quote(bid, ask), ask - bid)


def normalize_candles(df, v: str = "v", keep: tuple[str, ...] = ("ticker",)):
    """Raw candles in either spelling to one schema; a candle is known only at its end."""
    c = F.col(v)
    ohlc = ("open", "high", "low", "close")
    bid, ask = price(pick(c, "yes_bid", "close")), price(pick(c, "yes_ask", "close"))
    return df.select(
        *keep, timestamp(field(c, "end_period_ts")).alias("end_ts"),
        *[price(pick(c, g, f)).alias(f"{n}_{f}") for g, n in (("yes_bid", "bid"), ("yes_ask", "ask"), ("price", "trade")) for f in ohlc],
        price(pick(c, "price", "mean")).alias("trade_mean"), quantity(field(c, "volume_fp", "volume")).alias("volume"),
        quantity(field(c, "open_interest_fp", "open_interest")).alias("open_interest"),
        mid(bid, ask).alias("mid_close"), width(bid, ask).alias("spread_close"))


def normalize_trades(df, v: str = "v", keep: tuple[str, ...] = ()):
    c = F.col(v)
    return df.select(
        *keep, text(c, "trade_id").alias("trade_id"), text(c, "ticker").alias("ticker"),
        timestamp(field(c, "created_time")).alias("ts"), price(field(c, "yes_price_dollars", "yes_price")).alias("yes_price"),
        quantity(field(c, "count_fp", "count")).alias("count"), text(c, "taker_side").alias("taker_side"),
        F.coalesce(F.try_variant_get(c, "$.is_block_trade", "boolean"), F.lit(False)).alias("is_block_trade"))


def event_of(ticker: Column) -> Column:
    """Everything before the last dash."""
    return F.regexp_replace(ticker, "-[^-]*$", "")


def series_of(ticker: Column) -> Column:
    return F.substring_index(ticker, "-", 1)


def normalize_markets(df, v: str = "v", keep: tuple[str, ...] = ()):
    c = F.col(v)
    ticker = text(c, "ticker")
    return df.select(
        *keep, ticker.alias("ticker"),
        F.coalesce(F.nullif(text(c, "event_ticker"), F.lit("")), event_of(ticker)).alias("event_ticker"),
        series_of(ticker).alias("series_ticker"),
        *[text(c, n).alias(n) for n in ("title", "yes_sub_title", "status", "result")],
        *[timestamp(field(c, n)).alias(n) for n in ("open_time", "close_time", "settlement_ts")],
        price(field(c, "settlement_value_dollars", "settlement_value")).alias("settlement_value"),
        text(c, "strike_type").alias("strike_type"), quantity(field(c, "floor_strike")).alias("floor_strike"),
        quantity(field(c, "cap_strike")).alias("cap_strike"), quantity(field(c, "volume_fp", "volume")).alias("volume"),
        quantity(field(c, "open_interest_fp", "open_interest")).alias("open_interest"),
        price(field(c, "last_price_dollars", "last_price")).alias("last_price"),
        text(c, "rules_primary").alias("rules_primary"), text(c, "rules_secondary").alias("rules_secondary"))


def tier(settled: Column, closed: Column, cutoff: Column) -> Column:
    """Which tier holds a market: historical once it settled (or closed) before the cutoff."""
    return F.when(F.coalesce(settled, closed) < cutoff, "historical").otherwise("live")


def tier_windows(start: Column, end: Column, cutoff: Column) -> Column:
    """A time window split at the cutoff: one or two structs (tier, lo, hi)."""
    old = F.when(start < cutoff, F.struct(F.lit("historical").alias("tier"), start.alias("lo"), F.least(end, cutoff).alias("hi")))
    new = F.when(end > cutoff, F.struct(F.lit("live").alias("tier"), F.greatest(start, cutoff).alias("lo"), end.alias("hi")))
    return F.filter(F.array(old, new), lambda x: x.isNotNull())


def chunks(lo: Column, hi: Column, step: int) -> Column:
    """[lo, hi) in pieces of at most step: an array of structs (lo, hi); empty unless lo < hi."""
    starts = F.when(lo < hi, F.sequence(lo, hi - 1, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("lo"), F.least(s + step, hi).alias("hi")))


def kickoff_utc(day: Column, time: Column) -> Column:
    """Eastern wall time (13:00 where missing) to UTC."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", day.cast("string"), F.coalesce(F.nullif(time, F.lit("")), F.lit("13:00")))),
                              "America/New_York")


def parse_seasons(spec: str) -> list[int]:
    """'1999-2003,2025' to a list of seasons, for job arguments."""
    out: list[int] = []
    for piece in spec.split(","):
        lo, _, hi = piece.strip().partition("-")
        out += range(int(lo), int(hi or lo) + 1)
    return sorted(set(out))
