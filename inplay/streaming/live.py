"""Structured Streaming twins: bars, dedupe, sequence repair, event emission, as-of quotes, price-log sink.

Stateful operators keep one small state per game; every row they release is final, so information is
late, never early. Rows of a game must arrive in order within the watermark.
"""

from __future__ import annotations

import re
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from inplay.operators.quotes import bars
from inplay.operators.replay import DEFAULT_END_BOUND_S, MAX_PLAY_SECONDS, PENALTY, PENALTY_LAG_S, REVIEW, REVIEW_LAG_S
from inplay.sources.tables import dedupe_last


def live_bars(trades: DataFrame, late_after: str = "10 minutes", every: str = "1 minute", by=("ticker",), tie: str = "trade_id") -> DataFrame:
    """Tumbling bars that appear once the watermark passes their end; later rows are dropped."""
    return bars(trades.withWatermark("ts", late_after), by, every, tie=tie)


def live_dedupe(trades: DataFrame, late_after: str = "10 minutes", key: str = "trade_id") -> DataFrame:
    """Each trade id once, remembered for as long as duplicates may arrive."""
    return trades.withWatermark("ts", late_after).dropDuplicatesWithinWatermark([key])


def in_order(rows: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """One game's rows of one micro-batch in order; the trigger's admission limit bounds them."""
    parts = list(rows)
    if parts:
        yield pd.concat(parts).sort_values(key)


def use_rocksdb(spark) -> None:
    """State store that custom stateful operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# ------------------------------------------------------------------ sequence repair

REPAIR_OUT = "game_id bigint, play_id bigint, t_snap double, t_end double, t_known double, home_score double, away_score double"
_STATE = "last_snap double, last_end double, home double, away double, closed boolean"


class Repair(StatefulProcessor):
    """Monotone snap, end, known time and scores per game, from columns play_id, snap, end, duration, bad,
    home, away, last. Rows before a game's first valid snap wait in state, as nothing times them yet."""

    def __init__(self, delta_s: float = 0.0):
        self.delta_s = delta_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("clock", _STATE)
        self.waiting = handle.getListState("waiting", "play_id long, end double, duration double, bad boolean, home double, away double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        snap, end, home, away, closed = self.state.get() if self.state.exists() else (None, None, 0.0, 0.0, False)
        held = [tuple(r) for r in self.waiting.get()]
        out = []

        def step(pid, s, e, d, bad, h, a):
            nonlocal snap, end, home, away
            s = end if pd.isna(s) else s
            s = s if snap is None else max(s, snap)
            e = s + d if bad else e
            e = max(e, s) if end is None else max(e, s, end)
            snap, end = s, e
            home = home if pd.isna(h) else max(home, h)
            away = away if pd.isna(a) else max(away, a)
            out.append((key[0], pid, s, e, e + self.delta_s, home, away))

        for pdf in in_order(rows, "play_id"):
            for r in pdf.itertuples(index=False):
                if end is None and pd.isna(r.snap):
                    held.append((r.play_id, r.end, r.duration, r.bad, r.home, r.away))
                    continue
                if end is None:
                    end = r.snap  # the first valid snap times the rows that waited for it
                    for pid, e, d, bad, h, a in held:
                        step(pid, None, e, d, bad, h, a)
                    held = []
                step(r.play_id, r.snap, r.end, r.duration, r.bad, r.home, r.away)
                closed = closed or bool(r.last)
        if closed:
            self.state.clear()
            self.waiting.clear()
        else:
            if end is not None:
                self.state.update((snap, end, home, away, False))
            self.waiting.put(held) if held else self.waiting.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in REPAIR_OUT.split(", ")])

    def close(self) -> None:
        pass


def live_repair(rows: DataFrame, delta_s: float = 0.0) -> DataFrame:
    return rows.groupBy("game_id").transformWithStateInPandas(
        Repair(delta_s), outputStructType=REPAIR_OUT, outputMode="Append", timeMode="None")


# ------------------------------------------------------------------ event emission

EMIT_OUT = "game_id bigint, seq bigint, kind string, t double, timing string"
_PLAY = ("seq", "t_snap", "t_end", "snap_imputed", "end_imputed", "bound_s", "desc", "qtr", "game_half", "gsr", "hsr", "phase", "home_post", "away_post")
_PLAY_DDL = ("seq long, t_snap double, t_end double, snap_imputed boolean, end_imputed boolean, bound_s double, desc string, "
             "qtr long, game_half string, gsr double, hsr double, phase string, home_post long, away_post long")


class Emitter(StatefulProcessor):
    """Pregame, play, snap and final events. A play's public time needs the next play, so one play per
    game is held back; the row flagged `last` closes the game."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", _PLAY_DDL)
        self.clock = handle.getValueState("clock", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cur = dict(zip(_PLAY, self.held.get())) if self.held.exists() else None
        t = self.clock.get()[0] if self.clock.exists() else None
        out, closed = [], False

        def emit(seq, kind, at, timing):
            nonlocal t
            t = at if t is None else max(at, t)
            out.append((key[0], seq, kind, t, timing))

        for pdf in in_order(rows, "seq"):
            for r in pdf.to_dict("records"):
                if cur is None:
                    emit(-1, "pregame", r["t_snap"], "pregame")
                else:
                    at, timing = public_time(cur, r)
                    emit(cur["seq"], "play", at, timing)
                    toss = r["game_half"] != cur["game_half"] and r["qtr"] >= 5 and cur["qtr"] <= 4
                    late = r["qtr"] >= 4 or (r["qtr"] == 2 and r["hsr"] <= 300)
                    if not r["snap_imputed"] and (toss or (r["phase"] == "snap" and late)):
                        emit(r["seq"], "snap", r["t_snap"], "snap")
                cur = r
                if r["last"]:
                    at, timing = public_time(r, None)
                    emit(r["seq"], "final", at, timing)
                    closed = True
        if closed or cur is None:
            self.held.clear()
            self.clock.clear()
        else:
            self.held.update(tuple(cur[c] for c in _PLAY))
            self.clock.update((t,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EMIT_OUT.split(", ")])

    def close(self) -> None:
        pass


#: Rulings by priority: what the text says, the rule's name, its lag in seconds, and how a trusted next snap counts
#: (the later a review ends at is that snap itself; a penalty is known at its lag or at the snap, if sooner).
RULINGS = ((re.compile(REVIEW), "review", REVIEW_LAG_S, lambda lagged, snap: snap), (re.compile(PENALTY), "penalty", PENALTY_LAG_S, min))


def public_time(play: dict, after: dict | None) -> tuple[float, str]:
    """When a held play's result became public, and by which rule: the values of operators.replay.public_time for one
    pair of plays. A play is public at its end, unless its clock runs out, its end is a guess or a ruling is due."""
    snap = None if after is None or after["snap_imputed"] else after["t_snap"]
    overtime = play["qtr"] >= 5
    decided = overtime and play["home_post"] != play["away_post"]
    period_ends = after["game_half"] != play["game_half"] if after else not decided
    clock = play["gsr"] if overtime else play["hsr"]
    rest = clock - min(MAX_PLAY_SECONDS, clock, max(0.0, play["t_end"] - play["t_snap"]))
    runs_out, guessed = period_ends and rest > 0, bool(play["end_imputed"])
    rule = "clock" if runs_out else "imputed" if guessed else "end"
    length = (DEFAULT_END_BOUND_S if pd.isna(play["bound_s"]) else play["bound_s"]) if guessed else play["t_end"] - play["t_snap"]
    moments = [play["t_snap"] + length + (rest if runs_out else 0.0)]
    if rule != "end" and snap is not None:
        moments = [min(moments[0], snap)]
    for pattern, name, lag, with_snap in RULINGS:
        if pattern.search(play["desc"] or ""):
            lagged = play["t_end"] + lag
            moments.append(lagged if snap is None else with_snap(lagged, snap))
            rule = name
            break
    return max(*moments, play["t_end"]), rule


def live_events(plays: DataFrame) -> DataFrame:
    return plays.groupBy("game_id").transformWithStateInPandas(Emitter(), outputStructType=EMIT_OUT, outputMode="Append", timeMode="None")


# ------------------------------------------------------------------ as-of

ASOF_OUT = "game_id bigint, t timestamp, market double, quote_order bigint, p_home double"


class LastQuote(StatefulProcessor):
    """Latest quote known at each market minute. Quotes and minutes come as one stream with a common time;
    rows wait until the watermark passes them, then are played in time order (quotes first)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "us long, side int, quote_order long, p_home double, market double")
        self.last = handle.getValueState("last", "quote_order long, p_home double")
        self.handle = handle

    def _play(self, key, rows, upto) -> list[tuple]:
        ready = sorted((r for r in rows if r[0] < upto), key=lambda r: (r[0], r[1], r[2] if r[2] is not None else -1))
        last = self.last.get() if self.last.exists() else (None, None)
        out = []
        for us, side, order, p, market in ready:
            if side == 0:
                last = (order, p)
            else:
                out.append((key[0], pd.Timestamp(us, unit="us"), market, last[0], last[1]))
        if last[0] is not None:
            self.last.update(last)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.rows.get()]
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                held.append((int(r.us), int(r.side), None if pd.isna(r.quote_order) else int(r.quote_order),
                             None if pd.isna(r.p_home) else float(r.p_home), None if pd.isna(r.market) else float(r.market)))
        yield self._release(key, held, mark)

    def _release(self, key, held, mark) -> pd.DataFrame:
        out = self._play(key, held, mark)
        rest = [r for r in held if r[0] >= mark]
        self.rows.put(rest) if rest else self.rows.clear()
        if rest:
            self.handle.registerTimer(min(r[0] for r in rest) // 1000 + 1)
        frame = pd.DataFrame(out, columns=["game_id", "t", "market", "quote_order", "p_home"])
        return frame.astype({"quote_order": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._release(key, [tuple(r) for r in self.rows.get()], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def live_asof(quotes: DataFrame, minutes: DataFrame, late_after: str = "10 minutes") -> DataFrame:
    """Each market minute with the latest quote known by then (inclusive), once no earlier row can come.
    quotes: game_id, t_known, order, p_home; minutes: game_id, t, market."""
    null = F.lit(None)
    q = quotes.select("game_id", F.col("t_known").alias("ts"), F.lit(0).alias("side"), F.col("order").cast("bigint").alias("quote_order"),
                      "p_home", null.cast("double").alias("market"))
    m = minutes.select("game_id", F.col("t").alias("ts"), F.lit(1).alias("side"), null.cast("bigint").alias("quote_order"),
                       null.cast("double").alias("p_home"), "market")
    both = q.unionByName(m).withColumn("us", F.unix_micros("ts")).withWatermark("ts", late_after)
    return both.groupBy("game_id").transformWithStateInPandas(
        LastQuote(), outputStructType=ASOF_OUT, outputMode="Append", timeMode="EventTime")


# ------------------------------------------------------------------ sink


def price_log_sink(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append a stream of price rows to the log, one folder per game and micro-batch. A replayed batch
    overwrites its own folder, so a restart changes nothing; rows repeated across batches are
    resolved by load_live_log."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = dedupe_last(batch, ["game_id", "order"], ["t"]).withColumn("batch", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "game_id").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def load_live_log(spark, path: str, key: str = "STRING") -> DataFrame:
    """The log as written by price_log_sink, each (game, order) once, from its last batch. Game ids are read as
    `key`, not guessed from folder names."""
    fields = [f if f.name != "game_id" else StructField("game_id", StructType.fromDDL(f"g {key}")[0].dataType) for f in spark.read.parquet(path).schema.fields]
    return dedupe_last(spark.read.schema(StructType(fields)).parquet(path), ["game_id", "order"], ["batch"]).drop("batch")
