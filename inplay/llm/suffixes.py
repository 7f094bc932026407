"""Repeated long strings, by a logarithmic family of sparse suffix arrays over batches of documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inplay.llm.storage import keep
from inplay.llm.textscan import BASE, BASE_INVERSE, mix, powers, slices, span_hashes

DEPTH = 100  # bytes by which suffixes are ordered
STEP = 32  # places of a repeated string that are judged together
OTHER = 0xD1342543DE82EF95
OTHER_INVERSE = pow(OTHER, -1, 1 << 64)


def window_hashes(data: np.ndarray, size: int, base: int = BASE, inverse: int = BASE_INVERSE) -> np.ndarray:
    """Hash of data[i:i+size] for every i that has so many bytes after it."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=total[1:])
    n = len(data) - size + 1
    return mix((total[size:] - total[:n]) * powers(inverse, n))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i:i+width] for every full window, in a few passes whatever the width."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:len(x)] = x
    rows = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def sampled_suffixes(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The suffixes a sparse array holds: within every string of `length` bytes the place whose first DEPTH bytes
    hash least (the leftmost of equals). Equal strings choose the same place, so two occurrences of a repeated
    string always have suffixes in the array that agree in DEPTH bytes. Returns text, place in the text, least and
    greatest distance of the strings' starts before the place that chose it, and the order key of the suffix."""
    none = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if len(data) < length:
        return none
    if len(data) >= 1 << 32:
        raise ValueError("a text of 4 GiB or more")
    key = window_hashes(data, DEPTH)
    place = (key >> np.uint64(32) << np.uint64(32)) | np.arange(len(key), dtype=np.uint64)
    chosen = (sliding_least(place, length - DEPTH + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    if not len(text):
        return none
    first = np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0)
    start = np.arange(len(text)) - first[text] + offsets[:-1][text]
    at = chosen[start]
    new = np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1]))
    runs = np.flatnonzero(new)
    last = np.append(runs[1:], len(text)) - 1
    a, t = at[runs], text[runs]
    return t, a - offsets[:-1][t], a - start[last], a - start[runs], key[a]


class Family:
    """A logarithmic index family: levels of suffix arrays, each twice as many batches as the one before.

    A level is a table ordered by the suffixes' key, with one row per key: some occurrence and whether there is
    another one. A new batch becomes an array of its own, is merge-scanned (one join on the order key) against every
    level, and then equal-sized levels merge until all sizes differ. So with n batches there are log2(n) levels at
    most, and a suffix is rewritten log2(n) times at most."""

    def __init__(self, name: str = "level"):
        self.levels: dict[int, DataFrame] = {}
        self.name = name

    @staticmethod
    def array(suffixes: DataFrame) -> DataFrame:
        """One row per order key; equal suffixes meet map-side, so a hot key sends one row per task."""
        return suffixes.groupBy("key").agg(F.min("one").alias("one"), F.bool_or("again").alias("again"), F.max("one").alias("top")).select(
            "key", "one", (F.col("again") | (F.col("one") != F.col("top"))).alias("again"))

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch (key, occurrence `one`) and return the keys that now have a second occurrence because of it:
        within the batch, or in the batch and a level."""
        fresh = keep(self.array(batch.withColumn("again", F.lit(False))).sortWithinPartitions("key"), self.name)
        found = fresh.filter("again").select("key")
        for level in self.levels.values():
            other = level.select("key", F.col("one").alias("there"))
            found = found.union(fresh.join(other, "key").filter("one <> there").select("key"))
        size = 1
        while size in self.levels:
            fresh = keep(self.array(fresh.union(self.levels.pop(size))).sortWithinPartitions("key"), self.name)
            size *= 2
        self.levels[size] = fresh
        return found


def repeated_strings(docs: DataFrame, length: int = 400, batches: int = 4) -> DataFrame:
    """Every string of `length` bytes that starts at two or more places of all texts, in the same text or in
    others, as it lies in each distinct text: (text_hash, n_bytes, text, places array<struct<place, mask>>), where
    bit i of mask marks the string that starts i bytes before `place`. Texts without one are left out. Exact copies of
    a text count as one text here (what they share is known without an index).

    (1) Sparse suffixes of each text; (2) the family, batch after batch, tells which suffixes agree with another in
    DEPTH bytes; (3) around those, the strings that hold such a place are judged exactly. Strings are judged STEP
    starts at a time: their common bytes (core) and the flanks about them. Equal core and flanks in two places
    settle all STEP strings; where cores agree and flanks differ, each string is compared on its own. All counts
    are group-bys with map-side sums, so a passage that a third of all texts share is a few rows per task."""
    if length < DEPTH + STEP:
        raise ValueError(f"length must be {DEPTH + STEP} or more")
    core = length - STEP + 1
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("text", F.xxhash64("text").alias("text_hash"), F.octet_length("text").alias("n_bytes")).filter(F.col("n_bytes") >= length)

    def sample(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part, data, offsets in slices(batch, "text"):
                t, place, near, far, key = sampled_suffixes(data, offsets, length)
                yield pa.RecordBatch.from_arrays([part.column("text_hash").take(pa.array(t)), part.column("n_bytes").take(pa.array(t)), pa.array(place.astype(np.int32)),
                                                  pa.array(near.astype(np.int32)), pa.array(far.astype(np.int32)), pa.array(key.view(np.int64))],
                                                 names=["text_hash", "n_bytes", "place", "near", "far", "key"])

    suffixes = keep(docs.mapInArrow(sample, "text_hash long, n_bytes int, place int, near int, far int, key long"), "suffixes")
    family, found = Family(), []
    occurrence = suffixes.select("key", F.xxhash64("text_hash", "n_bytes", "place").alias("one"), F.pmod("text_hash", F.lit(batches)).alias("batch"))
    for b in range(batches):
        found.append(keep(family.add(occurrence.filter(F.col("batch") == b).select("key", "one")), "found"))
    repeated = found[0]
    for f in found[1:]:
        repeated = repeated.union(f)
    places = suffixes.join(repeated.distinct(), "key").groupBy("text_hash", "n_bytes").agg(F.collect_set(F.struct("place", "near", "far")).alias("places"))
    texts = docs.join(places, ["text_hash", "n_bytes"])
    texts = keep(texts.groupBy("text_hash", "n_bytes").agg(F.first("text").alias("text"), F.first("places").alias("places")), "texts")

    def judge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for r in range(batch.num_rows):
                data = np.frombuffer(batch.column("text")[r].as_py().encode(), np.uint8)
                marks = batch.column("places")[r].as_py()
                a, near, far = (np.array([m[k] for m in marks], np.int64) for k in ("place", "near", "far"))
                kinds = far // STEP - near // STEP + 1
                which = np.repeat(np.arange(len(a)), kinds)
                step = np.arange(len(which)) - (np.cumsum(kinds) - kinds)[which] + (near // STEP)[which]
                p = np.unique(a[which] - STEP * step)
                begin, end = np.maximum(p - STEP + 1, 0), np.minimum(p + core + STEP - 1, len(data))
                flanks = mix(span_hashes(data, begin, end) + ((p - begin) * STEP + end - p - core).astype(np.uint64))
                n = len(p)
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column("text_hash")[r].as_py()] * n, pa.int64()), pa.array([batch.column("n_bytes")[r].as_py()] * n, pa.int32()), pa.array(p, pa.int64()),
                    pa.array(window_hashes(data, core, OTHER, OTHER_INVERSE)[p].view(np.int64)), pa.array(flanks.view(np.int64))], names=["text_hash", "n_bytes", "place", "core", "flanks"])

    def one_by_one(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for r in range(batch.num_rows):
                data = np.frombuffer(batch.column("text")[r].as_py().encode(), np.uint8)
                marks = batch.column("places")[r].as_py()
                p, cores, flanks, n = (np.array([m[k] for m in marks], np.int64) for k in ("place", "core", "flanks", "n"))
                i = np.tile(np.arange(STEP), len(p))
                start = np.repeat(p, STEP) - i
                ok = (start >= 0) & (start + length <= len(data))
                whole = window_hashes(data, length)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, STEP)[ok]) for x in (cores, flanks, n)] + [pa.array(i[ok].astype(np.int32)), pa.array(whole[start[ok]].view(np.int64))],
                                                 names=["core", "flanks", "n", "i", "whole"])

    judged = keep(texts.mapInArrow(judge, "text_hash long, n_bytes int, place long, core long, flanks long"), "judged")
    kinds = keep(judged.groupBy("core", "flanks").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text_hash", "n_bytes", "place")).alias("at")), "kinds")
    mixed = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select("core")
    doubtful = kinds.join(mixed, "core").select("at.*", "core", "flanks", "n").groupBy("text_hash", "n_bytes").agg(F.collect_list(F.struct("place", "core", "flanks", "n")).alias("places"))
    single = texts.drop("places").join(doubtful, ["text_hash", "n_bytes"]).select("text", "places").mapInArrow(one_by_one, "core long, flanks long, n long, i int, whole long")
    again = keep(single.groupBy("core", "i", "whole").agg(F.sum("n").alias("total")).filter("total > 1").select("core", "i", "whole"), "again")
    masks = single.join(again, ["core", "i", "whole"]).select("core", "flanks", F.expr("shiftleft(1L, i)").alias("mask"))
    masks = masks.union(kinds.filter("n > 1").select("core", "flanks", F.lit((1 << STEP) - 1).cast("long"))).groupBy("core", "flanks").agg(F.bit_or("mask").alias("mask"))
    # Both sides of the joins on strings are plain tables, so that Spark can split one that very many places share.
    verdicts = judged.join(keep(masks, "masks"), ["core", "flanks"]).groupBy("text_hash", "n_bytes").agg(F.collect_list(F.struct("place", "mask")).alias("places"))
    return texts.drop("places").join(verdicts, ["text_hash", "n_bytes"])


def covered_spans(n_bytes: int, places: list[int], masks: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the marked strings of one text."""
    place, mask = np.array(places, np.int64), np.array(masks, np.uint64)
    bits = (mask[:, None] >> np.arange(STEP, dtype=np.uint64)) & np.uint64(1)
    starts = (place[:, None] - np.arange(STEP))[bits.astype(bool)]
    starts = np.unique(starts[(starts >= 0) & (starts + length <= n_bytes)])
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, breaks + 1)].tolist(), (starts[np.append(breaks, len(starts) - 1)] + length).tolist()))


def without_repeats(docs: DataFrame, length: int = 400, batches: int = 4) -> DataFrame:
    """Remove from each text (UTF-8 bytes) every byte that a string of `length` bytes covers which also starts
    anywhere else, judged on the input. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), spans,
    kept_sha256 (of the remaining bytes), one row per row of `docs`.

    Null text is empty; texts shorter than `length` stay whole; a text of which there is an exact copy and that is
    long enough goes altogether. Ids may be null or repeat. An empty table gives no rows; other columns are ignored."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.octet_length("text").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))

    def remove(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for r in batch.to_pylist():
                raw, rest, at = r["text"].encode(), hashlib.sha256(), 0
                spans = covered_spans(len(raw), [p["place"] for p in r["places"]], [p["mask"] for p in r["places"]], length)
                for a, b in spans:
                    rest.update(raw[at:a])
                    at = b
                rest.update(raw[at:])
                out.append({"text_hash": r["text_hash"], "n_bytes": r["n_bytes"], "spans": [{"start": a, "stop": b} for a, b in spans], "cut_sha": rest.hexdigest()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("text_hash", pa.int64()), ("n_bytes", pa.int32()),
                                                 ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("cut_sha", pa.string())]))

    cut = repeated_strings(docs, length, batches).mapInArrow(remove, "text_hash long, n_bytes int, spans array<struct<start:long,stop:long>>, cut_sha string")
    copies = keyed.groupBy("text_hash", "n_bytes").agg(F.count(F.lit(1)).alias("copies")).filter((F.col("copies") > 1) & (F.col("n_bytes") >= length))
    known = cut.join(copies, ["text_hash", "n_bytes"], "full")
    whole = F.col("copies").isNotNull()
    one = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").cast("long").alias("stop")))
    known = known.select("text_hash", "n_bytes", F.when(whole, one).otherwise(F.col("spans")).alias("spans"),
                         F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("cut_sha")).alias("cut_sha"))
    out = keyed.join(keep(known, "known"), ["text_hash", "n_bytes"], "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>"))
    return out.select("doc_id", F.col("n_bytes").cast("long"), F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"]).alias("n_removed"),
                      F.size(spans).cast("long").alias("n_spans"), spans.alias("spans"), F.coalesce("cut_sha", "sha").alias("kept_sha256"))
