"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inplay.llm.storage import keep
from inplay.llm.textscan import mix, sequence_hashes, shingle_hashes, slices, word_hashes

BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2  # any two 64-bit fingerprints within 23 bits have a block within 2 bits
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
TABLE_BITS = 24  # of the table of benchmark shingles (2 MB)


def fingerprints(grams: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes; a shingle weighs as often as it occurs. Bit i is set if the shingles
    with bit i outweigh the others or tie."""
    total = np.zeros((len(grams), 64), np.int32)
    place = np.arange(64, dtype=np.uint64)
    for column in grams.T:
        total += 2 * ((column[:, None] >> place) & np.uint64(1)).astype(np.int32) - 1
    return ((total >= 0).astype(np.uint64) << place).sum(axis=1, dtype=np.uint64)


def counted(grams: np.ndarray) -> np.ndarray:
    """Rows of shingle hashes, each repeat made a value of its own, so that the overlap of two rows as sets is the
    overlap of their shingles' weights."""
    rows = np.sort(grams, axis=1)
    turn = np.zeros(rows.shape, np.uint64)
    for j in range(1, rows.shape[1]):
        turn[:, j] = np.where(rows[:, j] == rows[:, j - 1], turn[:, j - 1] + np.uint64(1), np.uint64(0))
    return mix(rows + turn * np.uint64(0x9E3779B97F4A7C15))


def window_grams(words: np.ndarray, starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Shingle hashes of the windows of `n` words at `starts`, a row each; of fewer than `size` words the sequence's."""
    if n < size:
        return sequence_hashes(words, n)[starts][:, None]
    grams = shingle_hashes(words, size)
    return grams[starts[:, None] + np.arange(n - size + 1)]


def _rows(ids: pa.Array, start: np.ndarray, n: np.ndarray, prints: np.ndarray, grams: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(start, pa.int64()), pa.array(n, pa.int32()), pa.array(prints.view(np.int64)),
                                       pa.array([g.view(np.int64) for g in grams], pa.list_(pa.int64()))], names=["id", "start", "n", "print", "grams"])


ROWS = "id long, start long, n int, print long, grams array<long>"


def contaminated(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """Which documents (doc_id, text) hold a passage of which benchmark items (item_id, text): doc_id, item_id,
    similarity (weighted Jaccard of `size`-word shingles, the best window's), n_windows, first_word.

    Every window of a document with as many words as an item is a candidate, and of a document with fewer words (`size`
    at least) the whole, under each item length that it can reach, by the same bound for unequal sizes. (1) A window can reach `percent` only if
    few of its shingles (one in seven, at 75) are foreign to the whole benchmark; this bound is sound, uses a
    table of fixed size (a full one lets more windows through and changes nothing), and leaves windows about real
    passages. (2) Those get a SimHash; windows of equal content
    become one row. (3) Multi-index Hamming search among items of that length: the 64 bits are eight blocks; items are
    entered under all values within two bits of each block, windows look up their own blocks, so every pair within
    RADIUS = 23 bits meets. (4) Pairs that meet and lie within RADIUS are compared exactly, shingles weighing as
    often as they occur. At `percent` = 75 the expected distance is 11 bits, deviation 3; RADIUS is four deviations more.

    Words are runs of non-space bytes, A-Z in lower case. An item of fewer than `size` words matches only as a whole.
    Null and empty texts, on either side, match nothing; null ids are kept as they are; repeated rows count as windows of one document;
    empty tables give no rows; other columns are ignored."""
    slack = lambda m: m - -(-2 * percent * m // (100 + percent))  # noqa: E731  shingles that may differ among m

    def item(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part, data, offsets in slices(batch, "text"):
                words, first = word_hashes(data, offsets)
                for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    if b > a:
                        grams = window_grams(words[a:b], np.zeros(1, np.int64), b - a, size)
                        yield _rows(part.column("item_id").slice(r, 1).cast(pa.int64()), np.zeros(1, np.int64), np.array([b - a]), fingerprints(grams), list(counted(grams)))

    def shingles(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for _, data, offsets in slices(batch, "text"):
                words, first = word_hashes(data, offsets)
                grams = [window_grams(words[a:b], np.zeros(1, np.int64), b - a, size)[0] for a, b in zip(first[:-1].tolist(), first[1:].tolist()) if b > a]
                slots = np.unique(np.concatenate([np.zeros(0, np.uint64), *grams]) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(slots)], names=["slot"])

    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    wanted = keep(items.mapInArrow(item, ROWS), "items")
    known = np.zeros(1 << TABLE_BITS, bool)
    bits = items.mapInArrow(shingles, "slot int").groupBy(F.expr("slot div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, slot % 64)")).alias("bits"))
    for r in bits.toLocalIterator():  # 2^18 rows at most
        known[64 * r["w"] + np.flatnonzero((np.int64(r["bits"]).view(np.uint64) >> np.arange(64, dtype=np.uint64)) & np.uint64(1))] = True
    lengths = sorted(r["n"] for r in wanted.select("n").distinct().toLocalIterator())  # distinct lengths of items, not items

    def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part, data, offsets in slices(batch, "text"):
                words, first = word_hashes(data, offsets)
                foreign = np.append(np.int32(0), np.cumsum(~known[shingle_hashes(words, size) >> np.uint64(64 - TABLE_BITS)], dtype=np.int32))
                for n in lengths:
                    if n > len(words):
                        break
                    m = n - size + 1
                    if m > 0:
                        may = np.flatnonzero(foreign[m:] - foreign[:-m] <= slack(m))
                    else:
                        may = np.flatnonzero(known[sequence_hashes(words, n) >> np.uint64(64 - TABLE_BITS)])
                    text = np.searchsorted(first, may, "right") - 1
                    inside = may + n <= first[1:][text]
                    may, text = may[inside], text[inside]
                    for at in range(0, len(may), 2000):
                        s, t = may[at:at + 2000], text[at:at + 2000]
                        grams = window_grams(words, s, n, size)
                        yield _rows(part.column("doc_id").take(pa.array(t)).cast(pa.int64()), s - first[:-1][t], np.full(len(s), n), fingerprints(grams), list(counted(grams)))
                sizes = np.diff(first)
                for t in np.flatnonzero((sizes >= size) & (sizes < max(lengths, default=0))).tolist():  # whole documents
                    a, n = int(first[t]), int(sizes[t])
                    m = n - size + 1
                    strange = int(foreign[a + m] - foreign[a])
                    # 100 * own >= percent * (the item's shingles + strange) must hold; only then is a longer item in reach.
                    far = [k for k in lengths if k > n and 100 * (m - strange) >= percent * (k - size + 1 + strange)]
                    if far:
                        grams, many = window_grams(words, np.array([a]), n, size), len(far)
                        yield _rows(part.column("doc_id").take(pa.array([t] * many)).cast(pa.int64()), np.zeros(many, np.int64), np.array(far), np.repeat(fingerprints(grams), many), [*counted(grams)] * many)

    windows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, ROWS)
    windows = keep(windows.withColumn("content", F.xxhash64("grams")), "windows")
    contents = windows.groupBy("n", "print", "content").agg(F.first("grams").alias("grams"))

    near = [sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), r)]
    block = lambda b: F.expr(f"shiftrightunsigned(print, {BLOCK_BITS} * {b}) & {(1 << BLOCK_BITS) - 1}")
    keys = wanted.select(F.col("id").alias("item_id"), "n", F.col("print").alias("item_print"), F.col("grams").alias("item_grams"),
                         F.explode(F.array(*[F.struct(F.lit(b).alias("block"), block(b).alias("own")) for b in range(BLOCKS)])).alias("k"))
    keys = keys.withColumn("flip", F.explode(F.array(*[F.lit(v).cast("long") for v in near])))
    keys = keys.select("item_id", "n", "item_print", "item_grams", F.col("k.block").alias("block"), F.expr("k.own ^ flip").alias("value"))
    look = contents.withColumn("k", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), block(b).alias("value")) for b in range(BLOCKS)])))
    met = look.select("n", "print", "content", "grams", F.col("k.block").alias("block"), F.col("k.value").alias("value")).join(keys, ["n", "block", "value"])
    met = met.filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    both, all_of = F.size(F.array_intersect("grams", "item_grams")), F.size("grams") + F.size("item_grams")
    exact = met.withColumn("both", both).filter(F.col("both") * (100 + percent) >= percent * all_of)
    exact = exact.select("n", "print", "content", "item_id", (F.col("both") / (all_of - F.col("both"))).alias("similarity")).distinct()
    hits = windows.select("id", "start", "n", "print", "content").join(exact, ["n", "print", "content"])
    return hits.groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.max("similarity").alias("similarity"), F.count(F.lit(1)).alias("n_windows"), F.min("start").alias("first_word"))
