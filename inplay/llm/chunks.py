"""Repeated passages: content-defined chunks and their digests as anchors, extended byte-wise."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inplay.llm.storage import discard, keep
from inplay.llm.suffixes import OTHER, OTHER_INVERSE, sliding_least
from inplay.llm.textscan import SPACE, mix, powers, slices, span_hashes

REACH = 32  # bytes the rolling hash looks back over
#: The gear table: one pseudo-random 32-bit number per byte value, from a rule.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear rolling hash h = (h << 1) + GEAR[byte] at every byte, in 32 bits, so that it depends on the last
    REACH bytes alone. Five doublings give it for all places at once."""
    h = GEAR[data]
    back = 1
    while back < REACH:
        h[back:] += h[:-back] << np.uint32(back)
        back *= 2
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray, bits: int, longest: int) -> np.ndarray:
    """Ends of all chunks, ascending. A chunk ends after a byte where the top `bits` bits of the hash are 0, which
    depends on the last REACH bytes only, so chunks fall back into step soon after an insertion; at the end of its
    text; and after `longest` bytes without such a place."""
    h = gear_hashes(data)
    cut = h < np.uint32(1 << (32 - bits))
    begins = offsets[:-1]
    for j in range(REACH - 1):  # the hash must not look back into another text
        at = begins + j
        cut[at[at < np.minimum(offsets[1:], len(data))]] = False
    ends = np.unique(np.concatenate([np.flatnonzero(cut) + 1, offsets[1:]]))
    ends = ends[ends > 0]
    sizes = np.diff(ends, prepend=0)
    long = np.flatnonzero(sizes > longest)
    if len(long):
        more = [np.arange(ends[i] - sizes[i] + longest, ends[i], longest) for i in long.tolist()]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends


def anchors(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Places by which equal stretches find each other: in every string of `least` bytes within a text, the chunk of
    least // 2 bytes whose gear hash at its end is least (the leftmost of equals). Equal strings choose the same place, so
    two occurrences of a stretch of `least` bytes always share one. Returns text, place in the text, least and greatest
    distance of the strings' starts before it, and a 64-bit digest of the chunk (see second_digests).

    Where a chunk overlaps itself (a text that repeats a few bytes), only the first two and the last of its run stay."""
    size = least // 2
    if size < REACH:
        raise ValueError(f"least must be {2 * REACH} or more")
    begins, ends = offsets[:-1], offsets[1:] - least + 1  # of the strings within each text
    long = begins < ends
    if not long.any():
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    h = gear_hashes(data)[size - 1:]
    place = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    chosen = sliding_least(place, least - size + 1)
    edge = np.zeros(len(chosen) + 1, np.int8)
    edge[begins[long]] = 1
    edge[ends[long]] = -1  # texts are apart by the strings that cross their border
    valid = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    turn = np.append(True, chosen[1:] != chosen[:-1])
    turn[begins[long]] = True
    runs = np.flatnonzero(turn & valid)
    turn = np.append(turn[1:], True)
    turn[ends[long] - 1] = True
    last = np.flatnonzero(turn & valid)
    at = (chosen[runs] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(offsets, runs, "right") - 1
    high = span_hashes(data, at, at + size)
    same = np.append(False, (high[1:] == high[:-1]) & (text[1:] == text[:-1]) & (np.diff(at) < size))
    stay = ~same | ~np.append(False, same[:-1]) | ~np.append(same[1:], False)
    return text[stay], (at - offsets[:-1][text])[stay], (at - last)[stay], (at - runs)[stay], high[stay]


def second_digests(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Another 64-bit digest of data[at:at + size], from these bytes alone."""
    total = np.zeros(len(at), np.uint64)
    for j, power in enumerate(powers(OTHER, size)):
        total += (data[at + j].astype(np.uint64) + np.uint64(1)) * power
    return mix(total + np.uint64(size))


def repeated_anchors(docs: DataFrame, least: int) -> DataFrame:
    """Anchors of the texts (id, text_hash, text) whose digest of 128 bits occurs again, without the first occurrence (in the
    order of id, text_hash, place), per text and text of the first one, kept in the shared folder: id, text_hash, head_id,
    head_hash, marks (place, head_place, near, far). What it kept on the way is deleted.

    Two passes over the texts, so that the exchange of whole records is left to anchors that can matter: the first
    sends half digests alone and finds those that occur twice; the second leaves out, by a filter of fixed size (2 MB)
    over them, most anchors that do not (a full filter lets more through and changes nothing). First occurrences are
    found by a group-by on the digest with map-side minima."""

    def halves(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for _, data, offsets in slices(batch, "text"):
                high, n = np.unique(anchors(data, offsets, least)[-1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(high.view(np.int64)), pa.array(n > 1)], names=["high", "again"])

    twice = docs.select("text").mapInArrow(halves, "high long, again boolean").groupBy("high").agg(F.count(F.lit(1)).alias("n"), F.bool_or("again").alias("again"))
    twice = keep(twice.filter("n > 1 or again").select("high"), "halves")
    table = np.zeros(1 << 18, np.uint64)
    words = twice.select(F.pmod("high", F.lit(1 << 24)).alias("h")).groupBy(F.expr("h div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(h % 64))")).alias("bits"))
    for r in words.toLocalIterator():  # 2^18 rows at most
        table[r["w"]] = np.int64(r["bits"]).view(np.uint64)
    discard(twice)

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part, data, offsets in slices(batch, "text"):
                got = anchors(data, offsets, least)
                slot = got[-1] & np.uint64((1 << 24) - 1)
                may = (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                text, place, near, far, high = (x[may] for x in got)
                low = second_digests(data, offsets[:-1][text] + place, least // 2)
                which = pa.array(text)
                yield pa.RecordBatch.from_arrays([part.column("id").take(which), part.column("text_hash").take(which), pa.array(place), pa.array(near.astype(np.int32)),
                                                  pa.array(far.astype(np.int32)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64))],
                                                 names=["id", "text_hash", "place", "near", "far", "high", "low"])

    found = docs.select("id", "text_hash", "text").mapInArrow(cut, "id long, text_hash long, place long, near int, far int, high long, low long")
    found = keep(found, "anchors")
    where = F.struct("id", "text_hash", "place")
    heads = found.groupBy("high", "low").agg(F.min(where).alias("head"), F.max(where).alias("top")).filter("head <> top").select("high", "low", "head")
    # Both sides are plain tables, so that Spark can split an anchor that very many texts share.
    heads = keep(heads, "heads")
    later = found.join(heads, ["high", "low"]).filter(F.col("head") != where).select(
        "id", "text_hash", "place", "near", "far", F.col("head.id").alias("head_id"), F.col("head.text_hash").alias("head_hash"), F.col("head.place").alias("head_place"))
    pairs = keep(later.groupBy("id", "text_hash", "head_id", "head_hash").agg(F.collect_set(F.struct("place", "head_place", "near", "far")).alias("marks")), "pairs")
    discard(found)
    discard(heads)
    return pairs


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Bytes that two arrays have in common from their beginning, in time of that order."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        other = a[at:min(at + step, n)] != b[at:min(at + step, n)]
        if other.any():
            return at + int(other.argmax())
        at, step = at + len(other), 2 * step
    return n


def ranges(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers begins[i] .. ends[i] - 1 of all i, with i."""
    sizes = np.maximum(ends - begins, 0)
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - (np.cumsum(sizes) - sizes)[which] + begins[which]


def extended(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, least: int) -> pa.RecordBatch:
    """Pairs of texts (id, text_hash, text, head_id, head_hash, head_text, marks), their bytes and offsets: the passages
    that marks extend to, of the text (gone) and the head (not gone), and strings of `least` bytes about marks that reach
    beyond what the head has, with their digests."""
    heads = part.column("head_text").cast(pa.large_string())
    head_offsets = np.frombuffer(heads.buffers()[1], np.int64)[heads.offset:heads.offset + len(heads) + 1]
    head_data = np.frombuffer(heads.buffers()[2] or b"", np.uint8)
    lists = part.column("marks")
    marks = lists.flatten()
    row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
    place, head_place, near, far = (marks.field(c).to_numpy().astype(np.int64) for c in ("place", "head_place", "near", "far"))
    gap = place - head_place
    order = np.lexsort((place, gap, row))
    row, place, gap, near, far = (x[order] for x in (row, place, gap, near, far))
    groups = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (gap[1:] != gap[:-1]))) if len(row) else row
    begin, end = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    found, bounds = [], place.tolist()
    for i, to in zip(groups.tolist(), [*groups[1:].tolist(), len(row)]):
        r, way = int(row[i]), int(gap[i])
        own, head = data[offsets[r]:offsets[r + 1]], head_data[head_offsets[r]:head_offsets[r + 1]]
        while i < to:
            p = bounds[i]
            a, b = p - common(own[:p][::-1], head[:p - way][::-1]), p + common(own[p:], head[p - way:])
            next_ = max(i + 1, bisect_left(bounds, b, i, to))
            begin[i:next_], end[i:next_] = a, b
            if b - a >= least:
                found.append((r, way, a, b))
            i = next_
    names = ["id", "text_hash", "start", "stop", "gone", "high", "low"]
    key, other = [[part.column(c).to_numpy() for c in pair] for pair in (("id", "text_hash"), ("head_id", "head_hash"))]
    r, way, a, b = np.array(found, np.int64).reshape(-1, 4).T
    itself = (key[0][r] == other[0][r]) & (key[1][r] == other[1][r])
    first, last = place - far, place - near + 1
    which, at = (np.concatenate(x) for x in zip(ranges(first, np.minimum(last, begin)), ranges(np.maximum(first, np.maximum(end - least + 1, begin)), last)))
    start = np.unique(offsets[:-1][row[which]] + at)
    text = np.searchsorted(offsets, start, "right") - 1
    at = start - offsets[:-1][text]
    n, m = len(r), len(start)
    columns = [np.concatenate([key[0][r], other[0][r], key[0][text]]), np.concatenate([key[1][r], other[1][r], key[1][text]]),
               np.concatenate([np.where(itself, np.maximum(a, a - way + least), a), a - way, at]), np.concatenate([b, b - way, at + least])]
    gone = pa.array(np.append(np.repeat([True, False], n), np.zeros(m, bool)), mask=np.arange(2 * n + m) >= 2 * n)
    digests = [pa.array(np.append(np.zeros(2 * n, np.int64), span_hashes(data, start, start + least, *by).view(np.int64)), mask=np.arange(2 * n + m) < 2 * n)
               for by in ((), (OTHER, OTHER_INVERSE))]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), gone, *digests], names=names)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def whole_words(raw: bytes, spans: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Spans drawn in to where words begin and end, if that is REACH bytes away at most, and otherwise to where
    characters begin; those that are left with `least` bytes or more."""
    blank = lambda i: i < 0 or i >= len(raw) or bool(SPACE[raw[i]])
    out = []
    for a, b in spans:
        to = next((i for i in range(a, min(a + REACH, b)) if blank(i - 1) and not blank(i)), a)
        end = next((i for i in range(b, max(b - REACH, to), -1) if blank(i) and not blank(i - 1)), b)
        out += [(x, y) for x, y in whole_characters(raw, [(to, end)]) if y - x >= least]
    return out


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans drawn in to where characters begin, so that what stays is valid text."""
    inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    out = []
    for a, b in spans:
        while inside(a):
            a += 1
        while inside(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


SPAN = "array<struct<start:long,stop:long>>"


def dedupe_passages(docs: DataFrame, least: int = 120) -> DataFrame:
    """Remove repeated passages from all texts: returns the rows of (doc_id, text) with `kept` (the text without
    them), `repeated` (byte spans of passages that occur elsewhere too, this being the first occurrence or not)
    and `removed` (spans taken out).

    A passage is a stretch of `least` bytes or more, the same byte for byte at an earlier place in the order of doc_id, text
    and place. (1) Content-defined chunks are anchors only (see `anchors`): two occurrences of a stretch of `least` bytes
    share one. (2) Every anchor is compared with its first occurrence, byte-wise to both sides as far as the texts
    agree; what agrees for `least` bytes as a whole is a passage. (3) Strings of `least` bytes about an anchor that its first
    occurrence does not have may still be equal among the others: those are compared by a group-by on their digests.
    So no passage is missed for where its chunks end, and chunks that repeat at different places make none. What is taken
    out are whole words (of texts that have some), `least` bytes or more; the first occurrence stays. Where
    a stretch overlaps its own earlier occurrence, its first `least` bytes stay.

    Null text is empty and `kept` is then empty; rows with equal id and text are told apart by nothing, so they lose
    nothing to each other, and all keep what the first of them keeps. Null ids come first. An empty table gives none."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    docs = docs.withColumn("id", F.coalesce("doc_id", F.lit(-1 << 63)))
    pairs = repeated_anchors(docs, least)
    wanted = pairs.select("id", "text_hash").union(pairs.select("head_id", "head_hash")).distinct()
    texts = keep(docs.select("id", "text_hash", "text").join(wanted, ["id", "text_hash"]).groupBy("id", "text_hash").agg(F.first("text").alias("text")), "texts")

    def extend(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part, data, offsets in slices(batch, "text"):
                yield extended(part, data, offsets, least)

    # All sides of these joins are plain tables, so that Spark can split a text that very many share.
    both = pairs.join(texts.select(F.col("id").alias("head_id"), F.col("text_hash").alias("head_hash"), F.col("text").alias("head_text")), ["head_id", "head_hash"]).join(texts, ["id", "text_hash"])
    matches = keep(both.select("id", "text_hash", "text", "head_id", "head_hash", "head_text", "marks").mapInArrow(
        extend, "id long, text_hash long, start long, stop long, gone boolean, high long, low long"), "matches")
    discard(pairs)
    discard(texts)
    where = F.struct("id", "text_hash", "start")
    strings = matches.filter("gone is null")
    firsts = strings.groupBy("high", "low").agg(F.min(where).alias("head"), F.max(where).alias("top")).filter("head <> top").select("high", "low", "head")
    again = strings.join(keep(firsts, "firsts"), ["high", "low"])
    close = (F.col("id") == F.col("head.id")) & (F.col("text_hash") == F.col("head.text_hash")) & (F.col("start") < F.col("head.start") + least)
    again = again.filter((F.col("head") == where) | ~close).select("id", "text_hash", F.struct("start", "stop", (F.col("head") != where).alias("gone")).alias("mark"))
    marks = matches.filter("gone is not null").select("id", "text_hash", F.struct("start", "stop", "gone").alias("mark")).union(again)
    marks = marks.groupBy("id", "text_hash").agg(F.collect_set("mark").alias("marks"))

    def remove(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in rows:
            kept, found, real = [], [], []
            for r in range(batch.num_rows):
                text, marks = batch.column("text")[r].as_py(), batch.column("marks")[r].as_py() or []
                raw, at, parts = text.encode() if marks else b"", 0, []
                every, gone = [whole_words(raw, merged([(m["start"], m["stop"]) for m in marks if m["gone"] or not only]), least) for only in (False, True)]
                for a, b in gone:
                    parts.append(raw[at:a])
                    at = b
                kept.append(b"".join([*parts, raw[at:]]).decode() if gone else text)
                found.append([{"start": a, "stop": b} for a, b in every])
                real.append([{"start": a, "stop": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(kept, pa.string()), pa.array(found, span), pa.array(real, span)],
                                             names=["doc_id", "text", "kept", "repeated", "removed"])

    joined = docs.join(marks, ["id", "text_hash"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(remove, f"doc_id long, text string, kept string, repeated {SPAN}, removed {SPAN}")
