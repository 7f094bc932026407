"""How filters interact: every order of five filters at once, with duplicates found by compressed tries of the texts."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inplay.llm.storage import discard, keep
from inplay.llm.textscan import slices, span_hashes, word_spans

FILTERS = "ABCDE"
SHORT, COMMON, CAPITALS, SYMBOLS, COPY = (1 << i for i in range(5))
#: An id of null is larger than every other.
NO_ID = (1 << 63) - 1

_BYTE = np.arange(256)
CAPITAL = (_BYTE >= ord("A")) & (_BYTE <= ord("Z"))
SYMBOL = np.isin(_BYTE, [ord(c) for c in "#$%&*|"])
FIRST_OF_POINT = (_BYTE & 0xC0) != 0x80  # bytes that begin a code point


def own_failures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of the filters that look at one text alone: under 200 words, under half of them distinct, more than two
    in a hundred code points capitals, a symbol of #$%&*|. Words are compared by 64-bit hashes."""
    docs = len(offsets) - 1
    starts, stops, first = word_spans(data, offsets)
    words = np.diff(first)
    hashes = span_hashes(data, starts, stops)
    text = np.repeat(np.arange(docs), words)
    order = np.lexsort((hashes, text))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    distinct = np.bincount(text[order[new]], minlength=docs)

    def count(flag: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flag))
        return total[offsets[1:]] - total[offsets[:-1]]

    return (SHORT * (words < 200) + COMMON * (100 * distinct < 50 * words) + CAPITALS * (100 * count(CAPITAL[data]) > 2 * count(FIRST_OF_POINT[data]))
            + SYMBOLS * (count(SYMBOL[data]) > 0)).astype(np.int32)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A compressed trie of texts: edges carry strings, no node but the root has a single child and no end. A text's
    end holds the least id of those inserted and the rows that wait for it."""

    __slots__ = ("children", "least", "rows")

    def __init__(self) -> None:
        self.children: dict[int, list] = {}  # first byte -> [label, node]
        self.least: int | None = None
        self.rows: list = []

    def insert(self, text: bytes, number: int, row: object) -> None:
        node, at = self, 0
        while at < len(text):
            edge = node.children.get(text[at])
            if edge is None:
                new = Trie()
                node.children[text[at]] = [text[at:], new]
                node, at = new, len(text)
            elif text.startswith(edge[0], at):
                node, at = edge[1], at + len(edge[0])
            else:
                label, below = edge
                n = _shared(label, text[at:at + len(label)])
                middle = Trie()
                middle.children[label[n]] = [label[n:], below]
                node.children[text[at]] = [label[:n], middle]
                node, at = middle, at + n
        node.least = number if node.least is None else min(node.least, number)
        node.rows.append(row)

    def ends(self) -> Iterator[Trie]:
        """Every node at which texts end."""
        stack = [self]
        while stack:
            node = stack.pop()
            if node.least is not None:
                yield node
            stack.extend(edge[1] for edge in node.children.values())


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray, np.ndarray]]:
    for part, data, offsets in slices(batch, "text"):
        whole = data.tobytes()
        yield part, [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], data, offsets


def prefix_cuts(docs: DataFrame, target: int = 16 << 20, every: int = 1 << 18) -> list[bytes]:
    """Ascending prefixes that cut all texts into ranges of about `target` bytes each. Their lengths adapt: a cut is the
    shortest prefix that tells two neighbouring texts apart.

    Every task sorts its texts, a megabyte at a time, and gives such a prefix each `every` bytes, from a first place that
    differs from one megabyte to the next (else all would cut at the same few quantiles); these few are ordered by range
    and thinned to one cut every `target` bytes. Only the cuts come to the driver: total bytes / target."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            for _, texts, _, _ in _texts(batch):
                texts.sort()
                turn += 1
                found, weight, before = [], turn * 0.6180339887 % 1 * every, b""
                for text in texts:
                    if weight >= every and before != text:
                        found.append(text[:_shared(before, text) + 1])
                        weight %= every
                    weight += len(text)
                    before = text
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([every] * len(found), pa.int64())], names=["prefix", "bytes"])

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = target  # each range of the order begins with a cut
        for batch in batches:
            cuts = []
            for prefix, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if weight >= target:
                    cuts.append(prefix)
                    weight = 0
                weight += size
            yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.binary())], names=["prefix"])

    parts = keep(docs.select("text").mapInArrow(local, "prefix binary, bytes long").groupBy("prefix").agg(F.sum("bytes").alias("bytes")), "prefixes")
    total = parts.agg(F.sum("bytes")).first()[0] or 0
    ordered = parts.repartitionByRange(1 + total // (64 * target), "prefix").sortWithinPartitions("prefix")
    cuts = sorted({r["prefix"] for r in ordered.mapInArrow(thin, "prefix binary").collect()})
    discard(parts)
    return [bytes(c) for c in cuts if c]


def failures(docs: DataFrame, target: int = 16 << 20) -> DataFrame:
    """(doc_id long, part string, mask int) for every row of `docs` (doc_id, text, source): bit i of the mask is set when
    the text fails filter i of ABCDE. E fails when a row of a smaller id holds the same text.

    Texts are dealt by ranges of their prefixes and inserted whole into a compressed trie per task, whose ends keep the
    least id; what is not the least of its text fails. Before the exchange each batch settles its own copies: only
    the least of each text goes on with its text, others carry their mask alone. So a text that a third of all rows
    hold reaches its trie once a batch. Null text is empty, a null id is larger than every other, a null source is the
    empty part. Rows of one id and text fail or pass together."""
    cuts = prefix_cuts(docs, target)
    ranges = len(cuts) + 1

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lone = 0
        for batch in batches:
            for part, texts, data, offsets in _texts(batch):
                ids = part.column(0).fill_null(NO_ID).to_pylist()
                masks = own_failures(data, offsets)
                least: dict[bytes, int] = {}
                for text, number in zip(texts, ids):
                    if least.get(text, NO_ID) >= number:
                        least[text] = number
                sent, range_of = [], np.empty(len(texts), np.int32)
                for i, (text, number) in enumerate(zip(texts, ids)):
                    if least.get(text, NO_ID) < number:
                        masks[i] |= COPY
                        sent.append(None)
                        range_of[i] = lone = (lone + 1) % ranges
                    else:
                        sent.append(text)
                        range_of[i] = bisect_right(cuts, text)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array(masks, pa.int32()), pa.array(range_of), pa.array(sent, pa.binary())],
                                                 names=["doc_id", "part", "mask", "range", "text"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, trie = ["doc_id", "part", "mask"], Trie()
        for batch in batches:
            settled = pa.compute.is_null(batch.column(3))
            yield batch.filter(settled).select(names)
            rest = batch.filter(pa.compute.invert(settled))
            for number, part, mask, text in zip(*[rest.column(i).to_pylist() for i in range(4)]):
                trie.insert(text, NO_ID if number is None else number, (number, part, mask))
        rows = []
        for end in trie.ends():
            rows += [(n, p, m | COPY if (NO_ID if n is None else n) > end.least else m) for n, p, m in end.rows]
            if len(rows) > 10_000:
                yield _rows(rows)
                rows = []
        yield _rows(rows)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    sent = texts.mapInArrow(settle, "doc_id long, part string, mask int, range int, text binary")
    return sent.repartitionById(ranges, F.col("range")).select("doc_id", "part", "mask", "text").mapInArrow(judge, "doc_id long, part string, mask int")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    numbers, parts, masks = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(parts, pa.string()), pa.array(masks, pa.int32())], names=["doc_id", "part", "mask"])


def steps() -> Column:
    """All orders of the filters, one struct per order and step: its letters, the step, its filter's bit and the bits
    of the filters before it."""
    rows = []
    for order in permutations(range(5)):
        before = 0
        for step, i in enumerate(order, 1):
            rows.append({"filter_order": "".join(FILTERS[k] for k in order), "step": step, "bit": 1 << i, "before": before})
            before |= 1 << i
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")


def interactions(docs: DataFrame, labels: DataFrame, target: int = 16 << 20) -> DataFrame:
    """What each filter removes at each step of each order, per source: part, filter_order, step, and the counts kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    `docs` (doc_id, text, source), `labels` (doc_id, quality, toxic); other columns are not read. Every row counts, repeated
    ones too; of several labels of an id one with the value suffices, null labels and labels of null ids count nowhere.
    Rows shrink to (id, part, mask) with their number before they meet the labels, so a hot id is one row; per part 32
    masks are left, and every figure is a sum over those whose filters fail or hold. A mask of k failing filters is
    removed by each of them in 120 / k of all orders. An empty table gives no rows."""
    rows = failures(docs, target).groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marked = rows.join(marks, "doc_id", "left").select("part", "mask", "n", (F.coalesce("good", F.lit(0)) * F.col("n")).alias("good"), (F.coalesce("toxic", F.lit(0)) * F.col("n")).alias("toxic"))
    few = marked.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    listed = few.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most
    each = listed.select("part", "masks", F.explode(steps()).alias("s")).select("part", "masks", "s.*")

    def total(where, value=lambda m: m["n"]) -> Column:
        return F.aggregate(F.filter("masks", where), F.lit(0).cast("long"), lambda s, m: s + value(m))

    fails = lambda m: m["mask"].bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m["mask"].bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~gone(m)
    return each.select(
        "part", "filter_order", "step", total(lambda m: ~fails(m) & ~gone(m)).alias("kept"), total(here).alias("removed"), total(lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda m: m["mask"] == F.col("bit")).alias("unique_fails"), total(here, lambda m: m["good"]).alias("good_lost"), total(here, lambda m: m["toxic"]).alias("toxic_lost"),
        total(fails, lambda m: m["n"] * (F.lit(120) / F.bit_count(m["mask"])).cast("long")).alias("shapley"))
