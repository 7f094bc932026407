"""Packing token streams into sequences of one length, by order-preserving dynamic programming."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from inplay.llm.tokens import encoder

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
#: Marks that end a sentence, and what may close it after them.
SENTENCE_END, CLOSERS = ".!?…。！？", "\"')]}»”’"


def choose_cuts(places: np.ndarray, penalties: np.ndarray, length: int, final: bool) -> list[int]:
    """Which of the ascending `places` (the first is where the first sequence starts) to cut at, so that
    padding plus cut penalties over all sequences is least.

    cost[j] = penalty[j] + min over i of cost[i] + padding(places[j] - places[i]), where padding(n) is
    length - n, or 0 where n is a power of two. The first form is a minimum of cost[i] + places[i] over a
    sliding window of places, held by a monotone queue; the exact powers of two are found beforehand, one search
    of all places per size. Ties go to the longest sequence. No gap between places may exceed `length`. Returns the indices cut at,
    the first and last included; unless `final`, the last place of the window of least cost ends the plan."""
    n = len(places)
    to, before = [], []
    for size in 2 ** np.arange(int(length).bit_length()):
        at = np.searchsorted(places, places - size)
        hit = np.flatnonzero((places[at] == places - size) & (size < length))
        to.append(hit)
        before.append(at[hit])
    to, before = np.concatenate(to), np.concatenate(before)
    order = np.argsort(to, kind="stable")
    hits = [*to[order].tolist(), n]
    origins, hit = before[order].tolist(), 0
    at, fee = places.tolist(), penalties.tolist()
    cost, back = [0.0] * n, [0] * n
    queue, keys, head = [0], [float(at[0])], 0  # indices in the window, and their cost + place, ascending from `head`
    for j in range(1, n):
        p = at[j]
        low = p - length
        while at[queue[head]] < low:
            head += 1
        i = queue[head]
        best = keys[head] - low
        while hits[hit] == j:
            e = origins[hit]
            hit += 1
            if cost[e] < best:
                best, i = cost[e], e
        best += fee[j]
        cost[j] = best
        back[j] = i
        best += p
        while len(keys) > head and keys[-1] > best:
            keys.pop()
            queue.pop()
        keys.append(best)
        queue.append(j)
    j = n - 1
    if not final:
        first = int(np.searchsorted(places, places[-1] - length))
        j = min(range(max(first, 1), n), key=lambda k: cost[k] - at[k] * 1e-9)
    path = [j]
    while j:
        j = back[j]
        path.append(j)
    return path[::-1]


class Packer:
    """Packs one partition's documents in order. Plans over `horizon` tokens at a time; all but the last
    two sequences of a plan are final, the rest is planned again with what follows, so memory stays bounded."""

    def __init__(self, length: int, sentence_fee: float, token_fee: float, ends: np.ndarray, horizon: int, first_sequence: int):
        self.length, self.sentence_fee, self.token_fee, self.ends = length, sentence_fee, token_fee, ends
        self.horizon, self.sequence = max(horizon, 8 * length), first_sequence
        self.docs: deque = deque()  # (id, ids, place of the document's first token in the stream)
        self.begun, self.total = 0, 0  # what is packed, what has come

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, ids, self.total))
        self.total += len(ids)
        if self.total - self.begun >= self.horizon:
            yield from self.plan(final=False)

    def plan(self, final: bool) -> Iterator[tuple]:
        if self.total == self.begun:
            return
        places, fees = [np.array([self.begun])], [np.zeros(1)]
        for _, ids, start in self.docs:
            inner = np.flatnonzero(self.ends[ids[:-1]]) + (start + 1)
            inner = inner[inner > self.begun]
            places += [inner, np.array([start + len(ids)])]
            fees += [np.full(len(inner), self.sentence_fee), np.zeros(1)]
        place, fee = np.concatenate(places), np.concatenate(fees)
        gaps = np.flatnonzero(np.diff(place) > self.length)
        if len(gaps):  # a stretch without sentence ends: it may be cut anywhere at steps that keep every gap in reach
            step = max(1, self.length // 16)
            more = np.concatenate([np.arange(place[g] + step, place[g + 1], step) for g in gaps])
            place, fee = np.concatenate([place, more]), np.concatenate([fee, np.full(len(more), self.token_fee)])
            order = np.argsort(place, kind="stable")
            place, fee = place[order], fee[order]
        cuts = place[choose_cuts(place, fee, self.length, final)].tolist()
        if not final:
            cuts = cuts[:-2]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield from self.sequence_of(a, b)
        self.begun = cuts[-1]

    def sequence_of(self, a: int, b: int) -> Iterator[tuple]:
        offset = 0
        while a < b:
            doc_id, ids, start = self.docs[0]
            stop = min(b, start + len(ids))
            piece = ids[a - start:stop - start]
            yield doc_id, a - start, len(piece), piece.astype("<u4").tobytes(), len(ids), self.sequence, offset
            offset += len(piece)
            a = stop
            if stop == start + len(ids):
                self.docs.popleft()
        self.sequence += 1


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096, sentence_fee: float = 8, token_fee: float = 64, horizon: int = 1 << 18) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most `length` tokens. A document is its text's
    ids and then `end_id`. Returns one row per piece: doc_id, start (the document's ids before it), length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset in the sequence.

    Order-preserving: each partition of the input is packed in its own order, document after document, and its
    sequences are numbered from 2^33 times the partition's number. Cuts lie at ends of documents (free), ends of
    sentences (`sentence_fee` tokens' worth of padding) or, where a stretch without sentence ends exceeds a
    sequence, within it (`token_fee`); the sum of padding and fees is least within a horizon of `horizon` tokens.

    No shuffle: a partition is read once, and only the horizon (or the longest document) is in memory. A task that
    is run again gives the same rows. Null and empty texts are one id, `end_id`; null and repeated ids and texts
    are documents of their own; an empty table gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        ends = np.zeros(1 << 16, bool)
        for token, i in tokens.library.get_vocab().items():
            bare = token.removesuffix("</w>").rstrip(CLOSERS)
            ends[i] = bool(bare) and bare[-1] in SENTENCE_END
        task = TaskContext.get()
        packer = Packer(length, sentence_fee, token_fee, ends, horizon, (task.partitionId() if task else 0) << 33)
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=SCHEMA.names)
            rows.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256).to_pydict()
                for doc_id, ids in zip(some["doc_id"], tokens.ids(some["text"])):
                    rows.extend(packer.add(doc_id, np.append(np.frombuffer(ids, "<u2"), np.uint16(end_id))))
                if len(rows) >= 1000:
                    yield out()
        rows.extend(packer.plan(final=True))
        if rows:
            yield out()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)
