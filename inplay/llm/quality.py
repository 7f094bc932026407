"""Document quality by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inplay.llm.textscan import LOWER, SPACE, slices, span_hashes, word_spans

BITS = 14  # hashed words
BINS = 8  # per structure statistic
STATISTICS = ("words", "word_length", "upper", "digits", "symbols", "spaces", "lines", "beyond_ascii", "distinct", "doubled", "wordless", "symbol_ends", "sentences", "single")
META = 1 << 10  # hashed metadata values
WORDS_AT, BINS_AT = 0, 1 << BITS
META_AT = BINS_AT + BINS * len(STATISTICS)
WIDTH = META_AT + META

_BYTE = np.arange(256)
UPPER, DIGIT = (_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 48) & (_BYTE <= 57)
LETTER = UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
SYMBOL = ~SPACE & ~LETTER & ~DIGIT
STOP = np.isin(_BYTE, [ord("."), ord("!"), ord("?")])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of the texts: (row, column, value). Words: log counts, scaled so a text's squares add up to 1.
    Each statistic lights two neighbouring bins of its range, in proportion."""
    docs = len(offsets) - 1
    starts, stops, first = word_spans(data, offsets)
    words = np.diff(first)
    some, size = np.maximum(words, 1), np.maximum(np.diff(offsets), 1)
    hashes = span_hashes(LOWER[data], starts, stops)
    text = np.repeat(np.arange(docs), words)

    def share(flag: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flag))
        return (total[at[1:]] - total[at[:-1]]) / of

    letters = np.append(0, np.cumsum(LETTER[data]))
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])) if len(hashes) else np.zeros(0, bool)
    code, counts = np.unique((text.astype(np.int64) << BITS) | (hashes & np.uint64((1 << BITS) - 1)).astype(np.int64), return_counts=True)
    row, column = code >> BITS, code & ((1 << BITS) - 1)
    value = 1 + np.log(counts)
    norm = np.sqrt(np.bincount(row, value * value, docs))
    distinct = np.bincount(row, minlength=docs)
    ends = data[stops - 1] if len(stops) else np.zeros(0, np.uint8)
    table = np.stack([
        np.log1p(words) / 12, share(stops - starts, first, some) / 20, share(UPPER[data], offsets, size), share(DIGIT[data], offsets, size), share(SYMBOL[data], offsets, size) * 2,
        share(SPACE[data], offsets, size) * 2, share(data == 10, offsets, some) * 4, share(data >= 128, offsets, size) * 2, distinct / some, share(same, first, some),
        share(letters[stops] == letters[starts], first, some) * 2, share(SYMBOL[ends] & ~STOP[ends] & (ends != ord(",")), first, some), share(STOP[data], offsets, some), share(stops - starts == 1, first, some) * 2], 1)
    spot = np.clip(table, 0, 1) * (BINS - 1)
    low = np.minimum(spot.astype(np.int64), BINS - 2)
    bin_at = BINS_AT + BINS * np.arange(len(STATISTICS)) + low
    rows = np.repeat(np.arange(docs), len(STATISTICS))
    return (np.concatenate([row, rows, rows]), np.concatenate([column, bin_at.ravel(), bin_at.ravel() + 1]),
            np.concatenate([value / norm[row] if len(row) else value, (1 - (spot - low)).ravel(), (spot - low).ravel()]).astype(np.float32))


class Machine:
    """score = sigmoid(b + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j). The pairs cost no more than the row:
    half of (sum v_i x_i)^2 - sum v_i^2 x_i^2, for each of the few dimensions of v."""

    def __init__(self, rank: int = 8, seed: int = 1):
        self.bias = np.float32(0)
        self.weight = np.zeros(WIDTH, np.float32)
        self.factor = np.random.default_rng(seed).normal(0, 0.02, (WIDTH, rank)).astype(np.float32)

    def logits(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        part = self.factor[column] * value[:, None]
        mean = np.stack([np.bincount(row, p, n) for p in part.T], 1)
        squares = np.bincount(row, (part * part).sum(1), n)
        return self.bias + np.bincount(row, self.weight[column] * value, n) + 0.5 * ((mean * mean).sum(1) - squares), mean

    def scores(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(row, column, value, n)[0], -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.1, decay: float = 1e-5, seed: int = 1) -> Machine:
        """Minimise log loss by Adagrad over mini-batches; rows are (columns, values)."""
        rng, g_w, g_v = np.random.default_rng(seed), np.full(WIDTH, 1e-2, np.float32), np.full(self.factor.shape, 1e-2, np.float32)
        share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
        self.bias = np.float32(np.log(share / (1 - share)))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                some = order[at:at + batch]
                row = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
                column = np.concatenate([rows[i][0] for i in some])
                value = np.concatenate([rows[i][1] for i in some])
                logit, mean = self.logits(row, column, value, len(some))
                error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[some]) / len(some)).astype(np.float32)
                e = error[row] * value
                seen, where = np.unique(column, return_inverse=True)
                d_w = np.bincount(where, e, len(seen)) + decay * self.weight[seen]
                step = e[:, None] * (mean.astype(np.float32)[row] - self.factor[column] * value[:, None])
                d_v = np.stack([np.bincount(where, s, len(seen)) for s in step.T], 1) + decay * self.factor[seen]
                g_w[seen] += d_w * d_w
                g_v[seen] += d_v * d_v
                self.weight[seen] -= rate * d_w / np.sqrt(g_w[seen])
                self.factor[seen] -= 0.5 * rate * d_v / np.sqrt(g_v[seen])
                self.bias -= np.float32(0.05 * error.sum())
        return self


def _with_metadata(part: pa.RecordBatch, metadata: Sequence[str], sparse: tuple) -> tuple:
    row, column, value = sparse
    for name in metadata:
        cells = part.column(name).to_pylist()
        column = np.append(column, [META_AT + zlib.crc32(f"{name}={c}".encode()) % META for c in cells])
        row, value = np.append(row, np.arange(len(cells))), np.append(value, np.ones(len(cells), np.float32))
    return row, column, value


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, rank: int = 8, metadata: Sequence[str] = (), seed: int = 1) -> Machine:
    """Fit a machine on labelled documents: labels (doc_id, quality 0/1), docs (doc_id, text). At most `sample`
    labelled ids, those of the least hash, are used; that bounds what is sent to the driver (a row holds at most
    one number per feature). Several labels of one id count as their rounded mean, several texts of one id as the
    least of them; null labels and ids are left out. Without any label the machine gives every text 0.5, with one
    class alone it leans to that class."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.round(F.avg("quality")).alias("quality"))
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                row, column, value = _with_metadata(part, metadata, features(data, offsets))
                order = np.argsort(row, kind="stable")
                ends = np.searchsorted(row[order], np.arange(part.num_rows + 1))
                c, v = column[order].astype("<i4"), value[order].astype("<f4")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array([c[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                                                  pa.array([v[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())], names=["doc_id", "quality", "columns", "values"])

    joined = docs.select("doc_id", "text", *metadata).join(F.broadcast(chosen), "doc_id")  # `sample` rows at most
    joined = joined.withColumn("doc_id", F.col("doc_id").cast("long"))
    some = joined.mapInArrow(rows, "doc_id long, quality double, columns binary, values binary")
    some = some.groupBy("doc_id").agg(F.min_by(F.struct("quality", "columns", "values"), F.xxhash64("columns", "values")).alias("r")).orderBy("doc_id").select("r.*")
    got = some.collect()
    machine = Machine(rank, seed)
    if not got:
        return machine
    sparse = [(np.frombuffer(r["columns"], "<i4"), np.frombuffer(r["values"], "<f4")) for r in got]
    return machine.fit(sparse, np.array([r["quality"] for r in got], np.float32), seed=seed)


def score(docs: DataFrame, machine: Machine, metadata: Sequence[str] = ()) -> DataFrame:
    """Every row of `docs` with `score` double (0 to 1); its other columns pass through, a former `score` gives way.
    Null text is empty; an empty text is scored by its statistics. No shuffle; a text is read once, in time linear in
    its words."""
    docs = docs.drop("score")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                got = machine.scores(*_with_metadata(part, metadata, features(data, offsets)), part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], names=[*part.schema.names, "score"])

    return docs.mapInArrow(run, schema)
