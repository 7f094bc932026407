"""Token ids as static range asymmetric numeral systems: shared frequencies, independent interleaved blocks."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inplay.llm.storage import new_path
from inplay.llm.tokens import encoder

SCALE = 20  # frequencies add up to 2^SCALE
LOW = 1 << 31  # states stay in [LOW, 2^63)
HEADER = struct.Struct("<4sIIIIII")  # mark, checksum of what follows, documents, tokens, lanes, checkpoints, words
MARK = b"rANS"
LANES = 1024
REMEMBERED = 250_000  # chunks of text a worker remembers the ids of (see tokens.Encoder), beside a segment's ids and table
EVERY = 64  # steps between checkpoints; one holds 8 bytes a lane, about a tenth of what lies between
SEGMENTS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("segment", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_docs", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("table", T.BinaryType()), T.StructField("blocks", T.ArrayType(T.BinaryType()))])
DOCUMENTS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
                          T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


class Frequencies:
    """Shared table: frequency of each id, scaled so that ids that occur have at least 1 and all add up to 2^SCALE."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.before = np.cumsum(self.freq) - self.freq
        self.id_of = np.repeat(np.arange(len(freq), dtype=np.uint16), freq.astype(np.int64))

    @classmethod
    def scaled(cls, counts: np.ndarray) -> Frequencies:
        total, size = int(counts.sum()), 1 << SCALE
        if total == 0:
            return cls(np.zeros(len(counts), np.int64))
        freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) / total * size), 0).astype(np.int64)
        while (over := int(freq.sum()) - size) != 0:  # rounding is made good at the most frequent ids
            order = np.argsort(-freq, kind="stable")
            for i in order[:max(1, min(len(order), abs(over)))]:
                step = min(over, int(freq[i]) // 2) if over > 0 else over
                freq[i] -= step
                over -= step
                if not over:
                    break
        return cls(freq)

    def to_bytes(self) -> bytes:
        """The ids that occur (16 bits each), then their frequencies (32 bits each), deflated."""
        ids = np.flatnonzero(self.freq)
        return zlib.compress(ids.astype("<u2").tobytes() + self.freq[ids].astype("<u4").tobytes(), 1)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Frequencies:
        raw = zlib.decompress(raw)
        n, freq = len(raw) // 6, np.zeros(1 << 16, np.int64)
        freq[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<u4", n, 2 * n)
        return cls(freq)


def encode_block(doc_ids: list[int | None], docs: list[np.ndarray], table: Frequencies, lanes: int = LANES, every: int = EVERY) -> bytes:
    """One self-contained block: header, document index, checkpoints, words.

    Token t belongs to lane t % lanes, and a step codes one token in every lane. Steps are coded from the last
    to the first; the decoder reads words forwards. A checkpoint at every `every` steps holds the word offset
    and all lanes' states, so decoding can start there."""
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint16)
    steps = -(-len(ids) // lanes)
    x, words, points, put = np.full(lanes, LOW, np.uint64), [], [], 0
    low, shift, up = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(SCALE)
    freq, before = table.freq[ids], table.before[ids]
    most = freq << np.uint64(63 - SCALE)
    for k in range(steps - 1, -1, -1):
        a, b = k * lanes, min((k + 1) * lanes, len(ids))
        f, y = freq[a:b], x[:b - a]
        full = y >= most[a:b]
        if full.any():
            words.append((y[full] & low).astype("<u4"))
            put += len(words[-1])
            y = np.where(full, y >> shift, y)
        q, r = np.divmod(y, f)
        x[:b - a] = (q << up) + r + before[a:b]
        if k % every == 0:
            points.append((k, put, x.copy()))
    points.reverse()
    body = b"".join([
        np.array([i is not None for i in doc_ids], np.uint8).tobytes(), np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
        np.array([len(d) for d in docs], "<u4").tobytes(),
        *[struct.pack("<II", k, put - done) + s.astype("<u8").tobytes() for k, done, s in points], *[w.tobytes() for w in reversed(words)]])
    return HEADER.pack(MARK, zlib.crc32(body), len(docs), len(ids), lanes, len(points), put) + body


def decode_block(block: bytes, table: Frequencies, first: int = 0, last: int | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths, and the token ids of places first .. last - 1 (default: all), decoded from
    the checkpoint before `first`. A wrong mark or checksum raises."""
    mark, check, n_docs, n_tokens, lanes, n_points, n_words = HEADER.unpack_from(block)
    body = memoryview(block)[HEADER.size:]
    if mark != MARK or zlib.crc32(body) != check:
        raise ValueError("damaged block")
    valid = np.frombuffer(body, np.uint8, n_docs)
    ids = np.frombuffer(body, "<i8", n_docs, n_docs)
    lengths = np.frombuffer(body, "<u4", n_docs, 9 * n_docs)
    at, size = 13 * n_docs, 8 + 8 * lanes
    words = np.frombuffer(body, "<u4", n_words, at + n_points * size)
    last = n_tokens if last is None else min(last, n_tokens)
    names = [int(i) if v else None for i, v in zip(ids, valid)]
    if first >= last:
        return names, lengths, np.zeros(0, np.uint16)
    steps = [struct.unpack_from("<II", body, at + p * size) for p in range(n_points)]
    point = max(p for p in range(n_points) if steps[p][0] * lanes <= first)
    step, word = steps[point]
    x = np.frombuffer(body, "<u8", lanes, at + point * size + 8).astype(np.uint64)
    out = np.zeros(last - step * lanes, np.uint16)
    mask, down, shift, low = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32), np.uint64(LOW)
    for a in range(step * lanes, last, lanes):
        n = min(lanes, n_tokens - a)
        y = x[:n]
        slot = y & mask
        t = table.id_of[slot]
        y = table.freq[t] * (y >> down) + slot - table.before[t]
        need = y < low
        if need.any():
            k = int(need.sum())
            y[need] = (y[need] << shift) | words[word:word + k].astype(np.uint64)
            word += k
        x[:n] = y
        take = min(n, last - a)
        out[a - step * lanes:a - step * lanes + take] = t[:take]
    return names, lengths, out[first - step * lanes:]


def tokens_in(block: bytes) -> int:
    return HEADER.unpack_from(block)[3]


def _ids_with_end(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    tokens, end = encoder(tokenizer, REMEMBERED), np.uint16(end_id)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256).to_pydict()
            for doc_id, ids in zip(some["doc_id"], tokens.ids(some["text"])):
                yield doc_id, np.append(np.frombuffer(ids, "<u2"), end)


def encode_segment(doc_ids: list[int | None], docs: list[np.ndarray], block_tokens: int, lanes: int) -> tuple[bytes, list[bytes]]:
    """A segment's shared table, from the counts of all its ids, and its blocks of whole documents: `block_tokens`
    tokens at most, or one longer document."""
    counts = np.zeros(1 << 16, np.int64)
    for d in docs:
        counts += np.bincount(d, minlength=1 << 16) if len(d) > 1 << 14 else 0
    small = [d for d in docs if len(d) <= 1 << 14]
    counts += np.bincount(np.concatenate(small), minlength=1 << 16) if small else 0
    table, blocks, at, size = Frequencies.scaled(counts), [], 0, 0
    for i, d in enumerate([*docs, None]):
        if d is None or (i > at and size + len(d) > block_tokens):
            blocks.append(encode_block(doc_ids[at:i], docs[at:i], table, lanes))
            at, size = i, 0
        size += 0 if d is None else len(d)
    return table.to_bytes(), blocks


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_tokens: int = 1 << 22, block_tokens: int = 1 << 18, lanes: int = LANES) -> str:
    """Encode every document's ids and `end_id` to files at `path`, in ascending doc_id order (null first, equal
    ids by their texts' hash). One range exchange, then one pass: a task's documents go to segments of about
    `segment_tokens` tokens (or one longer document), which is what a task holds at once. A segment is a row of
    Parquet, which Spark's committer makes whole or not at all: the frequency table that its blocks share, and
    the blocks, each of which can be decoded alone and from any of its checkpoints.

    Repeated ids are spread over ranges like others. Empty and null texts are one id, `end_id`; an empty table gives
    an empty file; other columns are ignored."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, held, size, segment, start = [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            table, blocks = encode_segment(ids, held, block_tokens, lanes)
            values = [[part], [segment], [start], [len(held)], [size], [table], [blocks]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=SEGMENTS.names)

        for doc_id, tokens in _ids_with_end(batches, tokenizer, end_id):
            if held and size + len(tokens) > segment_tokens:
                yield row()
                ids, held, size, segment, start = [], [], 0, segment + 1, start + size
            ids.append(doc_id)
            held.append(tokens)
            size += len(tokens)
        if held:
            yield row()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(n, "doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place").select("doc_id", "text")
    ordered.mapInArrow(encode, SEGMENTS).write.parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files at `path`: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian
    unsigned 32-bit). Every block is decoded on its own; the start of each part comes from one sum per part."""
    segments = spark.read.schema(SEGMENTS).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, start, raw_table, blocks = (batch.column(c)[row] for c in ("part", "start", "table", "blocks"))
                table, start = Frequencies.from_bytes(raw_table.as_py()), start.as_py()
                for block in blocks.as_py():
                    ids, lengths, tokens = decode_block(block, table)
                    ends = np.cumsum(lengths.astype(np.int64))
                    raw, size = tokens.astype("<u4").tobytes(), len(ids)
                    pieces = [raw[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * size, pa.int32()), pa.array(ids, pa.int64()), pa.array(start + ends - lengths, pa.int64()),
                                                      pa.array(lengths, pa.int64()), pa.array(pieces, pa.binary())], names=DOCUMENTS.names)
                    start += len(tokens)

    return segments.select("part", "start", "table", "blocks").mapInArrow(decode, DOCUMENTS).select(
        "doc_id", (F.col("start") + _part_base(segments)).alias("start"), "n_tokens", "ids")


def _part_base(segments: DataFrame) -> Column:
    """How many ids lie in the parts before the row's part; one number per part comes to the driver."""
    sums = {r["part"]: r["n"] for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    bases, total = [], 0
    for p in range(max(sums, default=-1) + 1):
        bases.append(total)
        total += sums.get(p, 0)
    return F.get(F.from_json(F.lit(json.dumps(bases)), "array<bigint>"), F.col("part"))


def read_ids(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The ids of places first .. last - 1 of the whole stream: (place of the first, ids as little-endian unsigned 32-bit),
    a row per block they lie in. Other segments are skipped; in a block decoding starts at the checkpoint before `first`."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    placed = segments.withColumn("start", F.col("start") + _part_base(segments)).filter((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, raw_table, blocks = (batch.column(c)[row].as_py() for c in ("start", "table", "blocks"))
                table = Frequencies.from_bytes(raw_table)
                for block in blocks:
                    size = tokens_in(block)
                    a, b = max(first - start, 0), min(last - start, size)
                    if a < b:
                        ids = decode_block(block, table, a, b)[2]
                        yield pa.RecordBatch.from_arrays([pa.array([start + a], pa.int64()), pa.array([ids.astype("<u4").tobytes()], pa.binary())], names=["place", "ids"])
                    start += size

    return placed.select("start", "table", "blocks").mapInArrow(decode, "place long, ids binary")


def token_file(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents' ids to a new file in the shared folder and read it back."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, new_path(spark, "tokens"), tokenizer, end_id))
