"""Words and their hashes of many texts at once, with numpy over Arrow's buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from inplay.llm.tokens import forget

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are worked on at once; a longer single text is worked on whole.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64, not to be written to. Those a slice needs are made once per process and base."""
    if n > SLICE_BYTES + 1:
        return _powers(base, n)
    if base not in _POWERS:
        _POWERS[base] = _powers(base, SLICE_BYTES + 1)
    return _POWERS[base][:n]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about `limit` bytes of text: (rows, their bytes, offsets of each text). Null is empty.

    Scans of text use no token ids, so what an earlier stage's encoder remembers in this worker is dropped first."""
    forget()
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield batch.slice(at, to - at), data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of non-space bytes within a text, and per text its first word's index
    (one more entry at the end)."""
    solid = np.zeros(len(data) + 2, bool)
    np.logical_not(SPACE[data], out=solid[1:-1])
    begins, ends = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]  # a text may end, and the next begin, without a space
    begins[bounds] = solid[1:-1][bounds]
    ends[bounds - 1] = solid[1:-1][bounds - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int = BASE, inverse: int = BASE_INVERSE) -> np.ndarray:
    """64-bit hash of data[start:stop] for each span, from one running sum; equal bytes give equal hashes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=total[1:])
    return mix((total[stops] - total[starts]) * powers(inverse, len(data) + 1)[starts] + (stops - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z in lower case, and per text its first word's index (one more entry at the end)."""
    starts, stops, first = word_spans(data, offsets)
    return span_hashes(LOWER[data], starts, stops), first


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of every run of `size` words (they may span texts: the caller takes those that do not)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * np.uint64(BASE) + words[j:j + n]
    return mix(out)


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words as a sequence of its own; differs from that of a shingle."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = out * np.uint64(BASE) + words[j:j + n]
    return mix(out ^ np.uint64(0x5851F42D4C957F2D))


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence of words."""
    return sequence_hashes(words, len(words))[0]
