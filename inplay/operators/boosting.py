"""Boosted trees with monotone constraints: split search over histograms that all tasks add up, bounds passed down."""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field
from itertools import chain, combinations
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.types import DoubleType

BINS = 64
CELLS = BINS * BINS  # of the histogram of a few columns together
PAIRED = 5  # columns up to which the histograms of all pairs cost no more than two levels of single ones
HELD = 1 << 14  # rows scored at once
PIECE = 1 << 16  # rows that a task holds as one and goes over at once: what it makes of them stays in the processor's cache


@dataclass(frozen=True)
class Settings:
    rounds: int
    step: float
    depth: int
    row_share: float = 1.0
    column_share: float = 1.0
    split_penalty: float = 0.0
    leaf_weight: float = 1.0
    signs: tuple[int, ...] = ()  # per feature: 1 rising, -1 falling, 0 free; empty: all free
    ridge: float = 1.0
    seed: int = 2013


@dataclass
class Trees:
    """Complete binary trees as rows of arrays: feature and threshold of inner nodes (a row with x < threshold or without a
    value goes left), value of leaves in log odds."""

    base: float
    depth: int
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.base)
        for at in range(0, len(x), HELD):
            columns = np.ascontiguousarray(np.where(np.isnan(x[at:at + HELD]), -np.inf, x[at:at + HELD]).T)
            for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
                node = np.zeros(columns.shape[1], np.min_scalar_type(2**self.depth))
                for level in range(self.depth):
                    node = step_down(node, level, feature, threshold, lambda f, t: columns[f] >= t, np.inf)
                odds[at:at + HELD] += leaf[node]
        return 1 / (1 + np.exp(-odds))


def best_split(g: np.ndarray, h: np.ndarray, low: float, high: float, s: Settings, signs: np.ndarray) -> tuple[float, int, int, float, float]:
    """(gain, feature, bin, left weight, right weight) of one node from its histograms (features x bins). Weights stay
    within the node's bounds, and a split that would go against its feature's sign is no split."""
    gl, hl = g.cumsum(1), h.cumsum(1)
    total_g, total_h = gl[0, -1], hl[0, -1]
    gr, hr = total_g - gl, total_h - hl
    wl, wr = np.clip(-gl / (hl + s.ridge), low, high), np.clip(-gr / (hr + s.ridge), low, high)
    own = min(max(-total_g / (total_h + s.ridge), low), high)
    worth = lambda g_, h_, w: -(2 * g_ * w + (h_ + s.ridge) * w * w)
    gain = (worth(gl, hl, wl) + worth(gr, hr, wr) - worth(total_g, total_h, own)) / 2 - s.split_penalty
    gain[(hl < s.leaf_weight) | (hr < s.leaf_weight) | (signs[:, None] * (wr - wl) < 0)] = -np.inf
    gain[:, -1] = -np.inf
    i = int(gain.argmax())
    f, b = divmod(i, gain.shape[1])
    return float(gain[f, b]), f, b, float(wl[f, b]), float(wr[f, b])


def step_down(node: np.ndarray, level: int, feature: np.ndarray, cut: np.ndarray, above, never: float) -> np.ndarray:
    """Places of the rows in the next level, counted from its left, from those in `level`. `above(f, c)` says which rows
    lie right of cut c of feature f; a node whose cut is `never` sends all to the left. Comparing all rows once a node
    beats looking up each row's feature and cut as long as the nodes are few."""
    right = np.zeros(len(node), bool)
    for k in range(2**level):
        at = 2**level - 1 + k
        if cut[at] < never:
            right |= (node == k) & above(feature[at], cut[at].item())
    return node * node.dtype.type(2) + right


def together(sizes: Sequence[int], many: int) -> list[tuple[int, ...]]:
    """Sets of columns (their numbers of bins are given) such that `many` of any columns lie in one set. Sets have at most
    CELLS joint bins, so columns of few bins share one."""
    sets: list[tuple[int, ...]] = []
    open_ = set(combinations(range(len(sizes)), min(many, len(sizes))))
    for want in sorted(open_, key=lambda w: (-math.prod(sizes[c] for c in w), w)):
        if want not in open_:
            continue
        one = list(want)
        for c in sorted(range(len(sizes)), key=lambda c: (sizes[c], c)):
            more = sorted([*one, c])
            if c not in one and math.prod(sizes[d] for d in more) <= CELLS and open_ & (set(combinations(more, len(want))) - set(combinations(sorted(one), len(want)))):
                one = more
        sets.append(tuple(sorted(one)))
        open_ -= set(combinations(sets[-1], len(want)))
    return sets


def level_sums(binned: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, columns: np.ndarray, sizes: Sequence[int], sets: Sequence[tuple[int, ...]], level: int) -> np.ndarray:
    """Gradients and their slopes per set of columns, node of the level and joint bin, one after the other."""
    out = []
    for one in sets:
        cells = math.prod(sizes[c] for c in one)
        joint = np.zeros(len(node), np.uint16)
        for c in one:
            joint = joint * np.uint16(sizes[c]) + binned[:, columns[c]]
        flat = np.multiply(node, cells, dtype=np.int64) + joint
        out += [np.bincount(flat, v, 2**level * cells) for v in (g, h)]
    return np.concatenate(out).astype(float)


class Histograms:
    """What level_sums gave, by node of the level: single columns of a node, or of one side of a cut through it."""

    def __init__(self, sums: np.ndarray, sizes: Sequence[int], sets: Sequence[tuple[int, ...]], level: int):
        self.sizes, self.sets, self.parts, at = sizes, sets, [], 0
        for one in sets:
            shape = [2, 2**level, *[sizes[c] for c in one]]
            self.parts.append(sums[at:at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)

    def columns(self, k: int, side: tuple[int, slice] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(gradients, slopes) as arrays (columns, bins); `side` takes only some bins of one column."""
        out = np.zeros((2, len(self.sizes), BINS))
        for c, size in enumerate(self.sizes):
            i = next(i for i, one in enumerate(self.sets) if c in one and (side is None or side[0] in one))
            part, axes = self.parts[i][:, k], list(self.sets[i])
            if side:
                kept = np.zeros(self.sizes[side[0]], bool)
                kept[side[1]] = True
                part = part * kept.reshape([-1 if a == side[0] else 1 for a in axes])
            out[:, c, :size] = part.sum(tuple(1 + j for j, a in enumerate(axes) if a != c))
        return out[0], out[1]


def grow(sums_of, sizes: np.ndarray, columns: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree: (feature, bin, weight of each leaf). `sums_of(level, feature, cut, sizes, sets)` gives the level_sums of all
    rows under the tree so far; bins and gradients stay where they are. Of few columns the histograms of pairs are asked
    for, and both sides of a node's cut are read off them: one pass over the rows for two levels."""
    inner = 2**s.depth - 1
    feature, cut = np.zeros(inner, np.int32), np.full(inner, BINS, np.int64)
    signs = np.array(s.signs or (0,) * len(sizes))[columns]
    low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
    weight = np.zeros(2 * inner + 1)
    own = [int(n) for n in np.asarray(sizes)[columns]]
    place = {int(c): i for i, c in enumerate(columns)}

    def split(at: int, g: np.ndarray, h: np.ndarray) -> None:
        if not at:
            weight[at] = -g[0].sum() / (h[0].sum() + s.ridge)
        gain, f, b, left, right = best_split(g, h, low[at], high[at], s, signs)
        weight[2 * at + 1] = weight[2 * at + 2] = weight[at]
        low[2 * at + 1:2 * at + 3], high[2 * at + 1:2 * at + 3] = low[at], high[at]
        if gain > 0:
            feature[at], cut[at] = columns[f], b
            weight[2 * at + 1], weight[2 * at + 2] = left, right
            if signs[f]:
                upper, lower = (2 * at + 1, 2 * at + 2) if signs[f] > 0 else (2 * at + 2, 2 * at + 1)
                high[upper] = low[lower] = (left + right) / 2

    level = 0
    while level < s.depth:
        paired = 1 < len(own) <= PAIRED and level + 1 < s.depth
        sets = together(own, 1 + paired)
        hist = Histograms(sums_of(level, feature, cut, own, sets), own, sets, level)
        for k in range(2**level):
            at = 2**level - 1 + k
            split(at, *hist.columns(k))
            if paired and cut[at] < BINS:
                f, b = place[int(feature[at])], int(cut[at])
                split(2 * at + 1, *hist.columns(k, (f, slice(0, b + 1))))
                split(2 * at + 2, *hist.columns(k, (f, slice(b + 1, None))))
            elif paired:  # no cut: all rows lie left, where there is none either
                for child in (2 * at + 1, 2 * at + 2):
                    weight[2 * child + 1:2 * child + 3] = weight[child]
                    low[2 * child + 1:2 * child + 3], high[2 * child + 1:2 * child + 3] = low[child], high[child]
        level += 1 + paired
    return feature, cut, weight[inner:]


def counts_and_edges(data: DataFrame, names: Sequence[str], label: str = "y") -> tuple[Row, list[np.ndarray]]:
    """(rows n and labels s, per feature at most BINS - 2 ascending cut points of like shares), one aggregation for all."""
    at = F.array(*[F.lit(i / (BINS - 1)) for i in range(1, BINS - 1)])
    cuts = [F.percentile_approx(F.col(n).cast("double"), at, F.lit(100 * BINS)).alias(f"e{i}") for i, n in enumerate(names)]
    row = data.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("s"), *cuts).first()
    return row, [np.unique(np.array(row[f"e{i}"] or [], float)) for i in range(len(names))]


def _columns(s: Settings, r: int, width: int) -> np.ndarray:
    return np.sort(np.random.default_rng([s.seed, r]).permutation(width)[:max(1, round(s.column_share * width))])


class Rows:
    """Rows of one task with their log odds so far. Which rows and columns a round sees follows from the seed, the round
    and the rows' keys, so it is the same however the rows are dealt to tasks."""

    def __init__(self, binned: np.ndarray, y: np.ndarray, keys: np.ndarray, base: float):
        self.binned, self.y, self.keys, self.odds = np.asfortranarray(binned), y.astype(np.uint8), keys, np.full(len(y), base)

    def begin(self, s: Settings, r: int) -> Rows:
        p = 1 / (1 + np.exp(-self.odds))
        self.g, self.h = p - self.y, p * (1 - p)
        if s.row_share < 1:
            x = self.keys ^ np.uint64(0x9E3779B97F4A7C15 * (s.seed + r + 1) & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            drawn = ((x ^ (x >> np.uint64(29))) >> np.uint64(11)) < np.uint64(int(s.row_share * (1 << 53)))
            self.g, self.h = self.g * drawn, self.h * drawn
        return self

    def node(self, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
        at = np.zeros(len(self.y), np.min_scalar_type(2**levels))
        for level in range(levels):
            at = step_down(at, level, feature, cut, lambda f, c: self.binned[:, f] > c, BINS)
        return at

    def end(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Rows:
        feature, cut, leaf = tree
        self.odds = self.odds + leaf[self.node(feature, cut, (len(feature) + 1).bit_length() - 1)]
        return self


def _boost(rows: Rows, sizes: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(feature, bin, leaf) of one tree after the other, from rows held here. `sizes` are the numbers of bins."""
    for r in range(s.rounds):
        columns = _columns(s, r, len(sizes))
        rows.begin(s, r)
        feature, cut, leaf = grow(lambda level, f, c, own, sets: level_sums(rows.binned, rows.node(f, c, level), rows.g, rows.h, columns, own, sets, level), sizes, columns, s)
        tree = feature, cut, s.step * leaf
        rows.end(tree)
        yield tree


def _boost_spread(blocks, sizes: np.ndarray, s: Settings, keep: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same trees from an RDD of Rows: one job a pass adds up the tasks' histograms. The odds move on with the rows,
    which are kept in the executors from round to round, as objects, since blocks are compressed and read anew in every
    pass; every `keep` rounds their lineage is cut."""
    held, last = [blocks], None
    for r in range(s.rounds):
        columns = _columns(s, r, len(sizes))
        now = held[-1].map(lambda rows, last=last: rows.end(last) if last else rows)
        now = now.persist(StorageLevel.MEMORY_AND_DISK_DESER)
        if r % keep == keep - 1:
            now.localCheckpoint()

        def sums_of(level: int, feature: np.ndarray, cut: np.ndarray, own: list[int], sets: list[tuple[int, ...]]) -> np.ndarray:
            f, c = feature.copy(), cut.copy()
            def mine(rows: Rows) -> np.ndarray:
                rows.begin(s, r)
                return level_sums(rows.binned, rows.node(f, c, level), rows.g, rows.h, columns, own, sets, level)

            return now.map(mine).reduce(np.add)

        feature, cut, leaf = grow(sums_of, sizes, columns, s)
        last = feature, cut, s.step * leaf
        yield last
        held.append(now)
        if len(held) > 2:
            held.pop(0).unpersist()
    for one in held:
        one.unpersist()


def _rows_of(batches: Iterator[pa.RecordBatch], edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (a byte's worth per feature), labels and keys of (x0, x1, ..., y, key)."""
    width = len(edges)
    parts, ys, keys = [np.zeros((0, width), np.uint8)], [np.zeros(0)], [np.zeros(0, np.int64)]
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width + 2)]
        parts.append(np.stack([np.where(np.isnan(c), 0, 1 + np.searchsorted(e, c, "right")) for c, e in zip(columns, edges)], 1).astype(np.uint8))
        ys.append(columns[width])
        keys.append(columns[width + 1])
    return np.concatenate(parts), np.concatenate(ys), np.concatenate(keys).view(np.uint64)


def fit(frame: DataFrame, names: Sequence[str], label: str, s: Settings, held: int = 2_000_000, workers: int | None = None) -> Trees:
    """Boosted trees for a 0/1 label, trained on all rows. Values are missing where null or NaN and go left; rows with a
    null label are left out.

    Up to `held` rows the driver fetches them, a few dozen bytes each, and grows the trees itself. Beyond, they are dealt
    to `workers` tasks (all cores, if not given) which keep them for all rounds; a job per pass adds up their histograms
    (nodes x features or pairs of them x bins, whatever the number of rows). A job takes about a tenth of a second, the
    exchange of a barrier stage a whole one. Samples follow the rows' own values, so both ways see the same rows; sums differ in
    rounding alone."""
    x = [f"x{i}" for i in range(len(names))]
    data = frame.filter(F.col(label).isNotNull()).select(*[F.col(n).cast("double").alias(c) for n, c in zip(names, x)], F.col(label).cast("double").alias("y"))
    data = data.withColumn("key", F.xxhash64(*x, "y"))
    counts, edges = counts_and_edges(data, x)
    share = ((counts["s"] or 0) + 0.5) / (counts["n"] + 1)
    base, sizes = math.log(share / (1 - share)), np.array([len(e) + 2 for e in edges])

    if counts["n"] <= held:
        trees = list(_boost(Rows(*_rows_of(data.toArrow().to_batches(), edges), base), sizes, s))
    else:
        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part: list[pa.RecordBatch] = []
            for batch in chain(batches, [None]):
                part += [batch] if batch is not None else []
                if sum(b.num_rows for b in part) >= (PIECE if batch is not None else 1):
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Rows(*_rows_of(iter(part), edges), base))], pa.binary())], names=["rows"])
                    part = []

        spark = frame.sparkSession
        dealt = data.repartition(workers or spark.sparkContext.defaultParallelism, "key")
        blocks = dealt.mapInArrow(packed, "rows binary").rdd.map(lambda r: pickle.loads(r["rows"])).persist(StorageLevel.MEMORY_AND_DISK_DESER)
        trees = list(_boost_spread(blocks, sizes, s))
    return thresholds(base, s.depth, trees, edges)


def thresholds(base: float, depth: int, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], edges: list[np.ndarray]) -> Trees:
    """Trees over values from trees over bins. Bin 0 holds missing values, bin b those from edges[b - 2] on and below
    edges[b - 1]; a cut after bin b sends values of edges[b - 1] and more to the right, after bin 0 all that there are."""
    limit = lambda f, b: np.finfo(float).min if not b else float(edges[f][b - 1]) if b <= len(edges[f]) else math.inf
    shaped = lambda rows, kind: np.array([list(r) for r in rows], kind).reshape(len(trees), -1)
    return Trees(base, depth, shaped([t[0] for t in trees], np.int32), shaped([[limit(f, b) for f, b in zip(t[0], t[1])] for t in trees], float), shaped([t[2] for t in trees], float))


def predict(model: Trees, features: Sequence[Column]) -> Column:
    """Probability of label 1; the trees travel with the task and score a batch at a time."""

    @F.pandas_udf(DoubleType())
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.probabilities(np.stack([c.to_numpy(dtype="float64", na_value=np.nan) for c in columns], 1)))

    return score(*[f.cast("double") for f in features])
