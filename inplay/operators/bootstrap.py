"""Resampling whole entities (games): every statistic is a function of weighted per-entity sums, so
rows are summed per entity first and only those sums meet the resample weights."""

from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, IntegralType, LongType, NumericType, StructField, StructType

from inplay.functions.hashing import PRIME, id_key, poisson_cdf, poisson_weights, uniform, uniforms
from inplay.operators.onerow import with_row
from inplay.session import all_cores

SEED = 2013  # fixed value
BUCKETS = 64  # shares in which entities are numbered for exact draws
MET = 20  # exact draws that meet their entities at once, as a power of two
BLOCK = 512  # entities whose weights are held at once
GROUPS_HELD = 1024  # groups whose replicates a task holds before it gives them on


def entity_sums(df: DataFrame, by: str, groups: Sequence[str] = (), **sums: Column) -> DataFrame:
    """One row per group and entity with the sum of each expression."""
    return df.groupBy(*groups, by).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def _numbered(stats: DataFrame, by: str, groups: Sequence[str]) -> DataFrame:
    """Entities numbered 1..G within their group, with G. They are numbered in shares of the key, up to BUCKETS on either
    side of 0 and one for entities without an id, which comes last; a share's first number is the sum of the shares before
    it, a few rows a group. Entities meet these rows where they were numbered, not in the driver."""
    key = id_key(F.col(by), isinstance(stats.schema[by].dataType, NumericType))
    stats = stats.withColumn("__b", F.coalesce(key % BUCKETS, F.lit(BUCKETS)).cast("bigint"))
    sizes = stats.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__k"))
    part = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    sizes = sizes.withColumns({"__before": F.sum("__k").over(part.orderBy("__b")) - F.col("__k"), "__g": F.sum("__k").over(part)}).drop("__k")
    placed = stats.withColumn("__i", F.row_number().over(Window.partitionBy(*groups, "__b").orderBy(by)))
    sizes = sizes.select(*[F.col(g).alias(f"__s{i}") for i, g in enumerate(groups)], F.col("__b").alias("__share"), "__before", "__g")
    same = [F.col(g).eqNullSafe(F.col(f"__s{i}")) for i, g in enumerate(groups)]
    both = placed.hint("merge").join(sizes, [F.col("__b") == F.col("__share"), *same]).drop("__share", *[f"__s{i}" for i in range(len(groups))])
    return both.withColumn("__i", (F.col("__before") + F.col("__i")).cast("bigint")).drop("__b", "__before")


def _reps(n_boot: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep")


def _picks(numbered: DataFrame, groups: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """One row per draw. The entities are few bytes that become n_boot rows each, so they are dealt to all cores first."""
    pick = F.floor(uniform(seed, F.col("__i"), F.col("rep")) * F.col("__g")) + 1
    dealt = numbered.select(*groups, "__i", "__g").repartition(all_cores(numbered.sparkSession), *groups, "__i")
    return dealt.select(*groups, "__i", "__g", _reps(n_boot)).select(*groups, "rep", pick.cast("bigint").alias("__i"))


def _draws(numbered: DataFrame, groups: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    return _picks(numbered, groups, n_boot, seed).groupBy(*groups, "rep", "__i").agg(F.count(F.lit(1)).alias("__w"))


class _Replicates:
    """Weighted sums of one group over all replicates, as far as one task has seen it. Row 0 is the weights' own sum."""

    def __init__(self, n_sums: int, n_boot: int):
        self.total = np.zeros((1 + n_sums, n_boot))
        self.seen: np.ndarray | None = None  # draws of non-null values; None: as many as draws

    def add(self, values: np.ndarray, w: np.ndarray) -> None:
        missing = np.isnan(values)
        if self.seen is None and missing.any():
            self.seen = np.repeat(self.total[:1], len(self.total) - 1, 0)
        if self.seen is not None:
            self.seen += (~missing).T.astype(float) @ w
        self.total[0] += w.sum(0)
        values = np.where(missing, 0.0, values)
        if np.isfinite(values).all():
            self.total[1:] += values.T @ w
        else:  # an infinite sum counts where it is drawn only
            for i, column in enumerate(values.T, 1):
                self.total[i] += np.where(w > 0, column[:, None] * np.where(w > 0, w, 1), 0).sum(0)


def _block_codes(part: pa.RecordBatch, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's group within the block, a row of each group)."""
    code = np.zeros(part.num_rows, np.int64)
    for i in range(n_groups):
        one = part.column(i).dictionary_encode(null_encoding="encode")
        code = np.unique(code * (len(one.dictionary) + 1) + np.asarray(one.indices), return_inverse=True)[1]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def _replicate_rows(held: dict[tuple, _Replicates], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in held], t) for i, t in enumerate(types)]
    some = list(held.values())
    n_boot = some[0].total.shape[1]
    offsets = np.arange(len(some) + 1, dtype=np.int32) * n_boot
    for i in range(len(some[0].total)):
        flat = np.concatenate([r.total[i] for r in some])
        none = np.concatenate([np.zeros(n_boot, bool) if r.seen is None or not i else r.seen[i - 1] == 0 for r in some])
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, mask=none)))
    return pa.RecordBatch.from_arrays(columns, names=names)


def _poisson(stats: DataFrame, by: str, sums: Sequence[str], n_boot: int, groups: list[str], seed: int) -> DataFrame:
    """Replicates as a blocked product: a task multiplies its block of per-entity sums (entities x sums) with the
    entities' weights (entities x replicates), both made where the rows lie. What it gives on is one array of
    replicates per group and sum; entities x replicates never become rows. Entities without an id are not drawn."""
    numeric = isinstance(stats.schema[by].dataType, NumericType)
    key = F.pmod(id_key(F.col(by), numeric), F.lit(PRIME)).alias("__key")
    narrow = stats.filter(F.col(by).isNotNull()).select(*groups, key, *[F.col(c).cast("double").alias(c) for c in sums])
    lists = [StructField(c, ArrayType(DoubleType())) for c in ("__w", *sums)]
    schema = StructType([*[stats.schema[g] for g in groups], *lists])
    n_groups, names = len(groups), [f.name for f in schema]

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _Replicates] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(n_groups)]
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids, where = np.unique(np.asarray(part.column(n_groups)), return_inverse=True)
                w = poisson_weights(seed, ids, n_boot).astype(float)
                values = np.stack([part.column(n_groups + 1 + i).to_numpy(zero_copy_only=False) for i in range(len(sums))], 1)
                code, first = _block_codes(part, n_groups)
                labels = list(zip(*[part.column(i).take(pa.array(first)).to_pylist() for i in range(n_groups)])) or [()]
                order, ends = np.argsort(code, kind="stable"), np.cumsum(np.bincount(code, minlength=len(first)))
                for label, rows in zip(labels, np.split(order, ends[:-1])):
                    held.setdefault(label, _Replicates(len(sums), n_boot)).add(values[rows], w[where[rows]])
                if len(held) > GROUPS_HELD:
                    yield _replicate_rows(held, types, names)
                    held = {}
        if held:
            yield _replicate_rows(held, types, names)

    arrays = narrow.mapInArrow(product, schema)
    each = arrays.select(*groups, F.posexplode(F.arrays_zip("__w", *sums)).alias("rep", "__r")).select(*groups, "rep", "__r.*")
    whole = [c for c in sums if isinstance(stats.schema[c].dataType, IntegralType)]
    total = {c: F.round(F.sum(c)).cast("bigint") if c in whole else F.sum(c) for c in sums}
    return each.groupBy(*groups, "rep").agg(F.sum("__w").alias("__w"), *[e.alias(c) for c, e in total.items()]).filter("__w > 0").drop("__w")


def _multinomial(stats: DataFrame, by: str, sums: Sequence[str], n_boot: int, groups: list[str], seed: int) -> DataFrame:
    """Replicates of exact draws. A draw is 4 or 8 bytes, packed by the block of entities it falls into; a block's
    draws and its entities meet in one task, which gives on one array of replicates per sum. Neither entities nor draws
    pass through the driver, and draws never become rows. Sums of whole numbers stay whole, others are doubles."""
    bits = max(MET - (n_boot - 1).bit_length(), 0)
    size, code = 1 << bits, np.dtype("<u4" if n_boot << bits <= 1 << 32 else "<u8")
    n_groups, n_cores = len(groups), all_cores(stats.sparkSession)
    keys = [stats.schema[g] for g in groups]
    block = StructField("__block", LongType())
    whole = [isinstance(stats.schema[c].dataType, IntegralType) for c in sums]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (g, start) in enumerate(zip(batch.column(n_groups).to_pylist(), batch.column(n_groups + 1).to_pylist())):
                places = np.arange(start, min(start + BLOCK, g + 1))
                pick = np.floor(uniforms(seed, places, n_boot) * g).astype(np.int64)
                codes = ((np.arange(n_boot) << bits) + (pick & (size - 1))).astype(code).ravel()
                blocks = (pick >> bits).astype(np.uint16 if g >> bits < 1 << 16 else np.int64).ravel()
                order = np.argsort(blocks, kind="stable")
                some, first = np.unique(blocks[order], return_index=True)
                packed = [c.tobytes() for c in np.split(codes[order], first[1:])]
                own = [batch.column(i).take(pa.array([row] * len(some))) for i in range(n_groups)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(some.astype(np.int64)), pa.array(packed, pa.binary())], names=[*groups, "__block", "__codes"])

    def meet(key: tuple, drawn: pa.Table, rows: pa.Table) -> pa.Table:
        codes = np.frombuffer(b"".join(drawn.column("__codes").to_pylist()), code)
        rep, at = (codes >> code.type(bits)).astype(np.int64), (codes & code.type(size - 1)).astype(np.int64)
        place = rows.column("__at").to_numpy()
        columns = [pa.array([k.as_py()], drawn.schema.field(i).type) for i, k in enumerate(key[:-1])]
        for c, is_whole in zip(sums, whole):
            column = rows.column(c)
            value, there = np.zeros(size, np.int64 if is_whole else float), np.zeros(size, bool)
            value[place], there[place] = column.fill_null(0).to_numpy(), column.is_valid().to_numpy()
            total = np.zeros(n_boot, value.dtype)
            np.add.at(total, rep, value[at])
            none = np.bincount(rep[there[at]], minlength=n_boot) == 0
            columns.append(pa.ListArray.from_arrays(pa.array([0, n_boot], pa.int32()), pa.array(total, mask=none)))
        return pa.Table.from_arrays(columns, names=[*groups, *sums])

    sizes = stats.groupBy(*groups).agg(F.count(F.lit(1)).alias("__g")).filter("__g > 0")
    pieces = sizes.select(*groups, "__g", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__g"), F.lit(BLOCK).cast("bigint"))).alias("__from"))
    drawn = pieces.repartition(n_cores, *groups, "__from").mapInArrow(draw, StructType([*keys, block, StructField("__codes", BinaryType())]))
    i = F.col("__i") - 1
    rows = _numbered(stats, by, groups).select(*groups, F.shiftright(i, bits).alias("__block"), i.bitwiseAND(F.lit(size - 1).cast("bigint")).alias("__at"),
                                               *[F.col(c).cast("bigint" if w else "double").alias(c) for c, w in zip(sums, whole)])
    lists = [StructField(c, ArrayType(LongType() if w else DoubleType())) for c, w in zip(sums, whole)]
    met = drawn.groupBy(*groups, "__block").cogroup(rows.groupBy(*groups, "__block")).applyInArrow(meet, StructType([*keys, *lists]))
    each = met.select(*groups, F.posexplode(F.arrays_zip(*sums)).alias("rep", "__r")).select(*groups, "rep", "__r.*")
    return each.groupBy(*groups, "rep").agg(*[F.sum(c).alias(c) for c in sums])


def resample(stats: DataFrame, by: str, sums: Sequence[str], n_boot: int, groups: Sequence[str] = (),
             seed: int = SEED, method: str = "poisson") -> DataFrame:
    """Weighted sums per replicate: (groups, rep, sums...).

    poisson      an independent Poisson(1) count per entity from its id and the replicate's number, made where
                 the entity lies: no draw table, no join, no row per draw; only (groups x replicates) partial sums
                 are shuffled, and every group and statistic meets the same draws
    multinomial  every replicate draws as many entities as the group has, with replacement
    """
    groups = list(groups)
    if method == "poisson":
        return _poisson(stats, by, sums, n_boot, groups, seed)
    if method != "multinomial":
        raise ValueError(f"no method {method}")
    return _multinomial(stats, by, sums, n_boot, groups, seed)


def weights(rows: DataFrame, by: str, n_boot: int, seed: int = SEED, method: str = "poisson") -> DataFrame:
    """(rep, entity, w): how often each replicate draws each entity (drawn entities only). A list of the draws for those
    who want to see them; resample() needs none."""
    ids = rows.select(by).distinct()
    if method == "poisson":
        key = F.pmod(id_key(F.col(by), isinstance(rows.schema[by].dataType, NumericType)), F.lit(PRIME))

        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    w = poisson_weights(seed, np.asarray(part.column(1)), n_boot)
                    row, rep = np.nonzero(w)
                    yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int32()), part.column(0).take(pa.array(row)), pa.array(w[row, rep])], names=["rep", by, "w"])

        schema = StructType([StructField("rep", IntegerType()), rows.schema[by], StructField("w", LongType())])
        return ids.filter(F.col(by).isNotNull()).select(by, key.alias("__key")).mapInArrow(drawn, schema)
    numbered = _numbered(ids, by, [])
    return _draws(numbered, [], n_boot, seed).join(numbered.select("__i", by), "__i").select(
        "rep", by, F.col("__w").alias("w"))


def spread(replicates: DataFrame, groups: Sequence[str] = (), **stats: Column) -> DataFrame:
    """sd (sample), mean and 90% interval of each statistic over the replicates (n_boot rows a group)."""
    aggs = []
    for name, c in stats.items():
        aggs += [F.stddev_samp(c).alias(f"{name}_sd"), F.avg(c).alias(f"{name}_mean"),
                 F.percentile(c, F.lit(0.05)).alias(f"{name}_p05"), F.percentile(c, F.lit(0.95)).alias(f"{name}_p95")]
    return replicates.groupBy(*groups).agg(*aggs)


def interval(df: DataFrame, value: Column, by: str = "game_id", groups: Sequence[str] = (),
             weight: Column | None = None, n_boot: int = 1000, seed: int = SEED,
             method: str = "poisson") -> DataFrame:
    """Weighted mean of value with a 90% interval from resampling entities: mean, p05, p95, rows, games."""
    w = F.lit(1.0) if weight is None else weight
    stats = entity_sums(df, by, groups, sw=w.cast("double"), sx=(w * value).cast("double"), n=F.lit(1))
    total = stats.groupBy(*groups).agg((F.sum("sx") / F.sum("sw")).alias("mean"), F.sum("n").alias("rows"),
                                       F.count(F.lit(1)).alias("games"))
    draws = resample(stats, by, ["sw", "sx"], n_boot, groups, seed, method)
    band = draws.groupBy(*groups).agg(
        F.percentile(F.col("sx") / F.col("sw"), F.lit(0.05)).alias("p05"),
        F.percentile(F.col("sx") / F.col("sw"), F.lit(0.95)).alias("p95"))
    return total.join(band, list(groups)) if groups else total.transform(with_row, band)
