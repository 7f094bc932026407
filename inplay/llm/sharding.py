"""Uniform random sharding with exact shard sizes, by a hypergeometric communication matrix."""

from __future__ import annotations

import json
import math
import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inplay.llm.storage import keep


def hypergeometric(rng: random.Random, drawn: int, good: int, bad: int) -> int:
    """How many of `drawn` balls, taken without replacement from `good` + `bad`, are good: an exact draw by
    inversion, searched outwards from the mode (log-gamma gives the mode's probability; the neighbours
    follow by ratios), so that the number of steps is of the order of the standard deviation."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    start = math.exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    u = rng.random() - start
    if u <= 0:
        return mode
    up, down, p_up, p_down = mode, mode, start, start
    while up < high or down > low:
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Entry [p][s]: how many rows source partition p sends to shard s. Row sums are the partitions' counts,
    column sums the exact shard sizes (which differ by one at most); the law is that of a uniform shuffle."""
    rng, total = random.Random(seed), sum(rows)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in rows:
        line, need, pool = [], n, sum(left)
        for s in range(shards):
            k = hypergeometric(rng, need, left[s], pool - left[s])
            pool -= left[s]
            need -= k
            line.append(k)
        left = [a - k for a, k in zip(left, line)]
        matrix.append(line)
    return matrix


def hypergeometric_shards(df: DataFrame, shards: int = 8, seed: int = 0, max_sources: int = 4096, block_rows: int = 100_000) -> DataFrame:
    """Deal all rows of `df` into shards 0 .. shards-1 by a uniform shuffle; adds `shard` int and `slot` long,
    a random order within the shard, gapless from 0. Shard sizes are exact: they differ by one at most.

    Steps: (1) rows get their source partition and place in it, and are kept in the shared folder; (2) counts
    per source come to the driver (`max_sources` numbers at most, runs of neighbouring partitions share one)
    and the matrix is drawn; (3) each source permutes the places of its rows by a draw, and the matrix row says which
    stretch goes where: a stretch ends at a draw, so a source is described by one threshold per shard; (4) rows are
    exchanged by shard and block and permuted again. A shard is numbered in blocks of about `block_rows` rows, so that no
    task holds a whole shard. Steps 2 and 3 read places alone; what the rows hold moves once, in step 4.

    What rows hold decides nothing, so repeated rows, null ids and hot keys spread like others. Columns of any
    name pass through; former columns `shard` and `slot` give way to the new ones. An empty table gives an empty
    result. `seed` and the layout of the input fix the result."""
    df = df.drop("shard", "slot")
    # Working columns lie in one struct beside the row, so no name of the input can meet theirs.
    placed = keep(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row") if df.columns else F.struct(F.lit(1)).alias("row"),
                            F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "placed")
    parts = (placed.agg(F.max("part")).first()[0] or 0) + 1
    sources = min(parts, max_sources)
    source = F.floor(F.col("part") * sources / parts).cast("int").alias("source")
    counts = {r["source"]: r["count"] for r in placed.groupBy(source).count().collect()}
    sizes = [counts.get(p, 0) for p in range(sources)]
    ends = [list(accumulate(line)) for line in communication_matrix(sizes, shards, seed)]  # of each shard's stretch in a permuted source

    drawn = F.struct(F.xxhash64(F.lit(seed), F.lit("source"), "place").alias("draw"), F.col("place"))
    ranked = placed.select(source, drawn.alias("at")).withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy("at")) - 1)
    stops = ranked.filter(F.array_contains(F.get(_table(ends), F.col("source")), F.col("rank").cast("bigint"))).collect()  # sources x shards at most
    at_rank = {(r["source"], r["rank"]): (r["at"]["draw"], r["at"]["place"]) for r in stops}
    limits = [[at_rank[p, e] for e in line if e < sizes[p]] for p, line in enumerate(ends)]
    limit = F.get(_table([[{"draw": d, "place": q} for d, q in line] for line in limits], "array<array<struct<draw: bigint, place: bigint>>>"), F.col("source"))
    sent = placed.select("row", "place", source, drawn.alias("at")).withColumn("shard", F.size(F.filter(limit, lambda e: e <= F.col("at"))))

    blocks = max(1, math.ceil(sum(sizes) / shards / block_rows))
    draw = F.xxhash64(F.lit(seed), F.lit("shard"), "place")
    sent = sent.withColumn("draw", draw).withColumn("block", F.pmod(draw, F.lit(blocks)).cast("int"))
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    base = sent.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = W.partitionBy("shard", "block").orderBy(F.shiftrightunsigned("draw", 8), "draw", "place")
    out = sent.withColumn("rank", F.row_number().over(inner) - 1).join(base, ["shard", "block"])
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns], F.col("shard").cast("int"), (F.col("base") + F.col("rank")).cast("long").alias("slot"))


def _table(rows: list, kind: str = "array<array<bigint>>") -> Column:
    return F.from_json(F.lit(json.dumps(rows)), kind)
