"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inplay.llm.storage import discard, keep


def components(links: DataFrame) -> DataFrame:
    """(a, b) longs -> (id, component): the smallest id that links reach, for every id that has a link.

    Alternating stars: every node hangs its larger neighbours, then its smaller ones, on the smallest; the number of
    rounds grows with the logarithm of the longest chain. Each round is two group-bys and joins, written to the
    shared folder; nothing but three totals comes to the driver."""
    edges = keep(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = keep(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).filter("a <> b")
        old, edges = edges, keep(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(old)
        discard(large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
