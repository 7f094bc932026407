"""Document fingerprints from closed syncmers over words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inplay.llm.ordering import cut_points, range_bucket

#: A word, or one character of a script that is written without spaces.
UNIT = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[^\s\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]+"


def unit_hashes(text: Column) -> Column:
    """One 64-bit hash per word of the text (null: none)."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0)), lambda w: F.xxhash64(w))


def with_syncmers(df: DataFrame, text: Column, name: str, k: int = 4, s: int = 2) -> DataFrame:
    """Add `name`: array<struct<pos int, hash bigint>>, the text's closed syncmers in order.

    A k-mer is k successive words; it is kept if the least hash among its k - s + 1 inner s-mers lies at its
    first or its last place. Whether it is kept depends on its own words alone, so the same passage gives the
    same anchors in any document. A text of 1 to k - 1 words has one anchor, the hash of all its words; a
    text without words has none."""
    if not 1 <= s < k:
        raise ValueError("1 <= s < k")
    units, inner = f"{name}__units", f"{name}__inner"
    df = df.withColumn(units, unit_hashes(text))
    h = F.col(units)
    # The array is named once outside each lambda and once per place inside; Spark reads it from a column, not anew.
    df = df.withColumn(inner, F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (s - 1), F.lit(0))),
                                          lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, s)])))
    m, last = F.col(inner), k - s

    def anchor(x: Column, i: Column) -> Column:
        inside = [F.get(m, i + j) for j in range(1, last)]
        edge = F.least(x, F.get(m, i + last))
        closed = reduce(lambda a, b: a & b, [edge <= v for v in inside], F.lit(True))
        return F.when(closed, F.struct(i.cast("int").alias("pos"), F.xxhash64(x, F.get(m, i + last), *[F.get(m, i + j) for j in range(s, last, s)]).alias("hash")))

    whole = F.when(F.size(h) > 0, F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(F.lit(k), h).alias("hash")))).otherwise(
        F.array().cast("array<struct<pos:int,hash:bigint>>"))
    marks = F.transform(F.slice(m, F.lit(1), F.greatest(F.size(m) - last, F.lit(0))), anchor)
    return df.withColumn(name, F.when(F.size(h) >= k, F.array_compact(marks)).otherwise(whole)).drop(units, inner)


def sketch(anchors: Column, size: int = 64) -> Column:
    """The `size` least different anchor hashes (48 bits each), ascending: equal sets give equal sketches."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(anchors, lambda a: F.shiftrightunsigned(a["hash"], 16)))), 1, size)


def printed(values: Column) -> Column:
    """The sketch as one string: 12 hexadecimal digits per hash, lower case."""
    return F.lower(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 12, "0")), ""))


def likeness(a: Column, b: Column, size: int = 64) -> Column:
    """Jaccard similarity of two anchor sets estimated from their sketches: the share of the `size` least
    hashes of the union that both hold. Exact while the union has no more than `size`. Two empty: 1."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def fingerprints(df: DataFrame, text: str = "text", k: int = 4, s: int = 2, size: int = 64) -> DataFrame:
    """Add `anchors` (see with_syncmers) and `sketch` array<bigint> of the `size` least anchor hashes."""
    return with_syncmers(df, F.col(text), "anchors", k, s).withColumn("sketch", sketch(F.col("anchors"), size))


def edit_check(docs: DataFrame, k: int = 4, s: int = 2, size: int = 64, buckets: int | None = None) -> DataFrame:
    """How the fingerprints hold against an edit: for each (doc_id, text) the fingerprint of the text and of an
    edited text, whose last quarter (floor(n/4) code points) gives way to the first as many of the next document
    in ascending doc_id (after the last: the first), and the likeness to the edited text and to the next document.

    Null text is empty. Rows of one doc_id follow each other in the order of their texts' hash; null ids come
    first. A lone document is its own successor; an empty table gives none. Other columns are ignored.

    Documents are dealt into ranges of doc_id (cut points from one aggregate). Only the first row of each range
    goes to another range, as the successor of the last row before it."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = cut_points(docs, "doc_id", buckets)
    ranged = docs.withColumn("bucket", range_bucket(F.col("doc_id"), cuts)).withColumn("tie", F.xxhash64("text"))

    heads = ranged.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("head"), F.min_by("text", F.struct("doc_id", "tie")).alias("text"))
    # One row per range, so this order of ranges is as small as the list of cut points.
    order = W.partitionBy(F.lit(0)).orderBy("bucket")
    ids = ranged.select("bucket").distinct().withColumn("after", F.coalesce(
        F.lead("bucket").over(order), F.first("bucket").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    heads = heads.select(F.col("bucket").alias("after"), F.col("text").alias("head_text"))
    heads = fingerprints(heads, "head_text", k, s, size).select("after", "head_text", F.col("sketch").alias("head_sketch"))
    heads = ids.join(heads, "after").select("bucket", "head_text", "head_sketch")

    each = fingerprints(ranged.repartition("bucket"), "text", k, s, size).drop("anchors")
    mine = W.partitionBy("bucket").orderBy("doc_id", "tie")
    each = each.withColumn("next_text", F.lead("text").over(mine)).withColumn("next_sketch", F.lead("sketch").over(mine))
    each = each.join(heads, "bucket", "left").select(
        "doc_id", "text", "sketch", F.char_length("text").cast("long").alias("n_chars"),
        F.when(F.col("next_sketch").isNull(), F.col("head_text")).otherwise(F.col("next_text")).alias("next_text"),
        F.coalesce("next_sketch", "head_sketch").alias("next_sketch"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    each = each.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - cut), F.left("next_text", cut)))
    each = each.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "edited")
    each = with_syncmers(each, F.col("edited"), "anchors", k, s).withColumn("edited_sketch", sketch(F.col("anchors"), size))
    return each.select("doc_id", "n_chars", "edited_sha256", printed(F.col("sketch")).alias("fingerprint"), printed(F.col("edited_sketch")).alias("edited_fingerprint"),
                       likeness(F.col("sketch"), F.col("edited_sketch"), size).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch"), size).alias("near_next"))
