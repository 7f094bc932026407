"""Exact Jaccard join of documents on word n-grams, as a blocked sparse matrix product with size bounds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from inplay.llm.components import components
from inplay.llm.storage import discard, keep
from inplay.llm.textscan import mix, sequence_hash, shingle_hashes, slices, word_hashes

SLOTS = 20  # bits of the table of frequent n-grams


def gram_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Per text the ascending hashes of its distinct n-grams; of a shorter text the whole sequence as one; of a
    text without words none."""
    words, first = word_hashes(data, offsets)
    grams = shingle_hashes(words, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            yield np.unique(grams[a:b - size + 1])
        elif b > a:
            yield np.array([sequence_hash(words[a:b])])
        else:
            yield np.zeros(0, np.uint64)


def set_hash(grams: np.ndarray) -> int:
    """One 64-bit hash of a set; with its size it names the set."""
    total = np.array([np.bitwise_xor.reduce(mix(grams + np.uint64(0x9E3779B97F4A7C15))), mix(grams).sum(dtype=np.uint64)], np.uint64)
    return int(mix(total[:1] * np.uint64(0xD1342543DE82EF95) + total[1:])[0].view(np.int64))


def ordered(grams: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """n-grams as keys whose order is the same in all documents: rare ones first, then by hash."""
    return np.sort((weight[grams >> np.uint64(64 - SLOTS)].astype(np.uint64) << np.uint64(58)) | (grams & np.uint64((1 << 58) - 1)))


def jaccard_join(docs: DataFrame, size: int = 5, percent: int = 75, carry: Sequence[str] = ()) -> DataFrame:
    """Link documents (doc_id, text) whose sets of `size`-word n-grams have a Jaccard similarity of `percent` or
    more: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included), `set_id` (equal for
    equal sets), `class_id` (equal for linked sets; null without words) and the columns named in `carry`, one row per
    row of `docs`. Words are runs of non-space bytes, A-Z in lower case.

    The product of the document by n-gram matrix with its transpose, in blocks of one n-gram, without what cannot
    count. (1) Equal sets are one row of the matrix. (2) A document enters with its first n - ceil(p n) + 1 n-grams in
    one order of all n-grams: two sets that are similar enough must meet there. The order puts n-grams that are
    frequent anywhere last, by a fixed-size table of counts over all documents; it changes the work, not the result.
    (3) An entry knows its place in that order. Where two documents first meet, at places i and j, they share
    min(n - i, m - j) n-grams at most, so a pair that falls short of the size-derived bound there is never made; as rare
    n-grams come first, a document with many n-grams of its own hardly meets anyone. (4) First product: each block
    pairs its documents with the one that has the n-gram earliest among those of like size, so a group of g near
    copies costs g entries, not g^2; each document's two pairs that meet most often are verified and become components.
    (5) Second product: the pairs of each block that lie in different components, whose sizes allow a link, whose places
    keep the bound, and that have enough entries in common blocks left from there on to overlap as much as prefixes of linked sets
    must: a document with few of these meets no one of its size, however often chance repeats an n-gram. (6) What is left is compared on whole sets. The first product may miss links; the second misses none
    between different components: the n-gram at which a linked pair first meets passes the bound. Pairs that pass have their
    prefixes' overlap counted, and are dropped when count and unseen rest fall short of the size-derived bound. So
    components are exact; links inside one are not listed.

    Null text is empty; empty documents are linked with nothing and are their own component. A null id takes part and
    is never the smallest id (component_id is null where no document of the component has one). Repeated ids and rows are
    allowed; an empty table gives no rows; columns not named in `carry` are ignored."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOTS, np.int64)
        for batch in rows:
            for _, data, offsets in slices(batch, "text"):
                grams = np.concatenate(list(gram_sets(data, offsets, size)))
                total += np.bincount((grams >> np.uint64(64 - SLOTS)).astype(np.int64), minlength=1 << SLOTS)
        # Slots beyond what chance gives a task; the result orders n-grams only, so a slot missed here costs time alone.
        often = np.flatnonzero(total > 8 + 3 * total.mean())
        yield pa.RecordBatch.from_arrays([pa.array(often, pa.int32()), pa.array(total[often], pa.int64())], names=["slot", "n"])

    weight = np.zeros(1 << SLOTS, np.uint8)
    for r in docs.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():  # 2^SLOTS rows at most
        weight[r["slot"]] = min(63, int(r["n"]).bit_length())

    def name(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part, data, offsets in slices(batch, "text"):
                sets = list(gram_sets(data, offsets, size))
                rest = part.drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) for s in sets], pa.int64())],
                                                 names=[*rest.schema.names, "__n", "__s"])

    def enter(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()  # a task sends each set once
        for batch in rows:
            for _, data, offsets in slices(batch, "text"):
                keys, ns, ids = [], [], []
                for s in gram_sets(data, offsets, size):
                    i = set_hash(s) if len(s) else 0
                    if len(s) and (len(s), i) not in met:
                        met.add((len(s), i))
                        keys.append(ordered(s, weight)[:len(s) - -(-percent * len(s) // 100) + 1])
                        ns.append(len(s))
                        ids.append(i)
                sizes = np.array([len(k) for k in keys], np.int64)
                places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)), pa.array(np.repeat(np.array(ns, np.int32), sizes)),
                    pa.array(np.repeat(np.array(ids, np.int64), sizes)), pa.array(places.astype(np.int32))], names=["key", "n", "s", "i"])

    fields = [f for f in docs.schema.fields if f.name != "text"]
    named = docs.mapInArrow(name, T.StructType([*fields, T.StructField("__n", T.LongType()), T.StructField("__s", T.LongType())]))
    named = keep(named.select("doc_id", F.col("__n").alias("n"), F.col("__s").alias("s"), *carry), "named")
    vertex = keep(named.filter("n > 0").groupBy("n", "s").agg(F.min("doc_id").alias("id")), "vertices")

    # One exchange by n-gram; the windows share it. Copies of a set meet as equal rows and only mark each other.
    block, like = W.partitionBy("key"), W.partitionBy("key", "class")
    entry = docs.select("text").mapInArrow(enter, "key long, n int, s long, i int").withColumn("class", F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int"))
    entry = entry.repartition("key")
    me, first = F.struct("n", "s"), F.struct("i", "n", "s")
    entry = entry.withColumn("low", F.min(me).over(block)).withColumn("high", F.max(me).over(block)).filter("low <> high")
    entry = keep(entry.withColumn("hub", F.min(first).over(like)).select("key", "n", "s", "i", "hub").distinct(), "entries")

    def reach(an: Column, ai: Column, bn: Column, bi: Column) -> Column:
        """Whether sets of these sizes that first meet at these places may be similar enough."""
        return (100 + percent) * F.least(an - ai, bn - bi) >= percent * (an + bn)

    def verify(pairs: DataFrame) -> DataFrame:
        """(an, as, bn, bs) -> those that are similar enough, compared on whole sets."""
        wanted = pairs.selectExpr("an n", "as s").union(pairs.selectExpr("bn", "bs")).distinct()
        # A filter of fixed size (2 MB) keeps texts that no pair needs out of the exchange; what it lets through wrongly finds no pair.
        words = wanted.select(F.pmod("s", F.lit(1 << 24)).alias("h")).groupBy(F.expr("h div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(h % 64))")).alias("bits")).toLocalIterator()
        bits = np.zeros(1 << 18, np.uint64)
        for r in words:
            bits[r["w"]] = np.int64(r["bits"]).view(np.uint64)

        def load(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: set[tuple[int, int]] = set()
            for batch in rows:
                for _, data, offsets in slices(batch, "text"):
                    ns, ids, sets = [], [], []
                    for s in gram_sets(data, offsets, size):
                        if len(s):
                            i = set_hash(s)
                            h = i % (1 << 24)
                            if int(bits[h >> 6]) >> (h & 63) & 1 and (len(s), i) not in met:
                                met.add((len(s), i))
                                ns.append(len(s))
                                ids.append(i)
                                sets.append(s.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(ns, pa.int32()), pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["n", "s", "grams"])

        sets = docs.select("text").mapInArrow(load, "n int, s long, grams binary").join(wanted, ["n", "s"], "left_semi")
        sets = keep(sets.groupBy("n", "s").agg(F.first("grams").alias("grams")), "sets")

        def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                good = []
                for r in range(batch.num_rows):
                    a, b = (np.frombuffer(batch.column(c)[r].as_py(), np.uint64) for c in ("ga", "gb"))
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    good.append(100 * both >= percent * (len(a) + len(b) - both))
                yield batch.select(["an", "as", "bn", "bs"]).filter(pa.array(good, pa.bool_()))

        full = pairs.join(sets.selectExpr("n an", "s as", "grams ga"), ["an", "as"]).join(sets.selectExpr("n bn", "s bs", "grams gb"), ["bn", "bs"])
        found = keep(full.select("an", "as", "bn", "bs", "ga", "gb").mapInArrow(compare, "an int, as long, bn int, bs long"), "links")
        discard(sets)
        return found

    hub = F.col("hub")
    star = entry.filter((F.col("n") != hub["n"]) | (F.col("s") != hub["s"]))
    star = star.groupBy(hub["n"].alias("hn"), hub["s"].alias("hs"), "n", "s").agg(
        F.count(F.lit(1)).alias("met"), F.max(reach(F.col("n"), F.col("i"), hub["n"], hub["i"])).alias("near"))
    # A hub's count is a part of the overlap, taken four times here; what the prefixes do not show adds the rest at most.
    unseen = F.ceil(F.least("n", "hn") * percent / 100) - 1
    star = star.filter(F.col("near") & ((4 * F.col("met") + unseen) * (100 + percent) >= percent * (F.col("n") + F.col("hn"))))
    # Blocks of one group may have different hubs; the two that a document meets most often will do.
    star = star.withColumn("best", F.row_number().over(W.partitionBy("n", "s").orderBy(F.desc("met"), "hn", "hs"))).filter("best <= 2")
    a, b = F.least(F.struct(F.col("hn").alias("n"), F.col("hs").alias("s")), me), F.greatest(F.struct(F.col("hn").alias("n"), F.col("hs").alias("s")), me)
    star = keep(star.select(a["n"].alias("an"), a["s"].alias("as"), b["n"].alias("bn"), b["s"].alias("bs")).distinct(), "stars")
    links = verify(star)
    linked = links.selectExpr("as a", "bs b")

    def with_class(links: DataFrame) -> DataFrame:
        """Every set with the class it is linked into: a set's hash stands for it."""
        group = components(links).select(F.col("id").alias("s"), "component")
        return vertex.join(group, "s", "left").select("n", "s", "id", F.coalesce("component", "s").alias("component"))

    member = keep(with_class(linked).select(F.col("n").cast("int").alias("n"), "s", "component"), "members")
    rest = entry.drop("hub").join(member, ["n", "s"]).repartition("key")
    rest = rest.withColumn("one", F.min("component").over(block)).withColumn("other", F.max("component").over(block)).filter("one <> other").drop("one", "other")
    rest = rest.withColumn("left", F.row_number().over(W.partitionBy("n", "s").orderBy(F.desc("i"))))  # a set's entries from this one on
    rest = keep(rest, "entries")
    discard(entry)
    a, b = (rest.select("key", *[F.col(c).alias(f"{x}{c[0]}") for c in ("n", "s", "component", "i", "left")]) for x in "ab")
    a = a.filter((100 + percent) * (F.col("an") - F.col("ai")) >= 2 * percent * F.col("an"))  # the smaller set must come early even for its own size
    # What two prefixes share is at most what both sets have left where they first meet; the rest of the document whose prefix
    # ends first is the most that can follow.
    unseen = F.ceil(F.greatest("an", "bn") * percent / 100) - 1
    enough = lambda shared: (shared + unseen) * (100 + percent) >= percent * (F.col("an") + F.col("bn"))
    met = a.join(b, "key").filter((F.struct("an", "as") < F.struct("bn", "bs")) & (F.col("ac") != F.col("bc")) & (100 * F.col("an") >= percent * F.col("bn"))
                                  & reach(F.col("an"), F.col("ai"), F.col("bn"), F.col("bi")) & enough(F.least("al", "bl")))
    pairs = keep(met.select("an", "as", "bn", "bs").distinct().join(star, ["an", "as", "bn", "bs"], "left_anti"), "pairs")
    counted = pairs.join(rest.selectExpr("n an", "s as", "key"), ["an", "as"]).join(rest.selectExpr("n bn", "s bs", "key"), ["bn", "bs", "key"])
    counted = counted.groupBy("an", "as", "bn", "bs").agg(F.count(F.lit(1)).alias("met")).filter(enough(F.col("met")))
    full = keep(counted.select("an", "as", "bn", "bs"), "pairs")
    discard(pairs)
    discard(rest)
    member = keep(with_class(linked.union(verify(full).selectExpr("as a", "bs b"))).withColumnRenamed("component", "class_id"), "members")
    least = member.groupBy("class_id").agg(F.min("id").alias("component_id"))
    final = keep(member.join(least, "class_id").select("n", "s", "class_id", "component_id"), "final")
    out = named.join(final, ["n", "s"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("s").alias("set_id"), "class_id", *carry)
