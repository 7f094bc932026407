"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. run() writes every stage's rows as
Parquet to the shared folder and reads them back, so a lost executor costs one stage at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inplay.llm import chunks, decontaminate, jaccard, packing, quality
from inplay.llm.queries import quality_machine, table, tokenizer_file
from inplay.llm.storage import keep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.3 or more. It is fitted on labelled documents of the input."""
    machine = quality_machine(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), machine).filter("score >= 0.3").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of linked texts: the one of the smallest id (a null id is larger than every other), of several
    with that id the one whose text hashes least, of several rows alike any one. What counts is the text: rows that
    merely share an id stay, and so do texts without words."""
    keyed = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    groups = keep(jaccard.jaccard_join(keyed, carry=["text_hash"]).filter("class_id is not null").select("doc_id", "text_hash", "class_id"), "groups")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    judged = groups.join(groups.groupBy("class_id").agg(F.min(row).alias("one")), "class_id").withColumn("stays", row == F.col("one"))
    judged = judged.groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("rows"))
    drop, twice = judged.filter("not stays"), judged.filter("stays and rows > 1")
    same = lambda other: keyed["doc_id"].eqNullSafe(other["doc_id"]) & (keyed["text_hash"] == other["text_hash"])
    more = drop.unionByName(twice).select("doc_id", "text_hash")
    lone = keyed.join(more, same(more), "left_anti")
    one = keyed.join(twice.select("doc_id", "text_hash"), same(twice), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return lone.select(*COLUMNS).union(one.select(*COLUMNS))


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that came before; a document of which nothing but white space is left goes."""
    keyed = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    changed = chunks.dedupe_passages(docs.select("doc_id", "text")).filter(F.size("removed") > 0)
    changed = changed.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "kept").distinct()
    joined = keyed.join(changed, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    joined = joined.filter(F.col("kept").isNull() | F.col("kept").rlike(r"\S"))
    return joined.select("doc_id", F.coalesce("kept", "text").alias("text"), "lang", "source", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.char_length("kept")).cast("long").alias("n_chars"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    found = decontaminate.contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; one row per piece, with its ids."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality classifier", by_quality), ("n-gram Jaccard join", one_of_each), ("substring dedup", without_passages),
          ("benchmark decontamination", without_benchmark), ("packing", packed)]
#: Tokenisation, model scores and rolling hashes are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
