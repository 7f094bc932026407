"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inplay.llm import chunks, decontaminate, jaccard, mixing, packing, quality, rans, sharding, spheres, suffixes, syncmers, toxicity, tries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


@register
def op2_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, texts too, in eight shards whose counts differ by one at most; sizes and checksums of what arrives."""
    dealt = sharding.hypergeometric_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8, seed=2)
    raw = F.coalesce("text", F.lit("")).cast("binary")
    return dealt.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
                        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register
def op3_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and their edited twins, with likenesses."""
    return syncmers.edit_check(table(spark, sf_dir, "documents"))


@register
def op10_range_coded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids through the range-coded token file."""
    tokens = rans.token_file(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return tokens.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


@register
def op6_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that repeated 400-byte strings cover."""
    return suffixes.without_repeats(table(spark, sf_dir, "documents")).drop("spans")


@register
def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages that came before in others (or in themselves)."""
    out = chunks.dedupe_passages(table(spark, sf_dir, "documents"))
    bytes_of = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return out.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), bytes_of("repeated").alias("n_repeated"), bytes_of("removed").alias("n_removed"),
                      F.size("repeated").cast("long").alias("n_passages"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@register
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked by a Jaccard similarity of 0.75 or more on five-word n-grams."""
    return jaccard.jaccard_join(table(spark, sf_dir, "documents")).drop("set_id", "class_id")


ORACLES["op8_jaccard_join"] = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


@register
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a passage of a benchmark item, with the item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def remainder(column: str, parts: int):
    """crc32 of the id as text, modulo `parts` (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def quality_machine(docs: DataFrame, labels: DataFrame) -> quality.Machine:
    """A machine that has seen the labels of four fifths of the ids."""
    return quality.train(docs.select("doc_id", "text"), labels.filter(remainder("doc_id", 5) != 0))


@register
def op9_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a quality score; labels of one fifth of the ids are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_machine(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register
def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of nine tenths of them."""
    out = mixing.score_texts(table(spark, sf_dir, "documents"), remainder("doc_id", 10) != 0)
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@register
def op11_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a toxicity score; labels of a third of the ids are held out."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels.filter(remainder("doc_id", 3) != 1)))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register
def op12_trie_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from all documents, in each of their 120 orders, per source."""
    return tries.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_trie_audit"] = r"""
WITH marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
counted AS (SELECT doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
failing AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END,
    CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END, CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN least < c.doc_id THEN 'E' ELSE '' END) AS f
    FROM counted c LEFT JOIN marks m ON m.doc_id = c.doc_id),
masks AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l)
    JOIN letters d ON d.l NOT IN (a.l, b.l, c.l) JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
each AS (SELECT part, o, s, n, good, toxic, f, contains(f, substr(o, s, 1)) AS fails, len(translate(f, substr(o, 1, s - 1), '')) < len(f) AS gone, length(f) AS k
    FROM masks, orders, (SELECT unnest(range(1, 6)) AS s))
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN f = substr(o, s, 1) THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost, CAST(sum(CASE WHEN fails THEN n * (120 // k) ELSE 0 END) AS BIGINT) AS shapley
FROM each GROUP BY part, o, s
"""


@register
def op13_sphere_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid vectors in 16 clusters after three rounds of exact whole-number k-means."""
    rows, centroids = spheres.centroid_clusters(table(spark, sf_dir, "embeddings"))
    return spheres.with_inertia(rows.drop("scanned"), centroids)


def _sphere_sql(k: int = 16, rounds: int = 3) -> str:
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT sha256('1:' || vec_id) AS h, e FROM v ORDER BY h, e LIMIT {k}))"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT v.r, min({{'d': list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))), 'c': c.c}}) AS m
  FROM v, c{i} c GROUP BY v.r)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.e, o.e) AS e FROM c{i} o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM
  (SELECT a.m.c AS c, i, sum(v.e[i]) AS s, count(*) AS n FROM a{i} a JOIN v ON v.r = a.r, (SELECT unnest(range(1, 65)) AS i) GROUP BY a.m.c, i) GROUP BY c) n ON n.c = o.c)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT v.vec_id, CAST(a.m.c AS INTEGER) AS cluster, CAST(a.m.d AS BIGINT) AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.e, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN v ON v.r = a.r JOIN c{rounds} c ON c.c = a.m.c"""


ORACLES["op13_sphere_drift"] = _sphere_sql()
