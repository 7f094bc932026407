import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("shard", T.StringType()),
                       T.StructField("score", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n", T.StringType()), T.StructField("text_hash", T.StringType())])


def prose(seed, words):
    """Sentences of invented words."""
    rng = random.Random(repr(seed))
    out = []
    for i in range(words):
        w = "".join(rng.choice(["ka", "lo", "mi", "ré", "su", "to", "ven", "ß", "qi", "dar"]) for _ in range(rng.randint(1, 4)))
        out.append(w.capitalize() if i % 9 == 0 else w + ("." if i % 9 == 8 else ""))
    return " ".join(out)


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join("xx" + str(rng.randint(0, 99)) if rng.random() < share else w for w in text.split(" "))


def corpus():
    """Null, empty, white and very long texts, exact and near copies, repeated rows, a shared passage, null ids."""
    passage, twin = prose("passage", 90), prose("twin", 300)
    texts = [None, "", " \n\t ", "one", "Two Words", "two words", prose("long", 30_000), "a" * 5000, "ab " * 900, twin, twin, twin]
    texts += [edited(twin, s, 0.01) for s in range(4)] + [edited(twin, s, 0.5) for s in range(2)]
    texts += [f"{prose(('head', s), 60)}\n{passage}\n{prose(('tail', s), 60)}" for s in range(5)]
    texts += [prose(("own", s), 40 + 30 * s) for s in range(10)] + ["日本語 のテキスト です。", "<|endoftext|> x y\x1cz"]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    rows += [(None, prose("nobody", 50)), (None, twin), rows[8], rows[8], (rows[20][0], "same id, other text")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(pairs, partitions=3):
        full = [(i, t, "xx", None, len(t or ""), "s", "high", "k", "n", "h") for i, t in pairs]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions) if full else spark.createDataFrame([], SCHEMA)

    return make


@pytest.fixture(scope="session")
def docs(make_docs, rows):
    return make_docs(rows)


@pytest.fixture(scope="session")
def none(make_docs):
    return make_docs([])
