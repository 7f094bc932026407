"""Filter interactions, whole-number k-means and toxicity against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import types as T

from inplay.llm import queries, spheres, toxicity, trees, tries
from inplay.llm.queries import remainder
from tests.llm.conftest import prose


# ---- filter audit

def brute_audit(rows, labels):
    """rows: (doc_id, part, text); labels: (doc_id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    order_of = lambda i: (i is None, i or 0)
    least = {}
    for i, _, t in rows:
        t = t or ""
        least[t] = min(least.get(t, order_of(i)), order_of(i))
    fails = []
    for i, part, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
             "D": any(c in "#$%&*|" for c in t), "E": order_of(i) > least[t]}
        fails.append((part or "", i, {k for k in f if f[k]}))
    out, shapley = defaultdict(lambda: [0] * 6), Counter()
    parts = {p for p, _, _ in fails}
    for order in map("".join, permutations("ABCDE")):
        for step, letter in enumerate(order, 1):
            before = set(order[:step - 1])
            for p in parts:
                out[p, order, step]
            for p, i, f in fails:
                line = out[p, order, step]
                here = letter in f and not f & before
                shapley[p, letter] += here
                line[0] += letter not in f and not f & before
                line[1] += here
                line[2] += letter in f and bool(f & before)
                line[3] += f == {letter}
                line[4] += here and i in good
                line[5] += here and i in toxic
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_brute_force(spark, rows):
    rng = random.Random(4)
    data = [(i, rng.choice([None, "", "a", "b"]), t) for i, t in rows] + [(1000 + k, "b", prose("hot copy", 260)) for k in range(30)]
    data += [(None, "b", prose("hot copy", 260)), (900, "a", prose("hot copy", 260)[:-1]), (901, "a", prose("hot copy", 260) + " #"), (7, "c", "UP AND #"), (8, "c", "up " * 500)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, _, _ in data for _ in range(rng.choice([0, 1, 2]))] + [(None, 1, 1), (99_999, 1, 1)]
    schema = "doc_id long, source string, text string, part string, mask string, n string, range string"
    docs = spark.createDataFrame([(*r, "p", "m", "n", "r") for r in data], schema).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for target in (1 << 24, 2000):
        got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in tries.interactions(docs, marks, target).collect()}
        assert got == brute_audit(data, labels)
    assert tries.interactions(docs.limit(0), marks).count() == 0
    assert tries.interactions(docs, marks.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_trie_keeps_least_numbers_at_ends():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 7))) for _ in range(400)] + [b"", b"abc" * 5000, b"abc" * 5000 + b"x"]
    trie, want = tries.Trie(), {}
    for n, t in enumerate(rng.sample(texts, len(texts))):
        trie.insert(t, n, t)
        want[t] = min(want.get(t, n), n)
    ends = list(trie.ends())
    assert {e.rows[0]: e.least for e in ends} == want and all(len(set(e.rows)) == 1 for e in ends)
    stack = [(trie, True)]
    while stack:  # compressed: no inner node has one child and no end
        node, root = stack.pop()
        assert root or node.least is not None or len(node.children) > 1
        stack += [(below, False) for _, below in node.children.values()]


def test_prefix_cuts_deal_texts_evenly(spark):
    texts = [prose(("cut", k), 40) for k in range(600)] + ["the same long opening " * 20 + prose(("tail", k), 20) for k in range(600)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(6)
    size, target = sum(len(t.encode()) for t in texts), 40_000
    cuts = tries.prefix_cuts(docs, target, every=1000)
    assert cuts == sorted(set(cuts))
    held = Counter()
    for t in texts:
        held[np.searchsorted(np.array(cuts, object), t.encode(), "right")] += len(t.encode())
    assert len(cuts) >= size // target // 2 and max(held.values()) < 3 * target
    assert tries.prefix_cuts(docs.limit(0)) == []


# ---- k-means

def brute_means(vectors, k=16, rounds=3):
    """vectors: (id, list of 64 doubles or worse); the ids of seeds decide, then the vectors."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes())
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else at for j, at in enumerate(centroids)]
    at = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, j, d in at:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, j, d in at)


def test_spheres_equal_plain_means(spark, tmp_path):
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 1, (9, 64))
    vectors = [(k, (middle[k % 9] + rng.normal(0, 0.15, 64)).tolist()) for k in range(300)]
    vectors += [(500 + k, vectors[3][1]) for k in range(60)] + [vectors[5], vectors[5], (None, vectors[8][1]), (7, vectors[9][1])]
    vectors += [(600, None), (601, [1.0] * 63), (602, [1.0] * 63 + [None]), (603, [1.0] * 63 + [math.nan]), (604, [math.inf] + [0.0] * 63), (605, [0.0] * 64), (606, [])]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.StringType()), T.StructField("upper", T.StringType())])
    df = spark.createDataFrame([(*v, "c", "u") for v in vectors], schema).repartition(4)
    rows, centroids = spheres.centroid_clusters(df)
    assert Counter(tuple(r) for r in spheres.with_inertia(rows.drop("scanned"), centroids).collect()) == brute_means(vectors)
    assert rows.filter("not scanned").count() > 100  # the bounds spare most vectors the scan
    few = df.filter("vec_id < 5")
    rows, centroids = spheres.centroid_clusters(few)
    assert len(centroids) == 5 and Counter(tuple(r) for r in spheres.with_inertia(rows.drop("scanned"), centroids).collect()) == brute_means([v for v in vectors if v[0] is not None and v[0] < 5])
    rows, centroids = spheres.centroid_clusters(df.limit(0))
    assert spheres.with_inertia(rows, centroids).count() == 0
    df.drop("cluster", "upper").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op13_sphere_drift(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "int", "bigint", "bigint", "bigint", "string"] and out.count() == len(vectors) - 6


def test_drift_over_a_sphere_is_never_understated():
    rng = np.random.default_rng(5)
    for _ in range(60):
        old = rng.integers(-50, 50, (6, 3))
        new = old + rng.integers(-12, 12, (6, 3)) * rng.integers(0, 2, (6, 1))
        radius = rng.uniform(0, 40, 6)
        loss = spheres.tightened_drift(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        assert (loss <= drift[None, :] * (1 + 1e-6)).all()
        for i in range(6):
            way = rng.normal(0, 1, (200, 3))
            points = old[i] + way / np.sqrt((way**2).sum(1, keepdims=True)) * radius[i] * rng.uniform(0, 1, (200, 1)) ** 0.2
            for j in range(6):
                if i != j:
                    lost = np.sqrt(((points - old[j]) ** 2).sum(1)) - np.sqrt(((points - new[j]) ** 2).sum(1))
                    assert lost.max() <= loss[i, j] + 1e-9
    behind = spheres.tightened_drift(np.array([[-100, 0], [0, 0]]), np.array([[-100, 0], [8, 0]]), np.array([5.0, 0.0]))
    assert behind[0, 1] == 0  # a centroid that moves away from the sphere loses nothing


def test_large_components_stay_exact():
    p = np.array([[1 << 26, -(1 << 26)], [3, 4]], np.int64)
    assert spheres.squared(p, p).tolist() == [[0, ((1 << 26) - 3) ** 2 + ((1 << 26) + 4) ** 2], [((1 << 26) - 3) ** 2 + ((1 << 26) + 4) ** 2, 0]]


# ---- toxicity

def test_word_forms():
    data = np.frombuffer("(Fool!) f00l foooL *x* f@ol 12 --".encode(), np.uint8)
    _, _, plain, veiled, first = toxicity.word_forms(data, np.array([0, len(data)]))
    fool, bare = toxicity.form_hashes(["fool"])
    assert (plain[0], veiled[0]) == (fool[0], bare[0]) and plain[1] != fool[0] and veiled[1] == bare[0] == veiled[2]
    assert plain[6] == 0 == veiled[6] and plain[5] == 0 and first.tolist() == [0, 7]


def test_features_by_hand():
    text = "You are a nitwit!! And HE is a n1twit, aaargh? #$"
    lexicon = toxicity.Lexicon(*toxicity.form_hashes(["nitwit"]), np.array([3.0]))
    data = np.frombuffer((text + "nice" * 0).encode(), np.uint8)
    got = dict(zip(toxicity.STATISTICS, toxicity.features(data, np.array([0, 0, len(data)]), lexicon)[1]))
    n = 11
    assert got["words"] == pytest.approx(math.log1p(n)) and got["hits"] == got["veiled_hits"] == pytest.approx(math.log(2))
    assert got["weight_share"] == pytest.approx(6 / n) and got["hardest"] == 3 and got["aimed_share"] == pytest.approx(1 / n) and got["nearness"] == pytest.approx(1 / 4 + 1 / 9)
    assert got["persons"] == pytest.approx(1 / n) and got["shouted"] == pytest.approx(1 / n) and got["exclaimed"] == pytest.approx(2 / len(text))
    assert got["masked"] == pytest.approx(1 / n) and got["stretched"] == pytest.approx(1 / n) and got["single"] == pytest.approx(2 / n) and got["digits"] == pytest.approx(1 / len(text))


def test_isotonic_curve_and_trees():
    x, y = trees.isotonic(np.array([1, 2, 2, 3, 4, 5.0]), np.array([0, 1, 0, 0, 1, 1.0]))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and y[0] < 0.5 < y[-1]
    rng = np.random.default_rng(1)
    data = rng.uniform(-1, 1, (4000, 3))
    label = ((data[:, 0] > 0.2) ^ (data[:, 1] > 0)).astype(float)  # no single feature tells
    fitted = trees.Boosted().fit(data[:3000], label[:3000])
    assert ((fitted.logits(data[3000:]) > 0) == label[3000:]).mean() > 0.97
    assert trees.Boosted().fit(data[:0], label[:0]).logits(data[:2]).tolist() == [0, 0]
    assert len(set(trees.Boosted().fit(data[:50], np.ones(50)).logits(data[:9]).tolist())) == 1


def test_toxicity_on_held_out_labels(make_docs, spark, none):
    rng = random.Random(6)
    bad = ["nitwit", "fiend", "blighter", "oaf"]

    def rude(k):
        words = prose(("rude", k), 80).split()
        for _ in range(3):
            w = rng.choice(bad)
            words.insert(rng.randrange(len(words)), w if rng.random() < 0.7 else w.replace("i", "1").replace("o", "0"))
        return " ".join(words)

    mild, harsh = [(k, prose(("mild", k), 80)) for k in range(300)], [(1000 + k, rude(k)) for k in range(160)]
    labels = [(i, 0) for i, _ in mild] + [(i, 1) for i, _ in harsh] + [(None, 1), (5, None), (7, 0)]
    marks = spark.createDataFrame([(i, t, "x") for i, t in labels], "doc_id long, toxic int, text string")
    docs = make_docs(mild + harsh + [(None, None), (500, ""), (7, "a second text of one id"), (501, "x" * 30_000), (3, mild[3][1])])
    model = toxicity.train(docs, marks.filter(remainder("doc_id", 3) != 1))
    out = toxicity.score(docs, model)
    assert out.columns[-1] == "score" and len(set(out.columns)) == len(out.columns) and out.count() == 465
    score = {r.doc_id: r.score for r in out.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    assert np.mean([score[i] >= 0.7 for i, _ in harsh if held(i)]) > 0.9 and np.mean([score[i] < 0.7 for i, _ in mild if held(i)]) > 0.97
    assert all(0 <= s <= 1 for s in score.values())
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, marks.filter(remainder("doc_id", 3) != 1))).collect()}
    assert again == score
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.train(docs, marks.limit(0))
    assert {r.score for r in toxicity.score(docs, blank).collect()} == {0.5}
    assert all(0 < r.score < 0.2 for r in toxicity.score(docs, toxicity.train(docs, marks.filter("toxic = 0"))).collect())
