"""Sharding, fingerprints, language-model and quality scores, and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from inplay.llm import mixing, quality, queries, sharding, syncmers
from inplay.llm.ordering import cut_points, range_bucket
from inplay.llm.queries import remainder
from pyspark.sql import functions as F
from tests.llm.conftest import prose


def test_matrix_has_exact_margins_and_the_right_law():
    matrix = sharding.communication_matrix([7, 0, 13, 1, 22], 4, seed=3)
    assert [sum(r) for r in matrix] == [7, 0, 13, 1, 22]
    assert sorted(map(sum, zip(*matrix))) == [10, 11, 11, 11]
    rng, n = random.Random(1), 4000
    drawn = Counter(sharding.hypergeometric(rng, 5, 6, 9) for _ in range(n))
    for k in range(6):
        p = math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5)
        assert abs(drawn[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9
    big = [sharding.hypergeometric(rng, 10**6, 10**9, 7 * 10**9) for _ in range(200)]
    assert abs(np.mean(big) - 125_000) < 200


def test_shards_hold_every_row_once(docs, none, rows):
    out = sharding.hypergeometric_shards(docs, shards=4, seed=1, block_rows=3)
    assert [c for c in out.columns if c != "slot"] == [*[c for c in docs.columns if c != "shard"], "shard"]
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(4))
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert sharding.hypergeometric_shards(none).count() == 0


def test_range_buckets_follow_the_cut_points(spark):
    df = spark.range(500).selectExpr("case when id < 200 then 7 else id end as k").union(spark.sql("select cast(null as bigint)"))
    cuts = cut_points(df, "k", 10)
    for r in df.select("k", range_bucket(F.col("k"), cuts).alias("b")).collect():
        assert r.b == (-1 if r.k is None else sum(c < r.k for c in cuts))


def test_closed_syncmers_by_hand(spark):
    h = [11, 5, 9, 2, 7, 3, 8]
    text = prose("anchors", 60)
    df = spark.createDataFrame([(text,), ("start " + text,), (" ".join(text.split()[20:]),), ("a b",), ("",), (None,)], "text string")
    got = [r.anchors for r in syncmers.fingerprints(df, "text", 4, 2).select("anchors").collect()]
    assert len(h) and len(got[3]) == 1 and got[4] == [] == got[5]
    first = {a.pos: a.hash for a in got[0]}
    assert {p + 1: v for p, v in first.items()}.items() <= {a.pos: a.hash for a in got[1]}.items()  # context-free, so they move along
    assert {p - 20: v for p, v in first.items() if p >= 20} == {a.pos: a.hash for a in got[2]}
    assert 0.4 < len(first) / 57 < 0.95
    words = text.split()
    hashes = [r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).collect()]
    inner = [r.h for r in spark.createDataFrame(list(zip(hashes, hashes[1:])), "a long, b long").select(F.xxhash64("a", "b").alias("h")).collect()]
    assert sorted(first) == [i for i in range(len(words) - 3) if min(inner[i:i + 3]) in (inner[i], inner[i + 2])]


def test_edit_check_against_plain_python(make_docs, none):
    pairs = [(5 * k, prose(("edit", k), 10 + 7 * k)) for k in range(12)] + [(3, ""), (8, None), (61, "é" * 9), (62, prose(("edit", 4), 38)), (None, "null id comes first")]
    got = {r.doc_id: r for r in syncmers.edit_check(make_docs(pairs), buckets=4).collect()}
    order = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0))
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after, r = t or "", after or "", got[i]
        cut = len(t) // 4
        twin = t[:len(t) - cut] + after[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(twin.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.fingerprint == r.edited_fingerprint or t != twin
    assert got[20].fingerprint == got[62].fingerprint
    assert got[50].near_edited > 0.3 > got[50].near_next
    assert syncmers.edit_check(none).count() == 0
    alone = syncmers.edit_check(make_docs([(1, "just one text here")])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1


def test_bits_of_a_word_have_probabilities_that_add_up():
    words, kinds = [b"abc", b"abd", mixing.END, "é".encode()], np.array([0, 1, 16, 3])
    mixer = mixing.Mixer(np.zeros(mixing.SLOTS, np.uint16), np.zeros(mixing.SLOTS, np.uint16))
    assert mixer.scores([b"q"], np.array([0]))[0] == pytest.approx(-16 * math.log10(2))  # knows nothing: half a chance a bit
    rng = np.random.default_rng(1)
    mixer.zeros[:], mixer.ones[:] = rng.integers(0, 9, mixing.SLOTS), rng.integers(0, 9, mixing.SLOTS)
    assert mixer.learn(iter([(words, kinds, np.array([5.0, 3, 2, 1]))]), least_steps=20) == 11
    mixer.refine(mixer.watched)
    one_byte = [bytes([b]) for b in range(256) if bytes([b]) != mixing.END]
    ends = 10 ** mixer.scores([mixing.END], np.array([0]))[0]
    heads = 0.0
    for b in one_byte:  # the space that closes the word has a probability given the byte; leave it out
        word, node, bits, slots = mixing.bit_events([b], np.array([0]))
        total = mixer.mixed(*mixer.inputs(bits, slots, False))[0]
        spot = (np.clip(total, -8, 8) + 8) * (mixing.STEPS - 1) / 16
        low = np.minimum(spot.astype(int), mixing.STEPS - 2)
        better = mixer.refined[node, low] * (1 - (spot - low)) + mixer.refined[node, low + 1] * (spot - low)
        p = 0.5 / (1 + np.exp(-total)) + 0.5 / (1 + np.exp(-better))
        heads += np.prod(np.where(bits == 1, p, 1 - p)[:8])
    assert heads + ends == pytest.approx(1)


def test_language_model_scores(make_docs, none, rows):
    pairs = [(i, t) for i, t in rows if len(t or "") < 20_000]
    got = mixing.score_texts(make_docs(pairs), remainder("doc_id", 10) != 0, hot=50).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = [[*(t or "").encode().lower().split(), mixing.END] for _, t in pairs]
    c = Counter(w for (i, _), x in zip(pairs, tokens) if not held(i) for w in x)
    total, v = sum(c.values()), len(c)
    want = Counter((i, not held(i), len(x), sum(c[w] > 0 for w in x), total, round(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (v + 1))) for w in x), 6)) for (i, _), x in zip(pairs, tokens))
    assert Counter((r.doc_id, r.training, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    same = [r.score for r in got if r.n_bytes == len(prose("twin", 300).encode())]
    assert len(same) >= 4 and max(same) - min(same) < 1e-6
    assert mixing.score_texts(none, F.lit(True)).count() == 0


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    machine = quality.Machine(rank=3)
    column, value = np.array([3, 70, 900, 16_390]), rng.random(4).astype(np.float32)
    machine.weight[column] = rng.random(4)
    pairs = sum(float(machine.factor[column[i]] @ machine.factor[column[j]]) * value[i] * value[j] for i in range(4) for j in range(i))
    want = machine.bias + (machine.weight[column] * value).sum() + pairs
    assert machine.logits(np.zeros(4, int), column, value, 1)[0][0] == pytest.approx(want, rel=1e-4)


def labelled(make_docs, spark, n=120):
    good = [(k, prose(("good", k), 60)) for k in range(n)]
    bad = [(n + k, " ".join(f"{w}%%%" for w in prose(("bad", k), 60).upper().split())) for k in range(n // 3)]
    labels = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (5, None), (7, 1), (9_999, 0)]
    return make_docs(good + bad + [(None, None), (500, ""), (7, "a second text of one id")]), spark.createDataFrame([(i, q, "t") for i, q in labels], "doc_id long, quality int, text string"), good, bad


def test_quality_machine_on_held_out_labels(make_docs, spark, none):
    docs, labels, good, bad = labelled(make_docs, spark)
    machine = quality.train(docs, labels.filter(remainder("doc_id", 5) != 0), sample=100)
    out = quality.score(docs, machine)
    assert out.columns[-1] == "score" and len(set(out.columns)) == len(out.columns)
    score = {r.doc_id: r.score for r in out.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    assert np.mean([score[i] >= 0.3 for i, _ in good if held(i) and i != 7]) > 0.95
    assert np.mean([score[i] < 0.3 for i, _ in bad if held(i)]) > 0.8
    assert all(0 <= s <= 1 for s in score.values()) and len(score) == len(good) + len(bad) + 2
    assert quality.score(none, machine).count() == 0
    again = quality.train(docs, labels.filter(remainder("doc_id", 5) != 0), sample=100)
    assert (again.weight == machine.weight).all()
    assert {round(r.score, 6) for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} != set()
    meta = quality.train(docs, labels, metadata=["lang", "source"])
    assert quality.score(docs, meta, ["lang", "source"]).count() == docs.count()


def test_pipeline_stages_on_a_small_corpus(make_docs, spark, tmp_path):
    docs, labels, good, bad = labelled(make_docs, spark, 90)
    item, passage = prose("benchmark item", 30), prose("shared", 80)
    extra = [(1000, good[3][1]), (1001, f"{prose('x1', 50)} {item} {prose('x2', 50)}"), (1002, f"{prose('x3', 60)}\n{passage}\n{prose('x4', 60)}"),
             (1003, f"{prose('x5', 60)}\n{passage}\n{prose('x6', 60)}")]
    whole = make_docs(good + bad + extra + [(None, None), (2000, "")]).select(*corpus_pipeline.COLUMNS)
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "packing"]
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        at = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        seen.append({r.doc_id: r for r in at.collect()})
        if name != "packing":
            assert at.columns == list(corpus_pipeline.COLUMNS)
    kept = [set(s) for s in seen]
    assert not kept[0] & {i for i, _ in bad[5:]} or len(kept[0] & {i for i, _ in bad}) < 5
    assert {i for i, _ in good} <= kept[0]
    assert kept[0] - kept[1] == {1000}
    assert kept[2] == kept[1] and sum(seen[2][i].text != seen[1][i].text for i in kept[1]) == 1 and seen[2][1002].text == seen[1][1002].text and passage not in seen[2][1003].text
    assert kept[2] - kept[3] == {1001}
    assert kept[4] == kept[3]
    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()


def test_one_of_each_decides_by_text(make_docs, spark):
    a, b, c = prose("first text", 90), prose("second text", 90), prose("third text", 90)
    pairs = [(5, a), (None, a + " x"), (9, b), (None, b + " y"), (7, c), (7, prose("another text of id 7", 90)), (7, c), (8, c + " z"), (None, prose("alone", 50)), (None, prose("alone", 50) + " w"), (3, ""), (3, ""), (None, None)]
    docs = make_docs(pairs).select(*corpus_pipeline.COLUMNS)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, "").collect())
    lone = [k for k in kept if k[0] is None and k[1] is not None]
    assert len(lone) == 1 and lone[0][1].startswith(prose("alone", 50)) and kept.pop(lone[0]) == 1
    assert kept == Counter([(5, a), (9, b), (7, c), (7, prose("another text of id 7", 90)), (3, ""), (3, ""), (None, None)])


def test_registered_shards_deal_the_texts(spark, monkeypatch, tmp_path, make_docs, rows):
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    real, met = sharding.hypergeometric_shards, []
    monkeypatch.setattr(sharding, "hypergeometric_shards", lambda df, **k: met.append(df.columns) or real(df, **k))
    out = queries.op2_hypergeometric_shards(spark, str(tmp_path)).collect()
    assert met == [["doc_id", "text"]]
    raw = [(i, (t or "").encode()) for i, t in rows]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in raw)
