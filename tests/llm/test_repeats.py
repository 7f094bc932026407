"""Repeated strings and passages, near duplicates and benchmark passages against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from inplay.llm import chunks, decontaminate, jaccard, queries, suffixes, textscan, tokens
from inplay.llm.components import components
from tests.llm.conftest import edited, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def grams(text, size=5):
    w = words(text)
    return [tuple(w[i:i + size]) for i in range(len(w) - size + 1)] or ([tuple(w)] if w else [])


def covered(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i:i + length] for x in raw for i in range(len(x) - length + 1))
    for x in raw:
        mark = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if seen[x[i:i + length]] > 1:
                mark[i:i + length] = True
        yield x, mark[:len(x)]


@pytest.mark.parametrize("length,batches", [(400, 4), (150, 3)])
def test_repeated_strings_equal_brute_force(make_docs, rows, length, batches):
    pairs = [(i, t) for i, t in rows if len(t or "") < 20_000]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(make_docs(pairs), length, batches).collect())
    want = Counter()
    for (i, _), (x, mark) in zip(pairs, covered([t for _, t in pairs], length)):
        runs = int((np.diff(np.append(0, mark.astype(int))) == 1).sum())
        want[i, len(x), int(mark.sum()), runs, hashlib.sha256(np.frombuffer(x, np.uint8)[~mark].tobytes()).hexdigest()] += 1
    assert got == want


def test_family_merges_equal_sizes(spark):
    family, seen, found = suffixes.Family(), Counter(), set()
    for b in range(5):
        batch = [(k, 100 * b + k) for k in range(b, b + 4)]
        found |= {r.key for r in family.add(spark.createDataFrame(batch, "key long, one long")).collect()}
        seen.update(k for k, _ in batch)
    assert sorted(family.levels) == [1, 4]
    assert found == {k for k, n in seen.items() if n > 1}


def test_chunk_ends_fall_back_into_step():
    raw = prose("step", 400).encode()
    whole = lambda b: set(len(b) - chunks.chunk_ends(np.frombuffer(b, np.uint8), np.array([0, len(b)]), 5, 512))
    a, b = whole(raw), whole(b"inserted " + raw)
    late = {e for e in a if e < len(raw) - 600}
    assert late and late <= b
    assert chunks.chunk_ends(np.frombuffer(b"a" * 2000, np.uint8), np.array([0, 2000]), 5, 512).max() == 2000


def test_passages_go_once_and_clean_texts_stay(make_docs, rows):
    out = chunks.dedupe_passages(make_docs(rows)).collect()
    assert len(out) == len(rows)
    text = dict(rows)
    hosts = [r for r in out if prose("passage", 90) in r.text]
    assert len(hosts) == 5 and all(r.repeated for r in hosts) and sum(not r.removed for r in hosts) == 1
    assert min(hosts, key=lambda r: r.doc_id).kept == min(hosts, key=lambda r: r.doc_id).text
    for r in hosts:
        raw = r.text.encode()
        for s in r.removed:
            assert 120 <= s.stop - s.start <= len(prose("passage", 90).encode()) + 2
            assert raw[s.start:s.stop].decode() in prose("passage", 90) + "\n\n"
    for r in out:
        raw, at, kept = r.text.encode(), 0, b""
        for s in r.removed:
            kept, at = kept + raw[at:s.start], s.stop
        assert (kept + raw[at:]).decode() == r.kept
        if "ab ab" not in r.text and prose("passage", 90) not in r.text and not r.text.startswith(prose("twin", 300)[:20]) and "aaaa" not in r.text:
            assert r.kept == r.text and not r.repeated
    twins = [r for r in out if r.text == prose("twin", 300)]
    assert sum(r.kept == r.text for r in twins) == 1 and len(text) < len(rows)


def test_every_short_passage_goes(make_docs):
    """Many passages of 51 to 60 words, twice each; and common stretches that stay under the length but adjoin."""
    plant = [prose(("plant", k), 51 + k % 10) for k in range(150)]
    pairs = [(k, f"{prose(('before', k), 30)} {p} {prose(('after', k), 30)}") for k, p in enumerate(plant)]
    pairs += [(1000 + k, f"{prose(('front', k), 30)} {p} {prose(('back', k), 30)}") for k, p in enumerate(plant)]
    bits = [prose(("bit", k), 60)[:70].strip() for k in range(2)]
    pairs += [(2000, f"{prose('x', 30)} {bits[0]} {prose('y', 30)}"), (2001, f"{prose('z', 30)} {bits[1]} {prose('w', 30)}"), (2002, f"{prose('u', 30)} {bits[0]} {bits[1]} {prose('v', 30)}")]
    out = {r.doc_id: r for r in chunks.dedupe_passages(make_docs(pairs)).collect()}
    for k, p in enumerate(plant):
        assert out[k].kept == out[k].text and len(out[k].repeated) == 1
        assert p not in out[1000 + k].kept and len(out[1000 + k].kept.encode()) <= len(out[1000 + k].text.encode()) - len(p.encode())
    assert all(not out[i].repeated and out[i].kept == out[i].text for i in (2000, 2001, 2002))


def test_passages_of_others_than_the_first(make_docs):
    """The first occurrence of a common phrase has another context; two later texts share the phrase with theirs."""
    phrase = prose("phrase", 40)[:100].strip()
    around = [f"{prose('l', 4)} {phrase} {prose('r', 4)}" for _ in range(2)]
    pairs = [(0, f"{prose('a', 40)} {phrase} {prose('b', 40)}")] + [(1 + k, f"{prose(('c', k), 40)} {x} {prose(('d', k), 40)}") for k, x in enumerate(around)]
    out = {r.doc_id: r for r in chunks.dedupe_passages(make_docs(pairs)).collect()}
    assert [len(out[k].removed) for k in range(3)] == [0, 0, 1] and around[1] not in out[2].kept and len(out[1].repeated) == 1


def brute_links(pairs, percent=75):
    sets = [frozenset(grams(t)) for _, t in pairs]
    parent = list(range(len(pairs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(pairs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(pairs):
        least[root(i)].append(doc)
    out = Counter()
    for i, (doc, _) in enumerate(pairs):
        known = [d for d in least[root(i)] if d is not None]
        out[doc, len(sets[i]), (min(known) if known else None) if sets[i] else doc] += 1
    return out


def test_jaccard_components_equal_brute_force(make_docs, rows):
    base = prose("chain", 200).split()
    chain = [(1000 + k, " ".join(base[3 * k:3 * k + 120])) for k in range(12)]  # each links with its neighbours alone
    crowd = [(2000 + k, edited(prose("crowd", 120), k, 0.02)) for k in range(25)]
    pairs = rows + chain + crowd
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(make_docs(pairs)).collect())
    assert got == brute_links(pairs)


def test_null_ids_do_not_tie_classes_together(make_docs):
    """Two unrelated texts without an id, each near an unrelated document; and a class of which no row has an id."""
    a, b, c = prose("one", 100), prose("two", 100), prose("three", 100)
    pairs = [(5, a), (None, a + " x"), (9, b), (None, b + " y"), (None, c), (None, "z " + c), (None, prose("lone", 60)), (5, prose("same id", 60))]
    out = jaccard.jaccard_join(make_docs(pairs), carry=["lang"]).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_links(pairs)
    assert sorted(Counter(r.class_id for r in out).values()) == [1, 1, 2, 2, 2] and {r.lang for r in out} == {"xx"}


def test_chance_repeats_make_no_pairs(make_docs, monkeypatch):
    """Documents of like size that share phrases with many others, far fewer than linked sets must share, are never paired."""
    phrases = [prose(("phrase", k), 6).lower().replace(".", "") for k in range(12)]
    texts = [prose(("by chance", k), 110).split() for k in range(60)]
    pairs = [(k, " ".join(" ".join([*w[9 * j:9 * j + 9], phrases[(k + 5 * j) % 12]]) for j in range(12) if j < 9)) for k, w in enumerate(texts)]
    pairs += [(100 + k, edited(pairs[k][1], k, 0.02)) for k in range(10)]
    made, keep = [], jaccard.keep

    def counted(df, name):
        out = keep(df, name)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "keep", counted)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(make_docs(pairs)).collect())
    assert got == brute_links(pairs) and len({c for _, _, c in got}) < len(pairs)
    assert len(made) == 2 and made[0] <= 5


def test_heavily_edited_crowd_meets_only_near_its_like(make_docs):
    """Copies with one to three tenths of their words edited: some links, many near misses, each decided exactly."""
    base = prose("crowd of edits", 150)
    pairs = [(k, edited(base, k, 0.01 + 0.003 * k)) for k in range(40)] + [(100 + k, base + " " + prose(("more", k), 10 + 6 * k)) for k in range(8)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(make_docs(pairs, 5)).collect())
    assert got == brute_links(pairs) and 1 < len({c for _, _, c in got}) < 48


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 200, 201: 200}


def brute_leaks(pairs, items, percent=75):
    out = {}
    for doc, text in pairs:
        w = words(text)
        for item, passage in items:
            n, own = len(words(passage)), Counter(grams(passage))
            for s in range(len(w) - n + 1) if n else ():
                part = Counter([tuple(w[s:s + n][i:i + 5]) for i in range(n - 4)] or [tuple(w[s:s + n])])
                both, every = sum((own & part).values()), sum((own | part).values())
                if 100 * both >= percent * every:
                    out[doc, item] = max(out.get((doc, item), 0), both / every)
    return out


def test_benchmark_passages_equal_brute_force(spark, make_docs):
    items = [(k, prose(("item", k), 15 + 4 * k)) for k in range(8)] + [(50, "tiny item"), (51, ""), (52, None), (53, "la la la la la la la la la la la la"), (None, "no such words here at all")]
    pairs = [(k, f"{prose(('a', k), 80)} {items[k % 8][1]} {prose(('b', k), 80)}") for k in range(8)]
    pairs += [(20 + k, f"{prose(('a', k), 50)} {edited(items[k][1], k, 0.03).upper()}") for k in range(8)]
    pairs += [(40, "say la la la la la la la la la la la la and la"), (41, "x tiny item y"), (42, None), (43, ""), (None, items[3][1])] + [(60 + k, prose(("clean", k), 200)) for k in range(5)]
    table = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(make_docs(pairs), table).collect()}
    assert got == pytest.approx(brute_leaks(pairs, items))
    assert len(got) >= 10 and not any(d is not None and d >= 60 for d, _ in got)


def test_documents_shorter_than_an_item(spark, make_docs):
    items = [(k, prose(("whole", k), 59 - 4 * k)) for k in range(8)]
    cut = lambda k, a, b: " ".join(items[k][1].split(" ")[a:len(items[k][1].split(" ")) - b])
    pairs = [(10 * k + j, cut(k, a, b)) for k in range(8) for j, (a, b) in enumerate([(0, 2), (1, 1), (3, 2), (5, 5), (9, 9)])]
    pairs += [(200 + k, edited(cut(k, 1, 2), k, 0.02)) for k in range(8)] + [(None, cut(0, 2, 0)), (300, prose("other", 40)), (301, "a b c"), (302, None)]
    want = brute_leaks(pairs, items)
    for doc, text in pairs:
        for item, passage in items:
            part, own = Counter(grams(text)), Counter(grams(passage))
            both, every = sum((own & part).values()), sum((own | part).values())
            if len(words(text)) < len(words(passage)) and 100 * both >= 75 * every:
                want[doc, item] = both / every
    got = {(r.doc_id, r.item_id): (r.similarity, r.n_windows) for r in decontaminate.contaminated(make_docs(pairs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want) and all(v[1] == 1 for v in got.values())
    assert want[0, 0] == pytest.approx(53 / 55) and len(want) >= 24


def test_empty_tables(spark, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert suffixes.without_repeats(none).count() == 0
    assert chunks.dedupe_passages(none).count() == 0
    assert jaccard.jaccard_join(none).count() == 0
    assert decontaminate.contaminated(none, items).count() == 0


def test_extended_marks_of_many_pairs_at_once():
    """Marks within a passage are extended once, and every string about a mark that the head lacks is listed once."""
    same, least = bytes(range(33, 123)) * 2, 64
    own, head = b"#" * 20 + same + b"own" * 30, b"==" + same + b"other" * 9
    marks = [[{"place": p, "head_place": p - 18, "near": 0, "far": 9} for p in (40, 60, 150)], [{"place": 30, "head_place": 12, "near": 2, "far": 2}], []]
    texts = [own.decode(), head.decode(), ""]
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("place", "head_place", "near", "far")]))
    part = pa.RecordBatch.from_arrays([pa.array([5, 6, 7]), pa.array([1, 1, 1]), pa.array(texts), pa.array([3, 6, 3]), pa.array([2, 1, 2]), pa.array([head.decode(), head.decode(), "x"]), pa.array(marks, kind)],
                                      names=["id", "text_hash", "text", "head_id", "head_hash", "head_text", "marks"])
    (rows, data, offsets), = textscan.slices(part, "text")
    got = chunks.extended(rows, data, offsets, least).to_pylist()
    spans = {(r["id"], r["text_hash"], r["start"], r["stop"], r["gone"]) for r in got if r["gone"] is not None}
    assert spans == {(5, 1, 20, 201, True), (3, 2, 2, 183, False)}
    strings = [(r["id"], r["start"]) for r in got if r["gone"] is None]
    assert strings == [*((5, a) for a in range(141, 151)), (6, 28)]  # the last by a mark whose digests agree by chance
    assert all(r["stop"] == r["start"] + least and r["high"] is not None for r in got if r["gone"] is None)


def test_scans_of_text_drop_what_encoders_remember():
    """A worker that packed texts once must not hold its memory of words through later stages."""
    path = queries.tokenizer_file("word_bpe_49k.json")
    tokens.encoder(path).ids(["some words that are remembered"])
    assert tokens._ENCODERS[path].memory
    batch = pa.RecordBatch.from_arrays([pa.array(["a", None])], names=["text"])
    assert [len(data) for _, data, _ in textscan.slices(batch, "text")] == [1]
    assert not tokens._ENCODERS
