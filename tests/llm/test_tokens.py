"""Packing and the token file: pieces, sequences and files against the library's own ids."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inplay.llm import packing, rans
from inplay.llm.tokens import Encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b", "a \n b", "x\ty z ", " lead", "Ünïcode ÉCOLE ß", "it's we'll  don't", "'S 'Re", "日本語 テスト", "a<|endoftext|>b <|startoftext|>", "é áb ́x", "a b c",
       "1234 56a 7", "--- ... !!", "\n\n\nabc\n", "İstanbul Σίσυφος ΟΔΟΣ", "a" * 500, "a\x1cb c\x1d d", "x \u0085 y", "​ a ​ b", "ª º ² a", "ﬁ ﬂ ǅ", "end. end, end.", "\x00a b", "w- w%%% (w)", "a　b"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_remembered_chunks_have_the_librarys_ids(path, rows):
    own, library = Encoder(path), Tokenizer.from_file(path)
    texts = ODD + [t or "" for _, t in rows]
    for _ in range(2):  # from the library, then from memory
        for text, ids in zip(texts, own.ids(texts)):
            assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


def expected(rows, path):
    library = Tokenizer.from_file(path)
    return sorted((str(i), (np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")).tobytes()) for i, t in rows)


def cost_of(cuts, places, fees, length):
    pad = lambda n: 0 if n & (n - 1) == 0 else length - n
    return sum(pad(places[b] - places[a]) + fees[b] for a, b in zip(cuts[:-1], cuts[1:]))


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    places = np.append(0, np.cumsum(rng.integers(1, 12, 40)))
    fees, length = np.append(0, rng.integers(0, 3, 40) * 2.5), 32
    best = [0.0] + [np.inf] * 40
    for j in range(1, 41):
        for i in range(j):
            n = int(places[j] - places[i])
            if n <= length:
                best[j] = min(best[j], best[i] + (0 if n & (n - 1) == 0 else length - n) + fees[j])
    cuts = packing.choose_cuts(places, fees, length, True)
    assert cuts[0] == 0 and cuts[-1] == 40 and cost_of(cuts, places, fees, length) == pytest.approx(best[40])


def test_plan_of_a_stream_is_the_cheapest(rows):
    """The plan of pack() at its own settings, over a stream within its horizon, against the plain recurrence over all
    sentence ends and document ends."""
    ends, rng = np.zeros(1 << 16, bool), np.random.default_rng(3)
    ends[7] = True
    docs = [np.append(np.where(rng.random(n) < 0.08, 7, 9), 2).astype(np.uint16) for n in rng.integers(0, 900, 40)]
    packer = packing.Packer(4096, 8, 64, ends, 1 << 18, 0)
    pieces = [p for k, ids in enumerate(docs) for p in packer.add(k, ids)] + list(packer.plan(final=True))
    sizes = defaultdict(int)
    for p in pieces:
        sizes[p[5]] += p[2]
    cuts = np.append(0, np.cumsum(list(sizes.values())))
    stream, places, fee = np.concatenate(docs), [0], {0: 0.0}
    at = 0
    for ids in docs:
        for i, token in enumerate(ids[:-1], at + 1):
            if token == 7:
                places.append(i)
                fee[i] = 8.0
        at += len(ids)
        places.append(at)
        fee[at] = 0.0
    cost = {0: 0.0}
    for j, b in enumerate(places[1:], 1):
        cost[b] = min(cost[a] + (0 if (b - a) & (b - a - 1) == 0 else 4096 - (b - a)) for a in places[:j] if b - a <= 4096) + fee[b]
    assert cuts[-1] == len(stream) and set(cuts.tolist()) <= set(places)
    assert sum((0 if n & (n - 1) == 0 else 4096 - n) + fee[b] for n, b in zip(np.diff(cuts).tolist(), cuts[1:].tolist())) == pytest.approx(cost[places[-1]])


def test_packing_keeps_every_id_once(docs, rows):
    pieces = packing.pack(docs, WORD, length=256, horizon=4096).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        by_sequence[p.sequence_id].append(p)
    pad = total = 0
    for s in by_sequence.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == np.append(0, np.cumsum([p.length for p in s]))[:-1].tolist()
        n = sum(p.length for p in s)
        assert n <= 256
        pad, total = pad + (0 if n & (n - 1) == 0 else 256 - n), total + n
    assert pad < 0.05 * total
    pieces.sort(key=lambda p: (p.sequence_id, p.offset))
    got, held = [], b""
    for p in pieces:  # pieces of a document follow each other
        held = p.ids if p.start == 0 else held + p.ids
        if p.start + p.length == p.doc_tokens:
            got.append((str(p.doc_id), held))
    assert sorted(got) == expected(rows, WORD)


def test_token_file_gives_back_all_ids_in_order(docs, rows):
    got = rans.token_file(docs, BYTE).collect()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == expected(rows, BYTE)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.append(0, np.cumsum([r.n_tokens for r in got]))[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_ranges_of_the_stream_from_middle_checkpoints(spark, make_docs, tmp_path):
    rng = np.random.default_rng(9)
    ids = np.minimum(rng.geometric(0.01, 200_000) - 1, 50_000).astype(np.uint16)
    table = rans.Frequencies.scaled(np.bincount(ids, minlength=1 << 16))
    block = rans.encode_block([1], [ids], table)  # as in production
    points = rans.HEADER.unpack_from(block)[5]
    assert points == -(-len(ids) // (rans.LANES * rans.EVERY)) == 4
    for a, b in [(0, 5), (70_000, 70_001), (131_071, 131_073), (190_000, 200_000)]:
        assert (rans.decode_block(block, table, a, b)[2] == ids[a:b]).all()
    pairs = [(k, " ".join(f"word{(7 * k + j) % 97}" for j in range(40 + k))) for k in range(60)]
    path = rans.write_tokens(make_docs(pairs, 4), f"{tmp_path}/tokens", BYTE, segment_tokens=3000, block_tokens=700)
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(rans.read_tokens(spark, path).collect(), key=lambda r: r.start)])
    for a, b in [(0, 10), (2500, 2501), (2990, 6100), (len(whole) - 3, len(whole) + 50), (len(whole), len(whole) + 1)]:
        got = sorted(rans.read_ids(spark, path, a, b).collect(), key=lambda r: r.place)
        assert np.concatenate([np.zeros(0, "<u4"), *[np.frombuffer(r.ids, "<u4") for r in got]]).tolist() == whole[a:b].tolist() and (not got or got[0].place == a)


def test_empty_table(none):
    assert packing.pack(none, WORD).count() == 0
    assert rans.token_file(none, BYTE).count() == 0


def test_blocks_decode_from_any_checkpoint_and_notice_damage():
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.geometric(0.02, 10_001) - 1, 50_000).astype(np.uint16)
    table = rans.Frequencies.scaled(np.bincount(ids, minlength=1 << 16))
    assert table.freq.sum() == 1 << rans.SCALE
    again = rans.Frequencies.from_bytes(table.to_bytes())
    block = rans.encode_block([7, None, 9], [ids[:10], ids[10:10], ids[10:]], table, lanes=16, every=50)
    names, lengths, whole = rans.decode_block(block, again)
    assert names == [7, None, 9] and lengths.tolist() == [10, 0, 9991] and (whole == ids).all()
    for a, b in [(0, 1), (799, 801), (800, 10_001), (5000, 5000), (10_000, 10_001), (3, 9000)]:
        assert (rans.decode_block(block, again, a, b)[2] == ids[a:b]).all()
    assert len(block) < 10_001 * 1.2
    with pytest.raises(ValueError):
        rans.decode_block(block[:-1] + bytes([block[-1] ^ 1]), again)
    assert zlib.crc32(block) == zlib.crc32(rans.encode_block([7, None, 9], [ids[:10], ids[10:10], ids[10:]], again, lanes=16, every=50))
