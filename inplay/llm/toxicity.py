"""Toxicity: boosted trees over lexicon densities, second-person nearness, capitals, punctuation and obfuscation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inplay.llm.storage import discard, keep
from inplay.llm.textscan import LOWER, SPACE, mix, slices, span_hashes, word_spans
from inplay.llm.trees import Boosted, isotonic

#: Words for the one spoken to, in English, German, French and Spanish.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer", "tu", "te", "toi", "ton", "ta", "vous", "votre", "vos",
                 "tú", "ti", "tuyo", "usted", "ustedes", "vosotros")
#: Letters that digits and signs stand for.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
NEAR = 5  # words
STATISTICS = ("words", "hits", "hit_share", "weight_share", "hardest", "veiled_hits", "veiled_share", "aimed_hits", "aimed_share", "nearness", "persons",
              "capitals", "shouted", "exclaimed", "asked", "signs", "signs_in_a_row", "masked", "stretched", "single", "digits")

_BYTE = np.arange(256)
UPPER, DIGIT = (_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 48) & (_BYTE <= 57)
LETTER = UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
SIGN = ~SPACE & ~LETTER & ~DIGIT
PLAIN = LOWER.copy()
for _sign, _letter in STANDS_FOR.items():
    PLAIN[ord(_sign)] = ord(_letter)
PLAIN_LETTER = LETTER[PLAIN]
MARK = np.isin(_BYTE, [ord("!"), ord("|")])  # punctuation, unless letters stand on both sides


def word_forms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word: start, stop, hash of its lower-case form without what surrounds its letters, hash of its unveiled form;
    per text its first word's index. Unveiled: signs and digits become the letters they stand for, other signs go, a
    letter repeated counts once. A word without letters has hash 0."""
    starts, stops, first = word_spans(data, offsets)
    letter = np.append(0, np.cumsum(LETTER[data]))
    some = letter[stops] > letter[starts]
    at = np.append(np.flatnonzero(LETTER[data]), 0)
    begin, end = np.where(some, at[np.minimum(letter[starts], len(at) - 1)], starts), np.where(some, at[letter[stops] - 1] + 1, starts)
    low = LOWER[data]
    plain = np.where(some, span_hashes(low, begin, end), np.uint64(0))
    bare = PLAIN[data]
    good = np.flatnonzero(PLAIN_LETTER[data])
    word_of = np.searchsorted(starts, good, "right") - 1
    inner = ~MARK[data[good]] | ((good > begin[word_of]) & (good < end[word_of]))
    good, word_of = good[inner], word_of[inner]
    letters = bare[good]
    new = np.ones(len(good), bool)
    new[1:] = (letters[1:] != letters[:-1]) | (word_of[1:] != word_of[:-1])
    kept = good[new]
    a, b = np.searchsorted(kept, starts), np.searchsorted(kept, stops)
    veiled = np.where(b > a, span_hashes(letters[new], a, b), np.uint64(0))
    return starts, stops, plain, veiled, first


def form_hashes(words: list[str] | tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    _, _, plain, veiled, _ = word_forms(data, np.array([0, len(data)]))
    return plain, veiled


PERSONS = np.sort(form_hashes(SECOND_PERSON)[0])


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the sorted table, and where."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


class Lexicon:
    """Words of toxic texts with the log odds of toxicity: by plain and by unveiled form."""

    def __init__(self, plain: np.ndarray, veiled: np.ndarray, weight: np.ndarray):
        order, (_, once) = np.argsort(plain), np.unique(veiled, return_index=True)
        self.plain, self.weight = plain[order], weight[order]
        self.veiled, self.veiled_weight = veiled[once], weight[once]


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Dense rows (texts x STATISTICS)."""
    docs = len(offsets) - 1
    starts, stops, plain, veiled, first = word_forms(data, offsets)
    words = np.diff(first)
    some, size = np.maximum(words, 1), np.maximum(np.diff(offsets), 1)
    text = np.repeat(np.arange(docs), words)
    per_text = lambda value: np.bincount(text, value, docs)

    def share(flag: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flag))
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    hit, at = _found(lexicon.plain, plain)
    hidden, hidden_at = _found(lexicon.veiled, veiled)
    hidden &= ~hit
    weight = np.zeros(len(plain))
    weight[hit] = lexicon.weight[at[hit]]
    weight[hidden] = lexicon.veiled_weight[hidden_at[hidden]]
    person = _found(PERSONS, plain)[0]
    spots = np.flatnonzero(person)
    away = np.full(len(plain), len(plain) + NEAR, np.int64)  # words to the next word of second person in the same text
    any_hit = np.flatnonzero(hit | hidden)
    if len(spots) and len(any_hit):
        right = np.searchsorted(spots, any_hit)
        for side in (np.minimum(right, len(spots) - 1), np.maximum(right - 1, 0)):
            gap = np.where(text[spots[side]] == text[any_hit], np.abs(spots[side] - any_hit), len(plain) + NEAR)
            away[any_hit] = np.minimum(away[any_hit], gap)
    aimed = away <= NEAR
    hits, covert, pointed = per_text(hit), per_text(hidden), per_text(aimed)
    hardest = np.zeros(docs)
    np.maximum.at(hardest, text, weight)
    letters, uppers = np.append(0, np.cumsum(LETTER[data])), np.append(0, np.cumsum(UPPER[data]))
    signs = np.append(0, np.cumsum(~LETTER[data] & ~SPACE[data]))
    in_word, up = letters[stops] - letters[starts], uppers[stops] - uppers[starts]
    same = np.zeros(len(data), bool)
    same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & LETTER[data[2:]] & (data[2:] < 128)
    thrice = np.append(0, np.cumsum(same))
    double = np.zeros(len(data), bool)
    double[1:] = SIGN[data[1:]] & SIGN[data[:-1]]
    # Signs or digits between letters: more of them than before the first and after the last letter.
    inner = np.zeros(len(starts))
    if len(starts):
        at_letter = np.append(np.flatnonzero(LETTER[data]), 0)
        has = in_word > 0
        a = at_letter[np.minimum(letters[starts], len(at_letter) - 1)]
        b = at_letter[np.maximum(letters[stops] - 1, 0)]
        inner[has] = (signs[b[has]] - signs[a[has]]) > 0
    return np.stack([
        np.log1p(words), np.log1p(hits), hits / some, per_text(weight) / some, hardest, np.log1p(covert), covert / some, np.log1p(pointed), pointed / some,
        per_text(1 / (1.0 + np.minimum(away, 1 << 20)) * (hit | hidden)), per_text(person) / some, share(UPPER[data]), per_text((up == in_word) & (in_word > 1)) / some,
        share(data == ord("!")), share(data == ord("?")), share(SIGN[data]), share(double), per_text(inner) / some, per_text(thrice[stops] > thrice[starts]) / some,
        per_text(in_word == 1) / some, share(DIGIT[data])], 1)


class Model:
    def __init__(self, lexicon: Lexicon, trees: Boosted, spots: np.ndarray, shares: np.ndarray):
        self.lexicon, self.trees, self.spots, self.shares = lexicon, trees, spots, shares

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.logits(features(data, offsets, self.lexicon)), self.spots, self.shares), 0, 1)


def _toxic_words(sample: DataFrame, least: int = 4) -> DataFrame:
    """Words of toxic texts that stand between at least `least` different pairs of neighbours, most of which occur once:
    (plain, veiled, fold, texts, places). Words that merely belong to copies of one text always have the same neighbours."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                _, _, plain, veiled, first = word_forms(data, offsets)
                around = mix(np.append(np.uint64(0), plain[:-1]) * np.uint64(3) + np.append(plain[1:], np.uint64(0))) if len(plain) else plain
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                got = np.unique(np.stack([row.astype(np.uint64), plain, veiled, around]), axis=1)
                fold = np.asarray(part.column(part.schema.get_field_index("fold")))[got[0].astype(np.int64)]
                new = np.append(True, (got[0, 1:] != got[0, :-1]) | (got[1, 1:] != got[1, :-1]))[:got.shape[1]]
                yield pa.RecordBatch.from_arrays([pa.array(got[1].view(np.int64)), pa.array(got[2].view(np.int64)), pa.array(got[3].view(np.int64)), pa.array(fold), pa.array(new.astype(np.int64))],
                                                 names=["plain", "veiled", "around", "fold", "texts"])

    each = sample.filter("toxic = 1").select("text", "fold").mapInArrow(words, "plain long, veiled long, around long, fold int, texts long").filter("plain <> 0")
    places = each.groupBy("plain", "fold", "around").agg(F.min("veiled").alias("veiled"), F.sum("texts").alias("texts"))
    return places.groupBy("plain", "fold").agg(F.min("veiled").alias("veiled"), F.sum("texts").alias("texts"), F.count(F.lit(1)).alias("places")).filter(
        (F.col("places") >= least) & (2 * F.col("places") >= F.col("texts")))


def _clean_texts(sample: DataFrame, candidates: np.ndarray) -> DataFrame:
    """(plain, fold, texts): how many texts that are not toxic hold each candidate; added up per slice before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                _, _, plain, _, first = word_forms(data, offsets)
                known, at = _found(candidates, plain)
                row = np.repeat(np.arange(part.num_rows), np.diff(first))[known]
                pairs = np.unique(np.stack([row, at[known]]), axis=1)
                fold = np.asarray(part.column(part.schema.get_field_index("fold")))[pairs[0]]
                cells, n = np.unique(np.stack([pairs[1], fold]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(candidates[cells[0]].view(np.int64)), pa.array(cells[1].astype(np.int32)), pa.array(n, pa.int64())], names=["plain", "fold", "texts"])

    each = sample.filter("toxic = 0").select("text", "fold").mapInArrow(count, "plain long, fold int, texts long")
    return each.groupBy("plain", "fold").agg(F.sum("texts").alias("texts"))


def _lexicon(rows: list, clean: dict, toxic_texts: int, clean_texts: int, size: int) -> Lexicon:
    """The `size` words whose log odds of toxicity are surely large: 1.5 or more by their lower bound."""
    found: dict[int, list] = {}
    for r in rows:
        line = found.setdefault(r["plain"], [r["veiled"], 0])
        line[1] += r["texts"]
    plain = np.array(list(found), np.int64)
    veiled, t = np.array([v for v, _ in found.values()], np.int64), np.array([n for _, n in found.values()], float)
    c = np.array([clean.get(p, 0) for p in found], float)
    t, c = np.minimum(t, toxic_texts), np.minimum(c, clean_texts)
    odds = np.log((t + 0.5) / (toxic_texts - t + 0.5)) - np.log((c + 0.5) / (clean_texts - c + 0.5))
    least = odds - 1.64 * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    best = np.lexsort((plain, -least))[:size]
    best = best[least[best] >= 1.5]
    return Lexicon(plain[best].view(np.uint64), veiled[best].view(np.uint64), odds[best])


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, size: int = 256, seed: int = 1) -> Model:
    """Fit on labelled documents: labels (doc_id, toxic 0/1), docs (doc_id, text). At most `sample` labelled ids, those of
    the least hash, are used; their texts are written to the shared folder once and their dense rows (21 numbers each)
    come to the driver. The lexicon, at most `size` words, is learned from the same rows; so that the trees do not trust
    it more than it deserves, each half's rows are described by the other half's lexicon while they are fitted, and the
    isotonic curve is fitted to scores of rows that the scoring trees have not seen.

    Several labels of one id count as their rounded mean; several texts of one id count each. Null labels, ids and texts
    are handled: null ids and labels are left out, null text is empty. Without labels every text scores 0.5."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.round(F.avg("toxic")).cast("int").alias("toxic"))
    fold = F.pmod(F.xxhash64(F.lit(seed), F.lit("fold"), "doc_id"), F.lit(2)).cast("int").alias("fold")
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample).select("doc_id", "toxic", fold)
    some = keep(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")  # `sample` rows at most
    n = {(r["toxic"], r["fold"]): r["n"] for r in some.groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = lambda toxic, folds: sum(n.get((toxic, f), 0) for f in folds)
    rows = _toxic_words(some).collect()  # at most the words of `sample` texts that repeat in different places
    candidates = np.unique(np.array([r["plain"] for r in rows], np.int64)).view(np.uint64)
    clean = _clean_texts(some, np.sort(candidates)).collect() if len(candidates) else []

    def lexicon(folds: tuple[int, ...]) -> Lexicon:
        seen: dict[int, int] = {}
        for r in clean:
            if r["fold"] in folds:
                seen[r["plain"]] = seen.get(r["plain"], 0) + r["texts"]
        return _lexicon([r for r in rows if r["fold"] in folds], seen, texts(1, folds), texts(0, folds), size)

    whole, of_other = lexicon((0, 1)), [lexicon((1,)), lexicon((0,))]

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                which = np.asarray(part.column(part.schema.get_field_index("fold")))
                both = [features(data, offsets, lex) for lex in of_other]
                x = np.where(which[:, None] == 0, both[0], both[1])
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("toxic")), pa.array(which),
                                                  pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "toxic", "fold", "x"])

    described = some.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic", "fold").mapInArrow(dense, "doc_id long, toxic int, fold int, x binary")
    got = sorted(described.collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    discard(some)
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float64).reshape(len(got), len(STATISTICS))
    y, fold_of = np.array([r["toxic"] for r in got], float), np.array([r["fold"] for r in got])
    held = np.zeros(len(got))
    for f in (0, 1):
        mine = fold_of == f
        held[mine] = Boosted().fit(x[~mine], y[~mine]).logits(x[mine])
    return Model(whole, Boosted().fit(x, y), *isotonic(held, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of `docs` with `score` double (0 to 1); its other columns pass through, a former `score` gives way. Null
    text is empty; an empty text is scored by its statistics. No shuffle; a text is read once, whole."""
    docs = docs.drop("score")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(data, offsets), pa.float64())], names=[*part.schema.names, "score"])

    return docs.mapInArrow(run, schema)
