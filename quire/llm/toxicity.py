"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding takes compatibility forms (full-width and mathematical letters and the like) to plain ones, drops invisible characters and
loose combining marks, and maps homoglyphs and, in words that have letters, digit substitutions to Latin letters. Hits
count at word starts; a hit inside an exception phrase does not count. The weighted sum of the hits,
and the same divided by the length in words, go through a logistic function.

The lexicon is a short fixed one plus terms (whole words and word beginnings, for inflected languages)
learned from labels. Fitting uses a bounded sample of labelled rows, SAMPLE of each label at most,
chosen by a hash of doc_id; scoring covers every row and all of its text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import released, written

# Look-alike letters, digits and signs used for letters, the base lexicon with prior weights, exception phrases.
LOOKALIKES = {
    "a": "аαɑᴀ", "b": "ьЬʙƅ", "c": "сϲᴄ", "d": "ԁđᴅɗ", "e": "еεєɛᴇ", "f": "ƒꜰ", "g": "ɡɢցğ", "h": "һнħʜհ", "i": "іιıɩɪї", "j": "јյᴊ", "k": "кκᴋқ",
    "l": "ℓłʟӏ", "m": "мᴍ", "n": "ηпɴող", "o": "оοσօᴏøө", "p": "рρᴘ", "q": "ԛգ", "r": "гʀᴦ", "s": "ѕꜱ", "t": "тτŧᴛ", "u": "υսᴜц", "v": "νѵᴠ", "w": "ԝωᴡш", "x": "хχ", "y": "уγʏү", "z": "ᴢƶ",
}
SUBSTITUTES = str.maketrans("0134578@$!|", "oieastbasil")
LEXICON = {"idiot": 3.0, "moron": 3.0, "stupid": 2.0, "pathetic": 2.0, "worthless": 2.5, "scum": 3.0, "trash": 1.5, "loser": 2.0, "disgusting": 2.0, "clown": 1.5, "imbecile": 3.0, "bastard": 2.5, "retard": 3.0, "vermin": 2.5}
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "circus clown", "sore loser", "clown school")
#: Sample of each label; lengths of word beginnings; least documents and least share of toxic ones for a term; covers wanted of a toxic document.
SAMPLE, PREFIXES, LEAST_DOCS, LEAST_SHARE, COVERS = 4000, range(3, 9), 5, 0.9, 2
THRESHOLD = 0.3
#: Terms that a task holds while it counts them.
TERMS = 50_000

HOMOGLYPHS = str.maketrans({c: latin for latin, those in LOOKALIKES.items() for c in those})
#: Invisible characters (soft hyphen, joiners, direction marks, selectors) and the marks that are put over letters one by one.
UNSEEN = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10), *range(0x300, 0x370)])

_WORD = re.compile(r"[^\W_]+")
_ODD = re.compile(rf"(?<![^\W_])[^\W_]*[0134578@$!|{''.join(LOOKALIKES.values())}][^\s.,;:?\"()]*")
_LETTER = re.compile(r"[^\W\d_]")


def fold(text: str) -> str:
    """Lower case, plain forms, look-alike letters as Latin ones, and digits and signs as letters within words that have letters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(UNSEEN)

    def one(m: re.Match) -> str:
        word = m[0].translate(HOMOGLYPHS)
        bare = word.rstrip("!|$@")  # at the end these are punctuation
        return bare.translate(SUBSTITUTES) + word[len(bare) :] if len(_LETTER.findall(bare)) >= 2 else word

    return _ODD.sub(one, text.lower())


def terms_of(word: str) -> Iterator[str]:
    """The whole word, which ends in a space, and its proper beginnings: a stem counts only where something follows it."""
    yield word + " "
    for n in PREFIXES:
        if len(word) <= n:
            break
        yield word[:n]


@dataclass
class Model:
    weights: dict[str, float]  # a whole word ends in a space
    coefficients: tuple[float, float, float]  # constant, log of the sum, log of the sum per 1,000 words

    @cached_property
    def matcher(self) -> Matcher:
        """Built once in a worker process: a broadcast model is one object there."""
        return Matcher(self.weights)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "coefficients": self.coefficients}

    def score(self, total: float, words: int) -> float:
        z = sum(c * x for c, x in zip(self.coefficients, features(total, words), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def features(total: float, words: int) -> tuple[float, float, float]:
    return 1.0, math.log1p(total), math.log1p(1000 * total / max(words, 1))


class Matcher:
    """Weighted hits of a text."""

    def __init__(self, weights: dict[str, float]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        entries = defaultdict(list)
        for term, w in weights.items():
            entries[term.rstrip(" ")].append((w, term.endswith(" ")))
        for phrase in EXCEPTIONS:
            entries[phrase].append((0.0, True))
        for key, kinds in entries.items():
            self.auto.add_word(key, (key, kinds))
        self.auto.make_automaton()

    def total(self, folded: str) -> float:
        best: dict[int, float] = {}
        safe = []
        for end, (key, kinds) in self.auto.iter(folded):
            start = end - len(key) + 1
            if start and folded[start - 1].isalnum():
                continue
            closed = end + 1 == len(folded) or not folded[end + 1].isalnum()
            for w, whole in kinds:
                if whole != closed:
                    continue
                if w:
                    best[start] = max(w, best.get(start, 0.0))
                else:
                    safe.append((start, end))
        if not safe:
            return sum(best.values())
        safe.sort()
        reach = list(accumulate((b for _, b in safe), max))  # how far the phrases up to each reach
        return sum(w for at, w in best.items() if not ((k := bisect_right(safe, (at, len(folded)))) and reach[k - 1] >= at))


def _text(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """text, toxic of the sampled rows that are not held out, and how many labelled rows a sampled row of each label stands for. Equal texts count once."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = written(known, "toxicity-labels")
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    sample = written(picked[0].union(picked[1]), "toxicity-sample")  # at most 2 * SAMPLE rows, so it may be broadcast
    rows = _text(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic", F.md5("text").alias("digest"))
    rows = written(rows.dropDuplicates(["digest", "toxic"]).select("text", "toxic"), "toxicity-train")
    return rows, {y: max(1.0, n / SAMPLE) for y, n in counts.items()}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, clean, toxic: in how many texts; a term again whenever TERMS others have been counted."""
    found: dict[str, list[int]] = defaultdict(lambda: [0, 0])

    def counted() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([n[0] for n in found.values()], pa.int64()), pa.array([n[1] for n in found.values()], pa.int64())], names=["term", "clean", "toxic"])
        found.clear()
        return out

    for b in batches:
        for text, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for t in {t for w in set(_WORD.findall(fold(text))) for t in terms_of(w)}:
                found[t][y] += 1
            if len(found) > TERMS:
                yield counted()
    if found:
        yield counted()


def choose_terms(covered: dict[str, set[int]], docs: int, cost: dict[str, float]) -> list[str]:
    """Greedy choice of terms until every toxic document is covered COVERS times or no term helps enough documents.

    What a term helps is the toxic documents it covers less its cost, the clean ones it hits, scaled to as many.
    Terms that occur only beside others (in many near copies of one toxic document) help none and stay
    out. Among equals the longest term, which is the most exact, wins.
    """
    need = dict.fromkeys((d for s in covered.values() for d in s), COVERS)
    least, chosen, stems = max(LEAST_DOCS, docs // 200), [], set()
    gain = lambda t: sum(need[d] > 0 for d in covered[t]) - cost[t]
    order = sorted(covered, key=lambda t: (len(t), t), reverse=True)
    queue = [(-gain(t), k, t) for k, t in enumerate(order)]
    heapify(queue)
    while queue:
        _, k, term = heappop(queue)
        stem = term.rstrip(" ")
        if any(stem[:n] in stems for n in range(1, len(stem) + 1)) or any(s.startswith(stem) for s in stems):
            continue  # a longer or shorter form of what is chosen adds nothing
        now = gain(term)
        if now < least:
            continue  # gains only shrink
        if queue and (-now, k) > queue[0][:2]:
            heappush(queue, (-now, k, term))
            continue
        chosen.append(term)
        stems.add(stem)
        for d in covered[term]:
            need[d] -= 1
    return chosen


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton steps."""
    beta, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + penalty, x.T @ (weight * (y - p)) - penalty @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(beta.tolist())


DEFAULT = (-4.0, 1.0, 1.5)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The lexicon and the logistic function. Without toxic or without clean labels: the fixed lexicon and fixed coefficients."""
    rows, stands_for = training_rows(docs, labels)
    base = {w + " ": v for w, v in LEXICON.items()}
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Model(base, DEFAULT)
    counts = rows.mapInArrow(lambda batches: released(_count_terms(batches)), "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = F.col("toxic") / toxic
    good = (F.col("toxic") >= LEAST_DOCS) & (rate / (rate + F.col("clean") / clean) >= LEAST_SHARE)
    listed = {r.term: (r.clean, r.toxic) for r in counts.where(good | F.col("term").isin(*base)).collect()}  # terms of LEAST_DOCS sampled texts or more
    usable = {t for t, (c, n) in listed.items() if n >= LEAST_DOCS}

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({t for w in set(_WORD.findall(fold(text))) for t in terms_of(w) if t in usable}) for text in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["terms"])

    covered: dict[str, set[int]] = defaultdict(set)
    for d, r in enumerate(rows.where("toxic = 1").select("text").mapInArrow(incidence, "terms array<string>").collect()):  # SAMPLE rows at most
        for t in r.terms:
            covered[t].add(d)
    weights = dict(base)
    for t in [*choose_terms(covered, toxic, {t: listed[t][0] * toxic / clean for t in covered}), *(t for t in base if t in listed)]:
        c, n = listed[t]
        weights[t] = max(0.0, math.log((n + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)))
    for t in [t for t, w in weights.items() if w == 0.0]:
        del weights[t]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(weights)
        for b in batches:
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([matcher.total(fold(t)) for t in texts], pa.float64()), pa.array([len(t.split()) for t in texts], pa.int64()), b.column(1)], names=["total", "words", "toxic"])

    data = rows.mapInArrow(measure, "total double, words long, toxic int").collect()  # 2 * SAMPLE rows at most
    x = np.array([features(r.total, r.words) for r in data])
    y = np.array([r.toxic for r in data], float)
    share = {v: stands_for.get(v, 1.0) for v in (0, 1)}
    return Model(weights, _fit(x, y, np.where(y == 1, share[1], share[0])))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, hits (weighted sum) of every row.

    Long texts are scored whole, in linear time. A null text counts as empty; an empty text gets the score of a text without hits. Repeated rows
    each give a row; other columns are ignored; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts = b.column(1).to_pylist()
            totals = [m.matcher.total(fold(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(s, len(t.split())) for s, t in zip(totals, texts, strict=True)], pa.float64()), pa.array(totals, pa.float64())], names=["doc_id", "score", "hits"])

    return _text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, hits double")


def score_corpus(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, with a model learned from the rows that are not held out."""
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold.

    Null and empty texts have no hits and stay; long texts are scored whole, in linear time; rows that repeat a text share its fate;
    ids play no part; columns of any other name stay as they are; an empty table gives an empty one.
    """
    model = learn(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def rate(text: pa.Array) -> pa.Array:
        m = sent.value
        return pa.array([m.score(m.matcher.total(fold(t or "")), len((t or "").split())) for t in text.to_pylist()], pa.float64())

    return docs.where(rate(F.col("text").cast("string")) < THRESHOLD)
