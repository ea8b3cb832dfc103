"""Toxicity by a counterfactual-regularised linear classifier.

Method: logistic regression over which words and word beginnings a text holds, with a penalty on the
squared change of the score between counterfactuals, so that a neutral mention of a group moves no
score. For a labelled text with identity terms, every such term is swapped for others of its group.
As few texts hold such terms, each labelled text also gets a term (group and term by a hash of the
text) inserted: with it against without it, and with it against another of its group in its place.
``mention_changes`` reports score changes on neutral sentences, ``false_positives`` how many clean
documents each inserted term gets flagged.

The fit uses a bounded sample of labelled rows: about TRAIN_DOCUMENTS by a hash of doc_id, never
rows of the held-out fold (crc32 of doc_id as text modulo FOLDS equal to HELD_OUT). Frequencies
for the choice of features are counted by Spark over that sample. Every text is scored whole;
labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts get the score of a text without features; null ids are not
held out; labels that are null count for nothing, several labels of a doc_id as their largest;
without two classes to learn from every score is the share of toxic labels (0 without any);
repeated rows get a row each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, texts_of

FOLDS, HELD_OUT = 4, 2
TRAIN_DOCUMENTS = 12_000
MAX_FEATURES = 4096
#: Sample documents that hold a feature, and its chi-squared against the labels, at least.
LEAST_DOCUMENTS = 3
LEAST_SIGNAL = 20.0
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.3
RIDGE, COUNTERFACTUAL = 0.2, 50.0

#: Identity terms by group (fixed values); terms of a group are swapped for each other.
IDENTITIES = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "citizens", "refugees"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
_WORD = re.compile(r"\w+")
_OTHERS = {term: [t for t in group if t != term] for group in IDENTITIES for term in group}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def word_features(word: str) -> tuple[str, ...]:
    """The word itself, and its beginnings (marked with a closing tilde)."""
    return (word, *(word[:n] + "~" for n in PREFIXES if len(word) > n))


def text_features(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in word_features(w)}


def counterfactuals(text: str) -> list[str]:
    """The text with its identity terms swapped, one text for each other place in the groups; none without such terms."""
    words = set(_WORD.findall(text.lower())) & _OTHERS.keys()
    most = max((len(_OTHERS[w]) for w in words), default=0)
    return [_WORD.sub(lambda m: others[k % len(others)] if (others := _OTHERS.get(m.group().lower())) else m.group(), text) for k in range(most)]


def inserted(text: str) -> tuple[str, str]:
    """The identity term that the text gets, and another of its group."""
    h = crc32(text.encode("utf-8", "surrogatepass"))
    group = IDENTITIES[h % len(IDENTITIES)]
    k = h // len(IDENTITIES) % len(group)
    return group[k], group[(k + 1) % len(group)]


def changes(text: str, number: dict[str, int]) -> Iterator[dict[int, float]]:
    """Differences in features between the text's counterfactuals: 1 where only the one has a feature, -1 where only the other."""
    numbered = lambda features: {number[f] for f in features if f in number}
    own = numbered(text_features(text))
    pairs = [(numbered(text_features(other)), own) for other in counterfactuals(text)]
    one, other = (own | numbered(word_features(term)) for term in inserted(text))
    for a, b in [*pairs, (one, own), (one, other)]:
        if a != b:
            yield {f: 1.0 for f in sorted(a - b)} | {f: -1.0 for f in sorted(b - a)}


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
            for f in text_features(text):
                counts.setdefault(f, [0, 0])[toxic] += 1
        yield pa.record_batch([pa.array(counts.keys(), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], names=["feature", "clean", "toxic"])


class Model:
    """Weights by feature and an intercept."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._by_word: dict[str, tuple[str, ...]] = {}

    def score(self, text: str) -> float:
        held: set[str] = set()
        known, weights = self._by_word, self.weights
        for word in set(_WORD.findall(text.lower())):
            own = known.get(word)
            if own is None:
                if len(known) > 300_000:
                    known.clear()
                own = known[word] = tuple(f for f in word_features(word) if f in weights)
            held.update(own)
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(map(weights.__getitem__, sorted(held))), -30, 30))))


class _Rows:
    """A sparse 0/1 matrix (or differences of two), enough for products with vectors."""

    def __init__(self, rows: list[dict[int, float]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.array([c for r in rows for c in r], np.int64)
        self.value = np.array([v for r in rows for v in r.values()], np.float64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], self.width)


def fit_weights(held: list[set[int]], toxic: np.ndarray, swapped: list[dict[int, float]], width: int, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Ridge logistic regression with the counterfactual penalty, by Adam steps on the whole sample."""
    x, change = _Rows([dict.fromkeys(sorted(h), 1.0) for h in held], width), _Rows(swapped, width)
    mean = toxic.mean()
    w, bias = np.zeros(width + 1), float(np.log(mean / (1 - mean)))
    w[-1] = bias
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        error = 1 / (1 + np.exp(-np.clip(x.times(w[:-1]) + w[-1], -30, 30))) - toxic
        g = np.append(x.back(error) + RIDGE * w[:-1], error.sum())
        if change.n:
            g[:-1] += 2 * COUNTERFACTUAL * change.back(change.times(w[:-1]))
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= 0.05 * (1 - t / (rounds + 1)) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    every = max(1, labels.count() // TRAIN_DOCUMENTS)
    # At most twice TRAIN_DOCUMENTS rows of two numbers: small enough to send to every executor.
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).limit(2 * TRAIN_DOCUMENTS)
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic"))
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not clean or not toxic:
        return Model({}, -30.0 if not toxic else 30.0)

    counts = rows.mapInArrow(_feature_counts, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = F.col("toxic") / toxic - F.col("clean") / clean
    rate = (F.col("toxic") + F.col("clean")) / (clean + toxic)
    chosen = counts.where(F.col("toxic") + F.col("clean") >= LEAST_DOCUMENTS).withColumn("signal", share * share / (rate * (1 - rate) + 1e-9) * (clean * toxic / (clean + toxic))).where(F.col("signal") >= LEAST_SIGNAL).orderBy(F.desc("signal"), "feature").limit(MAX_FEATURES)
    names = sorted({r.feature for r in chosen.select("feature").collect()} | {f for t in _OTHERS for f in word_features(t)})
    number = {f: k for k, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held, changed = [], []
            for text in texts_of(batch):
                held.append(sorted(number[f] for f in text_features(text) if f in number))
                changed.append([[int(v * (f + 1)) for f, v in row.items()] for row in changes(text, number)])  # the sign tells which side has the feature
            yield pa.record_batch([batch.column("toxic"), pa.array(held, pa.list_(pa.int32())), pa.array(changed, pa.list_(pa.list_(pa.int32())))], names=["toxic", "held", "changed"])

    got = rows.mapInArrow(run, "toxic int, held array<int>, changed array<array<int>>").collect()
    got.sort(key=lambda r: (r.held, r.toxic))
    swapped = [{abs(f) - 1: 1.0 if f > 0 else -1.0 for f in row} for r in got for row in r.changed]
    weights, bias = fit_weights([set(r.held) for r in got], np.array([r.toxic for r in got], np.float64), swapped, len(names))
    return Model({f: float(w) for f, w in zip(names, weights) if w}, bias)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(map(model.score, texts_of(batch)), pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


#: Neutral sentences, a term in each place.
NEUTRAL = ("we met the {} family at the market", "a {} group opened a new school", "the {} people of the town sang", "she wrote about {} neighbours")


def mention_changes(model: Model) -> list[tuple[str, float]]:
    """Each identity term, and by how much it changes the score of a neutral sentence at most."""
    return [(term, max(abs(model.score(s.format(term)) - model.score(s.format(""))) for s in NEUTRAL)) for group in IDENTITIES for term in group]


def false_positives(docs: DataFrame, labels: DataFrame, model: Model) -> DataFrame:
    """term, clean, flagged and flagged_without: of the documents labelled clean (no label is used but this), how many are flagged with the term put before the text, and as they are."""
    clean = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic = 0").select("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = list(_OTHERS)
        for batch in slices(batches):
            texts = texts_of(batch)
            without = sum(model.score(t) >= THRESHOLD for t in texts)
            flagged = [sum(model.score(f"{term} {t}") >= THRESHOLD for t in texts) for term in terms]
            yield pa.record_batch([pa.array(terms), pa.array([len(texts)] * len(terms), pa.int64()), pa.array(flagged, pa.int64()), pa.array([without] * len(terms), pa.int64())], names=["term", "clean", "flagged", "flagged_without"])

    counted = docs.select("doc_id", "text").join(clean, "doc_id").select("text").mapInArrow(run, "term string, clean long, flagged long, flagged_without long")
    return counted.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("clean", "flagged", "flagged_without")))
