"""Toxicity by multiple-instance learning: sentences are judged, documents carry the labels.

A sentence has a chance p of being toxic, from its words; a document is toxic if one of its
sentences is: 1 - (1 - p1)(1 - p2)... (noisy-or). Only documents have labels, so the weights
are trained through that combination, and the sentence chances then say where the
offending passages are.

Which features count is decided on all documents that may be learnt from: the FEATURES
words and word beginnings whose share of toxic documents is furthest from the mean, in
standard errors. The weights are fitted on a bounded sample of these documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from hearthbook.llm.common import fold_of, map_batches, text_of, texts
from hearthbook.llm.labelled import HELD_OUT_FOLDS, labelled_texts, training_labels

#: Lengths of the word beginnings that are features beside whole words.
STEMS = (4, 5, 6)
#: Features with a weight: the size of the model, and of what is broadcast.
FEATURES = 1024
#: A word must occur in so many labelled documents to count.
LEAST_DOCUMENTS = 3
#: Labelled documents that the weights are fitted on, those of the smallest id hashes.
FIT_DOCUMENTS = 10_000
MEMO = 300_000
STEPS = 150
RATE = 0.1
PENALTY = 1e-3
FIRST_BIAS = -7.0
#: A sentence of this chance or more is reported as offending.
OFFENDING = 0.5

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def sentences(text: str) -> list[tuple[int, int]]:
    """(first, beyond) of each sentence: up to its full stops, marks or line end; blank ones aren't any."""
    return [m.span() for m in _SENTENCE.finditer(text) if not m[0].isspace()]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(word: str) -> list[str]:
    """The word itself, and its first letters (marked *), as endings vary."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)]


def features_of(found: set[str]) -> set[str]:
    return {f for word in found for f in features(word)}


class Features:
    """Finds which of the known features a sentence has; what a word gives is remembered."""

    def __init__(self, known: list[str]):
        self.known = {f: i for i, f in enumerate(known)}
        self.memo: dict[str, tuple[int, ...]] = {}

    def of(self, sentence: str) -> set[int]:
        memo, hits = self.memo, set()
        for word in _WORD.findall(sentence.lower()):
            found = memo.get(word)
            if found is None:
                found = tuple(self.known[f] for f in features(word) if f in self.known)
                if len(memo) >= MEMO:
                    memo.clear()
                memo[word] = found
            if found:
                hits.update(found)
        return hits


class Weights:
    def __init__(self, known: list[str], values: np.ndarray, bias: float):
        self.features = Features(known)
        self.values = list(map(float, values))
        self.bias = float(bias)

    def judge(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's chance, and its offending sentences with theirs."""
        values, bias = self.values, self.bias
        total, bad, plain = 0.0, [], 0
        for first, beyond in sentences(text):
            hits = self.features.of(text[first:beyond])
            if not hits:
                plain += 1
                continue
            z = bias + sum(values[i] for i in sorted(hits))
            total += _softplus(z)
            if z >= 0 and (p := _chance(z)) >= OFFENDING:
                bad.append((first, beyond, p))
        total += plain * _softplus(bias)
        return -math.expm1(-total), bad


def _chance(z: float) -> float:
    return 1.0 / (1.0 + math.exp(-z)) if z >= 0 else math.exp(z) / (1.0 + math.exp(z))


def _softplus(z: float) -> float:
    """-log(1 - p)."""
    return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))


def telling_features(sample: DataFrame, limit: int = FEATURES) -> list[str]:
    """The features that tell most, from the document counts of each in all rows of (text, label).

    They are counted within each batch before the shuffle. At most `limit` come back.
    """
    wanted = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic: Counter[str] = Counter()
            every: Counter[str] = Counter()
            for text, label in zip(texts(batch), batch.column("label").to_pylist(), strict=True):
                found = features_of(set(words(text)))
                every.update(found)
                if label:
                    toxic.update(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(every)), pa.array([toxic[w] for w in every], pa.int64()), pa.array(list(every.values()), pa.int64())],
                schema=wanted,
            )

    total = sample.agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("toxic")).first()
    if not total["n"] or not total["toxic"] or total["toxic"] == total["n"]:
        return []
    mean = total["toxic"] / total["n"]
    counts = (
        sample.select("text", "label").mapInArrow(run, "word string, toxic long, n long")
        .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    )
    score = F.abs(F.col("toxic") - F.col("n") * mean) / F.sqrt(F.col("n") * mean * (1 - mean) + 1)
    rows = counts.orderBy(score.desc(), "word").limit(limit).select("word").collect()
    return sorted(r["word"] for r in rows)


def fit(docs: DataFrame, labels: DataFrame, name: str = "toxic", limit: int = FIT_DOCUMENTS) -> Weights:
    """The weights; without labels of both kinds every document has the same small chance per sentence."""
    known = training_labels(labels, name)
    vocabulary = telling_features(labelled_texts(docs, known))
    if not vocabulary:
        return Weights([], np.zeros(0), FIRST_BIAS)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def per_batch(batch: pa.RecordBatch) -> dict:
        known = Features(shared.value)
        bags, plain = [], []
        for text in texts(batch):
            bag, none = [], 0
            for first, beyond in sentences(text):
                hits = sorted(known.of(text[first:beyond]))
                bag += [*hits, -1] if hits else []
                none += not hits
            bags.append(bag)
            plain.append(none)
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "bag": bags, "plain": plain}

    made = map_batches(labelled_texts(docs, F.broadcast(chosen)), per_batch, "doc_id long, label int, bag array<int>, plain long")
    rows = sorted(made.collect(), key=lambda r: r["doc_id"])  # up to `limit` bags of places
    return Weights(vocabulary, *_train(rows, len(vocabulary)))


def _train(rows: list, size: int) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the noisy-or likelihood. A bag is places, with -1 after each sentence."""
    flat = np.array([x for r in rows for x in r["bag"]], np.int64)
    ends = flat < 0
    sentence = np.cumsum(ends) - ends
    place, of = flat[~ends], sentence[~ends]
    count = int(ends.sum())
    bag_of = np.repeat(np.arange(len(rows)), [sum(x < 0 for x in r["bag"]) for r in rows])
    plain = np.array([r["plain"] for r in rows], np.float64)
    y = np.array([r["label"] for r in rows], np.float64)
    step = np.zeros(size + 1)
    weights = np.zeros(size + 1)
    weights[size] = FIRST_BIAS
    square = np.zeros(size + 1)
    for t in range(1, STEPS + 1):
        bias = weights[size]
        z = bias + np.bincount(of, weights[place], count)
        total = np.bincount(bag_of, np.logaddexp(0, z), len(rows)) + plain * np.logaddexp(0, bias)
        total = np.maximum(total, 1e-9)
        slope = np.where(y > 0, -1.0 / np.expm1(np.minimum(total, 50.0)), 1.0)
        by_sentence = slope[bag_of] / (1 + np.exp(-z))
        grad = np.empty(size + 1)
        grad[:size] = np.bincount(place, by_sentence[of], size)
        grad[size] = by_sentence.sum() + (slope * plain).sum() / (1 + math.exp(-bias))
        grad /= len(rows)
        grad[:size] += PENALTY * weights[:size] / 10
        step = 0.9 * step + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        weights -= RATE * (step / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return weights[:size], weights[size]


def scored(docs: DataFrame, weights: Weights) -> DataFrame:
    """docs with score (0 to 1; 0 without sentences) and the places of offending sentences.

    offending_first and offending_beyond are code points, in order. Null texts count as empty.
    Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    new = [
        StructField("score", DoubleType()), StructField("offending_first", ArrayType(LongType())),
        StructField("offending_beyond", ArrayType(LongType())),
    ]
    rows = docs.drop(*[f.name for f in new])
    fields = rows.schema.fieldNames()

    def per_batch(batch: pa.RecordBatch) -> dict:
        found = [shared.value.judge(t) for t in texts(batch)]
        return {name: batch.column(name) for name in fields} | {
            "score": [min(max(p, 0.0), 1.0) for p, _ in found],
            "offending_first": [[a for a, _, _ in bad] for _, bad in found],
            "offending_beyond": [[b for _, b, _ in bad] for _, bad in found],
        }

    return map_batches(rows, per_batch, StructType([*rows.schema.fields, *new]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_offending, offending_first, offending_beyond) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return scored(rows, fit(docs, labels)).select(
        "doc_id", (fold_of(HELD_OUT_FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        F.size("offending_first").cast("long").alias("n_offending"), "offending_first", "offending_beyond",
    )
