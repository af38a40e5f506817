"""Quality by nearest neighbours among labelled documents in a latent-semantic space.

A document is a vector of hashed word features with tf-idf weights. Document frequencies are
counted over all documents. A bounded sample of labelled documents gives, by truncated
singular value decomposition, the latent directions; the latent vectors and labels of that
sample are broadcast. Every document is compared with every one of them, in blocks of one
matrix product, and its nearest neighbours vote with the power of their similarity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType

from hearthbook.llm.common import fold_of, map_batches, remembered, spare_name, text_of, texts
from hearthbook.llm.labelled import HELD_OUT_FOLDS, labelled_texts, training_labels

#: Labelled documents that are compared with: those of the smallest id hashes. With DIMENSIONS
#: floats each they are what is broadcast, 1 MB, whatever the tables' size.
LABELLED = 4096
FEATURES = 2048
DIMENSIONS = 48
NEIGHBOURS = 25
POWER = 8.0
#: Steps of a similarity; products are of double precision.
STEPS = 1e9
BLOCK = 512
#: Words that a worker remembers, and those of a text that it looks at in one go.
MEMO, WORDS = 400_000, 200_000

_SHAPE = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|[^\x00-\x7f]+")


def _shape(word: str) -> str:
    """A word's form: A, a, 9 and u for runs of capitals, small letters, digits and others."""
    if word.isascii() and word.isalpha():  # most words, without the pattern
        if word.islower():
            return "a"
        if word.isupper():
            return "A"
        if word[0].isupper() and word[1:].islower():
            return "Aa"
    return _SHAPE.sub(lambda m: "A" if m[0][0] <= "Z" and m[0][0] >= "A" else "a" if "a" <= m[0][0] <= "z" else "9" if m[0][0].isascii() else "u", word)[:12]


def _place(name: str, before: int = 0) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass"), before) % FEATURES


_SAME = _place("\x00same as the word before")
_WORD, _ENDING, _FORM = (zlib.crc32(kind) for kind in (b"w", b"e", b"s"))


def _word_features(word: str) -> tuple[int, int, int]:
    """Places of the word itself, of its ending and of its form."""
    low = word.lower()
    return _place(low, _WORD), _place(low[-3:], _ENDING), _place(_shape(word), _FORM)


class _Known(dict):
    """The row of each word in a table of places."""

    def __init__(self):
        self.places = np.zeros((MEMO, 3), np.int16)

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.places[row] = _word_features(word)
        return row


def counts(text: str) -> np.ndarray:
    """How often each feature occurs in the whole text."""
    words = text.split()
    out = np.zeros(FEATURES, np.float32)
    known: _Known = remembered(("quality_knn",), _Known)
    for at in range(0, len(words), WORDS):
        part = words[at : at + WORDS]
        if len(known) + len(part) > MEMO:
            known.clear()
        rows = np.fromiter(map(known.__getitem__, part), np.int32, len(part))
        out += np.bincount(known.places[rows].ravel(), minlength=FEATURES)
        out[_SAME] += np.count_nonzero(rows[1:] == rows[:-1]) + (at > 0 and words[at - 1] == words[at])
    return out


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each feature occurs, and their number.

    Summed per batch in the tasks, then per feature: FEATURES rows reach the driver.
    """
    wanted = pa.schema([("feature", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for text in texts(batch):
                seen[:FEATURES] += counts(text) > 0
                seen[FEATURES] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1, dtype=np.int32)), pa.array(seen)], schema=wanted)

    rows = docs.select(text_of().alias("text")).mapInArrow(run, "feature int, n long")
    totals = np.zeros(FEATURES + 1, np.int64)
    for feature, n in rows.groupBy("feature").agg(F.sum("n")).collect():
        totals[feature] = n
    return totals[:FEATURES], int(totals[FEATURES])


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    made = np.log1p(rows, dtype=np.float64) * idf
    return made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)


def latent_directions(matrix: np.ndarray, dimensions: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    size = min(dimensions, *matrix.shape)
    start = np.random.default_rng(5).standard_normal((matrix.shape[1], min(size + 8, matrix.shape[1]))).astype(np.float32)
    basis = np.linalg.qr(start)[0]
    for _ in range(6):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    _, _, right = np.linalg.svd(matrix @ basis, full_matrices=False)
    return (basis @ right.T)[:, :size].astype(np.float64)


def votes(latent: np.ndarray, known: np.ndarray, labels: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """For each row of latent, the labels of its nearest rows of known, weighted by similarity.

    Both sides have length 1 or 0; nothing similar to anything gets the mean label. Similarities count
    in STEPS of one, far more than what the order of a matrix product's sums can change, so that equal
    texts have equal scores in any block. Ties at the last place go to the earlier rows of known.
    """
    if not len(known):
        return np.full(len(latent), 0.5)
    near = np.rint((latent @ known.T) * STEPS)
    k = min(neighbours, len(known))
    best = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < len(known) else np.tile(np.arange(k), (len(near), 1))
    last = np.take_along_axis(near, best, axis=1).min(axis=1)
    for i in np.flatnonzero((near >= last[:, None]).sum(axis=1) > k):  # ties at the last place
        best[i] = np.argsort(-near[i], kind="stable")[:k]
    best.sort(axis=1)  # sums in one order
    weight = (np.maximum(np.take_along_axis(near, best, axis=1), 0) / STEPS) ** POWER
    total = weight.sum(axis=1)
    share = (weight * labels[best]).sum(axis=1) / np.where(total > 0, total, 1.0)
    return np.where(total > 0, np.clip(share, 0.0, 1.0), labels.mean())


class Model:
    def __init__(self, idf: np.ndarray, directions: np.ndarray, known: np.ndarray, labels: np.ndarray):
        self.idf, self.directions, self.known, self.labels = idf, directions, known, labels

    def latent(self, rows: np.ndarray) -> np.ndarray:
        made = weighted(rows, self.idf) @ self.directions
        return made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)

    def score(self, batch: list[str]) -> np.ndarray:
        out = [
            votes(self.latent(np.stack([counts(t) for t in batch[at : at + BLOCK]])), self.known, self.labels)
            for at in range(0, len(batch), BLOCK)
        ]
        return np.concatenate(out) if out else np.empty(0)


def fit(docs: DataFrame, labels: DataFrame, name: str = "quality", limit: int = LABELLED) -> Model:
    """The model from up to `limit` labelled documents outside fold 0; without any, all scores are 0.5."""
    chosen = training_labels(labels, name).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    sample = labelled_texts(docs, F.broadcast(chosen))

    def per_batch(batch: pa.RecordBatch) -> dict:
        rows = [counts(t) for t in texts(batch)]
        return {
            "doc_id": batch.column("doc_id"), "label": batch.column("label"),
            "places": [np.flatnonzero(r).astype(np.int32) for r in rows],
            "times": [r[r > 0] for r in rows],
        }

    made = map_batches(sample, per_batch, "doc_id long, label int, places array<int>, times array<float>")
    rows = sorted(made.collect(), key=lambda r: r["doc_id"])  # up to `limit` rows of FEATURES numbers at most
    seen, total = document_frequencies(docs)
    idf = np.log((1.0 + total) / (1.0 + seen)).astype(np.float32) + np.float32(0.1)
    if not rows:
        return Model(idf, np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    matrix = np.zeros((len(rows), FEATURES), np.float32)
    for i, row in enumerate(rows):
        matrix[i, row["places"]] = row["times"]
    directions = latent_directions(weighted(matrix, idf).astype(np.float32), DIMENSIONS)
    model = Model(idf, directions, np.zeros((0, 1), np.float32), np.array([r["label"] for r in rows], np.float64))
    model.known = model.latent(matrix)
    return model


def scored(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 in one more column; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop(out)
    fields = rows.schema.fieldNames()

    def per_batch(batch: pa.RecordBatch) -> dict:
        return {name: batch.column(name) for name in fields} | {out: shared.value.score(texts(batch))}

    return map_batches(rows, per_batch, StructType([*rows.schema.fields]).add(out, DoubleType()))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return scored(rows, fit(docs, labels)).select(
        "doc_id", (fold_of(HELD_OUT_FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def of_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score threshold or more."""
    name = spare_name(docs, "quality_score")
    return scored(docs, fit(docs, labels), name).where(F.col(name) >= threshold).drop(name)
