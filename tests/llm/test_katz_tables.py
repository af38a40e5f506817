"""The stored back-off model of order 3 against plain recursion."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hearthbook.llm import common, katz, katz_tables

SF = "/root/testdata/sf0.001"


class Brute:
    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order)]
        for text in texts:
            padded = ["<s>"] * (order - 1) + self.tokens(text)
            for n in range(1, order + 1):
                self.counts[n - 1].update(tuple(padded[i - n + 1 : i + 1]) for i in range(order - 1, len(padded)))
        self.d = [katz.discounts(Counter(c.values())) for c in self.counts]
        self.total = sum(self.counts[0].values())
        self.unknown = 1 - sum(self.keep(0, r) for r in self.counts[0].values()) / self.total if self.total else 1.0
        self.size, self.followers = Counter(), defaultdict(list)
        for n in range(1, order):
            for gram, r in self.counts[n].items():
                self.size[gram[:-1]] += r
                self.followers[gram[:-1]].append(gram[-1])

    @staticmethod
    def tokens(text):
        return [*(text or "").encode().lower().split(), "</s>"]

    def keep(self, n, r):
        return (self.d[n][r] if r <= katz.K else 1 - katz.TAIL) * r

    def chance(self, context, word):
        n = len(context)
        r = self.counts[n][(*context, word)]
        if n == 0:
            return self.keep(0, r) / self.total if r else self.unknown
        if r:
            return self.keep(n, r) / self.size[context]
        if not self.size[context]:
            return self.chance(context[1:], word)
        left = 1 - sum(self.keep(n, self.counts[n][(*context, w)]) for w in self.followers[context]) / self.size[context]
        covered = sum(self.chance(context[1:], w) for w in self.followers[context])
        return left / (1 - covered) * self.chance(context[1:], word)

    def score(self, text):
        padded = ["<s>"] * (self.order - 1) + self.tokens(text)
        return sum(math.log10(self.chance(tuple(padded[i - self.order + 1 : i]), padded[i])) for i in range(self.order - 1, len(padded)))


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@pytest.fixture(scope="module")
def some(spark):
    return common.table(spark, SF, "documents").where(F.length("text") < 2500).limit(70).select("doc_id", "text").cache()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_stored_model_scores_as_plain_recursion(spark, some, tmp_path, order):
    rows = {r["doc_id"]: r["text"] for r in some.collect()}
    brute = Brute([t for i, t in rows.items() if not held_out(i)], order)
    path = str(tmp_path / "model")
    katz_tables.train(some, path, order)
    found = {r["doc_id"]: r for r in katz_tables.scored(some, path).collect()}
    assert set(found) == set(rows)
    for i, text in rows.items():
        words = Brute.tokens(text)
        assert (found[i]["held_out"], found[i]["n_tokens"]) == (held_out(i), len(words))
        assert found[i]["n_known"] == sum(brute.counts[0][(w,)] > 0 for w in words)
        assert found[i]["score"] == pytest.approx(brute.score(text), rel=1e-9)
    # a table that the model has not seen, with nulls, repeated rows and words it doesn't know
    other = [(None, None), (1, ""), (1, ""), (2, "never SEEN words"), (3, next(iter(rows.values()))[:300])]
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in other], "doc_id long, text string, score double")
    scores = sorted(r["score"] for r in katz_tables.scored(frame, path).collect())
    assert scores == pytest.approx(sorted(brute.score(t) for _, t in other), rel=1e-9)
    assert katz_tables.scored(frame.limit(0), path).count() == 0


def test_weights_are_normalised(spark, some, tmp_path):
    rows = {r["doc_id"]: r["text"] for r in some.collect()}
    brute = Brute([t for i, t in rows.items() if not held_out(i)], 3)
    words = [w for (w,) in brute.counts[0]]
    for context in list(brute.followers)[:6]:
        assert sum(brute.chance(context, w) for w in words) + brute.chance(context, "never") == pytest.approx(1)


def test_order_two_is_the_packed_model(spark, tmp_path):
    docs = common.table(spark, SF, "documents")
    path = str(tmp_path / "model")
    katz_tables.train(docs, path, 2)
    found = {r["doc_id"]: r["score"] for r in katz_tables.scored(docs, path).collect()}
    packed = {r["doc_id"]: r["score"] for r in katz.scores(docs).collect()}
    assert found.keys() == packed.keys() and all(found[i] == pytest.approx(packed[i], rel=1e-9) for i in found)


def test_a_model_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    path = str(tmp_path / "model")
    katz_tables.train(empty, path, 3)
    one = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert [(r["score"], r["n_tokens"], r["n_known"]) for r in katz_tables.scored(one, path).collect()] == [(0.0, 3, 0)]
