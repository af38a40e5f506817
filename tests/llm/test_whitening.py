"""Whitening against plain numpy and exact whole-number sums."""

from __future__ import annotations

import math

import numpy as np
import pytest

from hearthbook.llm import common, whitening
from hearthbook.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(vectors):
    """(deviations, whitened up to sign, shares) of plain lists."""
    rows = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(rows), [sum(c) for c in zip(*rows, strict=True)]
    apart = [[n * x - s for x, s in zip(r, sums, strict=True)] for r in rows]
    centred = np.array([[x / n for x in r] for r in apart])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    return [sum(x * x for x in r) for r in apart], centred @ basis / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()


def grid(rows, ids, column="whitened"):
    by = {(r["vec_id"], r["component"]): r[column] for r in rows}
    last = max(c for _, c in by)
    return np.array([[by[i, c] for c in range(1, last + 1)] for i in ids], float)


def test_whitening_of_the_table(spark):
    table = common.table(spark, SF, "embeddings").collect()
    rows = QUERIES["op12_whitening"](spark, SF).collect()
    ids = [r["vec_id"] for r in table]
    deviation, white, shares = brute([r["embedding"] for r in table])
    found = grid(rows, ids)
    assert found.shape == (len(ids), 32) and {r["n"] for r in rows} == {len(ids)}
    assert np.abs(found * np.sign((found * white[:, :32]).sum(0)) - white[:, :32]).max() < 1e-8
    assert {r["vec_id"]: r["deviation"] for r in rows} == dict(zip(ids, deviation, strict=True))
    assert np.abs(grid(rows, ids[:1], "explained")[0] / shares[:32] - 1).max() < 1e-9
    error = {r["identity_error"] for r in rows}
    assert len(error) == 1 and 0 <= error.pop() < 1e-10


def test_nearly_dependent_directions_keep_their_components(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(-1000, 1000, (4000, 5)) / 64.0
    near = base @ np.array([[1.0], [1], [1], [1], [1]]) + (np.arange(4000) % 500 == 0)[:, None] / 64.0
    vectors = np.hstack([base * 4096, near * 4096 + (rng.random((4000, 1)) < 0.01) / 64.0])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = whitening.whitened(frame.repartition(7)).collect()
    assert max(r["identity_error"] for r in rows) < 1e-6
    _, white, _ = brute(vectors)
    found = grid(rows, range(4000))
    alike = np.abs((found * white).mean(0))
    assert found.shape[1] == 6 and (alike[:5] > 1 - 1e-9).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    kept = [(1, [1.0, 2.0, 0.5]), (2, [1.5, 2.0, 1.0]), (2, [1.5, 2.0, 1.0]), (None, [9.0, 2.0, -1.0]), (5, [3.0]), (6, []), (7, [-0.01, 0.0, 4.0])]
    dropped = [(8, None), (9, [1.0, None, 2.0]), (10, [nan, 1.0, 1.0]), (11, [inf, 1.0, 1.0]), (12, [1e30, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1.0, 7) for i, v in [*dropped, *kept]], "vec_id long, embedding array<float>, whitened double, n int")
    rows = whitening.whitened(frame).collect()
    assert len(rows) == 3 * len(kept) and {r["n"] for r in rows} == {len(kept)}
    padded = [[float(np.float32(c)) for c in v] + [0.0] * (3 - len(v)) for _, v in kept]
    wanted = brute(padded)[0]
    assert sorted(r["deviation"] for r in rows if r["component"] == 1) == sorted(wanted)
    assert {r["vec_id"] for r in rows} == {1, 2, None, 5, 6, 7}
    assert whitening.whitened(frame.limit(0)).count() == 0
    assert whitening.whitened(frame.where("vec_id > 7")).count() == 0
    alike = whitening.whitened(frame.where("vec_id = 2")).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in alike] == [(None, 0.0, None, 0)] * 6
    with pytest.raises(ValueError, match="entries"):
        whitening.whitened(spark.createDataFrame([(1, [0.0] * 5000)], "vec_id long, embedding array<double>"))


def test_directions_without_variance_have_no_value(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(-500, 500, (300, 3)) / 64.0
    vectors = np.hstack([a, a[:, :1], np.full((300, 1), 7.0)])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = whitening.whitened(frame).collect()
    assert [sum(r["whitened"] is None for r in rows if r["component"] == c) for c in range(1, 6)] == [0, 0, 0, 300, 300]
    assert max(r["identity_error"] for r in rows) < 1e-9


def test_deviations_beyond_a_long_are_null():
    basis = whitening.Basis(2**31, np.array([2**31 * 1_000_000], object))
    whole = np.array([[1_000_000 + 2], [1_000_000 + 1]])
    assert whitening.deviations(whole, basis) == [None, 2**62]
