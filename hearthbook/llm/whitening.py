"""Whitening of embeddings by shifted Cholesky QR.

Rows are made whole numbers, centred, and orthogonalised in passes over all of them. A pass sums
the Gram matrix of the rows as they are so far, factors it by Cholesky, and the factor is applied to
the rows of the next pass by a triangular solve. The first pass shifts the matrix, so that it has a
factor however nearly some directions depend on each other; two more make the rows orthogonal to
double precision. The factors of all passes multiply to the R of the centred rows, and the SVD of
R gives the components without ever squaring the condition of the data.

Only sums of as many numbers as a matrix of dimensions by dimensions has go through the driver, and
such matrices are all that tasks get from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Entries are multiplied by SCALE, cut to whole numbers, and moved up by LIFT.
SCALE, LIFT = 64, 1_000_000
#: Components asked for at most, and passes of the orthogonalisation.
COMPONENTS, PASSES = 32, 3
#: Vectors longer than this are refused: matrices of that width go to every task.
MOST_DIMENSIONS = 4096
#: Entries that give no whole number of double precision are no numbers.
_LARGEST = 2.0**46
_ROWS = 4096
_EPS = float(np.finfo(float).eps)


@dataclass
class Basis:
    """What the passes have found: sums of the fit list, factors so far, and the components."""

    n: int
    sums: np.ndarray
    factors: list[np.ndarray] = field(default_factory=list)
    vectors: np.ndarray | None = None
    values: np.ndarray | None = None
    rank: int = 0

    def centred(self, whole: np.ndarray) -> np.ndarray:
        """Rows less their mean. The lift goes first, so that the rest is small and keeps its digits."""
        mean = np.array([float(s - self.n * LIFT) for s in self.sums.tolist()]) / self.n
        return (whole - LIFT).astype(float) - mean

    def orthogonal(self, rows: np.ndarray) -> np.ndarray:
        for factor in self.factors:
            rows = solved(rows, factor)
        return rows

    def whitened(self, centred: np.ndarray, count: int) -> np.ndarray:
        """The first count components of centred rows, each of variance one; NaN beyond the rank."""
        found = np.full((len(centred), count), np.nan)
        last = min(count, self.rank)
        found[:, :last] = centred @ self.vectors[:, :last] / np.sqrt(self.values[:last])
        return found


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows @ inv(factor) for an upper triangular factor, column by column."""
    found = np.empty_like(rows)
    for j in range(rows.shape[1]):
        found[:, j] = (rows[:, j] - found[:, :j] @ factor[:j, j]) / factor[j, j]
    return found


def whole_rows(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number rows of the vectors that count, and which ones these are.

    A vector doesn't count if it is null or has a null, non-finite or immensely large entry. One of
    fewer than width entries goes on with zeros.
    """
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    kept = lengths >= 0
    flat = vectors.flatten()
    entries = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), float)
    rows = np.zeros((int(kept.sum()), width))
    inside = np.arange(width) < lengths[kept][:, None]
    rows[inside] = entries
    good = (np.isfinite(rows) & (np.abs(rows) < _LARGEST)).all(axis=1)
    at = np.flatnonzero(kept)[good]
    return np.floor(rows[good] * SCALE).astype(np.int64) + LIFT, at


def _per_task(vectors: DataFrame, width: int, make, rows: int) -> DataFrame:
    """(i, j, total): the sums over all rows of make(whole rows), a list of matrices stacked in order of i."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("total", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                whole, _ = whole_rows(batch.column("vector").slice(at, rows), width)
                part = make(whole)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], schema=schema)

    return vectors.mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))


def _matrix(sums: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sums as a matrix; shape bounds what is collected."""
    found = np.zeros(shape)
    cells = sums.toArrow()
    found[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("total").to_numpy()
    return found


def counted(vectors: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """How many vectors count, and the exact sum of each entry's whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(width, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                whole, _ = whole_rows(batch.column("vector").slice(at, _ROWS), width)
                n += len(whole)
                sums += whole.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([n, *sums.tolist()], pa.int64())], names=["j", "total"])

    rows = vectors.mapInArrow(run, "j int, total long").groupBy("j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {r["j"]: int(r["total"]) for r in rows}
    return found.get(-1, 0), np.array([found.get(j, 0) for j in range(width)], object)


def fitted(vectors: DataFrame, width: int, passes: int = PASSES) -> Basis:
    """The components of vectors (vec_id, vector) of up to width entries, by shifted Cholesky QR."""
    n, sums = counted(vectors, width)
    basis = Basis(n, sums)
    if not n:
        return basis
    for turn in range(passes):
        gram = _matrix(
            _per_task(vectors, width, lambda whole, b=basis: (q := b.orthogonal(b.centred(whole))).T @ q, _ROWS), (width, width)
        )
        if not gram.any():  # all rows are alike
            basis.vectors, basis.values = np.eye(width), np.zeros(width)
            return basis
        basis.factors.append(cholesky(gram, n, shifted=turn == 0))
    product = np.eye(width)
    for factor in basis.factors:
        product = factor @ product
    _, singular, rows = np.linalg.svd(product)
    basis.vectors, basis.values = rows.T, singular**2 / n
    basis.rank = int((singular > singular[0] * max(n, width) * _EPS).sum()) if singular[0] > 0 else 0
    return basis


def cholesky(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """An upper triangular R with R'R = gram, plus a shift of the rounding errors' size if need be."""
    width = len(gram)
    norm = float(np.linalg.norm(gram, 2))
    shift = 11 * (n * width + width * (width + 1)) * _EPS / 2 * norm if shifted else 0.0
    shift = min(shift, norm * 1e-3)
    while True:
        try:
            return np.linalg.cholesky((gram + gram.T) / 2 + shift * np.eye(width)).T
        except np.linalg.LinAlgError:  # directions without variance
            shift = max(shift * 10, width * _EPS * norm)


def identity_error(vectors: DataFrame, width: int, basis: Basis, count: int) -> float | None:
    """The largest entry of the covariance of the whitened rows less the identity; None without any rows or variance."""
    count = min(count, basis.rank)
    if not count:
        return None
    sums = _per_task(vectors, width, lambda whole: basis.whitened(basis.centred(whole), count).sum(axis=0, keepdims=True), _ROWS)
    mean = _matrix(sums, (1, count)) / basis.n

    def gram(whole: np.ndarray) -> np.ndarray:
        rows = basis.whitened(basis.centred(whole), count) - mean
        return rows.T @ rows

    return float(np.abs(_matrix(_per_task(vectors, width, gram, _ROWS), (count, count)) / basis.n - np.eye(count)).max())


def deviations(whole: np.ndarray, basis: Basis) -> list[int | None]:
    """Of each row, the sum of (n * x - S)**2, exact; None where that is more than a long holds."""
    if not len(whole):
        return []
    small = [s - basis.n * LIFT for s in basis.sums.tolist()]
    reach = basis.n * int(np.abs(whole - LIFT).max()) + max(map(abs, small))
    if reach * reach * whole.shape[1] < 2**63:
        apart = (whole - LIFT) * basis.n - np.array(small, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    found = [sum((basis.n * x - s) ** 2 for x, s in zip(row, small, strict=True)) for row in (whole - LIFT).tolist()]
    return [x if x < 2**63 else None for x in found]


def whitened(
    embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding", passes: int = PASSES
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector that counts and each component.

    Vectors that are null or hold null, non-finite or immense (2**46 and more) entries are left out. Vectors
    shorter than the longest one go on with zeros; beyond MOST_DIMENSIONS entries it is an error. There
    are as many components as the longest vector has entries, `components` at most. One without
    variance (to double precision) has no whitened value (null) and explains 0. deviation is null
    where it is beyond a long. Repeated rows and null ids are rows like others; other columns are not
    read. A table in which no vector counts gives an empty one.
    """
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    width = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    if width > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {width} entries; {MOST_DIMENSIONS} is the most")
    width = max(width, 0)
    basis = fitted(vectors, width, passes) if width else Basis(0, np.zeros(0, object))
    count = min(components, width) if basis.n else 0
    error = identity_error(vectors, width, basis, count) if count else None
    explained = np.zeros(count)
    if count and basis.rank:
        last = min(count, basis.rank)
        explained[:last] = basis.values[:last] / basis.values.sum()

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    wanted = pa.schema([
        ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows if count else 0, _ROWS):
                part = batch.slice(start, _ROWS)
                whole, at = whole_rows(part.column("vector"), width)
                if not len(at):
                    continue
                values = basis.whitened(basis.centred(whole), count).ravel()
                rows = np.repeat(np.arange(len(at)), count)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(at)).take(pa.array(rows)),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(rows), basis.n)),
                        pa.array(deviations(whole, basis), pa.int64()).take(pa.array(rows)),
                        pa.array(values, mask=np.isnan(values)),
                        pa.array(np.tile(explained, len(at))),
                        pa.array(np.full(len(rows), np.nan if error is None else error), mask=np.full(len(rows), error is None)),
                    ],
                    schema=wanted,
                )

    return vectors.mapInArrow(run, schema)
