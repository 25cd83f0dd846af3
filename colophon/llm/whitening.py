"""Whitening of embeddings by slicing the spectrum of their covariance.

Entries become whole numbers, so all moments are exact: tasks add up sums, then products of entries centred at the whole
number next to their mean; what centring leaves over is corrected in integers. The covariance is thereby the correctly
rounded one, whatever the order in which tasks end.

Its leading eigenvalues are found by slicing: the inertia of an LDL^T factorisation of V - s I says how many eigenvalues lie
above s. Bisection with these counts puts each leading eigenvalue into an interval of its own, Rayleigh quotient iteration
converges cubically inside, and two more counts, just below and just above the result, certify its number. Eigenvalues that
no count can tell apart share an interval and get an orthonormal basis of it.

Only the moments (dimension squared numbers) reach the driver. Vectors are projected where they lie; nothing of them is
shuffled, whatever their number. Edge cases: rows whose vector is null, empty, or has null or non-finite entries take no
part, nor do vectors of another length than the commonest (the longer on a tie); entries beyond 2^50 count as 2^50;
directions without variance are no components, so equal vectors, a single vector or an empty table give no rows; repeated rows
and null ids count and stay like any others; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from colophon.llm.shared import written

SCALE, OFFSET, LARGEST = 64, 1_000_000, float(1 << 50)
EXACT = 1 << 53  # whole numbers up to here are exact in double precision
SMALL, ROWS = 1 << 20, 1 << 12  # products of so small entries over so many rows stay below EXACT
EPS = float(np.finfo(float).eps)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, no entry null, NaN or infinite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def whole_numbers(vector: Column) -> Column:
    """array<long>: floor(64 c) + 1000000 of each entry, as double."""
    scaled = lambda c: F.least(F.greatest(c.cast("double") * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))
    return F.transform(vector, lambda c: F.floor(scaled(c)) + F.lit(OFFSET).cast("long"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Sums:
    """Number of vectors and exact sums per dimension."""

    n: int
    sums: list[int]

    @property
    def centre(self) -> np.ndarray:
        """The whole number next to each mean."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype="int64")

    @property
    def rest(self) -> list[int]:
        """Sum of the entries after ``centre`` is taken off, per dimension."""
        return [s - self.n * int(m) for s, m in zip(self.sums, self.centre)]


def add_up(vectors: DataFrame) -> Sums | None:
    """Exact sums of ``x`` over the vectors of the commonest length; None without vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            x = batch.column(0)
            lengths = x.value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(lengths):
                rows = _matrix(x.filter(pa.array(lengths == width)), int(width))
                high, low = (rows >> 32).sum(axis=0), (rows & 0xFFFFFFFF).sum(axis=0)
                n, so_far = found.get(width, (0, 0))
                found[width] = (n + len(rows), so_far + high.astype(object) * (1 << 32) + low.astype(object))
        for width, (n, sums) in found.items():
            columns = [[int(width)] * len(sums), list(range(len(sums))), [n] * len(sums), [int(s) for s in sums]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["width", "i", "n", "total"])

    parts = vectors.select("x").mapInArrow(partial, "width int, i int, n long, total decimal(38,0)")
    totals = written(parts.groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "vector_sums")
    best = totals.filter("i = 0").agg(F.max(F.struct("n", "width")).alias("b")).first().b
    if best is None:
        return None
    rows = totals.filter(F.col("width") == best.width).orderBy("i").collect()  # one per dimension
    return Sums(int(best.n), [int(r.total) for r in rows])


def covariance(vectors: DataFrame, sums: Sums) -> np.ndarray:
    """Covariance matrix over all vectors, divisor n, every entry correctly rounded; one partial matrix per task is added up."""
    centre, width = sums.centre, len(sums.sums)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, small, pending = np.zeros((width, width), dtype=object), np.zeros((width, width), dtype="int64"), 0
        for batch in batches:
            rows = _matrix(batch.column(0), width) - centre
            large = np.abs(rows).max(axis=1) > SMALL if len(rows) else np.zeros(0, dtype=bool)
            for start in range(0, len(rows), ROWS):
                part = np.where(large[start : start + ROWS, None], 0, rows[start : start + ROWS]).astype("float64")
                small += (part.T @ part).astype("int64")  # exact: all partial sums are below EXACT
                pending += 1
                if pending == 512:
                    total, small, pending = total + small, np.zeros_like(small), 0
            for row in rows[large].astype(object):
                total = total + np.outer(row, row)
        total = total + small
        i, j = np.triu_indices(width)
        arrays = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([int(v) for v in total[i, j]], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "total"])

    parts = vectors.select("x").mapInArrow(partial, "i int, j int, total decimal(38,0)")
    matrix, n, rest = np.zeros((width, width)), sums.n, sums.rest
    for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():  # dimension squared / 2 rows
        matrix[r.i, r.j] = matrix[r.j, r.i] = (n * int(r.total) - rest[r.i] * rest[r.j]) / (n * n)
    return matrix


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift``: the positive inertia of D in an LDL^T factorisation with diagonal pivoting."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, positive, alpha = len(a), 0, 0, (1 + math.sqrt(17)) / 8

    def swap(p: int, q: int) -> None:
        a[[p, q]] = a[[q, p]]
        a[:, [p, q]] = a[:, [q, p]]

    while k < n:
        below = np.abs(a[k + 1 :, k])
        r = k + 1 + int(below.argmax()) if len(below) else k
        largest = abs(a[r, k]) if r > k else 0.0
        pair = False
        if abs(a[k, k]) < alpha * largest:
            others = np.abs(a[k:, r])
            others[r - k] = 0.0
            if abs(a[k, k]) * others.max() < alpha * largest * largest:
                pair = abs(a[r, r]) < alpha * others.max()
                swap(k + 1 if pair else k, r)
        if pair:  # an indefinite block of two: one eigenvalue of each sign
            block, side = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= side @ np.linalg.solve(block, side.T)
            positive, k = positive + 1, k + 2
            continue
        pivot = a[k, k]
        if pivot != 0.0:
            side = a[k + 1 :, k].copy()
            a[k + 1 :, k + 1 :] -= np.outer(side / pivot, side)
        positive, k = positive + (pivot > 0.0), k + 1
    return positive


class Slicer:
    """Leading eigenpairs of a symmetric matrix by inertia counts and Rayleigh quotient iteration."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.width = matrix, len(matrix)
        reach = np.abs(matrix).sum(axis=1) - np.abs(np.diag(matrix))
        self.low, self.high = float((np.diag(matrix) - reach).min()), float((np.diag(matrix) + reach).max())
        self.norm = max(abs(self.low), abs(self.high))
        self.unit = 16 * self.width * EPS * self.norm  # eigenvalues closer than this are one to the counts
        self._counts: dict[float, int] = {}

    def above(self, shift: float) -> int:
        if shift not in self._counts:
            self._counts[shift] = count_above(self.matrix, shift)
        return self._counts[shift]

    def intervals(self, wanted: int) -> list[tuple[float, float, int, int]]:
        """(low, high, first, last), descending: the eigenvalues numbered first to last lie between low and high."""
        done, open_ = [], [(self.low - self.unit, self.high + self.unit)]
        while open_:
            low, high = open_.pop()
            first, last = self.above(high) + 1, self.above(low)
            if last < first or first > wanted:
                continue
            if last == first or high - low <= self.unit:
                done.append((low, high, first, last))
            else:
                middle = (low + high) / 2
                open_ += [(low, middle), (middle, high)]
        return sorted(done, key=lambda interval: interval[2])

    def _solve(self, shift: float, x: np.ndarray) -> np.ndarray:
        for _ in range(4):
            try:
                z = np.linalg.solve(self.matrix - shift * np.eye(self.width), x)
                if np.isfinite(z).all():
                    return z
            except np.linalg.LinAlgError:
                pass
            shift += EPS * self.norm  # exactly an eigenvalue
        return x

    def vector(self, low: float, high: float, beside: list[np.ndarray], number: int) -> np.ndarray:
        """A unit eigenvector with its eigenvalue between the bounds, orthogonal to those in ``beside``."""
        alone = not beside and self.above(low) - self.above(high) == 1
        close = 32 * EPS * self.norm if alone else 4 * self.unit
        for attempt in range(80):
            x = np.random.default_rng(1000 * number + attempt).normal(size=self.width)
            shift, before = (low + high) / 2, math.inf
            for _ in range(16):
                z = self._solve(shift, x / np.linalg.norm(x))
                for other in [*beside, *beside]:
                    z = z - (other @ z) * other
                x = z / np.linalg.norm(z)
                quotient = float(x @ self.matrix @ x)
                off = float(np.linalg.norm(self.matrix @ x - quotient * x))
                inside = low - self.unit <= quotient <= high + self.unit
                if inside and (off <= close or (off <= 64 * close and off >= before)):
                    return x
                before = off
                if inside:
                    shift = quotient
            if alone:  # the start was led to a neighbour: halve the interval and start anew
                middle = (low + high) / 2
                low, high = (middle, high) if self.above(middle) >= number else (low, middle)
        raise ArithmeticError(f"no eigenvector found for eigenvalue {number}")

    def leading(self, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``wanted`` positive eigenvalues, descending, and their unit vectors as columns; numbers are certified by counts."""
        found: list[np.ndarray] = []
        for low, high, first, last in self.intervals(min(wanted, self.width)) if self.norm else []:
            group: list[np.ndarray] = []
            for number in range(first, last + 1):
                group.append(self.vector(low, high, group, number))
            found += group
        values = [float(x @ self.matrix @ x) for x in found]
        order = sorted(range(len(found)), key=lambda i: -values[i])
        kept: list[np.ndarray] = []
        for i in order[:wanted]:
            x = found[i]
            for other in kept:
                x = x - (other @ x) * other
            x = x / np.linalg.norm(x)
            value = float(x @ self.matrix @ x)
            if value <= self.unit:
                break
            number = len(kept) + 1
            if self.above(value - self.unit) < number or self.above(value + self.unit) >= number:
                raise ArithmeticError(f"counts do not certify eigenvalue {number}")
            kept.append(x if x[np.abs(x).argmax()] > 0 else -x)
        vectors = np.array(kept).T.reshape(self.width, -1)
        return np.array([float(x @ self.matrix @ x) for x in kept]), vectors


@dataclass
class Whitening:
    """What the fit list gave: its sums, trace, eigenvalues (descending) and unit vectors as columns."""

    sums: Sums
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def prepared(embeddings: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and whole-number vector ``x`` of the rows that take part."""
    rows = embeddings.filter(usable(F.col(vector)))
    return rows.select(F.col(vec_id).alias("vec_id"), whole_numbers(F.col(vector)).alias("x"))


def fit(vectors: DataFrame, components: int = 32) -> Whitening | None:
    """Whitening of all ``x``; None if there is no vector."""
    sums = add_up(vectors)
    if sums is None:
        return None
    matrix = covariance(vectors.filter(F.size("x") == len(sums.sums)), sums)
    values, columns = Slicer(matrix).leading(components)
    return Whitening(sums, float(np.trace(matrix)), values, columns)


def _projected(rows: np.ndarray, model: Whitening) -> np.ndarray:
    rest = np.array([r / model.sums.n for r in model.sums.rest])
    return ((rows - model.sums.centre).astype("float64") - rest) @ model.projection


def _deviations(rows: np.ndarray, sums: Sums) -> list[int]:
    """Sum over dimensions of (n x - S)^2 for each row, exact."""
    y, rest, n = rows - sums.centre, sums.rest, sums.n
    bound = (int(np.abs(y).max(initial=0)) + 1) * n  # |n x - S| = |n y - rest| and rest is at most n / 2
    if bound * bound * len(rest) < 1 << 62:
        return ((y * n - np.array(rest, dtype="int64")) ** 2).sum(axis=1).tolist()
    return [int(v) for v in ((y.astype(object) * n - np.array(rest, dtype=object)) ** 2).sum(axis=1)]


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation decimal(38,0) (null beyond it), whitened array<double> of every vector of the fitted length."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, k = len(model.sums.sums), len(model.values)
        for batch in batches:
            rows = _matrix(batch.column(1), width)
            deviations = [d if d < 10**38 else None for d in _deviations(rows, model.sums)]
            flat = np.ascontiguousarray(_projected(rows, model)).ravel()
            offsets = pa.array(np.arange(len(rows) + 1, dtype="int32") * k)
            arrays = [batch.column(0), pa.array(deviations, pa.decimal128(38, 0)), pa.ListArray.from_arrays(offsets, pa.array(flat))]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "deviation", "whitened"])

    same = vectors.filter(F.size("x") == len(model.sums.sums))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return same.mapInArrow(project, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, measured over all of them."""
    width, k = len(model.sums.sums), len(model.values)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = _projected(_matrix(batch.column(0), width), model)
            sums, products = sums + w.sum(axis=0), products + w.T @ w
        i, j = np.triu_indices(k)
        cells = np.concatenate([np.full(k, -1), i]), np.concatenate([np.arange(k), j]), np.concatenate([sums, products[i, j]])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int32(), pa.float64()))], names=["i", "j", "total"])

    same = vectors.filter(F.size("x") == width).select("x")
    cells = same.mapInArrow(partial, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    total = {(r.i, r.j): r.total / model.sums.n for r in cells}
    return max(abs(total[i, j] - total[-1, i] * total[-1, j] - (i == j)) for i in range(k) for j in range(i, k))


def whiten(embeddings: DataFrame, components: int = 32, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per vector and component.

    ``deviation`` is a long, null where the exact value does not fit one. A table without variance has no components and
    gives no rows.
    """
    vectors = prepared(embeddings, vec_id, vector)
    model = fit(vectors, components)
    if model is None or not len(model.values):
        kind = vectors.schema["vec_id"].dataType.simpleString()
        schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    rows = transform(vectors, model).select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("_k", "whitened"))
    return rows.select(
        "vec_id", (F.col("_k") + 1).cast("int").alias("component"), F.lit(model.sums.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("_k")).alias("explained"), F.lit(error).alias("identity_error"),
    )
