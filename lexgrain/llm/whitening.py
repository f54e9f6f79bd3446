"""Whitening of embeddings by an exact integer scatter.

Entries become whole numbers, floor(scale * c) + offset. Tasks subtract a shift and add up sums and cross-products in
whole numbers of any size; n * X'X - SS' is formed exactly, and only then turned into floats and decomposed by eigh.

Defined results: a vector that is null, or holds null, NaN, infinite or such entries as leave the range of a long once
scaled, is dropped. Vectors of another length than most have (ties: the longer) are dropped, empty ones too. Repeated
rows count each. A direction without variance has null in `whitened`; with one row, or equal rows, that is every
direction, and `explained` is null. An empty table gives no rows. Columns of any name are kept beside the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pack

#: Whole numbers are cut into signed limbs of so many bits: a product of two limbs, added up over BLOCK rows, is exact in a double.
LIMB, BLOCK = 20, 8192
#: Parts of the large sums are added up as longs of so many bits by Spark, so 2**33 tasks can't overflow one.
PART = 30
#: Scaled entries stay below this, so a long holds them with any offset and shift of the same size.
RANGE = 2.0**61


@dataclass(frozen=True)
class Scatter:
    """Exact sums of the whole-number vectors less the shift."""

    n: int
    dim: int
    shift: int
    sums: list[int]
    cross: list[list[int]]

    def covariance(self) -> np.ndarray:
        """(n * X'X - SS') / n**2, exact before the division, which rounds correctly."""
        n, s = self.n, self.sums
        return np.array([[(n * self.cross[i][j] - s[i] * s[j]) / (n * n) for j in range(self.dim)] for i in range(self.dim)], float).reshape(self.dim, self.dim)


@dataclass(frozen=True)
class Whitener:
    """Axes as columns by falling variance; `spread` has the variances, 0 where there is none."""

    scatter: Scatter
    scale: int
    offset: int
    axes: np.ndarray
    spread: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float | None]:
        return [float(e / self.trace) if self.trace else None for e in self.spread]


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as doubles x0, x1, ... with x = x0 + 2**20 x1 + ...; each at most 2**19 in size."""
    out, x, half = [], x.astype(np.int64), 1 << (LIMB - 1)
    while not out or x.any():
        low = ((x + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        x = (x - low) >> LIMB
    return out


def cross_products(x: np.ndarray) -> np.ndarray:
    """X'X of whole numbers, exact: a matrix of Python's whole numbers."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), BLOCK):
        parts = limbs(x[at : at + BLOCK])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total = total + (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return total


def row_products(x: np.ndarray, weights: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the sum of squares and the sum of x * weights, exact, as Python's whole numbers."""
    parts, squares, dots = limbs(x), np.zeros(len(x), object), np.zeros(len(x), object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            squares = squares + (a * b).sum(1).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    rest, k = list(weights), 0
    while any(rest):
        low = [w % (1 << LIMB) - (1 << LIMB) * (w % (1 << LIMB) >= 1 << (LIMB - 1)) for w in rest]
        for i, a in enumerate(parts):
            dots = dots + (a @ np.array(low, float)).astype(np.int64).astype(object) * (1 << LIMB * (i + k))
        rest, k = [(w - v) >> LIMB for w, v in zip(rest, low)], k + 1
    return squares, dots


def whole_numbers(values: np.ndarray, scale: int, offset: int) -> np.ndarray:
    return np.floor(values.astype(np.float64) * scale).astype(np.int64) + offset


def usable(df: DataFrame, vec_col: str, scale: int) -> DataFrame:
    """df as _row, with the usable vectors as doubles in _v."""
    vectors = pack(df).withColumn("_v", F.col("_row").getField(vec_col).cast("array<double>"))
    good = lambda c: c.isNotNull() & (F.abs(c) < RANGE / scale) & ~F.isnan(c)
    return vectors.where(F.col("_v").isNotNull() & F.coalesce(F.forall("_v", good), F.lit(False)))


def usual_length(df: DataFrame) -> int:
    found = df.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def scatter(df: DataFrame, vec_col: str = "embedding", scale: int = 64, offset: int = 1_000_000, shift: int | None = None, dim: int | None = None) -> Scatter:
    """The exact sums of all usable vectors; any shift gives the same covariance.

    A task gives a row for each cell of its sums, cut into parts that fit a long; Spark adds them up by cell, and the
    driver gets dim * (dim + 3) / 2 sums whatever the number of rows.
    """
    rows, shift = usable(df, vec_col, scale), offset if shift is None else shift
    dim = usual_length(rows) if dim is None else dim
    if not dim:
        return Scatter(0, 0, shift, [], [])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            x = whole_numbers(_matrix(batch.column(0), dim), scale, offset) - shift
            n += len(x)
            for part, weight in zip(limbs(x), (1 << LIMB * k for k in range(9))):
                sums = sums + part.sum(0).astype(np.int64).astype(object) * weight
            cross = cross + cross_products(x)
        cells = [n, *sums, *(cross[i, j] for i in range(dim) for j in range(i + 1))] if n else []
        out = []
        for cell, value in enumerate(cells):
            size, sign, k = abs(int(value)), 1 if value > 0 else -1, 0
            while size:
                out.append((cell, k, sign * (size & ((1 << PART) - 1))))
                size, k = size >> PART, k + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.int32(), pa.int32(), pa.int64()))], ["cell", "part", "value"])

    parts = rows.where(F.size("_v") == dim).select("_v").mapInArrow(add_up, "cell int, part int, value long")
    totals = [0] * (1 + dim + dim * (dim + 1) // 2)
    for r in parts.groupBy("cell", "part").agg(F.sum("value").alias("value")).collect():
        totals[r["cell"]] += r["value"] << PART * r["part"]
    cross, at = [[0] * dim for _ in range(dim)], 1 + dim
    for i in range(dim):
        for j in range(i + 1):
            cross[i][j] = cross[j][i] = totals[at]
            at += 1
    return Scatter(totals[0], dim, shift, totals[1 : dim + 1], cross)


def fit(found: Scatter, components: int = 32, scale: int = 64, offset: int = 1_000_000) -> Whitener:
    """The leading unit eigenvectors of the covariance; of either sign the one whose largest entry is positive."""
    if not found.n:
        return Whitener(found, scale, offset, np.zeros((0, 0)), np.zeros(0), 0.0)
    cov = found.covariance()
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    values, axes = values[order], axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), range(axes.shape[1])] < 0, -1.0, 1.0)
    none = values <= values.max(initial=0.0) * found.dim * np.finfo(float).eps
    return Whitener(found, scale, offset, axes, np.where(none, 0.0, values), float(np.trace(cov)))


def _projected(batch: pa.RecordBatch, w: Whitener) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers less the shift, and their whitened values; the mean is taken off in whole numbers first."""
    x = whole_numbers(_matrix(batch.column(0), w.scatter.dim), w.scale, w.offset) - w.scatter.shift
    n = w.scatter.n
    floor, rest = np.array([s // n for s in w.scatter.sums], np.int64), np.array([s % n / n for s in w.scatter.sums])
    with np.errstate(divide="ignore", invalid="ignore"):
        return x, ((x - floor).astype(np.float64) - rest) @ w.axes / np.sqrt(w.spread)


def identity_error(df: DataFrame, w: Whitener, vec_col: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened values' covariance less the identity, over all usable rows."""
    k = int((w.spread > 0).sum())
    if not k:
        return None
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, cross = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = _projected(batch, w)[1][:, :k]
            sums, cross = sums + y.sum(0), cross + y.T @ y
        cells = np.concatenate([sums, [cross[i, j] for i, j in upper]])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells)], ["cell", "value"])

    parts = usable(df, vec_col, w.scale).where(F.size("_v") == w.scatter.dim).select("_v").mapInArrow(add_up, "cell int, value double")
    cells = {r["cell"]: r["value"] / w.scatter.n for r in parts.groupBy("cell").agg(F.sum("value").alias("value")).collect()}
    return max(abs(cells[k + at] - cells[i] * cells[j] - (i == j)) for at, (i, j) in enumerate(upper))


def project(df: DataFrame, w: Whitener, vec_col: str = "embedding") -> DataFrame:
    """_row (all columns of df), deviation (sum of squares of n * x - S, in digits), whitened (array, null where there is no variance)."""
    kind = usable(df, vec_col, w.scale).schema["_row"].dataType
    rows = usable(df, vec_col, w.scale).where(F.size("_v") == max(w.scatter.dim, 1))
    n, sums, zero = w.scatter.n, w.scatter.sums, w.spread <= 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _projected(batch.select(["_v"]), w)
            squares, dots = row_products(x, sums)
            deviation = n * n * squares - 2 * n * dots + sum(s * s for s in sums)
            flat = pa.array(y.ravel(), mask=np.broadcast_to(zero, y.shape).ravel())
            whitened = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, max(1, y.shape[1])), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array([str(d) for d in deviation], pa.string()), whitened], ["_row", "deviation", "whitened"])

    if not n:
        return rows.select("_row", F.lit("").alias("deviation"), F.array().cast("array<double>").alias("whitened")).where("false")
    return rows.select("_v", "_row").mapInArrow(work, f"_row {kind.simpleString()}, deviation string, whitened array<double>")


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """A row for each usable vector and component: id, component (from 1), n, deviation (digits), whitened, explained, identity_error."""
    ids = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vector"))
    w = fit(scatter(ids, "vector", scale, offset), components, scale, offset)
    error, explained = identity_error(ids, w, "vector"), F.array(*(F.lit(e).cast("double") for e in w.explained))
    rows = project(ids, w, "vector").select(F.col("_row.id").alias("id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("id", (F.col("at") + 1).alias("component"), F.lit(w.scatter.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def as_long(digits: Column) -> Column:
    """Digits as a long, null where none holds them."""
    return digits.try_cast("long")
