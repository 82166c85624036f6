"""Whitening of embeddings by the leading eigenvectors of their covariance.

The covariance is never formed. A block Lanczos iteration asks for products of it with a
block of vectors, each one pass over the stored table in which tasks add up
``(x - mean)ᵀ ((x - mean) q)``; blocks are orthogonalised twice against the whole basis.
Directions that a block adds no more (a breakdown) are replaced by random ones orthogonal
to the basis. The iteration ends when the residuals of the wanted pairs are at the
rounding error, and stay so after a random block was thrown in (copies of a repeated
eigenvalue may hide from one start), or when the basis spans the space. The driver holds
the basis alone: dimensions times dimensions at most.

Entries enter as whole numbers ``floor(64 c) + 1000000``, so sums and deviations are
exact; a deviation beyond 64 bits is null, and shares are then still right to rounding.
Vectors that are null, hold a null or a value that is not finite or beyond 2^46 are
dropped; so are empty ones and those whose length is not the commonest one (of equally
common ones, the longest). Null and repeated ids are kept, a row each. There are as many
components as the covariance has eigenvalues above rounding error, and no more than asked
for: equal vectors alone have none. Further columns are not read. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import ship_package, stored

SCALE, OFFSET = 64.0, 1_000_000
#: Beyond this an entry times SCALE is no longer a whole number of its own.
LARGEST = float(1 << 46)
COMPONENTS, BLOCK = 32, 16
#: Residuals against the largest eigenvalue.
TOLERANCE = 1e-13
#: Rows whose components are written at once.
ROWS = 4_096


def whole_numbers(vector: Column) -> Column:
    """The entries as whole numbers; null where the vector is to be dropped."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > F.lit(LARGEST))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(SCALE)) + F.lit(OFFSET))
    return F.when((F.size(vector) > 0) & ~F.exists(vector, odd), x)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Table:
    """The vectors in Spark, with their number, sums and centre."""

    def __init__(self, vectors: DataFrame, id_col: str, vec_col: str) -> None:
        rows = stored(vectors.select(F.col(id_col).alias("id"), whole_numbers(F.col(vec_col)).alias("x")).where("x is not null"), "whitening-x")
        widths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        self.d, self.n = (widths["d"], widths["count"]) if widths else (0, 0)
        self.rows = rows.where(F.size("x") == self.d)
        self.base, self.rest, self.sums = np.zeros(self.d, np.int64), np.zeros(self.d), []
        if self.n:
            self.sums = self.added(lambda x: x.sum(axis=0), "bigint")
            self.base = np.array([s // self.n for s in self.sums], np.int64)
            self.rest = np.array([(s - int(b) * self.n) / self.n for s, b in zip(self.sums, self.base, strict=True)])

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """Whole numbers to deviations from the mean, without rounding the large part of it."""
        base, rest = self.base, self.rest
        return lambda x: (x - base).astype(np.float64) - rest

    def added(self, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> list:
        """The sum over all rows of an array of fixed size: tasks add up theirs, Spark adds these place by place."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    mine = np.ravel(part(_matrix(batch.column(0))))
                    total = mine if total is None else total + mine
            if total is not None:
                yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total)), pa.int32()), "value": pa.array(total)})

        sums = self.rows.select("x").mapInArrow(run, f"at int, value {kind}").groupBy("at").agg(F.sum("value").alias("value"))
        return [r["value"] for r in sorted(sums.collect())]  # numbers of one array

    def times(self, q: np.ndarray) -> np.ndarray:
        """The covariance times a block of vectors."""
        centre = self.centred()

        def part(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return c.T @ (c @ q)

        return np.array(self.added(part)).reshape(q.shape) / self.n


def lanczos(times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int = BLOCK, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix of ``d`` rows, falling, and their unit eigenvectors in columns."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, d)
    basis, image = np.zeros((d, 0)), np.zeros((0, 0))
    q = _fresh(rng, basis, min(block, d))
    agreed = None
    while True:
        w = times(q)
        basis = np.hstack([basis, q])
        m, b = basis.shape[1], q.shape[1]
        seen = basis.T @ w
        w = w - basis @ seen
        again = basis.T @ w
        w, seen = w - basis @ again, seen + again
        grown = np.zeros((m, m))
        grown[: m - b, : m - b] = image
        grown[:, m - b :], grown[m - b :, :] = seen, seen.T
        grown[m - b :, m - b :] = (seen[m - b :] + seen[m - b :].T) / 2
        image = grown
        values, inner = np.linalg.eigh(image)
        values, inner = values[::-1], inner[:, ::-1]
        if m == d:
            break
        least = TOLERANCE * max(abs(values[0]), abs(values[-1]), np.finfo(float).tiny)
        residuals = np.linalg.norm(w @ inner[m - b :], axis=0)
        done = m >= wanted and (residuals[:wanted] <= least).all()
        same = agreed is not None and np.abs(values[:wanted] - agreed).max() <= 10 * least
        if done and same and m > wanted and residuals[wanted] <= 1e-6 * values[0]:
            break
        # a block of random vectors, followed until its own largest pair is known, shows whether a copy of an eigenvalue was missed
        q = _fresh(rng, basis, min(block, d - m)) if done and not same else _next(rng, basis, w, min(block, d - m), least)
        agreed = values[:wanted].copy() if done else agreed
    return values[:wanted], basis @ inner[:, :wanted]


def _next(rng: np.random.Generator, basis: np.ndarray, w: np.ndarray, size: int, least: float) -> np.ndarray:
    """An orthonormal block of what ``w`` adds to the basis; random directions stand in for those that it doesn't add."""
    u, s, _ = np.linalg.svd(w, full_matrices=False)
    kept = _apart(basis, u[:, s > least][:, :size])
    if kept.shape[1] < size:
        kept = np.hstack([kept, _fresh(rng, np.hstack([basis, kept]), size - kept.shape[1])])
    return kept


def _fresh(rng: np.random.Generator, basis: np.ndarray, size: int) -> np.ndarray:
    return _apart(basis, rng.normal(size=(basis.shape[0], size)))


def _apart(basis: np.ndarray, w: np.ndarray) -> np.ndarray:
    for _ in range(3):
        w = np.linalg.qr(w - basis @ (basis.T @ w))[0] if w.shape[1] else w
    return w


def _deviations(x: np.ndarray, n: int, base: np.ndarray, rest: list[int]) -> tuple[list[int | None], np.ndarray]:
    """The sum over dimensions of ``(n x - S)²``: exact, or null beyond 64 bits; and as floating-point numbers."""
    away = (x - base).astype(np.float64) * n - np.array(rest, np.float64)
    about = (away * away).sum(axis=1)
    # whole numbers of 64 bits wrap around, so a sum that fits is right whatever its terms
    y = (x - base) * np.int64(n) - np.array(rest, np.int64)
    exact = (y * y).sum(axis=1)
    out: list[int | None] = exact.tolist()
    for k in np.flatnonzero(about > 9.2e18):
        whole = sum((n * (int(a) - int(b)) - r) ** 2 for a, b, r in zip(x[k], base, rest, strict=True)) if about[k] < 9.3e18 else 1 << 63
        out[k] = whole if whole < 1 << 63 else None
    return out, about


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error)``: a row for each vector and component."""
    spark = vectors.sparkSession
    ship_package(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    data = Table(vectors, id_col, vec_col)
    if not data.n:
        return spark.createDataFrame([], schema)
    n, base, d = data.n, data.base, data.d
    rest = [s - int(b) * n for s, b in zip(data.sums, base, strict=True)]
    trace = data.added(lambda x: _deviations(x, n, base, rest)[1].sum(keepdims=True))[0] / float(n) ** 3
    values, axes = lanczos(data.times, d, components)
    some = values > max(values[0], 0.0) * d * 1e-13
    values, axes = values[some], axes[:, some]
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    to_unit, centre = axes / np.sqrt(values), data.centred()
    mean = np.array(data.added(lambda x: (centre(x) @ to_unit).sum(axis=0))) / n

    def products(x: np.ndarray) -> np.ndarray:
        w = centre(x) @ to_unit - mean
        return w.T @ w

    error = float(np.abs(np.array(data.added(products)).reshape(k, k) / n - np.eye(k)).max())
    shares = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                x = _matrix(batch.column(1))
                m = len(x)
                exact = np.repeat(np.arange(m), k)
                columns = [
                    batch.column(0).take(pa.array(exact)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(_deviations(x, n, base, rest)[0], pa.int64()).take(pa.array(exact)),
                    pa.array(np.ravel(centre(x) @ to_unit)),
                    pa.array(np.tile(shares, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return data.rows.select("id", "x").mapInArrow(run, schema)
