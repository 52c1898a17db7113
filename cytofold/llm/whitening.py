"""Embedding whitening by a spectral divide and conquer.

The covariance comes from exact integer sums. Its eigenvectors come from polar
decompositions: the polar factor of the covariance less a shift is 1 on the
eigenvectors above the shift and -1 on those below, so it gives the projectors of
both; bases of the two ranges cut the matrix in two smaller ones, and so on down
to single components. Polar factors come from the dynamically weighted Halley
iteration, with QR steps while the weights are large and Cholesky steps after.
The matrix of the components is sent to all tasks, which whiten the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytofold.llm.common import materialise
from cytofold.llm.vectors import by_id, matrix, usable

EPS = float(np.finfo(float).eps)
#: Integer components stay within this.
LARGEST = 1 << 40


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix."""
    n = len(a)
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.eye(n)
    x, low = a / norm, EPS / 4
    for _ in range(40):
        square = low * low
        root = np.cbrt(4 * (1 - square) / (square * square)) if square > 0 else 0.0
        p = np.sqrt(1 + root)
        wa = p + 0.5 * np.sqrt(max(8 - 4 * root + 8 * (2 - square) / (square * p), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
            moved = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            lower = np.linalg.inv(np.linalg.cholesky(np.eye(n) + wc * x.T @ x))
            moved = (wb / wc) * x + (wa - wb / wc) * (x @ lower.T) @ lower
        moved = (moved + moved.T) / 2
        low = min(low * (wa + wb * square) / (1 + wc * square), 1.0)
        step = np.linalg.norm(moved - x)
        x = moved
        if step < 10 * EPS * n and 1 - low < 10 * EPS:
            break
    return x


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Places that lie between eigenvalues, unless they hit one."""
    diagonal = np.sort(np.diag(a))
    yield float(np.median(diagonal))
    yield float(diagonal.mean())  # between the least and the largest eigenvalue, unless all are equal
    spread = np.linalg.norm(a - diagonal.mean() * np.eye(len(a))) / np.sqrt(len(a))
    for k in range(1, 9):
        yield float(diagonal.mean()) + spread * 0.37 / k * (-1) ** k
    yield from ((diagonal[1:] + diagonal[:-1]) / 2).tolist()


def split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span an invariant subspace, and k; None if no shift parts the eigenvalues."""
    n = len(a)
    start = np.random.Generator(np.random.PCG64(7)).standard_normal((n, n))
    for shift in _shifts(a):
        above = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = int(round(np.trace(above)))
        if not 0 < k < n:
            continue
        basis, _ = np.linalg.qr(above @ start[:, :k])
        basis, _ = np.linalg.qr(above @ basis, mode="complete")
        if np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k]) <= 100 * n * EPS * np.linalg.norm(a):
            return basis, k
    return None


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as columns."""
    values, vectors = _parts((a + a.T) / 2, EPS * np.linalg.norm(a))
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _parts(a: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray]:
    n = len(a)
    if n == 1 or np.linalg.norm(a - np.diag(np.diag(a))) <= noise or (cut := split(a)) is None:
        return np.diag(a).copy(), np.eye(n)  # diagonal to rounding, or a multiple of the identity
    basis, k = cut
    found = [_parts((m + m.T) / 2, noise) for m in (b.T @ a @ b for b in (basis[:, :k], basis[:, k:]))]
    return np.concatenate([f[0] for f in found]), np.hstack([basis[:, :k] @ found[0][1], basis[:, k:] @ found[1][1]])


def integers(vectors: np.ndarray, scale: int, offset: int) -> np.ndarray:
    """floor(scale * c) + offset, held within ``LARGEST``."""
    return np.clip(np.floor(scale * vectors), -LARGEST, LARGEST).astype(np.int64) + offset


def exact_products(y: np.ndarray) -> np.ndarray:
    """y.T @ y of integers, as Python integers: doubles hold the sums of as many rows as fit in 53 bits."""
    most = int(np.abs(y).max(initial=0)) + 1
    rows = (1 << 53) // (most * most)
    if not rows:
        wide = y.astype(object)
        return wide.T @ wide
    total = np.zeros((y.shape[1],) * 2, dtype=object)
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def squared_deviations(y: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """Exact sums over components of (n * y - rest) squared; None beyond 63 bits."""
    most = n * (int(np.abs(y).max(initial=0)) + 1)
    if y.shape[1] * most * most < 1 << 63:
        apart = n * y - rest
        return (apart * apart).sum(axis=1).tolist()
    wide = n * y.astype(object) - rest.astype(object)
    return [v if v < 1 << 63 else None for v in (wide * wide).sum(axis=1).tolist()]


def _total(vectors: DataFrame, measure, width: int) -> list[int]:
    """Sums over all vectors of the integers that ``measure`` makes of a batch; a row for each of them and partition travels."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = measure(matrix(batch.column(0), width))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int64)), pa.array([int(v) for v in total], pa.decimal128(38, 0))], names=["at", "v"])

    rows = vectors.mapInArrow(sums, "at long, v decimal(38, 0)").groupBy("at").agg(F.sum("v").alias("v")).collect()
    return [int(r["v"]) for r in sorted(rows, key=lambda r: r["at"])]


def whitened_components(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 8, scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or has null or non-finite entries go, and so
    do those whose number of entries isn't that of the vector with the least id,
    null ids last. Rows that share an id, or repeat, all count. Components whose
    eigenvalue is nothing but rounding (no variance along them) are left out, so a
    single vector, or equal ones, give no rows. ``deviation`` is null beyond 63
    bits. Scaled entries beyond 2 ** 40 count as 2 ** 40. Other columns are
    ignored, so clashing names do no harm. An empty table gives an empty result.

    ``rows`` are read three times: for the sums, the products and the result.
    """
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kept = usable(rows, vector_col)
    first = kept.orderBy(*by_id(id_col)).select(F.size("_vector").alias("n")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    width = first["n"]
    kept = kept.where(F.size("_vector") == width)
    vectors = kept.select("_vector")
    n, *sums = _total(vectors, lambda v: np.concatenate([[len(v)], integers(v, scale, offset).sum(axis=0)]).astype(object), width)
    # Centred at the nearest integers to the means; what is left of the sums corrects the products.
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(sums, centre, strict=True)], dtype=np.int64)
    products = _total(vectors, lambda v: exact_products(integers(v, scale, offset) - centre).ravel(), width)
    covariance = np.array([(n * p - int(rest[k // width]) * int(rest[k % width])) / (n * n) for k, p in enumerate(products)]).reshape(width, width)
    values, directions = components(covariance)
    trace = float(np.trace(covariance))
    usable_ones = [k for k in range(min(most, width)) if values[k] > 100 * width * EPS * trace]
    if not usable_ones:
        return spark.createDataFrame([], schema)
    turn = directions[:, usable_ones] / np.sqrt(values[usable_ones])

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = integers(matrix(batch.column(1), width), scale, offset) - centre
            found = (y - rest / n) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(squared_deviations(y, rest, n), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    table = materialise(kept.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), "_vector").mapInArrow(whiten, "vec_id long, deviation long, whitened array<double>"), "whitened")
    k = len(usable_ones)
    means = table.agg(*(F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in range(k))).first()
    pairs = list(combinations_with_replacement(range(k), 2))
    spread = table.agg(*(F.avg((F.col("whitened")[i] - means[i]) * (F.col("whitened")[j] - means[j])).alias(f"c{i}_{j}") for i, j in pairs)).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(spread, pairs, strict=True))
    explained = F.array(*(F.lit(float(values[i] / trace)) for i in usable_ones))
    return table.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error")
    )
