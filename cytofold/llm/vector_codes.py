"""Vector codes by product quantisation, with memoised grid cells.

A vector is cut in equal parts and each part named by its nearest codebook entry.
Space is cut in boxes, a grid as coarse as ``cell_bits`` says. Of a box that holds
a point, the entries that can be nearest to some point of it are worked out once:
an entry whose least distance to the box is more than another's greatest is
dominated. Points are then held against the entries of their box only, exactly.

All arithmetic is on integers, so codes and codebooks are the same for any
partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytofold.llm.arrays import MIX, mix
from cytofold.llm.common import join_split, materialise
from cytofold.llm.vectors import by_id, matrix, usable

#: Integer components stay within this, so that sums of squares of 16,384 of them fit in 63 bits.
LARGEST = 1 << 23


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), held within ``LARGEST``."""
    return np.clip(np.floor(scale * vectors), -LARGEST, LARGEST).astype(np.int64)


class Cells:
    """Entries that can be nearest, by grid cell, for the codebook of one part.

    At most ``most`` cells are kept; when there are more, the table starts anew.
    """

    def __init__(self, entries: np.ndarray, cell_bits: int = 4, most: int = 1 << 14):
        self.entries, self.bits, self.most = entries, cell_bits, most
        self.evaluated = 0
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.corners = np.zeros((0, self.entries.shape[1]), np.int64)
        self.open = np.zeros((0, len(self.entries)), bool)

    def _learn(self, keys: np.ndarray, corners: np.ndarray) -> None:
        """Add cells; ``corners`` are their coordinates in the grid."""
        if len(self.keys) + len(keys) > self.most:
            self._forget()
        least = np.zeros((len(keys), len(self.entries)), np.int64)
        greatest = np.zeros_like(least)
        for axis in range(corners.shape[1]):
            low = (corners[:, axis] << self.bits)[:, None]
            high = low + (1 << self.bits) - 1
            at = self.entries[:, axis][None, :]
            outside = np.maximum(np.maximum(low - at, at - high), 0)
            across = np.maximum(np.abs(at - low), np.abs(at - high))
            least += outside * outside
            greatest += across * across
        undominated = least <= greatest.min(axis=1)[:, None]
        at = np.searchsorted(self.keys, keys)
        self.keys, self.corners, self.open = np.insert(self.keys, at, keys), np.insert(self.corners, at, corners, axis=0), np.insert(self.open, at, undominated, axis=0)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        return at, known

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each point, the lowest of ties, and its squared distance."""
        index, distance = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        for at in range(0, len(points), self.most):  # so that the cells of a turn always fit
            index[at : at + self.most], distance[at : at + self.most] = self._nearest(points[at : at + self.most])
        return index, distance

    def _nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        corners = points >> self.bits
        hashes = np.zeros(len(points), np.uint64)
        for axis in range(corners.shape[1]):
            hashes = mix(hashes ^ corners[:, axis].astype(np.uint64) * MIX[axis % len(MIX)] ^ np.uint64(axis))
        cells, first, cell = np.unique(hashes, return_index=True, return_inverse=True)
        _, known = self._find(cells)
        if not known.all():
            if len(self.keys) + int((~known).sum()) > self.most:
                known[:] = False  # they will be forgotten
            self._learn(cells[~known], corners[first[~known]])
        at, _ = self._find(cells)
        open_ = self.open[at[cell]]
        open_[(self.corners[at[cell]] != corners).any(axis=1)] = True  # two cells share a hash: all entries stay open
        point, entry = np.nonzero(open_)
        self.evaluated += len(point)
        apart = np.zeros(len(point), np.int64)
        for axis in range(points.shape[1]):
            step = points[point, axis] - self.entries[entry, axis]
            apart += step * step
        best = np.minimum.reduceat(apart * len(self.entries) + entry, np.flatnonzero(np.diff(point, prepend=-1)))
        return best % len(self.entries), best // len(self.entries)


class Coder:
    """The codebooks of all parts: an array of parts, entries and components."""

    def __init__(self, codebooks: np.ndarray, scale: int, cell_bits: int):
        self.codebooks, self.scale = codebooks, scale
        self.cells = [Cells(entries, cell_bits) for entries in codebooks]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Integer vectors, the entry of each of their parts, and its squared distance."""
        x = integers(vectors, self.scale)
        if not len(x):
            return x, np.zeros((0, len(self.cells)), np.int64), np.zeros((0, len(self.cells)), np.int64)
        found = [cells.nearest(part) for cells, part in zip(self.cells, np.split(x, len(self.cells), axis=1), strict=True)]
        return x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


_coders: dict[bytes, Coder] = {}


def coder(codebooks: np.ndarray, scale: int, cell_bits: int) -> Coder:
    """The worker's coder for these codebooks, with the cells it has met; that of other codebooks goes."""
    key = hashlib.sha256(codebooks.tobytes() + f"{codebooks.shape}{scale}{cell_bits}".encode()).digest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(codebooks, scale, cell_bits)
    return _coders[key]


def refined(vectors: DataFrame, codebooks: np.ndarray, scale: int, cell_bits: int) -> np.ndarray:
    """Codebooks whose entries are the floored means of the parts assigned to them; unused entries stay."""
    parts, size, width = codebooks.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, total = coder(codebooks, scale, cell_bits), np.zeros((parts, size, width + 1), np.int64)
        for batch in batches:
            x, entries, _ = tool.assign(matrix(batch.column(0), parts * width))
            for part in range(parts):
                total[part, :, 0] += np.bincount(entries[:, part], minlength=size)
                for k in range(width):
                    # Sums of a batch are exact in a double: fewer than 2 ** 30 rows of at most 2 ** 23.
                    total[part, :, k + 1] += np.bincount(entries[:, part], x[:, part * width + k], minlength=size).astype(np.int64)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "v"])

    # As many rows as the codebooks have components, and a count for each entry.
    rows = vectors.mapInArrow(sums, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(parts * size * (width + 1), np.int64)
    for r in rows:
        total[r["at"]] = r["v"]
    total = total.reshape(parts, size, width + 1)
    count = total[:, :, :1]
    return np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), codebooks)


def trained_codebooks(vectors: DataFrame, first: np.ndarray, parts: int, rounds: int, scale: int, cell_bits: int) -> np.ndarray:
    """Codebooks after ``rounds`` of assigning and averaging, from the parts of the vectors in ``first``."""
    codebooks = np.stack(np.split(integers(first, scale), parts, axis=1))
    for _ in range(rounds):
        codebooks = refined(vectors, codebooks, scale, cell_bits)
    return codebooks


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def vector_codes(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, cell_bits: int = 4
) -> DataFrame:
    """One row for each usable vector: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null, empty, or has null or non-finite components go, and
    so do those whose number of components isn't that of the vector with the least
    id among those that ``parts`` divides. Ids that are null come last; rows that
    share an id, or repeat, all count, ordered by their vectors where order
    matters. With fewer vectors than ``entries`` the codebooks are as short.
    Scaled components beyond 2 ** 23 count as 2 ** 23. Other columns are ignored,
    so clashing names do no harm. An empty table gives an empty result.

    ``rows`` are read once for the first entries and once for each round and the
    codes; what travels is a count and sums for each entry and partition.
    """
    spark = rows.sparkSession
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    kept = usable(rows, vector_col, parts)
    first = kept.orderBy(*by_id(id_col)).select(F.size("_vector").alias("n")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    width = first["n"]
    kept = kept.where(F.size("_vector") == width)
    seeds = kept.orderBy(*by_id(id_col)).select("_vector").limit(entries).collect()
    vectors = kept.select("_vector")
    codebooks = trained_codebooks(vectors, np.array([r["_vector"] for r in seeds]), parts, rounds, scale, cell_bits)
    digits = np.array([f"{k:02x}" for k in range(max(256, len(seeds)))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(codebooks, scale, cell_bits)
        for batch in batches:
            _, found, apart = tool.assign(matrix(batch.column(2), width))
            codes = ["".join(row) for row in digits[found].tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(apart.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    label = F.coalesce(F.concat(F.lit("0"), F.col(f"`{label_col}`").cast("string")), F.lit("1"))
    coded = kept.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.alias("label"), "_vector").mapInArrow(encode, "vec_id long, label string, code string, error long")
    coded = materialise(coded, "vector-codes")
    totals = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    return join_split(coded, totals, ["label"]).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))
