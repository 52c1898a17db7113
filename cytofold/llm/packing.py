"""Packing token pieces into sequences: linear grouping, few-size configurations, best fit.

Lengths are integers up to the sequence length, so how many pieces have each
length is a table of bounded size. The plan is made from that table alone: large
lengths are rounded up within groups of equal cardinality, a linear programme
over the configurations of the few sizes says how often to use each, actual
pieces take the slots of their group, and small ones go by best fit into what
actual lengths leave free. The plan is a bounded list of runs (length, ranks ->
sequences, offset), which executors look up by a piece's rank among its length.
"""

from __future__ import annotations

import warnings
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytofold.llm.common import materialise
from cytofold.llm.tokens import default_path, encoder

GROUPS = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut_pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of all documents; ``nth`` numbers the pieces of equal length within a part."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        tool = encoder(tokenizer)
        for batch in batches:
            for at, ids, bounds in tool.encode(batch.column(1)):
                n = len(bounds) - 1
                values = np.insert(ids, bounds[1:], end_id).astype("<u4")
                begins = bounds + np.arange(n + 1)
                sizes = np.diff(begins)
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(n), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                frm = begins[doc] + start
                crc = [zlib.crc32(values[a:b]) for a, b in zip(frm.tolist(), (frm + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                sorted_lengths = length[order]
                nth = np.empty(len(doc), dtype=np.int64)
                nth[order] = np.arange(len(doc)) - np.searchsorted(sorted_lengths, sorted_lengths) + seen[sorted_lengths]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def configurations(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of one to three sizes that fit, as columns of counts."""
    k = len(sizes)
    one = [(i,) for i in range(k)]
    two = [(i, j) for i in range(k) for j in range(i, k) if sizes[i] + sizes[j] <= capacity]
    three = [(i, j, m) for i, j in two for m in range(j, k) if sizes[i] + sizes[j] + sizes[m] <= capacity]
    found = one + two + three
    columns = np.zeros((k, len(found)))
    for c, members in enumerate(found):
        for i in members:
            columns[i, c] += 1
    return columns


def fewest(columns: np.ndarray, demand: np.ndarray, steps: int = 20_000) -> dict[int, float]:
    """Least total of configurations that meets the demand exactly (fractions allowed), by the simplex method.

    The first columns are the single sizes, a first basis. Any basis reached is a
    valid answer; a warning tells if the best isn't reached in ``steps``.
    """
    k = len(demand)
    basis, inverse = list(range(k)), np.eye(k)
    level = demand.astype(float)
    for _ in range(steps):
        gain = inverse.sum(axis=0) @ columns - 1
        enter = int(np.argmax(gain))
        if gain[enter] < 1e-9:
            break
        move = inverse @ columns[:, enter]
        ratio = np.full(k, np.inf)
        ratio[move > 1e-9] = level[move > 1e-9] / move[move > 1e-9]
        leave = int(np.argmin(ratio))
        step = ratio[leave]
        level = np.maximum(level - step * move, 0)
        level[leave] = step
        inverse[leave] /= move[leave]
        other = np.arange(k) != leave
        inverse[other] -= np.outer(move[other], inverse[leave])
        basis[leave] = enter
    else:
        warnings.warn(f"configurations not at their best after {steps} steps", stacklevel=2)
    return {c: x for c, x in zip(basis, level, strict=True) if x > 0}


class Plan:
    """Runs (length, first rank, count, first sequence, offset) that place every piece."""

    def __init__(self, counts: np.ndarray, capacity: int, groups: int = GROUPS):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> runs of sequences
        left = [(length, 0, int(counts[length])) for length in range(1, capacity // 4 + 1) if counts[length]]
        if counts[capacity]:
            self._place(capacity, 0, int(counts[capacity]), self._open(int(counts[capacity])), 0)
        left += self._large(counts, groups)
        for length, first, n in sorted(left, reverse=True):
            self._best_fit(length, first, n)

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _place(self, length: int, first: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((length, first, n, sequence, offset))

    def _large(self, counts: np.ndarray, groups: int) -> list[tuple[int, int, int]]:
        """Place large pieces by configurations; what rounding down leaves over comes back as (length, first rank, count)."""
        lengths = np.array([x for x in range(self.capacity - 1, self.capacity // 4, -1) if counts[x]], dtype=np.int64)
        if not len(lengths):
            return []
        ends = np.cumsum(counts[lengths])
        begins = ends - counts[lengths]
        total = int(ends[-1])
        size = -(-total // groups)
        firsts = np.arange(0, total, size)
        sizes = lengths[np.searchsorted(ends, firsts, side="right")]
        demand = np.minimum(firsts + size, total) - firsts
        columns = configurations(sizes, self.capacity)
        used = firsts.copy()  # the next rank of each group
        for c, x in sorted(fewest(columns, demand).items()):
            n = int(x + 1e-9)
            slots = [g for g in np.flatnonzero(columns[:, c]) for _ in range(int(columns[g, c]))]
            n = min([n, *(int((firsts[g] + demand[g] - used[g]) // columns[g, c]) for g in set(slots))])
            if n <= 0:
                continue
            starts = []
            for g in slots:
                starts.append(int(used[g]))
                used[g] += n
            base = self._open(n)
            cuts = {0, n}
            for s in starts:  # where a slot's actual length changes
                cuts.update(int(e - s) for e in ends[(ends > s) & (ends < s + n)])
            cuts = sorted(cuts)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                offset = 0
                for s in starts:
                    at = int(np.searchsorted(ends, s + a, side="right"))
                    self._place(int(lengths[at]), s + a - int(begins[at]), b - a, base + a, offset)
                    offset += int(lengths[at])
                self.free[self.capacity - offset].append((base + a, b - a))
        left = []
        for first, to in zip(used, firsts + demand, strict=True):
            at = int(np.searchsorted(ends, first, side="right"))
            while first < to:
                stop = min(int(ends[at]), int(to))
                left.append((int(lengths[at]), int(first - begins[at]), int(stop - first)))
                first, at = stop, at + 1
        return left

    def _best_fit(self, length: int, first: int, n: int) -> None:
        room = length
        while n:
            while room <= self.capacity and not self.free.get(room):
                room += 1
            if room > self.capacity:
                fresh = -(-n // (self.capacity // length))
                self.free[self.capacity].append((self._open(fresh), fresh))
                room = length
                continue
            sequence, many = self.free[room].pop()
            take = min(many, n)
            if take < many:
                self.free[room].append((sequence + take, many - take))
            self._place(length, first, take, sequence, self.capacity - room)
            if room > length:
                self.free[room - length].append((sequence, take))
                room = max(length, min(room, room - length))
            first, n = first + take, n - take

    def table(self) -> tuple[np.ndarray, ...]:
        """Runs sorted by (length, first rank): keys, first ranks, first sequences, offsets."""
        runs = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 5)
        return (runs[:, 0] << 44) + runs[:, 1], runs[:, 1], runs[:, 3], runs[:, 4]


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", groups: int = GROUPS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty: a piece of the end id alone. Texts longer than a
    sequence are cut, others never. Null and repeated ids are packed like any
    other row; extra columns are ignored; an empty table gives no pieces. Pieces
    of a sequence lie one behind the other from offset 0.
    """
    pieces = materialise(cut_pieces(docs, capacity, tokenizer or default_path(), end_id, id_col, text_col), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in per_part.groupBy("length").agg(F.sum("n")).collect():  # a row per length
        counts[length] = n
    keys, firsts, sequences, offsets = Plan(counts, capacity, groups).table()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch.pop("rank").to_numpy()
            at = np.searchsorted(keys, (batch["length"].to_numpy() << 44) + rank, side="right") - 1
            batch["sequence_id"] = sequences[at] + rank - firsts[at]
            batch["offset"] = offsets[at]
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "rank").mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
