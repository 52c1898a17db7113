"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for each place, the hash of what stands before
it: the sum of code point times base to the power of the place, modulo a prime.
Any span's hash is the difference of two entries over a power of the base, so two
spans are compared in a step and the longest common extension of two places is
found by binary search. Two bases are kept.

A fingerprint keeps few entries of the array: at places a power of two apart, and
at anchors, places chosen by the hash of the window before them, which move with
their surroundings. Both sets are nested: a coarser one is part of a finer one, so
fingerprints of any two lengths can be compared.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytofold.llm.arrays import blocks, mix
from cytofold.llm.common import fill, materialise

U64 = np.uint64
PRIME = (1 << 31) - 1
_P, _SHIFT = U64(PRIME), U64(31)
BASES = tuple(int(b) for b in np.random.Generator(np.random.PCG64(20250301)).integers(1 << 24, PRIME - 1, 2))
#: A common run shorter than this, or than half the shorter text, is chance.
LEAST_RUN = 6
HEAD = struct.Struct("<IBBB2I")
ANCHOR = np.dtype([("at", "<u4"), ("level", "u1"), ("hash", "<u4", 2)])


def fold(x: np.ndarray) -> np.ndarray:
    """Values below 2**63 modulo the prime."""
    for _ in range(2):
        high = x >> _SHIFT
        x = x & _P
        x += high
    np.subtract(x, _P, out=x, where=x >= _P)
    return x


class Powers:
    """Powers of a base and of its inverse, as far as they were asked for."""

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, PRIME))
        self.tables = [np.ones(1, dtype=U64) for _ in self.bases]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.tables[0]) < n:
            m = len(self.tables[0])
            self.tables = [np.concatenate([t, fold(t * U64(pow(b, m, PRIME)))]) for t, b in zip(self.tables, self.bases, strict=True)]
        return self.tables[0], self.tables[1]


POWERS = [Powers(b) for b in BASES]


def prefix_arrays(codes: np.ndarray) -> list[np.ndarray]:
    """For each base, the hashes of the first 0, 1, ... code points."""
    out = []
    for powers in POWERS:
        terms = fold((codes.astype(U64) + U64(1)) * powers.upto(len(codes))[0][: len(codes)])
        out.append(fold(np.concatenate([np.zeros(1, U64), np.cumsum(terms)])))
    return out


def code_points(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)


@dataclass
class Places:
    """Ascending places of a text and the prefix hashes there, as plain integers."""

    at: list[int]
    hashes: tuple[list[int], list[int]]

    def equal(self, other: Places, i: int, j: int, steps: int) -> bool:
        """Whether ``steps`` steps from places i and j span the same text."""
        a, b = self.at[i], other.at[j]
        if self.at[i + steps] - a != other.at[j + steps] - b:
            return False
        if a == b:
            return all((mine[i + steps] - mine[i] - theirs[j + steps] + theirs[j]) % PRIME == 0 for mine, theirs in zip(self.hashes, other.hashes, strict=True))
        for mine, theirs, powers in zip(self.hashes, other.hashes, POWERS, strict=True):
            up = powers.upto(max(a, b) + 1)[0]
            if (mine[i + steps] - mine[i]) * int(up[b]) % PRIME != (theirs[j + steps] - theirs[j]) * int(up[a]) % PRIME:
                return False
        return True

    def extension(self, other: Places, i: int, j: int) -> int:
        """The most steps from places i and j that span the same text, by binary search."""
        low, high = 0, min(len(self.at) - i, len(other.at) - j) - 1
        if high and not self.equal(other, i, j, 1):
            return 0
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(other, i, j, middle) else (low, middle - 1)
        return low


def text_places(text: str) -> Places:
    """Every place of a text, for exact questions about its spans."""
    one, two = prefix_arrays(code_points(text.encode("utf-8", "replace")))
    return Places(list(range(len(one))), (one.tolist(), two.tolist()))


def spans_equal(a: Places, i: int, b: Places, j: int, length: int) -> bool:
    return a.equal(b, i, j, length)


def longest_common_extension(a: Places, i: int, b: Places, j: int) -> int:
    """How many code points agree from place i of one text and place j of the other."""
    return a.extension(b, i, j)


def fingerprints(codes: np.ndarray, offsets: np.ndarray, cells: int = 16, window: int = 16) -> list[bytes]:
    """A fingerprint for each text; texts are code points, one after the other, cut at ``offsets``.

    Each holds ``cells`` prefix hashes a power of two apart at most, and as many
    anchors at most, whatever the length. Takes about 60 bytes of memory for a
    code point of the block.
    """
    arrays = prefix_arrays(codes)
    inverses = [p.upto(len(codes) + 1)[1] for p in POWERS]
    spans = fold((arrays[0][window:] + _P - arrays[0][:-window]) * inverses[0][: max(0, len(codes) + 1 - window)]) if len(codes) >= window else np.zeros(0, U64)
    hashed = mix(spans + U64(1))
    levels = np.bitwise_count((hashed & (~hashed + U64(1))) - U64(1))  # trailing zeros; of the window that starts here
    heads, at, start, sizes = [], [], [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n, shift = b - a, 0
        while n >> shift > cells:
            shift += 1
        mine = levels[a : max(a, b - window)]  # windows that end before the text does
        low = max(0, shift - 2)
        found = np.flatnonzero(mine >= low)
        while low and len(found) <= cells:
            low -= 1
            found = np.flatnonzero(mine >= low)
        while len(found) > cells:
            low += 1
            found = found[mine[found] >= low]
        heads.append((n, shift, low, mine[found]))
        at += [np.array([n]), np.arange(1, (n >> shift) + 1) << shift, found + window]
        sizes += [len(x) for x in at[-3:]]
        start += [a] * 3
    where, first = np.concatenate(at), np.repeat(start, sizes)
    hashes = np.stack([fold((g[first + where] + _P - g[first]) * inverse[first]) for g, inverse in zip(arrays, inverses, strict=True)], axis=-1).astype("<u4")
    ends, out = np.cumsum(sizes).tolist(), []
    for k, (n, shift, low, of) in enumerate(heads):
        a, b, c = ends[3 * k : 3 * k + 3]
        anchors = np.zeros(c - b, dtype=ANCHOR)
        anchors["at"], anchors["level"], anchors["hash"] = where[b:c], of, hashes[b:c]
        out.append(HEAD.pack(n, shift, low, c - b, *hashes[a - 1].tolist()) + hashes[a:b].tobytes() + anchors.tobytes())
    return out


class Fingerprint:
    """A fingerprint taken apart: length, hash of all, grid and anchors."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.n, self.shift, self.level, count, *self.total = HEAD.unpack_from(raw)
        self.cells = self.n >> self.shift
        self.grid = np.frombuffer(raw, "<u4", 2 * self.cells, HEAD.size).reshape(self.cells, 2)
        self.anchors = np.frombuffer(raw, ANCHOR, count, HEAD.size + 8 * self.cells)
        self.known: dict[int, tuple[Places, list[tuple]]] = {}

    def places(self, at: list[int], hashes: np.ndarray, end: bool = True) -> Places:
        columns = [[0, *of] + [total] * end for of, total in zip(hashes.T.tolist(), self.total, strict=True)]
        return Places([0, *at] + [self.n] * end, (columns[0], columns[1]))

    def on_grid(self, shift: int, end: bool) -> Places:
        """Places ``1 << shift`` apart, and the end if asked for."""
        step = 1 << (shift - self.shift)
        hashes = self.grid[step - 1 :: step]
        return self.places([k << shift for k in range(1, len(hashes) + 1)], hashes, end)

    def on_anchors(self, level: int) -> tuple[Places, list[tuple]]:
        """Anchors of a level or more, and for each step between them its length and its hash, wherever it stands."""
        if level not in self.known:
            kept = self.anchors[self.anchors["level"] >= level]
            x = self.places(kept["at"].tolist(), kept["hash"])
            steps = [[b - a for a, b in zip(x.at[:-1], x.at[1:], strict=True)]]
            for hashes, powers in zip(x.hashes, POWERS, strict=True):
                down = powers.upto(self.n + 1)[1][x.at[:-1]].tolist()
                steps.append([(b - a) * d % PRIME for a, b, d in zip(hashes[:-1], hashes[1:], down, strict=True)])
            self.known[level] = x, list(zip(*steps, strict=True))
        return self.known[level]


def _runs_in_place(a: Places, b: Places) -> Iterator[int]:
    """Lengths of the runs that stand at the same places of both texts."""
    i, last = 0, min(len(a.at), len(b.at)) - 1
    while i < last:
        steps = a.extension(b, i, i)
        if steps:
            yield a.at[i + steps] - a.at[i]
        i += steps + 1  # the next step differs


def _runs_by_anchor(one: tuple[Places, list[tuple]], two: tuple[Places, list[tuple]]) -> Iterator[int]:
    """Lengths of runs that both texts have somewhere: from each step, the longest one not yet taken from the other text."""
    (a, steps_a), (b, steps_b) = one, two
    if not set(steps_a) & set(steps_b):
        return
    where: dict[tuple, list[int]] = {}
    for j, step in enumerate(steps_b):
        where.setdefault(step, []).append(j)
    taken, i = set(), 0
    for k, step in enumerate(steps_a):
        if k < i or step not in where:
            continue
        best, at = 0, 0
        for j in where[step]:
            steps = 0 if j in taken else a.extension(b, k, j)
            steps = next((s for s in range(steps) if j + s in taken), steps)
            best, at = max((best, at), (steps, j))
        if best:
            yield a.at[k + best] - a.at[k]
            taken.update(range(at, at + best))
            i = k + best


def likeness(one: bytes, two: bytes) -> float:
    """Share of the longer text that the other has as well, from 0 to 1, as far as the fingerprints tell; 1 if they are equal.

    The larger of two measures: runs that stand at the same places, and runs
    between anchors wherever they stand. Runs of chance don't count. An empty text
    is like another empty one only.
    """
    return 1.0 if one == two else alike(Fingerprint(one), Fingerprint(two))


def alike(a: Fingerprint, b: Fingerprint) -> float:
    if a.raw == b.raw:
        return 1.0
    if not a.n or not b.n:
        return 0.0
    least = min(LEAST_RUN, (min(a.n, b.n) + 1) // 2)
    shift, level = max(a.shift, b.shift), max(a.level, b.level)
    in_place = sum(r for r in _runs_in_place(a.on_grid(shift, a.n == b.n), b.on_grid(shift, a.n == b.n)) if r >= least)
    moved = sum(r for r in _runs_by_anchor(a.on_anchors(level), b.on_anchors(level)) if r >= least)
    return min(max(in_place, moved) / max(a.n, b.n), 1.0)


class Texts:
    """A block of texts as bytes and code points, with where each begins in both."""

    def __init__(self, data: bytes, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        raw = np.frombuffer(data, dtype=np.uint8)
        self.starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        self.at = np.searchsorted(self.starts, offsets)
        self.sizes = np.diff(self.at)

    def cut(self, row: int, first: int, last: int) -> bytes:
        """Code points ``first`` to ``last`` of a text."""
        at = self.at[row]
        return self.data[self.starts[at + first] : self.starts[at + last]]

    def fingerprints(self, **options: int) -> list[bytes]:
        return fingerprints(code_points(self.data), self.at, **options)

    @staticmethod
    def of(texts: list[bytes]) -> Texts:
        return Texts(b"".join(texts), np.cumsum([0] + [len(t) for t in texts]))


def decodable(data: np.ndarray, offsets: np.ndarray) -> Texts:
    """The texts of a block; bytes that are no UTF-8 become replacement characters."""
    raw = data.tobytes()
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return Texts.of([raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
    return Texts(raw, offsets)


def edited(texts: Texts, row: int, after: Texts, after_row: int) -> bytes:
    """A text whose last quarter gives way to as much of the beginning of the next one."""
    n, more = int(texts.sizes[row]), int(after.sizes[after_row])
    return texts.cut(row, 0, n - n // 4) + after.cut(after_row, 0, min(n // 4, more))


COMPLETE = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
SCHEMA = f"{COMPLETE}, part int, first_last boolean, first_id long, first_tie long, text string, head string, head_fingerprint binary"
NAMES = [c.strip().split()[0] for c in SCHEMA.split(",")]


def _compared(texts: list[tuple[Texts, int]], marks: list[bytes], options: dict[str, int]) -> tuple[list[str], list[bytes], list[float], list[float]]:
    """For each text but the last: hash and fingerprint of its edited text, and the likeness of its fingerprint to that one and to the next text's."""
    blobs = [edited(*texts[k], *texts[k + 1]) for k in range(len(texts) - 1)]
    new = Texts.of(blobs).fingerprints(**options)
    own = [Fingerprint(m) for m in marks]
    return (
        [hashlib.sha256(x).hexdigest() for x in blobs], new,
        [alike(a, Fingerprint(b)) for a, b in zip(own[:-1], new, strict=True)], [alike(a, b) for a, b in zip(own[:-1], own[1:], strict=True)],
    )


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = 16, window: int = 16) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text counts as empty. The next document is the one that follows by
    ascending id, null ids last, rows that share an id in the order of a hash of
    their texts; after the last comes the first, also where there is one document
    only. Columns beside id and text are ignored, so clashing names do no harm. An
    empty table gives an empty result.

    Texts are shuffled once, into ranges of ids. Of each range only the first and
    the last text are looked at again, to pair them across the ranges.
    """
    options = {"cells": cells, "window": window}

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, last = None, None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, data, offsets in blocks(batch.column(1), 1 << 18):
                texts = decodable(data, offsets)
                marks = texts.fingerprints(**options)
                n = len(marks)
                if first is None:
                    first = (ids[at] is None, ids[at], batch.column(2)[at].as_py(), texts.cut(0, 0, int(texts.sizes[0])).decode(), marks[0])
                before = [] if last is None else [last]
                rows = [(x[1], x[2]) for x in before] + [(texts, k) for k in range(n)]
                found = [x[3] for x in before] + marks
                of = [x[0] for x in before] + ids[at : at + n]
                if len(rows) > 1:
                    done = _compared(rows, found, options)
                    columns = [pa.array(of[:-1], pa.int64()), pa.array([int(t.sizes[k]) for t, k in rows[:-1]], pa.int64()), pa.array(done[0]), pa.array(found[:-1], pa.binary()), pa.array(done[1], pa.binary()), pa.array(done[2]), pa.array(done[3])]
                    nulls = [pa.nulls(len(of) - 1, t) for t in (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns + nulls, names=NAMES)
                last = (of[-1], Texts.of([texts.cut(n - 1, 0, int(texts.sizes[n - 1]))]), 0, found[-1])
        if last is not None:
            row = dict.fromkeys(NAMES) | {"doc_id": last[0], "n_chars": int(last[1].sizes[0]), "fingerprint": last[3], "text": last[1].data.decode(), "part": TaskContext.get().partitionId()}
            row |= dict(zip(("first_last", "first_id", "first_tie", "head", "head_fingerprint"), first, strict=True))
            types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in zip(NAMES, types, strict=True)], names=NAMES)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pair = [(Texts.of([row[c].encode()]), 0) for c in ("text", "head")]
                done = _compared(pair, [row["fingerprint"], row["head_fingerprint"]], options)
                values = [row["doc_id"], row["n_chars"], done[0][0], row["fingerprint"], done[1][0], done[2][0], done[3][0]]
                types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=NAMES[:7])

    text = fill(F.col(f"`{text_col}`"))
    order = ["last", "doc_id", "tie"]
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie")).withColumn("last", F.col("doc_id").isNull())
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(ranged.select("doc_id", "text", "tie").mapInArrow(within, SCHEMA), "fingerprints")
    edges = rows.where("part is not null")
    # A row of keys for each range; equal keys are in one range, so keys order the ranges.
    parts = [r["part"] for r in sorted(edges.select("part", "first_last", "first_id", "first_tie").collect(), key=lambda r: (r["first_last"], r["first_id"] or 0, r["first_tie"]))]
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)) or [(-1, -1)], "part int, next int")
    heads = edges.select(F.col("part").alias("next"), "head", "head_fingerprint")
    pairs = edges.select("doc_id", "n_chars", "fingerprint", "text", "part").join(F.broadcast(follows), "part").join(heads, "next")
    ends = pairs.select("doc_id", "n_chars", "fingerprint", "text", "head", "head_fingerprint").mapInArrow(across, COMPLETE)
    return rows.where("part is null").select(*NAMES[:7]).unionByName(ends).withColumns({c: as_text(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


def as_text(fingerprint: Column) -> Column:
    """A fingerprint as a string of hexadecimal digits, which ``bytes.fromhex`` reads."""
    return F.lower(F.hex(fingerprint))
