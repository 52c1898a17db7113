"""LM scoring with a hierarchical Pitman-Yor model of word pairs.

A token sits in the restaurant of its context, the word before it, named by its
64-bit hash, so that there are as many restaurants as words. All context
restaurants share one parent, whose customers are their tables, and the parent's
base is uniform over the words known and one unknown. Tables are sampled by
Gibbs: given everything else, the number of tables of a dish with c customers has
probability proportional to

    S(c, t) * prod_{i < t} (strength + discount * (other tables + i)) * p(dish)^t

with generalised Stirling numbers S, by their recurrence for small c and by an
integral of their generating function beyond (``log_stirling``). Dishes of a
round see the totals of the round before. Predictive probabilities are averaged over
the rounds after the burn-in.

The corpus is worked in blocks. A chunk of documents sends its distinct (word,
context) pairs and their training counts to shards. Shards form a grid, a row by
the word's hash and a column by the context's, so that the pairs of a frequent
word or context are spread over many. Each round a shard sends its tables, added
up by context and by word, to groups of contexts and of words; a group adds them
up, seats the parent's customers of its words, and sends each shard the totals of
its own contexts and words. So totals are distributed tables as large as the
vocabulary, of which no worker holds more than its share. Then shards answer each
chunk's pairs with probabilities. All counts come from all training documents.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytofold.llm.arrays import MIX, U64, blocks, mix, word_hashes
from cytofold.llm.common import Shelf, fill, fold, materialise, named, release_shuffles

START = U64(0xA0761D6478BD642F)  # the context of a text's first token
END = U64(0x5BD1E9955BD1E995)
#: Stirling numbers come from their recurrence up to this many customers, and from an integral beyond; draws follow the same conditional.
RECURRENCE = 512
CONTEXTS, WORDS = 0, 1


def pack_up(values: np.ndarray) -> bytes:
    """Bytes of unsigned integers: width and number, then their byte planes, compressed."""
    values = np.ascontiguousarray(values).astype("<u8", copy=False)
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(raw) -> np.ndarray:
    raw = raw if isinstance(raw, bytes) else raw.as_py()
    width, n = raw[0], int.from_bytes(raw[1:9], "little")
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(raw[9:], width * n, codec="zstd"), dtype=np.uint8).reshape(width, n).T
    return out.ravel().view("<i8")


def pack_hashes(ascending: np.ndarray) -> bytes:
    return pack_up(np.diff(ascending, prepend=U64(0)))


def unpack_hashes(raw) -> np.ndarray:
    return np.cumsum(unpack(raw).view(np.uint64), dtype=np.uint64)


@dataclass(frozen=True)
class Grid:
    """Shards in rows by word and columns by context; a row's words and a column's contexts are cut into groups again."""

    rows: int
    columns: int

    def shard(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        row, column = mix(word + MIX[202]) % U64(self.rows), mix(context + MIX[203]) % U64(self.columns)
        return (row * U64(self.columns) + column).astype(np.int64)

    def groups(self, shard: int, kind: int, ascending: np.ndarray) -> np.ndarray:
        """The group of each of a shard's contexts or words, ascending."""
        row, column = divmod(shard, self.columns)
        outer, n = (column, self.rows) if kind == CONTEXTS else (row, self.columns)
        return outer * n + (((ascending >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


def batch_of(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    types = {name: pa.list_(kinds[kind[6:-1]]) if kind.startswith("array<") else kinds[kind] for name, kind in (f.split() for f in schema.split(", "))}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


# Chunks and the pairs that they ask for

CHUNKED = "chunk long, words binary, doc_ids array<long>, held array<boolean>, sizes binary, tokens binary"
KEYS = "chunk long, shard int, words binary, spread binary, names binary, contexts binary, counts binary"


def chunk_up(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """A row for each chunk of documents: its distinct words, frequent ones first, and the tokens as numbers of these."""

    def chunk_row(number: int, ids: list, held: list, hashes: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        codes, words = pd.factorize(np.concatenate(hashes))
        order = np.argsort(-np.bincount(codes), kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return batch_of(CHUNKED, [[number], [words[order].tobytes()], [ids], [held], [pack_up(np.concatenate(sizes))], [pack_up(place[codes])]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, held, hashes, sizes, held_bytes = [], [], [], [], 0
        for batch in batches:
            for at, data, offsets in blocks(batch.column(1)):
                words, bounds = word_hashes(data, offsets)
                n = len(offsets) - 1
                hashes.append(np.insert(words, bounds[1:], END))
                sizes.append(np.diff(bounds) + 1)
                ids += batch.column(0).slice(at, n).to_pylist()
                held += batch.column(2).slice(at, n).to_pylist()
                held_bytes += len(data)
                if held_bytes >= chunk_bytes:
                    yield chunk_row(number, ids, held, hashes, sizes)
                    number, ids, held, hashes, sizes, held_bytes = number + 1, [], [], [], [], 0
        if ids:
            yield chunk_row(number, ids, held, hashes, sizes)

    return docs.mapInArrow(cut, CHUNKED)


def pairs_of(row: dict, grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shard, word, context, training count) of a chunk's distinct pairs in this order, and the pair number of each token."""
    words, size = np.frombuffer(row["words"], dtype=np.uint64)[unpack(row["tokens"])], unpack(row["sizes"])
    n = len(words)
    context = np.empty(n, dtype=np.uint64)
    context[1:] = words[:-1]
    context[np.cumsum(size) - size] = START
    trained = np.repeat(~np.array(row["held"], dtype=bool), size)
    codes, _ = pd.factorize(mix(words ^ mix(context + MIX[201])))
    first = np.empty(codes.max() + 1, dtype=np.int64)
    first[codes[::-1]] = np.arange(n)[::-1]
    word, ctx = words[first], context[first]
    count = np.bincount(codes, trained, minlength=len(first)).astype(np.int64)
    shard = grid.shard(word, ctx)
    order = np.lexsort((ctx, word, shard))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return shard[order], word[order], ctx[order], count[order], place[codes]


def starts_of(ascending: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.append(True, ascending[1:] != ascending[:-1])) if len(ascending) else np.zeros(0, np.int64)


def pair_keys(chunks: DataFrame, grid: Grid) -> DataFrame:
    """Distinct pairs of each chunk for each shard, made anew from the tokens so that they are held on disk once."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = batch.slice(k, 1).to_pylist()[0]
                shard, word, ctx, count, _ = pairs_of(chunk, grid)
                bounds = np.append(starts_of(shard), len(shard)).tolist()
                out = []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    new = starts_of(word[a:b])
                    names, codes = np.unique(ctx[a:b], return_inverse=True)
                    out.append((chunk["chunk"], int(shard[a]), pack_hashes(word[a:b][new]), pack_up(np.diff(np.append(new, b - a))), pack_hashes(names), pack_up(codes), pack_up(count[a:b])))
                yield batch_of(KEYS, [list(c) for c in zip(*out, strict=True)])

    return chunks.select("chunk", "words", "held", "sizes", "tokens").mapInArrow(keys, KEYS)


SHARDS = "shard int, words binary, spread binary, names binary, contexts binary, counts binary, chunks array<long>, asked array<binary>"


def build_shards(keys: DataFrame) -> DataFrame:
    """A row for each shard: its pairs with training counts, and for each chunk which of them it asked for."""

    def build(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [(np.repeat(unpack_hashes(r["words"]), unpack(r["spread"])), unpack_hashes(r["names"])[unpack(r["contexts"])], unpack(r["counts"])) for r in rows]
        word, ctx, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        sizes = [len(c) for _, c, _ in parts]
        order = np.lexsort((ctx, word))
        word, ctx = word[order], ctx[order]
        new = np.append(True, (word[1:] != word[:-1]) | (ctx[1:] != ctx[:-1]))
        number = np.cumsum(new) - 1
        where = np.empty(len(order), dtype=np.int64)
        where[order] = number
        total = np.bincount(number, count[order]).astype(np.int64)
        word, ctx = word[new], ctx[new]
        fresh = starts_of(word)
        names, codes = np.unique(ctx, return_inverse=True)
        asked = [pack_up(np.diff(w, prepend=0)) for w in np.split(where, np.cumsum(sizes)[:-1])]
        columns = [[rows[0]["shard"]], [pack_hashes(word[fresh])], [pack_up(np.diff(np.append(fresh, len(word))))], [pack_hashes(names)], [pack_up(codes)], [pack_up(total)], [[r["chunk"] for r in rows]], [asked]]
        return pa.Table.from_batches([batch_of(SHARDS, columns)])

    return keys.groupBy("shard").applyInArrow(build, SHARDS)


# Sampling


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for x of ten and more."""
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


@functools.lru_cache(maxsize=4)
def stirling_table(discount: float, most: int = RECURRENCE) -> np.ndarray:
    """Logarithms of generalised Stirling numbers S(c, t) for c, t up to ``most``, by their recurrence."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)) + out[c, 1:], -np.inf)
        out[c + 1, 1:] = np.logaddexp(stay, out[c, :-1])
    return out


def log_ratio(x: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """log g and its slope at x = log(1 - z), for g(z) = z F'(z) / F(z) and F(z) = 1 - (1 - z)^d."""
    e, f = np.expm1(x), np.expm1(d * x)
    return math.log(d) + np.log(-e) + (d - 1) * x - np.log(-f), np.exp(x) / e + (d - 1) - d * np.exp(d * x) / f


@functools.lru_cache(maxsize=4)
def ratio_grid(discount: float) -> tuple[np.ndarray, np.ndarray]:
    x = -np.exp(np.linspace(math.log(1e-9), math.log(600.0), 6000))
    return log_ratio(x, discount)[0], x


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithms of S(c, t) for 1 <= t <= c and large c, to about a hundredth or better.

    S(c, t) = c! / t! / d^t * [z^c] F(z)^t with F(z) = 1 - (1 - z)^d. The coefficient
    is an integral along 1 - z = w (1 + i k y)^2, a parabola around the cut of F
    from 1 on that goes through the saddle point z F'(z) / F(z) = c / t.
    """
    c, t = np.asarray(c, dtype=float), np.asarray(t, dtype=float)
    ratio = np.log(c / t)
    x = np.interp(ratio, *ratio_grid(d))
    for _ in range(3):
        now, slope = log_ratio(x, d)
        x = np.minimum(x - np.clip((now - ratio) / slope, -0.5 * np.abs(x), 0.5 * np.abs(x)), -1e-12)
    slope, w = log_ratio(x, d)[1], np.exp(x)
    log_z, log_f = np.log(-np.expm1(x)), np.log(-np.expm1(d * x))
    k = np.minimum(0.5 * np.sqrt(-np.expm1(x) / (c * np.maximum(-slope, 1e-300) * w)), 1 / np.sqrt(c * w))
    y = np.arange(17) * (6 / 16)
    bend = np.log(1 + 1j * k[:, None] * y)
    here_z, here_f = np.log(1 - np.exp(x[:, None] + 2 * bend)), np.log(1 - np.exp(d * (x[:, None] + 2 * bend)))
    values = np.exp(t[:, None] * (here_f - log_f[:, None]) - c[:, None] * (here_z - log_z[:, None]) - here_z + bend).real
    integral = (values.sum(axis=1) - values[:, 0] / 2) * (6 / 16) * 2 * k * w / math.pi
    few = np.array([math.lgamma(n + 1) for n in range(11)])[np.minimum(t, 10).astype(int)]
    factorial = np.where(t > 10, log_gamma(np.maximum(t, 10) + 1), few)
    return np.where(t == c, 0.0, log_gamma(c + 1) - factorial - t * math.log(d) + t * log_f - c * log_z + np.log(np.maximum(integral, 1e-300)))


def many_customers(count: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, strength: float, u: np.ndarray, nodes: int = 65) -> np.ndarray:
    """Tables of dishes with more than ``RECURRENCE`` customers, drawn by the uniforms ``u``.

    The logarithm of the conditional is worked out at ``nodes`` places around its
    mode, eight deviations to both sides, and is linear between them.
    """
    ten = np.arange(10)

    def weight(t: np.ndarray) -> np.ndarray:
        seats = strength / d + others
        # prod_{i < t} (strength + d (others + i)) = d^t gamma(seats + t) / gamma(seats), moved by ten so that the series is good
        rising = log_gamma(seats + t + 10) - log_gamma(seats + 10) + np.log((seats[:, None] + ten) / (seats[:, None] + t[:, None] + ten)).sum(axis=1)
        return log_stirling(count, t, d) + rising + t * (math.log(d) + np.log(base))

    low, high = np.ones(len(count)), count.astype(float)
    while (low < high).any():  # the least t whose follower weighs no more
        mid = np.floor((low + high) / 2)
        up = weight(np.minimum(mid + 1, count)) > weight(mid)
        low, high = np.where(up, np.minimum(mid + 1, high), low), np.where(up, high, mid)
    side = np.maximum(np.minimum(np.ceil(np.sqrt(low)), np.minimum(low - 1, count - low)), 1)
    curve = 2 * weight(low) - weight(np.clip(low - side, 1, count)) - weight(np.clip(low + side, 1, count))
    reach = np.ceil(8 * side / np.sqrt(np.maximum(curve, 1e-2)) + 20)
    first, last = np.maximum(1, low - reach), np.minimum(count, low + reach)
    places = np.stack([np.rint(first + (last - first) * k / (nodes - 1)) for k in range(nodes)], axis=1)
    heights = np.stack([weight(places[:, k]) for k in range(nodes)], axis=1)
    out = np.empty(len(count), dtype=np.int64)
    for k in range(len(count)):
        t = np.arange(first[k], last[k] + 1)
        upto = np.cumsum(np.exp(np.interp(t, places[k], heights[k]) - heights[k].max()))
        out[k] = t[min(np.searchsorted(upto, u[k] * upto[-1]), len(t) - 1)]
    return out


def sample_tables(count: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with ``count`` customers, dish probability ``base`` and ``others`` tables beside theirs."""
    tables = np.minimum(count, 1)
    u = rng.random(len(count))
    order = np.argsort(count, kind="stable")
    ordered = count[order]
    values, begins = np.unique(ordered, return_index=True)
    stirling = stirling_table(discount)
    for c, a, b in zip(values.tolist(), begins.tolist(), np.append(begins[1:], len(ordered)).tolist(), strict=True):
        if c < 2 or c > RECURRENCE:
            continue
        step = max(1, (1 << 20) // c)
        for at in range(a, b, step):
            rows = order[at : min(b, at + step)]
            weight = np.log(strength + discount * (others[rows][:, None] + np.arange(c)))
            weight += np.log(base[rows])[:, None]
            np.cumsum(weight, axis=1, out=weight)
            weight += stirling[c, 1 : c + 1]
            weight -= weight.max(axis=1, keepdims=True)
            np.cumsum(np.exp(weight, out=weight), axis=1, out=weight)
            tables[rows] = 1 + (u[rows][:, None] * weight[:, -1:] > weight[:, :-1]).sum(axis=1)
    big = order[np.searchsorted(ordered, RECURRENCE + 1) :]
    for rows in np.array_split(big, -(-len(big) // 4096)) if len(big) else ():
        tables[rows] = many_customers(count[rows], base[rows], others[rows].astype(float), discount, strength, u[rows])
    return tables


# Rounds


@dataclass(frozen=True)
class Settings:
    discount: float
    parent_discount: float
    strength: float
    parent_strength: float
    seed: int


@dataclass(frozen=True)
class Parent:
    """Customers and tables of the parent restaurant; words known in training, tokens, pairs met once and twice, words with one customer and two at the start."""

    customers: float
    tables: float
    known: float
    tokens: float
    once: float
    twice: float
    single: float
    double: float


class Shard:
    """The pairs of a shard: numbers of word and context among its ``words`` and ``names``, and training count."""

    def __init__(self, row: dict):
        self.number, self.words, self.names = row["shard"], unpack_hashes(row["words"]), unpack_hashes(row["names"])
        self.word = np.repeat(np.arange(len(self.words)), unpack(row["spread"]))
        self.context, self.count = unpack(row["contexts"]), unpack(row["counts"])

    def by(self, kind: int, values: np.ndarray) -> np.ndarray:
        """``values`` of the pairs, added up by context or by word."""
        at, n = (self.context, len(self.names)) if kind == CONTEXTS else (self.word, len(self.words))
        return np.bincount(at, values, minlength=n).astype(np.int64)


def whole(parts: list[dict], kind: int, column: str) -> np.ndarray:
    """What the groups of a kind sent, in the order of the shard's contexts or words."""
    return np.concatenate([unpack(p[column]) for p in sorted(parts, key=lambda p: p["grp"]) if p["kind"] == kind])


class Seats:
    """What a shard knows after a round: its tables, and the totals of its contexts and words."""

    def __init__(self, parts: list[dict]):
        self.tables = unpack(next(p["y"] for p in parts if p["kind"] < 0))
        self.context_tables, self.word_customers, self.word_tables = whole(parts, CONTEXTS, "y"), whole(parts, WORDS, "y"), whole(parts, WORDS, "z")

    def parent_probability(self, parent: Parent, s: Settings) -> np.ndarray:
        """Of each of the shard's words."""
        new = (s.parent_strength + s.parent_discount * parent.tables) / (parent.known + 1)
        return (np.maximum(self.word_customers - s.parent_discount * self.word_tables, 0) + new) / (s.parent_strength + parent.customers)


SENT = "shard int, kind int, grp int, names binary, x binary, y binary, sums array<double>"
ADDED = "shard int, kind int, grp int, codes binary, x binary, y binary, z binary, sums array<double>"


class Rounds:
    """Rounds of Gibbs sampling over the shards; their states are tables in the shared folder.

    x are training counts (in the first round only), y tables, and z the parent's
    tables of a word.
    """

    def __init__(self, keys: DataFrame, grid: Grid):
        self.spark, self.shelf, self.grid = keys.sparkSession, Shelf(keys.sparkSession), grid
        self.shards = self.shelf.put(build_shards(keys), "lm-shards")
        release_shuffles(self.spark)
        self.states: list[DataFrame] = []  # (shard, parts) after each round
        self.parents: list[Parent] = []
        self.links = self.owned = None  # places of a shard's names in their group; the parent's tables of a group's words

    def run(self, settings: Settings | None) -> None:
        """One round more; the first gives each dish one table."""
        grid, turn = self.grid, len(self.states)
        parent = self.parents[-1] if turn else None

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    shard = Shard(row)
                    if turn:
                        seats = Seats(row["parts"])
                        rng = np.random.Generator(np.random.PCG64([settings.seed, shard.number, turn]))
                        base = seats.parent_probability(parent, settings)[shard.word]
                        tables = sample_tables(shard.count, base, np.maximum(seats.context_tables[shard.context] - seats.tables, 0), settings.discount, settings.strength, rng)
                    else:
                        tables = np.minimum(shard.count, 1)
                    met = [float((shard.count == k).sum()) for k in (1, 2)]
                    out = [(shard.number, -1, 0, None, None, pack_up(tables), [0.0, 0.0, 0.0, float(shard.count.sum()), *met, 0.0, 0.0])]
                    for kind, names in ((CONTEXTS, shard.names), (WORDS, shard.words)):
                        x, y = None if turn else shard.by(kind, shard.count), shard.by(kind, tables)
                        groups = grid.groups(shard.number, kind, names)
                        bounds = np.append(starts_of(groups), len(groups)).tolist()
                        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                            first = (None, None) if turn else (pack_hashes(names[a:b]), pack_up(x[a:b]))
                            out.append((shard.number, kind, int(groups[a]), *first, pack_up(y[a:b]), None))
                    yield batch_of(SENT, [list(c) for c in zip(*out, strict=True)])

        def add(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
            own = rows.pop(0) if rows[0]["shard"] < 0 else None
            kind, grp = table["kind"][0].as_py(), table["grp"][0].as_py()
            if turn:
                codes = [unpack(r["codes"]) for r in rows]
            else:
                names = [unpack_hashes(r["names"]) for r in rows]
                codes = np.split(np.unique(np.concatenate(names), return_inverse=True)[1], np.cumsum([len(x) for x in names])[:-1])
            size = 1 + max(int(c.max()) for c in codes)
            total = lambda column: sum(np.bincount(at, unpack(r[column]), minlength=size) for at, r in zip(codes, rows, strict=True)).astype(np.int64)
            x, y, z = None if turn else total("x"), total("y"), None
            if kind == WORDS and turn:
                rng = np.random.Generator(np.random.PCG64([settings.seed, 1 << 40, grp, turn]))
                others = np.maximum(parent.tables - unpack(own["y"]), 0)
                z = sample_tables(y, np.full(size, 1 / (parent.known + 1)), others, settings.parent_discount, settings.parent_strength, rng)
            elif kind == WORDS:
                z = np.minimum(y, 1)
            some = lambda values, c: None if values is None else pack_up(values[c])
            out = [(r["shard"], kind, grp, None if turn else pack_up(c), some(x, c), pack_up(y[c]), some(z, c), None) for r, c in zip(rows, codes, strict=True)]
            if kind == WORDS:
                sums = [float(y.sum()), float(z.sum()), 0.0 if turn else float((x > 0).sum()), 0.0, 0.0, 0.0, float((y == 1).sum()), float((y == 2).sum())]
                out.append((-1, kind, grp, None, None, pack_up(z), None, sums))
            return pa.Table.from_batches([batch_of(ADDED, [list(c) for c in zip(*out, strict=True)])])

        brief = Shelf(self.spark)
        rows = self.shards.select("shard", "words", "spread", "names", "contexts", "counts")
        sent = brief.put((rows.join(self.states[-1], "shard") if turn else rows).mapInArrow(send, SENT), "lm-sent")
        messages = sent.where("kind >= 0")
        if turn:
            messages = messages.select("shard", "kind", "grp", "y").join(self.links, ["shard", "kind", "grp"]).unionByName(self.owned.withColumn("codes", F.lit(None).cast("binary")))
        added = brief.put(messages.groupBy("kind", "grp").applyInArrow(add, ADDED), "lm-added")
        replies = added.where("shard >= 0").select("shard", "kind", "grp", "x", "y", "z")
        replies = replies.unionByName(sent.where("kind < 0").select("shard", "kind", "grp", "x", "y", F.lit(None).cast("binary").alias("z")))
        self.states.append(self.shelf.put(replies.groupBy("shard").agg(F.collect_list(F.struct("kind", "grp", "x", "y", "z")).alias("parts")), "lm-state"))
        self.owned = self.shelf.put(added.where("shard < 0").select("shard", "kind", "grp", "y"), "lm-owned")
        numbers = added.select("sums").unionByName(sent.select("sums")).agg(*(F.coalesce(F.sum(F.get("sums", F.lit(k))), F.lit(0.0)) for k in range(8))).first()
        if turn:
            self.parents.append(Parent(*numbers[:2], parent.known, *numbers[3:]))
        else:
            self.links = self.shelf.put(added.where("shard >= 0").select("shard", "kind", "grp", "codes"), "lm-links")
            self.parents.append(Parent(*numbers))
        brief.clear()


def answer(rounds: Rounds, settings: Settings, samples: list[int]) -> DataFrame:
    """(chunk, shard, p, counts, spread): probabilities of the pairs that a chunk asked for, averaged over the rounds ``samples``, and training counts of their words."""
    parents = rounds.parents
    schema = "chunk long, shard int, p binary, counts binary, spread binary"

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                context_counts, word_counts = (whole(row["round_0"], kind, "x") for kind in (CONTEXTS, WORDS))
                p = np.zeros(len(shard.count))
                for turn in samples:
                    seats = Seats(row[f"round_{turn}"])
                    parent = seats.parent_probability(parents[turn], settings)[shard.word]
                    new = settings.strength + settings.discount * seats.context_tables[shard.context]
                    p += (np.maximum(shard.count - settings.discount * seats.tables, 0) + new * parent) / (settings.strength + context_counts[shard.context])
                bits = (p / len(samples)).astype("<f4").view("<u4")
                for chunk, asked in zip(row["chunks"], row["asked"], strict=True):
                    at = np.cumsum(unpack(asked))
                    word = shard.word[at]
                    fresh = starts_of(word)
                    yield batch_of(schema, [[chunk], [shard.number], [pack_up(bits[at])], [pack_up(word_counts[word[fresh]])], [pack_up(np.diff(np.append(fresh, len(at))))]])

    rows = rounds.shards
    for turn in sorted({0, *samples}):
        rows = rows.join(rounds.states[turn].withColumnRenamed("parts", f"round_{turn}"), "shard")
    return rows.mapInArrow(reply, schema)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 0, folds: int = 10, strength: float = 1.0, parent_strength: float = 10.0, rounds: int = 3, burn_in: int = 1, seed: int = 5,
    chunk_bytes: int = 8 << 20, shard_chars: int = 16 << 20,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, log10_perplexity.

    Learns from documents outside fold ``held_out`` and scores all. Null text
    counts as empty: one end token. ``score`` is the log10 probability of the
    text's tokens, ``base_score`` that of additive smoothing; log10_perplexity
    is -score / n_tokens. Without training tokens both rest on the unknown word.
    Null and repeated ids are scored row by row; an empty table gives an empty
    result. Discounts come from how many dishes have one and two customers.
    ``rounds`` - ``burn_in`` samples are averaged. A task holds a chunk of
    ``chunk_bytes`` of text or the pairs of about ``shard_chars`` of it; larger
    ones make fewer messages between chunks and shards.
    """
    texts = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"), (fold(named(id_col), folds) == held_out).alias("held_out"))
    chars = texts.agg(F.sum(F.length(fill(F.col("text"))))).first()[0] or 0
    shards = max(12, -(-chars // shard_chars))
    side = math.isqrt(shards - 1) + 1
    grid = Grid(side, -(-shards // side))
    chunks = materialise(chunk_up(texts, chunk_bytes), "lm-chunks")
    gibbs = Rounds(pair_keys(chunks, grid), grid)
    gibbs.run(None)
    start = gibbs.parents[0]
    rate = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5
    settings = Settings(rate(start.once, start.twice), rate(start.single, start.double), strength, parent_strength, seed)
    for _ in range(rounds):
        gibbs.run(settings)
    n, v = int(start.tokens), int(start.known)
    replies = materialise(answer(gibbs, settings, list(range(burn_in + 1, rounds + 1))), "lm-replies")
    gibbs.shelf.clear()

    def score(text: pa.Table, reply: pa.Table) -> pa.Table:
        rows = sorted(reply.select(["shard", "p", "counts", "spread"]).to_pylist(), key=lambda r: r["shard"])
        logs = np.log10(np.concatenate([unpack(r["p"]).astype("<u4").view("<f4") for r in rows]).astype(float))
        count = np.concatenate([np.repeat(unpack(r["counts"]), unpack(r["spread"])) for r in rows])
        base = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
        one = text.to_pylist()[0]
        sizes, at = unpack(one["sizes"]), pairs_of(one, grid)[-1]
        first = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x[at], first)
        return pa.Table.from_batches([batch_of(SCORED, [one["doc_ids"], one["held"], sizes, add((count > 0).astype(np.int64)), np.full(len(sizes), n), add(base), add(logs)])])

    scored = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(score, SCORED)
    return scored.withColumn("log10_perplexity", -F.col("score") / F.col("n_tokens"))
