"""Most probable states and state posteriors along chains of segments, a chunk of a chain at a time.

A chain is cut in chunks. The scores of a chunk and the transitions between and
into its segments make a matrix from the state before the chunk to the state at
its end: a product over (max, +) for the best path, over (log-sum, +) for
posteriors. Scores and transitions are finite. Products of chunks are worked out side by side; a scan over chunks,
which reads vectors and matrices but no segments, gives the message that enters
each chunk, and with it the chunk's own states follow. No task holds more than a
chunk of a chain.

A product of a chunk soon is a sum of a vector for the state before and one for
the state at the end, since paths from all states join; from then on it takes
vectors only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytofold.sources.storage import materialise

#: Transitions within so many nats of each other can be summed in plain numbers without loss.
PLAIN_NATS = 600.0
#: What a row of a message is: a row of the matrix from 0 on, or one of these.
FIRST, BEFORE, AFTER = -1, -2, -3


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def largest(x: np.ndarray, axis: int) -> np.ndarray:
    return x.max(axis=axis)


def max_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product over (max, +)."""
    out = np.full((len(a), b.shape[1]), -np.inf)
    for k in range(a.shape[1]):
        np.maximum(out, a[:, k, None] + b[k], out=out)
    return out


def sum_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product over (log-sum, +)."""
    if np.ptp(b) < PLAIN_NATS:
        top, high = a.max(axis=1, keepdims=True), b.max()
        return np.log(np.exp(a - top) @ np.exp(b - high)) + top + high
    return np.stack([log_sum(row[:, None] + b, 0) for row in a])


class Algebra:
    """How values of paths are joined: by the best or by their log-sum."""

    def __init__(self, join: Callable, product: Callable):
        self.join, self.product = join, product


BEST, SUM = Algebra(largest, max_product), Algebra(log_sum, sum_product)


def enter(message: np.ndarray | None, scores: np.ndarray, step: np.ndarray, algebra: Algebra) -> np.ndarray:
    """Values by state at a segment, from those at the segment before; without one, the scores."""
    return scores if message is None else algebra.join(message[:, None] + step, 0) + scores


def each_step(transition: np.ndarray, n: int) -> list[np.ndarray]:
    """The same transition into each of n segments."""
    return [transition] * n


def forward(scores: np.ndarray, steps: list[np.ndarray], message: np.ndarray | None, algebra: Algebra) -> np.ndarray:
    """Values by segment and state; ``steps`` are the transitions into each segment."""
    out = []
    for row, step in zip(scores, steps, strict=True):
        message = enter(message, row, step, algebra)
        out.append(message)
    return np.array(out)


def chunk_product(scores: np.ndarray, steps: list[np.ndarray], algebra: Algebra) -> tuple[np.ndarray, np.ndarray] | np.ndarray:
    """From the state before a chunk to the state at its end: a matrix, or the two vectors whose sums it holds."""
    matrix = steps[0] + scores[0]
    for k in range(1, len(scores) + 1):
        shift = matrix.max(axis=1, keepdims=True)
        gap = matrix - shift - (matrix[:1] - shift[:1])
        if np.ptp(gap, axis=1).max() <= 64 * np.finfo(float).eps * np.abs(matrix).max():
            rest = forward(scores[k:], steps[k:], matrix[0] - shift[0], algebra)
            return shift[:, 0] + gap[:, 0], rest[-1] if len(rest) else matrix[0] - shift[0]
        if k < len(scores):
            matrix = algebra.product(matrix, steps[k]) + scores[k]
    return matrix


def trace(values: np.ndarray, steps: list[np.ndarray], message: np.ndarray | None, end: int) -> tuple[list[int], int]:
    """States of a chunk whose last one is ``end``, and the state before the chunk (-1: none); ties go to the first state."""
    path = [end]
    for k in range(len(values) - 1, 0, -1):
        path.append(int((values[k - 1] + steps[k][:, path[-1]]).argmax()))
    before = -1 if message is None else int((message + steps[0][:, path[-1]]).argmax())
    return path[::-1], before


def best_path(scores: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """States of a whole chain with the largest sum of scores and transitions; ties go to the first state."""
    steps = each_step(transition, len(scores))
    values = forward(scores, steps, None, BEST)
    return np.array(trace(values, steps, None, int(values[-1].argmax()))[0])


def marginals(scores: np.ndarray, steps: list[np.ndarray], message: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Posterior of each state of a chunk, from the messages that enter it at both ends."""
    ahead = forward(scores, steps, message, SUM)
    behind = [np.zeros(scores.shape[1]) if after is None else after]
    for row, step in zip(scores[:0:-1], steps[:0:-1], strict=True):
        behind.append(log_sum(step + (row + behind[-1]), 1))
    joint = ahead + np.array(behind[::-1])
    p = np.exp(joint - joint.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def reader(matrices: np.ndarray) -> Callable[[list], tuple]:
    """Reads a chunk: its scores, the transition into each segment, and the segments' numbers."""

    def read(items: list) -> tuple[np.ndarray, list[np.ndarray], list]:
        return np.array([list(i["scores"]) for i in items], dtype=float), [matrices[i["step"]] for i in items], [i["segment_idx"] for i in items]

    return read


class Chains:
    """Scored segments in chunks, a row of the table for each, and the messages between them.

    ``arrays`` has ``keys`` (which name sample, candidate and chain), segment_idx,
    scores (an array by state) and, where transitions differ between adjacencies,
    ``step``: the number of the matrix that leads into the segment. Null scores
    count as 0 for all states, null steps as the first matrix. Of rows that share
    keys and segment_idx all take part, one after the other.
    """

    def __init__(self, arrays: DataFrame, keys: list[str], matrices: np.ndarray, chunk: int):
        if chunk < 1:
            raise ValueError("a chunk has a segment at least")
        self.keys, self.matrices = keys, matrices if matrices.ndim == 3 else matrices[None]
        self.types = dict(arrays.dtypes)
        self.named = ", ".join(f"`{k}` {self.types[k]}" for k in keys)
        step = F.coalesce(F.col("step").cast("int"), F.lit(0)) if "step" in arrays.columns else F.lit(0)
        none = F.array_repeat(F.lit(0.0), self.matrices.shape[1])
        item = F.struct("segment_idx", step.alias("step"), F.coalesce("scores", none).alias("scores"))
        rows = arrays.select(*keys, F.floor(F.col("segment_idx") / chunk).cast("long").alias("chunk"), item.alias("item"))
        # A group holds a chunk, whose size is bounded.
        self.chunks = materialise(rows.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list("item")).alias("items")), "chunks")
        self.ends = self.chunks.groupBy(*keys).agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"))

    def several(self) -> bool:
        """Whether any chain has more than one chunk, so that messages are needed."""
        return not self.ends.where("first < last").isEmpty()

    def each(self, rows: DataFrame, make: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
        """``make`` applied to each row, with the keys put before what it yields."""
        keys = self.keys
        columns = [*keys, *(c.strip().split()[0] for c in schema.split(","))]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    out = list(make(row))
                    yield pd.DataFrame([(*(row[k] for k in keys), *o) for o in out], columns=columns)

        return rows.mapInPandas(run, f"{self.named}, {schema}")

    def products(self, algebra: Algebra) -> DataFrame:
        """(keys, chunk, row, v): what each chunk makes of the message before it; chunks that start a chain give their vector."""

        read = reader(self.matrices)

        def make(row: dict) -> Iterator[tuple]:
            scores, steps, _ = read(row["items"])
            if row["chunk"] == row["first"]:
                yield row["chunk"], FIRST, forward(scores, steps, None, algebra)[-1]
                return
            got = chunk_product(scores, steps, algebra)
            for k, v in [(BEFORE, got[0]), (AFTER, got[1])] if isinstance(got, tuple) else enumerate(got):
                yield row["chunk"], k, v

        return materialise(self.each(self.chunks.join(self.ends, self.keys), make, "chunk long, row int, v array<double>"), "products")

    def scan(self, products: DataFrame, apply: Callable, backward: bool = False, start=None) -> DataFrame:
        """(keys, chunk, message): carry a value from chunk to chunk of each chain; a chunk gets the value that reaches it.

        ``apply(value, rows)`` gives the value behind a chunk from the one before
        it. Chunks come in order in a stream; of each only its own rows are held.
        """
        keys = self.keys

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            chain, chunk, held, value = None, None, {}, start
            for batch in batches:
                out = []
                for *name, at, k, v in zip(*(batch[c] for c in [*keys, "chunk", "row", "v"]), strict=True):
                    if (name, at) != (chain, chunk):
                        value = apply(value, held) if name == chain else start
                        chain, chunk, held = name, at, {}
                        out.append((*name, at, value))
                    held[k] = np.array(v)
                yield pd.DataFrame(out, columns=[*keys, "chunk", "message"])

        order = [*keys, F.desc("chunk") if backward else "chunk"]
        placed = products.repartition(*keys).sortWithinPartitions(*order)
        return materialise(placed.mapInPandas(run, f"{self.named}, chunk long, message array<double>"), "messages")


def _through(algebra: Algebra, value: np.ndarray | None, held: dict[int, np.ndarray]) -> np.ndarray:
    """The message behind a chunk from the one before it."""
    if FIRST in held:
        return held[FIRST]
    if BEFORE in held:
        return algebra.join(value + held[BEFORE], 0) + held[AFTER]
    return algebra.join(value[:, None] + np.stack([held[k] for k in range(len(held))]), 0)


def _back_through(value: np.ndarray | None, held: dict[int, np.ndarray]) -> np.ndarray | None:
    """The message before a chunk from the one behind it, for posteriors; none is needed before the first."""
    if FIRST in held:
        return None
    if BEFORE in held:
        return held[BEFORE] + log_sum(held[AFTER] + (0.0 if value is None else value), 0)
    return log_sum(np.stack([held[k] for k in range(len(held))]) + (0.0 if value is None else value), 1)


def _array(x) -> np.ndarray | None:
    return None if x is None or isinstance(x, float) else np.array(x)


def decode_chain(arrays: DataFrame, keys: list[str], matrices: np.ndarray, chunk: int = 256) -> DataFrame:
    """(keys, segment_idx, state): the most probable states of every chain; ties go to the first state.

    ``matrices`` are transition scores between states, one for all adjacencies or
    several that ``step`` of the arrays names; see ``Chains``. An empty table gives
    an empty result.
    """
    chains = Chains(arrays, keys, matrices, chunk)
    read = reader(chains.matrices)
    rows = chains.chunks.withColumn("message", F.lit(None).cast("array<double>")).withColumn("end", F.lit(None).cast("int"))
    if chains.several():
        entering = chains.scan(chains.products(BEST), lambda value, held: _through(BEST, value, held))
        met = chains.chunks.join(entering, [*keys, "chunk"])

        def lead(row: dict) -> Iterator[tuple]:
            """The state before a chunk for each state at its end, and last the best of the latter."""
            scores, steps, _ = read(row["items"])
            message = _array(row["message"])
            values, back = forward(scores, steps, message, BEST), None
            for k in range(len(values)):
                before = message if k == 0 else values[k - 1]
                if before is not None:
                    pointer = (before[:, None] + steps[k]).argmax(axis=0)
                    back = pointer if back is None else back[pointer]
            back = np.full(scores.shape[1], -1) if message is None else back
            yield row["chunk"], 0, np.append(back, values[-1].argmax()).astype(float)

        leads = materialise(chains.each(met, lead, "chunk long, row int, v array<double>"), "leads")
        ending = chains.scan(leads, lambda value, held: np.array([held[0][int(held[0][-1] if value is None else value[0])]]), backward=True)
        rows = met.join(ending.select(*keys, "chunk", F.col("message")[0].cast("int").alias("end")), [*keys, "chunk"])

    def states(row: dict) -> Iterator[tuple]:
        scores, steps, segments = read(row["items"])
        message = _array(row["message"])
        values = forward(scores, steps, message, BEST)
        end = values[-1].argmax() if row["end"] is None or np.isnan(row["end"]) else row["end"]
        yield from zip(segments, trace(values, steps, message, int(end))[0], strict=True)

    return chains.each(rows, states, f"segment_idx {chains.types['segment_idx']}, state int")


def chain_posteriors(arrays: DataFrame, keys: list[str], matrices: np.ndarray, chunk: int = 256) -> DataFrame:
    """(keys, segment_idx, state, posterior) for every segment and state, along its chain; see ``decode_chain``."""
    chains = Chains(arrays, keys, matrices, chunk)
    read = reader(chains.matrices)
    rows = chains.chunks.withColumns({c: F.lit(None).cast("array<double>") for c in ("message", "after")})
    if chains.several():
        products = chains.products(SUM)
        entering = chains.scan(products, lambda value, held: _through(SUM, value, held))
        behind = chains.scan(products, _back_through, backward=True).withColumnRenamed("message", "after")
        rows = chains.chunks.join(entering, [*keys, "chunk"]).join(behind, [*keys, "chunk"])

    def spread(row: dict) -> Iterator[tuple]:
        scores, steps, segments = read(row["items"])
        p = marginals(scores, steps, _array(row["message"]), _array(row["after"]))
        for segment, of in zip(segments, p, strict=True):
            yield segment, of

    got = chains.each(rows, spread, f"segment_idx {chains.types['segment_idx']}, p array<double>")
    return got.select(*keys, "segment_idx", F.posexplode("p").alias("state", "posterior"))
