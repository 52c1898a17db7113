"""Near duplicates on word shingles: fast similarity sketching, banding, exact verification.

A sketch has ``COORDINATES`` coordinates. In round i every shingle is thrown into
a random bin with value i + a random fraction and bins keep their least value;
rounds go on until every bin is filled, and after ``COORDINATES`` rounds the
round number itself names the bin, so every bin is filled for certain. Agreeing
coordinates estimate the Jaccard similarity with Chernoff-like concentration.

Documents with equal shingle sets are one node. Nodes that share a band are
candidates: 4 coordinates a band and 40 bands miss a pair of similarity 0.75 with
probability (1 - 0.75^4)^40, about 3e-7. Links are confirmed on full shingle sets.
A few rounds link the nodes of a bucket with one of them. Then nodes that share
buckets are dealt to blocks, and blocks that meet in a bucket and aren't yet in
one class are held against each other whole, so that no bucket, however large,
loses a link that the classes depend on. A pair of different classes goes to the
full sets unless its sketches put it over ``DEVIATIONS`` standard deviations below the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytofold.llm.arrays import MIX, U64, blocks, mix, word_hashes
from cytofold.llm.common import KEY, fill, join_split, key_columns, keyed_rows, materialise, nth_row
from cytofold.llm.components import components

WIDTH = 5
BANDS, ROWS = 40, 4
COORDINATES = BANDS * ROWS
#: Rounds that link nodes with one of their bucket.
ROUNDS = 2
#: Nodes of a block, about.
BLOCK = 256
#: Bytes of full sets in a block, on average.
BLOCK_BYTES = 8 << 20
#: Pairs of one node that are confirmed in one chunk; more are dealt to further chunks.
CHUNK = 256
#: Pairs whose sketches lie this many standard deviations below the bound are taken for different.
DEVIATIONS = 6


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block; with fewer words, the whole sequence is one shingle."""
    words, bounds = word_hashes(data, offsets)
    if len(words) >= WIDTH:
        n = len(words) - WIDTH + 1
        shingles = words[:n] * MIX[2]
        for k in range(1, WIDTH):
            shingles += mix(words[k : n + k] + MIX[k]) * MIX[2 + k]
        shingles = mix(shingles)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            yield np.unique(shingles[a : b - WIDTH + 1])
        elif b > a:
            whole = U64(0)
            for k, w in enumerate(words[a:b]):
                whole = mix(np.array([whole ^ w]) * MIX[20 + k] + MIX[30 + b - a])[0]
            yield np.array([whole], dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)


_seeds = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * MIX[40])


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The coordinates' least values as 16-bit fingerprints."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    at, n = 0, len(shingles)
    while at < COORDINATES:
        rounds = np.arange(at, min(COORDINATES, at + max(1, 1024 // n)))
        thrown = mix(shingles[None, :] ^ _seeds[rounds][:, None])
        bins = (thrown & U64(0xFFFFFFFF)) % U64(COORDINATES)
        values = (rounds.astype(np.uint64) << U64(48))[:, None] | (thrown >> U64(16))
        np.minimum.at(best, bins.ravel().astype(np.int64), values.ravel())
        at = int(rounds[-1]) + 1
        if best.max() < np.iinfo(np.uint64).max:
            break
    for b in np.flatnonzero(best == np.iinfo(np.uint64).max):
        best[b] = (U64(COORDINATES + b) << U64(48)) | (mix(shingles ^ _seeds[COORDINATES + b]) >> U64(16)).min()
    return (mix(best) >> U64(48)).astype("<u2")


def most_differing(percent: int) -> int:
    """The largest number of differing coordinates that a pair at the bound has, but for ``DEVIATIONS`` standard deviations."""
    p = 1 - percent / 100
    return int(COORDINATES * p + DEVIATIONS * (COORDINATES * p * (1 - p)) ** 0.5) + 1


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, a 128-bit digest of the shingle set (hi, lo), and the sketch (null without shingles)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in blocks(batch.column(1)):
                sizes, high, low, sketches = [], [], [], []
                for shingles in shingle_sets(data, offsets):
                    sizes.append(len(shingles))
                    high.append(int(mix(shingles + MIX[50]).sum(dtype=np.uint64).astype(np.int64)))
                    low.append(int(mix(shingles ^ MIX[51]).sum(dtype=np.uint64).astype(np.int64)))
                    sketches.append(sketch(shingles).tobytes() if len(shingles) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sizes)), batch.column(2).slice(at, len(sizes)), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sketches, pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "hi", "lo", "sketch"],
                )

    return docs.mapInArrow(sign, "doc_id long, text_key long, n_shingles long, hi long, lo long, sketch binary")


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) for the nodes (node, rep, hi, lo), from a text of the document ``rep`` (last, doc_id, text_key)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            # Repeated rows lie together; one of them gives the set.
            node = batch.column(0).to_pylist()
            fresh = [i for i, k in enumerate(node) if not (k in seen or seen.add(k))]
            batch = batch.take(pa.array(fresh, pa.int64()))
            for at, data, offsets in blocks(batch.column(1)):
                found = list(shingle_sets(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(found)), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "shingles"])

    wanted = nodes.select("node", *key_columns(F.col("rep.doc_id"), F.col("rep.text_key")))
    texts = docs.select(*key_columns(F.col("doc_id"), F.col("text_key")), "text").join(wanted, KEY).select("node", "text")
    return texts.mapInArrow(sets, "node long, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Rows of a chunk of pairs meet sorted: first the set of ``a``, then the sets
    of its partners, one at a time. A node with many partners has many chunks.
    """
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = pairs.join(chunks, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")))
    first = dealt.select("a", "chunk").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "shingles")
    others = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "chunk", "b", "shingles")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            left, right = [], []
            for a, b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shingles = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                if b is None:
                    held, mine = a, shingles.copy()
                    continue
                small, large = (shingles, mine) if len(shingles) < len(mine) else (mine, shingles)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                if a == held and 100 * both >= percent * (len(small) + len(large) - both):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    met = first.unionByName(others).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return met.select("a", "b", "shingles").mapInArrow(check, "a long, b long")


def blocks_of(placed: DataFrame, reps: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (block, node, comp, sketch, shingles) in blocks, and the pairs of blocks (one, two) to compare.

    A node goes to its least neighbour's group and by hash to one of the group's
    blocks, which are as many as keep their nodes to ``BLOCK`` and the bytes of
    their sets to ``BLOCK_BYTES`` on average. Blocks are compared if they share a bucket and hold two classes.
    """
    low = placed.groupBy("band").agg(F.min("node").alias("low"))
    nodes = placed.join(low, "band").groupBy("node").agg(F.min("low").alias("low"), F.first("comp").alias("comp"), F.first("n_shingles").alias("n"))
    slots = nodes.groupBy("low").agg(F.ceil(F.greatest(F.count("*") / BLOCK, 8 * F.sum("n") / BLOCK_BYTES)).alias("slots"))
    nodes = materialise(nodes.join(slots, "low").select("node", "comp", F.xxhash64("low", F.pmod(F.xxhash64("node"), F.col("slots"))).alias("block")), "blocks")
    present = placed.select("band", "node").join(nodes, "node").groupBy("band", "block").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    mixed = present.groupBy("band").agg(F.min("c0").alias("m0"), F.max("c1").alias("m1")).where("m0 <> m1").select("band")
    side = lambda s: present.join(mixed, "band").select("band", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "c0", "c1")))
    met = side("a").join(side("b"), "band").where("block_a <= block_b and not (c0_a = c1_a and c0_b = c1_b and c0_a = c0_b)")
    pairs = met.select(F.col("block_a").alias("one"), F.col("block_b").alias("two")).distinct()
    return nodes.join(reps.select("node", "sketch"), "node").join(sets, "node"), pairs


def compare_blocks(nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes of different classes of all pairs of blocks; classes that a link has joined count as one."""
    both = pairs.select("one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block")).join(nodes, "block")
    bound = most_differing(percent)

    def compare(table: pa.Table) -> pa.Table:
        node, comp = table["node"].to_pylist(), table["comp"].to_pylist()
        coordinates = np.stack([np.frombuffer(b, dtype="<u2") for b in table["sketch"].to_pylist()])
        shingles = [np.frombuffer(b, dtype=np.uint64) for b in table["shingles"].to_pylist()]
        size = np.array([len(x) for x in shingles])
        second = np.array(table["block"]) == table["two"][0].as_py()
        first = np.array(table["block"]) == table["one"][0].as_py()
        own = {c: c for c in comp}

        def root(c: int) -> int:
            while own[c] != c:
                own[c] = own[own[c]]
                c = own[c]
            return c

        left, right = [], []
        for i in np.flatnonzero(first).tolist():
            apart = (coordinates != coordinates[i]).sum(axis=1) <= bound
            near = 100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])
            for j in np.flatnonzero(apart & near & second).tolist():
                a, b = root(comp[i]), root(comp[j])
                if a == b:
                    continue
                at = np.searchsorted(shingles[i], shingles[j])
                shared = int((shingles[i][np.minimum(at, size[i] - 1)] == shingles[j]).sum())
                if 100 * shared >= percent * (size[i] + size[j] - shared):
                    own[max(a, b)] = min(a, b)
                    left.append(node[i])
                    right.append(node[j])
        return pa.Table.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return both.groupBy("one", "two").applyInArrow(compare, "a long, b long")


def node_classes(docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(node, comp) for the nodes that have links."""
    bands = F.array(*(F.xxhash64(F.lit(b), F.substring("sketch", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)))
    keyed = reps.select("node", "n_shingles", F.explode(bands).alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = materialise(keyed.join(shared, "band"), "members")
    used = reps.join(members.select("node").distinct(), "node").select("node", "rep", "hi", "lo")
    sets = materialise(full_sets(docs, used), "sets")
    # Sets whose sizes differ too much can't be similar enough.
    near_size = lambda a, b: (100 * F.least(a, b)) >= (percent * F.greatest(a, b))

    links, comp = None, members.select("node").distinct().withColumn("comp", F.col("node"))
    for turn in range(ROUNDS):
        placed = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        by = (F.xxhash64("node", F.lit(turn)) if turn else F.col("node")).alias("by")
        pick = F.min(F.struct(by, "node", "comp", "n_shingles")).alias("p")
        picks = placed.groupBy("band").agg(pick, F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("band", F.col("p.node").alias("to"), F.col("p.comp").alias("to_comp"), F.col("p.n_shingles").alias("to_n"))
        tried = placed.join(picks, "band").where((F.col("comp") != F.col("to_comp")) & near_size(F.col("n_shingles"), F.col("to_n")))
        best = tried.groupBy("node", "to").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("to", F.struct("n", "to")).alias("to"))
        found = materialise(confirm(best.select(F.col("to").alias("a"), F.col("node").alias("b")), sets, percent), "links")
        links = found if links is None else links.unionByName(found)
        comp = components(links)

    placed = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    found = materialise(compare_blocks(*blocks_of(placed, reps, sets), percent), "links")
    return comp if found.isEmpty() else components(links.unionByName(found))


def classified(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n_shingles, comp, least) for each document that has shingles, and (doc_id, text_key) for the others.

    ``least`` is the first document of the class: null ids come last, rows that
    share an id in the order of a hash of their texts.
    """
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(fill(text)).alias("text_key"))
    signed = materialise(signatures(texts), "signatures")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    some = signed.where("n_shingles > 0").select("doc_id", "text_key", "n_shingles", "hi", "lo", "sketch")
    reps = some.groupBy("hi", "lo", "n_shingles").agg(F.min(place).alias("rep"), F.max("sketch").alias("sketch"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())
    reps = materialise(reps, "nodes")
    named = materialise(reps.select("hi", "lo", "node", "rep", "n").join(node_classes(texts, reps, percent), "node", "left"), "named")
    # A node alone is its class; the others meet the first document of theirs.
    linked = named.where("comp is not null").withColumnRenamed("n", "docs")
    least = materialise(linked.groupBy("comp").agg(F.min("rep").alias("least"), F.count("*").alias("n")), "classes")
    found = join_split(linked, least, ["comp"]).select("hi", "lo", "comp", "least", F.col("docs").alias("n"))
    alone = named.where("comp is null").select("hi", "lo", F.col("node").alias("comp"), F.col("rep").alias("least"), "n")
    classes = materialise(found.unionByName(alone), "members")
    rows = join_split(some.drop("sketch"), classes, ["hi", "lo"]).select("doc_id", "text_key", "n_shingles", "comp", "least")
    return rows, signed.where("n_shingles = 0").select("doc_id", "text_key")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Texts without words, null ones too, have an empty set, are linked with
    nothing and stay. component_id is the smallest id of the class, null ids
    ignored (null if a class has no other), and kept is doc_id = component_id;
    rows with null ids are kept only if their class has no id. Rows that share an
    id but not a text are nodes of their own. Extra columns are ignored.
    """
    rows, alone = classified(docs, id_col, text_col, percent)
    linked = rows.select("doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"))
    alone = alone.select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return linked.unionByName(alone).select("*", kept.alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were: one row of each class, the first (see ``classified``).

    Texts without words stay, but of rows that agree in id and text one only,
    that whose columns hash least.
    """
    rows, alone = classified(docs, id_col, text_col, percent)
    first = rows.where(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key") == F.col("least")).select("doc_id", "text_key")
    kept = first.unionByName(alone).select(*key_columns(F.col("doc_id"), F.col("text_key")))
    keyed = keyed_rows(docs, F.col(f"`{id_col}`").cast("long"), F.xxhash64(fill(F.col(f"`{text_col}`"))))
    return keyed.join(kept, KEY, "left_semi").withColumn("_nth", nth_row(keyed)).where("_nth = 1").select("_row.*")
