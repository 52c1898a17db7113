"""Line dedup within an edit bound, by deletion neighbourhoods.

A line goes if an earlier line of the corpus equals it or is one insertion,
deletion or substitution away; earlier means smaller (doc_id, line number).

Two lines one substitution apart agree after deleting the same position; two
lines one insertion apart agree after deleting a position of the longer. So the
variants of a line are itself and all its one-letter deletions, as hashed keys.
Lines that meet in a key (variant, position) are all within the bound of each
other, as are a line and those that have it as a deletion. Lines are numbered in
the order of their first places, so the least number by key, pre-aggregated before
the shuffle, replaces the pairs, and each line's earliest neighbour is confirmed
on the texts, in time linear in their length. A line whose earliest neighbour
proves to be none is held against all earlier lines that it meets.

Only lines that could have a neighbour emit variants: a single edit leaves the
first or the last half alone, so halves found in one line only rule it out.

The bound is 0 or 1 edits: the variants of two edits are the square of a line's
length in number. Lines are told apart by 128 bits of their hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytofold.llm.arrays import U64, mix
from cytofold.llm.common import KEY, SPACE_CHARS, Shelf, fill, global_rank, join_split, key_columns, keyed_rows, materialise, nth_row, release_shuffles
from cytofold.llm.quality_rules import let

#: An odd number and its inverse modulo 2^64, the base of the position weights of line hashes.
BASE = 0x9E3779B97F4A7C15
#: Rows that the table of low key bits has at most.
FILTER = 1 << 20
INVERSE = pow(BASE, -1, 1 << 64)
#: Variants of an Arrow batch, about.
BATCH = 1 << 16
WORDED = r"[^\x20\x09-\x0D]"


#: The two halves of a line's hash.
LINE = ["key", "check"]


def line_hash(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit(BASE & 0xFFFF), line)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, at, line, key, check): trimmed lines that have a word, with a 128-bit hash in two halves."""
    text = F.col(f"`{text_col}`")
    parts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(fill(text)).alias("text_key"), F.posexplode(F.split(fill(text), "\n")).alias("at", "line"))
    trimmed = parts.select("doc_id", "text_key", "at", F.btrim("line", F.lit(SPACE_CHARS)).alias("line")).where("line <> ''")
    return trimmed.withColumns(dict(zip(LINE, line_hash(F.col("line")), strict=True)))


def place() -> Column:
    """Where a line stands in the corpus: null ids come last, rows that share an id in the order of a hash of their texts."""
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", F.col("at").cast("int").alias("at"))


def half_keys(line: Column) -> Column:
    """Hashes of the first and last h letters for h = half of this length or of one less."""
    n = F.length(line)
    halves = (F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int"))  # the same for odd lengths
    return F.array_distinct(F.array(*(x for h in halves for x in (F.xxhash64(F.lit("first"), h, F.substring(line, F.lit(1), h)), F.xxhash64(F.lit("last"), h, F.substring(line, n - h + 1, h))))))


def variants(lines: DataFrame) -> DataFrame:
    """(id, variant, position, fresh) of the lines (id, line): position -1 is the line itself.

    Deleting any letter of a run of equal ones gives the same variant; all but
    the first of them are not ``fresh``. Substitutions need each position.
    """
    names = ["id", "variant", "position", "fresh"]

    def of(ident: int, line: str) -> tuple[np.ndarray, ...]:
        points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        n = len(points)
        steps = np.full(n + 1, BASE, dtype=np.uint64)
        steps[0] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(points + U64(1)) * np.multiply.accumulate(steps)[:n], dtype=np.uint64)])
        cut = sums[:n] + (sums[n] - sums[1:]) * U64(INVERSE)
        fresh = np.ones(n + 1, dtype=bool)
        fresh[2:] = points[1:] != points[:-1]
        sizes = np.concatenate([[n], np.full(n, n - 1)]).astype(np.uint64)
        return np.full(n + 1, ident), mix(np.concatenate([sums[n:], cut]) ^ mix(sizes)).astype(np.int64), np.arange(-1, n, dtype=np.int32), fresh

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for ident, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(of(ident, line))
                size += len(held[-1][0])
                if size >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)

    return lines.select("id", "line").mapInArrow(emit, "id long, variant long, position int, fresh boolean")


def likely_texts(lines: DataFrame, marks: DataFrame, firsts: DataFrame) -> DataFrame:
    """(id, key, check, line, first) of the distinct lines that share a half with another line, numbered in the order of their first places."""
    brief = Shelf(lines.sparkSession)
    # Repeated lines become one before they meet others, so that a frequent line is no hot key of its halves.
    halves = brief.put(marks.select(*LINE, F.explode("halves").alias("half")).distinct(), "halves")
    release_shuffles(lines.sparkSession)
    ends = [f(c).alias(f"{c}_{n}") for c in LINE for n, f in enumerate((F.min, F.max))]
    shared = halves.groupBy("half").agg(*ends).where("key_0 <> key_1 or check_0 <> check_1").select("half")
    wanted = brief.put(halves.join(shared, "half", "left_semi").select(*LINE).distinct(), "wanted")
    # The texts of other lines are kept off the shuffle by the low bits of the keys, a table of FILTER rows at most.
    low = F.col("key").bitwiseAND(F.lit(FILTER - 1))
    passed = wanted.select(low.alias("low")).distinct()
    near = lines.select(*LINE, "line", low.alias("low")).join(F.broadcast(passed), "low", "left_semi").groupBy(*LINE).agg(F.first("line").alias("line"))
    texts = near.join(wanted, LINE, "left_semi").join(firsts.select(*LINE, "first"), LINE)
    order = {f"by_{k}": F.col("first").getField(k) for k in ("last", "doc_id", "text_key", "at")}
    ranked = materialise(global_rank(texts.withColumns(order), *order).select(F.col("rank").alias("id"), *LINE, "line", "first"), "lines")
    brief.clear()
    return ranked


def within_one(a: str, b: str) -> bool:
    """Whether two texts are equal or one insertion, deletion or substitution apart, in linear time."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    low, high = 0, len(a)  # how much they agree in from the start, by halves of what is left
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, near): the earliest line of the pairs (id, other) that is within one edit indeed."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([within_one(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["id", "other"])

    of = texts.select("id", "line")
    met = pairs.join(of, "id").join(of.select(F.col("id").alias("other"), F.col("line").alias("other_line")), "other").select("id", "other", "line", "other_line")
    return met.mapInArrow(check, "id long, other long").groupBy("id").agg(F.min("other").alias("near"))


def earliest_neighbours(lines: DataFrame, marks: DataFrame, firsts: DataFrame) -> DataFrame:
    """(key, check, near): the first place of the earliest line within one edit, for lines that have one before them."""
    texts, brief = likely_texts(lines, marks, firsts), Shelf(lines.sparkSession)
    placed = brief.put(variants(texts), "variants")
    release_shuffles(lines.sparkSession)

    # Substitutions: lines that agree after deleting the same position.
    deleted = placed.where("position >= 0")
    groups = deleted.groupBy("variant", "position").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("variant", "position", "low")
    swapped = deleted.join(groups, ["variant", "position"]).select("id", "low")
    # Insertions: a line and those of which it is a deletion, once for each run of equal letters.
    once = deleted.where("fresh")
    whole = placed.where("position = -1").select("variant", F.col("id").alias("short"))
    longer = once.groupBy("variant").agg(F.min("id").alias("low"))
    grown = whole.join(longer, "variant").select(F.col("short").alias("id"), "low")
    shrunk = once.join(whole, "variant").select("id", F.col("short").alias("low"))

    # One after the other, so that their shuffles don't add up.
    found = None
    for kind in (swapped, grown, shrunk):
        some = brief.put(kind.where("low < id").groupBy("id").agg(F.min("low").alias("low")), "candidates")
        found = some if found is None else found.unionByName(some)
        release_shuffles(lines.sparkSession)
    pairs = found.groupBy("id").agg(F.min("low").alias("other"))
    near = materialise(confirmed(pairs, texts), "near")
    failed = pairs.join(near, "id", "left_anti").select("id")
    if not failed.isEmpty():
        # A candidate was none, since two variants' hashes agree by chance: all earlier lines that such lines meet are looked at.
        mine = placed.join(failed, "id", "left_semi").select("variant", "position", "fresh", F.col("id").alias("mine"))
        both = mine.join(deleted, ["variant", "position"]).select("mine", "id")
        up = mine.where("position = -1").select("variant", "mine").join(once, "variant").select("mine", "id")
        down = mine.where("position >= 0 and fresh").select("variant", "mine").join(whole, "variant").select("mine", F.col("short").alias("id"))
        met = both.unionByName(up).unionByName(down).where("id < mine").select(F.col("mine").alias("id"), F.col("id").alias("other")).distinct()
        near = materialise(near.unionByName(confirmed(met, texts)), "near")
    brief.clear()
    place_of = texts.select(F.col("id").alias("near"), F.col("first").alias("near_first"))
    return near.join(place_of, "near").join(texts.select("id", *LINE), "id").select(*LINE, F.col("near_first").alias("near"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1) -> DataFrame:
    """(doc_id, text_key, at) of the lines that go; rows that agree in id and text count as one. ``edits`` is 0 (equal lines only) or 1."""
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    lines = lines_of(docs, id_col, text_col)
    # Lines are cut and hashed once; their texts stay where they are.
    columns = ["doc_id", "text_key", "at", *LINE] + ([half_keys(F.col("line")).alias("halves")] if edits else [])
    marks = materialise(lines.select(*columns), "line-marks")
    firsts = materialise(marks.groupBy(*LINE).agg(F.min(place()).alias("first"), F.count("*").alias("n")), "firsts")
    verdict = firsts
    if edits:
        near = earliest_neighbours(lines, marks, firsts)
        verdict = firsts.join(near, LINE, "left").select(*LINE, F.least("first", F.coalesce("near", "first")).alias("first"), "n")
    here = marks.select(*LINE, "doc_id", "text_key", "at", place().alias("here"))
    gone = join_split(here, materialise(verdict, "verdict"), LINE).where("first < here")
    return gone.select("doc_id", "text_key", "at")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, dropped (line numbers from 0, ascending).

    Lines are what newlines separate, white space at both ends ignored; lines
    without a word are neither counted nor dropped. Null and empty texts have no
    lines. Null ids come last in the order; rows that share an id are ordered by
    a hash of their texts, and of rows that agree in id and text all but one lose
    all their lines. Extra columns are ignored; an empty table gives an empty
    result.
    """
    ident, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    numbered = F.transform(F.split(fill(text), "\n"), lambda x, i: F.struct(x.rlike(WORDED).alias("w"), i.alias("i")))
    lines = F.transform(F.filter(numbered, lambda s: s["w"]), lambda s: s["i"])
    rows = docs.select(ident.alias("doc_id"), *key_columns(ident, F.xxhash64(fill(text))), lines.alias("lines"))
    joined = rows.join(gone_by_row(docs, id_col, text_col, edits), KEY, "left").withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("doc_id")))
    dropped = F.when(F.col("nth") > 1, F.col("lines")).otherwise(F.coalesce("_gone", F.array().cast("array<int>")))
    return joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"))


def gone_by_row(docs: DataFrame, id_col: str, text_col: str, edits: int) -> DataFrame:
    gone = dropped_lines(docs, id_col, text_col, edits)
    return gone.select(*key_columns(F.col("doc_id"), F.col("text_key")), "at").groupBy(*KEY).agg(F.array_sort(F.collect_set("at")).alias("_gone"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1) -> DataFrame:
    """``docs`` with repeated lines taken out of the texts, all other columns and all rows as they were; null texts stay null.

    Of rows that agree in id and text, which are copies line by line, one keeps
    its lines: the one whose columns hash least.
    """
    text = F.col(f"`{text_col}`")
    keyed = keyed_rows(docs, F.col(f"`{id_col}`").cast("long"), F.xxhash64(fill(text)))
    joined = keyed.join(gone_by_row(docs, id_col, text_col, edits), KEY, "left").withColumn("_nth", nth_row(keyed))
    old = F.col("_row").getField(text_col)
    none = F.array().cast("array<int>")

    def kept(lines: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(lines) - 1)
        worded = F.filter(numbers, lambda i: F.get(lines, i).rlike(WORDED))
        left = F.array_except(numbers, F.when(F.col("_nth") > 1, worded).otherwise(F.coalesce("_gone", none)))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col("_gone").isNull() & (F.col("_nth") == 1), old).otherwise(let(F.split(old, "\n"), kept))
    return joined.select(*(text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns))
