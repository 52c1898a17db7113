"""Segmentations: cutting chromosomes, common refinement, merging runs of equal rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytofold.operators.intervals import bins, in_gaps
from cytofold.sources.storage import materialise

EPSILON = 1e-16


def create_segments(chromosomes: DataFrame, gaps: DataFrame, breakpoints: DataFrame, segment_length: int = 500_000) -> DataFrame:
    """Cut chromosomes every ``segment_length`` and at gap bounds, breakends and ends; segments that start in a gap go.

    ``segment_idx`` numbers the rows in the order of chromosome_idx and start. The
    numbering adds per-chromosome ranks to per-chromosome offsets, so no task
    orders all segments.
    """
    grid = chromosomes.where("length > 0").select("chromosome", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(segment_length).cast("long"))).alias("position"))
    cuts = grid.union(chromosomes.select("chromosome", "length"))
    for table, columns in ((gaps, [("chromosome", "start"), ("chromosome", "end")]), (breakpoints, [("chromosome_1", "position_1"), ("chromosome_2", "position_2")])):
        for pair in columns:
            cuts = cuts.union(table.select(*pair))
    order = Window.partitionBy("chromosome").orderBy("position")
    cut = cuts.distinct().select("chromosome", F.col("position").alias("start"), F.lead("position").over(order).alias("end")).where("end is not null")
    kept = in_gaps(cut, gaps, "start", "left_anti").join(chromosomes.select("chromosome", "chromosome_idx"), "chromosome")
    return number_rows(kept).select("segment_idx", "chromosome", "start", "end")


def number_rows(segments: DataFrame, name: str = "segment_idx") -> DataFrame:
    """Number rows from 0 by chromosome_idx, start, end."""
    sizes = segments.groupBy("chromosome_idx").agg(F.count("*").alias("_n"))
    before = sizes.select("chromosome_idx", (F.sum("_n").over(Window.orderBy("chromosome_idx")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("chromosome_idx").orderBy("start", "end"))
    return segments.withColumn("_rank", rank).join(before, "chromosome_idx").withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_rank", "_before")


def segment_order(segments: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """Segments in the configured chromosome order, then by start."""
    return segments.join(chromosomes.select("chromosome", "chromosome_idx"), "chromosome").orderBy("chromosome_idx", "start")


def fixed_bins(chromosomes: DataFrame, width: int = 1000) -> DataFrame:
    """Bins of equal width; the last one may reach beyond the chromosome's end."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(width).cast("long")))
    return chromosomes.where("length > 0").select("chromosome", starts.alias("start")).withColumn("end", F.col("start") + width)


#: Segments of both sides to a partition, where two segmentations meet.
SEGMENTS = 500_000


def meetings(one: DataFrame, two: DataFrame, by: list[str], keep: tuple[list[str], list[str]] = ([], [])) -> DataFrame:
    """Atoms that both segmentations cover, from one pass over their segments by start, with ``_plain``: whether the row fits such a pass.

    Of two segments that meet, the one that starts later finds the other as the last
    one started on the other side. That holds in groups whose rows are all plain: in
    the others segments of one side overlap, or a row without length cuts an atom.
    Rows that aren't plain are returned with or without an atom. Partitions are as
    many as the number of segments asks for, so what a task sorts is bounded.
    """
    sides = []
    for n, side, more in ((1, one, keep[0]), (2, two, keep[1])):
        # A row of no length is of kind 0, one with swapped bounds or half of them -1.
        kind = F.when(F.col("end") > F.col("start"), n).when(F.col("end") == F.col("start"), 0).otherwise(-1)
        cover = F.struct(F.col("end").alias("_e"), F.col("idx").alias(f"idx_{n}"), *more)
        rows = side.where("start is not null or `end` is not null").dropna(subset=by).withColumn("_kind", kind)
        sides.append(rows.select(*by, "start", "_kind", F.when(F.col("_kind") > 0, cover).alias(f"_cover_{n}")))
    rows = sides[0].unionByName(sides[1], allowMissingColumns=True)
    parts = math.ceil((one.count() + two.count()) / SEGMENTS)
    rows = rows.repartition(parts, *by) if parts > 1 else rows
    before = Window.partitionBy(*by).orderBy("start", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumns({f"_last_{n}": F.last(f"_cover_{n}", ignorenulls=True).over(before) for n in (1, 2)})
    first, kind = F.col("_kind") == 1, F.col("_kind")
    own, other = F.when(first, F.col("_last_1._e")).otherwise(F.col("_last_2._e")), F.when(first, F.col("_last_2._e")).otherwise(F.col("_last_1._e"))
    apart = F.coalesce(own <= F.col("start"), F.lit(True))
    inside = F.coalesce(F.least("_last_1._e", "_last_2._e") > F.col("start"), F.lit(False)) & F.col("_last_1").isNotNull() & F.col("_last_2").isNotNull()
    plain = F.when(kind > 0, apart).when(kind == 0, ~inside).otherwise(False)
    end = F.when((kind > 0) & (other > F.col("start")), F.least(F.coalesce("_cover_1._e", "_cover_2._e"), other))
    both = (F.coalesce(f"_cover_{n}", f"_last_{n}").alias(f"_cover_{n}") for n in (1, 2))
    return seen.select(*by, "start", end.alias("end"), *both, plain.alias("_plain")).where("`end` is not null or not _plain")


def reindex_segments(one: DataFrame, two: DataFrame, by: list[str], keep: tuple[list[str], list[str]] = ([], [])) -> DataFrame:
    """Common refinement of two segmentations: by, start, end, idx_1, idx_2 of the atoms that both cover, with the columns to ``keep`` of each."""
    met = materialise(meetings(one, two, by, keep), "atoms")
    found = met.select(*by, "start", "end", "_cover_1.*", "_cover_2.*").drop("_e")
    rest = met.where("not _plain").select(*by).distinct()
    if rest.isEmpty():
        return found
    parts = (side.join(rest, by, "left_semi") for side in (one, two))
    return found.join(rest, by, "left_anti").unionByName(cut_segments(*parts, by, keep))


def refined_sums(one: DataFrame, two: DataFrame, by: list[str], keep: tuple[list[str], list[str]], sums: dict[str, Column]) -> DataFrame:
    """Sums over the atoms of ``reindex_segments`` for each of ``by``, taken where the atoms are made."""
    add = [F.sum(x).alias(c) for c, x in sums.items()]
    met = meetings(one, two, by, keep).select(*by, "start", "end", "_cover_1.*", "_cover_2.*", "_plain").drop("_e")
    found = materialise(met.groupBy(*by).agg(F.bool_and("_plain").alias("_plain"), *add), "sums")
    rest = found.where("not _plain").select(*by)
    plain = found.where("_plain").drop("_plain")
    if rest.isEmpty():
        return plain
    parts = (side.join(rest, by, "left_semi") for side in (one, two))
    return plain.unionByName(cut_segments(*parts, by, keep).groupBy(*by).agg(*add))


def cut_segments(one: DataFrame, two: DataFrame, by: list[str], keep: tuple[list[str], list[str]]) -> DataFrame:
    """Common refinement where segments of one side may overlap and any row's bounds cut.

    One pass over the bounds of both in order: an atom is covered by the segment that
    started last where only one of its side is open. Atoms on which segments of one
    side overlap, if there are any, are joined with their segments.
    """
    events = []
    for n, side, more in ((1, one, keep[0]), (2, two, keep[1])):
        full = F.coalesce(F.col("end") > F.col("start"), F.lit(False))
        cover = F.struct(F.col("end").alias("_e"), F.col("idx").alias(f"idx_{n}"), *more)
        start = F.struct(F.col("start").alias("p"), full.cast("int").alias(f"_open_{n}"), F.when(full, cover).alias(f"_cover_{n}"))
        end = F.struct(F.col("end").alias("p"), (-full.cast("int")).alias(f"_open_{n}"), F.when(F.lit(False), cover).alias(f"_cover_{n}"))
        events.append(side.select(*by, F.explode(F.array(start, end)).alias("_at")).select(*by, "_at.*"))
    order = Window.partitionBy(*by).orderBy("p")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # Of rows at one position the last one has seen them all, and is the one followed by a larger position.
    seen = events[0].unionByName(events[1], allowMissingColumns=True).select(
        *by, F.col("p").alias("start"), F.lead("p").over(order).alias("end"), *(F.sum(f"_open_{n}").over(upto).alias(f"_open_{n}") for n in (1, 2)), *(F.last(f"_cover_{n}", ignorenulls=True).over(upto).alias(f"_cover_{n}") for n in (1, 2))
    )
    single = reduce(Column.__and__, [(F.col(f"_open_{n}") == 1) & (F.col(f"_cover_{n}._e") >= F.col("end")) for n in (1, 2)])
    both = seen.where("end > start and _open_1 > 0 and _open_2 > 0").withColumn("_single", single).dropna(subset=by)
    atoms = materialise(both.select(*by, "start", "end", *(F.when(F.col("_single"), F.col(f"_cover_{n}")).alias(f"_cover_{n}") for n in (1, 2)), "_single"), "atoms")
    found = atoms.where("_single").select(*by, "start", "end", "_cover_1.*", "_cover_2.*").drop("_e")
    rest = atoms.where("not _single").select(*by, "start", "end")
    return found if rest.isEmpty() else found.unionByName(with_covers(rest, one, two, by, keep))


def with_covers(atoms: DataFrame, one: DataFrame, two: DataFrame, by: list[str], keep: tuple[list[str], list[str]]) -> DataFrame:
    """Atoms with all pairs of segments that cover them; both are looked up by the bin that the atom starts in."""
    width = 100_000
    atoms = atoms.withColumn("_bin", F.floor(F.col("start") / width))
    for n, side, more in ((1, one, keep[0]), (2, two, keep[1])):
        covers = side.where(F.col("end") > F.col("start")).select(*by, F.col("idx").alias(f"idx_{n}"), *more, F.col("start").alias("_s"), F.col("end").alias("_e"), bins(F.col("start"), F.col("end") - 1, width).alias("_bin"))
        atoms = atoms.join(covers, [*by, "_bin"]).where((F.col("_s") <= F.col("start")) & (F.col("end") <= F.col("_e"))).drop("_s", "_e")
    return atoms.drop("_bin")


def run_ids(rows: DataFrame, by: list[str], order: list[str], changed: Column) -> DataFrame:
    """Add ``run``: how many rows up to this one have ``changed`` (null: the first row, a change)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_new", F.coalesce(changed, F.lit(True)).cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def differs(columns: list[str], by: list[str], order: list[str]) -> Column:
    w = Window.partitionBy(*by).orderBy(*order)
    return reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.lag(c).over(w)) for c in columns]) | F.lag(F.lit(1)).over(w).isNull()


def aggregate_adjacent(rows: DataFrame, by: list[str], values: list[str], stable: list[str], weighted: list[str]) -> DataFrame:
    """Merge runs of rows with equal values: first of stable columns, extent, summed length, length-weighted means."""
    keys = [*by, "chromosome"]
    runs = run_ids(rows, keys, ["start"], differs(values, keys, ["start"]))
    first = [F.min_by(c, "start").alias(c) for c in stable]
    means = [(F.sum(F.col(c) * F.col("length")) / (F.sum("length") + EPSILON)).alias(c) for c in weighted]
    return runs.groupBy(*keys, *values, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("length").alias("length"), *first, *means).drop("run")


def perfect_segments(genome: DataFrame, by: list[str], states: list[str]) -> DataFrame:
    """Extents of runs with equal states over all clones."""
    keys = [*by, "chromosome"]
    runs = run_ids(genome, keys, ["start"], differs(states, keys, ["start"]))
    return runs.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


#: Positions of a chunk in which runs are looked for first.
CHUNK = 100_000


def position_runs(positions: DataFrame, value: str, chunk: int = CHUNK) -> DataFrame:
    """Runs of consecutive positions of one value: chromosome, start, end, value.

    Runs are found within chunks; those that touch a chunk's bounds, two for each
    chunk and value at most, are then joined along the chromosome.
    """
    keys = ["chromosome", value, "_chunk"]
    at = positions.withColumn("_chunk", F.floor(F.col("position") / chunk))
    islands = at.withColumn("_island", F.col("position") - F.row_number().over(Window.partitionBy(*keys).orderBy("position")))
    runs = islands.groupBy(*keys, "_island").agg(F.min("position").alias("start"), (F.max("position") + 1).alias("end"))
    touches = (F.col("start") == F.col("_chunk") * chunk) | (F.col("end") == (F.col("_chunk") + 1) * chunk)
    runs = runs.withColumn("_part", F.when(~touches, F.col("_chunk")))  # null: the edges of the chromosome's chunks
    part = ["chromosome", value, "_part"]
    w = Window.partitionBy(*part).orderBy("start")
    joined = run_ids(runs, part, ["start"], F.lag("end").over(w) != F.col("start"))
    return joined.groupBy(*part, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_part", "run")


def value_runs(positions: DataFrame, values: list[str], chunk: int = CHUNK) -> DataFrame:
    """Runs of rows, in the order of positions, that agree in ``values``: chromosome, values, start, end (the last position).

    Runs are found within chunks; the first and the last of each chunk are then
    joined along the chromosome.
    """
    keys = ["chromosome", "_chunk"]
    at = positions.withColumn("_chunk", F.floor(F.col("position") / chunk))
    within = run_ids(at, keys, ["position"], differs(values, keys, ["position"]))
    runs = within.groupBy(*keys, "run", *values).agg(F.min("position").alias("start"), F.max("position").alias("end")).withColumn("_last", F.max("run").over(Window.partitionBy(*keys)))
    runs = runs.withColumn("_part", F.when((F.col("run") > 1) & (F.col("run") < F.col("_last")), F.col("_chunk"))).drop("run", "_last")
    part = ["chromosome", "_part"]
    w = Window.partitionBy(*part).orderBy("start")
    # Two runs of one chunk are apart, also where others between them were set aside.
    joined = run_ids(runs, part, ["start"], differs(values, part, ["start"]) | (F.lag("_chunk").over(w) == F.col("_chunk")))
    return joined.groupBy(*part, "run", *values).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_part", "run")


def state_runs(positions: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Position-level caller states to segments with dominant and alternative states.

    Null prevalence is 1. The state is dominant if its prevalence is 0.5 or more, else 1/1 is.
    """
    ends = value_runs(positions.withColumn("prevalence", F.coalesce("prevalence", F.lit(1.0))), ["minor", "major", "prevalence"], chunk)
    dominant = F.col("prevalence") >= 0.5
    one = F.lit(1).cast("long")
    pick = lambda c, when: F.when(when, F.col(c)).otherwise(one)
    return ends.select(
        "chromosome", "start", "end", pick("major", dominant).alias("major_1"), pick("minor", dominant).alias("minor_1"), pick("major", ~dominant).alias("major_2"), pick("minor", ~dominant).alias("minor_2"),
        F.least("prevalence", 1 - F.col("prevalence")).alias("alt_prevalence"),
    )


def state_map(totals: DataFrame) -> DataFrame:
    """State numbers of (minor, major) by total, for a table of totals (total)."""
    states = totals.select("total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("total") / 2))).alias("minor")).withColumn("major", F.col("total") - F.col("minor"))
    return states.withColumn("state", F.row_number().over(Window.orderBy("total", "minor")) - 1)


def segment_remap(segments: DataFrame, positions: DataFrame, width: int = 100_000) -> DataFrame:
    """Positions on the concatenation of ordered segments, with segment_idx and the coordinate inside it."""
    length = F.col("end") - F.col("start")
    by_chromosome = segments.groupBy("chromosome").agg(F.sum(length).alias("_len"), F.min("segment_idx").alias("_first"))
    offsets = by_chromosome.select("chromosome", (F.sum("_len").over(Window.orderBy("_first")) - F.col("_len")).alias("_before"))
    within = F.sum(length).over(Window.partitionBy("chromosome").orderBy("segment_idx").rowsBetween(Window.unboundedPreceding, 0))
    placed = segments.withColumn("_stop", within).join(offsets, "chromosome").withColumn("_to", F.col("_before") + F.col("_stop")).withColumn("_from", F.col("_to") - length)
    dealt = placed.where("_to > _from").withColumn("_bin", bins(F.col("_from"), F.col("_to") - 1, width))
    at = positions.withColumn("_bin", F.floor(F.col("position") / width))
    met = at.join(dealt.select("segment_idx", "chromosome", "start", "_from", "_to", "_bin"), "_bin").where((F.col("_from") <= F.col("position")) & (F.col("position") < F.col("_to")))
    return met.select(*positions.columns, "segment_idx", "chromosome", (F.col("position") - F.col("_from") + F.col("start")).alias("original"))


def wild_type_adjacencies(segments: DataFrame, max_gap: int = 3_000_000) -> DataFrame:
    """Pairs (left, right) of consecutive segments of a chromosome at most ``max_gap`` apart."""
    w = Window.partitionBy("chromosome").orderBy("segment_idx")
    joined = segments.withColumns({"right": F.lead("segment_idx").over(w), "_next": F.lead("start").over(w)})
    return joined.where(F.col("_next") - F.col("end") <= max_gap).select(F.col("segment_idx").alias("left"), "right")


def chains(segments: DataFrame, max_gap: int = 3_000_000) -> DataFrame:
    """Maximal runs of adjacent segments as half-open index ranges (first, last)."""
    w = Window.partitionBy("chromosome").orderBy("segment_idx")
    runs = run_ids(segments, ["chromosome"], ["segment_idx"], F.col("start") - F.lag("end").over(w) > max_gap)
    return runs.groupBy("chromosome", "run").agg(F.min("segment_idx").alias("first"), (F.max("segment_idx") + 1).alias("last")).drop("run")


def chain_of_segments(segments: DataFrame, max_gap: int = 3_000_000) -> DataFrame:
    """(segment_idx, chain): the run of adjacent segments that each belongs to, named by its first segment."""
    w = Window.partitionBy("chromosome").orderBy("segment_idx")
    runs = run_ids(segments, ["chromosome"], ["segment_idx"], F.col("start") - F.lag("end").over(w) > max_gap)
    return runs.select("segment_idx", F.min("segment_idx").over(Window.partitionBy("chromosome", "run")).alias("chain"))


def concat_coordinates(chromosomes: DataFrame) -> DataFrame:
    """Start, end and middle of each chromosome on the concatenated genome."""
    total = F.sum("length").over(Window.orderBy("chromosome_idx"))
    return chromosomes.select("chromosome", (total - F.col("length")).alias("start"), total.alias("end"), (total - F.col("length") / 2).alias("mid"))


def segment_connectors(rows: DataFrame, by: list[str], field: str) -> DataFrame:
    """Between each segment and the next: where one ends and the next begins, and the mean of their values."""
    w = Window.partitionBy(*by, "chromosome").orderBy("start")
    joined = rows.withColumns({"x1": F.lead("start").over(w), "_next": F.lead(field).over(w)})
    return joined.where("x1 is not null").select(*by, "chromosome", F.col("end").alias("x0"), "x1", ((F.col(field) + F.col("_next")) / 2).alias("value"))
