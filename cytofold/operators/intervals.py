"""Interval and position joins within a chromosome.

Spark has no range join, so intervals are dealt to the bins they touch and the
other side is looked up by the bin of one coordinate: an ordinary equi-join on
(chromosome, level, bin), which Catalyst broadcasts when the interval side is small
at run time and shuffles otherwise, with the exact predicate on top. Bins are
nested, each level's eight times as wide as those below; an interval goes to the
lowest level whose bins are as long as itself, so it touches two of them at most,
and the other side is looked up at the levels that occur. Joins with segments,
whose number makes them shorter, take bins of the segments' mean length instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytofold.sources.storage import materialise

BIN = 10_000


def bins(start: Column, end: Column, width: int) -> Column:
    """The bins that a closed interval touches."""
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width)))


#: Powers of two between the widths of a level and the next.
STEP = 3


def deal(intervals: DataFrame, start: Column, last: Column, width: int) -> DataFrame:
    """Add ``_level`` and ``_bin``: a row for each of the bins, two at most, that a closed interval touches."""
    length = F.greatest(last - start, F.lit(0)) + 1
    level = F.greatest(F.ceil((F.log2(length / F.lit(width)) - 1e-9) / STEP), F.lit(0)).cast("int")
    wide = intervals.withColumn("_level", level)
    size = F.expr(f"shiftleft({width}L, {STEP} * _level)")
    return wide.withColumn("_bin", F.explode(F.sequence(F.floor(start / size), F.floor(F.greatest(start, last) / size))))


def deal_cells(intervals: DataFrame, start: Column, last: Column, width: int | None) -> tuple[DataFrame, int]:
    """``deal`` with bins of ``width`` and wider, and that width; without one, bins of one level, as wide as the intervals are on average.

    The latter makes three rows for each interval on average at most, and segments
    that don't overlap share a bin with few others however many there are. Each
    point is looked up once.
    """
    if width is not None:
        return deal(intervals, start, last, width), width
    lengths = intervals.agg(F.ceil(F.avg(F.greatest(last - start, F.lit(0)))).alias("mean")).first()
    mean = max(int(lengths["mean"] or 1), 1)
    every = F.sequence(F.floor(start / mean), F.floor(F.greatest(start, last) / mean))
    return intervals.withColumn("_level", F.lit(0)).withColumn("_bin", F.explode(every)), mean


def look_up(points: DataFrame, at: Column, dealt: DataFrame, width: int) -> DataFrame:
    """Add ``_level`` and ``_bin``: the bin of a coordinate at each level that ``dealt`` has, a handful."""
    levels = dealt.agg(F.collect_set("_level")).scalar()
    return points.withColumn("_at", at).withColumn("_levels", levels).withColumn("_level", F.explode("_levels")).withColumn("_bin", F.expr(f"floor(_at / shiftleft({width}L, {STEP} * _level))")).drop("_levels", "_at")


def matched_or_none(points: DataFrame, at: Column, dealt: DataFrame, condition: Column, width: int) -> DataFrame:
    """Left join of ``points`` and ``dealt`` (both may hold ``chromosome``), at all levels of the latter; its other columns start with s_ and are null without a match."""
    levels = sorted(r["_level"] for r in dealt.select("_level").distinct().collect())  # a handful
    named = [c for c in dealt.columns if c.startswith("s_")]

    def met(level: int, rows: DataFrame, how: str) -> DataFrame:
        mine = dealt.where(F.col("_level") == level).select(F.col("chromosome").alias("_c"), F.col("_bin").alias("_b"), *named)
        return rows.join(mine, (F.col("chromosome") == F.col("_c")) & (F.floor(at / (width << STEP * level)) == F.col("_b")) & condition, how).drop("_c", "_b")

    if len(levels) == 1:
        return met(levels[0], points, "left")
    rest = points
    for level in levels:
        rest = met(level, rest, "left_anti")
    none = rest.withColumns({c: F.lit(None).cast(dict(dealt.dtypes)[c]) for c in named})
    return reduce(DataFrame.unionByName, [met(level, points, "inner") for level in levels], none)


def with_neighbours(segments: DataFrame) -> DataFrame:
    """Add ``prev_end`` and ``next_start`` in the order of start and end within the chromosome."""
    order = Window.partitionBy("chromosome").orderBy("start", "end")
    return segments.withColumns({"prev_end": F.lag("end").over(order), "next_start": F.lead("start").over(order)})


def contained_counts(segments: DataFrame, intervals: DataFrame, by: list[str], width: int | None = None) -> DataFrame:
    """Intervals inside each segment, counted by ``by`` and segment, zeros included.

    An interval that starts exactly on the end of the segment before is dropped.
    Columns: by, chromosome, start, end, readcount, and what else ``segments`` has.
    """
    met = with_segments(segments, intervals, width, "left").groupBy(*by, F.col("s_chromosome").alias("chromosome"), F.col("s_start").alias("start"), F.col("s_end").alias("end"))
    counts = met.agg(F.count("s_start").alias("readcount"))
    frame = segments
    if by:
        # Intervals outside all segments keep a row of their group, so groups come from the counts and nothing is read twice.
        counts = materialise(counts, "contained-counts")
        groups = counts.agg(F.collect_set(F.struct(*by))).scalar()  # samples, a handful
        frame = segments.withColumn("_group", F.explode(groups)).select("_group.*", *segments.columns)
    found = counts.where("start is not null")
    return frame.join(found, [*by, "chromosome", "start", "end"], "left").withColumn("readcount", F.coalesce("readcount", F.lit(0)))


def contained_pairs(segments: DataFrame, intervals: DataFrame, width: int | None = None) -> DataFrame:
    """Intervals with the segment they are counted in (s_start, s_end)."""
    return with_segments(segments, intervals, width, "inner").drop("s_chromosome")


def with_segments(segments: DataFrame, intervals: DataFrame, width: int | None, how: str) -> DataFrame:
    """Intervals joined with the segment they are counted in (s_chromosome, s_start, s_end), at each level that segments have."""
    seg = with_neighbours(segments.select("chromosome", "start", "end")).select(F.col("chromosome").alias("s_chromosome"), F.col("start").alias("s_start"), F.col("end").alias("s_end"), "prev_end")
    dealt, width = deal_cells(seg, F.col("s_start"), F.col("s_end"), width)
    dealt = dealt.withColumnsRenamed({"_level": "_s_level", "_bin": "_s_bin"})
    inside = (F.col("start") >= F.col("s_start")) & (F.col("end") <= F.col("s_end")) & (F.col("prev_end").isNull() | (F.col("start") > F.col("prev_end")))
    place = (F.col("chromosome") == F.col("s_chromosome")) & (F.col("_level") == F.col("_s_level")) & (F.col("_bin") == F.col("_s_bin"))
    seen = look_up(intervals, F.col("start"), dealt.withColumnRenamed("_s_level", "_level"), width)
    return seen.join(dealt, place & inside, how).drop("_level", "_bin", "_s_level", "_s_bin", "prev_end")


def overlapping_counts(segments: DataFrame, positions: DataFrame, width: int | None = None) -> DataFrame:
    """Positions strictly inside each segment, zeros included."""
    seg = segments.select("chromosome", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    dealt, width = deal_cells(seg, F.col("s_start"), F.col("s_end"), width)
    met = look_up(positions, F.col("position"), dealt, width).join(dealt, ["chromosome", "_level", "_bin"])
    met = met.where((F.col("s_start") < F.col("position")) & (F.col("position") < F.col("s_end")))
    found = met.groupBy("chromosome", F.col("s_start").alias("start"), F.col("s_end").alias("end")).agg(F.count("*").alias("n"))
    return segments.join(found, ["chromosome", "start", "end"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def find_contained_positions(segments: DataFrame, positions: DataFrame, width: int | None = None) -> DataFrame:
    """Positions with the index of the segment [start, end) they lie in, -1 if none."""
    seg = segments.select("chromosome", F.col("segment_idx").alias("s_idx"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    dealt, width = deal_cells(seg, F.col("s_start"), F.col("s_end") - 1, width)
    met = matched_or_none(positions, F.col("position"), dealt, (F.col("s_start") <= F.col("position")) & (F.col("position") < F.col("s_end")), width)
    return met.select(*positions.columns, F.coalesce("s_idx", F.lit(-1)).cast("long").alias("segment_idx"))


def find_contained_segments(segments: DataFrame, intervals: DataFrame, width: int | None = None) -> DataFrame:
    """Intervals with the index of the segment that holds them, -1 if none.

    An interval that starts on a shared bound belongs to the right segment, an
    empty one on it to none.
    """
    dealt, width, inside = dealt_holders(segments, ["segment_idx"], width)
    met = matched_or_none(intervals, F.col("start"), dealt, inside, width)
    return met.select(*intervals.columns, F.coalesce("s_segment_idx", F.lit(-1)).cast("long").alias("segment_idx"))


def dealt_holders(segments: DataFrame, columns: list[str], width: int | None) -> tuple[DataFrame, int, Column]:
    """Segments with neighbours and ``columns`` (s_ before each name) in bins of a width, and whether one holds an interval, see ``find_contained_segments``."""
    seg = with_neighbours(segments.select("chromosome", "start", "end", *columns))
    seg = seg.select("chromosome", *(F.col(c).alias(f"s_{c}") for c in (*columns, "start", "end", "prev_end", "next_start")))
    dealt, width = deal_cells(seg, F.col("s_start"), F.col("s_end"), width)
    start, end = F.col("start"), F.col("end")
    inside = (start >= F.col("s_start")) & (F.col("s_next_start").isNull() | (start < F.col("s_next_start"))) & (end <= F.col("s_end")) & (F.col("s_prev_end").isNull() | (end > F.col("s_prev_end")))
    return dealt, width, inside


def with_holding_segment(segments: DataFrame, intervals: DataFrame, columns: list[str], width: int | None = None) -> DataFrame:
    """Intervals that a segment holds, see ``find_contained_segments``, with the segment's ``columns``, s_ before each name."""
    dealt, width, inside = dealt_holders(segments, columns, width)
    met = look_up(intervals, F.col("start"), dealt, width).join(dealt, ["chromosome", "_level", "_bin"])
    return met.where(inside).select(*(F.col(c) for c in intervals.columns), *(f"s_{c}" for c in columns))


def interval_position_overlap(intervals: DataFrame, positions: DataFrame, width: int = BIN, longest: int | None = None) -> DataFrame:
    """All pairs of an interval and a position in [start, end); intervals may overlap each other.

    Intervals are dealt to bins, see above. Where none is longer than ``longest``,
    as with reads, the positions are dealt to the bins that intervals over them
    start in instead, and each interval is looked up once.
    """
    full = intervals.where(F.col("end") > F.col("start"))
    if longest is None:
        keys = ["chromosome", "_level", "_bin"]
        dealt = deal(full, F.col("start"), F.col("end") - 1, width)
        at = look_up(positions, F.col("position"), dealt, width)
    else:
        keys = ["chromosome", "_bin"]
        dealt = full.withColumn("_bin", F.floor(F.col("start") / width))
        at = positions.select("*", bins(F.col("position") - longest + 1, F.col("position"), width).alias("_bin"))
    return dealt.join(at, keys).where((F.col("start") <= F.col("position")) & (F.col("position") < F.col("end"))).drop("_level", "_bin")


def vrange(ranges: DataFrame) -> DataFrame:
    """The integers start, ..., start + length - 1 of every range; empty ranges give none."""
    return ranges.where("length > 0").select("*", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("value"))


def in_gaps(points: DataFrame, gaps: DataFrame, column: str, how: str) -> DataFrame:
    """Rows whose ``column`` lies (``left_semi``) or doesn't lie (``left_anti``) in a gap [start, end)."""
    g = gaps.select(F.col("chromosome").alias("_c"), bins(F.col("start"), F.col("end") - 1, BIN).alias("_bin"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    at = F.col(column)
    return points.join(g, (F.col("chromosome") == F.col("_c")) & (F.floor(at / BIN) == F.col("_bin")) & (at >= F.col("_s")) & (at < F.col("_e")), how)
