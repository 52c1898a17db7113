"""Breakpoints: breakends, matching, nearest segment ends, types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def breakends(breakpoints: DataFrame) -> DataFrame:
    """Two rows for each breakpoint, sides 0 and 1."""
    return breakpoints.select("prediction_id", F.expr("stack(2, 0, chromosome_1, strand_1, position_1, 1, chromosome_2, strand_2, position_2) as (prediction_side, chromosome, strand, position)"))


def breakpoint_chromosome_filter(breakpoints: DataFrame, segments: DataFrame) -> DataFrame:
    known = segments.select(F.col("chromosome").alias("_c")).distinct()
    for side in "12":
        breakpoints = breakpoints.join(known, F.col(f"chromosome_{side}") == F.col("_c"), "left_semi")
    return breakpoints


def nearby_breakends(one: DataFrame, two: DataFrame, reach: int) -> DataFrame:
    """Breakend pairs of equal chromosome and strand with position_2 in [position - reach, position + reach)."""
    a = breakends(one).select(F.col("prediction_id").alias("id_1"), F.col("prediction_side").alias("side_1"), "chromosome", "strand", F.col("position").alias("p_1"), F.explode(F.array(*(F.floor(F.col("position") / (2 * reach)) + k for k in (-1, 0, 1)))).alias("_bin"))
    b = breakends(two).select(F.col("prediction_id").alias("id_2"), F.col("prediction_side").alias("side_2"), "chromosome", "strand", F.col("position").alias("p_2"), F.floor(F.col("position") / (2 * reach)).alias("_bin"))
    return a.join(b, ["chromosome", "strand", "_bin"]).where((F.col("p_2") >= F.col("p_1") - reach) & (F.col("p_2") < F.col("p_1") + reach))


def paired_breakends(one: DataFrame, two: DataFrame, reach: int) -> DataFrame:
    """Pairs of breakpoints (id_1, id_2) both sides of which are near in the sense of ``nearby_breakends``, straight or crosswise.

    They are looked up by both ends at once, so breakends that only have one side
    in common never meet. Has ``p_1_<side>`` and chromosome and strand of the first
    table, ``q_<side>`` of the second, and ``turned``: sides 0 and 1 of the first
    are sides 1 and 0 of the second.
    """
    size = 2 * reach
    named = lambda rows, names: rows.select("prediction_id", *(F.col(f"{c}_{s}").alias(f"_{c}_{k}") for k, s in enumerate(names) for c in ("chromosome", "strand", "position")))
    cell = lambda k: F.floor(F.col(f"_position_{k}") / size)
    a = named(one, "12").withColumnsRenamed({"prediction_id": "id_1", "_position_0": "p_0", "_position_1": "p_1"})
    a = a.withColumn("_cell_0", F.explode(F.array(*(F.floor(F.col("p_0") / size) + n for n in (-1, 0, 1))))).withColumn("_cell_1", F.explode(F.array(*(F.floor(F.col("p_1") / size) + n for n in (-1, 0, 1)))))
    both = named(two, "12").withColumn("turned", F.lit(False)).unionByName(named(two, "21").withColumn("turned", F.lit(True)))
    b = both.withColumns({f"_cell_{k}": cell(k) for k in (0, 1)}).withColumnsRenamed({"prediction_id": "id_2", "_position_0": "q_0", "_position_1": "q_1"})
    met = a.join(b, [f"_{c}_{k}" for k in (0, 1) for c in ("chromosome", "strand", "cell")])
    for k in (0, 1):
        met = met.where((F.col(f"q_{k}") >= F.col(f"p_{k}") - reach) & (F.col(f"q_{k}") < F.col(f"p_{k}") + reach))
    return met


def by_repeats(one: DataFrame, two: DataFrame, unique, general) -> DataFrame:
    """``unique`` of the rows whose prediction_id occurs once in its table, and ``general`` of pairs with other rows."""

    def split(rows: DataFrame) -> list[DataFrame]:
        again = rows.groupBy(F.col("prediction_id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
        return [rows.join(again, F.col("prediction_id").eqNullSafe(F.col("_id")), how) for how in ("left_anti", "left_semi")]

    (once_1, more_1), (once_2, more_2) = split(one), split(two)
    return unique(once_1, once_2).unionByName(general(more_1, two)).unionByName(general(once_1, more_2))


def match_breakpoints(one: DataFrame, two: DataFrame, search_range: int = 400) -> DataFrame:
    """Pairs (prediction_id_1, prediction_id_2) with exactly two breakend matches, of two sides on either side.

    Such a pair matches straight or crosswise, and not both ways.
    """
    named = [F.col("id_1").alias("prediction_id_1"), F.col("id_2").alias("prediction_id_2")]
    reaches = lambda p, q: (F.col(q) >= F.col(p) - search_range) & (F.col(q) < F.col(p) + search_range)
    same = (F.col("_chromosome_0") == F.col("_chromosome_1")) & (F.col("_strand_0") == F.col("_strand_1"))
    across = same & (reaches("p_0", "q_1") | reaches("p_1", "q_0"))  # a third match
    sides = [F.count("*").alias("n"), F.count_distinct("side_1").alias("s1"), F.count_distinct("side_2").alias("s2")]
    unique = lambda a, b: paired_breakends(a, b, search_range).where(~across).select(*named)
    general = lambda a, b: nearby_breakends(a, b, search_range).groupBy(*named).agg(*sides).where("n = 2 and s1 = 2 and s2 = 2").select("prediction_id_1", "prediction_id_2")
    return by_repeats(one, two, unique, general)


def query_breakpoint_db(queries: DataFrame, database: DataFrame, extend: int = 200) -> DataFrame:
    """The nearest database breakpoint that matches both sides within ``extend``, opposite sides to opposite sides; null if none."""

    def unique(a: DataFrame, b: DataFrame) -> DataFrame:
        dist = [F.abs(F.col(f"p_{k}") - F.col(f"q_{k}")) for k in (0, 1)]
        return paired_breakends(a, b, extend + 1).where((dist[0] <= extend) & (dist[1] <= extend)).select("id_1", "id_2", (dist[0] + dist[1]).alias("dist"))

    def general(a: DataFrame, b: DataFrame) -> DataFrame:
        near = nearby_breakends(a, b, extend + 1).where(F.abs(F.col("p_1") - F.col("p_2")) <= extend).withColumn("dist", F.abs(F.col("p_1") - F.col("p_2")))
        first = near.where("side_1 = 0").select("id_1", "id_2", F.col("side_2").alias("t1"), F.col("dist").alias("d1"))
        second = near.where("side_1 = 1").select("id_1", "id_2", F.col("side_2").alias("t2"), F.col("dist").alias("d2"))
        return first.join(second, ["id_1", "id_2"]).where("t1 <> t2").select("id_1", "id_2", (F.col("d1") + F.col("d2")).alias("dist"))

    both = by_repeats(queries, database, unique, general)
    best = both.groupBy("id_1").agg(F.min_by("id_2", F.struct("dist", "id_2")).alias("db_id"))
    return queries.join(best.withColumnRenamed("id_1", "prediction_id"), "prediction_id", "left").select("prediction_id", "db_id")


def segment_ends(segments: DataFrame) -> DataFrame:
    """Starts (side 0, strand -) and ends (side 1, strand +) of segments as positions."""
    return segments.select("chromosome", "segment_idx", F.expr("stack(2, 0, '-', start, 1, '+', `end`) as (side, strand, position)"))


def closest_segment_end(segments: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """The nearest segment end of each breakend on its strand, by two as-of looks over one union.

    Ties go to the larger position. ``dist`` is the lesser of the distances to
    the ends on either side, negative where the breakend lies beyond all ends.
    """
    ends = segment_ends(segments).select("chromosome", "strand", "position", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("prediction_id"), F.lit(None).cast("int").alias("prediction_side"), F.struct("position", "segment_idx", "side").alias("end_"))
    ends = ends.groupBy("chromosome", "strand", "position", "kind", "prediction_id", "prediction_side").agg(F.max("end_").alias("end_"))
    asked = breakends(breakpoints).select("chromosome", "strand", "position", F.lit(1).alias("kind"), "prediction_id", "prediction_side", F.lit(None).cast(ends.schema["end_"].dataType).alias("end_"))
    order = Window.partitionBy("chromosome", "strand").orderBy("position", "kind")
    left = F.last("end_", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("chromosome", "strand").orderBy(F.desc("position"), F.desc("kind"))
    right = F.last("end_", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    looked = ends.unionByName(asked).withColumns({"left": left, "right": right}).where("kind = 1")
    # An end at the breakend's own position is found by both looks.
    to_left, to_right = F.col("position") - F.col("left.position"), F.col("right.position") - F.col("position")
    exact = F.col("left.position") == F.col("position")
    pick = F.when(exact, F.col("left")).when(F.col("right").isNull(), F.col("left")).when(F.col("left").isNull(), F.col("right")).when(to_right <= to_left, F.col("right")).otherwise(F.col("left"))
    dist = F.when(exact, 0).when(F.col("right").isNull(), -to_left).when(F.col("left").isNull(), -to_right).otherwise(F.least(to_left, to_right))
    return looked.select("prediction_id", "prediction_side", "chromosome", "strand", "position", pick.alias("p"), dist.alias("dist")).where("p is not null").select("prediction_id", "prediction_side", "p.segment_idx", "p.side", F.col("p.position").alias("end_position"), "dist")


def breakpoint_segments(segments: DataFrame, breakpoints: DataFrame, adjacencies: DataFrame, max_brk_dist: int = 2000) -> DataFrame:
    """Breakpoints as pairs of segment ends (n_1, side_1, n_2, side_2); wild-type look-alikes and loops to one end go."""
    ends = closest_segment_end(segments, breakpoints)
    of = lambda c, s: F.max(F.when(F.col("prediction_side") == s, F.col(c)))
    wide = ends.groupBy("prediction_id").agg(of("segment_idx", 0).alias("n_1"), of("side", 0).alias("side_1"), of("segment_idx", 1).alias("n_2"), of("side", 1).alias("side_2"), F.sum("dist").alias("dist"), F.count("*").alias("n"))
    near = wide.where((F.col("n") == 2) & (F.col("dist") <= max_brk_dist)).where("not (n_1 = n_2 and side_1 = side_2)").drop("n")
    a, b = F.col("left"), F.col("right")
    forward = (near["n_1"] == a) & (near["side_1"] == 1) & (near["n_2"] == b) & (near["side_2"] == 0)
    reverse = (near["n_2"] == a) & (near["side_2"] == 1) & (near["n_1"] == b) & (near["side_1"] == 0)
    return near.join(adjacencies, forward, "left_anti").join(adjacencies, reverse, "left_anti")


def breakpoint_type(breakpoints: DataFrame) -> DataFrame:
    """translocation, inversion, deletion or duplication; ties in position go by strand, + before -."""
    first = (F.col("position_1") < F.col("position_2")) | ((F.col("position_1") == F.col("position_2")) & (F.col("strand_1") <= F.col("strand_2")))
    left: Column = F.when(first, F.col("strand_1")).otherwise(F.col("strand_2"))
    kind = (
        F.when(F.col("chromosome_1") != F.col("chromosome_2"), "translocation").when(F.col("strand_1") == F.col("strand_2"), "inversion").when(left == "+", "deletion").otherwise("duplication")
    )
    return breakpoints.withColumn("type", kind)


def breakend_boundaries(nodes: DataFrame, adjacencies: DataFrame) -> DataFrame:
    """(n, side) with left boundary, orientation, rank among the breakends of the boundary, and telomere flag."""
    left = F.when(F.col("side") == 1, F.col("n")).otherwise(F.col("n") - 1)
    placed = nodes.withColumns({"n_left": left, "orient": F.when(F.col("side") == 1, 1).otherwise(-1)})
    rank = F.row_number().over(Window.partitionBy("n_left").orderBy("prediction_id", "n", "side")) - 1
    known = adjacencies.select(F.col("left").alias("n_left"), F.lit(1).alias("_adjacent"))
    return placed.withColumn("rank", rank).join(known, "n_left", "left").withColumn("is_telomere", F.col("_adjacent").isNull().cast("int")).drop("_adjacent")
