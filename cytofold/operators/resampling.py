"""Resampling of fragments with replacement, to the depths of a mixture of genomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytofold.functions.likelihood import log_gamma
from cytofold.operators.intervals import with_holding_segment
from cytofold.sources.storage import materialise

BIN = 10_000
SEGMENT = ["chromosome", "start", "end"]


def resample_depth_targets(copies: DataFrame, depths: DataFrame) -> DataFrame:
    """(chromosome, start, end, allele, read_depth): copies of a segment's allele in each genome times the genome's haploid depth, over all genomes.

    ``copies`` has a row for each copy (chromosome, start, end, allele, genome),
    ``depths`` one for each genome (genome, haploid_depth).
    """
    counted = copies.groupBy(*SEGMENT, "allele", "genome").agg(F.count("*").alias("_copies"))
    return counted.join(depths, "genome").groupBy(*SEGMENT, "allele").agg(F.sum(F.col("_copies") * F.col("haploid_depth")).alias("read_depth"))


def poisson_masses(rate: Column) -> Column:
    """P(n = k) for k from 0, as an array whose length follows the rate: fourteen deviations and thirty beyond the mean leave a tail far below 1e-12."""
    most = F.ceil(rate + 14 * F.sqrt(rate) + 30).cast("int")
    return F.transform(F.sequence(F.lit(0), most), lambda k: F.when(rate > 0, F.exp(k * F.log(rate) - rate - log_gamma(k + F.lit(1.0)))).otherwise((k == 0).cast("double")))


def uniform(seed: int, *counters: Column) -> Column:
    """A multiple of 2 ** -53 below 1: the first 53 bits of the MD5 digest of the seed and the counters, which alone decide it."""
    text = F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in counters))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 14), 16, 10).cast("long")
    return F.shiftright(bits, 3) / F.lit(float(1 << 53))


def levels_below(u: Column, levels: str) -> Column:
    """How many levels are less than ``u``, which becomes a variable of its own: inside the comparison it would be worked out for each level."""
    return F.transform(F.array(u), lambda v: F.size(F.filter(levels, lambda x: v > x)))[0]


def poisson_resample(fragments: DataFrame, targets: DataFrame, scale: float = 1.0, seed: int = 17) -> DataFrame:
    """Copies of fragments by the target depth of the segment that holds them, with new dense ids in order of start.

    ``targets`` has (chromosome, start, end, allele, rate) on disjoint segments; a
    fragment is drawn once for each allele, Poisson(rate * scale) times, by the
    inverse of the distribution at a uniform that seed, fragment and allele decide,
    see ``uniform``. Fragments that no segment holds go. Levels of the distribution
    are summed up once for each rate. Segments take their targets into the join, as
    few of them may hold most fragments. Ids are ranks within a start plus the copies
    at starts before, which are summed up within bins and over bins, so that no task
    sorts the fragments of a bin.
    """
    rates = targets.select("rate").distinct().withColumn("_rate", F.col("rate") * scale)
    masses = rates.select("rate", F.posexplode(poisson_masses(F.col("_rate"))).alias("_k", "_p"))
    upto = F.sum("_p").over(Window.partitionBy("rate").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    levels = masses.withColumn("_upto", upto).groupBy("rate").agg(F.array_sort(F.collect_list("_upto")).alias("_levels"))
    drawn_by = F.when(F.col("rate") * scale > 0, F.struct("allele", "rate"))
    segments = materialise(targets.groupBy(*SEGMENT).agg(F.collect_list(drawn_by).alias("targets")), "targets")
    placed = with_holding_segment(segments, fragments.select(*SEGMENT, "fragment_id"), ["targets"])
    rated = placed.select(*SEGMENT, "fragment_id", F.explode("s_targets").alias("_t")).select(*SEGMENT, "fragment_id", "_t.*").join(materialise(levels, "levels"), "rate")
    copies = levels_below(uniform(seed, F.col("fragment_id"), F.col("allele")), "_levels")
    # Rows without copies are written too: leaving them out before would take the uniforms again.
    drawn = materialise(rated.select(*SEGMENT, "fragment_id", "allele", copies.alias("_copies")), "drawn").where("_copies > 0")
    # A window holds the starts of a bin, or the bins of a chromosome.
    starts = drawn.groupBy("chromosome", "start").agg(F.sum("_copies").alias("_size")).withColumn("_bin", F.floor(F.col("start") / BIN))
    bins = starts.groupBy("chromosome", "_bin").agg(F.sum("_size").alias("_all"))
    bins = bins.select("chromosome", "_bin", (F.sum("_all").over(Window.partitionBy("chromosome").orderBy("_bin")) - F.col("_all")).alias("_bins_before"))
    within = F.sum("_size").over(Window.partitionBy("chromosome", "_bin").orderBy("start")) - F.col("_size")
    before = starts.withColumn("_within", within).join(bins, ["chromosome", "_bin"]).select("chromosome", "start", (F.col("_bins_before") + F.col("_within")).alias("_before"))
    order = Window.partitionBy("chromosome", "start").orderBy("fragment_id", "allele").rowsBetween(Window.unboundedPreceding, 0)
    ranked = drawn.withColumn("_first", F.sum("_copies").over(order) - F.col("_copies")).join(before, ["chromosome", "start"])
    first = F.col("_before") + F.col("_first")
    return ranked.select(*SEGMENT, "allele", F.explode(F.sequence(first, first + F.col("_copies") - 1)).alias("fragment_id"))
