"""Read, allele and SNP counting, phasing of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytofold.operators.intervals import contained_counts, find_contained_segments
from cytofold.sources.storage import materialise

FRAGMENT = ["fragment_id", "sample_id", "chromosome"]


def read_quality_filter(fragments: DataFrame, filter_duplicates: bool = False, map_qual_threshold: int = 1) -> DataFrame:
    kept = fragments.where(F.col("mapping_quality") >= map_qual_threshold)
    return kept.where("is_duplicate = 0") if filter_duplicates else kept


def concordant_alignments(alignments: DataFrame, max_fragment: int = 1000, max_soft_clipped: int = 8, check_proper_pair: bool = True) -> DataFrame:
    """Primary, mapped, not QC-failed, properly paired alignments with a usable insert size and few clipped bases."""
    clipped = F.aggregate(F.transform(F.regexp_extract_all("cigar", F.lit(r"(\d+)S"), F.lit(1)), lambda x: x.cast("int")), F.lit(0), lambda a, b: a + b)
    clipped = F.when(F.contains("cigar", F.lit("S")), clipped).otherwise(F.lit(0))
    kept = alignments.where("is_primary = 1 and is_mapped = 1 and is_failed_qc = 0 and insert_size <> 0").where((F.abs("insert_size") <= max_fragment) & (clipped <= max_soft_clipped))
    return kept.where("is_proper_pair = 1") if check_proper_pair else kept


def leading_clip(cigar: str) -> Column:
    """Clipped bases at the start of an alignment; most have none, and aren't searched for them."""
    return F.when(F.contains(cigar, F.lit("S")), F.coalesce(F.regexp_extract(cigar, r"^(\d+)S", 1).try_cast("int"), F.lit(0))).otherwise(F.lit(0))


def pair_reads(alignments: DataFrame) -> DataFrame:
    """Fragments from first and second mates that are both valid; both mates are in one group, so one shuffle."""
    mates = alignments.groupBy("sample_id", "chromosome", "name").agg(
        F.count_if(F.col("is_first") == 1).alias("n1"), F.count_if(F.col("is_first") == 0).alias("n2"), F.min("pos").alias("start"),
        F.abs(F.max_by("insert_size", "pos")).alias("size"), F.max("is_duplicate").alias("is_duplicate"), F.min("mapping_quality").alias("mapping_quality"),
    )
    return mates.where("n1 = 1 and n2 = 1").select("sample_id", "chromosome", "name", "start", (F.col("start") + F.col("size")).alias("end"), "mapping_quality", "is_duplicate")


def snp_counts(alleles: DataFrame, by: list[str]) -> DataFrame:
    return alleles.groupBy(*by, "chromosome", "position").agg(F.count_if(F.col("is_alt") == 0).alias("ref_count"), F.count_if(F.col("is_alt") == 1).alias("alt_count"))


def segment_read_counts(segments: DataFrame, fragments: DataFrame, **quality) -> DataFrame:
    return contained_counts(segments, read_quality_filter(fragments, **quality), ["sample_id"])


def haplotype_allele_join(alleles: DataFrame, haplotypes: DataFrame, fragments: DataFrame) -> DataFrame:
    """Allele rows on haplotype blocks, with their fragment; filtered fragments take their rows along.

    The id leads the keys: rows are sorted by the first bytes of the first key, and
    there are few samples.
    """
    marks = haplotypes.withColumnRenamed("allele", "is_alt")
    return alleles.join(marks, ["chromosome", "position", "is_alt"]).join(fragments.select("sample_id", "chromosome", "fragment_id", "start", "end"), FRAGMENT)


def allele_read_counts(segments: DataFrame, alleles: DataFrame, haplotypes: DataFrame, fragments: DataFrame) -> DataFrame:
    """Fragments by segment, block and allele; a fragment counts once, for its first (position, block, allele)."""
    joined = haplotype_allele_join(alleles, haplotypes, fragments)
    pick = F.min(F.struct("position", "hap_label", "allele_id", "start", "end")).alias("p")
    single = joined.groupBy(*FRAGMENT).agg(pick).select(*FRAGMENT, "p.start", "p.end", "p.hap_label", "p.allele_id")  # in the order of the join, not sorted again
    placed = find_contained_segments(segments, single).where("segment_idx >= 0")
    counted = placed.groupBy("sample_id", "segment_idx", "hap_label", "allele_id").agg(F.count("*").alias("readcount"))
    return counted.join(segments.select("segment_idx", "chromosome", "start", "end"), "segment_idx").drop("segment_idx")


def phase_segments(allele_counts: DataFrame) -> DataFrame:
    """Mark for every block which allele is allele a, the same for all samples.

    In each segment the sample with the largest relative allele difference (ties:
    first sample) decides: its larger allele of a block (ties: allele 0) is a.
    Blocks that the deciding sample has no reads of are dropped. The counts, a row
    for each sample, segment, block and allele, are written once for all that
    reads them here.
    """
    allele_counts = materialise(allele_counts, "allele-counts")
    segment = ["chromosome", "start", "end"]
    of = lambda a: F.sum(F.when(F.col("allele_id") == a, F.col("readcount")).otherwise(0))
    blocks = allele_counts.groupBy("sample_id", *segment, "hap_label").agg(of(0).alias("r0"), of(1).alias("r1"))
    blocks = blocks.withColumn("major", F.when(F.col("r0") >= F.col("r1"), 0).otherwise(1))
    apart = blocks.groupBy("sample_id", *segment).agg((F.sum(F.abs(F.col("r0") - F.col("r1"))) / F.sum(F.col("r0") + F.col("r1"))).alias("ratio"))
    first = Window.partitionBy(*segment).orderBy(F.desc("ratio"), "sample_id")
    chosen = apart.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("sample_id", *segment)
    phase = blocks.join(chosen, ["sample_id", *segment]).select(*segment, "hap_label", F.col("major").alias("allele_a"))
    return allele_counts.join(phase, [*segment, "hap_label"]).withColumn("is_allele_a", (F.col("allele_id") == F.col("allele_a")).cast("int")).drop("allele_a")


def segment_allele_counts(segment_counts: DataFrame, phased: DataFrame) -> DataFrame:
    """Counts of the larger and smaller allele of every segment, zeros included; allele a wins ties."""
    keys = ["sample_id", "chromosome", "start", "end"]
    of = lambda a: F.sum(F.when(F.col("is_allele_a") == a, F.col("readcount")).otherwise(0))
    sums = phased.groupBy(*keys).agg(of(1).alias("a"), of(0).alias("b"))
    joined = segment_counts.join(sums, keys, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in "ab"})
    return joined.select(*keys, "readcount", F.greatest("a", "b").alias("major_readcount"), F.least("a", "b").alias("minor_readcount"), (F.col("a") >= F.col("b")).cast("int").alias("major_is_allele_a"))


def fragment_stats(fragments: DataFrame) -> DataFrame:
    size = F.col("end") - F.col("start")
    return fragments.groupBy("sample_id").agg(F.avg(size).alias("fragment_mean"), F.stddev_pop(size).alias("fragment_stddev"))
