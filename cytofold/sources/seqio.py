"""Reading and writing of sequence data, text tables and caller formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BREAKPOINTS = "prediction_id long, chromosome_1 string, strand_1 string, position_1 long, chromosome_2 string, strand_2 string, position_2 long"
GAPS = "bin int, chromosome string, start long, `end` long, ix int, n string, size long, type string, bridge string"


def read_tsv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """A tab-separated table, plain or gzip; without a schema every column is a string."""
    reader = spark.read.option("sep", "\t").option("header", header)
    return (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)


def write_tsv(rows: DataFrame, path: str, header: bool = True, compression: str = "none") -> None:
    rows.write.option("sep", "\t").option("header", header).option("compression", compression).csv(path)


def read_breakpoints(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, BREAKPOINTS)


def read_gap_table(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, GAPS, header=False)


def read_chromosome_lengths(spark: SparkSession, path: str, configured: DataFrame) -> DataFrame:
    """Name and length of the configured chromosomes (chromosome, chromosome_idx), from a headerless index."""
    rows = read_tsv(spark, path, "chromosome string, length long, offset long", header=False)
    return rows.join(configured.select("chromosome", "chromosome_idx"), "chromosome").select("chromosome", "chromosome_idx", "length")


def normalise_names(rows: DataFrame, prefix: bool = False) -> DataFrame:
    """Chromosome names without (or with) the prefix chr."""
    bare = F.regexp_replace("chromosome", "^chr", "")
    return rows.withColumn("chromosome", F.concat(F.lit("chr"), bare) if prefix else bare)


def snp_panel(rows: DataFrame) -> DataFrame:
    """One row for each single-nucleotide alternative of (chromosome, position, ref, alts)."""
    bases = ("A", "C", "G", "T")
    return rows.select("chromosome", "position", "ref", F.explode("alts").alias("alt")).where(F.col("ref").isin(*bases) & F.col("alt").isin(*bases))


def check_chromosome_names(rows: DataFrame, reference: DataFrame, prefix: bool = False) -> DataFrame:
    """How many rows break the prefix convention, and how many name a chromosome that the reference lacks."""
    known = reference.select(F.col("chromosome").alias("_k")).distinct()
    joined = rows.join(known, F.col("chromosome") == F.col("_k"), "left")
    return joined.agg(F.count_if(F.col("chromosome").startswith("chr") != F.lit(prefix)).alias("bad_prefix"), F.count_if(F.col("_k").isNull()).alias("unknown"))


def write_seqdata(fragments: DataFrame, path: str, mode: str = "append") -> None:
    """Append fragments by sample and chromosome; missing quality is 60, missing duplicate marks are 0."""
    for name, default in (("mapping_quality", 60), ("is_duplicate", 0)):
        value = F.coalesce(F.col(name), F.lit(default)) if name in fragments.columns else F.lit(default)
        fragments = fragments.withColumn(name, value.cast("int"))
    fragments.write.mode(mode).partitionBy("sample_id", "chromosome").parquet(path)


def read_seqdata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).withColumn("chromosome", F.col("chromosome").cast("string"))


def merge_overlapping(parts: DataFrame) -> DataFrame:
    """Fragments of several files (file_no): ids are moved up by the running largest id + 1 of the files before, by chromosome."""
    tops = parts.groupBy("file_no", "chromosome").agg((F.max("fragment_id") + 1).alias("_top"))
    before = Window.partitionBy("chromosome").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    shifts = tops.select("file_no", "chromosome", F.coalesce(F.sum("_top").over(before), F.lit(0)).alias("_shift"))
    return parts.join(shifts, ["file_no", "chromosome"]).withColumn("fragment_id", F.col("fragment_id") + F.col("_shift")).drop("_shift")


def split_table(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """Add ``part``: rows of a group in order, n to a part."""
    return rows.withColumn("part", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / n))


def het_snp_vcf_rows(haplotypes: DataFrame, panel: DataFrame) -> DataFrame:
    """Heterozygous SNPs in the columns of a variant call file."""
    sites = haplotypes.select("chromosome", "position").distinct().join(panel, ["chromosome", "position"])
    ident = F.concat_ws("_", "chromosome", "position", "ref", "alt")
    return sites.select("chromosome", "position", ident.alias("id"), "ref", "alt", F.lit(".").alias("qual"), F.lit("PASS").alias("filter"), F.lit("").alias("info"), F.lit("GT").alias("format"), F.lit("0/1").alias("gt"))


def genotype_gen_rows(genotypes: DataFrame, panel: DataFrame) -> DataFrame:
    """Unambiguous genotypes with id chromosome:position and AA, AB, BB."""
    called = genotypes.where(F.col("AA") + F.col("AB") + F.col("BB") == 1)
    return called.join(panel, ["chromosome", "position"]).select("chromosome", F.concat_ws(":", "chromosome", "position").alias("id"), "position", "ref", "alt", "AA", "AB", "BB")


def caller_allele_rows(counts: DataFrame, layout: str) -> DataFrame:
    """SNP counts in the column layout of other callers: ``titan``, ``theta``, ``baf``."""
    total = F.col("ref_count") + F.col("alt_count")
    if layout == "titan":
        return counts.select(F.col("chromosome").alias("chr"), F.col("position").alias("pos"), F.lit("A").alias("ref"), F.col("ref_count").alias("refCount"), F.lit("T").alias("nonref"), F.col("alt_count").alias("nonrefCount"))
    if layout == "theta":
        return counts.select(F.col("chromosome").alias("chrom"), "position", "ref_count", "alt_count", total.alias("total"), F.lit("AB").alias("genotype"))
    return counts.select("chromosome", "position", F.least("ref_count", "alt_count").alias("minor_count"), total.alias("total_count"))


def write_results(solutions: DataFrame, cn: DataFrame, brk_cn: DataFrame, path: str, h: tuple[str, ...] = ("h_0", "h_1", "h_2")) -> None:
    """Chosen solutions as ``meta`` (JSON lines: their statistics, h and mix), with their ``cn`` and ``brk_cn`` rows as tab-separated tables.

    Rows of other solutions (sample_id, init_id) are left out; rows without
    ``init_id``, which all solutions of a sample share, are written for the chosen
    ones. Both tables begin with sample_id and init_id.
    """
    keys = ["sample_id", "init_id"]
    total = sum((F.col(c) for c in h[1:]), F.col(h[0]))
    stats = [c for c in solutions.columns if c not in h]
    solutions.select(F.to_json(F.struct(*stats, F.array(*h).alias("h"), F.transform(F.array(*h), lambda x: x / total).alias("mix"))).alias("value")).write.text(f"{path}/meta")
    for name, table in (("cn", cn), ("brk_cn", brk_cn)):
        met = table.join(solutions.select(*keys).distinct(), [k for k in keys if k in table.columns])
        write_tsv(met.select(*keys, *(c for c in table.columns if c not in keys)), f"{path}/{name}")
