"""SNP genotypes and haplotype blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snp_genotypes(counts: DataFrame, error: float = 0.01, threshold: float = 0.9) -> DataFrame:
    """AA, AB, BB flags from the posterior of three binomials with equal priors, in logarithms."""
    ref, alt = F.col("ref_count"), F.col("alt_count")
    low, high = F.log(F.lit(error)), F.log(F.lit(1 - error))
    logs = {"AA": alt * low + ref * high, "AB": (alt + ref) * F.log(F.lit(0.5)), "BB": ref * low + alt * high}
    top = F.greatest(*logs.values())
    total = sum(F.exp(x - top) for x in logs.values())
    return counts.withColumns({g: (F.exp(x - top) / total >= threshold).cast("int") for g, x in logs.items()})


def tumour_genotypes(counts: DataFrame, error: float = 0.01, min_total: int = 50, p_value: float = 1e-16) -> DataFrame:
    """Genotypes of pooled tumour counts: an allele is there if a binomial test of errors alone rejects.

    The critical count is found once for each distinct total: the least k whose
    upper tail is below ``p_value``.
    """
    pooled = counts.groupBy("chromosome", "position").agg(F.sum("ref_count").alias("ref_count"), F.sum("alt_count").alias("alt_count")).withColumn("total", F.col("ref_count") + F.col("alt_count")).where(F.col("total") > min_total)
    k = pooled.select("total").distinct().select("total", F.explode(F.sequence(F.lit(0).cast("long"), "total")).alias("k"))
    upto = Window.partitionBy("total").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    choose = F.sum(F.when(F.col("k") == 0, 0.0).otherwise(F.log((F.col("total") - F.col("k") + 1) / F.col("k")))).over(upto)
    mass = k.withColumn("_p", F.exp(choose + F.col("k") * F.log(F.lit(error)) + (F.col("total") - F.col("k")) * F.log(F.lit(1 - error))))
    tail = F.sum("_p").over(Window.partitionBy("total").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0))
    critical = mass.withColumn("_tail", tail).where(F.col("_tail") < p_value).groupBy("total").agg(F.min("k").alias("k_crit"))
    there = lambda c: F.coalesce(F.col(c) >= F.col("k_crit"), F.lit(False))
    has_a, has_b = there("ref_count"), there("alt_count")
    flags = {"AA": has_a & ~has_b, "AB": has_a & has_b, "BB": ~has_a & has_b}
    return pooled.join(critical, "total", "left").select("chromosome", "position", "ref_count", "alt_count", *(c.cast("int").alias(n) for n, c in flags.items()))


def haplotype_blocks(samples: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Blocks over phasing draws: label, alleles and confidence by heterozygous position."""
    draw = Window.partitionBy("sample_no", "chromosome").orderBy("position")
    het = samples.where("allele1 <> allele2").withColumn("change", F.abs(F.col("allele1") - F.coalesce(F.lag("allele1").over(draw), F.col("allele1"))))
    sites = het.groupBy("chromosome", "position").agg(F.avg("change").alias("fraction"))
    order = Window.partitionBy("chromosome").orderBy("position")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rated = sites.withColumn("confidence", F.greatest("fraction", 1 - F.col("fraction"))).withColumn("is_changepoint", F.bround("fraction").cast("int"))
    labelled = rated.withColumn("_new", ((F.col("confidence") < threshold) | F.lag("position").over(order).isNull()).cast("int"))
    labelled = labelled.withColumns({"_label": F.sum("_new").over(upto), "allele1": (F.sum("is_changepoint").over(upto) % 2).cast("int")})
    blocks = labelled.groupBy("chromosome").agg(F.max("_label").alias("_n"))  # one row per chromosome
    before = blocks.select("chromosome", (F.sum("_n").over(Window.orderBy("chromosome")) - F.col("_n")).alias("_before"))
    return labelled.join(before, "chromosome").select("chromosome", "position", (F.col("_before") + F.col("_label") - 1).alias("hap_label"), "allele1", (1 - F.col("allele1")).alias("allele2"), "confidence")


def haplotype_blocks_last_draw(samples: DataFrame, threshold: float = 0.95) -> DataFrame:
    """The older form: labels rise on low confidence only, alleles are those of the last draw."""
    draw = Window.partitionBy("sample_no", "chromosome").orderBy("position")
    het = samples.where("allele1 <> allele2").withColumn("change", F.abs(F.col("allele1") - F.coalesce(F.lag("allele1").over(draw), F.col("allele1"))))
    sites = het.groupBy("chromosome", "position").agg(F.avg("change").alias("f"), F.max_by("allele1", "sample_no").alias("allele1"), F.max_by("allele2", "sample_no").alias("allele2"))
    low = (F.greatest("f", 1 - F.col("f")) < threshold).cast("long")
    return sites.select("chromosome", "position", F.sum(low).over(Window.partitionBy("chromosome").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)).alias("hap_label"), "allele1", "allele2")


def haplotype_long(blocks: DataFrame) -> DataFrame:
    """Two rows for each position: allele of allele_id 0 and 1."""
    return blocks.select("chromosome", "position", "hap_label", F.expr("stack(2, allele1, 0, allele2, 1) as (allele, allele_id)"))
