"""Restart grids and the choice among candidate solutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def select_best_solution(solutions: DataFrame, max_divergent: float = 0.5) -> DataFrame:
    """Best elbo by sample among solutions under the divergence limit, among all where none is."""
    ok = F.col("proportion_divergent") < max_divergent
    rows = solutions.withColumn("_any", F.max(ok).over(Window.partitionBy("sample_id"))).where(ok | ~F.col("_any"))
    return _best(rows).drop("_any")


def export_best_solution(solutions: DataFrame, max_divergent: float = 0.5, min_ploidy: float | None = None, max_ploidy: float | None = None) -> DataFrame:
    """Best elbo by sample within the limits; samples without a solution in them are left out."""
    rows = solutions.where(F.col("proportion_divergent") <= max_divergent)
    if min_ploidy is not None:
        rows = rows.where(F.col("ploidy") > min_ploidy)
    return _best(rows if max_ploidy is None else rows.where(F.col("ploidy") < max_ploidy))


def _best(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("sample_id").orderBy(F.desc("elbo"), "init_id")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def candidate_depths(modes: DataFrame, scales: tuple[float, ...] = (1.0, 0.5)) -> DataFrame:
    """(sample_id, mode_idx, h_normal, h_tumour): the least mode is normal, each one above it a candidate at every scale."""
    low = modes.groupBy("sample_id").agg(F.min("centre").alias("h_normal"))
    above = modes.join(low, "sample_id").where(F.col("centre") > F.col("h_normal"))
    rows = above.withColumn("_scale", F.explode(F.array(*(F.lit(s) for s in scales)))).withColumn("h_tumour", (F.col("centre") - F.col("h_normal")) * F.col("_scale"))
    number = F.row_number().over(Window.partitionBy("sample_id").orderBy("centre", F.desc("_scale"))) - 1
    return rows.select("sample_id", number.alias("mode_idx"), "h_normal", "h_tumour")


def estimate_ploidy(candidates: DataFrame, depths: DataFrame) -> DataFrame:
    """Length-weighted mean of raw major + minor copies of each candidate (h_normal, h_tumour)."""
    raw = (F.col("major") + F.col("minor") - 2 * F.col("h_normal")) / F.col("h_tumour")
    joined = depths.join(candidates, "sample_id").where(raw.isNotNull() & ~F.isnan(raw) & (F.abs(raw) != float("inf")))
    return joined.groupBy("sample_id", "mode_idx", "h_normal", "h_tumour").agg((F.sum(raw * F.col("length")) / F.sum("length")).alias("ploidy"))


def init_grid(candidates: DataFrame, mix_fractions: tuple[float, ...], divergence_weights: tuple[float, ...], min_ploidy: float, max_ploidy: float, cn_max: int) -> DataFrame:
    """Candidates inside the ploidy limits (else the closest) x mix fractions x divergence weights, with a common depth limit."""
    off = F.greatest(min_ploidy - F.col("ploidy"), F.col("ploidy") - max_ploidy, F.lit(0.0))
    w = Window.partitionBy("sample_id")
    kept = candidates.withColumn("_off", off).withColumn("_least", F.min("_off").over(w)).where(F.col("_off") == F.col("_least"))
    kept = kept.withColumn("max_depth", F.min(2 * F.col("h_normal") + (cn_max + 0.25) * F.col("h_tumour")).over(w))
    kept = kept.withColumn("mix_frac", F.explode(F.array(*(F.lit(m) for m in mix_fractions)))).withColumn("divergence_weight", F.explode(F.array(*(F.lit(d) for d in divergence_weights))))
    return clone_depths(kept.drop("_off", "_least"))


def clone_depths(rows: DataFrame) -> DataFrame:
    """Haploid depths [normal, tumour * fraction, tumour * (1 - fraction)]."""
    return rows.withColumns({"h_0": F.col("h_normal"), "h_1": F.col("h_tumour") * F.col("mix_frac"), "h_2": F.col("h_tumour") * (1 - F.col("mix_frac"))})


def depth_coverage_check(rows: DataFrame, limits: DataFrame, least: float = 0.75) -> DataFrame:
    """Share of length at a depth within the limit, by sample, and whether it suffices."""
    within = F.sum(F.when(F.col("readcount") / F.col("length") <= F.col("max_depth"), F.col("length")).otherwise(0)) / F.sum("length")
    return rows.where("length > 0").join(limits, "sample_id").groupBy("sample_id").agg(within.alias("proportion")).withColumn("passes", F.col("proportion") >= least)


def solution_stats(cn: DataFrame, by: list[str]) -> DataFrame:
    """Ploidy, proportion divergent, clones and segments of solutions with states major_m, minor_m of two clones."""
    length = F.col("length")
    total = (F.col("major_1") + F.col("minor_1") + F.col("major_2") + F.col("minor_2")) / 2
    apart = (F.col("major_1") != F.col("major_2")).cast("int") + (F.col("minor_1") != F.col("minor_2")).cast("int")
    return cn.groupBy(*by).agg((F.sum(total * length) / F.sum(length)).alias("ploidy"), (F.sum(apart * length) / (2 * F.sum(length))).alias("proportion_divergent"), F.lit(3).alias("num_clones"), F.count("*").alias("num_segments"))


def mixture_fractions(solutions: DataFrame) -> DataFrame:
    total = F.col("h_0") + F.col("h_1") + F.col("h_2")
    return solutions.select("sample_id", "init_id", F.transform(F.array("h_0", "h_1", "h_2"), lambda x: x / total).alias("mix"))


def param_grid(parts: list[DataFrame]) -> DataFrame:
    """Cartesian product of small parameter tables, numbered."""
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))
    return out.withColumn("param_id", F.row_number().over(Window.orderBy(*out.columns)) - 1)


def weighted_sample(rows: DataFrame, by: list[str], key: str, weight: str, k: int, seed: int = 1) -> DataFrame:
    """k rows by group without replacement, chances in proportion to weight, from a hash of the key.

    Exponential keys -ln(u) / weight order the rows; u is a multiplicative hash,
    so that reruns and other engines draw the same rows.
    """
    u = ((F.col(key) % 1_000_003) * 7919 + seed * 104_729) % 1_000_003
    u = (u + 1) / F.lit(1_000_004.0)
    ranked = rows.where(F.col(weight) > 0).withColumn("_k", -F.log(u) / F.col(weight)).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_k", key)))
    return ranked.where(F.col("_n") <= k).drop("_k", "_n")


def best_caller_init(rows: DataFrame) -> DataFrame:
    """Least validity index by sample; mixture of normal n and one or two clones from prevalences t_1, t_2."""
    best = rows.groupBy("sample_id").agg(F.min_by(F.struct("init_id", "n", "t_1", "t_2"), F.struct("validity", "init_id")).alias("b")).select("sample_id", "b.*")
    rest = 1 - F.col("n")
    two = F.array(F.col("n"), rest * F.col("t_2"), rest * F.abs(F.col("t_1") - F.col("t_2")))
    return best.select("sample_id", "init_id", F.when(F.col("t_2").isNull(), F.array(F.col("n"), rest * F.col("t_1"))).otherwise(two).alias("mix"))


def best_nll_solution(rows: DataFrame) -> DataFrame:
    """Least NLL + BAF_NLL by sample; its colon-separated copies C as rows (segment, total)."""
    best = rows.groupBy("sample_id").agg(F.min_by("copies", F.struct(F.col("nll") + F.col("baf_nll"), F.col("init_id"))).alias("copies"))
    return best.select("sample_id", F.posexplode(F.split("copies", ":")).alias("segment", "_c")).select("sample_id", "segment", F.col("_c").cast("int").alias("total"))
