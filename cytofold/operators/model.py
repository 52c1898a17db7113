"""Copy-number states: enumeration, scoring, breakpoint states.

Any number of tumour clones, whose columns are major_1, minor_1, major_2 and so on;
the normal clone is (1, 1). State tables depend on the number of clones and the
largest copy number only, so they are broadcast.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytofold.functions import likelihood as lk

ALLELES = ("major", "minor")


def cn_columns(clones: int) -> list[str]:
    """Columns of the copies of alleles in tumour clones."""
    return [f"{a}_{m}" for m in range(1, clones + 1) for a in ALLELES]


CN = tuple(cn_columns(2))


def clones_of(rows: DataFrame, name: str = "major") -> int:
    """How many tumour clones a table has columns for."""
    return next(m for m in range(len(rows.columns) + 1) if f"{name}_{m + 1}" not in rows.columns)


def over(function, columns: list[Column]) -> Column:
    """``greatest`` or ``least`` of any number of columns."""
    return function(*columns) if len(columns) > 1 else columns[0]


def spread(columns: list[Column]) -> Column:
    return over(F.greatest, columns) - over(F.least, columns)


def canonical(clones: int) -> tuple[Column, Column]:
    """Copies of alleles as an array, and those with the alleles swapped; of a state and its swap the larger array stands for both."""
    return tuple(F.array(*(F.col(f"{a}_{m}").cast("int") for m in range(1, clones + 1) for a in order)) for order in (ALLELES, ALLELES[::-1]))


def copy_states(spark: SparkSession, cn_max: int, cn_diff_max: int, clones: int = 2) -> DataFrame:
    """States (state, major_1, minor_1, ...) of ``clones`` tumour clones, one for each class under swapping alleles.

    No clone has more than ``cn_max`` copies and no allele differs by more than
    ``cn_diff_max`` between clones. States are numbered in the order of their
    copies. Clones are added one after the other, so states that break a limit
    are not carried on.
    """
    rows = spark.range(1).select()
    for m in range(1, clones + 1):
        values = F.explode(F.sequence(F.lit(0), F.lit(cn_max)))
        rows = rows.withColumn(f"major_{m}", values).withColumn(f"minor_{m}", values).where(F.col(f"major_{m}") + F.col(f"minor_{m}") <= cn_max)
        for a in ALLELES:
            rows = rows.where(spread([F.col(f"{a}_{k}") for k in range(1, m + 1)]) <= cn_diff_max)
    own, swapped = canonical(clones)
    columns = cn_columns(clones)
    return rows.where(own >= swapped).withColumn("state", F.row_number().over(Window.orderBy(*columns)) - 1).select("state", *columns)


def number_states(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Add ``state`` to rows with copies of alleles, whichever of them is called the major; null where ``states`` lacks it."""
    clones = clones_of(states)
    own, swapped = canonical(clones)
    table = states.select("state", own.alias("_cn"))
    return rows.withColumn("_cn", F.when(own >= swapped, own).otherwise(swapped)).join(table, "_cn", "left").drop("_cn")


def breakpoint_states(spark: SparkSession, cn_max: int, cn_diff_max: int, clones: int = 2) -> DataFrame:
    """States (brk_state, cn_1, ...) of a breakpoint's copies in ``clones`` tumour clones."""
    rows, columns = spark.range(1).select(), [f"cn_{m}" for m in range(1, clones + 1)]
    for m, c in enumerate(columns):
        rows = rows.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(cn_max)))).where(spread([F.col(x) for x in columns[: m + 1]]) <= cn_diff_max)
    return rows.withColumn("brk_state", F.row_number().over(Window.orderBy(*columns)) - 1).select("brk_state", *columns)


def transition_cost(clones: int) -> Column:
    """Cost of moving from the state with columns <c>_a to that with columns <c>_b: changes of totals, plus the lesser of allele changes kept or flipped beyond them."""
    d = lambda a, b: F.abs(F.col(f"{a}_a") - F.col(f"{b}_b"))
    number = range(1, clones + 1)
    total = sum((F.abs(F.col(f"major_{m}_a") + F.col(f"minor_{m}_a") - F.col(f"major_{m}_b") - F.col(f"minor_{m}_b")) for m in number), F.lit(0))
    kept = sum((d(f"{a}_{m}", f"{a}_{m}") for a in ALLELES for m in number), F.lit(0))
    flipped = sum((d(f"major_{m}", f"minor_{m}") + d(f"minor_{m}", f"major_{m}") for m in number), F.lit(0))
    return (total + F.least(kept - total, flipped - total)).cast("long")


def state_transition_costs(states: DataFrame) -> DataFrame:
    """(state_a, state_b, cost) of all pairs of states, see ``transition_cost``."""
    clones = clones_of(states)
    one, two = (states.select(*(F.col(c).alias(f"{c}_{s}") for c in ("state", *cn_columns(clones)))) for s in "ab")
    both = one.crossJoin(F.broadcast(two))  # the table's size depends on clones and the largest copy number only
    return both.select("state_a", "state_b", transition_cost(clones).alias("cost"))


def is_loh(any_clone: bool = False, clones: int = 2) -> Column:
    """Every clone has a zero allele; with ``any_clone`` one allele is zero in all clones."""
    none = {c: F.col(c) == 0 for c in cn_columns(clones)}
    if any_clone:
        return reduce(Column.__or__, [reduce(Column.__and__, [none[f"{a}_{m}"] for m in range(1, clones + 1)]) for a in ALLELES])
    return reduce(Column.__and__, [none[f"major_{m}"] | none[f"minor_{m}"] for m in range(1, clones + 1)])


def is_hdel(clones: int = 2) -> Column:
    return F.greatest(*(F.col(c) for c in cn_columns(clones))) == 0


def expected(h: tuple[float, ...]) -> tuple[Column, Column]:
    """Depth of the state, and share of the minor allele in it; ``h`` holds the haploid depths of the normal and each tumour clone."""
    weigh = lambda a: sum((h[m] * F.col(f"{a}_{m}") for m in range(1, len(h))), F.lit(float(h[0])))
    total = weigh("major") + weigh("minor")
    return total, weigh("minor") / total


def subclonal(clones: int) -> Column:
    """How many alleles differ between clones."""
    return sum(((spread([F.col(f"{a}_{m}") for m in range(1, clones + 1)]) > 0).cast("int") for a in ALLELES), F.lit(0))


def segment_loglik(rows: DataFrame, h: tuple[float, ...], r: float = 500.0, r_noise: float = 10.0, m: float = 500.0, hdel_mu: float = 1e-5, loh_p: float = 0.01) -> DataFrame:
    """Log-likelihood of counts under states: mixture of negative binomials for the total, beta-binomial or uniform for alleles.

    Masked rows give 0; homozygous deletions have mean hdel_mu * length, states
    without one allele in every clone the ratio loh_p; negative copies give -inf.
    """
    depth, ratio = expected(h)
    clones = len(h) - 1
    x, n, k, p_, mu_ = (F.col(c) for c in ("_x", "_n", "_k", "_p", "_mu"))
    mu = F.when(is_hdel(clones), F.lit(hdel_mu) * F.col("length")).otherwise(depth * F.col("length") + 1e-16)
    p = F.greatest(F.lit(1e-16), F.least(F.lit(1 - 1e-16), F.when(is_loh(clones=clones), F.lit(loh_p)).otherwise(ratio)))
    rows = rows.withColumns({"_x": F.col("readcount").cast("double"), "_n": (F.col("major_readcount") + F.col("minor_readcount")).cast("double"), "_k": F.col("minor_readcount").cast("double"), "_p": p, "_mu": mu})
    terms = {"_t": lk.negbin(x, mu_, F.lit(r)), "_tn": lk.negbin(x, mu_, F.lit(r_noise)), "_a": lk.betabin(k, n, p_, F.lit(m))}
    rows = rows.withColumns(terms).withColumns({"_t1": math.log(1 - lk.NOISE) + F.col("_t"), "_t2": math.log(lk.NOISE) + F.col("_tn"), "_a1": math.log(1 - lk.NOISE) + F.col("_a"), "_a2": math.log(lk.NOISE) - F.log(n + 1)})
    total, allele = lk.log_sum(F.col("_t1"), F.col("_t2")), lk.log_sum(F.col("_a1"), F.col("_a2"))
    either = F.when(F.col("total_mask"), total).otherwise(F.lit(0.0)) + F.when(F.col("allele_mask"), allele).otherwise(F.lit(0.0))
    scratch = [c for c in rows.columns if c.startswith("_")]
    return rows.withColumn("loglik", F.when(F.least(*(F.col(c) for c in cn_columns(clones))) < 0, F.lit(float("-inf"))).otherwise(either)).drop(*scratch)


def product(segments: DataFrame, table: DataFrame) -> DataFrame:
    """Every segment with every state. Segments are spread over all shuffle partitions first, since few bytes of them make many rows."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.repartition(parts).crossJoin(F.broadcast(table))  # the table's size depends on the largest copy number only


def segment_state_scores(segments: DataFrame, states: DataFrame, h: tuple[float, ...], divergence_weight: float = 1e-7, outlier: float = 0.01, r: tuple[float, float] = (500.0, 10.0), m: tuple[float, float] = (500.0, 10.0)) -> DataFrame:
    """Score of every segment and state: outlier-weighted log-likelihoods and a penalty for subclonal alleles.

    What counts or states enter alone is worked out once for each segment or
    state, ahead of their product; pairs are left with the terms of both.
    """
    r0, r1, m0, m1 = (F.lit(v) for v in (*r, *m))
    mean = lambda a, b: (1 - outlier) * a + outlier * b
    double = lambda c: F.col(c).cast("double")
    counts = segments.withColumns({"_x": double("readcount"), "_k": double("minor_readcount"), "_j": double("major_readcount"), "_n": double("major_readcount") + double("minor_readcount")})
    x, n, k, j = (F.col(c) for c in ("_x", "_n", "_k", "_j"))
    counts = counts.withColumns({"_total": mean(lk.negbin_counts(x, r0), lk.negbin_counts(x, r1)), "_allele": mean(lk.betabin_counts(k, n, m0), lk.betabin_counts(k, n, m1))})
    depth, ratio = expected(h)
    p = F.col("_p")
    table = states.withColumns({"_depth": depth, "_p": ratio, "_sub": subclonal(len(h) - 1)}).withColumn("_ratio", mean(lk.betabin_ratio(p, m0), lk.betabin_ratio(p, m1)))
    mu = F.col("_depth") * F.col("length")
    either = lambda size: 0.5 * (lk.betabin_both(k, j, p, size) + lk.betabin_both(j, k, p, size))
    total = F.col("_total") + mean(lk.negbin_mean(x, mu, r0), lk.negbin_mean(x, mu, r1))
    alleles = F.when(n > 0, F.col("_allele") - F.col("_ratio") + mean(either(m0), either(m1))).otherwise(F.lit(0.0))
    rows = product(counts, table)
    scored = rows.withColumn("score", total + alleles - F.col("_sub") * F.col("length") * divergence_weight)
    return scored.drop(*(c for c in scored.columns if c.startswith("_")))


def segment_state_likelihoods(segments: DataFrame, states: DataFrame, h: tuple[float, ...], r: tuple[float, float] = (500.0, 10.0), m: tuple[float, float] = (500.0, 10.0)) -> DataFrame:
    """Log-likelihoods of every segment and state by indicator: total_u for the outlier u, allele_vw for the outlier v and the swap w.

    Segments without allele reads have allele terms of 0.
    """
    double = lambda c: F.col(c).cast("double")
    counts = segments.withColumns({"_x": double("readcount"), "_k": double("minor_readcount"), "_j": double("major_readcount"), "_n": double("major_readcount") + double("minor_readcount")})
    x, n, k, j = (F.col(c) for c in ("_x", "_n", "_k", "_j"))
    counts = counts.withColumns({f"_total_{u}": lk.negbin_counts(x, F.lit(r[u])) for u in (0, 1)} | {f"_allele_{v}": lk.betabin_counts(k, n, F.lit(m[v])) for v in (0, 1)})
    depth, ratio = expected(h)
    table = states.withColumns({"_depth": depth, "_p": ratio}).withColumns({f"_ratio_{v}": lk.betabin_ratio(F.col("_p"), F.lit(m[v])) for v in (0, 1)})
    rows = product(counts, table)
    mu = F.col("_depth") * F.col("length")
    out = {f"total_{u}": F.col(f"_total_{u}") + lk.negbin_mean(x, mu, F.lit(r[u])) for u in (0, 1)}
    for v in (0, 1):
        for w, (a, b) in enumerate(((k, j), (j, k))):
            both = F.col(f"_allele_{v}") - F.col(f"_ratio_{v}") + lk.betabin_both(a, b, F.col("_p"), F.lit(m[v]))
            out[f"allele_{v}{w}"] = F.when(n > 0, both).otherwise(F.lit(0.0))
    scored = rows.withColumns(out)
    return scored.drop(*(c for c in scored.columns if c.startswith("_")))


def segment_map_state(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Best state of each segment, neighbours ignored; ties go to the first state."""
    return scores.groupBy(*keys).agg(F.max_by("state", F.struct(F.col("score"), -F.col("state"))).alias("state"))


def outlier_responsibilities(posteriors: DataFrame, keys: list[str], prior_total: float = 0.01, prior_allele: float = 0.01, swap: float = 0.5) -> DataFrame:
    """p_outlier_total, p_outlier_allele and p_allele_swap of segments from posterior and likelihoods by state (see ``segment_state_likelihoods``).

    Each is the softmax of its prior and its expected log-likelihood, one update
    in this order: alleles see the probability ``swap`` of a swap held so far, the
    swap sees the allele outliers just found, and has no prior.
    """
    names = ("total_0", "total_1", "allele_00", "allele_01", "allele_10", "allele_11")
    rows = posteriors.groupBy(*keys).agg(*(F.sum(F.col("posterior") * F.col(c)).alias(f"_{c}") for c in names))
    share = lambda no, yes: 1 / (1 + F.exp(no - yes))
    prior = lambda p: math.log(1 - p) - math.log(p)
    swapped = lambda v: (1 - swap) * F.col(f"_allele_{v}0") + swap * F.col(f"_allele_{v}1")
    rows = rows.withColumns({"p_outlier_total": share(prior(prior_total) + F.col("_total_0"), F.col("_total_1")), "p_outlier_allele": share(prior(prior_allele) + swapped(0), swapped(1))})
    kept = lambda w: (1 - F.col("p_outlier_allele")) * F.col(f"_allele_0{w}") + F.col("p_outlier_allele") * F.col(f"_allele_1{w}")
    return rows.withColumn("p_allele_swap", share(kept(0), kept(1))).drop(*(f"_{c}" for c in names))


def state_arrays(scores: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each segment with its scores in state order."""
    return scores.groupBy(*keys, "segment_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("state", "score"))), lambda s: s["score"]).alias("scores"))


def cost_matrix(costs: DataFrame) -> np.ndarray:
    """State by state costs on the driver; their number depends on the largest copy number only."""
    rows = costs.collect()
    n = 1 + max(r["state_a"] for r in rows)
    out = np.zeros((n, n))
    for r in rows:
        out[r["state_a"], r["state_b"]] = r["cost"]
    return out


def decode_breakpoints_naive(cn: DataFrame, adjacencies: DataFrame, breakpoints: DataFrame, clones: tuple[str, ...] = ("total_1", "total_2")) -> DataFrame:
    """Copies of a breakpoint: the lesser over its ends of the drop across the end against the wild-type neighbour, at least 0.

    ``breakpoints`` has n_1, side_1, n_2, side_2; ``cn`` has segment_idx and totals.
    """
    ends = breakpoints.select("prediction_id", F.expr("stack(2, n_1, side_1, n_2, side_2) as (n, side)"))
    pairs = adjacencies.select(F.col("left").alias("n"), F.lit(1).alias("side"), F.col("right").alias("other")).union(adjacencies.select(F.col("right"), F.lit(0), F.col("left")))
    here = cn.select(F.col("segment_idx").alias("n"), *(F.col(c).alias(f"_{c}") for c in clones))
    there = cn.select(F.col("segment_idx").alias("other"), *(F.col(c).alias(f"_o_{c}") for c in clones))
    joined = ends.join(pairs, ["n", "side"], "left").join(here, "n").join(there, "other", "left")
    drop = lambda c: F.greatest(F.col(f"_{c}") - F.coalesce(f"_o_{c}", F.lit(0)), F.lit(0))
    return joined.groupBy("prediction_id").agg(*(F.min(drop(c)).alias(c.replace("total", "cn")) for c in clones))


def decode_breakpoints_by_transition(changes: DataFrame, states: DataFrame, penalty: float = 10.0) -> DataFrame:
    """Best breakpoint state: least penalty of total changes not explained, over both boundaries and all clones.

    ``changes`` has prediction_id, orient, d_1, d_2, ... (totals left minus right of a boundary).
    """
    columns = [f"cn_{m}" for m in range(1, clones_of(states, "cn") + 1)]
    cost = penalty * sum((F.abs(F.col(c.replace("cn", "d")) - F.col("orient") * F.col(c)) for c in columns), F.lit(0))
    scored = changes.crossJoin(F.broadcast(states)).groupBy("prediction_id", "brk_state", *columns).agg(F.sum(cost).alias("cost"))
    return scored.groupBy("prediction_id").agg(F.min_by(F.struct(*columns), F.struct("cost", "brk_state")).alias("b")).select("prediction_id", "b.*")


def state_class_weights(posteriors: DataFrame, flagged: DataFrame, keys: list[str], outliers: DataFrame | None = None) -> DataFrame:
    """Weight of segments by posterior of flagged states, times ``factor`` of ``outliers`` (keys, segment_idx), normalised by sample; null where all are 0."""
    sums = posteriors.join(flagged, "state", "left_semi").groupBy(*keys, "segment_idx").agg(F.sum("posterior").alias("_w"))
    if outliers is not None:
        sums = sums.join(outliers.select(*keys, "segment_idx", "factor"), [*keys, "segment_idx"]).withColumn("_w", F.col("_w") * F.col("factor"))
    total = sums.groupBy(*keys).agg(F.sum("_w").alias("_t"))
    return sums.join(total, keys).select(*keys, "segment_idx", F.when(F.col("_t") > 0, F.col("_w") / F.col("_t")).alias("weight"))


def normal_copies(segments: DataFrame, male: bool) -> DataFrame:
    """Normal state (1, 1), but (1, 0) on X of a male."""
    on_x = F.col("chromosome").isin("X", "chrX") & F.lit(male)
    return segments.withColumns({"normal_major": F.lit(1), "normal_minor": F.when(on_x, 0).otherwise(1)})


def depth_gradient(rows: DataFrame, by: list[str], r: float = 500.0, family: str = "negbin", r_noise: float = 10.0, z: float = lk.NOISE) -> DataFrame:
    """Sum over segments of the derivative of the total log-likelihood with respect to each haploid depth.

    Families: ``poisson``, ``negbin`` and ``mixture``, whose components weigh in by
    their shares of the likelihood.
    """
    clones = next(m for m in range(len(rows.columns) + 1) if f"h_{m}" not in rows.columns)
    mu = sum((F.col(f"h_{m}") * F.col(f"total_{m}") for m in range(clones)), F.lit(0.0)) * F.col("length") + 1e-16
    rows = rows.withColumns({"_mu": mu, "_x": F.col("readcount").cast("double")})
    x, mu = F.col("_x"), F.col("_mu")
    negbin = lambda size: x / mu - (x + size) / (size + mu)
    if family == "mixture":
        rows = rows.withColumns({"_a": math.log(1 - z) + lk.negbin(x, mu, F.lit(r)), "_b": math.log(z) + lk.negbin(x, mu, F.lit(r_noise))})
        share = 1 / (1 + F.exp(F.col("_b") - F.col("_a")))
        slope = share * negbin(r) + (1 - share) * negbin(r_noise)
    else:
        slope = x / mu - 1 if family == "poisson" else negbin(r)
    return rows.withColumn("_slope", slope).groupBy(*by).agg(*(F.sum(F.col("_slope") * F.col(f"total_{m}") * F.col("length")).alias(f"grad_{m}") for m in range(clones)))


def argmax_column(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Number of the column with the largest value; ties go to the first."""
    values = F.array(*(F.col(c) for c in columns))
    return rows.withColumn("argmax", (F.array_position(values, F.array_max(values)) - 1).cast("int"))


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
