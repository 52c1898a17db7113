"""Genome metrics and evaluation of predictions against a known truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytofold.operators.bias import reverse_complement
from cytofold.operators.segments import refined_sums


def share(flag: Column, weight: str = "length") -> Column:
    return F.sum(F.when(flag, F.col(weight)).otherwise(0)) / F.sum(weight)


def genome_state_lengths(cn: DataFrame, by: list[str], clone: int = 1) -> DataFrame:
    """Length and proportion without one allele, without both, and with six copies or more."""
    a, b = F.col(f"major_{clone}"), F.col(f"minor_{clone}")
    flags = {"loh": F.least(a, b) == 0, "hdel": F.greatest(a, b) == 0, "hlamp": a + b >= 6}
    return cn.groupBy(*by).agg(*(F.sum(F.when(f, F.col("length")).otherwise(0)).alias(f"length_{n}") for n, f in flags.items()), *(share(f).alias(f"proportion_{n}") for n, f in flags.items()))


def clone_divergence(cn: DataFrame, by: list[str]) -> DataFrame:
    """Alleles of clone 1 above those of clone 2, times length, and their proportion."""
    above = (F.col("major_1") > F.col("major_2")).cast("int") + (F.col("minor_1") > F.col("minor_2")).cast("int")
    return cn.groupBy(*by).agg(F.sum(above * F.col("length")).alias("length_divergent"), (F.sum(above * F.col("length")) / F.sum("length")).alias("proportion_divergent"))


def genome_ploidy(cn: DataFrame, by: list[str], clone: int = 1) -> DataFrame:
    total = F.col(f"major_{clone}") + F.col(f"minor_{clone}")
    return cn.groupBy(*by).agg((F.sum(total * F.col("length")) / F.sum("length")).alias("ploidy"))


def state_distribution(cn: DataFrame, by: list[str], allele: str, cn_max: int = 6) -> DataFrame:
    """Length-weighted proportion of each state of an allele, capped, with all states present."""
    capped = F.least(F.col(allele), F.lit(cn_max)).cast("int")
    sums = cn.groupBy(*by, capped.alias("state")).agg(F.sum("length").alias("_l"))
    totals = cn.groupBy(*by).agg(F.sum("length").alias("_t")).withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(cn_max))))
    return totals.join(sums, [*by, "state"], "left").select(*by, "state", (F.coalesce("_l", F.lit(0)) / F.col("_t")).alias("proportion"))


def segment_copy_number(path: DataFrame) -> DataFrame:
    """Occurrences of segments and alleles in clone chromosome paths."""
    return path.groupBy("clone", "segment", "allele").agg(F.count("*").alias("copies"))


#: Elements of a path that a window orders at most, given dense positions.
BLOCK = 10_000
PATH = ["clone", "chain"]


def in_blocks(path: DataFrame, size: int) -> DataFrame:
    """Add ``_block``: ranges of ``ord``, in which paths are put in order piece by piece."""
    return path.withColumn("_block", F.floor(F.col("ord") / size))


def path_sequences(path: DataFrame, pieces: DataFrame, elements: int = 1000, block: int = BLOCK) -> DataFrame:
    """(clone, chain, part, sequence): the pieces (segment, seq) of each path in order, reversed and complemented where orient < 0.

    A part holds ``elements`` of them, so that no row holds a whole chromosome;
    parts one after the other are the path's sequence. Elements are counted within
    blocks of a path and over its blocks.
    """
    keys = [*PATH, "_block"]
    rows = in_blocks(path, block)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = sizes.select(*keys, (F.sum("_n").over(Window.partitionBy(*PATH).orderBy("_block")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("ord")) - 1
    numbered = rows.withColumn("_rank", rank).join(before, keys).select(*PATH, "ord", "segment", "orient", F.floor((F.col("_before") + F.col("_rank")) / elements).alias("part"))
    joined = numbered.join(pieces, "segment").withColumn("_s", F.when(F.col("orient") < 0, reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "_s")))
    return joined.groupBy(*PATH, "part").agg(F.array_join(F.transform(ordered, lambda x: x["_s"]), "").alias("sequence"))


def with_next(path: DataFrame, columns: list[str], block: int) -> DataFrame:
    """Add next_<column>: the values of the element that follows in the cyclic path.

    Blocks of a path are ordered by themselves; each hands on its first element only.
    """
    keys = [*PATH, "_block"]
    rows = in_blocks(path, block)
    w = Window.partitionBy(*keys).orderBy("ord")
    heads = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), "ord").alias("_head"))
    blocks = Window.partitionBy(*PATH).orderBy("_block")
    first = F.first("_head").over(blocks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(*keys, F.coalesce(F.lead("_head").over(blocks), first).alias("_head"))
    led = rows.withColumns({"_more": F.lead(F.lit(True)).over(w)} | {f"_{c}": F.lead(c).over(w) for c in columns}).join(heads, keys)
    return led.withColumns({f"next_{c}": F.when(F.col("_more"), F.col(f"_{c}")).otherwise(F.col(f"_head.{c}")) for c in columns}).drop("_block", "_more", "_head", *(f"_{c}" for c in columns))


def path_breakpoints(path: DataFrame, wild_type: DataFrame, block: int = BLOCK) -> DataFrame:
    """Copies of the oriented adjacencies of cyclic paths that aren't wild type, by canonical pair of ends."""
    ends = with_next(path, ["segment", "orient"], block).select(
        "clone", F.col("segment").alias("n1"), F.when(F.col("orient") > 0, 1).otherwise(0).alias("s1"), F.col("next_segment").alias("n2"), F.when(F.col("next_orient") > 0, 0).otherwise(1).alias("s2")
    )
    a, b = F.struct(F.col("n1").alias("n"), F.col("s1").alias("s")), F.struct(F.col("n2").alias("n"), F.col("s2").alias("s"))
    canonical = ends.select("clone", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).select("clone", F.col("a.n").alias("n_1"), F.col("a.s").alias("side_1"), F.col("b.n").alias("n_2"), F.col("b.s").alias("side_2"))
    usual = wild_type.select(F.col("left").alias("n_1"), F.lit(1).alias("side_1"), F.col("right").alias("n_2"), F.lit(0).alias("side_2"))
    keys = ["n_1", "side_1", "n_2", "side_2"]
    return canonical.join(usual, keys, "left_anti").groupBy("clone", *keys).agg(F.count("*").alias("copies"))


def balanced_breakpoints(nodes: DataFrame, cn: DataFrame, n_segments: int) -> DataFrame:
    """Breakpoints whose copy change across both ends, summed over clones and made absolute, is 0 (neighbours cyclic)."""
    ends = nodes.select("prediction_id", F.expr("stack(2, n_1, side_1, n_2, side_2) as (n, side)"))
    other = F.pmod(F.when(F.col("side") == 1, F.col("n") + 1).otherwise(F.col("n") - 1), F.lit(n_segments))
    here = cn.select(F.col("segment_idx").alias("n"), F.col("total").alias("_here"))
    there = cn.select(F.col("segment_idx").alias("other"), F.col("total").alias("_there"))
    change = ends.withColumn("other", other).join(here, "n").join(there, "other").withColumn("_d", F.abs(F.col("_here") - F.col("_there")))
    return change.groupBy("prediction_id").agg(F.sum("_d").alias("_d")).where("_d = 0").select("prediction_id")


def evaluate_cn(truth: DataFrame, pred: DataFrame, by: list[str], swap: bool) -> DataFrame:
    """Length-weighted agreement of two segmentations with two clones each (clone 1 the larger), alleles sorted.

    Clonal and subclonal agreement are the same number by definition.
    """
    side = lambda t, s: t.select(*by, "chromosome", "start", "end", F.col("k").alias("idx"), *(F.array_sort(F.array(F.col(f"major_{m}"), F.col(f"minor_{m}"))).alias(f"{s}{m}") for m in (1, 2)))
    same = (F.col("t1") == F.col("p1")) & (F.col("t2") == F.col("p2"))
    if swap:
        same = same | ((F.col("t1") == F.col("p2")) & (F.col("t2") == F.col("p1")))
    total = lambda s: F.get(F.col(s), F.lit(0)) + F.get(F.col(s), F.lit(1))
    apart = lambda s: sum(((F.get(F.col(f"{s}1"), F.lit(k)) != F.get(F.col(f"{s}2"), F.lit(k))).cast("int") for k in (0, 1)), F.lit(0))
    flags = {"cn": same, "dom_cn": F.col("t1") == F.col("p1"), "clonal": (F.col("t1") == F.col("t2")) == (F.col("p1") == F.col("p2"))}
    means = {"pred_ploidy": (total("p1") + total("p2")) / 2, "true_ploidy": (total("t1") + total("t2")) / 2, "pred_proportion_divergent": apart("p") / 2, "true_proportion_divergent": apart("t") / 2}
    length = F.col("end") - F.col("start")
    sums = {"length": length} | {n: F.when(x, length).otherwise(0) for n, x in flags.items()} | {n: x * length for n, x in means.items()}
    rows = refined_sums(side(truth, "t"), side(pred, "p"), [*by, "chromosome"], (["t1", "t2"], ["p1", "p2"]), sums)
    part = lambda n: F.sum(n) / F.sum("length")
    return rows.groupBy(*by).agg(
        part("cn").alias("proportion_cn_correct"), part("dom_cn").alias("proportion_dom_cn_correct"), part("clonal").alias("proportion_clonal_correct"), part("clonal").alias("proportion_subclonal_correct"),
        *(part(n).alias(n) for n in means),
    )


def evaluate_brk_cn(truth: DataFrame, pred: DataFrame, swap: bool) -> DataFrame:
    """Agreement of breakpoint copies (true_1, true_2 against cn_1, cn_2); missing predictions are 0, balanced breakpoints go."""
    rows = truth.join(pred, "prediction_id", "left").fillna(0, ["cn_1", "cn_2"]).where("not is_balanced")
    same = (F.col("true_1") == F.col("cn_1")) & (F.col("true_2") == F.col("cn_2"))
    if swap:
        same = same | ((F.col("true_1") == F.col("cn_2")) & (F.col("true_2") == F.col("cn_1")))
    present = {s: (F.col(f"{s}_1") > 0) | (F.col(f"{s}_2") > 0) for s in ("true", "cn")}
    sub = {s: present[s] & ((F.col(f"{s}_1") == 0) | (F.col(f"{s}_2") == 0)) for s in ("true", "cn")}
    out = {"correct_proportion": F.avg(same.cast("double"))}
    for name, flags in (("present", present), ("subclonal", sub)):
        out |= {f"{name}_num_true": F.count_if(flags["true"]), f"{name}_num_pos": F.count_if(flags["cn"]), f"{name}_num_true_pos": F.count_if(flags["true"] & flags["cn"])}
    return rows.agg(*(c.alias(f"brk_cn_{n}") for n, c in out.items()))


def evaluate_mixture(truth: DataFrame, pred: DataFrame, swap_ratio: float = 0.75) -> DataFrame:
    """Ordered clone fractions side by side; swapping is allowed when both true ones are close."""
    order = lambda c: F.reverse(F.array_sort(F.col(c)))
    double = lambda c: F.when(F.size(c) == 1, F.concat(F.col(c), F.col(c))).otherwise(F.col(c))
    t = truth.withColumn("true_mix", order("true_mix")).withColumn("true_mix", double("true_mix"))
    p = pred.withColumn("pred_mix", order("pred_mix")).withColumn("pred_mix", double("pred_mix"))
    return t.join(p, "sample_id").withColumn("allow_swap", F.array_min("true_mix") / F.array_max("true_mix") > swap_ratio)


def evaluate_outliers(truth: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """Length-weighted agreement of outlier flags with outlier probabilities above one half."""
    side = lambda t, c: t.select(*by, "chromosome", "start", "end", F.col("k").alias("idx"), c)
    length = F.col("end") - F.col("start")
    sums = {"length": length, "correct": F.when(F.col("is_outlier") == F.col("predicted"), length).otherwise(0)}
    rows = refined_sums(side(truth, F.col("is_outlier")), side(pred, (F.col("p_outlier") > 0.5).alias("predicted")), [*by, "chromosome"], (["is_outlier"], ["predicted"]), sums)
    return rows.groupBy(*by).agg((F.sum("correct") / F.sum("length")).alias("correct_outlier_proportion"))
