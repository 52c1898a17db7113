"""Depths, raw and expected copy number, quality flags, weighted percentiles, modes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytofold.operators.selection import exact_percentiles, weighted_clusters

EPSILON = 1e-16


def segment_depths(counts: DataFrame) -> DataFrame:
    """Allele ratio (0 without allele reads) and depths of the larger allele, the smaller and both."""
    allele = F.col("major_readcount") + F.col("minor_readcount")
    ratio = F.when(allele > 0, F.col("minor_readcount") / allele).otherwise(F.lit(0.0))
    per = lambda x: F.when(F.col("length") != 0, x / F.col("length"))
    rows = counts.withColumn("allele_ratio", ratio)
    return rows.withColumns({"major_depth": per(F.col("readcount") * (1 - F.col("allele_ratio"))), "minor_depth": per(F.col("readcount") * F.col("allele_ratio")), "total_depth": per(F.col("readcount"))})


def quality_flags(rows: DataFrame) -> DataFrame:
    """high_quality: length, allele reads and length ratio each above their 10th percentile in the sample."""
    rows = rows.withColumns({"allele_readcount": F.col("major_readcount") + F.col("minor_readcount"), "length_ratio": F.col("length") / (F.col("end") - F.col("start") + 1)})
    judged = ["length", "allele_readcount", "length_ratio"]
    cuts = exact_percentiles(rows, ["sample_id"], judged, 0.1).withColumnsRenamed({c: f"_{c}" for c in judged})
    above = [F.col(c) > F.col(f"_{c}") for c in judged]
    return rows.join(cuts, "sample_id").withColumn("high_quality", above[0] & above[1] & above[2]).drop(*(f"_{c}" for c in judged))


def read_depth(counts: DataFrame) -> DataFrame:
    """Depths of segments with a length and measurable alleles, with quality flags taken over all segments."""
    rows = quality_flags(segment_depths(counts)).where((F.col("length") > 0) & (F.col("allele_readcount") > 0))
    return rows.select("sample_id", "chromosome", "start", "end", "length", F.col("major_depth").alias("major"), F.col("minor_depth").alias("minor"), F.col("total_depth").alias("total"), "high_quality")


def cn_table(segments: DataFrame, h: tuple[str, str, str] = ("h_0", "h_1", "h_2")) -> DataFrame:
    """Raw and expected copy number of segments with depths, states major_m, minor_m and haploid depths h."""
    tumour = F.col(h[1]) + F.col(h[2])
    expected = lambda a: sum((F.col(f"{a}_{m}") * F.col(h[m]) for m in (1, 2)), F.col(f"{a}_0") * F.col(h[0]))
    rows = segments
    for a in ("major", "minor"):
        rows = rows.withColumns({f"{a}_raw": (F.col(f"{a}_depth") - F.col(f"{a}_0") * F.col(h[0])) / tumour, f"{a}_depth_e": expected(a)})
        rows = rows.withColumns({f"{a}_e": F.col(f"{a}_depth_e") * F.col("length"), f"{a}_raw_e": (F.col(f"{a}_depth_e") - F.col(f"{a}_0") * F.col(h[0])) / tumour, f"{a}_diff": F.abs(F.col(f"{a}_1") - F.col(f"{a}_2"))})
    total = F.col("major_depth_e") + F.col("minor_depth_e")
    return rows.withColumns({"total_depth_e": total, "total_e": total * F.col("length")})


def genotypable_proportion(counts: DataFrame) -> DataFrame:
    return counts.withColumn("phi", (F.col("major_readcount") + F.col("minor_readcount")) / (F.col("readcount") + 1))


def mean_copy_number(counts: DataFrame, h: tuple[Column, Column]) -> DataFrame:
    """Mean raw copy number of alleles and total from counts and haploid depths (normal, tumour)."""
    depth = lambda c: F.col(c) / (F.col("phi") * F.col("length") + EPSILON)
    rows = genotypable_proportion(counts)
    total = F.col("readcount") / (F.col("length") + EPSILON)
    return rows.withColumns({
        "mean_major": (depth("major_readcount") - h[0]) / h[1], "mean_minor": (depth("minor_readcount") - h[0]) / h[1], "mean_total": (total - 2 * h[0]) / h[1],
    })


def expected_read_counts(rows: DataFrame) -> DataFrame:
    """Expected major, minor and total reads of states: sum of cn * h * measurable proportion * length, plus 1e-16."""
    weigh = lambda a: F.col(f"{a}_0") * F.col("h_0") + F.col(f"{a}_1") * F.col("h_1") + F.col(f"{a}_2") * F.col("h_2")
    major, minor = weigh("major"), weigh("minor")
    return rows.withColumns({
        "major_mu": major * F.col("phi") * F.col("length") + EPSILON, "minor_mu": minor * F.col("phi") * F.col("length") + EPSILON, "total_mu": (major + minor) * F.col("length") + EPSILON,
        "p": F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), minor / (major + minor))),
    })


def masks(rows: DataFrame, min_length: float, min_genotyped: float, cn_max: int, max_depth: float) -> DataFrame:
    """Boolean columns that mark poor rows instead of dropping them."""
    raw = F.least(F.greatest(F.coalesce(F.nanvl("total_raw", F.lit(float("inf"))), F.lit(float("inf"))), F.lit(0.0)), F.lit(1e6))
    return rows.withColumns({
        "segment_length_mask": F.col("length") >= min_length,
        "genotyped_mask": (F.col("major_readcount") + F.col("minor_readcount")) / (F.col("readcount") + EPSILON) >= min_genotyped,
        "amplification_mask": F.bround(raw) <= cn_max,
        "depth_mask": F.col("total_depth") <= max_depth,
    })


def weighted_percentile(rows: DataFrame, by: list[str], value: str, weight: str, q: float) -> DataFrame:
    """The least value whose cumulative weight reaches the share q of the weight, by group."""
    grouped = rows.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    totals = Window.partitionBy(*by)
    reached = grouped.withColumns({"_cum": F.sum("_w").over(upto), "_all": F.sum("_w").over(totals)}).where(F.col("_cum") >= q * F.col("_all"))
    return reached.groupBy(*by).agg(F.min(value).alias("value"))


def minor_modes(depths: DataFrame, k: int = 5, by: str = "sample_id", cells: int = 1024) -> DataFrame:
    """(by, centre): centres of the best ``k`` clusters of length-weighted minor depths of each sample; the top 5 % and clusters under 1 % of the weight go.

    Clusters are the best whose limits are those of ``cells`` equal cells, see
    ``weighted_clusters``; nothing is iterated.
    """
    cut = exact_percentiles(depths, [by], ["minor"], 0.95).withColumnRenamed("minor", "_cut")
    found = weighted_clusters(depths.join(cut, by).where(F.col("minor") < F.col("_cut")), [by], "minor", "length", k, cells)
    total = F.sum("weight").over(Window.partitionBy(by))
    return found.withColumn("_all", total).where(F.col("weight") >= 0.01 * F.col("_all")).select(by, "centre")


def concat_position(rows: DataFrame, offsets: DataFrame, columns: list[str]) -> DataFrame:
    """Add plot_<column>: positions on the concatenated genome."""
    shifted = rows.join(offsets.select("chromosome", F.col("start").alias("_shift")), "chromosome")
    return shifted.withColumns({f"plot_{c}": F.col(c) + F.col("_shift") for c in columns}).drop("_shift")


#: Standard deviations beyond which exp(-z * z / 2) is 0 in doubles, and no sum is changed (it is from 38.61 on).
REACH = 39.0
#: Rows of a group that one task takes, kernel values it holds at a time, and curves it gives at a time.
CHUNK, HELD, CURVES = 20_000, 1 << 18, 16


def kernel_sums(x: np.ndarray, weight: np.ndarray, bandwidth: np.ndarray, top: np.ndarray, group: np.ndarray, points: int) -> np.ndarray:
    """Sums of weighted Gaussian kernels at ``points`` equal steps from 0 to a group's ``top``; one row for each group.

    ``bandwidth`` and ``top`` are those of the groups, ``group`` is the row's. Points
    from which a row lies ``REACH`` bandwidths away or more get 0 from it.
    """
    last, bw = points - 1, bandwidth[group]
    with np.errstate(divide="ignore", invalid="ignore"):
        step = top[group] / last
        low, high = np.ceil((x - REACH * bw) / step), np.floor((x + REACH * bw) / step) + 1
    low, high = (np.where(step > 0, np.clip(np.nan_to_num(a), 0, points), b).astype(np.int64) for a, b in ((low, 0), (high, points)))
    size = np.maximum(high - low, 0)
    upto = np.cumsum(size)
    grid = (top[:, None] * np.arange(points) / last).ravel()
    out = np.zeros(len(grid))
    begin = 0
    while begin < len(x):
        before = upto[begin] - size[begin]
        end = max(begin + 1, int(np.searchsorted(upto, before + HELD, side="right")))
        part = slice(begin, end)
        each = lambda a: np.repeat(a[part], size[part])
        cell = each(group * points + low - (upto - size - before)) + np.arange(upto[end - 1] - before)
        z = (grid[cell] - each(x)) / each(bw)
        out += np.bincount(cell, weights=each(weight) * np.exp(-0.5 * (z * z)), minlength=len(out))
        begin = end
    return out.reshape(len(top), points) / (bandwidth * math.sqrt(2 * math.pi))[:, None]


def density(rows: DataFrame, by: list[str], values: list[str], weight: str, limit: str, points: int = 2000, factor: float = 0.01) -> DataFrame:
    """(by, i, x, values): weighted Gaussian kernel densities of several values on one grid, from 0 to the weighted 95th percentile of ``limit``, one of them.

    A group has ``points`` equal steps, both ends included, and a point more at each
    end, where densities are 0 so that the curves are closed. The bandwidth is
    ``factor`` times the weighted standard deviation, corrected by the effective
    number of rows; a value that doesn't vary has no density (null). Equal rows are
    added up first. A group with more rows than ``CHUNK`` is spread over tasks and
    its curves are added.
    """
    w, x = F.col("_w"), F.col
    equal = rows.select(*by, *values, F.col(weight).alias("_w")).groupBy(*by, *values).agg(F.sum("_w").alias("_w"), F.sum(w * w).alias("_w2"))
    top = weighted_percentile(equal, by, limit, "_w", 0.95).withColumnRenamed("value", "_top")
    moments = [F.sum(a).alias(f"_{c}_{k}") for c in values for k, a in ((1, w * x(c)), (2, w * x(c) * x(c)))]
    stats = equal.groupBy(*by).agg(F.count("*").alias("_n"), F.sum("_w").alias("_all"), F.sum("_w2").alias("_W2"), *moments)
    total = F.col("_all").cast("double")
    spread = lambda c: F.try_divide(F.col(f"_{c}_2") / total - (F.col(f"_{c}_1") / total) * (F.col(f"_{c}_1") / total), 1 - F.col("_W2") / (total * total))
    stats = stats.where("_all > 0").select(*by, total.alias("_all"), F.ceil(F.col("_n") / CHUNK).alias("_chunks"), *(F.when(spread(c) > 0, factor * F.sqrt(spread(c))).alias(f"_bw_{c}") for c in values))
    joined = equal.drop("_w2").join(stats.join(top, by), by).withColumn("_chunk", F.pmod(F.xxhash64(*values), F.col("_chunks")))
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "i int", "x double", *(f"`{c}` double" for c in values)])
    keys = [*by, "_chunk"]

    def curves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.clip(np.arange(points + 2) - 1, 0, points - 1)

        def of(groups: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
            first, group = groups.take(begins), np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(groups))))
            number = lambda table, c: table[c].to_numpy().astype(float)
            tops, weights = number(first, "_top"), number(groups, "_w")
            out = [first[c].combine_chunks().take(np.repeat(np.arange(len(begins)), points + 2)) for c in by]
            out += [np.tile(np.arange(points + 2, dtype=np.int32), len(begins)), (tops[:, None] * place / (points - 1)).ravel()]
            for c in values:
                bw = number(first, f"_bw_{c}")
                sums = kernel_sums(number(groups, c), weights, bw, tops, group, points) / number(first, "_all")[:, None]
                closed = np.pad(sums, ((0, 0), (1, 1)))
                out.append(pa.array(closed.ravel(), mask=np.repeat(np.isnan(bw), points + 2)))
            return pa.RecordBatch.from_arrays([pa.array(a) if isinstance(a, np.ndarray) else a for a in out], [*by, "i", "x", *values])

        held = None  # rows of the last group, which the next batch may go on with
        for batch in chain(batches, [None]):
            parts = [t for t in (held, batch and pa.Table.from_batches([batch])) if t is not None and len(t)]
            if not parts:
                continue
            table = pa.concat_tables(parts).combine_chunks()
            new = np.ones(len(table), dtype=bool)
            new[1:] = np.logical_or.reduce([pc.not_equal(table[c][1:], table[c][:-1]).to_numpy() for c in keys])
            begins = np.append(np.flatnonzero(new), len(table))
            whole = len(begins) - 1 if batch is None else len(begins) - 2
            for a in range(0, whole, CURVES):
                b = min(a + CURVES, whole)
                yield of(table.slice(begins[a], begins[b] - begins[a]), begins[a:b] - begins[a])
            held = table.slice(begins[whole])

    # Curves are far larger than their rows, so small partitions aren't put together.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def drawn(part: DataFrame) -> DataFrame:
        return part.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(curves, schema)

    spread_out = drawn(joined.where("_chunks > 1")).groupBy(*by, "i", "x").agg(*(F.sum(c).alias(c) for c in values))
    return drawn(joined.where("_chunks = 1")).unionByName(spread_out)
