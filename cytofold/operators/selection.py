"""Exact percentiles and one-dimensional clusters from histograms of bounded size.

Histograms of partitions add up, so no task sees the values of a group: a pass
tells in which bin an order statistic lies, and the next one divides that bin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytofold.sources.storage import materialise


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """The bin, from 0, of a value between ``low`` and ``high``."""
    return F.when(high > low, F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1))).otherwise(F.lit(0))


def exact_percentiles(rows: DataFrame, by: list[str], columns: list[str], q: float, bins: int = 4096) -> DataFrame:
    """(by, columns): the percentile of each column in each group, between the two nearest values in proportion.

    Null and NaN values don't count; a group without values has null. Each pass
    counts the values of the bins that still hold a wanted one, in ``bins`` parts
    between the least and the largest of them, until these are equal: some passes
    for values spread evenly, one more at worst for each distinct value.
    """
    slim = materialise(rows.select(*by, *(F.col(c).cast("double").alias(c) for c in columns)), "percentile-values")
    named = F.array(*(F.struct(F.lit(k).alias("_c"), F.col(c).alias("_v")) for k, c in enumerate(columns)))
    values = slim.select(*by, F.explode(named).alias("_x")).select(*by, "_x.*").where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    keys = [*by, "_c"]
    at = q * (F.col("_n") - 1)
    wanted = F.array(*(F.struct(F.lit(k).alias("_end"), F.least(F.floor(at) + 1 + k, F.col("_n")).alias("_rank")) for k in (0, 1)))
    found = values.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    found = materialise(found.select(*keys, (at - F.floor(at)).alias("_share"), F.explode(wanted).alias("_w"), "_low", "_high").select(*keys, "_share", "_w.*", "_low", "_high"), "order-statistics")
    part = [*keys, "_low", "_high"]
    while not (open_ := found.where("_low < _high")).isEmpty():
        held = values.join(open_.select(*part).distinct(), keys).where("_v between _low and _high")
        counts = held.groupBy(*part, bin_of(F.col("_v"), F.col("_low"), F.col("_high"), bins).alias("_bin")).agg(F.count("*").alias("_k"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        # A window holds a row for each bin at most.
        upto = Window.partitionBy(*part).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        below = counts.withColumn("_below", F.sum("_k").over(upto) - F.col("_k"))
        met = open_.join(below, part).where((F.col("_below") < F.col("_rank")) & (F.col("_rank") <= F.col("_below") + F.col("_k")))
        met = met.select(*keys, "_share", "_end", (F.col("_rank") - F.col("_below")).alias("_rank"), F.col("_least").alias("_low"), F.col("_most").alias("_high"))
        found = materialise(found.where("_low >= _high").unionByName(met), "order-statistics")
    ends = found.groupBy(*keys).agg(F.max("_share").alias("_share"), *(F.max(F.when(F.col("_end") == k, F.col("_low"))).alias(f"_v{k}") for k in (0, 1)))
    between = ends.withColumn("_p", F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.col("_share"))
    return between.groupBy(*by).agg(*(F.max(F.when(F.col("_c") == k, F.col("_p"))).alias(c) for k, c in enumerate(columns)))


def best_cuts(weight: np.ndarray, first: np.ndarray, second: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Ranges [a, b) of cells that make the ``k`` clusters of least squared distance, from the weights and first and second moments of ordered cells."""
    w, m, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (weight, first, second))
    n = len(weight)
    k = min(k, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        cost = (q[None, :] - q[:, None]) - (m[None, :] - m[:, None]) ** 2 / (w[None, :] - w[:, None])
    cost[np.tril_indices(n + 1)] = np.inf
    value, backs = cost[0], []
    for _ in range(k - 1):
        options = value[:, None] + cost
        backs.append(options.argmin(axis=0))
        value = options.min(axis=0)
    ends = [n]
    for back in reversed(backs):
        ends.append(int(back[ends[-1]]))
    ends = [*ends, 0][::-1]
    return list(zip(ends[:-1], ends[1:], strict=True))


def weighted_clusters(rows: DataFrame, by: list[str], value: str, weight: str, k: int, cells: int = 1024) -> DataFrame:
    """(by, centre, weight): the best ``k`` clusters of each group's values, by squared distance to their weighted means.

    Values meet in ``cells`` equal cells between the least and the largest;
    clusters are the best of all that keep cells whole, found by dynamic
    programming. Values without weight don't count. Groups with fewer cells than
    ``k`` have as many clusters as cells.
    """
    full = rows.select(*by, F.col(value).cast("double").alias("_x"), F.col(weight).cast("double").alias("_w")).where(F.col("_x").isNotNull() & (F.col("_w") > 0))
    spans = full.groupBy(*by).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    apart = F.col("_x") - F.col("_low")
    placed = full.join(spans, by).groupBy(*by, "_low", bin_of(F.col("_x"), F.col("_low"), F.col("_high"), cells).alias("_cell"))
    moments = placed.agg(F.sum("_w").alias("_w"), F.sum(F.col("_w") * apart).alias("_m"), F.sum(F.col("_w") * apart * apart).alias("_q"))
    # A list has an entry for each cell at most.
    listed = moments.groupBy(*by, "_low").agg(F.array_sort(F.collect_list(F.struct("_cell", "_w", "_m", "_q"))).alias("_cells"))

    def cluster(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                w, m, q = (np.array([c[name] for c in row["_cells"]], dtype=float) for name in ("_w", "_m", "_q"))
                for a, b in best_cuts(w, m, q, k):
                    out.append((*(row[c] for c in by), row["_low"] + m[a:b].sum() / w[a:b].sum(), w[a:b].sum()))
            yield pd.DataFrame(out, columns=[*by, "centre", "weight"])

    types = dict(rows.dtypes)
    return listed.mapInPandas(cluster, ", ".join(f"`{c}` {types[c]}" for c in by) + ", centre double, weight double")
