"""Exact duplicates with a heavy-hitter split.

Frequent digests are found by mergeable Misra-Gries summaries, verified by an
exact count, and their winners broadcast (at most ``k`` rows), so rows of a large
group are settled where they lie. All other digests have at most ``n / (k + 1)``
rows each and meet in ordinary shuffles: their counts are summed up before the
shuffle and joined back row by row, so that no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytofold.llm.common import KEY, SPACE_RUN, fill, heavy_keys, key_columns, keyed_rows, materialise, named, nth_row

FAN_IN = 32


def trim(counts: pd.Series, k: int) -> pd.Series:
    """Keep ``k`` counters: the (k + 1)-th largest count is taken from all, what is left above 0 stays."""
    if len(counts) <= k:
        return counts
    counts = counts.sort_values(ascending=False)
    counts = counts.iloc[:k] - counts.iloc[k]
    return counts[counts > 0]


def heavy_candidates(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Keys that may hold more than ``1 / (k + 1)`` of the rows; ``k`` rows at most.

    Every partition makes a summary; summaries merge in a tree of fan-in
    ``FAN_IN``, so no task sees more than ``FAN_IN * k`` counters.
    """

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        kept = pd.Series(dtype="int64")
        for batch in batches:
            kept = trim(kept.add(batch[key].value_counts(), fill_value=0).astype("int64"), k)
        yield pd.DataFrame({"part": TaskContext.get().partitionId(), key: kept.index.astype(object), "n": kept.to_numpy()})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        kept = trim(group.groupby(key)["n"].sum(), k)
        return pd.DataFrame({"part": group["part"].iloc[0] // FAN_IN, key: kept.index.astype(object), "n": kept.to_numpy()})

    schema = f"part long, {key} string, n long"
    parts = rows.select(key).rdd.getNumPartitions()
    found = rows.select(key).mapInPandas(summarise, schema)
    while True:
        found = found.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, schema)
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            return found.select(key)


def digest(text):
    """SHA-256 (lowercase hex) of a text whose white-space runs are single spaces."""
    return F.sha2(F.regexp_replace(fill(text), SPACE_RUN, " ").cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; the empty text is a text like any other. Of equal
    texts the row with the smallest id stays, null ids last; of rows that agree
    in id and text one stays. Columns beside id and text are ignored, so clashing
    names do no harm. An empty table gives an empty result. ``k`` counters find
    the frequent digests: as many as ``heavy_keys`` says if not given.
    """
    k = k or heavy_keys(docs.sparkSession)
    rows = materialise(
        docs.select(named(id_col).alias("doc_id"), digest(named(text_col)).alias("text_sha256"), F.monotonically_increasing_id().alias("row")),
        "digests",
    )
    total = rows.count()
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    counted = [F.min(order).alias("first"), F.count("*").alias("group_size")]
    winners = (
        rows.join(F.broadcast(heavy_candidates(rows, "text_sha256", k)), "text_sha256")
        .groupBy("text_sha256")
        .agg(*counted)
        .where((F.col("group_size") > 1) & (F.col("group_size") * (k + 1) > total))
    )
    winners = materialise(winners, "winners")
    tagged = rows.join(F.broadcast(winners), "text_sha256", "left")
    light = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    rest = light.join(light.groupBy("text_sha256").agg(*counted), "text_sha256")
    return tagged.where(F.col("first").isNotNull()).unionByName(rest).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("first.row") == F.col("row")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were; of rows that agree in id and text the one whose columns hash least."""
    kept = exact_dedup(docs, id_col, text_col, k).where("kept").select(*key_columns(F.col("doc_id"), F.col("text_sha256")))
    keyed = keyed_rows(docs, named(id_col), digest(named(text_col)))
    return keyed.join(kept, KEY, "left_semi").withColumn("_nth", nth_row(keyed)).where("_nth = 1").select("_row.*")
