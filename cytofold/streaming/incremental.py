"""Incremental forms of the batch operators that add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cytofold.operators.counts import snp_counts
from cytofold.sources.seqio import write_seqdata


def stream_snp_counts(alleles: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Counts by position over a stream of allele rows: each batch is counted and appended, readers add batches up.

    A batch that is replayed overwrites its own folder, so counts stay exact.
    """

    def append(batch: DataFrame, number: int) -> None:
        snp_counts(batch, ["sample_id"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return alleles.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_counts(batches: DataFrame) -> DataFrame:
    return batches.groupBy("sample_id", "chromosome", "position").agg(F.sum("ref_count").alias("ref_count"), F.sum("alt_count").alias("alt_count"))


def stateful_snp_counts(alleles: DataFrame) -> DataFrame:
    """The same as Spark state, for update mode sinks."""
    return snp_counts(alleles, ["sample_id"])


def stream_write_seqdata(fragments: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of fragments to partitioned files; a replayed batch replaces its own folder."""

    def append(batch: DataFrame, number: int) -> None:
        write_seqdata(batch, f"{out}/batch={number}", mode="overwrite")

    return fragments.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
