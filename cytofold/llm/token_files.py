"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters on ids.

Documents are range-partitioned by id and sorted, so files, stripes and row
groups hold narrow id ranges: a reader prunes files and stripes by their
statistics, row groups by the row index, and looks single ids up through the
Bloom filter; stripes are read in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytofold.llm.common import new_path
from cytofold.llm.tokens import default_path, encoder

SCHEMA = "doc_id long, ids array<int>, n_tokens long, part int, start_in_part long"


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    stripe_bytes: int = 16 << 20,
    row_index_stride: int = 1000,
    bloom_fpp: float = 0.01,
) -> None:
    """Encode whole texts, append ``end_id`` to each, write them in ascending id order.

    Null and empty texts give the end id alone. Null ids come first; rows that
    share an id are all written, in the order of a hash of their texts. An empty
    table gives files without rows. Each row also holds its file part and the ids
    before it in that part, from which ``read_token_files`` gets global starts.
    """
    tokenizer = tokenizer or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        tool = encoder(tokenizer)
        for batch in batches:
            for at, ids, bounds in tool.encode(batch.column(1)):
                n = len(bounds) - 1
                ends = bounds[1:] + np.arange(1, n + 1)
                values = np.insert(ids, bounds[1:], end_id).astype(np.int32)
                sizes = np.diff(ends, prepend=0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), lists, pa.array(sizes), pa.array(np.full(n, part, dtype=np.int32)), pa.array(before + ends - sizes)],
                    names=["doc_id", "ids", "n_tokens", "part", "start_in_part"],
                )
                before += int(ends[-1])

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    (
        ordered.mapInArrow(encode, SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids, n_tokens and start (ids of all documents before it); filters on doc_id reach the ORC reader."""
    rows = spark.read.schema(SCHEMA).orc(path)
    offsets, before = [], 0
    for part, n in sorted(rows.groupBy("part").agg(F.sum("n_tokens")).collect()):  # a row per file part
        offsets.append((part, before))
        before += n
    starts = spark.createDataFrame(offsets or [(0, 0)], "part int, part_start long")
    return rows.join(F.broadcast(starts), "part").select("doc_id", "ids", "n_tokens", (F.col("part_start") + F.col("start_in_part")).alias("start"))


def id_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            bounds = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write token files into the shared folder and return the digests of what is read back."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    write_token_files(docs, path, tokenizer)
    return id_digests(read_token_files(spark, path))
