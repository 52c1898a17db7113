"""What the training-data operators share: reading, shared storage, ordering."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytofold.sources.storage import delete_now, materialise, new_path

__all__ = ["KEY", "Shelf", "documents", "fill", "fold", "global_rank", "heavy_keys", "join_split", "key_columns", "keyed_rows", "materialise", "n_words", "named", "new_path", "nth_row", "release_shuffles", "words"]

#: ASCII white space; a word is a run of anything else.
SPACE_RUN = r"[\x20\x09-\x0D]+"
SPACE_CHARS = "\t\n\x0b\x0c\r "


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of tables that have been written.

    They go once the driver collects its garbage, which a job of few objects and
    many bytes seldom does by itself. What Python let go of is let go of by the JVM
    a moment later, hence the second turn.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


class Shelf:
    """Tables in the shared folder that go once their readers are done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def put(self, rows: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        rows.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            delete_now(self.spark, path)
        self.paths = []
        release_shuffles(self.spark)


def named(column: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + column.replace("`", "``") + "`")


def fill(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.array_remove(F.split(fill(text), SPACE_RUN), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


#: The columns that tell rows apart, nulls and repeated ids as well.
KEY = ["_last", "_id", "_text_key"]


def key_columns(ident: Column, text_key: Column) -> list[Column]:
    return [ident.isNull().alias("_last"), F.coalesce(ident.cast("string"), F.lit("")).alias("_id"), text_key.alias("_text_key")]


def keyed_rows(docs: DataFrame, ident: Column, text_key: Column) -> DataFrame:
    """``_row``, which holds all columns so that none can clash, and the columns of ``KEY``."""
    return docs.select(F.struct(*(named(c) for c in docs.columns)).alias("_row"), *key_columns(ident, text_key))


def nth_row(keyed: DataFrame, *more: str) -> Column:
    """The number, from 1, of a row among those that agree in ``KEY`` and ``more``, in the order of a hash of all columns."""
    fields = keyed.schema["_row"].dataType.names
    return F.row_number().over(Window.partitionBy(*KEY, *more).orderBy(F.xxhash64(*(F.col("_row").getField(c).cast("string") for c in fields))))


#: A key is heavy if it has more than this part of the rows, so that at most as many are.
HEAVY = 1024


def heavy_keys(spark: SparkSession) -> int:
    """``HEAVY``, or the number of shuffle partitions if that is more: a key that isn't heavy has no more rows than a partition has on average."""
    return max(HEAVY, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_split(rows: DataFrame, table: DataFrame, on: list[str], count: str = "n") -> DataFrame:
    """``rows`` joined with ``table``, which has a row for each key and in ``count`` how many of ``rows`` have it.

    Heavy keys, ``heavy_keys`` at most, are broadcast; the others meet in a shuffle.
    """
    most = heavy_keys(rows.sparkSession)
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    heavy = table.where(F.col(count) * most > total)
    light = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(table.where(F.col(count) * most <= total), on)
    return rows.join(F.broadcast(heavy), on).unionByName(light)


def global_rank(df: DataFrame, *order: str) -> DataFrame:
    """Add ``rank`` (from 0) in the order given, without gathering rows in one task.

    Range partitions are numbered by Spark's own partition-and-row ids; the
    offsets table has one row per partition, so it is bounded and broadcast.
    """
    placed = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "rank",
    )
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    offsets, total = [], 0
    for row in sorted(counts.collect()):
        offsets.append((row["_part"], total))
        total += row["_n"]
    start = placed.sparkSession.createDataFrame(offsets or [(0, 0)], "_part long, _start long")
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(start), "_part")
        .withColumn("rank", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_at", "_part", "_start")
    )
