"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a digest of id and text. A copy of a
document finishes at virtual time (words of its source up to its end) / (target
of its source); all copies are range-sorted by finish and the sequence is cut at
the total budget. Time 1 is where every source has met its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytofold.llm.common import KEY, fill, global_rank, join_split, key_columns, keyed_rows, materialise, n_words, named, nth_row

#: A source's words are summed up in buckets of about this many rows, or a quarter of the root of all rows if that is more.
BUCKET_ROWS = 64


def targets(sources: DataFrame, share: float, epochs: int) -> DataFrame:
    """Add ``target`` to (skey, source_size, weight): water filling under caps of ``epochs`` times the size.

    One level holds for all sources below their cap (target = weight * level); it
    only rises as sources reach their caps, so each round is one aggregate and
    the driver holds three numbers, however many sources there are.
    """
    cap = F.col("source_size") * epochs
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        at_cap = cap <= F.col("weight") * F.lit(level)
        full, weight, n = sources.agg(
            F.coalesce(F.sum(F.when(at_cap, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~at_cap, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(~at_cap, 1)),
        ).first()
        if not n:
            level = float("inf")
            break
        risen = (budget - full) / weight
        if risen <= level:
            break
        level = risen
    filled = F.when(cap <= F.col("weight") * F.lit(level), cap.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return sources.withColumn("target", filled)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cycle: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    epochs: int = 2,
    seed: int = 17,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, text_key.

    ``cycle`` gives the weights of the sources in code-point order, null last.
    ``copies`` (0 to ``epochs``) is how often the mix takes the document, ``taken``
    is copies * size. Null text has size 0 and is never taken, nor is any empty
    text; a source without words has target 0. Documents that agree in id and
    text are told apart by row, and which of them is taken first doesn't change
    the result. The order depends on ids, texts and ``seed`` only.
    """
    source = named(source_col).cast("string")
    key = F.xxhash64(fill(named(text_col)))
    rows = materialise(
        docs.select(
            named(id_col).alias("doc_id"),
            source.alias("source"),
            F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("skey"),
            n_words(named(text_col)).alias("size"),
            key.alias("text_key"),
            F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), named(id_col).cast("string"), named(text_col))), 1, 15), 16, 10).cast("long").alias("shuffled"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "sizes",
    )
    per_source = rows.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ranked = global_rank(per_source, "skey")
    weights = F.array(*(F.lit(float(w)) for w in cycle))
    sources = materialise(targets(ranked.withColumn("weight", F.get(weights, (F.col("rank") % len(cycle)).cast("int"))), share, epochs), "sources")
    budget, total = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bucket_rows = max(BUCKET_ROWS, int(total**0.5 / 4))

    placed = join_split(rows, sources.select("skey", "source_size", "target", "n"), ["skey"])
    placed = placed.withColumn("bucket", F.floor(F.col("shuffled") / F.lit(2.0**60) * F.ceil(F.col("n") / bucket_rows)))
    within = Window.partitionBy("skey", "bucket").orderBy("shuffled", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("skey", "bucket").agg(F.sum("size").alias("_words")).select("skey", "bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_start"))
    summed = placed.withColumn("_end", F.sum("size").over(within)).join(starts, ["skey", "bucket"])
    copies = summed.withColumn("epoch", F.explode(F.array(*(F.lit(e) for e in range(epochs)))))
    finish = (F.col("epoch") * F.col("source_size") + F.col("_start") + F.col("_end")) / F.col("target")
    copies = copies.select("doc_id", "source", "size", "source_size", "target", "text_key", "row", "shuffled", F.when((F.col("target") > 0) & (F.col("size") > 0), finish).alias("finish"))

    order = ["finish", "shuffled", "doc_id", "row"]
    queued = materialise(
        copies.where("finish is not null").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)),
        "queue",
    )
    offsets, words = [], 0
    for part, n in sorted(queued.groupBy("part").agg(F.sum("size")).collect()):  # a row per partition
        offsets.append((part, words))
        words += n
    start = docs.sparkSession.createDataFrame(offsets or [(0, 0)], "part long, _before long")
    running = F.sum("size").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    taken = (
        queued.withColumn("_run", running)
        .join(F.broadcast(start), "part")
        .where(F.col("_before") + F.col("_run") <= F.lit(budget + 1e-6))  # a sum of targets, whose last digits hang on its order
        .groupBy("row")
        .agg(F.count("*").alias("copies"))
    )
    return (
        placed.join(taken, "row", "left")
        .withColumn("copies", F.coalesce("copies", F.lit(0)).cast("int"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_key")
    )


def draw_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = 2, **options) -> DataFrame:
    """The mixed rows of ``docs``, all columns as they were; a document taken twice comes twice.

    Of rows that agree in id, text and source, those whose columns hash least are
    taken most, so that reruns agree.
    """
    as_text = lambda source: F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1")).alias("_source")
    mixed = mix_sources(docs, id_col, text_col, source_col, epochs=epochs, **options).where("copies > 0")
    mixed = mixed.select(*key_columns(F.col("doc_id"), F.col("text_key")), as_text(F.col("source")), "copies")
    most = mixed.groupBy(*KEY, "_source").agg(*(F.count_if(F.col("copies") >= e).alias(f"_at_least_{e}") for e in range(1, epochs + 1)))
    keyed = keyed_rows(docs, named(id_col), F.xxhash64(fill(named(text_col)))).withColumn("_source", as_text(F.col("_row").getField(source_col)))
    taken = keyed.join(most, [*KEY, "_source"]).withColumn("_nth", nth_row(keyed, "_source"))
    copies = sum(((F.col("_nth") <= F.col(f"_at_least_{e}")).cast("int") for e in range(1, epochs + 1)), F.lit(0))
    return taken.withColumn("_copies", copies).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*")
