"""GC and mappability bias.

Position-level work runs on chunks of the genome (chromosome, chunk_start, seq):
prefix sums are per chunk plus an offset from the chunks before, so no window
spans a chromosome's bases.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytofold.operators.intervals import bins
from cytofold.sources.storage import materialise


def genome_chunks(bases: DataFrame, width: int = 1000) -> DataFrame:
    """Chunks of text from single bases (chromosome, pos, base)."""
    start = F.floor(F.col("pos") / width) * width
    rows = bases.groupBy("chromosome", start.alias("chunk_start")).agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("b"))
    return rows.select("chromosome", "chunk_start", F.array_join(F.transform("b", lambda x: x["base"]), "").alias("seq"))


def is_gc(base: Column) -> Column:
    return base.isin("G", "C", "g", "c").cast("int")


#: The complements of bases, other letters as they are; by byte.
COMPLEMENT = np.arange(256, dtype=np.uint8)
COMPLEMENT[np.frombuffer(b"ACTGactg", dtype=np.uint8)] = np.frombuffer(b"TGACtgac", dtype=np.uint8)
KEY = ["chromosome", "chunk_start"]


def with_margins(chunks: DataFrame, before: int, after: int, width: int = 1000) -> DataFrame:
    """Chunks with ``head`` and ``tail``: the last bases of the chunk before and the first of the one after; chunks meet by their starts."""
    if max(before, after) > width:
        raise ValueError("margins reach beyond the next chunk; take wider chunks")
    shifted = lambda by, text, name: chunks.select("chromosome", (F.col("chunk_start") + by).alias("chunk_start"), text.alias(name))
    joined = chunks.join(shifted(width, F.right("seq", F.lit(before)), "head"), KEY, "left").join(shifted(-width, F.left("seq", F.lit(after)), "tail"), KEY, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in ("head", "tail")})


def gc_flags(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda x: x != ""), is_gc)


def gc_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^GCgc]", ""))


def gc_cumsum(chunks: DataFrame) -> DataFrame:
    """(chromosome, pos, gc): how many G and C there are up to each position, itself included.

    Running sums are within chunks, which bases don't leave; chunks get the sum of
    those before them.
    """
    upto = Window.partitionBy("chromosome").orderBy("chunk_start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunks.select(*KEY, gc_count(F.col("seq")).alias("_n"))
    offset = chunks.join(sizes.select(*KEY, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before")), KEY).repartition(*KEY)
    bases = offset.select(*KEY, "_before", F.posexplode(gc_flags(F.col("seq"))).alias("i", "gc"))
    within = F.sum("gc").over(Window.partitionBy(*KEY).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return bases.select("chromosome", (F.col("chunk_start") + F.col("i")).alias("pos"), (F.col("_before") + within).alias("gc"))


def gc_window_counts(chunks: DataFrame, fragment_length: int, offset: int, width: int = 1000) -> DataFrame:
    """G and C in the window of fragment_length - 2 * offset bases that ends at each position, from chunks with a margin."""
    size = fragment_length - 2 * offset
    rows = with_margins(chunks, size, 0, width).repartition(*KEY).select(*KEY, F.length("head").alias("_h"), F.posexplode(gc_flags(F.concat("head", "seq"))).alias("i", "_gc"))
    order = Window.partitionBy(*KEY).orderBy("i")
    rows = rows.withColumn("_run", F.sum("_gc").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_gone", F.lag("_run", size).over(order))
    return rows.where("i >= _h").select("chromosome", (F.col("chunk_start") + F.col("i") - F.col("_h")).alias("pos"), (F.col("_run") - F.coalesce("_gone", F.lit(0))).alias("gc"))


def mappable(track: DataFrame, chromosomes: DataFrame, threshold: int) -> DataFrame:
    """Intervals of sufficient quality, clipped at the chromosome's end."""
    joined = track.where(F.col("quality") >= threshold).join(chromosomes.select("chromosome", "length"), "chromosome")
    return joined.where("start < length").select("chromosome", "start", F.least("end", "length").alias("end"))


def covered(points: DataFrame, intervals: DataFrame, column: str) -> DataFrame:
    """Points whose ``column`` lies in one of the (disjoint) intervals."""
    width = 10_000
    dealt = intervals.where(F.col("end") > F.col("start")).select(F.col("chromosome").alias("_cover_c"), F.col("start").alias("_cover_s"), F.col("end").alias("_cover_e"), bins(F.col("start"), F.col("end") - 1, width).alias("_cover_b"))
    at = F.col(column)
    return points.join(dealt, (F.col("chromosome") == F.col("_cover_c")) & (F.floor(at / width) == F.col("_cover_b")) & (at >= F.col("_cover_s")) & (at < F.col("_cover_e")), "left_semi")


def gc_samples(chunks: DataFrame, track: DataFrame, chromosomes: DataFrame, fragments: DataFrame, fragment_length: int, offset: int, n: int, threshold: int = 1, seed: int = 0, width: int = 1000) -> DataFrame:
    """Hashed sample positions: GC share of their window and fragments that start there.

    The k-th position is (k * 7919 * 104729 + seed) modulo the genome's length, on
    the concatenated genome; unmappable starts and windows beyond the end go. A
    sample meets the chunk that its window ends in, and reads its own bases only.
    """
    size = fragment_length - 2 * offset
    total = F.sum("length").over(Window.orderBy("chromosome_idx"))
    spans = chromosomes.withColumns({"_to": total, "_from": total - F.col("length")})
    genome = chromosomes.agg(F.sum("length").alias("_genome"))
    drawn = chunks.sparkSession.range(n).join(F.broadcast(genome)).select(((F.col("id") * 829348951 + seed) % F.col("_genome")).alias("_p"))
    placed = drawn.join(F.broadcast(spans), (F.col("_p") >= F.col("_from")) & (F.col("_p") < F.col("_to"))).select("chromosome", (F.col("_p") - F.col("_from")).alias("position"), "length")
    placed = placed.where(F.col("position") + fragment_length - offset - 1 < F.col("length")).drop("length")
    placed = covered(placed, mappable(track, chromosomes, threshold), "position")
    last = F.col("position") + fragment_length - offset - 1
    near = placed.withColumns({"_last": last, "chunk_start": F.floor(last / width) * width}).join(with_margins(chunks, size, 0, width), KEY)
    end = F.length("head") + F.col("_last") - F.col("chunk_start") + 1  # of the window, in head and chunk
    at = near.withColumn("_gc", gc_count(F.substring(F.concat("head", "seq"), F.greatest(end - size + 1, F.lit(1)), F.least(F.lit(size), end))))
    at = materialise(at.select("chromosome", "position", "_gc"), "gc-positions")  # ``n`` rows at most
    asked = at.select("chromosome", F.col("position").alias("start")).distinct().withColumn("position", F.col("start"))
    # Fragments elsewhere keep one row of their sample, without a position; so samples are known and fragments are read once.
    reads = fragments.select("sample_id", "chromosome", "start").join(asked, ["chromosome", "start"], "left")
    reads = materialise(reads.groupBy("sample_id", F.when(F.col("position").isNotNull(), F.col("chromosome")).alias("chromosome"), "position").agg(F.count("*").alias("read_count")), "gc-reads")
    samples = reads.agg(F.collect_set("sample_id")).scalar()  # a handful
    full = at.withColumn("sample_id", F.explode(samples)).join(reads.where("position is not null"), ["sample_id", "chromosome", "position"], "left")
    return full.select("sample_id", "chromosome", "position", (F.col("_gc") / F.lit(float(size))).alias("gc_percent"), F.coalesce("read_count", F.lit(0)).alias("read_count"))


def gc_binned_counts(samples: DataFrame, resolution: int = 100) -> DataFrame:
    """Sum, number and mean of counts by rounded GC percentage, all bins present."""
    binned = samples.groupBy("sample_id", F.bround(F.col("gc_percent") * resolution).cast("int").alias("gc_bin")).agg(F.sum("read_count").alias("sum"), F.count("*").alias("len"))
    grid = samples.select("sample_id").distinct().select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(resolution))).alias("gc_bin"))
    filled = grid.join(binned, ["sample_id", "gc_bin"], "left").fillna(0, ["sum", "len"])
    return filled.withColumn("mean", F.when(F.col("len") > 0, F.col("sum") / F.col("len")).otherwise(F.lit(0.0)))


def gc_lowess(binned: DataFrame, frac: float = 0.2, passes: int = 3, resolution: int = 100) -> DataFrame:
    """Locally weighted regression of the mean on the bin, scaled to a maximum of 1.

    Each bin's k nearest bins get tricube weights and a weighted line by sums;
    ``passes`` further rounds weigh residuals by the bisquare of six medians.
    """
    k = int(frac * (resolution + 1) + 1e-10)
    points = materialise(binned.select("sample_id", F.col("gc_bin").cast("double").alias("x"), F.col("mean").alias("y")), "gc-points")
    left = points.select("sample_id", F.col("x").alias("x0"))
    near = left.join(points, "sample_id").withColumn("_d", F.abs(F.col("x") - F.col("x0")))
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy("sample_id", "x0").orderBy("_d", "x"))).where(F.col("_r") <= k)
    local = ranked.withColumn("_h", F.max("_d").over(Window.partitionBy("sample_id", "x0"))).withColumn("w", F.pow(1 - F.pow(F.try_divide("_d", "_h"), 3), 3)).select("sample_id", "x0", "x", "y", "w")
    local = materialise(local, "gc-weights")
    robust = points.select("sample_id", "x", F.lit(1.0).alias("b"))
    fitted = points
    for turn in range(passes + 1):
        w = F.col("w") * F.col("b")
        sums = local.join(robust, ["sample_id", "x"]).groupBy("sample_id", "x0").agg(F.sum(w).alias("s"), F.sum(w * F.col("x")).alias("sx"), F.sum(w * F.col("y")).alias("sy"), F.sum(w * F.col("x") * F.col("x")).alias("sxx"), F.sum(w * F.col("x") * F.col("y")).alias("sxy"))
        det = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
        slope = F.when(F.abs(det) > 1e-12, F.try_divide(F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy"), det)).otherwise(0.0)
        line = F.try_divide("sy", "s") + F.col("_m") * (F.col("x0") - F.try_divide("sx", "s"))
        # Where all weights are 0 the point itself stays.
        own = points.withColumnRenamed("x", "x0")
        fitted = sums.withColumn("_m", slope).join(own, ["sample_id", "x0"]).select("sample_id", F.col("x0").alias("x"), F.coalesce(line, F.col("y")).alias("smoothed"))
        if turn < passes:
            rest = points.join(fitted, ["sample_id", "x"]).withColumn("_e", F.abs(F.col("y") - F.col("smoothed")))
            scale = rest.groupBy("sample_id").agg((6 * F.percentile("_e", 0.5)).alias("_s"))
            u = F.coalesce(F.try_divide("_e", "_s"), F.lit(0.0))
            robust = materialise(rest.join(scale, "sample_id").select("sample_id", "x", F.when(u < 1, F.pow(1 - u * u, 2)).otherwise(F.lit(0.0)).alias("b")), "gc-robust")
    top = fitted.groupBy("sample_id").agg(F.max("smoothed").alias("_top"))
    return fitted.join(top, "sample_id").select("sample_id", F.col("x").cast("int").alias("gc_bin"), F.try_divide("smoothed", "_top").alias("smoothed"))


def gc_probability(curve: DataFrame, lengths: DataFrame, resolution: int = 100) -> DataFrame:
    """(length, gc_count, gc_weight): the curve's share at the GC percentage, rounded down, for all counts of windows of the ``lengths`` (length).

    ``curve`` has gc_bin 0 to ``resolution`` and smoothed; it is scaled to sum 1,
    and negative values give 0.
    """
    share = curve.crossJoin(F.broadcast(curve.agg(F.sum("smoothed").alias("_all")))).select("gc_bin", F.greatest(F.col("smoothed") / F.col("_all"), F.lit(0.0)).alias("gc_weight"))
    counts = lengths.select("length", F.explode(F.sequence(F.lit(0), F.col("length").cast("int"))).alias("gc_count"))
    bin_ = F.least(F.floor(F.col("gc_count") / F.col("length") * resolution), F.lit(resolution)).cast("int")
    return counts.withColumn("gc_bin", bin_).join(share, "gc_bin").select("length", "gc_count", "gc_weight")


def segment_bias(
    segments: DataFrame, chunks: DataFrame, track: DataFrame, chromosomes: DataFrame, curve: DataFrame, mean: float, stddev: float, offset: int, read_length: int,
    step: int = 10, threshold: int = 1, do_gc: bool = True, do_map: bool = True, width: int = 1000,
) -> DataFrame:
    """Sum of length density, GC weight of the window and mappability of read and mate over all places of fragments.

    Segments are dealt to the chunks that they touch. A chunk, with a margin as
    long as the longest fragment and the mappable intervals that touch both, holds
    all that fragments starting in it need, so that bases are never shuffled.
    Fragments lie within their segment.
    """
    low, high = int(mean - 2.3263478740 * stddev - 1.0), int(mean + 2.3263478740 * stddev + 1.0)
    lengths = [x for x in range(low, high + 1, step) if x >= read_length]
    spark, margin = chunks.sparkSession, max(lengths)
    # A row for each length and count: their number depends on the fragments' lengths only.
    table: dict[int, dict[int, float]] = {}
    for r in gc_probability(curve, spark.createDataFrame([(x - 2 * offset,) for x in lengths], "length int")).collect():
        table.setdefault(r["length"], {})[r["gc_count"]] = r["gc_weight"]
    weights = {x: np.array([table[x - 2 * offset][c] for c in range(x - 2 * offset + 1)]) if do_gc else np.ones(x - 2 * offset + 1) for x in lengths}
    density = {x: math.exp(-0.5 * ((x - mean) / stddev) ** 2) / (stddev * math.sqrt(2 * math.pi)) for x in lengths}

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                text = np.frombuffer(row.text.encode("ascii"), dtype=np.uint8)
                gc = np.cumsum(np.isin(text, np.frombuffer(b"GCgc", dtype=np.uint8)))
                ok = np.zeros(len(text), dtype=bool) if do_map else np.ones(len(text), dtype=bool)
                for span in row.spans if row.spans is not None else ():
                    ok[max(0, span["start"] - row.chunk_start) : max(0, span["end"] - row.chunk_start)] = True
                total = 0.0
                for x in lengths:
                    at = np.arange(max(row.start, row.chunk_start), min(row.end - x, row.chunk_start + width)) - row.chunk_start
                    at = at[ok[at]]
                    at = at[ok[at + x - read_length]]
                    total += density[x] * weights[x][gc[at + x - offset] - gc[at + offset]].sum()
                found.append(total)
            yield pd.DataFrame({"segment_idx": batch["segment_idx"], "bias": found})

    texts = with_margins(chunks, 0, margin, width).select(*KEY, F.concat("seq", "tail").alias("text"))
    deal = lambda rows, first: rows.where(F.col("end") > F.col("start")).withColumn("_bin", bins(first, F.col("end") - 1, width)).withColumn("chunk_start", F.col("_bin") * width).drop("_bin")
    dealt = deal(segments.select("segment_idx", "chromosome", "start", "end"), F.col("start"))
    near = deal(mappable(track, chromosomes, threshold), F.greatest(F.col("start") - margin, F.lit(0))).groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    placed = dealt.join(texts.join(near, KEY, "left"), KEY).select("segment_idx", "chunk_start", "start", "end", "text", "spans")
    found = placed.mapInPandas(weigh, "segment_idx long, bias double").groupBy("segment_idx").agg(F.sum("bias").alias("bias"))
    return segments.join(found, "segment_idx", "left").withColumn("bias", F.coalesce("bias", F.lit(0.0)))


def biased_length(rows: DataFrame, by: list[str]) -> DataFrame:
    """Length in proportion to bias, with the genome's total length."""
    totals = rows.groupBy(*by).agg(F.sum("bias").alias("_bias"), F.sum(F.col("end") - F.col("start")).cast("double").alias("_size"))
    joined = rows.join(totals, by) if by else rows.crossJoin(F.broadcast(totals))
    return joined.withColumn("length", F.col("bias") / F.col("_bias") * F.col("_size")).drop("_bias", "_size")


def reverse_complement(column: Column) -> Column:
    return F.translate(F.reverse(column), "ACTGactg", "TGACtgac")


def kmers(chunks: DataFrame, k: int, width: int = 1000) -> DataFrame:
    """All k-mers without N, upper case, from chunks that borrow the next chunk's first k - 1 bases."""
    joined = with_margins(chunks, 0, k - 1, width).select(*KEY, F.upper(F.concat("seq", "tail")).alias("s")).where(F.length("s") >= k)
    rows = joined.select(*KEY, F.explode(F.sequence(F.lit(1), F.least(F.length("s") - (k - 1), F.lit(width)))).alias("i"), "s")
    found = rows.select("chromosome", (F.col("chunk_start") + F.col("i") - 1).alias("start"), F.substring(F.col("s"), F.col("i"), F.lit(k)).alias("kmer"))
    return found.where(~F.contains("kmer", F.lit("N"))).withColumn("id", F.concat_ws(":", "chromosome", "start"))


def cut_super_kmers(text: bytes, k: int, m: int, most: int) -> Iterator[tuple[int, int, bytes]]:
    """(minimiser, start, bases) of the runs of k-mers without N, of the first ``most`` ones, that share their minimiser.

    The minimiser of a k-mer is the least hash of its m-mers, each taken with its
    reverse complement, so both strands of a k-mer have the same one.
    """
    bases = np.frombuffer(text, dtype=np.uint8)
    n = min(len(bases) - k + 1, most)
    if n <= 0:
        return
    fore, back = np.zeros(n + k - m, np.uint64), np.zeros(n + k - m, np.uint64)
    for j in range(m):
        at = bases[j : j + len(fore)]
        fore |= at.astype(np.uint64) << np.uint64(8 * (m - 1 - j))
        back |= COMPLEMENT[at].astype(np.uint64) << np.uint64(8 * j)
    hashes = np.minimum(fore, back) * np.uint64(0x9E3779B97F4A7C15)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    least = np.lib.stride_tricks.sliding_window_view(hashes, k - m + 1).min(axis=1)
    unknown = np.concatenate([[0], np.cumsum(bases == ord("N"))])
    good = unknown[k : k + n] == unknown[:n]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = ~good[:-1] | (least[1:] != least[:-1])
    starts = np.flatnonzero(good & fresh)
    stops = np.flatnonzero(good & np.append(fresh[1:] | ~good[1:], True)) + 1
    for a, b, minimiser in zip(starts.tolist(), stops.tolist(), least[starts].view(np.int64).tolist(), strict=True):
        yield minimiser, a, text[a : b + k - 1]


def super_kmers(chunks: DataFrame, k: int, width: int = 1000, m: int | None = None) -> DataFrame:
    """(minimiser, chromosome, start, bases): all k-mers without N, runs of neighbours that share their minimiser in a row; upper case.

    ``m`` is 8 at most, by default half of k.
    """
    m = min(8, max(1, k // 2)) if m is None else m
    if not 0 < m <= min(k, 8):
        raise ValueError("minimisers have one base at least, and eight or the k-mer's length at most")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(x, c, at + a, s.decode("latin-1")) for c, at, text in zip(batch["chromosome"], batch["chunk_start"], batch["s"], strict=True) for x, a, s in cut_super_kmers(text.encode("latin-1"), k, m, width)]
            yield pd.DataFrame(out, columns=["minimiser", "chromosome", "start", "bases"])

    texts = with_margins(chunks, 0, k - 1, width).select(*KEY, F.upper(F.concat("seq", "tail")).alias("s")).where(F.length("s") >= k)
    return texts.mapInPandas(cut, "minimiser long, chromosome string, start long, bases string")


def unique_kmers(chunks: DataFrame, k: int, width: int = 1000, m: int | None = None) -> DataFrame:
    """(chromosome, position) of the k-mers that occur once in the genome, on either strand.

    Super-k-mers are shuffled, not k-mers: both strands of a k-mer have one
    minimiser, so its partition counts them all.
    """
    met = super_kmers(chunks, k, width, m).repartition("minimiser")
    rows = met.select("minimiser", "chromosome", "start", "bases", F.explode(F.sequence(F.lit(1), F.length("bases") - (k - 1))).alias("_i"))
    rows = rows.select("minimiser", "chromosome", (F.col("start") + F.col("_i") - 1).alias("start"), F.substring(F.col("bases"), F.col("_i"), F.lit(k)).alias("kmer"))
    canonical = F.least("kmer", reverse_complement(F.col("kmer")))
    once = rows.groupBy("minimiser", canonical.alias("c")).agg(F.count("*").alias("n"), F.min("chromosome").alias("chromosome"), F.min("start").alias("position"))
    return once.where("n = 1").select("chromosome", "position")
