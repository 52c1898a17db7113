import math

import pytest

from cytofold.operators import bias as bs


def test_segment_bias_equals_loops(spark):
    n, offset, read = 150, 2, 10
    sequence = "".join("GCAT"[(k * k + k // 7) % 4] for k in range(n))
    chunks = spark.createDataFrame([("1", k, sequence[k : k + 50]) for k in range(0, n, 50)], "chromosome string, chunk_start long, seq string")
    track = spark.createDataFrame([("1", 0, 60, 5), ("1", 60, 70, 0), ("1", 70, n, 9)], "chromosome string, start long, `end` long, quality int")
    chromosomes = spark.createDataFrame([("1", 0, n)], "chromosome string, chromosome_idx int, length long")
    segments = spark.createDataFrame([(0, "1", 0, 80), (1, "1", 80, n)], "segment_idx long, chromosome string, start long, `end` long")
    curve = spark.createDataFrame([(b, 1 - abs(b - 45) / 100) for b in range(101)], "gc_bin int, smoothed double")
    cumsum = bs.gc_cumsum(chunks)
    got = {r["segment_idx"]: r["bias"] for r in bs.segment_bias(segments, chunks, track, chromosomes, curve, 30.0, 5.0, offset, read, step=5, width=50).collect()}

    running, total = [], 0
    for c in sequence:
        total += c in "GC"
        running.append(total)
    assert [r["gc"] for r in cumsum.orderBy("pos").collect()] == running
    ok = [0 if 60 <= p < 70 else 1 for p in range(n)]
    for k, (start, end) in enumerate([(0, 80), (80, n)]):
        bias = 0.0
        for length in range(int(30 - 2.3263478740 * 5 - 1), int(30 + 2.3263478740 * 5 + 1) + 1, 5):
            width = length - 2 * offset
            if length < read:
                continue
            share = sum(1 - abs(b - 45) / 100 for b in range(101))
            weights = [(1 - abs(min(int(c / width * 100), 100) - 45) / 100) / share for c in range(width + 1)]
            density = math.exp(-0.5 * ((length - 30) / 5) ** 2) / (5 * math.sqrt(2 * math.pi))
            for p in range(start, end - length):
                count = running[p + length - offset] - running[p + offset]
                bias += density * weights[count] * ok[p] * ok[p + length - read]
        assert got[k] == pytest.approx(bias)


def test_kmers_cross_chunks(spark):
    chunks = spark.createDataFrame([("1", 0, "ACGTN"), ("1", 5, "ACGTT")], "chromosome string, chunk_start long, seq string")
    assert sorted((r["start"], r["kmer"]) for r in bs.kmers(chunks, 3, 5).collect()) == [(0, "ACG"), (1, "CGT"), (5, "ACG"), (6, "CGT"), (7, "GTT")]


def test_windows_and_running_counts_cross_chunks(spark):
    sequence = "".join("GCATTAGC"[(k * k + k // 3) % 8] for k in range(95))
    chunks = spark.createDataFrame([("1", k, sequence[k : k + 20]) for k in range(0, 95, 20)], "chromosome string, chunk_start long, seq string")
    is_gc = [c in "GC" for c in sequence]
    assert {r["pos"]: r["gc"] for r in bs.gc_cumsum(chunks).collect()} == {p: sum(is_gc[: p + 1]) for p in range(95)}
    got = {r["pos"]: r["gc"] for r in bs.gc_window_counts(chunks, 17, 2, 20).collect()}
    assert got == {p: sum(is_gc[max(0, p - 12) : p + 1]) for p in range(95)}
