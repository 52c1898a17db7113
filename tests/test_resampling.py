"""Resampling against the Poisson distribution."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from cytofold.operators.resampling import levels_below, poisson_masses, poisson_resample, resample_depth_targets, uniform


@pytest.mark.parametrize("rate", [0.0, 1.0, 20.0, 900.0])
def test_masses_are_whole(spark, rate):
    masses = spark.createDataFrame([(rate,)], "rate double").select(poisson_masses(F.col("rate"))).first()[0]
    assert sum(masses) == pytest.approx(1, abs=1e-9) and masses[0] == pytest.approx(math.exp(-rate))
    assert sum(k * p for k, p in enumerate(masses)) == pytest.approx(rate)


def test_segments_have_their_rates(spark):
    rows = [("1", 10 * k, 10 * k + 5, k * 37) for k in range(4000)]
    fragments = spark.createDataFrame(rows, "chromosome string, start long, end long, fragment_id long")
    targets = spark.createDataFrame([("1", 0, 20_000, 0, 20.0), ("1", 0, 20_000, 1, 0.0), ("1", 20_000, 30_000, 0, 1.5), ("1", 30_000, 39_000, 1, 300.0)], "chromosome string, start long, end long, allele int, rate double")
    got = poisson_resample(fragments, targets).groupBy((F.col("start") >= 20_000).cast("int") + (F.col("start") >= 30_000).cast("int"), "allele").count().collect()
    found = {(r[0], r["allele"]): r["count"] for r in got}
    assert set(found) == {(0, 0), (1, 0), (2, 1)}
    for key, n, rate in (((0, 0), 2000, 20.0), ((1, 0), 1000, 1.5), ((2, 1), 900, 300.0)):
        assert found[key] / n == pytest.approx(rate, abs=5 * (rate / n) ** 0.5)
    ids = [r["fragment_id"] for r in poisson_resample(fragments, targets, scale=0.1).collect()]
    assert sorted(ids) == list(range(len(ids)))


def test_depths_add_up_over_genomes(spark):
    copies = spark.createDataFrame([("1", 0, 9, 0, 0)] * 2 + [("1", 0, 9, 1, 0), ("1", 0, 9, 0, 1), ("2", 0, 5, 1, 1)], "chromosome string, start long, end long, allele int, genome int")
    depths = spark.createDataFrame([(0, 0.1), (1, 0.25)], "genome int, haploid_depth double")
    got = {(r["chromosome"], r["allele"]): r["read_depth"] for r in resample_depth_targets(copies, depths).collect()}
    assert got == pytest.approx({("1", 0): 0.45, ("1", 1): 0.1, ("2", 1): 0.25})


def test_uniforms_have_53_bits_and_their_tail(spark):
    few = spark.range(2000).select((F.col("id") * 1_000_003).alias("id"), F.lit(1).alias("allele"))
    got = {r["id"]: r["u"] for r in few.withColumn("u", uniform(17, F.col("id"), F.col("allele"))).collect()}
    assert len(set(got.values())) == 2000  # ids that agree modulo a million and three draw apart
    assert all(u == (int(hashlib.md5(f"17|{k}|1".encode()).hexdigest()[:14], 16) >> 3) / 2**53 for k, u in got.items())
    assert any((u * 2**53) % 2 for u in got.values())
    many = spark.range(4_000_000).withColumn("u", uniform(5, F.col("id")))
    row = many.agg(F.avg("u"), F.var_pop("u"), F.count_if(F.col("u") > 1 - 4e-6), F.count_if(F.col("u") < 4e-6), F.min("u"), F.max("u")).first()
    assert row[0] == pytest.approx(0.5, abs=1e-3) and row[1] == pytest.approx(1 / 12, abs=1e-3)
    assert 4 <= row[2] <= 34 and 4 <= row[3] <= 34 and 0 <= row[4] and row[5] < 1


def test_a_uniform_is_worked_out_once(spark, capsys):
    rows = spark.range(5).select("id", F.array(*(F.lit(k / 10) for k in range(10))).alias("levels")).withColumn("u", uniform(17, F.col("id")))
    found = rows.select("u", levels_below(F.col("u"), "levels").alias("n"))
    assert all(r["n"] == math.ceil(r["u"] * 10) for r in found.collect())
    spark.range(5).select("id", F.array(*(F.col("id") / k for k in range(1, 9))).alias("levels")).repartition(2).withColumn("u", uniform(17, F.col("id"))).select(levels_below(F.col("u"), "levels")).explain()
    plan = capsys.readouterr().out
    assert plan.count("md5") == 1 and plan.index("md5") < plan.index("lambdafunction")  # not in the comparison with a level


def test_ids_follow_start_id_and_allele(spark):
    """By hand: segments of rate 0 count as neighbours, starts in several bins, several fragments at a start."""
    cut = {"1": [0, 9_000, 9_100, 25_000, 61_000], "2": [0, 40_000]}
    rates = lambda c, k, a: [2.5, 0.0, 1.0, 4.0][(k + 2 * a + int(c)) % 4]
    targets = [(c, s, e, a, rates(c, k, a)) for c, at in cut.items() for k, (s, e) in enumerate(zip(at, at[1:])) for a in (0, 1)]
    fragments = [(c, start, start + size, 7919 * n % 1009 + 1009 * n) for c in cut for n, (start, size) in enumerate((s, z) for s in [0, 8_990, 9_000, 9_050, 9_100, 9_999, 10_000, 24_950, 25_000, 39_990, 60_000] for z in (10, 40, 50))]
    got = poisson_resample(spark.createDataFrame(fragments, "chromosome string, start long, end long, fragment_id long"), spark.createDataFrame(targets, "chromosome string, start long, end long, allele int, rate double"))
    expected = []
    for c, at in cut.items():
        drawn = []
        for fc, start, end, i in fragments:
            held = [k for k, (s, e) in enumerate(zip(at, at[1:])) if fc == c and s <= start < e and end <= e]
            for k, a in ((k, a) for k in held for a in (0, 1)):
                u, rate, n, upto = (int(hashlib.md5(f"17|{i}|{a}".encode()).hexdigest()[:14], 16) >> 3) / 2**53, rates(c, k, a), 0, 0.0
                while u > (upto := upto + math.exp(-rate) * rate**n / math.factorial(n)):
                    n += 1
                drawn += [(start, i, a, end)] * n
        expected += [(c, start, end, a, k) for k, (start, i, a, end) in enumerate(sorted(drawn))]
    assert len(expected) > 100 and sorted(map(tuple, got.select("chromosome", "start", "end", "allele", "fragment_id").collect())) == sorted(expected)
