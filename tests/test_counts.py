"""Counts of fragments by block and allele."""

import pytest

from cytofold.operators import counts as ct


@pytest.fixture()
def tables(spark):
    segments = spark.createDataFrame([(0, "1", 0, 100), (1, "1", 100, 200)], "segment_idx long, chromosome string, start long, end long")
    alleles = spark.createDataFrame([("a", "1", 7, 12, 0), ("a", "1", 7, 10, 1), ("b", "1", 8, 120, 0), ("b", "1", 9, 10, 0)], "sample_id string, chromosome string, fragment_id long, position long, is_alt int")
    haplotypes = spark.createDataFrame([("1", p, a, p // 100, 1 - a) for p in (10, 12, 120) for a in (0, 1)], "chromosome string, position long, allele int, hap_label long, allele_id int")
    fragments = spark.createDataFrame([("a", "1", 7, 5, 20), ("a", "1", 7, 5, 30), ("b", "1", 8, 110, 130)], "sample_id string, chromosome string, fragment_id long, start long, end long")
    return segments, alleles, haplotypes, fragments


def test_a_fragment_counts_once(spark, tables):
    rows = ct.allele_read_counts(*tables).select("sample_id", "chromosome", "start", "end", "hap_label", "allele_id", "readcount")
    assert sorted(map(tuple, rows.collect())) == [("a", "1", 0, 100, 0, 0, 1), ("b", "1", 100, 200, 1, 1, 1)]


def test_fragments_are_sorted_once_by_id_first(spark, tables):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ct.allele_read_counts(*tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sorts = [line.split("Sort [", 1)[1] for line in plan.splitlines() if " Sort [" in line and "fragment_id" in line]
    assert len(sorts) == 2 and all(s.startswith("fragment_id") for s in sorts)
