"""Queries on tables whose keys are beyond those of the smaller ones."""

import os

import pytest
from pyspark.sql import functions as F

from cytofold import plans
from cytofold.plans.fixtures import STAR, Tables
from cytofold.sources import seqio

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
SHIFT = 9_000_000


@pytest.fixture(scope="module")
def shifted(spark, tmp_path_factory):
    """The smallest tables with orders from 9 million on, whose fragments have ids beyond 63 bits."""
    out = tmp_path_factory.mktemp("shifted")
    for t in STAR:
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        keys = [c for c in ("o_orderkey", "l_orderkey") if c in rows.columns]
        rows.withColumns({c: F.col(c) + SHIFT for c in keys}).write.parquet(f"{out}/{t}.parquet")
    return str(out)


def ids(rows):
    of = lambda r: (((r["l_orderkey"] * 1_000_000 + r["l_partkey"]) * 10_000 + r["l_suppkey"]) * 10 + r["l_linenumber"]) * 100 + int(r["l_quantity"])
    return sorted(of(r) for r in rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").collect())


def test_ids_of_fragments_beyond_63_bits(spark, shifted):
    small, large = Tables(spark, SF), Tables(spark, shifted)
    assert dict(small.fragments.dtypes)["fragment_id"] == "bigint"
    expected = ids(large.lineitem)
    assert expected[-1] >= 2**63
    assert sorted(int(r["fragment_id"]) for r in large.fragments.select("fragment_id").collect()) == expected
    names = [r["name"] for r in plans.all_queries()["concordant_alignment_filter"](spark, shifted).where("is_first = 1").collect()]
    assert sorted(names) == sorted(f"r{i}" for i in expected if i % 13 != 0)


@pytest.mark.parametrize("name", ["allele_calls", "allele_read_counts", "gc_probability", "gc_window_counts", "vrange", "merge_overlapping_seqdata", "weighted_sample", "find_contained_segments"])
def test_queries_on_ids_beyond_63_bits(spark, shifted, name):
    assert plans.all_queries()[name](spark, shifted).count() > 0


def test_customers_are_spread_by_their_number(spark, tmp_path):
    spark.range(12_000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    profiles = Tables(spark, str(tmp_path)).cn_profiles
    assert profiles.rdd.getNumPartitions() == 3
    assert profiles.select("c_custkey").distinct().count() == 12_000


def test_results_of_tables_that_solutions_share(spark, tmp_path):
    solutions = spark.createDataFrame([(1, 7, 0.1, 0.2, 0.3), (2, 9, 0.1, 0.2, 0.3)], "sample_id int, init_id long, h_0 double, h_1 double, h_2 double")
    cn = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13)], "sample_id int, start long")
    brk = spark.createDataFrame([(1, 7, 5), (1, 8, 6)], "sample_id int, init_id long, cn_1 int")
    seqio.write_results(solutions, cn, brk, str(tmp_path))
    shared = seqio.read_tsv(spark, f"{tmp_path}/cn", "sample_id int, init_id long, start long").collect()
    assert sorted(map(tuple, shared)) == [(1, 7, 10), (1, 7, 11), (2, 9, 12)]
    assert [tuple(r) for r in seqio.read_tsv(spark, f"{tmp_path}/brk_cn", "sample_id int, init_id long, cn_1 int").collect()] == [(1, 7, 5)]


@pytest.mark.parametrize("name", ["concordant_alignment_filter", "drop_nonfinite", "find_contained_positions", "fragment_snp_calls", "gap_anti_join", "gc_binned_counts"])
def test_rows_on_ids_beyond_63_bits(spark, shifted, name):
    """The rows of the SQL, whose ids are taken as 128-bit numbers here."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in STAR:
        con.execute(f"create view {t} as select * from '{shifted}/{t}.parquet/*.parquet'")
    text = lambda rows: sorted(tuple(f"{v:.4f}" if isinstance(v, float) else str(v) for v in row) for row in rows)
    found = plans.all_queries()[name](spark, shifted)
    expected = con.execute(plans.all_oracles()[name].replace("l_orderkey * 1000000 ", "l_orderkey::hugeint * 1000000 "))
    columns = [d[0] for d in expected.description]
    assert text(found.select(*columns).collect()) == text(expected.fetchall())
