"""Registered queries against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from cytofold import plans
from cytofold.plans.fixtures import STAR

SF = "/root/testdata/sf0.001"
NAMES = [
    "segment_allele_counts", "create_segments", "closest_segment_end", "breakpoint_segments", "match_breakpoints", "reindex_segments", "aggregate_adjacent", "snp_genotypes",
    "haplotype_blocks", "phase_segments", "betabin_uniform_loglik", "segment_state_scores", "select_best_solution", "init_grid", "evaluate_cn", "path_breakpoints",
    "log_gamma", "segment_map_state", "density_curves", "poisson_resample", "gc_lowess", "segment_bias",
    "minor_modes", "read_depth", "state_runs", "mappability_runs", "unique_kmer_hits", "breakpoint_states", "path_sequences", "interval_position_overlap", "decode_chain",
]


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return repr(float(value)) if isinstance(value, (int, float)) else str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in STAR:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = plans.all_queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in got.select(*columns).collect())
    expected = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({plans.all_oracles()[name]}) q").fetchall()
    assert rows == sorted(tuple(plain(v) for v in r) for r in expected)
