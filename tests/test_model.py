import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytofold.functions import likelihood as lk
from cytofold.functions.likelihood import log_gamma
from cytofold.operators import decoding as dc
from cytofold.operators import depth as dp
from cytofold.operators import haplotypes as hp
from cytofold.operators import model as md
from cytofold.operators import segments as sg


def test_log_gamma(spark):
    xs = [1e-3, 0.3, 1.0, 2.5, 17.0, 1234.5, 1e6]
    got = [r["y"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(log_gamma(F.col("x")).alias("y")).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], abs=1e-8, rel=1e-10)


def enumerated(scores, steps):
    """The best path (ties to the first states from the end backwards) and the posteriors, from all paths."""
    n, k = scores.shape
    paths = list(itertools.product(range(k), repeat=n))
    value = np.array([sum(scores[i, s] for i, s in enumerate(p)) + sum(steps[i][p[i - 1], p[i]] for i in range(1, n)) for p in paths])
    best = min((p for p, v in zip(paths, value, strict=True) if v >= value.max() - 1e-9), key=lambda p: p[::-1])
    weight = np.exp(value - value.max()) / np.exp(value - value.max()).sum()
    return best, np.array([[weight[[p[i] == s for p in paths]].sum() for s in range(k)] for i in range(n)])


def test_path_and_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    scores, transition = rng.normal(size=(4, 5)), -rng.random((5, 5))
    best, expected = enumerated(scores, [transition] * 4)
    assert tuple(dc.best_path(scores, transition)) == best
    assert dc.marginals(scores, [transition] * 4) == pytest.approx(expected)


@pytest.mark.parametrize("algebra", [dc.BEST, dc.SUM])
def test_chunk_products_equal_steps(algebra):
    rng = np.random.default_rng(4)
    for spread, high in ((1.0, 1.0), (50.0, 3.0), (3000.0, 40.0), (1.0, 2000.0)):
        scores, steps = rng.normal(size=(30, 6)) * spread, [-high * rng.random((6, 6)) for _ in range(30)]
        for n in (1, 2, 7, 30):
            got = dc.chunk_product(scores[:n], steps[:n], algebra)
            whole = got[0][:, None] + got[1] if isinstance(got, tuple) else got
            for start in range(6):
                message = np.where(np.arange(6) == start, 0.0, -1e300)
                assert whole[start] == pytest.approx(dc.forward(scores[:n], steps[:n], message, algebra)[-1], rel=1e-9, abs=1e-9)
    assert isinstance(dc.chunk_product(rng.normal(size=(200, 6)) * 5, [-rng.random((6, 6))] * 200, algebra), tuple)


@pytest.mark.parametrize("chunk", [1, 2, 7, 100])
def test_chains_in_chunks_equal_enumeration(spark, chunk):
    rng = np.random.default_rng(5)
    matrices = np.stack([-np.round(4 * rng.random((3, 3))), -np.round(9 * rng.random((3, 3)))])  # whole numbers, so ties occur
    schema = "sample_id string, chain long, segment_idx long, step int, scores array<double>"
    rows, best, posterior = [], {}, {}
    for sample, first, n in (("a", 0, 9), ("a", 9, 1), ("a", 10, 8), ("b", 0, 2), ("b", 30, 9)):
        scores, step = np.round(rng.normal(size=(n, 3)) * 3), rng.integers(0, 2, n)
        rows += [(sample, first, first + k, int(step[k]), scores[k].tolist()) for k in range(n)]
        path, p = enumerated(scores, [matrices[s] for s in step])
        best |= {(sample, first + k): path[k] for k in range(n)}
        posterior |= {(sample, first + k, s): p[k, s] for k in range(n) for s in range(3)}
    arrays = spark.createDataFrame(rows, schema).repartition(5)
    got = dc.decode_chain(arrays, ["sample_id", "chain"], matrices, chunk).collect()
    assert {(r["sample_id"], r["segment_idx"]): r["state"] for r in got} == best
    got = dc.chain_posteriors(arrays, ["sample_id", "chain"], matrices, chunk).collect()
    assert {(r["sample_id"], r["segment_idx"], r["state"]): r["posterior"] for r in got} == pytest.approx(posterior)
    assert dc.Chains(arrays, ["sample_id", "chain"], matrices, chunk).chunks.where(F.size("items") > chunk).isEmpty()
    assert dc.decode_chain(arrays.where("false"), ["sample_id", "chain"], matrices, chunk).isEmpty()


def test_long_chain_in_chunks_equals_one_pass(spark):
    rng = np.random.default_rng(6)
    scores, matrix = rng.normal(size=(700, 12)) * 4, -3 * rng.random((12, 12))
    arrays = spark.createDataFrame([("s", 0, k, scores[k].tolist()) for k in range(700)], "sample_id string, chain long, segment_idx long, scores array<double>")
    got = {r["segment_idx"]: r["state"] for r in dc.decode_chain(arrays, ["sample_id", "chain"], matrix, 64).collect()}
    assert [got[k] for k in range(700)] == dc.best_path(scores, matrix).tolist()
    p = np.zeros((700, 12))
    for r in dc.chain_posteriors(arrays, ["sample_id", "chain"], matrix, 64).collect():
        p[r["segment_idx"], r["state"]] = r["posterior"]
    assert np.abs(p - dc.marginals(scores, [matrix] * 700)).max() < 1e-10


def test_split_terms_equal_whole_likelihoods(spark):
    x, mu, k, n, p, m = 31.0, 27.5, 4.0, 19.0, 0.3, 200.0
    row = spark.createDataFrame([(x, mu, k, n, p)], "x double, mu double, k double, n double, p double")
    got = row.select(lk.negbin(F.col("x"), F.col("mu"), F.lit(m)), lk.betabin(F.col("k"), F.col("n"), F.col("p"), F.lit(m))).first()
    g, q, a, b = math.lgamma, mu / (m + mu), m * p, m * (1 - p)
    assert got[0] == pytest.approx(g(x + m) - g(x + 1) - g(m) + x * math.log(q) + m * math.log(1 - q))
    assert got[1] == pytest.approx(g(n + 1) - g(k + 1) - g(n - k + 1) + g(k + a) + g(n - k + b) - g(n + m) + g(m) - g(a) - g(b))


def test_minor_modes_are_weighted_means_of_clusters(spark):
    rng = np.random.default_rng(8)
    samples = {"a": [0.1, 0.3, 0.5, 0.7, 0.9], "b": [1.0, 2.0, 4.0, 5.0, 7.0]}
    rows = []
    for name, centres in samples.items():
        for c in centres:
            rows += [(name, float(c + rng.normal(0, 0.005)), int(rng.integers(100, 900))) for _ in range(40)]
        rows += [(name, 50.0 + k, 50) for k in range(11)]  # above the 95th percentile
        rows += [(name, 0.2, 0)]  # without length
    found = dp.minor_modes(spark.createDataFrame(rows, "sample_id string, minor double, length long")).collect()
    for name, centres in samples.items():
        mine = [(v, w) for n, v, w in rows if n == name]
        cut = np.percentile([v for v, _ in mine], 95)
        expected = [np.average([v for v, _ in g], weights=[w for _, w in g]) for c in centres if (g := [x for x in mine if abs(x[0] - c) < 0.05 and x[0] < cut and x[1]])]
        assert sorted(r["centre"] for r in found if r["sample_id"] == name) == pytest.approx(expected)


def test_gradient_of_the_mixture_is_a_derivative(spark):
    rows = [("s", 0.02, 0.01, 0.02, 2, 3, 1, 5000.0, 300), ("s", 0.02, 0.01, 0.02, 2, 1, 1, 9000.0, 900)]
    names = ["sample_id", "h_0", "h_1", "h_2", "total_0", "total_1", "total_2", "length", "readcount"]
    got = md.depth_gradient(spark.createDataFrame(rows, names), ["sample_id"], family="mixture").first()

    def value(h):
        out = 0.0
        for _, *_, t0, t1, t2, length, x in rows:
            mu = (h[0] * t0 + h[1] * t1 + h[2] * t2) * length
            nb = lambda r: math.lgamma(x + r) - math.lgamma(x + 1) - math.lgamma(r) + x * math.log(mu / (r + mu)) + r * math.log(r / (r + mu))
            out += np.logaddexp(math.log(0.99) + nb(500.0), math.log(0.01) + nb(10.0))
        return out

    h = np.array([0.02, 0.01, 0.02])
    for m in range(3):
        step = np.zeros(3)
        step[m] = 1e-7
        assert got[f"grad_{m}"] == pytest.approx((value(h + step) - value(h - step)) / 2e-7, rel=1e-4)


def test_chain_of_segments_equals_ranges(spark):
    rows = [(0, "1", 0, 10), (1, "1", 10, 20), (2, "1", 500, 600), (3, "2", 0, 5), (4, "2", 6, 9)]
    table = spark.createDataFrame(rows, "segment_idx long, chromosome string, start long, `end` long")
    got = {r["segment_idx"]: r["chain"] for r in sg.chain_of_segments(table, 100).collect()}
    ranges = [(r["first"], r["last"]) for r in sg.chains(table, 100).collect()]
    assert got == {k: a for a, b in ranges for k in range(a, b)} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}


@pytest.mark.parametrize(("threshold", "labels"), [(0.95, [0, 1, 2, 2, 2, 0]), (0.55, [0] * 6)])
def test_haplotype_blocks_golden(spark, threshold, labels):
    draws = ["001110", "000110", "111001", "000110", "001110"]
    rows = [(n, "1", p, int(a), 1 - int(a)) for n, d in enumerate(draws) for p, a in enumerate(d)]
    table = spark.createDataFrame(rows, "sample_no int, chromosome string, position long, allele1 int, allele2 int")
    got = sorted((r["position"], r["hap_label"], r["allele1"]) for r in hp.haplotype_blocks(table, threshold).collect())
    assert [a for _, _, a in got] == [0, 0, 0, 1, 1, 0]
    if threshold == 0.55:
        assert [h for _, h, _ in got] == labels
    else:
        assert [h for _, h, _ in got][:5] == [0, 0, 1, 2, 2]


@pytest.mark.parametrize(("clones", "top", "apart"), [(1, 4, 1), (2, 3, 1), (2, 3, 2), (3, 2, 1)])
def test_states_of_any_clones_equal_enumeration(spark, clones, top, apart):
    classes = {}
    for cn in itertools.product(range(top + 1), repeat=2 * clones):
        pairs = [cn[2 * m : 2 * m + 2] for m in range(clones)]
        if all(sum(p) <= top for p in pairs) and all(max(p[a] for p in pairs) - min(p[a] for p in pairs) <= apart for a in (0, 1)):
            classes[frozenset([cn, tuple(x for p in pairs for x in p[::-1])])] = cn
    states = md.copy_states(spark, top, apart, clones)
    got = [tuple(r)[1:] for r in states.orderBy("state").collect()]
    assert got == sorted(classes.values())
    rows = spark.createDataFrame([(k, *cn) for k, c in enumerate(classes) for cn in c] + [(-1, *[top + 1] * (2 * clones))], ["k", *md.cn_columns(clones)])
    numbers = {}
    for r in md.number_states(rows, states).collect():
        numbers.setdefault(r["k"], set()).add(r["state"])
    assert numbers.pop(-1) == {None} and sorted(s for v in numbers.values() for s in v) == list(range(len(classes)))
    brk = [tuple(r)[1:] for r in md.breakpoint_states(spark, top, apart, clones).orderBy("brk_state").collect()]
    assert brk == [c for c in itertools.product(range(top + 1), repeat=clones) if max(c) - min(c) <= apart]
    cost = {(r["state_a"], r["state_b"]): r["cost"] for r in md.state_transition_costs(states).collect()}
    for (a, x), (b, y) in itertools.product(enumerate(got), repeat=2):
        total = sum(abs(x[2 * m] + x[2 * m + 1] - y[2 * m] - y[2 * m + 1]) for m in range(clones))
        ways = [sum(abs(x[2 * m + k] - y[2 * m + (k ^ flip)]) for m in range(clones) for k in (0, 1)) for flip in (0, 1)]
        assert cost[a, b] == total + min(ways) - total


@pytest.mark.parametrize("clones", [1, 2, 3])
def test_scores_and_paths_of_any_clones(spark, clones):
    h = (0.02, 0.02, 0.015, 0.005)[: clones + 1]
    states = md.copy_states(spark, 3, 1, clones)
    table = {r["state"]: tuple(r)[1:] for r in states.collect()}
    rng = np.random.default_rng(clones)
    true = [int(s) for s in rng.choice([s for s, cn in table.items() if sum(cn)], 6)]
    rows = []
    for k, s in enumerate(true):
        major, minor = (h[0] + sum(h[m + 1] * table[s][2 * m + a] for m in range(clones)) for a in (0, 1))
        rows.append(("s", 0, k, 1e6, round(1e6 * (major + minor)), round(3e5 * major), round(3e5 * minor)))
    segments = spark.createDataFrame(rows, ["sample_id", "chain", "segment_idx", "length", "readcount", "major_readcount", "minor_readcount"])
    scores = md.segment_state_scores(segments, states, h)
    one = {(r["segment_idx"], r["state"]): r["score"] for r in scores.collect()}
    assert len(one) == 6 * len(table)
    # A clone split in two equal ones of half the depth scores as before.
    twice = states.withColumns({f"{a}_{clones + 1}": F.col(f"{a}_{clones}") for a in ("major", "minor")})
    split = (*h[:-1], h[-1] / 2, h[-1] / 2)
    assert {(r["segment_idx"], r["state"]): r["score"] for r in md.segment_state_scores(segments, twice, split).collect()} == pytest.approx(one)
    arrays = md.state_arrays(scores, ["sample_id", "chain"])
    got = dc.decode_chain(arrays, ["sample_id", "chain"], -0.01 * md.cost_matrix(md.state_transition_costs(states)), 4).collect()
    assert len(got) == 6 and all(0 <= r["state"] < len(table) for r in got)
    rows = states.withColumns({"total_mask": F.lit(True), "allele_mask": F.lit(True), "length": F.lit(1e6), "readcount": F.lit(40_000), "major_readcount": F.lit(5_000), "minor_readcount": F.lit(5_000)})
    assert md.segment_loglik(rows, h).where("loglik is null or isnan(loglik)").isEmpty()


def test_segments_are_spread_before_their_product_with_states(spark):
    segments = spark.createDataFrame([(k, 100 + k, 3, 5, 1000) for k in range(40)], "segment_idx long, readcount long, minor_readcount long, major_readcount long, length long").coalesce(1)
    states = md.copy_states(spark, 3, 1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows in (md.segment_state_scores(segments, states, (0.02, 0.01, 0.02)), md.segment_state_likelihoods(segments, states, (0.02, 0.01, 0.02))):
        assert rows.rdd.getNumPartitions() == parts > 1
        assert rows.count() == 40 * states.count()
