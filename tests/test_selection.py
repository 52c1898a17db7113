import itertools

import numpy as np
import pytest

from cytofold.operators.selection import best_cuts, exact_percentiles, weighted_clusters


@pytest.mark.parametrize("bins", [64, 4096])
def test_percentiles_equal_numpy(spark, bins):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=400), "b": np.repeat([1.0, 2.0, 2.5], 50), "c": np.array([7.0]), "d": np.concatenate([np.full(300, 3.0), rng.random(20) * 1e-12, [1e12, -1e12]]), "e": rng.integers(0, 5, 101).astype(float)}
    rows = [(k, float(v), float(v * v)) for k, vs in groups.items() for v in vs] + [("a", None, float("nan")), ("f", None, None)]
    table = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    for q in (0.1, 1.0):
        got = {r["g"]: (r["x"], r["y"]) for r in exact_percentiles(table, ["g"], ["x", "y"], q, bins).collect()}
        assert got == {k: pytest.approx((np.percentile(v, 100 * q), np.percentile(v * v, 100 * q)), rel=1e-12, abs=1e-13) for k, v in groups.items()}
    assert exact_percentiles(table.where("false"), ["g"], ["x"], 0.5).isEmpty()


def spread(points, weights, ranges):
    return sum(float((weights[a:b] * (points[a:b] - np.average(points[a:b], weights=weights[a:b])) ** 2).sum()) for a, b in ranges)


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    x, w = np.sort(rng.normal(size=11)), rng.integers(1, 9, 11).astype(float)
    k = 1 + seed % 5
    got = best_cuts(w, w * x, w * x * x, k)
    ways = [list(itertools.pairwise([0, *c, 11])) for c in itertools.combinations(range(1, 11), k - 1)]
    assert got[0][0] == 0 and got[-1][1] == 11 and len(got) == k
    assert spread(x, w, got) == pytest.approx(min(spread(x, w, r) for r in ways))


def test_clusters_whatever_the_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(s, float(c + rng.normal(0, 0.004)), int(rng.integers(1, 9))) for s in "ab" for c in (0.1, 0.4, 0.5, 0.9) for _ in range(60)] + [("a", 5.0, 0), ("c", 2.0, 3), ("c", 2.0, 1), ("d", None, 4)]
    table = spark.createDataFrame(rows, "s string, x double, w long")
    found = [sorted((r["s"], round(r["centre"], 9), r["weight"]) for r in weighted_clusters(table.repartition(n), ["s"], "x", "w", 4, 512).collect()) for n in (1, 6)]
    assert found[0] == found[1] and found[0][-1] == ("c", 2.0, 4.0) and len(found[0]) == 9
    for name in "ab":
        for c, (_, centre, weight) in zip((0.1, 0.4, 0.5, 0.9), [f for f in found[0] if f[0] == name], strict=True):
            mine = [(x, w) for s, x, w in rows if s == name and w and abs(x - c) < 0.05]
            assert centre == pytest.approx(np.average([x for x, _ in mine], weights=[w for _, w in mine]), abs=1e-8) and weight == sum(w for _, w in mine)
