"""Kernel densities against the plain formula."""

import os

import numpy as np
import pytest

from cytofold import plans
from cytofold.operators import depth as dp

SF = "/root/testdata/sf0.001"
SCHEMA = "g string, minor double, total double, w long"


def plain(values, weights, xs):
    """As a weighted Gaussian kernel estimate has it: every row at every point."""
    mean = np.average(values, weights=weights)
    spread = np.average((values - mean) ** 2, weights=weights) / (1 - (weights**2).sum() / weights.sum() ** 2)
    bw = 0.05 * np.sqrt(spread)
    kernels = np.exp(-0.5 * ((xs[:, None] - values) / bw) ** 2) / (bw * np.sqrt(2 * np.pi))
    return np.pad((kernels * weights).sum(axis=1) / weights.sum(), 1)


@pytest.mark.parametrize("chunk", [20_000, 30])
def test_curves_equal_the_formula(spark, monkeypatch, chunk):
    monkeypatch.setattr(dp, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    sizes = {"a": 200, "b": 3, "c": 40, "wide": 30}
    rows = [(g, float(m), float(m + t), int(w)) for g, n in sizes.items() for m, t, w in zip(rng.normal(1, 0.2, n), rng.gamma(2.0, 1.0 if g != "wide" else 1e-3, n), rng.integers(0, 9, n) + (g == "b"), strict=True)]
    rows += rows[:20] + [("one", 1.0, 2.0, 5), ("same", 3.0, 1.0, 2), ("same", 3.0, 2.0, 2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # so that groups go on in further batches
    try:
        found = dp.density(spark.createDataFrame(rows, SCHEMA).repartition(5), ["g"], ["minor", "total"], "w", "total", 50, 0.05).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in ("a", "b", "c", "wide"):
        mine = np.array([r[1:] for r in rows if r[0] == g])
        order = mine[np.argsort(mine[:, 1])]
        top = order[np.searchsorted(np.cumsum(order[:, 2]), 0.95 * order[:, 2].sum()), 1]
        got = sorted((r for r in found if r["g"] == g), key=lambda r: r["i"])
        assert [r["i"] for r in got] == list(range(52))
        xs = np.linspace(0, top, 50)
        assert [r["x"] for r in got] == pytest.approx([0, *xs, top])
        for k, c in enumerate(("minor", "total")):
            assert [r[c] for r in got] == pytest.approx(plain(mine[:, k], mine[:, 2], xs), rel=1e-9, abs=1e-300)
    assert {r["minor"] for r in found if r["g"] == "same"} == {None} and None not in {r["total"] for r in found if r["g"] == "same"}
    assert {(r["minor"], r["total"]) for r in found if r["g"] == "one"} == {(None, None)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_the_query_has_all_points_of_three_depths(spark):
    found = plans.all_queries()["density_curves"](spark, SF).where("sample_id = 'c7'").orderBy("i").collect()
    assert [r["i"] for r in found] == list(range(2002)) and found[0]["x"] == found[1]["x"] == 0 and found[2000]["x"] == found[2001]["x"]
    assert all(found[k][c] == 0 for k in (0, 2001) for c in ("minor", "major", "total")) and found[2000]["total"] > 0
