"""Breakpoint matching against loops, with repeated ids, and what its join carries."""

import random

import pytest

from cytofold.operators import breakpoints as bp

SCHEMA = "prediction_id long, chromosome_1 string, strand_1 string, position_1 long, chromosome_2 string, strand_2 string, position_2 long"


def some(spark, rng, n, ids):
    end = lambda: (rng.choice("12"), rng.choice("+-"), rng.randrange(600))
    rows = [(rng.randrange(ids) if ids < n else i, *end(), *end()) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def matches(a, b, near):
    return [(s, t) for s in (0, 1) for t in (0, 1) if a[1 + 3 * s : 3 + 3 * s] == b[1 + 3 * t : 3 + 3 * t] and near(a[3 + 3 * s], b[3 + 3 * t])]


@pytest.mark.parametrize("ids", [90, 60])
def test_matching_equals_loops(spark, ids):
    rng = random.Random(ids)
    (one, a), (two, b) = some(spark, rng, 90, ids), some(spark, rng, 90, ids)
    found, best = {}, {}
    for x in one:
        for y in two:
            found.setdefault((x[0], y[0]), []).extend(matches(x, y, lambda p, q: p - 100 <= q < p + 100))
    expected = sorted(k for k, m in found.items() if len(m) == 2 and len({s for s, _ in m}) == 2 and len({t for _, t in m}) == 2)
    assert expected and sorted(tuple(r) for r in bp.match_breakpoints(a, b, 100).collect()) == expected
    ends = lambda rows, k: [(r[0], s, *r[1 + 3 * s : 4 + 3 * s]) for r in rows if r[0] == k for s in (0, 1)]
    for i in {x[0] for x in one}:
        for j in {y[0] for y in two}:
            near = [(e[1], f[1], abs(e[4] - f[4])) for e in ends(one, i) for f in ends(two, j) if e[2:4] == f[2:4] and abs(e[4] - f[4]) <= 80]
            pairs = [(d + g, j) for s, t, d in near if s == 0 for u, v, g in near if u == 1 and t != v]
            best[i] = min([*pairs, *([best[i]] if i in best else [])], default=None) or best.pop(i, None) or (float("inf"), None)
    got = {(r["prediction_id"], r["db_id"]) for r in bp.query_breakpoint_db(a, b, 80).collect()}
    assert got == {(i, v[1]) for i, v in best.items()}


def test_breakends_with_one_side_in_common_do_not_meet(spark):
    rows = [(i, "1", "+", 5, "2", "-", 10_000 * i) for i in range(60)]
    pairs = bp.paired_breakends(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows, SCHEMA), 50)
    assert pairs.count() == 60
