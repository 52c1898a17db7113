"""K-mers by their minimisers and chromosome paths by blocks, against plain loops."""

import random
from collections import Counter

import pytest

from cytofold.operators import bias as bs
from cytofold.operators import evaluation as ev

PAIR = str.maketrans("ACGT", "TGCA")


@pytest.mark.parametrize(("k", "m", "width"), [(5, None, 7), (12, None, 50), (12, 1, 50), (9, 8, 40), (3, 3, 1000), (31, None, 64)])
def test_unique_kmers_equal_loops(spark, k, m, width):
    rng = random.Random(k)
    genome = {c: "".join(rng.choice("ACGTACGTN" if c == "1" else "ACG") for _ in range(n)) for c, n in (("1", 700), ("2", 301), ("3", 4))}
    genome["4"] = genome["1"][100:160] + genome["2"][40:90][::-1].translate(PAIR) + "AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAARYK" * 2
    chunks = spark.createDataFrame([(c, a, s[a : a + width]) for c, s in genome.items() for a in range(0, len(s), width)], "chromosome string, chunk_start long, seq string")
    places = [(c, i, s[i : i + k]) for c, s in genome.items() for i in range(len(s) - k + 1) if "N" not in s[i : i + k]]
    own = lambda x: min(x, x[::-1].translate(PAIR))
    counts = Counter(own(x) for _, _, x in places)
    got = sorted((r["chromosome"], r["position"]) for r in bs.unique_kmers(chunks, k, width, m).collect())
    assert got == sorted((c, i) for c, i, x in places if counts[own(x)] == 1)
    supers = bs.super_kmers(chunks, k, width, m).collect()
    assert sorted((r["chromosome"], r["start"] + i, r["bases"][i : i + k]) for r in supers for i in range(len(r["bases"]) - k + 1)) == sorted(places)
    if k == 31:
        assert sum(len(r["bases"]) for r in supers) < 6 * sum(map(len, genome.values()))


def test_kmers_are_shuffled_once(spark):
    chunks = spark.createDataFrame([("1", 0, "ACGTTGCA" * 9)], "chromosome string, chunk_start long, seq string")
    plan = bs.unique_kmers(chunks, 12)._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("MapInPandas")]
    assert after.count("Exchange") == 1 and "hashpartitioning(minimiser" in after


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_paths_whatever_the_block(spark, block):
    rng = random.Random(5)
    paths = {(clone, chain): sorted(rng.sample(range(60), n)) for clone, chain, n in ((1, "a", 1), (1, "b", 25), (2, "a", 13))}
    rows = [(clone, chain, o, rng.randrange(6), rng.choice([-1, 1])) for (clone, chain), ords in paths.items() for o in ords]
    path = spark.createDataFrame(rows, "clone long, chain string, ord long, segment long, orient int").repartition(4)
    wild = spark.createDataFrame([(k, k + 1) for k in range(5)], "left long, right long")
    expected = Counter()
    for key in paths:
        mine = [r for r in rows if r[:2] == key]
        for (*_, n1, o1), (*_, n2, o2) in zip(mine, mine[1:] + mine[:1], strict=True):
            a, b = sorted([(n1, int(o1 > 0)), (n2, int(o2 <= 0))])
            if not (a[1] == 1 and b == (a[0] + 1, 0) and a[0] < 5):
                expected[key[0], *a, *b] += 1
    assert {tuple(r)[:5]: r["copies"] for r in ev.path_breakpoints(path, wild, block).collect()} == expected
    pieces = {k: "".join(rng.choice("ACGT") for _ in range(3)) for k in range(6)}
    got = ev.path_sequences(path, spark.createDataFrame(list(pieces.items()), "segment long, seq string"), 4, block).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["part"]):
        assert len(r["sequence"]) <= 12
        found[r["clone"], r["chain"]] = found.get((r["clone"], r["chain"]), "") + r["sequence"]
    assert found == {key: "".join(pieces[s] if o > 0 else pieces[s][::-1].translate(PAIR) for c, h, _, s, o in rows if (c, h) == key) for key in paths}
