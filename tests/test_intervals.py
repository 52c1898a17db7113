"""Range operators against naive loops, on coordinates small enough to hit bounds."""

import random

import pytest
from pyspark.sql import functions as F

from cytofold.operators import evaluation as ev
from cytofold.operators import intervals as iv
from cytofold.operators import segments as sg

SEG = "chromosome string, segment_idx long, start long, `end` long"
FRAG = "chromosome string, i long, start long, `end` long"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(2014)
    cuts = sorted(rng.sample(range(200), 24))
    segments = [("1", k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if k % 5 != 3]
    segments = [("1", k, a, b) for k, (_, _, a, b) in enumerate(segments)]
    fragments = [("1", i, s, s + rng.randrange(0, 12)) for i, s in enumerate(rng.randrange(0, 200) for _ in range(600))]
    return segments, fragments


def test_golden_boundaries(spark):
    segments = spark.createDataFrame([("1", 0, 0, 10), ("1", 1, 10, 20)], SEG)
    fragments = spark.createDataFrame([("1", i, a, b) for i, (a, b) in enumerate([(0, 10), (2, 5), (10, 15), (5, 12), (10, 10), (20, 20)])], FRAG)
    counts = {r["start"]: r["readcount"] for r in iv.contained_counts(segments, fragments, []).collect()}
    assert counts == {0: 3, 10: 1}
    found = {r["i"]: r["segment_idx"] for r in iv.find_contained_segments(segments, fragments).collect()}
    assert [found[i] for i in range(6)] == [0, 0, 1, -1, -1, 1]


@pytest.mark.parametrize("width", [7, 1000])
def test_range_joins_equal_loops(spark, data, width):
    segments, fragments = data
    s, f = spark.createDataFrame(segments, SEG), spark.createDataFrame(fragments, FRAG)
    prev = {k: (segments[k - 1][3] if k else None) for k in range(len(segments))}
    expected = {k: sum(1 for _, _, a, b in fragments if a >= x and b <= y and (prev[k] is None or a > prev[k])) for _, k, x, y in segments}
    assert {r["segment_idx"]: r["readcount"] for r in iv.contained_counts(s, f, [], width).collect()} == expected
    points = f.selectExpr("chromosome", "i", "start as position")
    at = {i: next((k for _, k, x, y in segments if x <= a < y), -1) for _, i, a, _ in fragments}
    assert {r["i"]: r["segment_idx"] for r in iv.find_contained_positions(s, points, width).collect()} == at
    pairs = {(k, i) for _, k, x, y in segments for _, i, a, _ in fragments if x <= a < y}
    assert {(r["segment_idx"], r["i"]) for r in iv.interval_position_overlap(s, points, width).collect()} == pairs
    inner = {k: sum(1 for _, _, a, _ in fragments if x < a < y) for _, k, x, y in segments}
    assert {r["segment_idx"]: r["n"] for r in iv.overlapping_counts(s, points, width).collect()} == inner


def test_groups_outside_all_segments_count_zero(spark):
    segments = spark.createDataFrame([("1", 0, 0, 10), ("1", 1, 10, 20), ("2", 2, 0, 90_000)], SEG)
    intervals = spark.createDataFrame([("a", "1", 2, 5), ("a", "1", 3, 5), ("a", "2", 9, 80_000), ("b", "1", 50, 60), ("b", "3", 0, 4)], "sample_id string, chromosome string, start long, `end` long")
    got = {(r["sample_id"], r["segment_idx"]): r["readcount"] for r in iv.contained_counts(segments, intervals, ["sample_id"]).collect()}
    assert got == {("a", 0): 2, ("a", 1): 0, ("a", 2): 1, ("b", 0): 0, ("b", 1): 0, ("b", 2): 0}
    assert iv.contained_counts(segments, intervals.limit(0), ["sample_id"]).count() == 0


def test_reindex_golden(spark):
    schema = "chromosome string, idx long, start long, `end` long"
    a = spark.createDataFrame([("1", 0, 10, 20), ("1", 1, 20, 30), ("1", 2, 30, 40)], schema)
    b = spark.createDataFrame([("1", 0, 0, 5), ("1", 1, 5, 25), ("1", 2, 25, 27), ("1", 3, 27, 28), ("1", 4, 28, 45)], schema)
    rows = sorted((r["start"], r["end"], r["idx_1"], r["idx_2"]) for r in sg.reindex_segments(a, b, ["chromosome"]).collect())
    assert rows == [(10, 20, 0, 1), (20, 25, 1, 1), (25, 27, 1, 2), (27, 28, 1, 3), (28, 30, 1, 4), (30, 40, 2, 4)]


def test_reindex_meets_bounds_once(spark):
    schema = "chromosome string, idx long, start long, `end` long, v string"
    a = spark.createDataFrame([("1", 0, 0, 10, "x"), ("1", 1, 10, 30, "y"), (None, 2, 0, 10, "z"), ("2", 3, 5, 5, "w")], schema)
    b = spark.createDataFrame([("1", 7, 5, 20, "p"), ("2", 8, 0, 9, "q")], schema).withColumnRenamed("v", "u")
    got = sg.reindex_segments(a, b, ["chromosome"], (["v"], ["u"]))
    assert sorted(map(tuple, got.collect())) == [("1", 5, 10, 0, "x", 7, "p"), ("1", 10, 20, 1, "y", 7, "p")]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    over = a.union(spark.createDataFrame([("1", 4, 8, 12, "o")], schema))
    rows = sorted((r["start"], r["end"], r["idx_1"], r["idx_2"]) for r in sg.reindex_segments(over, b, ["chromosome"]).collect())
    assert rows == [(5, 8, 0, 7), (8, 10, 0, 7), (8, 10, 4, 7), (10, 12, 1, 7), (10, 12, 4, 7), (12, 20, 1, 7)]


def test_segmentations_meet_in_partitions_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(sg, "SEGMENTS", 1000, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = spark.range(3000).selectExpr("cast(id div 3 as string) as chromosome", "id as idx", "id % 3 * 7 as start", "id % 3 * 7 + 7 as `end`")
        two = one.selectExpr("chromosome", "idx", "start + 2 as start", "`end` + 2 as `end`")
        got = sg.reindex_segments(one, two, ["chromosome"])
        assert len(got.inputFiles()) == 6  # one for each partition that met
        assert got.count() == 5000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def odd_segments(rng, kind, group):
    """Segments with gaps between them; ``kind`` adds one that overlaps, has no length, swapped bounds or half of them, or a null key."""
    cuts = sorted(rng.sample(range(60), rng.choice((2, 4, 7))))
    rows = [(a, b) for a, b in zip(cuts, cuts[1:]) if rng.random() < 0.8]
    a, b = sorted(rng.sample(range(60), 2))
    rows += {"overlap": [(a, b)], "point": [(a, a)], "swapped": [(b, a)], "half": [(None, b) if a % 2 else (a, None)], "none": [(None, None)]}.get(kind, [])
    return [(None if kind == "key" else group, i, x, y, rng.random() < 0.5) for i, (x, y) in enumerate(rows)]


def test_odd_segmentations_meet_as_by_enumeration(spark):
    rng = random.Random(8)
    kinds = ("", "", "overlap", "point", "swapped", "half", "none", "key")
    sides = [[r for g in range(120) for r in odd_segments(rng, rng.choice(kinds), f"c{g}")] for _ in range(2)]
    groups = [{}, {}]
    for side, group in zip(sides, groups):
        for c, *row in side:
            group.setdefault(c, []).append(row)
    expected, flags = [], {}
    for c in groups[0].keys() & groups[1].keys() - {None}:
        x, y = groups[0][c], groups[1][c]
        cuts = sorted({p for _, *ab, _ in x + y for p in ab if p is not None})
        for a, b in zip(cuts, cuts[1:]):
            over = [[r for r in s if None not in r[1:3] and r[1] <= a and b <= r[2]] for s in (x, y)]
            for i, *_, u in over[0]:
                for j, *_, v in over[1]:
                    expected.append((c, a, b, i, u, j, v))
                    n = flags.setdefault(c, [0, 0])
                    n[0] += (b - a) * (u == v)
                    n[1] += b - a
    schema = "chromosome string, idx long, start long, `end` long, {} boolean"
    one, two = (spark.createDataFrame(r, schema.format(n)) for r, n in zip(sides, "uv"))
    assert sorted(map(tuple, sg.reindex_segments(one, two, ["chromosome"], (["u"], ["v"])).collect())) == sorted(expected)
    truth = one.withColumn("sample_id", F.col("chromosome")).withColumnsRenamed({"idx": "k", "u": "is_outlier"})
    pred = two.withColumn("sample_id", F.col("chromosome")).withColumn("p_outlier", F.col("v").cast("double")).withColumnRenamed("idx", "k")
    got = {r["sample_id"]: r["correct_outlier_proportion"] for r in ev.evaluate_outliers(truth, pred, ["sample_id"]).collect()}
    assert got == {c: n / total for c, (n, total) in flags.items()}


def test_empty_inputs(spark):
    s, f = spark.createDataFrame([], SEG), spark.createDataFrame([], FRAG)
    assert iv.contained_counts(s, f, []).count() == 0
    assert sg.wild_type_adjacencies(s).count() == 0


def test_ranges(spark):
    rows = spark.createDataFrame([(1, 0), (3, 2), (4, 3), (6, 0)], "start long, length long")
    assert sorted(r["value"] for r in iv.vrange(rows).collect()) == [3, 4, 4, 5, 6]


def test_short_intervals_are_looked_up_once(spark):
    rng = random.Random(3)
    spans = [(k, "1", s, s + rng.randint(0, 40)) for k, s in enumerate(rng.randint(0, 500) for _ in range(200))]
    points = [("1", p) for p in sorted(rng.sample(range(560), 60))]
    intervals = spark.createDataFrame(spans, "k long, chromosome string, start long, `end` long")
    positions = spark.createDataFrame(points, "chromosome string, position long")
    expected = sorted((k, p) for k, _, a, b in spans for _, p in points if a <= p < b)
    for options in ({"width": 30}, {"width": 30, "longest": 40}, {"width": 7, "longest": 40}):
        assert sorted((r["k"], r["position"]) for r in iv.interval_position_overlap(intervals, positions, **options).collect()) == expected


def test_long_intervals_are_dealt_to_few_bins(spark):
    rng = random.Random(7)
    size = 3_000_000
    intervals = [("1", 0, 0, size), ("1", 1, 17, size - 5), ("2", 2, 5, 6)] + [("1", 10 + k, s, s + rng.choice([1, 3, 40, 700, 9_000, 100_000])) for k, s in enumerate(rng.randrange(size) for _ in range(300))]
    points = [("1", k, rng.randrange(-5, size + 5)) for k in range(400)] + [("2", 900, 5), ("3", 901, 5), ("1", 902, size), ("1", 903, 0)]
    s, p = spark.createDataFrame(intervals, SEG), spark.createDataFrame(points, "chromosome string, i long, position long")
    width = 10
    dealt = iv.deal(s, F.col("start"), F.col("end") - 1, width)
    assert dealt.groupBy("segment_idx").count().agg(F.max("count")).first()[0] <= 2 and dealt.select("_level").distinct().count() > 4
    pairs = sorted((k, i) for c, k, a, b in intervals for d, i, x in points if c == d and a <= x < b)
    assert sorted((r["segment_idx"], r["i"]) for r in iv.interval_position_overlap(s, p, width).collect()) == pairs
    held = {i for _, i in pairs}
    rows = sorted((r["i"], r["segment_idx"]) for r in iv.find_contained_positions(s, p, width).collect())
    assert rows == sorted([(i, k) for k, i in pairs] + [(i, -1) for _, i, _ in points if i not in held])
    assert iv.find_contained_positions(s.where("false"), p, width).where("segment_idx = -1").count() == len(points)


def test_segments_of_many_lengths_equal_loops(spark):
    rng = random.Random(9)
    cuts = sorted({0, 1, 3, 10, 500, 501, 9_000, 9_001, 250_000, 250_007, 900_000})
    segments = [("1", k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    fragments = [("1", i, s, s + rng.randrange(0, 6)) for i, s in enumerate(rng.choice(cuts) + rng.randrange(-4, 5) for _ in range(500))]
    s, f = spark.createDataFrame(segments, SEG), spark.createDataFrame(fragments, FRAG)
    bounds = [(k, a, b, segments[k - 1][3] if k else None, segments[k + 1][2] if k + 1 < len(segments) else None) for _, k, a, b in segments]
    counted = {k: sum(1 for _, _, x, y in fragments if x >= a and y <= b and (before is None or x > before)) for k, a, b, before, _ in bounds}
    inside = {i: next((k for k, a, b, before, after in bounds if a <= x and (after is None or x < after) and y <= b and (before is None or y > before)), -1) for _, i, x, y in fragments}
    for width in (2, 50, 10_000):
        assert {r["segment_idx"]: r["readcount"] for r in iv.contained_counts(s, f, [], width).collect()} == counted
        assert {r["i"]: r["segment_idx"] for r in iv.find_contained_segments(s, f, width).collect()} == inside


@pytest.mark.parametrize("chunk", [1, 2, 7, 1000])
def test_runs_whatever_the_chunk(spark, chunk):
    rng = random.Random(11)
    rows = [(c, p, rng.choice("aab"), rng.randrange(2)) for c in "12" for p in range(120) if rng.random() < 0.9] + [("3", 6, "a", 0)]
    table = spark.createDataFrame(rows, "chromosome string, position long, v string, u int")
    places = sorted((c, v, p) for c, p, v, _ in rows)
    islands = [(c, v, p) for c, v, p in places if (c, v, p - 1) not in set(places)]
    ends = [(c, v, p + 1) for c, v, p in places if (c, v, p + 1) not in set(places)]
    expected = [(c, v, a, b) for (c, v, a), (_, _, b) in zip(islands, ends, strict=True)]
    assert sorted((r["chromosome"], r["v"], r["start"], r["end"]) for r in sg.position_runs(table, "v", chunk).collect()) == expected
    runs = []
    for c, p, v, u in sorted(rows):
        if runs and runs[-1][:3] == [c, v, u]:
            runs[-1][4] = p
        else:
            runs.append([c, v, u, p, p])
    got = [[r["chromosome"], r["v"], r["u"], r["start"], r["end"]] for r in sg.value_runs(table, ["v", "u"], chunk).collect()]
    assert sorted(got) == sorted(runs)


def test_many_short_segments_share_no_bin(spark):
    bounds = [*range(0, 3000), 3000, 9000]
    segments = [("1", k, a, b) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
    s = spark.createDataFrame(segments, "chromosome string, segment_idx long, start long, end long")
    dealt, width = iv.deal_cells(s, F.col("start"), F.col("end"), None)
    assert dealt.groupBy("_bin").count().agg(F.max("count")).first()[0] <= width + 2 and dealt.count() <= 3 * len(segments)
    f = spark.createDataFrame([("1", i, p, p + 1 + i % 2 * 40) for i, p in enumerate(range(0, 9100, 7))], "chromosome string, i long, start long, end long")
    at = lambda p: next((k for _, k, a, b in segments if a <= p < b), -1)
    rows = {r["i"]: (r["start"], r["end"]) for r in f.collect()}
    points = f.select("chromosome", "i", F.col("start").alias("position"))
    assert {r["i"]: r["segment_idx"] for r in iv.find_contained_positions(s, points).collect()} == {i: at(p) for i, (p, _) in rows.items()}
    inside = {i: at(p) if at(p) >= 0 and q <= segments[at(p)][3] else -1 for i, (p, q) in rows.items()}
    assert {r["i"]: r["segment_idx"] for r in iv.find_contained_segments(s, f).collect()} == inside
    assert sum(r["n"] for r in iv.overlapping_counts(s, points).collect()) == sum(any(a < p < b for _, _, a, b in segments) for p, _ in rows.values())
