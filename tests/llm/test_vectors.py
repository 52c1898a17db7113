"""Vector codes and whitening against plain versions."""

import hashlib
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cytofold.llm.queries import ORACLE_SQL, QUERIES
from cytofold.llm.vector_codes import Cells, vector_codes
from cytofold.llm.whitening import components, exact_products, polar_factor, squared_deviations, whitened_components

SCHEMA = "vec_id long, embedding array<float>, label int"
SF = "/root/testdata/sf0.01"


def vectors(seed, n, width=32, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(int(k), (rng.standard_normal(width) * spread).astype(np.float32).tolist(), int(rng.integers(0, 3)) if rng.random() < 0.8 else None) for k in rng.permutation(n)]


ODD = [(1000, None, 1), (1001, [float("nan")] * 32, 1), (1002, [float("inf")] + [0.0] * 31, None), (1003, [None] + [0.5] * 31, 2), (1004, [], 1), (1005, [1.0] * 16, 1), (None, [0.25] * 32, None), (None, [0.25] * 32, None), (7, [0.5] * 32, 1), (7, [0.5] * 32, 1)]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] and len(r[1]) == 32 and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(256 * c) for c in r[1]] for r in kept])
    cut = np.stack(np.split(x, parts, axis=1))
    books = cut[:, :entries].copy()

    def assign():
        apart = ((cut[:, :, None, :] - books[:, None, :, :]) ** 2).sum(axis=3)
        return apart.argmin(axis=2), apart.min(axis=2)

    for _ in range(rounds):
        index, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = cut[p][index[p] == e]
                if len(mine):
                    books[p, e] = mine.sum(axis=0) // len(mine)
    index, apart = assign()
    error, sha = apart.sum(axis=0).tolist(), hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
    by_label = {}
    for r, e in zip(kept, error, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted(str((r[0], "".join(f"{i:02x}" for i in index[:, k]), error[k], by_label[r[2]], sha)) for k, r in enumerate(kept))


@pytest.mark.parametrize("seed, n, spread, bits", [(1, 400, 0.2, 4), (2, 300, 5.0, 2), (3, 20, 1.0, 6), (4, 300, 1e-3, 4)])
def test_codes_equal_plain_version(spark, seed, n, spread, bits):
    rows = vectors(seed, n, spread=spread) + ODD
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("z") for c in ("n", "code", "error", "key", "_id")}).repartition(3)
    assert sorted(map(str, map(tuple, vector_codes(docs, cell_bits=bits).collect()))) == plain_codes(rows)


def test_cells_find_the_first_of_the_nearest_entries():
    rng = np.random.default_rng(5)
    entries = rng.integers(-40, 40, (64, 3))
    entries[40:] = entries[:24]  # ties
    cells = Cells(entries, cell_bits=3, most=500)
    for _ in range(4):
        points = rng.integers(-60, 60, (3000, 3))
        index, apart = cells.nearest(points)
        every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (apart == every.min(axis=1)).all()
        assert len(cells.keys) <= 500
    assert cells.evaluated < 0.4 * 4 * 3000 * 64


def test_cells_that_share_a_hash_are_told_apart(monkeypatch):
    import cytofold.llm.vector_codes as vc

    monkeypatch.setattr(vc, "mix", lambda x: x & np.uint64(3))
    rng = np.random.default_rng(6)
    entries, points = rng.integers(-99, 99, (20, 2)), rng.integers(-99, 99, (500, 2))
    index, _ = Cells(entries, cell_bits=2).nearest(points)
    assert (index == ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_codes_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = QUERIES["op12_vector_codes"](spark, SF)
    columns = ", ".join(got.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.execute(f"select {columns} from ({ORACLE_SQL['op12_vector_codes']})").fetchall()))


def test_no_vectors(spark):
    for rows in ([], ODD[:5]):
        table = spark.createDataFrame(rows, SCHEMA)
        assert vector_codes(table).count() == 0 and whitened_components(table).count() == 0
    one = spark.createDataFrame([(3, [0.5] * 32, None)], SCHEMA)
    assert [r["error"] for r in vector_codes(one).collect()] == [0] and whitened_components(one).count() == 0
    huge = spark.createDataFrame([(1, [3e38] * 32, 1), (2, [-3e38] * 32, 1), (3, [1.0] + [2.0] * 31, 2)], SCHEMA)
    assert vector_codes(huge).count() == 3
    assert {r["vec_id"]: r["deviation"] for r in whitened_components(huge).collect()} == {1: None, 2: None, 3: 2048**2 + 31 * 4096**2}


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_components_of_matrices(n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((3 * n, n))
    for a in (x.T @ x, (x * 10.0 ** -np.arange(n).clip(0, 12)).T @ x, np.eye(n) * 3, np.diag([7.0] + [1.0] * (n - 1)), np.ones((n, n)), np.zeros((n, n)), x[: n // 2 + 1].T @ x[: n // 2 + 1]):
        a = (a + a.T) / 2
        values, columns = components(a)
        norm = max(np.linalg.norm(a), 1e-300)
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * norm
        assert np.linalg.norm(a @ columns - columns * values) <= 1e-13 * norm and np.linalg.norm(columns.T @ columns - np.eye(n)) < 1e-12


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((9, 9)))
    values = np.array([5, 3, 1e-8, -1e-8, -2, 4, -7, 1, -1])
    assert np.linalg.norm(polar_factor(q * values @ q.T) - q * np.sign(values) @ q.T) < 1e-6


def test_exact_sums():
    rng = np.random.default_rng(2)
    for top in (100, 1 << 25, 1 << 40):
        y = rng.integers(-top, top, (50, 4))
        assert (exact_products(y) == y.astype(object).T @ y.astype(object)).all()
    y = rng.integers(-(1 << 20), 1 << 20, (9, 4))
    rest = rng.integers(-500, 500, 4)
    plain = [sum((10**k * int(v) - int(r)) ** 2 for v, r in zip(row, rest, strict=True)) for k in (3, 15) for row in y]
    assert squared_deviations(y, rest, 1000) + squared_deviations(y, rest, 10**15) == [v if v < 1 << 63 else None for v in plain]


@pytest.mark.parametrize("parts", [1, 4])
def test_whitening_equals_plain_version(spark, parts):
    rng = np.random.default_rng(8)
    mixing = rng.standard_normal((32, 32)) * 0.6 ** np.arange(32)
    rows = [(k, (np.array(v) @ mixing.T * 0.1).astype(np.float32).tolist(), label) for k, v, label in vectors(3, 500)] + ODD
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("z") for c in ("n", "at", "component", "whitened")}).repartition(parts)
    got = whitened_components(docs).collect()
    kept = [r for r in rows if r[1] and len(r[1]) == 32 and all(x is not None and math.isfinite(x) for x in r[1])]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in r[1]] for r in kept], dtype=np.float64)
    n = len(x)
    centred = x - x.mean(axis=0)
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    values, columns = values[::-1], columns[:, ::-1]
    deviation = [int(((n * row - x.sum(axis=0)).astype(np.int64) ** 2).sum()) for row in x]
    expected = centred @ columns[:, :8] / np.sqrt(values[:8])
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    assert sorted(str((r["vec_id"], r["deviation"])) for r in got if r["component"] == 1) == sorted(str((r[0], d)) for r, d in zip(kept, deviation, strict=True))
    for c in range(8):
        mine = {r["vec_id"]: r for r in got if r["component"] == c + 1 and r["vec_id"] not in (None, 7)}
        where = [k for k, r in enumerate(kept) if r[0] in mine]
        found = np.array([mine[kept[k][0]]["whitened"] for k in where])
        sign = np.sign(found @ expected[where, c])
        assert np.abs(found - sign * expected[where, c]).max() < 1e-8
        assert {r["explained"] for r in mine.values()} == {mine[kept[where[0]][0]]["explained"]} and mine[kept[where[0]][0]]["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
