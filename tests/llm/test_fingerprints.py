"""Document fingerprints against plain strings."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytofold.llm.fingerprints import HEAD, PRIME, Texts, document_fingerprints, likeness, longest_common_extension, prefix_arrays, spans_equal, text_places

SCHEMA = "doc_id long, text string"


def marks(*texts, **options):
    return Texts.of([t.encode() for t in texts]).fingerprints(**options)


def words(seed, n, vocabulary=3000):
    rng = np.random.default_rng(seed)
    return " ".join(f"wörd{x}" for x in rng.integers(0, vocabulary, n))


def test_prefix_arrays_are_polynomials():
    from cytofold.llm.fingerprints import BASES

    codes = np.array([ord(c) for c in "añ𝄞" * 40], dtype=np.uint32)
    for got, base in zip(prefix_arrays(codes), BASES, strict=True):
        value, power, expected = 0, 1, [0]
        for c in codes.tolist():
            value, power = (value + (c + 1) * power) % PRIME, power * base % PRIME
            expected.append(value)
        assert got.tolist() == expected


def test_spans_and_extensions():
    rng = np.random.default_rng(3)
    a, b = ("".join(rng.choice(list("ab"), 300)) for _ in range(2))
    x, y = text_places(a), text_places(b)
    for i, j in rng.integers(0, 300, (200, 2)).tolist():
        same = 0
        while i + same < 300 and j + same < 300 and a[i + same] == b[j + same]:
            same += 1
        assert longest_common_extension(x, i, y, j) == same
        if same and i + same < 300 and j + same < 300:
            assert spans_equal(x, i, y, j, same) and not spans_equal(x, i, y, j, same + 1)


def test_equal_texts_and_only_they_have_equal_fingerprints():
    texts = [words(k, n) for k in range(30) for n in (1, 2, 20, 400)] + ["", "a", "b", "aa", "ab", "ba", "x" * 999, "x" * 1000]
    got = marks(*texts)
    assert len(set(got)) == len(set(texts)) and marks(*texts[::-1])[::-1] == got
    assert all(HEAD.unpack_from(m)[0] == len(t) for m, t in zip(got, texts, strict=True))
    assert max(map(len, marks(words(1, 30_000), "x" * 100_000))) <= HEAD.size + 16 * 8 + 16 * 13


@pytest.mark.parametrize("n", [40, 300, 2000, 30_000])
def test_likeness_follows_what_texts_share(n):
    a, other = words(1, n), words(2, n)
    middle, place = len(a) // 2, 2 * len(a) // 3
    edits = {
        "replaced": a[:middle] + "#" + a[middle + 1 :], "inserted": a[:place] + " one more word " + a[place:], "cut": a[: len(a) - len(a) // 4] + other[: len(a) // 4], "moved": a[middle:] + a[:middle],
    }
    found = {k: likeness(*marks(a, t)) for k, t in edits.items()}
    assert found["replaced"] > 0.8 and found["inserted"] > 0.6 and 0.6 < found["cut"] < 0.76 and found["moved"] > 0.55, found
    assert likeness(*marks(a, other)) < 0.1 and likeness(*marks(a, a)) == 1 and likeness(*marks(a, "")) == 0
    assert likeness(*marks(a, edits["cut"])) == pytest.approx(likeness(*marks(edits["cut"], a)), abs=0.15)


def test_likeness_of_repetitive_texts():
    assert likeness(*marks("a" * 5000, "a" * 3750 + words(1, 200))) > 0.5
    assert likeness(*marks("one line again\n" * 400, "one line again\n" * 300 + words(1, 150))) > 0.5


ROWS = [
    (5, "a text of some words that goes on for a while, " * 5), (2, "ünï𝄞cödé " * 30), (9, None), (7, ""), (None, "no id at all, but a text"), (None, None), (2, "ünï𝄞cödé " * 30), (3, "abc"), (4, "abcd"),
    (11, "y" * 200_000), (12, words(1, 20_000)), (12, "another text with that id"), (-4, "the first one of all"),
]


def plain(rows, tie):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, tie[r[1] or ""]))
    texts = [t or "" for _, t in rows]
    out = []
    for k, (i, _) in enumerate(rows):
        t, after = texts[k], texts[(k + 1) % len(rows)]
        n = len(t)
        new = t[: n - n // 4] + after[: n // 4]
        a, b, c = marks(t, new, after)
        out.append((i, n, hashlib.sha256(new.encode()).hexdigest(), a.hex(), b.hex(), likeness(a, b), likeness(a, c)))
    return sorted(map(str, out))


@pytest.mark.parametrize("parts", [1, 3])
def test_documents_equal_plain_version(spark, parts):
    names = ("n_chars", "tie", "last", "part", "head", "fingerprint", "text_key")
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("z") for c in names}).repartition(parts)
    tie = {r["t"]: r["h"] for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).collect()}
    assert sorted(map(str, map(tuple, document_fingerprints(docs).collect()))) == plain(ROWS, tie)


def test_few_rows(spark):
    assert document_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    (row,) = document_fingerprints(spark.createDataFrame([(1, "abcdefgh")], SCHEMA)).collect()
    assert (row["n_chars"], row["edited_sha256"], row["near_next"]) == (8, hashlib.sha256(b"abcdefab").hexdigest(), 1.0)
    odd = spark.createDataFrame([(1, "abc def " * 9)], SCHEMA).select(F.col("doc_id").alias("the.id"), F.col("text").alias("the.text"))
    assert document_fingerprints(odd, "the.id", "the.text").count() == 1


def test_next_documents_across_many_ranges(spark):
    rows = [(k, f"text number {k} " * (k % 7)) for k in range(2000)]
    got = document_fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert sorted(map(str, map(tuple, got))) == plain(rows, {t: 0 for _, t in rows})
