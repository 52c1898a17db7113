"""Training-data operators against brute force, and on nulls, empty and odd inputs."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cytofold.llm.arrays import MIX, blocks, mix, word_hashes
from cytofold.llm.exact_dedup import drop_copies, exact_dedup
from cytofold.llm.language_id import BUCKETS, NAMES, Words, identify, viterbi, word_scores
from cytofold.llm.language_model import lm_scores
from cytofold.llm.line_dedup import drop_lines, line_dedup
from cytofold.llm.mixing import draw_mix, mix_sources
from cytofold.llm.near_dedup import drop_near_copies, near_dedup
from cytofold.llm.packing import Plan, pack
from cytofold.llm.quality_classifier import quality_scores
from cytofold.llm.quality_rules import keep_good, quality_rules
from cytofold.llm.token_files import read_token_files, round_trip, write_token_files
from cytofold.llm.tokens import default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_like(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def docs(spark):
    base = [words_like(k, 60) for k in range(12)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(base)]
    rows += [(20 + k, t.replace(" ", "\t\n", 1), "en", "s0", 0) for k, t in enumerate(base[:4])]  # equal up to white space
    rows += [(40 + k, t + f" extra{k}", "en", "s1", 0) for k, t in enumerate(base[:6])]  # near copies
    rows += [(60, None, None, None, None), (61, "", "en", "s2", 0), (62, " \t\n", "fr", None, 3), (63, "one two", "en", "s2", 7), (63, "one two", "en", "s2", 7), (None, "one two", "en", "s2", 7), (64, "x" * 30_000, "en", "s2", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for result in (quality_rules(empty), exact_dedup(empty), mix_sources(empty), near_dedup(empty), line_dedup(empty), pack(empty), round_trip(empty), identify(empty), lm_scores(empty), quality_scores(empty, labels)):
        assert result.count() == 0


def test_clashing_columns(docs):
    odd = docs.withColumns({c: F.lit("x") for c in ("key", "row", "first", "kept", "node", "band", "size", "part", "sequence_id", "skey", "at", "line")})
    for result in (quality_rules(odd), exact_dedup(odd), mix_sources(odd), near_dedup(odd), line_dedup(odd)):
        assert result.count() == docs.count()
    for kept in (keep_good(odd), drop_copies(odd), drop_near_copies(odd), draw_mix(odd), drop_lines(odd)):
        assert kept.columns == odd.columns


NULLS = [(None, None), (None, None), (7, None), (8, ""), (8, ""), (9, "same words here " * 4), (9, "same words here " * 4), (10, "y" * 200_000), (11, "long text of words " * 20_000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeated rows, an unbroken and a very long text, and columns named like those of the operators."""
    table = spark.createDataFrame(NULLS, "doc_id long, text string")
    names = ("lang", "source", "key", "row", "part", "pos", "label", "score", "ids", "n_tokens", "start", "part_start", "piece", "length", "context", "word", "held_out", "lang_pred", "x", "n", "value")
    return table.withColumns({c: F.lit(None).cast("string") if c in ("lang", "source") else F.lit("z") for c in names})


@pytest.mark.parametrize("operator", [quality_rules, exact_dedup, mix_sources, near_dedup, line_dedup, round_trip, identify, lm_scores])
def test_odd_tables_give_a_row_for_each_row(odd, operator):
    got = operator(odd).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(k) for k, _ in NULLS)


def test_odd_tables_scored_and_packed(odd, spark):
    labels = spark.createDataFrame([(None, None, None), (9, 1, 0), (9, 1, 0), (10, 0, 0), (10, None, 1)], "doc_id long, quality int, toxic int").withColumn("score", F.lit("z"))
    assert quality_scores(odd, labels).count() == len(NULLS)
    pieces = pack(odd).collect()
    assert {str(r["doc_id"]) for r in pieces} == {str(k) for k, _ in NULLS} and max(r["length"] for r in pieces) <= 2048
    assert sum(r["length"] for r in pieces if r["doc_id"] == 8) == 2  # an end for each of two empty texts


def test_quality_rules(docs, spark):
    texts = ["the of and to in a is that for it " * 3, "a b c d e f a b c d e x y z q", "# * $ |" * 4, None, "same\nsame\nother\n \nsame"]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        w = WORD.findall(text or "")
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_exact_dedup_any_number_of_counters(docs):
    rows = docs.select("doc_id", "text").collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    sizes = Counter(norm(r["text"]) for r in rows)
    for k in (1, 1024):
        got = exact_dedup(docs, k=k).collect()
        assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(sizes)
        assert sorted(r["group_size"] for r in got) == sorted(sizes[norm(r["text"])] for r in rows)
    assert drop_copies(docs).count() == len(sizes)


def test_mixing(docs):
    got = mix_sources(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs.repartition(5)).collect()))
    longest = max(r["size"] for r in got)
    for source in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == source]
        assert mine[0]["target"] <= 2 * mine[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 2 * longest
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert sum(r["target"] for r in {r["source"]: r for r in got}.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    assert draw_mix(docs).count() == sum(r["copies"] for r in got)


def brute_classes(rows):
    sets = []
    for r in rows:
        w = WORD.findall((r["text"] or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    own = list(range(len(rows)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                own[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[root(i)] = min(least.get(root(i), r["doc_id"]), r["doc_id"])
    return sorted((str(r["doc_id"]), len(sets[i]), str(least.get(root(i)))) for i, r in enumerate(rows))


def test_near_dedup_equals_brute_force(docs, spark):
    rng = np.random.default_rng(1)
    seed = words_like(99, 80).split()
    rows = []
    for k in range(60):  # a chain of edits, so that links are spread over a class
        seed[rng.integers(0, 80)] = f"new{k}"
        rows.append((1000 + k, " ".join(seed)))
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = near_dedup(more).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_classes(more.collect())


def test_line_dedup(spark):
    rows = [(1, "alpha beta\ngamma delta\nalpha beta"), (2, "alpha betas\ngamma  delta!\n\nunrelated text"), (3, None), (4, "alpha beta\nunrelated texts\nab"), (5, "ba\nunrelated text"), (None, "fresh\ngamma delta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["dropped"]) for r in line_dedup(docs).collect()}
    assert got == {1: (3, [2]), 2: (3, [0]), 3: (0, []), 4: (3, [0, 1]), 5: (2, [1]), None: (2, [1])}
    assert {r["doc_id"]: r["text"] for r in drop_lines(docs).collect()}[4] == "ab"
    assert {r["doc_id"]: r["dropped"] for r in line_dedup(docs, edits=0).collect()}[4] == [0]


def within_one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


@pytest.mark.parametrize("letters, longest", [("ab", 9), ("abc", 7)])
def test_line_dedup_against_brute_force_on_repeated_letters(spark, letters, longest):
    rng = np.random.default_rng(len(letters))
    lines = ["".join(rng.choice(list(letters), rng.integers(1, longest + 1))) for _ in range(60)] + ["page 100", "page 101", "letter", "letfer"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"] for r in line_dedup(docs).collect() if r["n_dropped"]}
    assert got == {k for k, line in enumerate(lines) if any(within_one_edit(line, x) for x in lines[:k])}
    assert {61, 63} <= got


def test_plan_is_gapless_and_near_the_bound():
    rng = np.random.default_rng(4)
    counts = np.bincount(rng.integers(1, 2049, 5000), minlength=2049)
    plan = Plan(counts, 2048)
    placed = sorted((s + i, offset, length) for length, _, n, s, offset in plan.runs for i in range(n))
    assert len(placed) == 5000 and Counter(x[2] for x in placed) == Counter({k: int(n) for k, n in enumerate(counts) if n})
    end = {}
    for s, offset, length in placed:
        assert offset == end.get(s, 0)
        end[s] = offset + length
    assert max(end.values()) <= 2048 and len(end) <= 1.05 * (counts * np.arange(2049)).sum() / 2048


def test_tokens_packed_and_written(docs, spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_path())
    texts = ["Don't stop!! it's 3.14€ — “q” é,̸ Å", "a<|endoftext|>b c", None, "x y z İ ½ ٣٤ 中文,字", "long " * 3000]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    ids = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
    path = f"file://{tmp_path}/tokens"
    write_token_files(table, path)
    back = {r["doc_id"]: r for r in read_token_files(spark, path).collect()}
    start = 0
    for k in range(len(texts)):
        assert back[k]["ids"] == [*ids[k], 2] and back[k]["start"] == start
        start += len(ids[k]) + 1
    digests = {r["doc_id"]: r["ids_crc32"] for r in round_trip(table).collect()}
    assert digests == {k: zlib.crc32(np.array([*ids[k], 2], dtype="<u4").tobytes()) for k in ids}
    pieces = pack(table).collect()
    for k in ids:
        whole = np.array([*ids[k], 0], dtype="<u4")
        mine = sorted((r for r in pieces if r["doc_id"] == k), key=lambda r: r["piece"])
        assert sum(r["length"] for r in mine) == len(whole)
        assert all(r["ids_crc32"] == zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)


def test_language_spans(spark):
    en, fr = "the house and the garden of the king were with them ", "les maisons et des jardins du roi sont dans une rue "
    rows = [(k, (en if k % 2 else fr) * 3, "en" if k % 2 else "fr") for k in range(60)]
    rows += [(100, None, "en"), (101, "12 34 !!", "en"), (102, en * 4 + fr * 4, None)]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k]["lang_pred"] == ("en" if k % 2 else "fr") for k in range(60))
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und"
    assert [s["lang"] for s in got[102]["spans"]] == ["en", "fr"]


def test_scores_by_slices_equal_scores_at_once():
    rng = np.random.default_rng(3)
    texts = ["", "a bc " * 40, "x" * 50 + " y", "..."]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    words = Words(data, np.cumsum([0, *map(len, texts)]))
    log, barred = rng.normal(size=(2 * BUCKETS, 3)).astype(np.float32), np.zeros((len(NAMES), 3), np.float32)
    once = word_scores(words, log, barred)
    assert len(once) == 82
    assert np.allclose(once[0], log[words.grams[:1]].sum(axis=0) + log[BUCKETS + words.words[0]])
    for most in (1, 2, 3, 7, 49, 60):
        assert np.array_equal(word_scores(words, log, barred, most), once)


def test_viterbi_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    rows = np.repeat([0, 1, 2], [5, 1, 4])
    scores = rng.normal(size=(10, 3))
    got = viterbi(scores, rows, 0.7)
    for t in range(3):
        mine = scores[rows == t]
        best = max(itertools.product(range(3), repeat=len(mine)), key=lambda p: sum(mine[i, x] for i, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:])))
        assert tuple(got[rows == t]) == best


def test_lm_scores(spark):
    texts = [words_like(k, 40, 30) for k in range(80)] + [None, "", "Unseen words only"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scores(docs).collect()}
    tokens = {k: [*WORD.findall((t or "").lower()), None] for k, t in enumerate(texts)}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in tokens}
    counts = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for k, ws in tokens.items():
        base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"], got[k]["held_out"]) == (len(ws), sum(counts[w] > 0 for w in ws), n, held[k])
        assert got[k]["base_score"] == pytest.approx(base)
        assert got[k]["score"] < 0


def test_lm_contexts_keep_apart(spark):
    """Words that share a context when contexts are hashed to 16 bits: what follows one says nothing about the other."""
    names = [f"w{k}" for k in range(3000)]
    (_, data, offsets), = blocks(pa.array(names))
    at = (mix(word_hashes(data, offsets)[0] + MIX[200]) % np.uint64(65535)).tolist()
    seen = {}
    a, b = next((names[seen[x]], names[k]) for k, x in enumerate(at) if seen.setdefault(x, k) != k)
    c = next(n for n in names if n not in (a, b))
    held = [k for k in range(5000) if zlib.crc32(str(k).encode()) % 10 == 0][:3]
    rows = [(10_000 + k, f"{x} {y}") for k, (x, y) in enumerate([(a, "left"), (b, "right"), (c, "left")] * 40)] + list(zip(held, [f"{a} right", f"{b} right", f"{c} right"], strict=True))
    got = {r["doc_id"]: r["score"] for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()}
    first, second, third = (got[k] for k in held)
    assert first == pytest.approx(third, abs=0.3) and second > first + 1


def test_quality_classifier(spark):
    rng = np.random.default_rng(2)
    good = [words_like(k, int(rng.integers(30, 90))) + "." for k in range(120)]
    bad = [" ".join(f"W{x}!!" for x in rng.integers(0, 5, int(rng.integers(20, 60)))) for _ in range(120)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)] + [(999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 120), 0) for k in range(240)] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_scores(docs, labels).collect()}
    held = [k for k in range(240) if got[k]["held_out"]]
    assert len(held) > 20 and np.mean([got[k]["predicted"] == int(k < 120) for k in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["score"] == 0.5 for r in quality_scores(docs, labels.where("quality = 1")).collect())


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        after = stage(spark, docs, sf).cache()
        assert after.columns == docs.columns and (name == "mixing" or after.count() <= before)
        docs = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
