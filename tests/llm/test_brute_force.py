"""Language spans, quality scores, token files and pipeline stages against plain versions of their definitions."""

import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cytofold.llm.arrays import MIX, blocks, mix
from cytofold.llm.language_id import BUCKETS, NAMES, SCRIPT_OF, SMOOTH, SWITCH, identify
from cytofold.llm.mixing import mix_sources
from cytofold.llm.packing import pack
from cytofold.llm.quality_classifier import quality_scores, statistics
from cytofold.llm.queries import ORACLE_SQL
from cytofold.llm.token_files import SCHEMA, write_token_files

SF = "/root/testdata/sf0.001"
U = np.uint64


def fold_of(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def plain_words(text):
    """(start, end, [letter trigram buckets], word bucket, script) of each run of letters and their marks."""
    points, out, at = [ord(c) for c in text], [], 0
    inside = []
    for i, c in enumerate(text):
        inside.append(c.isalpha() or unicodedata.category(c).startswith("M") and i > 0 and inside[-1])
    low = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in text]
    while at < len(points):
        if not inside[at]:
            at += 1
            continue
        end = at
        while end < len(points) and inside[end]:
            end += 1
        codes = []
        for i in range(at, end):
            before, after = (low[i - 1] if i > at else 0), (low[i + 1] if i + 1 < end else 0)
            codes.append(mix(np.array([(before << 42) | (low[i] << 21) | after], dtype=U)))
        whole = sum((c * MIX[100 + min(k, 60)] for k, c in enumerate(codes)), np.zeros(1, U))
        out.append((at, end, [int(c[0] % U(BUCKETS)) for c in codes], int(mix(whole)[0] % U(BUCKETS)), int(SCRIPT_OF[min(low[at], 0xFFFF)])))
        at = end
    return out


def plain_identify(rows):
    grams, words, scripts = (defaultdict(Counter) for _ in range(3))
    for doc_id, text, lang in rows:
        if fold_of(doc_id, 4) != 2 and lang is not None and text is not None:
            for _, _, g, w, s in plain_words(text):
                grams[lang].update(g)
                words[lang][w] += 1
                scripts[lang][s] += 1
    langs = sorted(grams)
    log = lambda table, lang, b: np.log((table[lang][b] + SMOOTH) / (sum(table[lang].values()) + SMOOTH * BUCKETS))
    seen = {(s, lang): scripts[lang][s] >= max(1, 0.001 * sum(scripts[lang].values())) for s in range(len(NAMES)) for lang in langs}
    out = {}
    for doc_id, text, _ in rows:
        found = plain_words(text or "")
        if not found:
            out[doc_id] = ("und", 0.0)
            continue
        best, back = None, []
        for _, _, g, w, s in found:
            any_seen = any(seen[s, x] for x in langs)
            score = [sum(log(grams, x, b) for b in g) + log(words, x, w) - (0 if seen[s, x] or not any_seen else 1e4) for x in langs]
            if best is None:
                best = score
                continue
            top = max(range(len(langs)), key=lambda k: best[k])
            steps = [top if best[top] - SWITCH > best[k] else k for k in range(len(langs))]
            back.append(steps)
            best = [max(best[k], best[top] - SWITCH) + score[k] for k in range(len(langs))]
        path = [max(range(len(langs)), key=lambda k: best[k])]
        for steps in reversed(back):
            path.append(steps[path[-1]])
        letters = Counter()
        for (a, b, *_), k in zip(found, reversed(path), strict=True):
            letters[k] += b - a
        winner = max(sorted(letters), key=lambda k: letters[k])
        out[doc_id] = (langs[winner], letters[winner] / sum(letters.values()))
    return out


def test_languages_equal_a_plain_version(spark):
    rng = np.random.default_rng(11)
    stock = {"en": "the house and garden of king were with them".split(), "fr": "les maisons et jardins du roi étaient dans une rue".split(), "hi": "नमस्ते दुनिया यह किताब बहुत अच्छी है हिन्दी".split(), "ru": "дом и сад короля были большими".split()}
    rows = []
    for k in range(80):
        lang = sorted(stock)[k % 4]
        rows.append((k, " ".join(rng.choice(stock[lang], rng.integers(1, 12))), lang))
    rows += [(200 + k, " ".join(rng.choice(stock["en"], 6)) + ". " + " ".join(rng.choice(stock[o], 7)), None) for k, o in enumerate(("fr", "hi", "ru"))]
    rows += [(300, None, "en"), (301, "12 !? ́", "fr"), (302, "", None), (303, "xyzzy Ünß", None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    wanted = plain_identify(rows)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in wanted.items()}
    assert all(got[k][1] == pytest.approx(wanted[k][1]) for k in got)


def test_words_keep_their_marks(spark):
    assert [text for a, b, *_ in plain_words("हिन्दी किताब") for text in ["हिन्दी किताब"[a:b]]] == ["हिन्दी", "किताब"]


def test_statistics_of_plain_texts():
    texts = ["One two, two THREE.\nfour five\nfour five", "", "# $ 12 a", "x"]
    (_, data, offsets), = blocks(pa.array(texts))
    got = statistics(data, offsets)
    for text, row in zip(texts, got, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        n, chars = len(words), sum(len(w) for w in words)
        lines = [x for x in text.split("\n") if x]
        plain = {
            0: np.log1p(n), 1: np.log1p(chars / max(n, 1)), 3: np.sqrt(sum(c.isupper() for c in text) / max(chars, 1)), 4: np.sqrt(sum(c.isdigit() for c in text) / max(chars, 1)), 5: np.sqrt(sum(c in ".,;:?" for c in text) / max(n, 1)),
            7: np.sqrt(len({w.lower() for w in words}) / max(n, 1)), 8: np.sqrt(sum(a.lower() == b.lower() for a, b in zip(words, words[1:])) / max(n, 1)), 10: np.log1p(n / max(len(lines), 1)), 11: np.sqrt(len(set(lines)) / max(len(lines), 1)),
            12: np.sqrt(sum(w[-1] in ".,;:?!" for w in words) / max(n, 1)),
        }
        assert {k: row[k] for k in plain} == pytest.approx(plain)


def test_quality_scores_equal_direct_densities(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    (_, data, offsets), = blocks(pa.array([t for _, t in rows]), 1 << 30)
    x = dict(zip([k for k, _ in rows], statistics(data, offsets), strict=True))
    marks = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] in (0, 1) and r["doc_id"] in x and fold_of(r["doc_id"], 4) != 2]
    groups = {c: np.array([x[k] for k, q in marks if q == c]) for c in (0, 1)}
    spread = {c: np.cov(g.T, bias=True) for c, g in groups.items()}
    n = {c: len(g) for c, g in groups.items()}
    both = (n[0] * spread[0] + n[1] * spread[1]) / (n[0] + n[1])
    shrunk = {c: 0.88 * spread[c] + 0.1 * both + 0.02 * np.diag(np.maximum(np.diag(both), 1e-6)) for c in spread}

    def log_density(v, c):
        apart = v - groups[c].mean(axis=0)
        return -0.5 * (apart @ np.linalg.solve(shrunk[c], apart) + np.linalg.slogdet(shrunk[c])[1])

    got = {r["doc_id"]: r for r in quality_scores(docs, labels).collect()}
    for k, v in x.items():
        score = 1 / (1 + np.exp(-np.clip(log_density(v, 1) - log_density(v, 0) + np.log(n[1] / n[0]), -500, 500)))
        assert got[k]["score"] == pytest.approx(score, abs=1e-6) and got[k]["held_out"] == (fold_of(k, 4) == 2)
        assert got[k]["predicted"] == int(got[k]["score"] >= 0.7)


def test_token_files_are_pruned_by_id(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"some words number {k} " * 5) for k in range(6000)], "doc_id long, text string")
    path = f"file://{tmp_path}/tokens"
    write_token_files(docs, path, row_index_stride=1000)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = [f for f in spark.read.orc(path).inputFiles()]
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(files[0]), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == 1000 and reader.getStripes().size() >= 1
    one = spark.read.schema(SCHEMA).orc(path).where("doc_id = 4321").select("doc_id", "n_tokens")
    plan = one._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4321)]" in plan.toString()
    assert [r["doc_id"] for r in one.collect()] == [4321]
    leaf = one._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert leaf.metrics().apply("numOutputRows").value() <= 1000  # one row group of 6000 rows
    missing = spark.read.schema(SCHEMA).orc(path).where("doc_id = 999999").select("doc_id")
    assert missing.count() == 0


def plain_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages_equal_plain_versions(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    quality, exact, near, mixed, packed = (f for _, f in corpus_pipeline.STAGES)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    good = {r[0] for r in con.execute(f"select doc_id from ({ORACLE_SQL['op1_quality_rules']}) q where kept").fetchall()}
    one = quality(spark, docs, SF).cache()
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == good

    first = {}
    for r in sorted(one.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    two = exact(spark, one, SF).cache()
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(first.values())

    rows = sorted(two.collect(), key=lambda r: r["doc_id"])
    sets, own = [plain_sets(r["text"]) for r in rows], list(range(len(rows)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                own[b] = a
    three = near(spark, two, SF).cache()
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(rows[i]["doc_id"] for i in range(len(rows)) if root(i) == i)

    taken = {r["doc_id"]: r["copies"] for r in mix_sources(three).collect() if r["copies"]}
    four = mixed(spark, three, SF).cache()
    assert four.columns == columns and Counter(r["doc_id"] for r in four.collect()) == taken
    assert {tuple(r) for r in four.collect()} <= {tuple(r) for r in docs.collect()}

    five = packed(spark, four, SF)
    held = five.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 2048 for r in held)
    assert sum(r["n"] for r in held) == sum(r["length"] for r in pack(four).collect()) and len(held) <= 1.03 * sum(r["n"] for r in held) / 2048 + 2
