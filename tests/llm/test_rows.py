"""Rows that repeat, share ids or have none, and columns named like those of the operators."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cytofold.llm.components import components
from cytofold.llm.exact_dedup import drop_copies, exact_dedup
from cytofold.llm.language_id import identify
from cytofold.llm.language_model import lm_scores
from cytofold.llm.line_dedup import drop_lines, line_dedup
from cytofold.llm.mixing import draw_mix, mix_sources
from cytofold.llm.near_dedup import drop_near_copies
from cytofold.llm import quality_rules as rules
from cytofold.llm.quality_rules import keep_good, quality_rules

WORDED = re.compile(r"[^\x20\x09-\x0D]")
BASE = " ".join(f"word{k}" for k in range(60))
OTHER = " ".join(f"other{k}" for k in range(60))


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def texts(rows):
    return sorted(str(r["text"]) for r in rows.collect())


@pytest.mark.parametrize("operator", [keep_good, drop_copies, drop_near_copies, draw_mix, drop_lines])
def test_underscored_columns_do_not_clash(spark, operator):
    names = ("_id", "_key", "_gone", "_copies", "_row", "_last", "_text_key", "_nth", "_source", "_copy", "least", "n", "comp", "hi", "lo")
    docs = table(spark, [(k, f"{BASE} number{k} text", "s") for k in range(4)] + [(None, None, None)], "doc_id long, text string, source string")
    odd = docs.withColumns({c: F.lit(c) for c in names})
    got = operator(odd)
    assert got.columns == odd.columns
    assert all(r[c] == c for r in got.collect() for c in names)


def test_names_with_dots_and_backticks(spark):
    docs = table(spark, [(k, f"{BASE} number{k} text", "en", "s") for k in range(4)] + [(None, None, None, None)], "`doc.id` long, `te``xt` string, `la.ng` string, `so.urce` string")
    names = {"id_col": "doc.id", "text_col": "te`xt"}
    mixed = names | {"source_col": "so.urce"}
    for result in (quality_rules(docs, **names), exact_dedup(docs, **names), mix_sources(docs, **mixed), lm_scores(docs, **names), identify(docs, lang_col="la.ng", **names)):
        assert result.count() == 5
    kept = (keep_good(docs, text_col="te`xt"), drop_copies(docs, **names), draw_mix(docs, **mixed))
    assert all(rows.columns == docs.columns for rows in kept)
    assert [rows.count() for rows in kept] == [0, 5, 6]  # no stop words; all differ; half of four texts again


def test_texts_without_room_for_positions_are_refused(spark, monkeypatch):
    monkeypatch.setattr(rules, "AT_BITS", 4)
    assert quality_rules(table(spark, [(1, "a b c d e " * 3)])).first()["n_repeat_words"] == 15
    with pytest.raises(Exception, match="16 words or more"):
        quality_rules(table(spark, [(1, "a b c d e " * 4)])).collect()


def test_lines_of_rows_that_share_an_id_are_their_own(spark):
    docs = table(spark, [(None, "only once kept\nyet other"), (None, "said before\nunlike it"), (1, "said before"), (5, "a line of its own"), (5, "said before\nanother line"), (5, "said before\nanother line")])
    kept = [r["text"] for r in drop_lines(docs).collect()]
    assert sorted(kept) == sorted(["only once kept\nyet other", "unlike it", "said before", "a line of its own", "another line", ""])
    assert sorted((r["n_lines"], tuple(r["dropped"])) for r in line_dedup(docs).where("doc_id = 5").collect()) == [(1, ()), (2, (0,)), (2, (0, 1))]


def test_repeated_rows_keep_their_lines_once(spark):
    rows = [(8, "same text line")] * 3 + [(None, "x y\n\nz w")] * 2 + [(9, None)] * 2
    kept = Counter(r["text"] for r in drop_lines(table(spark, rows)).collect())
    assert kept == {"same text line": 1, "": 3 - 1, "x y\n\nz w": 1, "\n".join([""]): 2, None: 2} or kept == {"same text line": 1, "": 3, "x y\n\nz w": 1, None: 2}


def test_unique_lines_stay_on_random_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(None if rng.random() < 0.3 else int(rng.integers(0, 12)), "\n".join("".join(rng.choice(list("abcdefgh"), 7)) for _ in range(rng.integers(0, 4)))) for _ in range(60)]
    rows += rows[:5]
    before = Counter(line.strip() for _, t in rows for line in t.split("\n") if WORDED.search(line))
    after = Counter(line for r in drop_lines(table(spark, rows), edits=0).collect() for line in r["text"].split("\n") if WORDED.search(line))
    assert set(after) == set(before) and set(after.values()) == {1}


def test_near_copies_go_whatever_their_ids(spark):
    near = BASE.replace("word30", "new")
    nearer = BASE.replace("word50", "newer")
    rows = [(3, BASE), (5, near), (5, OTHER), (None, nearer), (None, "quite unlike anything else here"), (7, OTHER), (None, None), (9, "")]
    assert texts(drop_near_copies(table(spark, rows))) == sorted([BASE, OTHER, "quite unlike anything else here", "None", ""])
    alone = [(None, near), (None, BASE), (None, BASE)]
    assert drop_near_copies(table(spark, alone)).count() == 1


def test_one_row_of_repeated_ones_stays(spark):
    rows = [(1, BASE, "b"), (1, BASE, "a"), (1, OTHER, "a"), (None, OTHER, "c")]
    docs = table(spark, rows, "doc_id long, text string, source string")
    for operator in (drop_copies, drop_near_copies):
        found = [sorted(map(str, operator(docs.repartition(n)).collect())) for n in (1, 3)]
        assert found[0] == found[1] and len(found[0]) == 2


def test_mix_takes_repeated_rows_by_source(spark):
    rows = [(1, BASE, "a", "x"), (1, BASE, "b", "y"), (1, BASE, None, "z"), (2, OTHER, "b", "u"), (2, OTHER, "b", "v")]
    docs = table(spark, rows, "doc_id long, text string, source string, more string")
    found = [sorted(map(str, draw_mix(docs.repartition(n)).collect())) for n in (1, 4)]
    assert found[0] == found[1]
    assert set(found[0]) <= {str(r) for r in docs.collect()}


def test_components_of_a_star_and_a_chain(spark):
    rng = np.random.default_rng(2)
    star = [(10_000, int(k)) for k in rng.permutation(3000) + 10_001]
    chain = [(k, k + 1) for k in range(500)]
    got = {r["node"]: r["comp"] for r in components(table(spark, star + chain, "a long, b long")).collect()}
    assert all(got[b] == 10_000 for _, b in star) and all(got[k] == 0 for k in range(501))


@pytest.mark.parametrize("letters, longest, seed", [("ab", 9, 1), ("abc", 6, 2), ("abcd", 5, 3)])
def test_line_dedup_equals_sql(spark, letters, longest, seed):
    rng = np.random.default_rng(seed)
    line = lambda: "".join(rng.choice(list(letters + " "), rng.integers(0, longest)))
    rows = [(k, "\n".join(line() for _ in range(rng.integers(0, 6)))) for k in range(40)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    expected = con.execute(r"""with l as (select doc_id, i, trim(x, ' ') as line from (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as i from documents) where trim(x, ' ') <> '')
        select a.doc_id, list(distinct a.i order by a.i) from l a join l b on (b.doc_id, b.i) < (a.doc_id, a.i) and abs(length(a.line) - length(b.line)) <= 1 and levenshtein(a.line, b.line) <= 1 group by 1""").fetchall()
    got = {r["doc_id"]: r["dropped"] for r in line_dedup(table(spark, rows)).collect() if r["dropped"]}
    assert got == dict(expected)


def test_lines_with_equal_keys_are_told_apart(spark, monkeypatch):
    import cytofold.llm.line_dedup as ld

    rng = np.random.default_rng(9)
    rows = [(k, "\n".join("".join(rng.choice(list("abcd "), rng.integers(1, 6))) for _ in range(5))) for k in range(30)]
    expected = sorted(map(str, line_dedup(table(spark, rows)).collect()))
    real = ld.line_hash
    monkeypatch.setattr(ld, "line_hash", lambda line: (F.lit(7).cast("long"), real(line)[1]))
    assert sorted(map(str, line_dedup(table(spark, rows)).collect())) == expected


def test_long_lines_are_confirmed_in_linear_time(spark):
    import time

    a = "".join(np.random.default_rng(1).choice(list("abcdefgh "), 1_000_000))
    rows = [(1, a), (2, a[:700_000] + "#" + a[700_001:]), (3, a[:5] + a[6:]), (4, a[:10] + "##" + a[12:]), (5, a + "z")]
    began = time.time()
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup(table(spark, rows)).collect()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1}
    assert time.time() - began < 120


def test_within_one_edit():
    from itertools import product

    from cytofold.llm.line_dedup import within_one

    texts = ["".join(p) for n in range(5) for p in product("ab", repeat=n)]

    def near(x, y):
        grown = {x[:i] + c + x[i:] for i in range(len(x) + 1) for c in "ab"}
        return y == x or y in grown or x in {y[:i] + c + y[i:] for i in range(len(y) + 1) for c in "ab"} or len(x) == len(y) and sum(a != b for a, b in zip(x, y, strict=True)) == 1

    assert all(within_one(x, y) == near(x, y) for x in texts for y in texts)


def test_blocks_of_near_copies_keep_to_bytes(spark, monkeypatch):
    import cytofold.llm.near_dedup as nd

    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    rows = []
    for k in range(40):
        mine = list(base)
        for at in rng.choice(400, int(rng.integers(0, 25)), replace=False):
            mine[at] = f"x{rng.integers(0, 10**9)}"
        rows.append((k, " ".join(mine)))
    sizes, real = [], nd.compare_blocks

    def watched(nodes, pairs, percent):
        sizes.append(nodes.groupBy("block").agg(F.sum(F.length("shingles")).alias("b")).agg(F.max("b")).first()[0])
        return real(nodes, pairs, percent)

    monkeypatch.setattr(nd, "compare_blocks", watched)
    found = []
    for most in (8 << 20, 4 * 3200):
        monkeypatch.setattr(nd, "BLOCK_BYTES", most)
        found.append(sorted(map(str, nd.near_dedup(table(spark, rows)).collect())))
    assert found[0] == found[1] and sizes[1] < sizes[0] / 2
