"""The Pitman-Yor model against recurrences, exact conditionals and a direct sequential sampler."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cytofold.llm.language_model import RECURRENCE, lm_scores, log_stirling, pack_up, sample_tables, stirling_table, unpack


def conditional(c, base, others, discount, strength):
    stirling = stirling_table(discount, max(c, 2))
    t = np.arange(1, c + 1)
    log = stirling[c, 1 : c + 1] + np.cumsum(np.log(strength + discount * (others + t - 1))) + t * np.log(base)
    p = np.exp(log - log.max())
    return p / p.sum()


def test_packed_values_come_back():
    for values in ([], [0], [1, 2, 2**40, 2**63], range(1000)):
        values = np.array(list(values), dtype=np.uint64)
        assert (unpack(pack_up(values)).view(np.uint64) == values).all()


@pytest.mark.parametrize("discount", [0.05, 0.3, 0.5, 0.72, 0.85, 0.95])
def test_stirling_integral_equals_recurrence(discount):
    c = RECURRENCE + 100
    t = np.arange(1, c + 1)
    assert np.abs(log_stirling(np.full(c, c), t, discount) - stirling_table(discount, c)[c, 1:]).max() < 0.02


@pytest.mark.parametrize("c, base, others", [(1, 0.1, 3), (2, 0.3, 5), (40, 0.01, 20), (300, 0.4, 900), (RECURRENCE, 0.2, 10), (RECURRENCE + 80, 0.2, 10), (RECURRENCE + 80, 1e-4, 0), (RECURRENCE + 80, 0.3, 2000)])
def test_tables_follow_their_conditional(c, base, others):
    n = 4000
    got = sample_tables(np.full(n, c), np.full(n, base), np.full(n, others), 0.7, 1.0, np.random.default_rng(1))
    p = conditional(c, base, others, 0.7, 1.0)
    t = np.arange(1, c + 1)
    mean = (p * t).sum()
    deviation = ((p * t * t).sum() - mean**2) ** 0.5
    assert abs(got.mean() - mean) <= 5 * deviation / n**0.5 + 1e-9
    assert got.std() == pytest.approx(deviation, rel=0.08, abs=0.02)
    shares = (np.arange(20) + 0.5) / 20
    assert np.abs(np.quantile(got, shares) - np.searchsorted(np.cumsum(p), shares) - 1).mean() <= 1 + 0.1 * deviation


def sequential(texts, held, sweeps=300, strength=1.0, parent_strength=10.0):
    """Log10 probabilities of texts by a sequential sampler that visits one dish at a time; predictions averaged over sweeps."""
    rng = np.random.default_rng(3)
    tokens = {k: [*text.split(), "</s>"] for k, text in texts.items()}
    pairs = {k: list(zip(["<s>", *w[:-1]], w)) for k, w in tokens.items()}
    count = Counter(p for k in pairs if k not in held for p in pairs[k])
    context = Counter()
    for (u, _), c in count.items():
        context[u] += c
    tables = dict.fromkeys(count, 1)
    words = sorted({w for _, w in count})
    below = Counter(w for _, w in count)
    rate = lambda cs: min(0.95, max(0.05, sum(c == 1 for c in cs) / (sum(c == 1 for c in cs) + 2 * sum(c == 2 for c in cs))))
    d, d0 = rate(count.values()), rate(below.values())
    parent = dict.fromkeys(words, 1)
    used = defaultdict(int)
    for (u, _), t in tables.items():
        used[u] += t
    v = len(words)
    draw = lambda *args: 1 + int((rng.random() > np.cumsum(conditional(*args))).sum())

    def base(w):
        new = (parent_strength + d0 * sum(parent.values())) / (v + 1)
        return (max(below[w] - d0 * parent.get(w, 0), 0) + new) / (parent_strength + sum(below.values()))

    total, samples = defaultdict(float), 0
    for sweep in range(sweeps):
        for (u, w), c in count.items():
            if c > 1:
                t = draw(c, base(w), used[u] - tables[u, w], d, strength)
                used[u] += t - tables[u, w]
                below[w] += t - tables[u, w]
                tables[u, w] = t
        for w in words:
            parent[w] = min(draw(below[w], 1 / (v + 1), sum(parent.values()) - parent[w], d0, parent_strength), below[w])
        if sweep >= sweeps // 10:
            samples += 1
            for u, w in {p for ps in pairs.values() for p in ps}:
                total[u, w] += (max(count[u, w] - d * tables.get((u, w), 0), 0) + (strength + d * used[u]) * base(w)) / (strength + context[u])
    return {k: sum(np.log10(total[p] / samples) for p in ps) for k, ps in pairs.items()}


def test_scores_equal_a_sequential_sampler(spark):
    rng = np.random.default_rng(5)
    p = 1 / np.arange(1, 26) ** 1.3
    texts = {k: " ".join(f"w{x}" for x in rng.choice(25, 14, p=p / p.sum())) for k in range(60)} | {60: "w1 unseen w2"}
    held = {k for k in texts if zlib.crc32(str(k).encode()) % 10 == 0}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_scores(docs, rounds=6, burn_in=2).collect()}
    wanted = sequential(texts, held)
    assert got.keys() == wanted.keys()
    apart = np.array([got[k] / wanted[k] - 1 for k in got])
    assert np.abs(apart).max() < 0.08 and abs(apart.mean()) < 0.01


def test_scores_do_not_hang_on_partitions_or_block_sizes(spark):
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 40, 30))) for k in range(50)] + [(50, None), (None, "w1 w2"), (7, "w3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [lm_scores(docs.repartition(n), chunk_bytes=size) for n, size in ((1, 8 << 20), (5, 8 << 20), (3, 500))]
    found = [sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 3)) for r in run.collect()) for run in runs]
    assert found[0] == found[1] == found[2]
