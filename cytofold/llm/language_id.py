"""Language identification of mixed-language texts.

Words are runs of letters and the marks on them. A word's script narrows the candidate languages to
those seen with it in training; hashed letter trigrams and the word itself score
it for each; Viterbi with a penalty for each switch labels the words, so that
spans of one language come out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytofold.llm.arrays import MIX, U64, blocks, mix
from cytofold.llm.common import fold, named

#: First code points of Unicode blocks by script.
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
)
NAMES = sorted({name for _, name in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(name) for _, name in SCRIPTS])[np.maximum(0, np.searchsorted([first for first, _ in SCRIPTS], np.arange(0x10000), side="right") - 1)]
IS_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])
IS_MARK = np.array([unicodedata.category(chr(c)).startswith("M") for c in range(0x10000)])
FOLD = np.array([ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(0x10000)], dtype=np.uint32)
BUCKETS = 1 << 15
#: Cost of a switch, in natural-log units.
SWITCH = 9.0
SMOOTH = 0.3


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a block (lower case), whether each is a letter or a mark behind one, and the offsets of the rows in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    low = points < 0x10000
    letter = np.zeros(len(points), dtype=bool)
    letter[low] = IS_LETTER[points[low]]
    for c in np.unique(points[~low]):
        if unicodedata.category(chr(int(c))).startswith("L"):
            letter |= points == c
    marks = np.zeros(len(points), dtype=bool)
    marks[low] = IS_MARK[points[low]]
    if marks.any():  # a mark belongs to the letter before it and the marks between, in the same row
        n = np.arange(len(points))
        base = np.maximum.accumulate(np.where(marks, -1, n))
        row_start = np.repeat(bounds[:-1], np.diff(bounds))
        letter |= marks & (base >= row_start) & letter[np.maximum(base, 0)]
    folded = points.copy()
    folded[low] = FOLD[points[low]]
    return folded, letter, bounds


class Words:
    """The words of a block: rows, spans in code points, scripts, and their features as bucket numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        points, letter, self.bounds = letters(data, offsets)
        n = len(points)
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.bounds] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = letter[:-1]
        before &= ~cut[:n]
        after = np.zeros(n, dtype=bool)
        after[:-1] = letter[1:]
        after &= ~cut[1:]
        self.starts = np.flatnonzero(letter & ~before)
        self.ends = np.flatnonzero(letter & ~after) + 1
        self.rows = np.searchsorted(self.bounds, self.starts, side="right") - 1
        at = np.flatnonzero(letter)
        prev = np.where(before[at], points[at - 1], 0).astype(np.uint64)
        following = np.where(after[at], points[np.minimum(at + 1, n - 1)], 0).astype(np.uint64)
        own = points[at].astype(np.uint64)
        code = mix((prev << U64(42)) | (own << U64(21)) | following)
        self.grams = (code % U64(BUCKETS)).astype(np.int64)
        self.lengths = self.ends - self.starts
        self.first = np.cumsum(self.lengths) - self.lengths
        place = np.arange(len(at)) - np.repeat(self.first, self.lengths)
        value = (code * MIX[100 + np.minimum(place, 60)]) if len(at) else code
        self.words = (mix(np.add.reduceat(value, self.first)) % U64(BUCKETS)).astype(np.int64) if len(at) else np.zeros(0, np.int64)
        self.scripts = SCRIPT_OF[np.minimum(points[self.starts], 0xFFFF)]


def train(texts: DataFrame, lang_col: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, feature log-probabilities (2 * BUCKETS x languages) and which scripts each was seen in.

    Every training text counts. A partition adds its counts up before they are
    shuffled; a language has a fixed number of counters.
    """
    width = 2 * BUCKETS + len(NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for at, data, offsets in blocks(batch.column(0)):
                words = Words(data, offsets)
                lang = langs[at : at + len(offsets) - 1][words.rows]
                for name in set(lang):
                    mine = lang == name
                    new = np.concatenate([
                        np.bincount(words.grams[np.repeat(mine, words.lengths)], minlength=BUCKETS),
                        np.bincount(words.words[mine], minlength=BUCKETS),
                        np.bincount(words.scripts[mine], minlength=len(NAMES)),
                    ])
                    held[name] = held.get(name, 0) + new
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.astype("<i8").tobytes() for v in held.values()], pa.binary())], names=["lang", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, dtype="<i8") for c in group["counts"])
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "counts": [total.tobytes()]})

    schema = "lang string, counts binary"
    partial = texts.select("text", lang_col).mapInArrow(count, schema)
    partial = partial.groupBy("lang", F.spark_partition_id() % 16).applyInPandas(add, schema)
    rows = sorted(partial.groupBy("lang").applyInPandas(add, schema).collect())
    if not rows:
        return [], np.zeros((2 * BUCKETS, 0)), np.zeros((len(NAMES), 0), dtype=bool)
    counts = np.stack([np.frombuffer(r["counts"], dtype="<i8") for r in rows], axis=1).astype(float)
    assert counts.shape[0] == width
    log = [np.log((c + SMOOTH) / (c.sum(axis=0) + SMOOTH * BUCKETS)) for c in (counts[:BUCKETS], counts[BUCKETS : 2 * BUCKETS])]
    scripts = counts[2 * BUCKETS :]
    return [r["lang"] for r in rows], np.concatenate(log), scripts >= np.maximum(1, 0.001 * scripts.sum(axis=0))


def word_scores(words: Words, log: np.ndarray, barred: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Score of each word (rows) for each language, from some ``most`` letters at a time and one word at least, however long the text is."""
    out = np.empty((len(words.starts), log.shape[1]), dtype=log.dtype)
    ends = words.first + words.lengths
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, words.first[a] + most, side="right")))
        grams = np.add.reduceat(log[words.grams[words.first[a] : ends[b - 1]]], words.first[a:b] - words.first[a])
        out[a:b] = grams + log[BUCKETS + words.words[a:b]] + barred[words.scripts[a:b]]
        a = b
    return out


def viterbi(scores: np.ndarray, rows: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; ``rows`` (ascending) says which text a word belongs to. All texts step together."""
    n, k = scores.shape
    _, first, counts = np.unique(rows, return_index=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    first, counts = first[order], counts[order]
    alive = np.searchsorted(-counts, -np.arange(counts[0] if len(counts) else 0), side="left")
    back = np.empty((n, k), dtype=np.int8 if k < 128 else np.int32)
    best = np.zeros((len(first), k), dtype=scores.dtype)
    own = np.arange(k)
    for t, m in enumerate(alive):
        at = first[:m] + t
        if t:
            now = best[:m]
            top = now.argmax(axis=1)
            jump = now[np.arange(m), top] - penalty
            switch = jump[:, None] > now
            back[at] = np.where(switch, top[:, None], own)
            best[:m] = np.where(switch, jump[:, None], now) + scores[at]
        else:
            best[:m] = scores[at]
    label = best.argmax(axis=1)
    out = np.empty(n, dtype=np.int64)
    for t in range(len(alive) - 1, -1, -1):
        m = alive[t]
        at = first[:m] + t
        out[at] = label[:m]
        if t:
            label[:m] = back[at, label[:m]]
    return out


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2, folds: int = 4, penalty: float = SWITCH
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, spans.

    Learns from text and language of documents outside fold ``held_out`` whose
    language isn't null. ``spans`` holds (start, end, lang) in code points from
    the first to the last letter of each stretch of one language; ``lang_pred``
    has most letters, ``score`` is their share (ties: first in code-point order).
    Null texts, texts without a letter, and all texts if nothing could be learned
    get ``und``, score 0 and no spans. An empty table gives an empty result.
    """
    texts = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"), named(lang_col).alias("lang"))
    fold_of = fold(F.col("doc_id"), folds)
    langs, log, seen = train(texts.where((fold_of != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull()), "lang")
    log = log.astype(np.float32)
    barred = np.where(seen, 0.0, -1e4).astype(np.float32)
    barred[~seen.any(axis=1)] = 0

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in blocks(batch.column(1), 2 << 20):
                n = len(offsets) - 1
                words = Words(data, offsets)
                share = np.zeros((n, len(langs)))
                runs = np.zeros(0, np.int64)
                if len(langs) and len(words.starts):
                    scores = word_scores(words, log, barred)
                    found = viterbi(scores, words.rows, penalty)
                    np.add.at(share, (words.rows, found), words.lengths)
                    new = np.ones(len(found), dtype=bool)
                    new[1:] = (found[1:] != found[:-1]) | (words.rows[1:] != words.rows[:-1])
                    runs = np.flatnonzero(new)
                total = share.sum(axis=1)
                some = total > 0
                pred = np.full(n, "und", dtype=object)
                if len(langs):
                    pred[some] = np.array(langs, dtype=object)[share[some].argmax(axis=1)]
                score = np.where(some, share.max(axis=1, initial=0) / np.maximum(total, 1), 0.0)
                lasts = np.append(runs[1:], len(words.starts)) - 1 if len(runs) else runs
                begin = words.bounds[words.rows[runs]]
                fields = [
                    pa.array((words.starts[runs] - begin).astype(np.int64)),
                    pa.array((words.ends[lasts] - begin).astype(np.int64)),
                    pa.array([langs[i] for i in found[runs]] if len(runs) else [], pa.string()),
                ]
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(words.rows[runs], np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays(fields, names=["start", "end", "lang"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.array(pred, pa.string()), pa.array(score), spans], names=["doc_id", "held_out", "lang_pred", "score", "spans"]
                )

    schema = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"
    return texts.select("doc_id", "text", (fold_of == held_out).alias("held_out")).mapInArrow(label, schema)
