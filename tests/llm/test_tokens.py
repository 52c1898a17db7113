"""Token ids against the tokenizers library: letters that normalisation takes apart, marks, digits, special strings."""

import sys
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cytofold.llm.packing import pack
from cytofold.llm.token_files import round_trip
from cytofold.llm.tokens import Encoder, default_path

ASSIGNED = [chr(c) for c in range(0x20, sys.maxunicode) if unicodedata.category(chr(c))[0] not in "C" or c in (0x200B, 0x200D, 0xFEFF)]
UNSTABLE = [c for c in ASSIGNED if not unicodedata.is_normalized("NFC", c)]
MARKS = [c for c in ASSIGNED if unicodedata.category(c)[0] == "M"]
PLAIN = ["zebra apple", "hello world of words", "plain again, it's 12 o'clock.", "don't stop"]


@pytest.fixture(scope="module")
def library():
    return Encoder(default_path()).library


def encoded(texts):
    out = []
    for _, ids, offsets in Encoder(default_path()).encode(pa.array(texts)):
        out += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def whole(library, texts):
    return [library.encode(t, add_special_tokens=False).ids for t in texts]


def beside_plain(odd):
    return [t for k, x in enumerate(odd) for t in ([x, PLAIN[k % len(PLAIN)]] if k % 50 == 0 else [x])]


def test_every_unstable_letter(library):
    texts = beside_plain([f"{c} a{c}b word {c} word {c}{c} ক{c}য়" for c in UNSTABLE])
    assert len(UNSTABLE) > 1000 and encoded(texts) == whole(library, texts)


def test_every_mark(library):
    texts = beside_plain([f"{c} e{c} e {c} E{c}x y 1{c}." for c in MARKS])
    assert encoded(texts) == whole(library, texts)


@pytest.mark.parametrize("seed", range(2))
def test_random_texts(library, seed):
    rng = np.random.default_rng(seed)
    bits = [*ASSIGNED[::7], *MARKS[::3], *UNSTABLE[::2]] if seed % 2 else [*"abcXYZ019 .,'\n\t", "'s", "n't", " ", "ß", "İ", "ſ", "K", "가", "가", "é", "é", "　", "<|endoftext|>", "<|EndOfText|>", "<|", "|>", "ཱི", "9⃣"]
    texts = beside_plain(["".join(rng.choice(bits, rng.integers(1, 30))) for _ in range(1500)])
    assert encoded(texts) == whole(library, texts)


def test_operators_hold_the_ids_of_the_library(spark, library):
    texts = [*PLAIN, "হয়", *("ok " + c + " fine" for c in UNSTABLE[::10]), "क़ख़ words", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    ids = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
    crc = lambda k, end: zlib.crc32(np.array([*ids[k], end], dtype="<u4").tobytes())
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in pack(docs).collect()} == {k: (len(v) + 1, crc(k, 0)) for k, v in ids.items()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in round_trip(docs).collect()} == {k: (len(v) + 1, crc(k, 2)) for k, v in ids.items()}
