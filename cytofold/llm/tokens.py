"""Token ids of whole texts with a public tokenizer, a batch at a time.

A batch is cut at white space and between ASCII letters and other ASCII
characters, places where the tokenizer's own splitting always cuts; every
distinct piece goes through the tokenizers library once (A-Z already as a-z, as
its normaliser would do), and ids of a text are put together from its pieces.
Apostrophes never lie at a cut (contractions), and texts that hold a special
token's string go through the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa

from cytofold.llm.arrays import LOWER, blocks, hash_spans, ranges, spans

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
OTHER = np.zeros(256, dtype=bool)
OTHER[33:127] = True
OTHER &= ~LETTER
OTHER[ord("'")] = False
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
#: Pieces kept from block to block; beyond them, those that the block at hand doesn't use go.
KEPT_PIECES = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes Arrow arrays of texts to (ids, offsets) pairs of numpy arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self._set(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _set(self, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """The known pieces: sorted hashes, and where each one's ids lie in ``ids``."""
        self.keys, self.starts, self.lengths, self.ids = keys, starts, lengths, ids

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has.

        Pieces go to the library many at a time, a space apart; each id belongs to
        the piece that holds its first character. Normalisation may take letters
        apart or together, which the library's offsets see through.
        """
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), 10_000):
            some = pieces[at : at + 10_000]
            got = self.library.encode(" ".join(some), add_special_tokens=False)
            starts = np.cumsum([0] + [len(p) + 1 for p in some])
            first = np.array(got.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            ids.append(np.array(got.ids, dtype=np.uint32))
            counts.append(np.bincount(np.searchsorted(starts, first, side="right") - 1, minlength=len(some)))
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, keys: np.ndarray, pieces: list[str], used: np.ndarray) -> None:
        """Add pieces; when there are too many, known ones that are not ``used`` by this block go first."""
        if len(self.keys) + len(keys) > KEPT_PIECES:
            rows = np.flatnonzero(used)
            lengths = self.lengths[rows]
            self._set(self.keys[rows], np.cumsum(lengths) - lengths, lengths, self.ids[ranges(self.starts[rows], lengths)])
        some, lengths = self._ids(pieces)
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        by_key = np.argsort(keys)
        keys, starts, lengths = keys[by_key], starts[by_key], lengths[by_key]
        at = np.searchsorted(self.keys, keys)
        self._set(np.insert(self.keys, at, keys), np.insert(self.starts, at, starts), np.insert(self.lengths, at, lengths), np.concatenate([self.ids, some]))

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == hashes[inside]
        return at, known

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        letter, other = LETTER[data], OTHER[data]
        cuts = np.zeros(len(data), dtype=bool)
        cuts[1:] = letter[1:] & other[:-1] | other[1:] & letter[:-1]
        starts, ends = spans(data, offsets, cuts)
        lower = LOWER[data]
        inverse, hashes = pd.factorize(hash_spans(lower, starts, ends))
        at, known = self._find(hashes)
        if not known.all():
            raw = lower.tobytes()
            fresh = np.flatnonzero(~known)
            where = np.empty(len(hashes), dtype=np.int64)
            where[inverse[::-1]] = np.arange(len(inverse))[::-1]
            where = where[fresh]
            pieces = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
            used = np.zeros(len(self.keys), dtype=bool)
            used[at[known]] = True
            self._learn(hashes[fresh], pieces, used)
            at, _ = self._find(hashes)
        place = at[inverse]
        lengths = self.lengths[place]
        per_row = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, offsets)]
        return self.ids[ranges(self.starts[place], lengths)], per_row

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        got = [self.library.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return np.array([i for ids in got for i in ids], dtype=np.uint32), np.concatenate([[0], np.cumsum([len(ids) for ids in got])]).astype(np.int64)

    def encode(self, texts: pa.Array):
        """Yield (first row, ids, offsets of the rows in ids) for blocks of rows."""
        for at, data, offsets in blocks(texts):
            raw = data.tobytes()
            special = any(s in raw for s in SPECIAL)
            yield at, *(self._whole(data, offsets) if special else self._block(data, offsets))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
