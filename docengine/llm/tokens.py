"""Token ids of whole texts by a public vocabulary, word by word.

The vocabulary drops white space, folds case and never merges across blanks, nor between a letter or
digit and a mark.  So a text's ids are those of its blank-separated words in order, with A-Z folded and the
closing ASCII marks behind a letter or digit taken as a word of their own.  Words are found and hashed for a whole slice of
texts at once; each distinct word goes through the tokenizers library once per worker and memo
generation, and the slice's ids are gathered from the memo.  Words are looked up by 64 bits of hash and
held against another 64; a slice in which two words agree in the first alone goes through the library text
by text.

Defined results: null and empty texts, and those of white space alone, have no ids; equal texts have equal
ids; a text longer than a slice is handled whole; an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import LOWER, second_hashes, span_hashes, text_slices, word_spans

#: Words kept per worker (about 50 bytes each); beyond it those of one slice alone go, or all if too many stay.
MEMO_WORDS = 1_200_000
VOCABULARY = "word_bpe_49k.json"

_BLANKS = np.ones(256, bool)
_BLANKS[[0x20, 0x0A]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: ASCII marks but the apostrophe and those of special tokens.
_CLOSING = np.zeros(256, bool)
_CLOSING[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "'<|>"]] = True
#: Second bytes of the two-byte letters from U+00C0 to U+00FF, which all begin with 0xC3.
_LATIN = np.zeros(256, bool)
_LATIN[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, numbers = (np.concatenate(x) for x in zip(a, b, strict=True))
    order = np.argsort(keys, kind="stable")
    return keys[order], numbers[order]


class Encoder:
    """Ids of slices of texts. Equal to the library's own encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        #: (sorted hashes, word numbers): most words, and those learned lately.
        self.known, self.recent = none, none
        self.words = self.used = 0
        self.pool = np.zeros(1 << 16, np.uint16)
        #: By word number: where its ids start in the pool, how many, the second hash, slices it was seen in.
        self.starts, self.lens, self.seconds, self.hits = (np.zeros(1 << 14, t) for t in (np.int64, np.int32, np.uint64, np.uint8))

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of sorted hashes, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        for keys, numbers in (self.known, self.recent):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                out[hit] = numbers[at[hit]]
        return out

    def _learn(self, hashes: np.ndarray, seconds: np.ndarray, words: list[str]) -> None:
        for lo in range(0, len(words), 4096):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words[lo : lo + 4096], add_special_tokens=False)]
            lens = np.fromiter(map(len, found), np.int64, len(found))
            total, k = int(lens.sum()), self.words
            ids = np.fromiter((i for ids in found for i in ids), np.uint32, total)
            if self.pool.dtype == np.uint16 and total and ids.max() > 0xFFFF:
                self.pool = self.pool.astype(np.uint32)
            while self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while k + len(found) > len(self.starts):
                self.starts, self.lens, self.seconds, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens, self.seconds, self.hits))
            own = slice(k, k + len(found))
            self.pool[self.used : self.used + total] = ids
            self.starts[own], self.lens[own], self.seconds[own], self.hits[own] = self.used + np.cumsum(lens) - lens, lens, seconds[lo : lo + 4096], 0
            self.words, self.used = k + len(found), self.used + total
        self.recent = _merged(self.recent, (hashes, np.arange(self.words - len(words), self.words, dtype=np.int32)))
        if len(self.recent[0]) > 1 << 16:
            self.known, self.recent = _merged(self.known, self.recent), (np.zeros(0, np.uint64), np.zeros(0, np.int32))

    def _make_room(self) -> None:
        """Keeps the words that were seen in several slices, if they leave half of the memo free."""
        keep = np.flatnonzero(self.hits[: self.words] > 1)
        if 2 * len(keep) > MEMO_WORDS:
            return self.forget()
        keys, numbers = _merged(self.known, self.recent)
        new = np.full(self.words, -1, np.int32)
        new[keep] = np.arange(len(keep))
        stay = new[numbers] >= 0
        self.known, self.recent = (keys[stay], new[numbers[stay]]), (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        lens, starts = self.lens[keep], self.starts[keep]
        ends = np.cumsum(lens, dtype=np.int64)
        self.pool = self.pool[np.repeat(starts - (ends - lens), lens) + np.arange(int(lens.sum()))]
        self.starts, self.lens, self.seconds, self.hits = ends - lens, lens, self.seconds[keep], np.ones(len(keep), np.uint8)
        self.words, self.used = len(keep), len(self.pool)
        spare = max(1 << 14, len(keep))
        self.pool = np.concatenate([self.pool, np.zeros(4 * spare, self.pool.dtype)])
        self.starts, self.lens, self.seconds, self.hits = (np.concatenate([x, np.zeros(spare, x.dtype)]) for x in (self.starts, self.lens, self.seconds, self.hits))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i of the slice has ids[bounds[i]:bounds[i + 1]]."""
        starts, ends, first = word_spans(data, offsets, _BLANKS)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        # Where the marks that close a word begin, if a letter or digit stands before them.
        last = np.maximum.accumulate(np.where(_CLOSING[data], -1, np.arange(len(data))))[ends - 1]
        before, two = data[np.maximum(last, 0)], data[np.maximum(last - 1, 0)]
        mark = (last >= starts) & (last < ends - 1) & (_ALNUM[before] | (_LATIN[before] & (two == 0xC3) & (last > starts)))
        place = np.arange(len(starts)) + np.cumsum(mark) - mark
        total = len(starts) + int(mark.sum())
        s, e = np.empty(total, np.int64), np.empty(total, np.int64)
        s[place], e[place] = starts, np.where(mark, last + 1, ends)
        s[place[mark] + 1], e[place[mark] + 1] = last[mark] + 1, ends[mark]
        first = np.append(place, total)[first]
        folded = LOWER[data]
        # Special tokens are matched before case is folded: words that may hold one stay as they are.
        opening = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        for w in np.unique(np.searchsorted(starts, opening, "right") - 1).tolist():
            folded[starts[w] : ends[w]] = data[starts[w] : ends[w]]
        hashes, at, which = np.unique(span_hashes(folded, s, e), return_index=True, return_inverse=True)
        second = second_hashes(folded, s, e)
        if (second != second[at[which]]).any():
            return self._one_by_one(data, offsets)
        numbers = self._numbers(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            if self.words + len(missing) > MEMO_WORDS and self.words:
                self._make_room()
                missing = np.flatnonzero(self._numbers(hashes) < 0)
            raw, starts, ends = folded.tobytes(), s[at[missing]].tolist(), e[at[missing]].tolist()
            self._learn(hashes[missing], second[at[missing]], [raw[lo:hi].decode() for lo, hi in zip(starts, ends, strict=True)])
            numbers = self._numbers(hashes)
        if (self.seconds[numbers] != second[at]).any():
            return self._one_by_one(data, offsets)
        self.hits[numbers] += self.hits[numbers] < 255
        numbers = numbers[which]
        lens = self.lens[numbers]
        bounds = np.concatenate([[0], np.cumsum(lens)])
        ids = self.pool[np.repeat(self.starts[numbers] - bounds[:-1], lens) + np.arange(bounds[-1])].astype(np.uint32)
        return ids, bounds[first]


    def _one_by_one(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from the library alone."""
        raw, off = data.tobytes(), offsets.tolist()
        found = [self.tokenizer.encode(raw[lo:hi].decode(), add_special_tokens=False).ids for lo, hi in zip(off, off[1:], strict=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.concatenate([[0], np.cumsum([len(ids) for ids in found])]).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder, with its memo, per worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batch: pa.RecordBatch, path: str, column: str = "text") -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of every row; null and empty texts have no ids."""
    own = encoder(path)
    for lo, hi, data, offsets in text_slices(batch, column):
        ids, bounds = own.encode(data, offsets)
        for i in range(lo, hi):
            yield i, ids[bounds[i - lo] : bounds[i - lo + 1]]
