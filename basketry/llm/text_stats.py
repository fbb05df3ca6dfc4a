"""Exact per-text counts for many texts at once, on Arrow buffers without a Python loop over texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from basketry.llm.common import Words, mix, span_hash, text_bytes

#: Character classes in the order of the histograms.
CLASSES = ("lower", "upper", "digit", "blank", "newline", "stop", "symbol", "other ascii", "beyond ascii")
#: Characters that count as symbols, and as ordinary punctuation.
SYMBOLS = b"#*$%&|<>"
STOPS = b".,;:!?'\"()-"

_CLASS = np.full(256, 7, dtype=np.int8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 3
_CLASS[0x0A] = 4
_CLASS[list(STOPS)] = 5
_CLASS[list(SYMBOLS)] = 6
_CLASS[0xC0:] = 8
_CLASS[0x80:0xC0] = 9  # inside a character
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between neighbouring ``bounds``."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated_lines(raw: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """Of each text's lines with a word, how many equal an earlier one."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(raw == 0x0A)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    # a line that starts at a text's end (after a final break) belongs to that text: it is empty and has no word
    doc = np.searchsorted(offsets, begin, side="right") - 1
    end = np.append(begin[1:], len(raw)) if len(begin) else begin
    broken = np.zeros(len(raw) + 1, dtype=bool)
    broken[breaks] = True
    end = np.where((end > begin) & broken[np.maximum(end - 1, 0)], end - 1, end)
    has = np.searchsorted(words.start, end) > np.searchsorted(words.start, begin)
    begin, end, doc = begin[has], end[has], doc[has]
    if not len(begin):
        return np.zeros(n, dtype=np.int64)
    key = span_hash(raw, begin, end)
    order = np.lexsort((key, doc))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][same], minlength=n).astype(np.int64)


def repeated_words(h: np.ndarray, words: Words, size: int = 3) -> np.ndarray:
    """Words that stand in some run of ``size`` words found twice or more in their text."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(len(words.first) - 1, dtype=np.int64)
    doc = np.repeat(np.arange(len(words.first) - 1), words.count)
    whole = doc[:n] == doc[size - 1 :]
    key = doc[:n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(size):
        key = key * np.uint64(0x9FB21C651E98DF25) + h[k : k + n]
    key = mix(key)
    at = np.flatnonzero(whole)
    order = at[np.argsort(key[at])]
    sorted_ = key[order]
    same = sorted_[1:] == sorted_[:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h), dtype=bool)
    for k in range(size):
        covered[k : k + n] |= twice
    return per_text(covered, words.first)


def common_table(lists: dict[str, list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All common words; the sorted hashes of their forms; which word each hash is of."""
    names = sorted({w for words in lists.values() for w in words})
    forms = [(f, k) for k, w in enumerate(names) for f in {w, w[:1].upper() + w[1:]}]
    raw = np.frombuffer("".join(f for f, _ in forms).encode(), dtype=np.uint8)
    cuts = np.cumsum([0, *(len(f.encode()) for f, _ in forms)])
    h = span_hash(raw, cuts[:-1], cuts[1:])
    order = np.argsort(h)
    return names, h[order], np.asarray([k for _, k in forms])[order]


class Stats:
    """Counts of each text of an Arrow string column (no nulls)."""

    def __init__(self, column: pa.Array) -> None:
        raw, offsets = text_bytes(column)
        self.raw, self.offsets, self.words = raw, offsets, Words(raw, offsets)
        self.hash = self.words.hash
        self.n_words = self.words.count
        kind = _CLASS[raw]
        starts = np.concatenate([[0], np.cumsum(kind != 9)])
        spans = starts[self.words.end] - starts[self.words.start]
        self.word_chars = per_text(spans, self.words.first)
        self.n_symbols = per_text(_SYMBOL[raw], offsets)
        self.n_dup_lines = repeated_lines(raw, offsets, self.words)
        self.n_repeat_words = repeated_words(self.hash, self.words)
        n = len(offsets) - 1
        doc = np.repeat(np.arange(n), np.diff(offsets))
        self.classes = np.bincount(doc * 10 + kind, minlength=10 * n).reshape(n, 10)[:, :9]

    def common(self, table: tuple[list[str], np.ndarray, np.ndarray]) -> np.ndarray:
        """Texts by common words: how often each occurs."""
        names, h, which = table
        n = len(self.offsets) - 1
        at = np.minimum(np.searchsorted(h, self.hash), len(h) - 1)
        hit = np.flatnonzero(h[at] == self.hash)
        doc = np.repeat(np.arange(n), self.n_words)[hit]
        return np.bincount(doc * len(names) + which[at[hit]], minlength=n * len(names)).reshape(n, len(names))
