"""Numbers that describe a text, an Arrow column at a time."""

from __future__ import annotations

import numpy as np

from talus.llm._text import BLANK, Words, mix

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 small letter or non-ASCII, 2 capital, 3 digit, 4 blank, 5 line break, 6 other mark
_KIND[128:] = 1
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[BLANK] = 4
_KIND[10] = 5
_KIND[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'\"-()?"]] = 6

NAMES = (
    "log_words", "log_lines", "capitals", "digits", "marks", "stops", "blank", "letters_per_word", "word_spread", "distinct", "repeats", "second_repeats",
    "top_word", "marked_words", "bare_marks", "line_length", "short_lines", "repeated_lines", "capital_words", "top_pair",
)


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    return sums[first[1:]] - sums[first[:-1]]


def _top_and_distinct(keys: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Count of the commonest key of each text, and number of different keys."""
    key = np.sort(text.astype(np.uint64) << np.uint64(40) | keys >> np.uint64(24))  # 40 bits of a hash tell a text's keys apart well enough to count them
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    of, size = (key[at] >> np.uint64(40)).astype(np.int64), np.diff(np.append(at, len(key)))
    top = np.zeros(n)
    if len(at):
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        top[of[starts]] = np.maximum.reduceat(size, starts)
    return top, np.bincount(of, minlength=n).astype(np.float64)


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text; zeros for an empty one."""
    n = len(offsets) - 1
    w = Words(data, offsets)
    kind = _KIND[data]
    share = lambda k: _per_text(kind == k, offsets) / np.maximum(1, np.diff(offsets))
    words = np.diff(w.first).astype(np.float64)
    some = np.maximum(1, words)
    size = (w.end - w.start).astype(np.float64)
    mean = _per_text(size, w.first) / some
    spread = np.sqrt(np.maximum(0, _per_text(size * size, w.first) / some - mean**2))
    same = lambda lag: np.concatenate([(w.hash[lag:] == w.hash[:-lag]) & (w.text[lag:] == w.text[:-lag]), np.zeros(min(lag, len(w.hash)), bool)])
    top, distinct = _top_and_distinct(w.hash, w.text, n)
    pair = mix(w.hash[:-1] * np.uint64(3) + w.hash[1:])
    pairs, _ = _top_and_distinct(pair, w.text[:-1], n) if len(pair) else (np.zeros(n), None)
    last = kind[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    bare = np.zeros(len(w.hash), bool)
    if len(w.hash):
        letters = np.concatenate([np.zeros(1, np.int64), np.cumsum((kind == 1) | (kind == 2) | (kind == 3))])
        capital = np.concatenate([np.zeros(1, np.int64), np.cumsum(kind == 2)])
        bare = letters[w.end] == letters[w.start]
        shouted = (capital[w.end] - capital[w.start] == letters[w.end] - letters[w.start]) & ~bare & (size > 2)
    else:
        shouted = bare
    breaks = _per_text(kind == 5, offsets) + (np.diff(offsets) > 0)
    length = np.diff(offsets) / np.maximum(1, breaks)
    edge = np.flatnonzero(kind == 5)
    cuts = np.unique(np.concatenate([offsets[:-1], edge + 1, offsets[-1:]]))
    line_text = np.searchsorted(offsets, cuts[:-1], "right") - 1
    line_size = np.diff(cuts)
    short = np.bincount(line_text[line_size < 30], minlength=n).astype(np.float64)
    at = np.searchsorted(w.start, cuts)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash, dtype=np.uint64)])
    line_key = sums[at[1:]] - sums[at[:-1]]
    full = at[1:] > at[:-1]
    _, lines = _top_and_distinct(mix(line_key[full]), line_text[full], n)
    many = np.bincount(line_text[full], minlength=n).astype(np.float64)
    out = np.stack([
        np.log1p(words), np.log1p(breaks), share(2), share(3), share(6), _per_text(np.isin(data, [44, 46]), offsets) / some, share(4) + share(5), mean, spread, distinct / some,
        _per_text(same(1), w.first) / some, _per_text(same(2), w.first) / some, top / some, _per_text(last == 6, w.first) / some, _per_text(bare, w.first) / some, np.log1p(length),
        short / np.maximum(1, breaks), 1 - lines / np.maximum(1, many), _per_text(shouted, w.first) / some, pairs / some,
    ], axis=1)
    out[words == 0] = 0
    return out
