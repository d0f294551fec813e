"""Array-at-a-time word hashing over Arrow string columns: no Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _MOD = 0x9E3779B97F4A7C15 | 1, 1 << 64
_CHUNK = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse; those of usual lengths are kept."""
    if n > len(_POW):
        return tuple(_powers(b, n) for b in (_BASE, pow(_BASE, -1, _MOD)))
    return _POW, _INV


_POW, _INV = (_powers(b, _CHUNK + 2) for b in (_BASE, pow(_BASE, -1, _MOD)))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space and the controls 9 to 13 end a word.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: First bytes of three-byte characters from U+3000 to U+9FFF: kana and CJK ideographs.
_CJK = np.zeros(256, bool)
_CJK[0xE3:0xEA] = True
#: Every ASCII byte that is no letter or digit ends a word.
PUNCT = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input moves every bit of the result."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_null(a.type):
        a = a.cast(pa.string())
    if a.null_count:
        a = a.fill_null("")
    wide = pa.types.is_large_string(a.type)
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32, len(a) + 1, a.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch of texts: hash, text number, byte positions. ``first[i]:first[i+1]`` are those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, end: np.ndarray = BLANK, cjk: bool = False):
        """end: which bytes end a word; cjk: each CJK character is a word. Works in pieces of a quarter of a megabyte or one longer word, cut between words."""
        h, starts, ends = [], [], []
        at, n = 0, len(data)
        cut = offsets[:-1]
        while at < n:
            stop = min(n, at + _CHUNK)
            if stop < n:  # back to the end of a word, or on to the end of one longer than a piece
                gap = np.flatnonzero(end[data[at:stop]])
                i = int(np.searchsorted(cut, stop, "right"))
                back = max(at + int(gap[-1]) + 1 if len(gap) else at, int(cut[i - 1]))
                if back <= at:
                    gap = np.flatnonzero(end[data[stop:]])
                    back = min(stop + int(gap[0]) if len(gap) else n, int(cut[i]) if i < len(cut) else n)
                stop = back
            b = data[at:stop]
            pow_, inv = powers(len(b) + 1)
            blank = end[b]
            left = np.empty(len(b), bool)
            left[0], left[1:] = True, blank[:-1]
            inside = cut[np.searchsorted(cut, at) : np.searchsorted(cut, stop)] - at
            left[inside] = True
            if cjk:
                alone = np.flatnonzero(_CJK[b])
                left[alone] = True
                left[alone[alone + 3 < len(b)] + 3] = True
            right = np.empty(len(b), bool)
            right[-1], right[:-1] = True, left[1:] | blank[1:]
            s, e = np.flatnonzero(~blank & left), np.flatnonzero(~blank & right) + 1
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(_BYTE[LOWER[b]] * pow_[: len(b)], out=sums[1:])
            h.append(mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64)))
            starts.append(s + at)
            ends.append(e + at)
            at = stop
        self.hash = np.concatenate(h) if h else np.zeros(0, np.uint64)
        self.start = np.concatenate(starts) if h else np.zeros(0, np.int64)
        self.end = np.concatenate(ends) if h else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))


_GRAM = np.array([pow(0xD6E8FEB86659FD93, i + 1, _MOD) for i in range(64)], np.uint64)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k hashes; the order within a run counts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += hashes[i : i + n] * _GRAM[i]
    return mix(out)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole sequence, of any length."""
    out = np.uint64(len(hashes))
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 64):
            part = hashes[at : at + 64]
            out = mix((out + (part * _GRAM[: len(part)]).sum(dtype=np.uint64))[None])[0]
    return out


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of texts of at most so many bytes together (one text at least)."""
    at = 0
    while at < len(offsets) - 1:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, stop
        at = stop


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)
