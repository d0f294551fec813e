"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Words are lower-cased runs of letters, digits and non-ASCII characters; a CJK character is a word of its own, as its script has no
spaces. An item of m words matches a passage if at most k = floor(edit_ratio * m) words must be inserted, deleted or replaced. Items of
fewer than ``least_words`` words identify nothing and are left out (1 takes every item).

1. A random walk over words (CGK embedding: step j puts out the word x[i], and i moves on if a random bit of (j, x[i]) says so) maps a
   small edit distance to a small Hamming distance: two walks that meet on equal words stay together. Each walk is sampled at
   the places of its ``TABLES``; a table's key is the hash of the words put out there.
2. The items' walks, begun at each of their words, fill the tables (key -> item, place). A document's walks, begun at each of its words,
   are looked up: an equal key makes the item-sized window that lies around it a candidate. One key suffices, and every stretch of a
   passage between two edits offers some, so the repeated samples reach the recall below. Items of fewer than ``SHORT`` words are
   looked up by the exact runs that k edits must leave whole (k + 1 parts), which loses none.
3. A candidate goes on if k words at most of the item are missing from the window (a bound that loses none) and is then verified by the
   exact edit distance of the item to any passage of the window.

Measured over passages with as many random edits as the ratio allows (items of 8 to 60 words): 1.000 are found at 0.15 and 0.998 at
0.3 (0.954 of the items of 8 and 9 words); tests hold them to 0.99 and 0.93.

The items are a reference set, taken in blocks of about ``BLOCK_CHARS`` characters, each a broadcast of bounded size (some 40 MB at
most) and one pass over the documents; documents are never shuffled.
Cases: null and empty texts match nothing; texts of any length are searched whole; repeated rows give repeated results; null ids are
carried (``clean`` judges each row by itself, so a row with a null id goes too); null item texts are skipped; repeated items are reported
each; empty tables give empty results, or ``docs`` as it is; of ties in one document the lowest distance, then the earliest passage is
reported. Other columns are not read by ``contaminated`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import SparkSession

from talus.llm._store import small_batches
from talus.llm._text import PUNCT, Words, buffers, grams, mix, slices

#: Walks over the words, and for each its tables: the places of a walk that make a key. The first word always counts, so that words that
#: no item has need no walk; the others lie far enough apart to be words of their own as a rule.
TABLES = (((0, 2, 4), (0, 3, 6), (0, 4, 8)), ((0, 2, 5), (0, 3, 5), (0, 5, 9)))
SHORT = 8
BLOCK_CHARS = 1_000_000
#: Words of windows that are compared in one go: bounds the memory of a text that repeats one run of words over and over.
AT_ONCE = 1_000_000
#: Bits of the filter that most words of a document fail.
FILTER = 22


def allowance(m: int, edit_ratio: float) -> int:
    """Edits allowed in an item of m words (a ratio of 0.3 allows 3 in 10, whatever 0.3 * 10 is in binary)."""
    return int(edit_ratio * m + 1e-9)


def walk_keys(words: np.ndarray, at: np.ndarray, ends: np.ndarray, walk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each table of a walk that begins at the words ``at``, before ``ends``: the keys, and which of them are of distinct words
    inside."""
    moves = mix(words ^ np.uint64(0x9E3779B97F4A7C15 * (walk + 1) & (1 << 64) - 1))
    place, seen = at.copy(), {}
    wanted = sorted({p for t in TABLES[walk] for p in t})
    for j in range(wanted[-1] + 1):
        if j in wanted:
            seen[j] = place.copy()
        place += (moves[np.minimum(place, len(words) - 1)] >> np.uint64(j) & np.uint64(1)).astype(np.int64)
    for n, places in enumerate(TABLES[walk]):
        key, ok, last = np.full(len(at), n + 10 * walk, np.uint64), np.ones(len(at), bool), None
        for p in places:
            here = seen[p]
            ok &= here < ends
            if last is not None:
                ok &= here > last
            key = mix(key + words[np.minimum(here, len(words) - 1)])
            last = here
        yield key, ok


def passage_distance(item: np.ndarray, window: np.ndarray, k: int) -> tuple[int, int, int]:
    """Least edits between the item and a passage of the window, with the passage's first word and end: of equal ones the earliest, then
    shortest. More than k: (k + 1, 0, 0)."""
    at = np.arange(len(window) + 1, dtype=np.int64)
    one = np.int64(1) << 40  # a cost and the passage's first word in one number
    cost = at.copy()
    for i, x in enumerate(item, 1):
        step = np.minimum(cost[1:] + one, cost[:-1] + one * (window != x))
        row = np.concatenate([[i * one], step])
        cost = np.minimum.accumulate(row - at * one) + at * one
    j = int(cost.argmin())
    d, begin = int(cost[j] >> 40), int(cost[j] & (one - 1))
    return (d, begin, j) if d <= k else (k + 1, 0, 0)


def _sorted(keys: list[np.ndarray], items: list[np.ndarray], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, item, place = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (items, np.int32), (places, np.int32)))
    order = np.argsort(key, kind="stable")
    return key[order], item[order].astype(np.int32), place[order].astype(np.int32)


class Items:
    """Word hashes of the items, the tables of their walks, and the exact runs of the short ones."""

    def __init__(self, ids: list, texts: list, edit_ratio: float, least_words: int):
        data, offsets = buffers(pa.array(texts, pa.string()))
        w = Words(data, offsets, PUNCT, cjk=True)
        size = np.diff(w.first)
        some = [i for i in range(len(ids)) if size[i] >= max(least_words, 1)]
        self.ids = [ids[i] for i in some]
        self.words = [w.hash[w.first[i] : w.first[i + 1]] for i in some]
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.k = np.array([allowance(len(x), edit_ratio) for x in self.words], np.int64)
        number = np.repeat(np.arange(len(self.words)), self.size)
        flat = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        starts = np.cumsum(self.size) - self.size
        place = np.arange(len(flat)) - starts[number]
        self.has = np.unique(mix(flat + np.uint64(0x9E3779B97F4A7C15) * number.astype(np.uint64)))  # words of each item
        at = np.flatnonzero(self.size[number] >= SHORT)
        keys, items, places = [], [], []
        for walk in range(len(TABLES)) if len(at) else ():
            for key, ok in walk_keys(flat, at, (starts + self.size)[number[at]], walk):
                keys.append(key[ok])
                items.append(number[at[ok]])
                places.append(place[at[ok]])
        self.table = _sorted(keys, items, places)
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_run: dict[int, tuple[list, list, list]] = {}
        for i in np.flatnonzero(self.size < SHORT).tolist():
            parts = int(self.k[i]) + 1
            n = int(self.size[i]) // parts
            if n:
                held = by_run.setdefault(n, ([], [], []))
                held[0].append(grams(self.words[i], n)[np.arange(parts) * n])
                held[1].append(np.full(parts, i))
                held[2].append(np.arange(parts) * n)
        self.runs = {n: _sorted(*held) for n, held in by_run.items()}
        self.first_words = np.unique(flat)

    def filters(self) -> tuple[np.ndarray, np.ndarray]:
        """Which low bits the words and the keys of the items have; made in the task, not sent."""
        out = np.zeros((2, 1 << FILTER), bool)
        for row, x in zip(out, (self.first_words, self.table[0]), strict=True):
            row[x & np.uint64((1 << FILTER) - 1)] = True
        return out[0], out[1]


def _found(table: tuple[np.ndarray, np.ndarray, np.ndarray], key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, first word of its window) for each entry of the table that has the key of a word."""
    lo, hi = np.searchsorted(table[0], key, "left"), np.searchsorted(table[0], key, "right")
    n = hi - lo
    pick = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return table[1][pick].astype(np.int64), np.repeat(at, n) - table[2][pick]


def candidates(items: Items, filters, words: np.ndarray, text: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, text, first word of the window), a table at a time."""
    known, keyed = filters
    mask = np.uint64((1 << FILTER) - 1)
    at = np.flatnonzero(known[words & mask])
    ends = first[text[at] + 1]
    for walk in range(len(TABLES)) if len(items.table[0]) else ():
        for key, ok in walk_keys(words, at, ends, walk):
            some = np.flatnonzero(ok & keyed[key & mask])
            item, start = _found(items.table, key[some], at[some])
            yield item, np.repeat(text[at[some]], np.searchsorted(items.table[0], key[some], "right") - np.searchsorted(items.table[0], key[some], "left")), start
    for n, table in items.runs.items():
        g = grams(words, n)
        some = np.flatnonzero(np.isin(g, table[0]) & (text[: len(g)] == text[n - 1 :]))
        item, start = _found(table, g[some], some)
        yield item, np.repeat(text[some], np.searchsorted(table[0], g[some], "right") - np.searchsorted(table[0], g[some], "left")), start


def near_enough(items: Items, words: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the window has all but k words of the item at least: no more than k edits can take away."""
    size = end - begin
    row = np.repeat(np.arange(len(item)), size)
    w = words[np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    key = mix(w + np.uint64(0x9E3779B97F4A7C15) * item[row].astype(np.uint64))
    place = np.minimum(np.searchsorted(items.has, key), len(items.has) - 1)
    return np.bincount(row, items.has[place] == key, len(item)) >= items.size[item] - items.k[item]


def matches(items: Items, filters, words: np.ndarray, text: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, first word, words) of the best passage of each text and item. text and first as in Words."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    if not len(words) or not len(items.size):
        return []
    found = [np.stack(c, axis=1) for c in candidates(items, filters, words, text, first)]
    window = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    item, doc, start = window.T
    begin = np.maximum(start - items.k[item], first[doc])
    end = np.minimum(start + items.size[item] + items.k[item], first[doc + 1])
    ends, cut, good = np.cumsum(end - begin), 0, []
    while cut < len(item):
        stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + AT_ONCE, "right")))
        good.append(cut + np.flatnonzero(near_enough(items, words, item[cut:stop], begin[cut:stop], end[cut:stop])))
        cut = stop
    good = np.concatenate(good) if good else np.zeros(0, np.int64)
    item, doc, begin, end = item[good], doc[good], begin[good], end[good]
    # overlapping windows of one item are one: the distance is to any passage inside (ends grow with starts, but at a text's edges)
    apart = np.ones(len(item), bool)
    apart[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (begin[1:] >= end[:-1])
    heads = np.flatnonzero(apart)
    last = np.maximum.reduceat(end, heads) if len(heads) else end
    for i, b in zip(heads.tolist(), last.tolist(), strict=True):
        key, a = (int(doc[i]), int(item[i])), int(begin[i])
        if key in best and best[key][0] == 0:
            continue
        d, x, y = passage_distance(items.words[key[1]], words[a:b], int(items.k[key[1]]))
        if d <= items.k[key[1]]:
            one = (d, a + x - int(first[key[0]]), y - x)
            best[key] = min(best.get(key, one), one)
    return [(*key, *one) for key, one in sorted(best.items())]


def _each(shared, batches):
    """(batch, range of its rows, their matches)."""
    items = shared.value
    filters = items.filters()
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for lo, hi in slices(offsets):
            w = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], PUNCT, cjk=True)
            yield batch, lo, hi, items, matches(items, filters, w.hash, w.text, w.first)


def _scan(shared):
    def run(batches):
        for batch, lo, _, items, rows in _each(shared, batches):
            ids = batch.column("doc_id")
            doc = ids.take(pa.array([lo + r[0] for r in rows], pa.int64()))
            own = [pa.array([items.ids[r[1]] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3, 4))]
            yield pa.record_batch([doc, *own], ["doc_id", "item_id", "edits", "first_word", "n_words"])

    return run


def _keep(shared):
    def run(batches):
        for batch, lo, hi, _, rows in _each(shared, batches):
            clean_ = np.ones(hi - lo, bool)
            clean_[[r[0] for r in rows]] = False
            yield batch.slice(lo, hi - lo).filter(pa.array(clean_))

    return run


def _blocks(docs: DataFrame, benchmark: DataFrame, edit_ratio: float, least_words: int):
    """A broadcast of the items of each block."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.where("text IS NOT NULL").selectExpr("CAST(item_id AS BIGINT) AS item_id", "CAST(text AS STRING) AS text")
    size = items.agg(F.sum(F.length("text") + 8)).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS) or 1
    for k in range(blocks):
        part = (items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items).collect()
        yield spark.sparkContext.broadcast(Items([r[0] for r in part], [r[1] for r in part], edit_ratio, least_words))


def contaminated(docs: DataFrame, benchmark: DataFrame, edit_ratio: float = 0.15, least_words: int = 6) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, edits, first_word, n_words."""
    texts = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").where("text IS NOT NULL")
    found = None
    for shared in _blocks(docs, benchmark, edit_ratio, least_words):
        rows = texts.mapInArrow(_scan(shared), "doc_id long, item_id long, edits long, first_word long, n_words long")
        found = rows if found is None else found.unionByName(rows)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, edit_ratio: float = 0.15, least_words: int = 6) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    schema = docs.schema
    for shared in _blocks(docs, benchmark, edit_ratio, least_words):
        docs = docs.mapInArrow(_keep(shared), schema)
    return docs


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return contaminated(read("documents").select("doc_id", "text"), read("benchmark"))


QUERIES = {"op10_benchmark_decontamination": op10_benchmark_decontamination}
