"""Line dedup by a deletion-neighbourhood join.

Two lines are near-equal if at most one word was inserted, deleted or replaced, by words of the lower-cased line; lines of fewer
than ``fuzzy_words`` words must be equal (any two lines of one word are one replacement apart, so 2 is the least that means anything), and
lines of fewer than ``least_words`` words always stay. By default no line with a word is left out. A line goes if any earlier line
(smaller doc_id, then smaller line number) of the whole input is near-equal to it; what stays is joined again in its order.

1. Equal lines are grouped (minima are combined before the shuffle): all but the earliest go. What is kept of a document are the numbers of
   its lines that are the earliest of their kind, so lines are never joined with their groups.
2. Of the different lines, those that share the first or the last ``L`` words with another (one edit leaves one of both whole; L
   grows with the line) can have a partner; the others are done.
3. Each of those emits all variants with one word less as hashed keys, besides the whole line. Equal keys join: within one (key,
   position) every line is a replacement away from the earliest, and a whole line is a deletion away from every variant that
   equals it. The join is to the earliest of each key, so a group of n lines makes n pairs.
4. The edit distance of each pair is verified on the words.

Nothing is broadcast: line numbers meet their texts by a shuffle on doc_id, twice. What joins large tables of keys is written first, so that
Spark can split the partitions of a frequent key.

Cases: null and empty texts have no lines and come back as they are; blank lines stay; texts and lines of any length are compared whole;
rows of one doc_id count as one document: repeated rows lose the same lines, and of different texts under one doc_id each loses the lines whose
numbers are found in any; rows with a null
doc_id neither lose lines nor count as earlier ones; an empty table gives an empty one. Other columns are kept; a column n_removed
is replaced by the result. A text that loses all its lines becomes empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm._store import Workspace, small_batches
from talus.llm._text import Words, buffers, mix, powers, slices

#: Names of columns that stand beside those of the input for a while.
_ID, _LIST = "_talus_id", "_talus_lines"


def levels_of(sizes: np.ndarray, fuzzy_words: int) -> list[int]:
    """How many first or last words a line may have to share with one of a word more or less, or as many, and at most one edit:
    ``half`` holds for the lines of 2 * half to 4 * half words, so that two such lines always have a level in common."""
    most = int(sizes.max()) if len(sizes) else 0
    return [half for half in (1 << i for i in range(40)) if fuzzy_words < 4 * half and 2 * half <= most]


class Ranges:
    """Hashes of ranges of a sequence of words, by sums of the words times powers of a base: equal ranges have equal hashes wherever they
    stand."""

    def __init__(self, words: np.ndarray):
        self.pow, self.inv = powers(len(words) + 2)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * self.pow[: len(words)], dtype=np.uint64)]) for x in (words, mix(words ^ np.uint64(0x5851F42D4C957F2D)))]

    def of(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        """Of the words a to b, less its last touch (``mix``)."""
        return (self.sums[which][b] - self.sums[which][a]) * self.inv[a]

    def lines(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each range."""
        return tuple(mix(self.of(a, b, i) + (b - a).astype(np.uint64)) for i in (0, 1))

    def variants(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each range its first hash, then those of it without its i-th word for every i; and where each range's end."""
        n = b - a
        ends = np.cumsum(n + 1)
        row = np.repeat(np.arange(len(n)), n + 1)
        i = np.arange(len(row)) - (ends - n - 1)[row] - 1  # -1: the whole
        lo, hi, at = a[row], b[row], np.maximum(a[row] + i, a[row])
        key = self.of(lo, at) + (self.sums[0][hi] - self.sums[0][at + 1]) * self.inv[lo + 1] + (n[row] - 1).astype(np.uint64)
        whole = self.of(lo, hi) + n[row].astype(np.uint64)
        return mix(np.where(i < 0, whole, key)), ends


def split_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first and last byte of each line of a batch; empty texts have none."""
    breaks, some = np.flatnonzero(data == 10), np.flatnonzero(np.diff(offsets))
    # a text's end and a newline at the start of the next one are two ends at one offset
    text = np.concatenate([np.searchsorted(offsets, breaks, "right") - 1, some])
    ends = np.concatenate([breaks, offsets[some + 1]])
    order = np.lexsort((ends, text))
    text, ends = text[order], ends[order]
    first = np.concatenate([[True], text[1:] != text[:-1]])[: len(text)]
    return text, np.where(first, offsets[text], np.roll(ends, 1) + 1), ends


def _numbered(text: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each run of one text."""
    first = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
    at = np.arange(len(text))
    return at - np.maximum.accumulate(np.where(first, at, 0)) if len(text) else at


def _each(batch, column="text"):
    """Slices of a batch: range of rows, their words, and per line: text, number in the text, range of words."""
    data, offsets = buffers(batch.column(column))
    for lo, hi in slices(offsets, 1 << 19):
        part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        text, start, end = split_lines(part, off)
        w = Words(part, off)
        yield lo, hi, w, text, _numbered(text), np.searchsorted(w.start, start), np.searchsorted(w.start, end)


def _lines(least_words: int, fuzzy_words: int):
    def run(batches):
        for batch in batches:
            for lo, hi, w, text, number, a, b in _each(batch):
                ids = batch.column("doc_id").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                some = np.flatnonzero(b - a >= max(1, least_words))
                a, n, ranges = a[some], (b - a)[some], Ranges(w.hash)
                h1, h2 = ranges.lines(a, a + n)
                line, key = [], []
                for half in levels_of(n, fuzzy_words):
                    at = np.flatnonzero((n >= max(2 * half, fuzzy_words)) & (n <= 4 * half))
                    for side, first in enumerate((a[at], a[at] + n[at] - half)):
                        line.append(at)
                        key.append(mix(ranges.of(first, first + half) + np.uint64(2 * half + side)))
                line, key = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((line, np.int64), (key, np.uint64)))
                order = np.argsort(line, kind="stable")
                ends = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(line[order], np.arange(len(some) + 1)), pa.int32()),
                    pa.array(key[order].view(np.int64), pa.int64()),
                )
                yield pa.record_batch(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids[text[some]], pa.int64()), pa.array(number[some], pa.int32()), ends],
                    ["h1", "h2", "doc_id", "line", "ends"],
                )

    return run


def _lists(column: pa.Array) -> np.ndarray:
    """(row, number) of a column of lists of line numbers, each once, in order; null counts as empty."""
    column = column.fill_null([]) if column.null_count else column
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    return np.unique(np.stack([row, column.flatten().to_numpy().astype(np.int64)], axis=1), axis=0) if len(row) else np.zeros((0, 2), np.int64)


def _variants(batches):
    """For the lines that ``_LIST`` names: keys with the place of the missing word (first the whole line), and the words themselves."""
    for batch in batches:
        for lo, hi, w, text, number, a, b in _each(batch):
            ids = batch.column(_ID).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
            pair = _lists(batch.column(_LIST).slice(lo, hi - lo))
            first = np.searchsorted(text, np.arange(hi - lo + 1))
            row, at = pair[:, 0], first[pair[:, 0]] + pair[:, 1]
            there = at < first[row + 1]
            row, at, line = row[there], at[there], pair[there, 1]
            keys, ends = Ranges(w.hash).variants(a[at], b[at])
            n = b[at] - a[at]
            place = np.repeat(a[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            words = pa.py_buffer(w.hash[place].astype(np.uint32).tobytes())
            own = [
                pa.array(ids[row], pa.int64()),
                pa.array(line, pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(keys.view(np.int64))),
                pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], 4 * np.cumsum(n)]).astype(np.int32).tobytes()), words]),
            ]
            yield pa.record_batch(own, ["doc_id", "line", "keys", "words"])


def within_one(a: np.ndarray, b: np.ndarray) -> bool:
    """At most one word inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    n = len(a)
    differ = np.flatnonzero(a != b[:n])
    if len(differ) == 0:
        return True
    i = int(differ[0])
    return bool((a[i + 1 :] == b[i + 1 :]).all()) if len(b) == n else bool((a[i:] == b[i + 1 :]).all())


def _verify(batches):
    for batch in batches:
        ok = [within_one(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist(), strict=True)]
        yield batch.select(["doc_id", "line"]).filter(pa.array(ok, pa.bool_()))


def _without(least_words: int):
    """Texts less their lines of ``least_words`` words that ``_LIST`` doesn't name; a row without a number (``_ID``) keeps all."""

    def run(batches):
        for batch in batches:
            for lo, hi, _, text, number, a, b in _each(batch):
                part = batch.slice(lo, hi - lo)
                kept = _lists(part.column(_LIST))
                counts = b - a >= max(1, least_words)
                known = ~part.column(_ID).is_null().to_numpy(zero_copy_only=False)
                key = lambda r, n: r.astype(np.int64) << 32 | n
                gone = counts & known[text] & ~np.isin(key(text, number), key(kept[:, 0], kept[:, 1]))
                removed = np.bincount(text[gone], minlength=hi - lo)
                texts = part.column("text")
                if removed.any():
                    texts, lost = texts.to_pylist(), {}
                    for i, n in zip(text[gone].tolist(), number[gone].tolist(), strict=True):
                        lost.setdefault(i, set()).add(n)
                    for i, numbers in lost.items():
                        texts[i] = "\n".join(x for n, x in enumerate(texts[i].split("\n")) if n not in numbers)
                at = part.schema.get_field_index("text")
                part = part.set_column(at, "text", pa.array(texts, part.schema.field(at).type) if isinstance(texts, list) else texts)
                names = [c for c in part.schema.names if c not in (_ID, _LIST)]
                yield pa.record_batch([*(part.column(c) for c in names), pa.array(removed, pa.int32())], [*names, "n_removed"])

    return run


def _with_lines(docs: DataFrame, lines: DataFrame, how: str) -> DataFrame:
    """docs with the array of line numbers of each doc_id."""
    lists = lines.groupBy(F.col("doc_id").alias(_ID)).agg(F.collect_list("line").alias(_LIST))
    return docs.withColumn(_ID, F.col("doc_id").cast("long")).join(lists.hint("merge"), _ID, how)


def kept_lines(docs: DataFrame, least_words: int = 1, fuzzy_words: int = 2) -> DataFrame:
    """(doc_id, line) of every line of ``least_words`` words that has no earlier near-equal line."""
    small_batches(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "lines")
    texts = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = texts.mapInArrow(_lines(least_words, max(2, fuzzy_words)), "h1 long, h2 long, doc_id long, line int, ends array<long>")
    first = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line", "ends")).alias("at")).select("at.*")
    first = ws.put("first", first)
    ends = first.selectExpr("doc_id", "line", "explode(ends) AS key")
    shared = ws.put("shared", ends.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    some = ws.put("some", ends.join(shared.hint("merge"), "key").select("doc_id", "line").distinct())
    given = _with_lines(texts, some, "inner").groupBy(_ID).agg(F.min("text").alias("text"), F.first(_LIST).alias(_LIST))  # repeated rows once
    v = ws.put("variants", given.mapInArrow(_variants, "doc_id long, line int, keys array<long>, words binary"))
    keys = v.selectExpr("posexplode(keys) AS (place, key)", "struct(doc_id, line) AS at")
    met = ws.put("met", keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    keys = ws.put("keys", keys.join(met.hint("merge"), "key"))
    # each line meets the earliest at its place, and whole lines the earliest variant
    least = keys.groupBy("key", "place").agg(F.min("at").alias("least"))
    tops = least.groupBy("key").agg(F.min(F.when(F.col("place") == 0, F.col("least"))).alias("whole"), F.min(F.when(F.col("place") > 0, F.col("least"))).alias("part"))
    least = ws.put("least", least.join(tops, "key"))
    pairs = keys.join(least.hint("merge"), ["key", "place"]).selectExpr(
        "at",
        "explode(array(least, CASE WHEN place = 0 THEN part ELSE whole END)) AS other",
    ).where("other < at").distinct()
    words = lambda c, o: v.selectExpr(f"struct(doc_id, line) AS {c}", f"words AS {o}")
    near = pairs.join(words("at", "wa"), "at").join(words("other", "wb"), "other").select("at.doc_id", "at.line", "wa", "wb").mapInArrow(_verify, "doc_id long, line int")
    near = ws.put("near", near.distinct())
    kept = ws.put("kept", first.select("doc_id", "line").join(near.hint("merge"), ["doc_id", "line"], "left_anti"))
    ws.drop("first", "shared", "some", "variants", "met", "keys", "least", "near")
    return kept


def dedup_lines(docs: DataFrame, least_words: int = 1, fuzzy_words: int = 2) -> DataFrame:
    """``docs`` with its texts less the lines that repeat an earlier one, and n_removed."""
    docs = docs.drop("n_removed")
    both = _with_lines(docs, kept_lines(docs, least_words, fuzzy_words), "left").select(*[F.col(f"`{c}`") for c in docs.columns], _ID, _LIST)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_removed", T.IntegerType())])
    return both.mapInArrow(_without(least_words), schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).selectExpr("doc_id", "CAST(n_removed AS BIGINT) AS n_removed", "CAST(length(text) AS BIGINT) AS n_chars", "sha2(text, 256) AS text_sha256")


QUERIES = {"op5_line_dedup": op5_line_dedup}
