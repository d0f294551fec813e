"""Suffix-array dedup: every byte of a text that a 200-byte string covers which also starts anywhere else goes.

Strings of 200 bytes that are equal have the same least hash among their 64-byte grams, at the same place (the leftmost of equal ones). So texts
are cut, by content alone, into pieces: runs of neighbouring strings with one least gram, their anchor. Equal strings are always in pieces
of one anchor, and two pieces with equal bytes hold the same strings. What follows is

1. pieces as rows of hashes; anchors that occur once drop out, and pieces that occur twice are repeated as a whole;
2. anchors with unlike pieces (where copies begin, end or differ): their unlike pieces, each once, are dealt out by anchor into shards of about
   a megabyte. A shard's suffix array is made by induced sorting: suffixes are classified by whether they are smaller than the next one, the
   leftmost-smaller substrings are sorted by inducing from their places in the text and named, equal names are told apart by the same procedure
   over the string of names, and from the sorted ones all others are induced in linear time. Common prefixes with the neighbour above are computed in
   text order (permuted): where the bytes before differ they are compared, elsewhere they are one less than at the place before. A string is
   repeated if it shares 200 bytes with a neighbour in the array;
3. an anchor with more unlike pieces than a shard takes (``many``) is not sorted by one task: its strings are counted by hash, which combines before
   the shuffle. Both ways give the same result;
4. repeated strings come back to the texts as ranges, and the bytes that they cover go.

Texts that are equal share one key (96 bits of hash), so that copies ask and are answered once. Pieces are told apart by two hashes of 64 bits, as
are the strings of step 3; all else is compared byte by byte.

Cases: a null text counts as empty; texts under 200 bytes stay as they are; overlapping repetitions within one text count, so a long run of one
letter goes; texts of any length are worked on in slices, whole; repeated rows are copies and lose what they share, wholly; a null or
repeated doc_id changes nothing, as ids aren't used; an empty table gives an empty one. What is kept is binary, as a cut can split a character.
Columns named n_bytes, spans and kept are replaced; the others stay.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from talus.llm._store import Workspace, small_batches
from talus.llm._text import _BYTE, buffers, mix, powers, signed

#: Bytes of a repeated string and of an anchor's gram; unlike pieces of an anchor that one shard sorts; bytes of a shard, of a slice of text.
WINDOW, GRAM, MANY, SHARD, SLICE = 200, 64, 2048, 1 << 20, 1 << 20
#: Each window is in one of so many ranges of places left of its anchor; windows of a range share their middle bytes.
RANGES = 4
_PLACE = np.uint64((1 << 22) - 1)
_KEYS = ["_k1", "_k2"]


# pieces


class Slice:
    """Rolling hashes of joined texts: any substring's hash is a difference of two sums."""

    def __init__(self, data: np.ndarray):
        self.data, n = data, len(data)
        pow_, self.inv = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * pow_[:n], out=self.sums[1:])

    def hash(self, a: np.ndarray, b: np.ndarray, salt: int | np.ndarray = 0) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inv[a] + np.asarray(salt).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each gram, and for each window the place of its least gram, by minima of blocks from both ends."""
        width = WINDOW - GRAM + 1
        gram = mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.inv[: len(self.sums) - GRAM])
        n = len(gram)
        blocks = np.full((-(-n // width), width), np.uint64(2**64 - 1))
        blocks.ravel()[:n] = gram & ~_PLACE | np.arange(n, dtype=np.uint64)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        most = n - width + 1
        return gram, (np.minimum(behind[:most], ahead[width - 1 : width - 1 + most]) & _PLACE).astype(np.int64)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of joined texts: (text, first window, windows, anchor's hash, piece's hash) of each piece."""
    if len(data) < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    s = Slice(data)
    gram, at = s.anchors()
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    inside = np.arange(len(at)) + WINDOW <= offsets[1:][text]
    first = inside.copy()
    first[1:] &= ~(inside[:-1] & (at[1:] == at[:-1]))
    a = np.flatnonzero(first)
    stops = np.append(np.flatnonzero(first | ~inside), len(at))
    n = stops[np.searchsorted(stops, a, "right")] - a
    return text[a], a - offsets[text[a]], n, gram[at[a]], s.hash(a, a + n + WINDOW - 1, n)


def _slices(data: np.ndarray, offsets: np.ndarray):
    """(first text, joined bytes, offsets, place of the first byte in its text): whole texts together, long ones in parts that overlap by a window
    less one."""
    i = 0
    while i < len(offsets) - 1:
        size = offsets[i + 1] - offsets[i]
        if size > SLICE:
            for at in range(0, int(size) - WINDOW + 1, SLICE):
                part = data[offsets[i] + at : min(offsets[i] + at + SLICE + WINDOW - 1, offsets[i + 1])]
                yield i, part, np.array([0, len(part)]), at
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], 0
        i = j


_PIECES = "_k1 long, _k2 int, h long, p long, start long, n int, m int"


def _piece_rows(batches):
    """A row for each unlike piece of a text (m: how often it is there), and a row without hash for each place of those that are there more
    than once: these are repeated whatever else there is."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in _KEYS)
        for i, part, off, at in _slices(data, offsets):
            text, start, n, h, p = pieces(part, off)
            if not len(text):
                continue
            order = np.lexsort((start, p, h, text))
            text, start, n, h, p = text[order] + i, start[order] + at, n[order], h[order], p[order]
            new = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1]) | (p[1:] != p[:-1]))
            group = np.cumsum(new) - 1
            m = np.bincount(group)
            own = np.flatnonzero(m[group] > 1)
            rows = np.append(np.flatnonzero(new), own)
            hashed = np.arange(len(rows)) < len(m)
            one = lambda v: pa.array(signed(v[rows]), mask=~hashed)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[text[rows]]), pa.array(k2[text[rows]]), one(h), one(p), pa.array(start[rows]), pa.array(n[rows].astype(np.int32)), pa.array(np.append(m, np.zeros(len(own))).astype(np.int32))],
                names=[*_KEYS, "h", "p", "start", "n", "m"],
            )


# suffix arrays


def smaller(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it (the last counts so)."""
    up = np.sign(np.diff(s))
    turn = np.where(up != 0, np.arange(len(up)), len(up))
    nearest = np.minimum.accumulate(turn[::-1])[::-1]
    return np.append(np.append(up, 1)[nearest] > 0, True)


def _induced_in_buckets(s: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """For few letters: a letter's bucket is scanned at a time, wave by wave where a suffix induces one of the same bucket."""
    rising, falling, known = ([[] for _ in range(k)] for _ in range(3))
    none = np.zeros(0, np.int64)
    joined = lambda parts: np.concatenate(parts) if parts else none

    def deal(found: np.ndarray, to: list) -> None:
        c = s[found]
        order = np.argsort(c, kind="stable")
        cuts = np.flatnonzero(np.diff(c[order])) + 1
        for part in np.split(found[order], cuts) if len(c) else ():
            to[s[part[0]]].append(part)

    def scan(c: int, now: np.ndarray, to: list, kind: bool) -> None:
        while len(now):
            before = now[now > 0] - 1
            before = before[small[before] == kind]
            own = s[before] == c
            deal(before[~own], to)
            now = before[own]
            if len(now):
                to[c].append(now)

    deal(lms, known)
    for c in range(k):
        scan(c, joined(rising[c]), rising, False)
        scan(c, joined(known[c]), rising, False)
    falling[0].append(np.array([len(s) - 1]))
    for c in range(k - 1, 0, -1):
        scan(c, joined(falling[c]), falling, True)
        scan(c, joined(rising[c])[::-1], falling, True)
    return np.concatenate([x for c in range(k) for x in (joined(rising[c]), joined(falling[c])[::-1])])


def _induced_by_rows(s: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """For many letters: one scan up and one down over the array that is being filled. ``letter``: of the suffix to induce, -1 for none."""
    ends = np.cumsum(np.bincount(s, minlength=k))
    before = np.append(-1, s[:-1])
    letter = lambda kind: np.append(np.where(np.append(not kind, small[:-1]) == kind, before, -1), -1).tolist()
    tails, sa = ends.tolist(), [-1] * len(s)
    for i, c in zip(lms[::-1].tolist(), s[lms[::-1]].tolist(), strict=True):
        tails[c] -= 1
        sa[tails[c]] = i
    left, heads = letter(False), np.append(0, ends[:-1]).tolist()
    for j in sa:
        c = left[j]
        if c >= 0:
            sa[heads[c]] = j - 1
            heads[c] += 1
    left, tails = letter(True), ends.tolist()
    for j in reversed(sa):
        c = left[j]
        if c >= 0:
            tails[c] -= 1
            sa[tails[c]] = j - 1
    return np.array(sa)


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of leftmost-smaller substrings in their order; equal ones share a rank."""
    length = np.zeros(len(s), np.int64)
    length[lms] = np.append(lms[1:], lms[-1]) - lms + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    open_, t = np.flatnonzero(same), 0
    while len(open_):
        open_ = open_[length[a[open_]] > t]
        equal = s[a[open_] + t] == s[b[open_] + t]
        same[open_[~equal]] = False
        open_, t = open_[equal], t + 1
    return np.append(0, np.cumsum(~same))


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the suffixes of s in their order, by induced sorting. s: letters under k, with a 0 at its end and nowhere else."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    small = smaller(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induced = _induced_in_buckets if k <= 300 else _induced_by_rows
    first = np.zeros(len(s), bool)
    first[lms] = True
    order = induced(s, small, lms, k)
    order = order[first[order]]
    name = _names(s, lms, order)
    if name[-1] + 1 < len(lms):  # some are equal: their order is that of the suffixes of the string of names
        named = np.zeros(len(s), np.int64)
        named[order] = name
        order = lms[suffix_array(named[lms], int(name[-1]) + 1)]
    return induced(s, small, order, k)


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, in text order: how much its suffix shares with the one before it in the array (the first shares nothing)."""
    n = len(s)
    above = np.full(n, -1)
    above[sa[1:]] = sa[:-1]
    place = np.arange(n)
    one = above < 0
    # one less than at the place before, wherever the letters before are equal
    fresh = one | (above == 0) | (place == 0)
    fresh[1:] |= s[place[1:] - 1] != s[np.maximum(above[1:] - 1, 0)]
    found = np.zeros(n, np.int64)
    i = np.flatnonzero(fresh & ~one)
    j = above[i]
    padded = np.append(s, np.full(16, -1))
    at, step = np.zeros(len(i), np.int64), np.arange(16)
    open_ = np.arange(len(i))
    while len(open_):
        a, b = i[open_] + at[open_], j[open_] + at[open_]
        unlike = padded[a[:, None] + step] != padded[b[:, None] + step]
        run = np.where(unlike.any(axis=1), unlike.argmax(axis=1), 16)
        at[open_] += run
        open_ = open_[run == 16]
    found[i] = at
    last = np.maximum.accumulate(np.where(fresh, place, 0))
    return np.maximum(found[last] - (place - last), 0)


def repeated(texts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of joined pieces: the places where a string of WINDOW bytes begins that begins elsewhere too."""
    n = np.diff(offsets)
    s = np.ones(len(texts) + len(n) + 1, np.int64)  # 1 parts the pieces, 0 ends all
    own = np.arange(len(texts)) + np.repeat(np.arange(len(n)), n)
    s[own] = texts.astype(np.int64) + 2
    s[-1] = 0
    sa = suffix_array(s, 258)
    shared = common_prefixes(s, sa)[sa] >= WINDOW
    hit = np.zeros(len(s), bool)
    hit[sa[shared]] = True
    hit[sa[np.flatnonzero(shared) - 1]] = True
    hit = hit[own]
    hit[np.arange(len(texts)) + WINDOW > np.repeat(offsets[1:], n)] = False  # not within one piece
    return np.flatnonzero(hit)


def _alike(h: np.ndarray, texts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Pieces that may share a window with another of their anchor: windows of a range of places share their middle, so its hash must be there twice."""
    s = Slice(texts)
    _, at = s.anchors()
    a, stop = offsets[:-1], offsets[1:]
    anchor, step = at[a], (WINDOW - GRAM) // RANGES
    out = np.zeros(len(a), bool)
    for i in range(RANGES):
        low, high = np.maximum(a, anchor - step * (i + 1)), np.minimum(stop - WINDOW, anchor - step * i)
        some = np.flatnonzero(low <= high)
        core = s.hash(anchor[some] - step * i, anchor[some] - step * (i + 1) + WINDOW)
        order = np.lexsort((core, h[some]))
        same = (core[order][1:] == core[order][:-1]) & (h[some][order][1:] == h[some][order][:-1])
        out[some[order[:-1][same]]] = True
        out[some[order[1:][same]]] = True
    return out


_FOUND = "h long, p long, off int, n int"


def _ranges(h, p, owner: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Places in pieces as ranges (off, n)."""
    first = np.append(True, (owner[1:] != owner[:-1]) | (np.diff(place) != 1)) if len(place) else np.zeros(0, bool)
    a = np.flatnonzero(first)
    n = np.diff(np.append(a, len(place)))
    return pa.RecordBatch.from_arrays([pa.array(h[owner[a]]), pa.array(p[owner[a]]), pa.array(place[a].astype(np.int32)), pa.array(n.astype(np.int32))], names=["h", "p", "off", "n"])


def _sort_shards(batches):
    """Rows (h, p, piece) in the order of h: whole anchors are gathered until a shard is full, then sorted."""

    def sort(t: pa.Table) -> pa.RecordBatch:
        data, offsets = buffers(t.column("piece"))
        h, p = (t.column(c).to_numpy() for c in ("h", "p"))
        some = np.flatnonzero(_alike(h, data, offsets))
        size = np.diff(offsets)[some]
        off = np.append(0, np.cumsum(size))
        texts = data[np.repeat(offsets[some] - off[:-1], size) + np.arange(off[-1])]
        at = repeated(texts, off) if len(some) else np.zeros(0, np.int64)
        owner = np.searchsorted(off, at, "right") - 1
        return _ranges(h[some], p[some], owner, at - off[owner])

    held, size = [], 0
    for batch in batches:
        t = pa.Table.from_batches([batch])
        at = 0
        ids = t.column("h").to_numpy()
        for cut in np.append(np.flatnonzero(np.diff(ids)) + 1, len(ids)).tolist():
            last = held[-1].column("h")[-1].as_py() if held else None
            if size >= SHARD and last is not None and ids[at] != last:
                yield sort(pa.concat_tables(held))
                held, size = [], 0
            part = t.slice(at, cut - at)
            held.append(part)
            size += part.column("piece").nbytes
            at = cut
    if held:
        yield sort(pa.concat_tables(held))


def _window_rows(batches):
    """Every string of a piece by the hashes of its halves."""
    for batch in batches:
        data, offsets = buffers(batch.column("piece"))
        s = Slice(data)
        n = np.diff(offsets) - WINDOW + 1
        owner = np.repeat(np.arange(len(n)), n)
        off = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        at = offsets[owner] + off
        h, p = (batch.column(c).to_numpy() for c in ("h", "p"))
        half = [signed(s.hash(at + i * WINDOW // 2, at + (i + 1) * WINDOW // 2)) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(h[owner]), pa.array(p[owner]), pa.array(off.astype(np.int32)), *map(pa.array, half)], names=["h", "p", "off", "w1", "w2"])


# texts


def _packed(batches):
    for batch in batches:
        i = batch.schema.get_field_index("text")
        data, offsets = buffers(batch.column(i))
        packed = [zlib.compress(data[a:b].tobytes(), 1) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield batch.set_column(i, "text", pa.array(packed, pa.binary()))


def _cut_out(batches):
    """(text, _asked: [h, p, start, n]) -> (h, p, piece)."""
    for batch in batches:
        h, p, out = [], [], []
        for text, asked in zip(batch.column("text"), batch.column("_asked").to_pylist(), strict=True):
            text = zlib.decompress(text.as_py())
            for x in asked:
                h.append(x["h"])
                p.append(x["p"])
                out.append(text[x["start"] : x["start"] + x["n"] + WINDOW - 1])
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(p, pa.int64()), pa.array(out, pa.binary())], names=["h", "p", "piece"])


def _finish(batches):
    """Texts without the bytes that the windows in ``_found`` cover."""
    for batch in batches:
        size, spans, kept = [], [], []
        for text, found in zip(batch.column("text"), batch.column("_found").to_pylist(), strict=True):
            text = zlib.decompress(text.as_py())
            covered = np.zeros(len(text) + 1, np.int64)
            for x in found or ():
                covered[x["start"]] += 1
                covered[x["start"] + x["n"] + WINDOW - 1] -= 1
            gone = np.cumsum(covered) > 0
            edge = np.flatnonzero(np.diff(np.append(False, gone).astype(np.int8))).tolist()
            size.append(len(text))
            spans.append([{"start": a, "stop": b} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            kept.append(np.frombuffer(text, np.uint8)[~gone[:-1]].tobytes() if edge else text)
        batch = batch.drop_columns(["text", "_found"])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for name, column in (("n_bytes", pa.array(size, pa.int64())), ("spans", pa.array(spans, kind)), ("kept", pa.array(kept, pa.binary()))):
            batch = batch.append_column(name, column)
        yield batch


def found_windows(docs: DataFrame, ws: Workspace, many: int = MANY) -> DataFrame:
    """docs (_k1, _k2, text): (_k1, _k2, start, n), ranges of places in each text at which a repeated string begins."""
    rows = ws.put("pieces", docs.select(*_KEYS, "text").mapInArrow(_piece_rows, _PIECES))
    hashed = rows.where("h IS NOT NULL")
    anchors = hashed.groupBy("h").agg(F.sum("m").alias("all_"), (F.min("p") < F.max("p")).alias("unlike")).where("all_ > 1").select("h", "unlike")
    live = ws.put("live", hashed.join(anchors, "h"))
    unlike = live.where("unlike").groupBy("h", "p").agg(F.sum("m").alias("m"), F.max("n").alias("n"), F.min(F.struct(*_KEYS, "start")).alias("at"))
    unlike = ws.put("unlike", unlike)
    asked = unlike.groupBy("at._k1", "at._k2").agg(F.collect_list(F.struct("h", "p", "at.start", "n")).alias("_asked"))
    once = docs.select(*_KEYS, "text").mapInArrow(_packed, "_k1 long, _k2 int, text binary").dropDuplicates(_KEYS)
    texts = asked.join(once, _KEYS).select("text", "_asked").mapInArrow(_cut_out, "h long, p long, piece binary")
    texts = ws.put("texts", texts.join(unlike.groupBy("h").agg((F.count("*") > many).alias("many")), "h"))
    sorted_ = texts.where("NOT many").select("h", "p", "piece").repartition("h").sortWithinPartitions("h", "p").mapInArrow(_sort_shards, _FOUND)
    windows = texts.where("many").select("h", "p", "piece").mapInArrow(_window_rows, "h long, p long, off int, w1 long, w2 long")
    counted = windows.join(windows.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1"), ["w1", "w2"]).selectExpr("h", "p", "off", "1 AS n")
    found = unlike.where("m > 1").selectExpr("h", "p", "0 AS off", "n").unionByName(ws.put("sorted", sorted_)).unionByName(counted)
    back = live.where("unlike").select("h", "p", *_KEYS, "start").join(found, ["h", "p"]).selectExpr(*_KEYS, "start + off AS start", "n")
    whole = rows.where("h IS NULL").unionByName(live.where("NOT unlike").select(rows.columns), True).select(*_KEYS, "start", "n")
    return whole.unionByName(back)


def remove_repeats(docs: DataFrame, many: int = MANY) -> DataFrame:
    """docs with n_bytes, spans (start, stop of the removed runs) and kept (the bytes that stay) in place of text."""
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "suffix")
    own = [c for c in docs.columns if c not in ("text", "n_bytes", "spans", "kept", *_KEYS)]
    # copies share their key; what follows takes texts by their keys alone
    rows = docs.select(*own, F.coalesce("text", F.lit("")).alias("text")).selectExpr("*", "xxhash64(text) AS _k1", "hash(text) AS _k2")
    found = found_windows(rows, ws, many).groupBy(*_KEYS).agg(F.collect_set(F.struct("start", "n")).alias("_found"))
    packed = rows.mapInArrow(_packed, StructType([f if f.name != "text" else type(f)("text", BinaryType()) for f in rows.schema]))
    out = packed.join(found, _KEYS, "left").select(*own, "text", "_found")
    kinds = StructType(out.schema.fields[:-2] + StructType.fromDDL("n_bytes long, spans array<struct<start:long,stop:long>>, kept binary").fields)
    return out.mapInArrow(_finish, kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).selectExpr("doc_id", "n_bytes", "n_bytes - octet_length(kept) AS n_removed", "CAST(size(spans) AS BIGINT) AS n_spans", "sha2(kept, 256) AS kept_sha256")


#: The same by counting the digest of every string of 200 bytes, over the hexadecimal form of the texts.
ORACLE = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
  w AS (SELECT doc_id, s, md5_number(substr(x, 2 * s + 1, {2 * WINDOW})) AS g FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - {WINDOW - 1})) AS s FROM d)),
  r AS (SELECT doc_id, s FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
  i AS (SELECT doc_id, s, sum(CASE WHEN s - p <= {WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM r)),
  n AS (SELECT doc_id, run, min(s) AS a, max(s) + {WINDOW} AS b FROM i GROUP BY doc_id, run),
  k AS (SELECT doc_id, run, b AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) AS b FROM n UNION ALL SELECT doc_id, 0, 0, min(a) FROM n GROUP BY doc_id),
  t AS (SELECT k.doc_id, string_agg(substr(d.x, 2 * k.a + 1, 2 * (k.b - k.a)), '' ORDER BY k.a) AS kept FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id),
  c AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS runs FROM n GROUP BY doc_id)
  SELECT d.doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(t.kept, x))) AS kept_sha256
  FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""

QUERIES = {"op11_suffix_array_dedup": query}
ORACLES = {"op11_suffix_array_dedup": ORACLE}
