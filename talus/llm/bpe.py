"""Byte-level BPE encoding and decoding over a pair occurrence index.

The distinct pretokens of a partition's batch lie one after another in one array of symbols, linked to their live neighbours. An index
maps each mergeable pair, by rank, to all its positions. Active ranks are taken in ascending order: all live positions of the pair
merge in one array operation, and the pairs to their left and right enter the lists of their ranks. A pair with a merged symbol always
has a later rank than that merge, so no list is touched twice. Texts are then put together from their pretokens' ids, and
decoded again from the ids alone.

The vocabulary file (its path is a parameter; the file reaches the executors as a broadcast) is the JSON of a byte-level BPE tokenizer
without normaliser. Special tokens in a text become their own ids, as the tokenizers library does without ``encode_special_tokens``.

A worker holds about ``AT_ONCE`` characters of text at a time with their results, whatever the batches' size, and remembers the ids of
pretokens up to ``REMEMBERED_BYTES``. A longer text is encoded whole, in pieces cut where white space follows something else: no pretoken
reaches over such a place, and none looks back over it.

Cases: a null text counts as empty; an empty text has no ids and decodes to an empty text; repeated rows give repeated results;
null ids are carried; texts of any length are encoded whole; an empty table gives an empty one. Other columns are carried by ``encode``, but for
own columns named n_tokens, ids or decoded, which the results replace.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from talus.llm._store import small_batches
from talus.llm._text import buffers, mix, powers

#: How a byte-level tokenizer splits text before the merges: a fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text that are split at a time, and whose new pretokens are merged and results given out together.
SPLIT, AT_ONCE = 250_000, 2_000_000
#: About so many bytes of pretokens with their ids are remembered by a task: it begins anew beyond.
REMEMBERED_BYTES = 48 << 20


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merge table and token bytes from the tokenizer's JSON."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, byte = spec["model"], byte_symbols()
        self._check(spec)
        ids = model["vocab"]
        self.bytes: list[bytes] = [b""] * (max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in ids.items():
            self.bytes[i] = bytes(byte[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.decimal = [b"%d" % i for i in range(len(self.bytes))]
        self.first = np.zeros(256, np.int32)
        for c, b in byte.items():
            self.first[b] = ids[c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left, self.right, self.made = (np.array(x, np.int32) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in pairs), strict=True))
        key = self.left.astype(np.int64) << 32 | self.right
        order = np.argsort(key, kind="stable")
        self.key, self.rank_of_key = key[order], order.astype(np.int32)
        self.dense = np.full((256, 256), -1, np.int32)  # ranks of pairs of single bytes' symbols, by byte
        back = {int(s): b for b, s in enumerate(self.first)}
        for r, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True)):
            if a in back and b in back:
                self.dense[back[a], back[b]] = r

    @staticmethod
    def _check(spec: dict) -> None:
        """Raises where the file asks for something that isn't done here."""
        before, other = spec.get("pre_tokenizer") or {}, []
        other += ["a normaliser"] if spec.get("normalizer") else []
        other += [f"the pre-tokenizer {before.get('type')}"] if before.get("type") != "ByteLevel" or not before.get("use_regex", True) else []
        other += ["add_prefix_space"] if before.get("add_prefix_space") else []
        other += [f"the model {spec['model'].get('type')}"] if spec["model"].get("type", "BPE") != "BPE" else []
        other += [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if spec["model"].get(k)]
        other += [f"{k} of {t['content']!r}" for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word") if t.get(k)]
        if other:
            raise ValueError(f"unsupported in a tokenizer file: {', '.join(other)}")

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank_of_key[at], -1)


def merge(v: Vocabulary, pretokens: list[bytes]) -> tuple[list[int], list[int]]:
    """Ids of the pretokens one after another, and where each one's end."""
    data = np.frombuffer(b"".join(pretokens), np.uint8)
    sizes = np.array([len(p) for p in pretokens], np.int64)
    n, ends = len(data), np.cumsum(sizes)
    symbol = v.first[data]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # live neighbours in the pretoken; n and -1: none
    after[ends[sizes > 0] - 1] = n
    before[(ends - sizes)[sizes > 0]] = -1
    live = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray, rank: np.ndarray) -> None:
        at, rank = at[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(rank) else []
        for r, part in zip(rank[cut].tolist() if len(rank) else [], np.split(at, cut[1:]) if len(rank) else [], strict=True):
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(part)

    here = np.flatnonzero(after < n)
    enter(here, v.dense[data[here], data[here + 1]])
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = np.sort(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        a, b, made = v.left[r], v.right[r], v.made[r]
        at = at[live[at] & (symbol[at] == a)]
        at = at[after[at] < n]
        at = at[symbol[after[at]] == b]
        if a == b and len(at) > 1:  # of overlapping ones every second, from the left
            at = np.unique(at)
            follows = np.concatenate([[False], after[at[:-1]] == at[1:]])
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            at = at[run % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        symbol[at] = made
        live[gone] = False
        nxt = after[gone]
        after[at] = nxt
        inner = nxt < n
        before[nxt[inner]] = at[inner]
        left = before[at]
        left = left[left >= 0]
        enter(np.concatenate([left, at[inner]]), np.concatenate([v.ranks(symbol[left], symbol[after[left]]), v.ranks(symbol[at[inner]], symbol[nxt[inner]])]))
    kept = np.concatenate([[0], np.cumsum(live)])
    return symbol[live].tolist(), kept[ends].tolist()


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For every code point: 1 letter, 2 number, 3 white space, 0 other, as PATTERN's classes have them."""
    import regex

    every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "!" for i in range(0x110000))
    out = np.zeros(0x110000, np.uint8)
    for k, what in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
        out[np.frombuffer("".join(regex.findall(what, every)).encode("utf-32-le"), np.uint32)] = k
    return out


def split_points(code: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where pretokens start in texts that lie one after another and start at ``texts``: what PATTERN finds, as array operations.

    Runs of one class are pretokens, but: a run of white space before anything else gives up its last character, which leads the next run
    if it is a space and stands alone if not; and an apostrophe on its own starts a contraction with the letters after it."""
    n, kind = len(code), _classes()[code]
    starts = np.ones(n, bool)
    starts[1:] = kind[1:] != kind[:-1]
    starts[texts[texts < n]] = True
    last = np.ones(n, bool)  # of a run
    last[:-1] = starts[1:]
    ends_text = np.zeros(n + 1, bool)
    ends_text[texts] = True
    lends = np.flatnonzero(last & (kind == 3) & ~ends_text[1:])  # white space just before something else
    starts[lends] = True
    led = lends[code[lends] == 32] + 1
    starts[led] = False
    # contractions: a run of one apostrophe that no space leads, before s t m d re ve ll
    quote = np.flatnonzero((code == 39) & last & starts)
    quote = quote[quote + 1 < n]
    quote = quote[~ends_text[quote + 1]]
    a = code[quote + 1]
    two = np.minimum(quote + 2, n - 1)
    b = np.where((quote + 2 < n) & ~ends_text[two], code[two], 0)
    one = np.isin(a, [ord(c) for c in "stmd"])
    pair = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    starts[quote[one | pair] + 1] = False
    for some, k in ((one, 2), (pair & ~one, 3)):
        cut = quote[some] + k
        cut = cut[cut < n]
        starts[cut] = True  # the rest of the letters, or what follows them
        # white space that leads a run is itself led by nothing: a cut there is a start already
    return np.flatnonzero(starts)


class Coder:
    """Encodes texts batch by batch; remembers the ids of pretokens between batches, up to ``REMEMBERED_BYTES``."""

    def __init__(self, v: Vocabulary):
        self.v, self.known, self.held = v, {}, 0
        self.split, self.may_cut = None, not any(re.search(r"\s", s) for s in v.special)
        if v.special:
            import regex

            self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(v.special, key=len, reverse=True)) + ")")

    def pretokens(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.v.special):
            return _pattern().findall(text)
        return [p for i, part in enumerate(self.split.split(text)) for p in ([part] if i % 2 else _pattern().findall(part))]

    def learn(self, words: list[str]) -> None:
        """Puts into ``known`` for each pretoken: number of ids, decimal ids joined by commas, bytes that the ids decode to."""
        if self.held > REMEMBERED_BYTES:
            self.known, self.held = {}, 0
        known, table, decimal, at = self.known, self.v.bytes, self.v.decimal, 0
        new = []
        for w in words:
            if w not in known:
                i = self.v.special.get(w)
                if i is None:
                    new.append(w)
                else:
                    known[w] = (1, decimal[i], table[i])
        flat, ends = merge(self.v, [w.encode("utf-8", "surrogatepass") for w in new])
        for w, end in zip(new, ends, strict=True):
            ids = flat[at:end]
            at = end
            known[w] = one = (len(ids), b",".join([decimal[i] for i in ids]), b"".join([table[i] for i in ids]))
            self.held += 300 + 2 * len(w) + len(one[1]) + len(one[2])  # three objects, a tuple and a place in the table

    def numbered(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pretokens, the number of each pretoken of the texts, and where each text's start."""
        size = np.array([len(t) for t in texts])
        begin = np.cumsum(size) - size
        whole = "".join(texts)
        if not self.v.special or not any(x in whole for x in self.v.special):
            code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
            start = split_points(code, np.append(begin, len(code))) if len(code) else np.zeros(0, np.int64)
            end = np.append(start[1:], len(code))[: len(start)]
            pow_, inv = powers(len(code) + 1)
            h = []
            for salt in (1, 2):
                sums = np.zeros(len(code) + 1, np.uint64)
                np.cumsum(mix(code.astype(np.uint64) + np.uint64(salt << 40)) * pow_[: len(code)], out=sums[1:])
                h.append((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))
            _, first, number = np.unique(h[0], return_index=True, return_inverse=True)
            if (h[1] == h[1][first][number]).all():  # two hashes agree on which pretokens are equal
                return [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)], number.astype(np.int32), np.searchsorted(start, np.append(begin, len(code)))
        split = [self.pretokens(t) for t in texts]
        words = list(dict.fromkeys(w for x in split for w in x))
        place = {w: i for i, w in enumerate(words)}
        return words, np.array([place[w] for x in split for w in x], np.int32), np.cumsum([0, *map(len, split)])

    def encode(self, texts: list[str]):
        """For each text: number of ids, the ids as decimal text, the decoded text."""
        pieces = [self.numbered(texts[a:b]) for a, b in runs_of([len(t) for t in texts], SPLIT)]
        self.learn(list(dict.fromkeys(w for words, _, _ in pieces for w in words)))
        for words, number, first in pieces:
            found = [self.known[w] for w in words]
            n = np.array([f[0] for f in found], np.int64)
            ids, decoded = _objects([f[1] for f in found]), _objects([f[2] for f in found])
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                part = number[a:b]
                yield int(n[part].sum()), b",".join(ids[part].tolist()), b"".join(decoded[part].tolist()).decode("utf-8", "replace")

    def long(self, text: str):
        """As encode, for one text of any length: a piece at a time."""
        n, ids, decoded = 0, [], []
        for piece in self.cut(text):
            for count, joined, plain in self.encode([piece]):
                n += count
                ids += [joined] if joined else []
                decoded.append(plain)
        return n, b",".join(ids), "".join(decoded)

    def cut(self, text: str) -> list[str]:
        """Pieces of about ``AT_ONCE`` characters, cut before white space that follows something else."""
        out, at = [], 0
        while self.may_cut and len(text) - at > AT_ONCE:
            end = _EDGE.search(text, at + AT_ONCE - 1)
            if end is None:
                break
            out.append(text[at : end.start() + 1])
            at = end.start() + 1
        return [*out, text[at:]]


_EDGE = re.compile(r"\S(?=[ \n])")


def runs_of(sizes, most: int):
    """Ranges of rows whose sizes add up to about ``most`` (one row at least)."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, stop
        at = stop


def coded(coder: Coder, batches):
    """(rows of a batch, their results) for runs of rows of about ``AT_ONCE`` bytes."""
    for batch in batches:
        for lo, hi in runs_of(np.diff(buffers(batch.column("text"))[1]), AT_ONCE):
            part = batch.slice(lo, hi - lo)
            texts = [t or "" for t in part.column("text").to_pylist()]
            yield part, [coder.long(texts[0])] if len(texts) == 1 else coder.encode(texts)


def _objects(x) -> np.ndarray:
    out = np.empty(len(x), object)
    out[:] = x
    return out


@lru_cache(maxsize=1)
def vocabulary_of(text: str) -> Vocabulary:
    """Parsed once in a Python worker, which serves many tasks."""
    return Vocabulary(text)


def _encode(shared, rest: list[str]):
    def run(batches):
        for part, found in coded(Coder(vocabulary_of(shared.value)), batches):
            n, ids, decoded = zip(*found, strict=True)
            own = [pa.array(n, pa.int64()), pa.array([x.decode() for x in ids], pa.string()), pa.array(decoded, pa.string())]
            yield pa.record_batch([*(part.column(c) for c in rest), *own], [*rest, "n_tokens", "ids", "decoded"])

    return run


def _digests(shared):
    def run(batches):
        for part, found in coded(Coder(vocabulary_of(shared.value)), batches):
            n, ids, decoded = zip(*((n, hashlib.sha256(joined).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) for n, joined, text in found), strict=True)
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _broadcast(spark: SparkSession, path: str | None):
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` (less its text) with n_tokens, the ids as decimal text joined by commas, and the text decoded from the ids."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "decoded")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest]
    schema = ", ".join([*fields, "n_tokens long", "ids string", "decoded string"])
    return docs.select(*[f"`{c}`" for c in rest], "text").mapInArrow(_encode(_broadcast(docs.sparkSession, vocabulary), rest), schema)


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return docs.mapInArrow(_digests(_broadcast(spark, None)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


QUERIES = {"op7_bpe_encode_decode": op7_bpe_encode_decode}
