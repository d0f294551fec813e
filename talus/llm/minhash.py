"""Near-duplicate documents by MinHash with sequential Bayesian verification.

1. Every text becomes its set of word shingles (64-bit hashes) and a signature of ``BANDS * ROWS`` minima.
   Equal sets form one class; only its smallest doc_id goes on.
2. The signature's bands are join keys. In each bucket the member that has the most company over all bands (the likely
   original of a group) is the hub, and every other member is compared to it: a group of any size costs a row a member. Members of
   large buckets are dealt into blocks, and the hub's row is copied once a block, so that no task gets a whole group.
3. A pair's signatures are compared batch by batch. The pair goes as soon as the posterior probability of a similarity of
   at least ``threshold`` (uniform prior) falls under ``miss``. Survivors are verified on the full sets.
4. Verified links join documents to components. In buckets that still hold several components, the members outside the largest one are compared with the
   others in blocks of bounded size: the largest component's sets are read once, and only the others are copied to each block. Pairs of one
   component are skipped, survivors are verified on full sets at once, and only a link that joins two components of the block is emitted,
   so a group never becomes all its pairs. Members of buckets with more than ``MANY`` blocks outside their largest component meet at rare shingles
   instead: two sets with the wanted similarity share one of the rarest 20 % (at 0.8) of either, so the bucket's text in common brings nobody together. Pairs that
   share a band are looked at in the same way as in the blocks, so the links don't depend on which of the two a bucket takes.

Cases: a null or empty text, or one without words, has no shingle (n_shingles 0), is linked with nothing and kept. Texts of any length
take part whole. Repeated rows give one result row each. doc_id is taken for a key: of different texts under one doc_id the one with the
fewest shingles (then least hashes) is compared for all of them, and equal sets are linked anyway. A null doc_id is in no link: component_id is null and the row is kept.
An empty table gives an empty one. Other columns are not read.
A link whose similarity is at the threshold is found with probability of at least 1 - (1 - t^ROWS)^BANDS (1 - 2e-5 at 0.8), less
``miss`` a batch, in buckets of any size.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm._store import Workspace, small_batches
from talus.llm._text import Words, buffers, grams, mix, sequence_hash, slices
from talus.operators.graph import star_roots

ROWS, BANDS, BATCH = 5, 28, 20
WIDTH = ROWS * BANDS
#: Members of a bucket that meet in one task at a time, and about how many shingles they have together; blocks of members outside the largest component above
#: which a bucket's members meet at rare shingles; counters that tell which shingles are rare.
BLOCK, BLOCK_SHINGLES, MANY, COUNTERS = 512, 1 << 20, 16, 1 << 16

_R = np.random.default_rng(7)
_A, _B = (_R.integers(0, 2**31, WIDTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; the whole sequence as one if there are fewer words."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([sequence_hash(words)])
    g = grams(words, k)
    g.sort()
    return g[np.concatenate([[True], g[1:] != g[:-1]])]


def signature(s: np.ndarray) -> np.ndarray:
    """Lower halves of the minima under WIDTH random linear orders of the (already mixed) hashes: those of large sets lie near 0, so their
    upper halves would agree by chance."""
    low, high = s.astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(WIDTH, 2**32 - 1, np.uint32)
    for at in range(0, len(s), 1024):
        a, b = low[at : at + 1024, None], high[at : at + 1024, None]
        np.minimum(least, (a * _A + b * _B).min(axis=0), out=least)
    return (least & np.uint32(0xFFFF)).astype(np.uint16)


def least_matches(threshold: float, miss: float, width: int = WIDTH, batch: int = BATCH) -> list[tuple[int, int]]:
    """After n of the minima: the fewest matches with P(similarity >= threshold | matches) >= miss."""
    out = []
    for n in [*range(batch, width, batch), width]:
        p, m = 0.0, -1  # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        while p < miss:
            m += 1
            p += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def likely(a: np.ndarray, b: np.ndarray, plan: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the rows of two signature matrices that no batch prunes."""
    at, matches, left = 0, np.zeros(len(a), np.int32), np.arange(len(a))
    for n, least in plan:
        matches = matches + (a[left, at:n] == b[left, at:n]).sum(axis=1)
        keep = matches >= least
        left, matches, at = left[keep], matches[keep], n
    return left


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def share_band(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two signature matrices have a band in common."""
    return (a == b).reshape(len(a), BANDS, ROWS).all(axis=2).any(axis=1)


def _matrix(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _features(k: int):
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            ids = batch.column("doc_id")
            for lo, hi in slices(offsets, 1 << 18):
                w = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n, h1, h2, sig = [], [], [], []
                for i in range(hi - lo):
                    s = shingle_set(w.hash[w.first[i] : w.first[i + 1]], k)
                    n.append(len(s))
                    h1.append(int(np.int64(s.sum(dtype=np.uint64).view(np.int64))))
                    h2.append(int(np.bitwise_xor.reduce(mix(s * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)) if len(s) else 0)
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield pa.record_batch(
                    [ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())],
                    ["doc_id", "n", "h1", "h2", "sig"],
                )

    return run


def _sets(k: int):
    """The sets of the rows whose set is the one that is wanted for their id."""

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            want = batch.column("h1").to_numpy(), batch.column("n").to_numpy()
            for lo, hi in slices(offsets, 1 << 18):
                w = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                sets = [shingle_set(w.hash[w.first[i] : w.first[i + 1]], k) for i in range(hi - lo)]
                own = [i for i, s in enumerate(sets) if len(s) == want[1][lo + i] and s.sum(dtype=np.uint64).view(np.int64) == want[0][lo + i]]
                yield pa.record_batch(
                    [batch.column("id").take(pa.array([lo + i for i in own], pa.int64())), pa.array([sets[i].tobytes() for i in own], pa.binary())],
                    ["id", "words"],
                )

    return run


def _prune(plan):
    def run(batches):
        for batch in batches:
            left = np.zeros(0, np.int64)
            if len(batch):
                a, b = _matrix(batch.column("sa"), np.uint16), _matrix(batch.column("sb"), np.uint16)
                left = likely(a, b, plan)
                left = left[share_band(a[left], b[left])]
            yield batch.select(["a", "b", "nb", "own"]).take(pa.array(left, pa.int64()))

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def rare_shingles(s: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, in the order of (counter, hash). Two sets with the wanted similarity share at least ``percent`` of the hundred of either, and the
    first one that they share has the others behind it, so it is among the rarest of both, whatever the counters say. A shingle that no other set has is left out."""
    seen = counts[s % np.uint64(len(counts))]
    first = np.lexsort((s, seen))[: len(s) - (percent * len(s) + 99) // 100 + 1]
    return s[first[seen[first] > 1]]


def _counters(batches):
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        every = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint64)
        counts += np.bincount((every % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
    at = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["counter", "seen"])


def _rare(counts: np.ndarray, percent: int):
    def run(batches):
        for batch in batches:
            found = [rare_shingles(np.frombuffer(w, np.uint64), counts, percent) for w in batch.column("words").to_pylist()]
            if found:
                ids = np.repeat(batch.column("id").to_numpy(), [len(f) for f in found])
                yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64), pa.int64()), pa.array(ids, pa.int64())], ["g", "id"])

    return run


def block_links(ids, comp, out, left, sig, words, band: int, plan, percent: int) -> list[tuple[int, int]]:
    """Verified links between components: the rows of ``left`` (or, where there are none, those marked ``out``, which are outside the group's largest component)
    against the other rows. Two rows that are both out meet from either side and count once. ``band`` is the one that the group shares: a pair is
    looked at where it is the first that its documents share; in a group around a shingle (-1) they may share any. Stops at links that the components so far imply, so there are fewer links than components."""
    order = np.lexsort((left, ids))
    ids, comp, out, left, sig = ids[order], comp[order], out[order], left[order], sig[order]
    parts = sig.reshape(len(sig), BANDS, ROWS)
    root = {c: c for c in comp.tolist()}

    def top(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    found_links = []
    for i in np.flatnonzero(left if left.any() else out):
        others = np.flatnonzero(~left & (comp != comp[i]) & (~out | (ids > ids[i])))
        if band > 0 and len(others):
            others = others[~(parts[others, :band] == parts[i, :band]).all(axis=2).any(axis=1)]
        found = others[likely(np.broadcast_to(sig[i], (len(others), sig.shape[1])), sig[others], plan)]
        if band < 0:
            found = found[share_band(sig[found], sig[i])]
        if len(found):
            found = found[np.argsort(-(sig[found] == sig[i]).sum(axis=1), kind="stable")]
        own = np.frombuffer(words[order[i]], np.uint64)
        for j in found:
            a, b = top(int(comp[i])), top(int(comp[j]))
            if a != b and similar(own, np.frombuffer(words[order[j]], np.uint64), percent):
                found_links.append((int(ids[i]), int(ids[j])))
                root[max(a, b)] = min(a, b)
    return found_links


def _block(plan, percent: int):
    def run(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).to_numpy()
        band = table.column("band")[0].as_py()
        sig = _matrix(table.column("sig").combine_chunks(), np.uint16)
        found = block_links(get("id"), get("comp"), get("out"), get("left"), sig, table.column("words").to_pylist(), band, plan, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _blocks(size: str, shingles: str) -> str:
    """SQL for the number of blocks that a group of so many members and shingles is dealt into."""
    return f"CAST(greatest(ceil({size} / {BLOCK}), ceil({shingles} / {BLOCK_SHINGLES})) AS INT)"


_OWN = "CAST(pmod(xxhash64(id, 1), nb) AS INT) AS own"


def _dealt(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """left (on, nb, own) joined to right (on), whose rows are copied once for each block that asks for them: no task gets all of a group."""
    asked = left.select(on, "nb").distinct().selectExpr(on, "nb", "explode(sequence(0, nb - 1)) AS own")
    return left.join(asked.join(right, on), [on, "nb", "own"])


def _groups(rows: DataFrame) -> DataFrame:
    """rows (g, id, comp, n): of each group with several components its largest one (big), the blocks of all its rows (nb) and of those outside it (ms)."""
    each = rows.groupBy("g", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    big = F.max_by(F.struct("comp", "size", "n"), F.struct("size", -F.col("comp"))).alias("big")
    total = each.groupBy("g").agg(F.count("*").alias("comps"), F.sum("size").alias("size"), F.sum("n").alias("n"), big).where("comps > 1")
    return total.selectExpr("g", "big.comp AS big", f"{_blocks('size', 'n')} AS nb", f"{_blocks('(size - big.size)', '(n - big.n)')} AS ms")


_SIDES = ["comp <> big AS out", _OWN, "CAST(pmod(xxhash64(id, 2), ms) AS INT) AS chunk"]


def _rare_rows(who: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """who (id, comp, n), sets (id, words): (g, id, comp, n) for each rare shingle g of each set. How rare they are say sums over ``COUNTERS`` remainders of their
    hashes, which is all that comes to the driver."""
    spelled = who.select("id").join(sets, "id")
    seen = spelled.mapInArrow(_counters, "counter long, seen long").groupBy("counter").agg(F.sum("seen").alias("seen")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[seen.column("counter").to_numpy()] = seen.column("seen").to_numpy()
    return spelled.mapInArrow(_rare(counts, percent), "g long, id long").join(who, "id").select("g", "id", "comp", "n")


def _block_rows(now: DataFrame, sets: DataFrame, ws: Workspace, percent: int = 80) -> DataFrame:
    """Groups to compare: buckets that hold several components, and the rare shingles of the members of those with very many rows outside the largest one.

    now (key, band, size, shingles, id, comp, n): (g, band, nb, ms, id, comp, out, own, chunk), band -1 for a shingle. Rows are dealt into nb blocks by
    ``own``; those that are out of the largest component also into ms chunks."""
    rows = now.selectExpr("key AS g", "band", "id", "comp", "n", f"{_blocks('size', 'shingles')} AS nb").selectExpr("*", _OWN)
    groups = ws.put("groups", _groups(rows))
    dealt = rows.join(groups.where(f"ms <= {MANY}").selectExpr("g", "nb", "big", "ms", "explode(sequence(0, nb - 1)) AS own"), ["g", "nb", "own"])
    names = ["g", "CAST(band AS INT) AS band", "nb", "ms", "id", "comp"]
    small = dealt.drop("own").selectExpr(*names, *_SIDES)
    many = groups.where(f"ms > {MANY}")
    if many.isEmpty():
        return small
    who = ws.put("who", rows.join(many.select("g"), "g", "left_semi").select("id", "comp", "n").distinct())
    rare = ws.put("rare", _rare_rows(who, sets, percent))
    large = rare.join(_groups(rare), "g").withColumn("band", F.lit(-1)).selectExpr(*names, *_SIDES)
    return small.unionByName(large)


def rare_pairs(rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of groups of one block in which one is out of the largest component, each once."""
    x, y = rows.where("out").selectExpr("g", "id AS a", "comp AS ca"), rows.selectExpr("g", "id AS b", "comp AS cb", "out")
    return x.join(y, "g").where("ca <> cb AND (NOT out OR a < b)").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()


def block_copies(rows: DataFrame) -> DataFrame:
    """(bi, bj, left) for each meeting of a row: with every chunk in its own block, and, if it's out, with every block in its chunk. A group of N rows with M of
    them out costs N * ms + M * nb copies, where nb is N and ms is M by the size of a block; nothing is copied in a group of one block."""
    own = "transform(sequence(0, ms - 1), c -> struct(own AS bi, c AS bj, false AS left))"
    far = "CASE WHEN out AND nb * ms > 1 THEN transform(sequence(0, nb - 1), o -> struct(o AS bi, chunk AS bj, true AS left)) ELSE array() END"
    return rows.selectExpr("g", "band", "id", "comp", "out", f"inline(concat({own}, {far}))")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = 1e-5) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    spark = docs.sparkSession
    small_batches(spark)
    ws, plan = Workspace(spark, "minhash"), least_matches(percent / 100, miss)
    texts = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    feats = ws.put("features", texts.mapInArrow(_features(shingle), "doc_id long, n long, h1 long, h2 long, sig binary"))
    full = feats.where("n > 0 AND doc_id IS NOT NULL")
    classes = ws.put("classes", full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("id")))
    own = [full.doc_id == classes.id, *(full[c] == classes[c] for c in ("n", "h1", "h2"))]
    first = full.join(classes, own, "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct("n", "h1", "h2", "sig")).alias("r"))
    reps = ws.put("reps", first.selectExpr("id", "r.n AS n", "r.h1 AS h1", "r.sig AS sig"))

    keys = reps.selectExpr(
        "id",
        "n",
        f"inline(transform(sequence(0, {BANDS - 1}), i -> struct(xxhash64(i, substring(sig, i * {2 * ROWS} + 1, {2 * ROWS})) AS key, CAST(i AS BYTE) AS band)))",
    )
    sizes = keys.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1")
    members = ws.put("members", keys.join(sizes, "key"))
    company = members.groupBy("id").agg(F.sum("size").alias("company"))
    hubs = members.join(company, "id").groupBy("key").agg(F.max_by("id", F.struct("company", -F.col("id"))).alias("hub"))
    blocked = members.selectExpr("key", "id", "size", f"{_blocks('size', '0')} AS nb").selectExpr("*", _OWN)
    pairs = _dealt(blocked, hubs, "key").where("id <> hub").groupBy(F.col("id"), F.col("hub").alias("b")).agg(F.max("nb").alias("nb")).selectExpr("id AS a", "b", "nb", _OWN)

    sets = ws.put(
        "sets",
        texts.join(
            company.join(reps, "id").select("id", "n", "h1"),
            F.col("doc_id") == F.col("id"),
        ).select("id", "text", "n", "h1").mapInArrow(_sets(shingle), "id long, words binary").dropDuplicates(["id"]),
    )
    sided = lambda t, c: t.selectExpr(f"id AS {c}", f"sig AS s{c}")
    whole = lambda c: sets.selectExpr(f"id AS {c}", f"words AS w{c}")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The links among pairs (a, b, nb, own)."""
        left = _dealt(pairs.join(sided(reps, "a"), "a"), sided(reps, "b"), "b").select("a", "b", "nb", "own", "sa", "sb").mapInArrow(_prune(plan), "a long, b long, nb int, own int")
        left = ws.put(f"likely_{name}", left)
        return ws.put(name, _dealt(left.join(whole("a"), "a"), whole("b"), "b").select("a", "b", "wa", "wb").mapInArrow(_verify(percent), "a long, b long"))

    links = verified(pairs, "links")
    comp = ws.put("comp", star_roots(links))

    now = members.where("size > 2").join(comp.withColumnRenamed("root", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    blocks = ws.put("blocks", _block_rows(now, sets, ws, percent))
    # a set in a small group around a shingle isn't sent there, as there are many of these
    rare = blocks.where("band < 0 AND nb = 1")
    rows = block_copies(blocks.where("band >= 0 OR nb > 1"))
    whole_rows = rows.join(reps.select("id", "sig"), "id").join(sets, "id").select("g", "bi", "bj", "band", "id", "comp", "out", "left", "sig", "words")
    more = whole_rows.groupBy("g", "bi", "bj").applyInArrow(_block(plan, percent), "a long, b long")
    more = ws.put("more", more)
    if not rare.isEmpty():
        met = ws.put("met", rare_pairs(rare))
        asks = met.groupBy("b").agg(F.expr(f"{_blocks('count(*)', '0')}").alias("nb"))
        more = more.unionByName(verified(met.join(asks, "b").selectExpr("a", "b", "nb", "CAST(pmod(xxhash64(a, 1), nb) AS INT) AS own"), "rare_links"))
    # what the blocks found joins the roots of the first round
    at = lambda c: comp.selectExpr(f"id AS {c}", f"root AS r{c}")
    over = more.join(at("a"), "a", "left").join(at("b"), "b", "left").selectExpr("coalesce(ra, a) AS a", "coalesce(rb, b) AS b").distinct()
    last = ws.put("last", star_roots(over).selectExpr("id AS root", "root AS final"))
    every = comp.unionByName(last.join(comp.select("root"), "root", "left_anti").selectExpr("root AS id", "root")).join(last, "root", "left").selectExpr("id", "coalesce(final, root) AS component_id")
    classed = classes.join(every, "id", "left").selectExpr("h1", "h2", "n", "coalesce(component_id, id) AS component_id")
    ws.drop("reps", "sets", "members", "likely_links", "links", "groups", "who", "rare", "blocks", "more", "met", "likely_rare_links", "rare_links")
    out = feats.select("doc_id", "n", "h1", "h2").join(classed, ["h1", "h2", "n"], "left")
    return out.selectExpr(
        "doc_id",
        "n AS n_shingles",
        "CASE WHEN doc_id IS NULL THEN NULL ELSE coalesce(component_id, doc_id) END AS component_id",
    ).selectExpr("*", "coalesce(doc_id = component_id, true) AS kept")


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but the near-duplicates of a smaller doc_id; of repeated rows of one doc_id one stays."""
    gone = near_duplicates(docs, shingle, percent).where("NOT kept").select("doc_id").distinct()
    cols = docs.columns
    clean = docs.join(gone, "doc_id", "left_anti").select(cols)
    return clean.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(clean.where("doc_id IS NULL"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shingle=4)


QUERIES = {"op1_minhash_near_dedup": op1_minhash_near_dedup}
