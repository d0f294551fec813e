import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talus.llm import ann, bpe, chat, decontaminate, licenses, linededup, minhash, quality, secrets, toxicity
from talus.llm._text import PUNCT, Words, buffers, mix

DOCS = "doc_id long, text string, lang string, n_removed string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash") for i, t in rows], DOCS)


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def shingles(text, k):
    w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def test_word_hashes_ignore_batches_and_split_nowhere():
    texts = ["Ab  cd\n", "", None, "x" * 3_000_000 + " y", "ab CD", "é ñ"]
    w = Words(*buffers(pa.array(texts)))
    alone = [Words(*buffers(pa.array([t]))).hash.tolist() for t in texts]
    assert [w.hash[w.first[i] : w.first[i + 1]].tolist() for i in range(len(texts))] == alone
    assert alone[0] == alone[4] and len(alone[3]) == 2 and len(alone[5]) == 2


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(1)
    base = words(r, 120, 5000)
    rows = [(i, words(r, r.randrange(1, 80))) for i in range(60)]
    rows += [(100 + i, edited(r, base, r.randrange(1, 9))) for i in range(80)] + [(90, base), (91, base.upper()), (92, None), (93, ""), (94, " \n"), (95, "a b"), (96, "a  b"), (None, base), (90, base)]
    got = minhash.near_duplicates(docs(spark, rows), shingle=4).collect()
    sets = {i: shingles(t, 4) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert len(got) == len(rows)
    for g in got:
        if g["doc_id"] is None:
            assert g["component_id"] is None and g["kept"]
        else:
            assert (g["n_shingles"], g["component_id"], g["kept"]) == (len(sets[g["doc_id"]]), top(g["doc_id"]), top(g["doc_id"]) == g["doc_id"])


@pytest.mark.parametrize("many", [16, 0])
def test_large_groups_are_compared_in_blocks(spark, monkeypatch, many):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "MANY", many)
    r = random.Random(2)
    a = words(r, 60, 5000)
    chain = [a]
    for _ in range(50):
        chain.append(edited(r, chain[-1], 1))
    got = minhash.near_duplicates(docs(spark, list(enumerate(chain))), shingle=4).collect()
    sets = [shingles(t, 4) for t in chain]
    assert all(len(x & y) >= 0.8 * len(x | y) for x, y in zip(sets, sets[1:]))
    assert {g["component_id"] for g in got} == {0}


def test_copies_of_a_large_group_grow_linearly(spark, tmp_path):
    """100,000 members of one component and ten outsiders in one bucket: sets are copied once each, and the outsiders' once a block. Every pair with an outsider
    meets once."""
    n = 100_000
    now = spark.range(n + 10).selectExpr("1L AS key", "CAST(3 AS BYTE) AS band", f"{n + 10}L AS size", f"{60 * (n + 10)}L AS shingles", "id", f"CASE WHEN id < {n} THEN 0L ELSE id END AS comp", "60L AS n")
    reps = spark.createDataFrame([], "id long, n long, h1 long, sig binary")
    rows = minhash.block_copies(minhash._block_rows(now, reps, minhash.Workspace(spark, "copies")))
    assert rows.count() <= n + 10 + 10 * (n // minhash.BLOCK + 2)
    few = spark.range(300).selectExpr("1L AS key", "CAST(3 AS BYTE) AS band", "300L AS size", f"{300 * 2**16}L AS shingles", "id", "CASE WHEN id < 200 THEN 0L ELSE id END AS comp", "65536L AS n")
    t = minhash.block_copies(minhash._block_rows(few, reps, minhash.Workspace(spark, "copies")))
    met = t.where("left").alias("a").join(t.where("NOT left").alias("b"), ["g", "bi", "bj"]).where("a.comp <> b.comp AND (NOT b.out OR b.id > a.id)").select("a.id", "b.id").collect()
    assert len(met) == len(set(met)) == 100 * 200 + 100 * 99 // 2


def one_band(k=4, seed=42392, changes=3, band=24):
    """Two texts that are linked but share only one band of their signatures, and texts of another group in that band's bucket, one of which is its hub."""
    r = random.Random(seed)
    own = lambda t: minhash.shingle_set(Words(*buffers(pa.array([t]))).hash, k)
    bands = lambda t: minhash.signature(own(t)).reshape(minhash.BANDS, minhash.ROWS)
    a = words(r, 120, 5000)
    b = edited(r, a, changes)
    assert minhash.similar(own(a), own(b), 80) and np.flatnonzero((bands(a) == bands(b)).all(axis=1)).tolist() == [band]
    hub = next(t for t in (edited(r, a, 10) for _ in range(10_000)) if (bands(t)[band] == bands(a)[band]).all() and not any(minhash.similar(own(t), own(x), 75) for x in (a, b)))
    return [hub, *(edited(r, hub, 1) for _ in range(8)), a, b]


@pytest.mark.parametrize("block", [512, 4, 1])
@pytest.mark.parametrize("many", [16, 0])
def test_links_do_not_depend_on_the_size_of_a_bucket(spark, monkeypatch, many, block):
    """Pairs of one band are linked in buckets that are compared whole and in those whose members meet at rare shingles, in one block and in several."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "MANY", many)
    got = minhash.near_duplicates(docs(spark, list(enumerate(one_band()))), shingle=4).collect()
    assert {g["doc_id"]: g["component_id"] for g in got} == {**dict.fromkeys(range(9), 0), 9: 9, 10: 9}


@pytest.mark.parametrize("many", [16, 0])
def test_near_copies_of_the_pipeline_do_not_depend_on_the_size_of_a_bucket(spark, monkeypatch, many):
    import corpus_pipeline

    monkeypatch.setattr(minhash, "MANY", many)
    kept = corpus_pipeline.near_dedup(spark, docs(spark, list(enumerate(one_band(5, 28912, 2, 4)))), "").collect()
    assert sorted(g["doc_id"] for g in kept) == [0, 9]


def test_rare_shingles_of_similar_sets_meet():
    """Whatever the counters say; at the least similarity, and in sets of one shingle."""
    r = np.random.default_rng(3)
    for n in [1, 2, 3, 4, 5, 9, 10, 11, 57, 300] * 20:
        both = mix(r.integers(0, 2**62, n).astype(np.uint64))
        more = mix(r.integers(0, 2**62, n // 4).astype(np.uint64))
        cut = r.integers(0, len(more) + 1)
        a, b = np.sort(np.concatenate([both, more[:cut]])), np.sort(np.concatenate([both, more[cut:]]))
        assert minhash.similar(a, b, 80)
        counts = r.integers(2, 9, 64)
        assert np.intersect1d(minhash.rare_shingles(a, counts, 80), minhash.rare_shingles(b, counts, 80)).size


def test_signatures_of_long_unlike_texts_differ():
    r = np.random.default_rng(16)
    for n in (200, 20_000, 200_000):
        a, b = (minhash.signature(mix(r.integers(0, 2**62, n).astype(np.uint64))) for _ in range(2))
        assert (a == b).mean() < 0.03


def test_near_duplicates_odd_rows(spark, tmp_path):
    r = random.Random(17)
    base, other = words(r, 60, 5000), words(r, 40, 5000)
    rows = [(7, base), (7, other), (8, base), (9, other), (10, base + " tail"), (14, base + " end"), (11, "x" * 400_000), (12, "y " * 60_000), (13, "y " * 60_001)]
    t = spark.createDataFrame([(i, x, "clash", 1) for i, x in rows], "doc_id long, text string, component_id string, n int")
    got = sorted((g["doc_id"], g["n_shingles"], g["component_id"], g["kept"]) for g in minhash.near_duplicates(t, shingle=4).collect())
    assert got == [(7, 37, 7, True), (7, 57, 7, True), (8, 57, 7, False), (9, 37, 7, False), (10, 58, 10, True), (11, 1, 11, True), (12, 1, 12, True), (13, 1, 12, False), (14, 58, 10, False)]
    t.write.parquet(f"{tmp_path}/documents.parquet")
    q = minhash.op1_minhash_near_dedup(spark, str(tmp_path))
    assert q.columns == ["doc_id", "n_shingles", "component_id", "kept"] and q.count() == len(rows)
    assert sorted(g["doc_id"] for g in minhash.keep_one(t).collect()) == [7, 10, 11, 12]


def test_bayesian_bounds():
    plan = minhash.least_matches(0.8, 1e-5)
    assert [n for n, _ in plan][-1] == minhash.WIDTH and all(a[1] <= b[1] for a, b in zip(plan, plan[1:]))
    r = np.random.default_rng(0)
    pairs = []
    for _ in range(300):
        both, own = mix(r.integers(0, 2**62, 160).astype(np.uint64)), mix(r.integers(0, 2**62, 40).astype(np.uint64))
        pairs.append((minhash.signature(np.concatenate([both, own[:20]])), minhash.signature(np.concatenate([both, own[20:]]))))
    a, b = (np.stack(x) for x in zip(*pairs))
    assert len(minhash.likely(a, b, plan)) == 300 and abs((a == b).mean() - 0.8) < 0.01


def test_empty_tables(spark):
    none = docs(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert minhash.near_duplicates(none).count() == linededup.dedup_lines(none).count() == bpe.encode(none).count() == 0
    assert decontaminate.contaminated(none, bench).count() == licenses.find_licenses(none).count() == 0
    assert secrets.find_secrets(none.selectExpr("doc_id", "text", "'' AS path")).count() == quality.keep_good(none, lab).count() == 0
    assert toxicity.score(none, toxicity.fit(none, lab)).count() == 0
    assert ann.nearest(*[spark.createDataFrame([], "id long, v array<float>")] * 2).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def one_edit(a, b):
    """At most one word inserted, deleted or replaced: by the whole table of edit distances."""
    cost = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(cost[j - 1] + (x != y), cost[j] + 1, row[-1] + 1))
        cost = row
    return cost[-1] <= 1


def removed(rows, least=1, fuzzy=2):
    seen, out = [], {}
    for i, t in sorted(rows):
        out[i] = set()
        for n, line in enumerate(t.split("\n")):
            w = line.lower().split()
            if len(w) < least:
                continue
            if any(w == o or len(w) >= fuzzy and len(o) >= fuzzy and abs(len(w) - len(o)) <= 1 and one_edit(w, o) for o in seen):
                out[i].add(n)
            seen.append(w)
    return out


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(3)
    pool = [words(r, n, 60) for n in (3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40) for _ in range(4)]

    def line():
        w = r.choice(pool).split()
        k = r.random()
        if k < 0.3:
            w[r.randrange(len(w))] = f"n{r.randrange(50)}"
        elif k < 0.5:
            w.insert(r.randrange(len(w) + 1), f"n{r.randrange(50)}")
        elif k < 0.7:
            del w[r.randrange(len(w))]
        return " ".join(w) if r.random() < 0.9 else r.choice(["", "a b", "  "])

    rows = [(i, "\n".join(line() for _ in range(r.randrange(1, 6)))) for i in range(60)]
    want = removed(rows)
    got = {g["doc_id"]: g for g in linededup.dedup_lines(docs(spark, rows)).collect()}
    for i, t in rows:
        assert got[i]["text"] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i]) and got[i]["n_removed"] == len(want[i])


def test_line_dedup_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (4, "A  b c D\nz"), (None, "a b c d"), (5, "\n\n")]
    got = sorted(((g["doc_id"], g["text"]) for g in linededup.dedup_lines(docs(spark, rows).withColumn("gone", F.lit(1)).withColumn("lines", F.lit("x"))).collect()), key=str)
    assert got == sorted([(1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (4, "z"), (None, "a b c d"), (5, "\n\n")], key=str)


def test_line_dedup_of_short_lines(spark, tmp_path):
    """The query and the pipeline leave no line out by its length."""
    import corpus_pipeline

    r = random.Random(12)
    line = lambda: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(0, 9)))
    rows = [(1, "Page\nall rights reserved by acme"), (2, "page\nfoot note\nall rights reserved by emca"), (3, "Foot note\nnote\nsome rights reserved")]
    rows += [(10 + i, "\n".join(line() for _ in range(r.randrange(1, 5)))) for i in range(60)]
    want = removed(rows, least=1, fuzzy=2)
    assert [want[i] for i in (1, 2, 3)] == [set(), {0, 2}, {0}]
    docs(spark, rows).select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    for g in linededup.op5_line_dedup(spark, str(tmp_path)).collect():
        assert g["n_removed"] == len(want[g["doc_id"]])
    long = docs(spark, rows).selectExpr("doc_id", "text", "CAST(0 AS BIGINT) AS n_chars")
    kept = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i]) for i, t in rows}
    got = {g["doc_id"]: g["text"] for g in corpus_pipeline.line_dedup(spark, long, "").collect()}
    assert got == {i: t for i, t in kept.items() if t or not want[i]}


def test_line_dedup_after_a_leading_newline(spark):
    """A newline that starts a text is a line end of its own beside the end of the text before it."""
    rows = [(1, "\na b c d\nonly here once"), (2, "x y z w"), (3, "\nA b c d\nanother line here"), (4, "\nunique words stay here\nx y z w"), (5, ""), (6, "\n\na b c d")]
    got = {g["doc_id"]: (g["text"], g["n_removed"]) for g in linededup.dedup_lines(docs(spark, rows).coalesce(1)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("x y z w", 0), 3: ("\nanother line here", 1), 4: ("\nunique words stay here", 1), 5: ("", 0), 6: ("\n", 1)}


def distance_table(item, text, k):
    """Least edits between the item and any passage of the text, by the plain table."""
    cost = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        row = [i]
        for j, y in enumerate(text, 1):
            row.append(min(cost[j - 1] + (x != y), cost[j] + 1, row[-1] + 1))
        cost = row
    return min(cost)


def with_edits(r, w, n):
    w = list(w)
    for _ in range(n):
        p, kind = r.randrange(len(w)), r.random()
        if kind < 0.34:
            w[p] = f"q{r.randrange(9)}"
        elif kind < 0.67:
            w.insert(p, f"q{r.randrange(9)}")
        else:
            del w[p]
    return w


@pytest.mark.parametrize(("ratio", "least"), [(0.15, 0.99), (0.3, 0.93)])
def test_decontamination_recall_and_silence(ratio, least):
    r = random.Random(4)
    items = [words(r, 8 + i % 45, 3000).split() for i in range(60)]
    index = decontaminate.Items(list(range(60)), [" ".join(w) for w in items], ratio, 6)
    texts = [words(r, r.randrange(1, 20), 3000).split() + with_edits(r, items[n % 60], decontaminate.allowance(len(items[n % 60]), ratio)) + words(r, 5, 3000).split() for n in range(600)]
    w = Words(*buffers(pa.array([", ".join(t).upper() for t in texts])), PUNCT, cjk=True)
    rows = decontaminate.matches(index, index.filters(), w.hash, w.text, w.first)
    found = {(t, index.ids[i]): d for t, i, d, *_ in rows}
    assert sum((n, n % 60) in found for n in range(600)) >= least * 600 and len(found) == sum((n, n % 60) in found for n in range(600))
    assert all(distance_table(items[i], texts[t], 0) == d <= decontaminate.allowance(len(items[i]), ratio) for (t, i), d in found.items())


def test_decontamination_equals_brute_force(spark):
    """On dense data, where hardly anything is unlike: every pair of the plain table is found, and no other."""
    r = random.Random(44)
    items = [words(r, r.choice([1, 2, 3, 5, 7, 8, 10, 20]), 12).split() for _ in range(40)]
    texts = [words(r, r.randrange(0, 60), 12).split() for _ in range(60)]
    texts += [with_edits(r, items[n % 40] * 2, r.randrange(0, 4)) for n in range(60)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    out = decontaminate.contaminated(docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]), bench, 0.2, 1).collect()
    got = {(g["doc_id"], g["item_id"]): (g["edits"], g["first_word"], g["n_words"]) for g in out}
    want = {(t, i): d for t, w in enumerate(texts) for i, x in enumerate(items) if w and (d := distance_table(x, w, 0)) <= int(0.2 * len(x) + 1e-9)}
    assert {k: v[0] for k, v in got.items()}.keys() <= want.keys() and len(got) >= 0.98 * len(want)
    for (t, i), (d, at, n) in got.items():
        assert d == want[t, i] == distance_table(items[i], texts[t][at : at + n], 0)
    assert all((t, i) in got for t, i in want if len(items[i]) < 8)


def test_decontamination_odd_rows(spark, tmp_path):
    r = random.Random(45)
    items = [(i, words(r, 14 + i, 3000)) for i in range(12)] + [(20, "機械学習の評価用の文章です"), (21, "just four words here")]
    passage = "前置き" + items[12][1] + "。終わり"
    rows = [(1, items[3][1]), (1, items[3][1]), (2, " ".join(items[3][1].split()[:8])), (3, None), (4, ""), (None, items[5][1]), (None, "clean text"), (5, "ab " * 5000), (6, ("x " * 40 + items[0][1] + " ") * 300), (7, passage), (8, "just four words here")]
    bench = spark.createDataFrame([*items, (99, None), (98, "too short"), (3, items[3][1])], "item_id long, text string")
    t = docs(spark, rows).withColumn("item_id", F.lit("clash"))
    out = sorted(((g["doc_id"], g["item_id"], g["edits"]) for g in decontaminate.contaminated(t, bench).collect()), key=str)
    assert out == sorted([(1, 3, 0)] * 4 + [(None, 5, 0), (6, 0, 0), (7, 20, 0)], key=str)
    left = decontaminate.clean(t, bench)
    assert sorted(map(str, left.collect())) == sorted(map(str, t.where("doc_id IN (2, 3, 4, 5, 8) OR doc_id IS NULL AND text LIKE 'clean%'").collect()))
    assert {(g["doc_id"], g["item_id"]) for g in decontaminate.contaminated(t, bench, least_words=4).collect()} >= {(8, 21)}
    t.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    query = decontaminate.op10_benchmark_decontamination(spark, str(tmp_path))
    assert query.columns == ["doc_id", "item_id", "edits", "first_word", "n_words"] and query.count() == len(out)


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    r = random.Random(5)
    texts = ["", None, "a" * 5000, "<|endoftext|>x<|endoftext|>", " \n\n\t x  ", "日本語 ½²³ ١٢٣", "🙂 é\x00", "it's WE'LL 'sab ''s"]
    texts += ["".join(r.choice("aAbB \n'sté1½,.!") for _ in range(200)) for _ in range(60)] + ["'".join(r.choice(["s", "re", "ll", "d", " ", "\n", ""]) for _ in range(50)) for _ in range(60)]
    got = {g["doc_id"]: g for g in bpe.encode(docs(spark, list(enumerate(texts)))).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ",".join(map(str, ids)) and got[i]["decoded"] == t.decode(ids, skip_special_tokens=False) and got[i]["n_tokens"] == len(ids)


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"].split()
    del mit[40:44]
    rows = [(1, "code here\n" + " ".join(mit)), (2, "Released under the MIT License. And again: released under the mit license!"), (3, None), (4, ""), (5, "nothing to see under the sun"), (6, licenses.TEMPLATES["GPL-3.0"])]
    out = licenses.find_licenses(docs(spark, rows)).collect()
    assert sorted((g["doc_id"], g["license"]) for g in out) == [(1, "MIT"), (2, "MIT-notice"), (2, "MIT-notice"), (6, "GPL-3.0")]
    one = next(g for g in out if g["doc_id"] == 1)
    assert 0.95 < one["coverage"] < 1 and rows[0][1].encode()[one["first_byte"] : one["end_byte"]].startswith(b"Permission")


def test_licenses_with_runs_put_in_or_left_out(spark):
    mit, r = licenses.TEMPLATES["MIT"].split(), random.Random(13)
    cut = mit[:80] + mit[88:]
    put = mit[:80] + words(r, 40).split() + mit[80:]
    numbered = [x for i, w in enumerate(mit) for x in ([f"n{i}", w] if i % 10 == 5 else [w])]
    notice = "Released under the MIT License."
    rows = [(1, " ".join(cut)), (2, words(r, 30) + " " + " ".join(put) + " " + words(r, 30)), (3, " ".join(numbered)), (4, (notice + " ") * 150 + " ".join(mit)), (5, " ".join(mit[:60]))]
    out = licenses.find_licenses(docs(spark, rows)).collect()
    got = {(i, n): sorted((g["matched_words"], g["first_byte"], g["end_byte"]) for g in out if (g["doc_id"], g["license"]) == (i, n)) for i, n in {(g["doc_id"], g["license"]) for g in out}}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (3, "MIT"), (4, "MIT"), (4, "MIT-notice")}
    n = len(licenses.Index({"MIT": licenses.TEMPLATES["MIT"]}).words[0])
    assert [got[i, "MIT"][0][0] for i in (1, 2, 3, 4)] == [n - 8, n, n, n] and len(got[4, "MIT-notice"]) == 150
    assert rows[1][1].encode()[slice(*got[2, "MIT"][0][1:])].decode() == " ".join(put).rstrip(".")


def nearest_plainly(rows, queries, k=5):
    """rows, queries: (id, vector): per query id its k best (rank, id, score), an id once."""
    out = {}
    for q in sorted({i for i, _ in queries}):
        v = min(x for i, x in queries if i == q)
        best = {}
        for i, x in rows:
            if i != q and len(x) == len(v):
                s = sum(a * b for a, b in zip(x, v)) / (sum(a * a for a in x) ** 0.5 * sum(b * b for b in v) ** 0.5)
                best[i] = max(best.get(i, -9), s)
        out[q] = sorted(((-round(s, 12), i) for i, s in best.items()))[:k]
    return out


def test_neighbours_equal_brute_force(spark, tmp_path):
    r = np.random.default_rng(6)
    x = (r.normal(size=(900, 64)) + (np.arange(900) % 7)[:, None] * 0.1).astype(np.float32)
    x[1:200:3] = x[0]
    good = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(2200, [1.0, 2.0]), (50, [float(c) for c in x[50]]), (7, [float(c) for c in x[8]]), (7, [float(c) for c in x[7]]), (100, [float(c) for c in x[100] * 2])]
    bad = [(2000, None), (2050, [0.0] * 64), (2100, [float("nan")] * 64), (2150, []), (None, [1.0] * 64), (100, [None] * 64), (2250, [float("inf")] + [0.0] * 63)]
    t = spark.createDataFrame([(i, v, "clash") for i, v in good + bad], "vec_id long, embedding array<float>, score string")
    t.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for g in ann.op3_nearest_neighbours(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], g["score"]))
    want = nearest_plainly(good, [(i, v) for i, v in good if i % 50 == 0])
    assert set(got) == {q for q, found in want.items() if found} and set(got) == set(range(0, 900, 50))
    assert all([n for n, *_ in rows] == list(range(1, 6)) and len({i for _, i, _ in rows}) == 5 for rows in got.values())
    hit = sum(len({i for _, i, _ in got[q]} & {i for _, i in want[q]}) for q in got)
    assert hit >= 0.98 * 5 * len(got)
    for q, rows in got.items():
        scores = {i: -s for s, i in want[q]}
        assert [(i, s, scores[i]) for _, i, s in rows if i in scores and abs(s - scores[i]) > 1e-9] == []
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)


def test_neighbours_of_few_rows(spark):
    v = lambda *rows: spark.createDataFrame(list(rows), "id long, v array<double>")
    both = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])]
    got = [(g["query_id"], g["rank"], g["id"]) for g in ann.nearest(v(*both), v(*both[:2])).orderBy("rank").collect()]
    assert got == [(1, 1, 2), (1, 2, 3)]
    assert ann.nearest(v((1, [1.0])), v((1, [1.0]))).count() == ann.nearest(v((1, [1.0])), v((2, [1.0, 1.0]))).count() == 0


def test_chat_is_reversible(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", "<\\|x <\\\\| \\"), (2, 0, "assistant", None), (2, 1, None, ""), (3, 0, "ro\nle\\n<|", "t\n"), (3, 0, "ro\nle\\n<|", "t\n"), (None, 0, "user", "x"), (4, 0, "system", "a"), (4, 1, "user", "b"), (4, 2, "user", "c")]
    out = {g["conv_id"]: g for g in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    t = chat.Template()
    for c in (1, 2, 3, 4, None):
        assert chat.read_back(out[c]["formatted"], t) == [(r or "", x or "") for i, _, r, x in rows if i == c]
    assert [chat.unescape(out[1]["formatted"][s["start"] : s["end"]], t) for s in out[1]["segments"] if s["loss"]] == [rows[1][3]]
    assert out[1]["valid"] and not out[2]["valid"] and out[4]["error_turn"] == 2 and out[2]["error_turn"] == 0


def test_chats_that_end_with_the_user(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "system", "a")]
    out = {g["conv_id"]: (g["valid"], g["error_turn"]) for g in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out == {1: (False, 1), 2: (True, None), 3: (False, 1)}


def test_other_templates_escape_their_own_marks():
    t = chat.Template(begin="[INST]", end="[/INST]", between=" ", after_role=": ", marks=("[INST]", "[/INST]"))
    r = random.Random(15)
    turns = [("".join(r.choice(["[INST]", "[/INST]", "[", "\\", ": ", "n", "INST]"]) for _ in range(r.randrange(8))), "".join(r.choice(["[INST]", "[\\INST]", "[/INST]", "[", "/INST]", "\\", " ", ": "]) for _ in range(r.randrange(9)))) for _ in range(300)]
    assert chat.read_back("".join(x for x, _ in chat.segments(turns, t)), t) == turns
    for bad in ({"marks": ("<\\|",)}, {"marks": ("<|<",)}, {"begin": "[INST]"}, {"after_role": ""}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_secrets(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'x\ntoken = "{key}" y'), (2, "sha256 " + key), (3, None), (4, ""), (5, "anordinarylongwordofletters1 here"), (6, f'é token = "{key}"'), (None, f'api_key="{key}"')]
    t = docs(spark, rows).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS path")
    out = {g["doc_id"]: g for g in secrets.find_secrets(t).collect()}
    assert set(out) == {1, 6, None} and out[1]["secret_sha256"] == hashlib.sha256(key.encode()).hexdigest()
    assert rows[5][1][out[6]["first_char"] - 1 :][:40] == key
    forest = secrets.default_forest()

    def score(tree, x):
        while not isinstance(tree, int):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    held = secrets.findings(400, seed=77)
    good = sum((sum(score(t, secrets.features(*f[:4])) for t in forest) / len(forest) >= 500) == bool(f[4]) for f in held)
    assert good >= 0.95 * len(held)


def test_secrets_without_a_digit(spark):
    r = random.Random(14)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    of = lambda k, s=letters: "".join(r.choice(s) for _ in range(k))
    rows = [(i, f'conf api_key = "{of(20)}" end') for i in range(40)] + [(100 + i, f'the password: "{of(16)}"') for i in range(40)]
    rows += [(200 + i, f"uses AKIA{of(16, letters[:26])} here") for i in range(40)]
    rows += [(300 + i, f"some {w} here") for i, w in enumerate(["internationalization", "thanonontioniner", "uncharacteristically", "ERSCHSCHBERBERTZ", "get_user_name_from_session", "src/main/java/com/example", "-" * 30, "=" * 20])]
    rows += [(400, "token = get_token_from_session(user)"), (401, "the token internationalization is long")]
    t = docs(spark, rows).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS path")
    found = {g["doc_id"] for g in secrets.find_secrets(t).collect()}
    assert all(sum(a <= i < a + 40 for i in found) >= 36 for a in (0, 100, 200)) and not any(i >= 300 for i in found)


def test_secret_spans(spark):
    """A finding is the value alone, whatever names it; padding belongs to it; contexts reach over the candidate before."""
    held = [
        ("API_KEY=", "ghp_aB3dE5fG7hJ9kL1mN3pQ5rS7tU9vW1xY3zA5", " x"),
        ("aws_secret_access_key=", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzzzzzzKEYx1", ""),
        ("é password: '", "hunter2!xy", "'"),
        ("pwd=", "Tr0ub4dor&3", ";"),
        ("api_key = ", "QUJDREVGR0hJSktMTU5PUFFSU1RVVg==", " end"),
    ]
    none = ["token = get_token_from_session(user)", "secret: nevermind about it", "token=${TOKEN_VALUE}", "the password: required field", "1234567890123456 card", "sha256 " + "ab12" * 16]
    rows = [(i, a + b + c) for i, (a, b, c) in enumerate(held)] * 2 + [(100 + i, x) for i, x in enumerate(none)] + [(200, " ".join(none) + "\n" + "".join(held[0]))]
    t = docs(spark, rows).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS path", "'clash' AS c", "'clash' AS score")
    out = sorted((g["doc_id"], g["first_char"], g["n_chars"], g["secret_sha256"]) for g in secrets.find_secrets(t).collect())
    found = lambda i, at, x: (i, at + 1, len(x), hashlib.sha256(x.encode()).hexdigest())
    assert out == sorted([found(i, len(a), b) for i, (a, b, _) in enumerate(held)] * 2 + [found(200, len(" ".join(none)) + 1 + len(held[0][0]), held[0][1])])


def test_secrets_planted_in_documents(spark):
    """Precision and recall on the tokens that the table holds."""
    d = "/root/testdata/sf0.01"
    t = spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text").collect()
    want = {(g["doc_id"], m.start(1) + 1) for g in t for m in re.finditer('(?i)token = "([0-9a-f]{40})"', g["text"])}
    got = {(g["doc_id"], g["first_char"]) for g in secrets.op8_secret_scan(spark, d).collect()}
    assert want and len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_quality_from_positives_and_unlabelled():
    from talus.llm._features import text_features

    r = random.Random(8)
    good = lambda: ". ".join(words(r, r.randrange(8, 20), 900).capitalize() for _ in range(r.randrange(2, 8))) + "."
    bad = lambda: r.choice([" | ".join(words(r, 60, 900).split()), "%%% ".join(words(r, 60, 900).split()), "spam " * 80, words(r, 60, 900).upper() + "!!"])
    f = lambda texts: text_features(*buffers(pa.array(texts)))
    net = quality.fit_arrays(f([good() for _ in range(300)]), f([good() if i % 10 < 7 else bad() for i in range(600)]))
    assert 0.5 < net.prior < 0.85
    assert (net.score(f([good() for _ in range(200)])) >= 0.7).mean() >= 0.95 and (net.score(f([bad() for _ in range(200)])) < 0.7).mean() >= 0.95
    assert np.isfinite(net.score(f(["", None, "x" * 200_000]))).all()


def test_toxicity_with_unseen_misspellings():
    r = random.Random(9)
    insults = ["worthless", "pathetic", "disgusting", "horrible"]

    def text(toxic, spell=lambda w: w):
        w = words(r, r.randrange(30, 120), 600).split()
        for _ in range(3 if toxic else 0):
            w[r.randrange(len(w))] = spell(r.choice(insults))
        return " ".join(w)

    y = np.array([i % 3 == 0 for i in range(900)])
    m = toxicity.train(*buffers(pa.array([text(t) for t in y])), y.astype(int), 1 / 3)
    s = lambda texts: m.score(*buffers(pa.array(texts)))
    assert (s([text(True) for _ in range(100)]) >= 0.3).mean() > 0.95 and (s([text(False) for _ in range(100)]) < 0.3).mean() > 0.95
    assert (s([text(True, lambda w: w[:3] + w[3] + w[3:]) for _ in range(100)]) >= 0.3).mean() > 0.7
    assert s(["", None])[0] == pytest.approx(1 / 3, abs=0.01)


def test_pipeline_equals_plain_version(spark, tmp_path):
    """Every stage over small tables: lines, near-copies, benchmark and tokens by plain code; without labels the first stage keeps all."""
    tokenizers = pytest.importorskip("tokenizers")
    import corpus_pipeline

    r = random.Random(21)
    items = [(i, words(r, 20, 3000)) for i in range(4)]
    base = [words(r, 60, 3000) for _ in range(4)]
    line = words(r, 9, 3000)
    rows = [(i, words(r, 30, 3000) + "\n" + words(r, 12, 3000)) for i in range(12)]
    rows += [(20 + i, base[i % 4] + "\n" + words(r, 3, 3000)) for i in range(8)] + [(40, base[0].upper()), (41, edited(r, base[1], 2))]
    rows += [(50 + i, words(r, 20, 3000) + " " + " ".join(with_edits(r, items[i][1].split(), i % 3)) + " " + words(r, 10, 3000)) for i in range(4)]
    rows += [(60 + i, f"{words(r, 15, 3000)}\n{edited(r, line, i % 2)}\n{words(r, 15, 3000)}") for i in range(4)]
    rows += [(70, None), (71, ""), (72, "x"), (None, base[2]), (73, "y " * 3000 + words(r, 50, 3000)), (5, rows[5][1])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone string"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    known = {i: t for i, t in rows if i is not None}
    gone = removed([(i, t) for i, t in known.items() if t is not None])
    docs_ = [(i, t if i is None or not t or not gone[i] else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])) for i, t in [*known.items(), (None, base[2])]]
    docs_ = [(i, t) for i, t in docs_ if i is None or not gone.get(i) or t]
    sets, root = {i: shingles(t, 5) for i, t in docs_ if i is not None}, {}
    for i in sorted(sets):
        near = [j for j in root if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        root[i] = min([root[j] for j in near], default=i)
    docs_ = [(i, t) for i, t in docs_ if i is None or root[i] == i]
    plain = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    docs_ = [(i, t) for i, t in docs_ if not any(distance_table(x.split(), plain(t), 0) <= int(0.15 * len(x.split()) + 1e-9) for _, x in items if len(plain(t)) > 16)]
    code = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    want = sorted(((i, ",".join(map(str, code.encode(t or "", add_special_tokens=False).ids)), t or "") for i, t in docs_), key=str)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "ids", "decoded", "n_tokens"} <= set(out.columns)
    assert sorted(((g["doc_id"], g["ids"], g["decoded"]) for g in out.collect()), key=str) == want
    assert 10 < len(want) <= len(rows) - 6
    docs0 = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs0.limit(0), str(tmp_path)).columns == docs0.columns and stage(spark, docs0.limit(0), str(tmp_path)).count() == 0


def test_queries_keep_their_contracts(spark):
    """Through the registered queries: columns, held-out rows, thresholds, the added conversation, exact digests."""
    tokenizers = pytest.importorskip("tokenizers")
    import zlib

    d = "/root/testdata/sf0.001"
    texts = [(g["doc_id"], g["text"]) for g in spark.read.parquet(f"{d}/documents.parquet").collect()]
    for q, cut in ((toxicity.op4_toxicity, 0.3), (quality.op6_quality_classifier, 0.7)):
        out = q(spark, d).collect()
        assert sorted(g["doc_id"] for g in out) == sorted(i for i, _ in texts)
        assert all(g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2) and g["predicted"] == int(g["score"] >= cut) and 0 <= g["score"] <= 1 for g in out)
    code = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for i, t in texts:
        ids = code.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(code.decode(ids, skip_special_tokens=False)))
    assert {g["doc_id"]: (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) for g in bpe.op7_bpe_encode_decode(spark, d).collect()} == want
    talk = {g["conv_id"]: g for g in chat.op9_chat_format(spark, d).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    assert (talk[-1]["n_turns"], talk[-1]["loss_chars"], talk[-1]["loss_sha256"]) == (2, len(said), sha(said)) and talk[-1]["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n")


def test_licenses_equal_plain_alignment(spark):
    """Coverage against the longest common subsequence of template and text, on texts that hold one edited template or none."""
    r = random.Random(22)
    names = [n for n in licenses.TEMPLATES if "notice" not in n]
    plain = lambda t: re.findall("[a-z0-9]+", t.lower())

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rows, want = [], {}
    for i in range(40):
        name = names[i % len(names)]
        w = plain(licenses.TEMPLATES[name])
        for _ in range(r.randrange(0, len(w) // 6)):
            w[r.randrange(len(w))] = f"z{r.randrange(99)}"
        rows.append((i, words(r, r.randrange(30)) + " " + " ".join(w) + " " + words(r, r.randrange(30))))
        share = common(plain(licenses.TEMPLATES[name]), w) / len(plain(licenses.TEMPLATES[name]))
        if share >= 0.8:
            want[i] = (name, share)
    rows += [(100 + i, words(r, 200)) for i in range(10)]
    out = {}
    for g in licenses.find_licenses(docs(spark, [*rows, rows[0]]).withColumn("license", F.lit("clash"))).collect():
        if "notice" not in g["license"]:
            out.setdefault(g["doc_id"], []).append((g["license"], g["coverage"]))
    assert len(out.pop(0)) == 2 and all(len(v) == 1 for v in out.values())
    got = {i: v[0] for i, v in out.items()}
    assert set(got) <= set(want) and len(got) >= 0.9 * (len(want) - 1)
    assert all(got[i][0] == want[i][0] and got[i][1] <= want[i][1] + 1e-9 and got[i][1] >= want[i][1] - 0.03 for i in got)


def test_licenses_alike_are_told_apart(spark):
    """One row a text, of the licence itself: also where templates differ by a word or hold one another."""
    names = [n for n in licenses.TEMPLATES if "notice" not in n]
    out = licenses.find_licenses(docs(spark, [(i, "before it " + licenses.TEMPLATES[n] + " and after") for i, n in enumerate(names)])).collect()
    assert sorted((g["doc_id"], g["license"], g["coverage"]) for g in out) == [(i, n, 1.0) for i, n in enumerate(names)]


def test_the_band_loses_no_alignment():
    """Alignments in the band against those in a band over everything, for texts with words put in, left out and replaced."""
    r = np.random.default_rng(5)
    for trial in range(30):
        m = int(r.integers(4, 30))
        template = r.integers(0, 40, m).astype(np.uint64)
        mid = [x for w in template.tolist() for x in ([] if r.random() < 0.1 else [w] + [99] * int(r.integers(0, 3) * (r.random() < 0.2)))]
        text = np.array([*r.integers(0, 60, 5 * m), *mid, *r.integers(0, 60, 5 * m)], np.uint64)
        pairs = [(p, q) for p in range(len(text) - 1) for q in range(m - 1) if text[p] == template[q] and text[p + 1] == template[q + 1]]
        if not pairs:
            continue
        votes, places = np.array(sorted(pairs)).T
        near, wide = (licenses.align(template, text, d) for d in (np.unique(votes - places), np.arange(-m, len(text))))
        best = int(wide[1].argmax())
        held = any(wide[2][best] <= p <= best for p in votes)
        assert not held or all(near[k][best] == wide[k][best] for k in range(3)), trial


def test_licenses_of_few_words_and_odd_rows(spark):
    own = {"WTFPL": "WTFPL", "Zero": "Public Domain", "MIT": licenses.TEMPLATES["MIT"]}
    rows = [(1, "this is WTFPL."), (2, "wtfpl"), (3, "In the public domain since 1990"), (3, "In the public domain since 1990"), (4, "public, the domain"), (5, "x " * 100_000 + own["MIT"]), (None, "WTFPL"), (6, None), (7, "")]
    out = licenses.find_licenses(docs(spark, rows).withColumn("coverage", F.lit("clash")), own).collect()
    assert sorted(((g["doc_id"], g["license"]) for g in out), key=str) == sorted([(1, "WTFPL"), (2, "WTFPL"), (3, "Zero"), (3, "Zero"), (5, "MIT"), (None, "WTFPL")], key=str)
    assert licenses.find_licenses(docs(spark, []), own).count() == 0
