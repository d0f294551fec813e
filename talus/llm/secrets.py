"""Secret scan on DataFrame functions alone: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 16 or more of ``A-Za-z0-9+/_-`` (with base64's padding, if the length asks for it), or whatever value of 8 or more
characters a name for a key is assigned (``NAMED``; the finding is the value, without the name). Its features are whole numbers that
built-in functions compute: length, shares of digits, capitals, vowels, other signs and different characters, changes of character class,
share covered by dictionary pieces, plain hexadecimal, known prefixes, neighbouring words (words for a key, words that say otherwise, an
assignment before it, a quote after it), and the path. The forest is trained from labelled findings (``findings()`` makes a seeded set;
``train`` takes any) on the driver when first asked for, and becomes a SQL expression, so the scan runs no Python. Finding the offsets takes
one exchange of the candidates alone.

Cases: null and empty texts have no candidate; a null path counts as empty; repeated rows give repeated findings; null ids are carried;
texts of any length are scanned whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A name for a key with what assigns it a value.
NAMED = r"(?i:(?:passw(?:or)?d|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]*[=:][ \t]*[\"'`]?)"
CANDIDATE = NAMED + r"[^ \t\r\n\"'`]{8,}|[A-Za-z0-9+/_-]{16,}"
#: What ends a sentence or a call isn't part of an assigned value.
CLOSING = r"[,;.)\]}>]+\z"
LEAST = 8
#: Pieces of common words: fixed values.
PIECES = (
    "tion|ing|ment|the|and|ent|ion|ver|ter|que|eau|lich|keit|ung|sch|est|ect|con|com|www|http|src|test|main|file|name|class|data|index|value|user|version|page|item|list|"
    "get|set|env|environ|process|config|default|required|session|request|response|client|server|change|your|example|none|null|true|false|string|token|secret|password|key|auth|login|"
    "access|private|public|some|this|that|with|from|have|will|over|under|able|ness|less|ful|pre|pro|ance|ence|ough|ight|tive|sion|ally|ough|word|time|work|hand|open|read|write|path"
)
KEY_WORDS = "token|secret|passw|pwd|api[_-]?key|access[_-]?key|private|credential|bearer|auth"
DOUBT_WORDS = "sha1|sha256|md5|commit|digest|checksum|hash|uuid|guid|example|sample|dummy|placeholder|integrity|revision|order|invoice|isbn|phone|card"
PREFIXES = "AKIA|ASIA|AIza|ghp_|gho_|glpat-|xox[bap]-|sk-|sk_live|eyJ"
NAMES = (
    "size",
    "digits",
    "capitals",
    "vowels",
    "signs",
    "different",
    "changes",
    "dictionary",
    "hexadecimal",
    "prefix",
    "key_word",
    "doubt_word",
    "assigned",
    "quoted",
    "test_path",
)
TREES, DEPTH, LEAF = 25, 5, 1000


def quoted(pattern: str, dialect: str) -> str:
    """A SQL string literal."""
    text = pattern.replace("\\", "\\\\").replace("'", "\\'") if dialect == "spark" else pattern.replace("'", "''")
    return f"'{text}'"


def feature_sql(dialect: str) -> list[str]:
    """Expressions over c (candidate), b (40 characters before it), a (after it) and p (path), in the order of NAMES."""
    spark = dialect == "spark"
    flag = ", 'g'" if not spark else ""
    div = "div" if spark else "//"
    sub = lambda what, x, by="": f"regexp_replace({x}, {quoted(what, dialect)}, '{by}'{flag})"
    part = lambda what, x="c": f"(100 * length({sub(what, x)}) {div} length(c))"
    has = lambda x, what: f"(CASE WHEN {'regexp' if spark else 'regexp_matches'}({x}, {quoted(what, dialect)}) THEN 1 ELSE 0 END)"
    runs = sub("[^A-Za-z0-9]+", sub("[0-9]+", sub("[A-Z]+", sub("[a-z]+", "c", "a"), "A"), "0"), "-")
    different = "size(array_distinct(split(c, '')))" if spark else "len(list_distinct(string_split(c, '')))"
    return [
        "length(c)",
        part("[^0-9]"),
        part("[^A-Z]"),
        part("[^aeiouAEIOU]"),
        part("[A-Za-z0-9+/=_-]"),
        f"(100 * {different} {div} length(c))",
        f"(100 * length({runs}) {div} length(c))",
        f"(100 * (length(c) - length({sub(PIECES, 'lower(c)')})) {div} length(c))",
        has("c", r"^[0-9a-fA-F]+\z"),
        has("c", f"^({PREFIXES})"),
        has("b", f"(?i)({KEY_WORDS})"),
        has("b", f"(?i)({DOUBT_WORDS})"),
        has("b", r"[=:][ \"'`]*\z"),
        has("a", "^[\"'`]"),
        has("p", "(?i)(test|example|fixture|sample|docs?/|mock)"),
    ]


def features(c: str, b: str, a: str, p: str) -> list[int]:
    """The same numbers in Python, for training."""
    count = lambda what, x=c: 100 * len(re.sub(what, "", x)) // len(c)
    runs = re.sub("[^A-Za-z0-9]+", "-", re.sub("[0-9]+", "0", re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", c))))
    has = lambda x, what: int(bool(re.search(what, x)))
    return [
        len(c), count("[^0-9]"), count("[^A-Z]"), count("[^aeiouAEIOU]"), count("[A-Za-z0-9+/=_-]"), 100 * len(set(c)) // len(c), 100 * len(runs) // len(c),
        100 * (len(c) - len(re.sub(PIECES, "", c.lower()))) // len(c), has(c, r"^[0-9a-fA-F]+\Z"), has(c, f"^({PREFIXES})"), has(b, f"(?i)({KEY_WORDS})"), has(b, f"(?i)({DOUBT_WORDS})"),
        has(b, r"[=:][ \"'`]*\Z"), has(a, "^[\"'`]"), has(p, "(?i)(test|example|fixture|sample|docs?/|mock)"),
    ]


def findings(n: int = 1600, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings: candidate, text before and after, path, 1 for a secret."""
    r = random.Random(seed)
    hexa, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    of = lambda s, k: "".join(r.choice(s) for _ in range(k))
    word = lambda: "".join(r.choice(PIECES.split("|") + ["er", "on", "an", "re", "ha", "ou", "ai", "le", "elle", "pa", "mi", "do", "ru", "ka", "so"]) for _ in range(r.randint(1, 3)))
    prose = lambda k: " ".join(word() for _ in range(k))
    keys = ["token", "secret", "password", "api_key", "API_KEY", "access_key", "private_key", "Authorization: Bearer", "client_secret", "passwd"]
    doubts = ["sha256", "commit", "md5", "checksum", "uuid", "example", "invoice", "order", "digest", "integrity", "sample key"]
    paths = ["src3", "src12", "src/app/config.py", "deploy/env.yaml", "lib/net/client.go", "README", "web/index.html"]
    tests = ["tests/test_auth.py", "docs/example.md", "fixtures/keys.json", "mock/data.txt"]
    out = []
    for _ in range(n):
        kind = r.random()
        secret = r.choice([lambda: of(hexa, r.choice([32, 40, 64])), lambda: of(base, r.randint(16, 48)), lambda: of(base + "+/", 40), lambda: of(base[:52], r.randint(16, 32)), lambda: "AKIA" + of(base[:26] + "0123456789", 16), lambda: "ghp_" + of(base, 36), lambda: "sk-" + of(base, 40)])()
        before, after, path = prose(3) + " ", " " + prose(2), r.choice(paths)
        if kind < 0.4:  # named and assigned
            quote = r.choice(['"', '"', "", "`"])
            out.append((secret, before + r.choice(["", "", "", r.choice(doubts) + ".com "]) + r.choice(keys) + r.choice([" = ", "=", ": "]) + quote, quote + after, path, 1))
        elif kind < 0.47:  # only a known prefix
            out.append((r.choice(["AKIA" + of(base[:26] + "0123456789", 16), "ghp_" + of(base, 36), "glpat-" + of(base, 20), *["AKIA" + of(base[:26], 16), "ghp_" + of(base[:52], 36)][: r.randint(0, 2)]]), before, after, path, 1))
        elif kind < 0.62:  # digests and ids
            out.append((r.choice([of(hexa, r.choice([32, 40, 64])) + "0", "-".join(of(hexa, k) for k in (8, 4, 4, 4, 11)) + "1"]), before + r.choice(doubts) + r.choice([" ", "=", ": "]), after, path, 0))
        elif kind < 0.72:  # bare numbers and hashes in prose
            out.append((r.choice([of("0123456789", r.randint(16, 19)), of(hexa, 39) + "4"]), before, after, path, 0))
        elif kind < 0.87:  # words, paths, addresses, names after a key word
            number, case = r.choice([(str(r.randint(0, 99)), "1"), ("", "")]), r.choice([str, str.upper, str.capitalize])
            joined = case(r.choice(["_", "-", "/", "", ""]).join(word() for _ in range(5)) + number[0])
            out.append(((joined + "abcdefghijklmnop")[: max(16, len(joined))] + number[1], before + r.choice(["", "", "see ", "file = ", "token ", r.choice(keys) + " = "]), after, path, 0))
        elif kind < 0.94:  # placeholders in tests and documentation
            out.append((r.choice([secret, "x" * 20 + "0", "0123456789abcdef0123"]), before + "example " + r.choice(keys) + " = \"", "\"" + after, r.choice(tests), 0))
        else:  # rules of one sign
            out.append((r.choice("=-_") * r.randint(16, 40) + r.choice(["1", ""]), before, after, path, 0))
    for _ in range(n // 2):  # long words in prose: most candidates without a digit
        long = "".join(word() for _ in range(4)).ljust(16, "e")[: r.randint(16, 24)]
        out.append((r.choice([str, str.capitalize, str.upper])(long), prose(3) + r.choice([" ", ". ", "\n", "! "]), r.choice([" ", ". ", ", "]) + prose(2), r.choice(paths), 0))
    short, signs = ["password", "passwd", "pwd", "secret", "token", "api_key"], "!@#%^&*+~?-_."
    for _ in range(n // 4):  # passwords and short keys
        made = [
            of(base, r.randint(8, 15)),
            of(base + signs, r.randint(8, 20)),
            word().capitalize() + of("0123456789", r.randint(2, 4)) + of(signs, r.randint(1, 2)) + of(base, 3),
        ]
        quote = r.choice(['"', "'", "", "`"])
        out.append((r.choice(made).ljust(8, "7"), prose(2) + " " + r.choice(short) + r.choice([" = ", "=", ": "]) + quote, quote + " " + prose(2), r.choice(paths), 1))
    for _ in range(n // 4):  # what else a name for a key is assigned: words, references, calls, place-holders
        w, v = word(), word()
        made = [
            w + v,
            w,
            v.capitalize() + w,
            "${" + w.upper() + "}",
            "<" + w + "-" + v + ">",
            "os.environ[" + w.upper(),
            "process.env." + w.upper(),
            f"{w}({v}",
            f"{w}.{v}",
            "{{" + w,
            w + "_" + v,
            f"self.{w}_{v}",
            "x" * 8,
            "*" * 8,
            "....",
            "changeme",
        ]
        quote = r.choice(['"', "'", "", "", ""])
        out.append((r.choice(made).ljust(8, "e"), prose(2) + " " + r.choice(short) + r.choice([" = ", "=", ": "]) + quote, r.choice([quote, "("]) + " " + prose(2), r.choice(paths), 0))
    for _ in range(n // 12):  # names of functions and members after a key word
        name = r.choice("_-/").join(word() for _ in range(r.randint(4, 5))).ljust(16, "e")
        out.append((name, prose(3) + " " + r.choice(keys) + r.choice([" = ", "=", ": "]), r.choice(["(", ".", ";", " "]) + prose(2), r.choice(paths), 0))
    return [(c, b[-40:], a[:8], p, y) for c, b, a, p, y in out]


def train(rows: list[tuple[str, str, str, str, int]], trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list:
    """Random forest of Gini trees on bootstrap samples and random features: nested (feature, threshold, left, right) or a leaf of 0 to LEAF."""
    x, y = np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows])
    r = np.random.default_rng(seed)

    def grow(at: np.ndarray, left: int):
        share = y[at].mean()
        if left == 0 or len(at) < 8 or share in (0, 1):
            return int(round(LEAF * (y[at].sum() + 0.5) / (len(at) + 1)))
        best = None
        for f in r.choice(x.shape[1], 5, replace=False).tolist():
            order = at[np.argsort(x[at, f], kind="stable")]
            v, c = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] != v[:-1]) + 1
            if not len(cut):
                continue
            n1, n2 = cut, len(at) - cut
            p1, p2 = c[cut - 1] / n1, (c[-1] - c[cut - 1]) / n2
            gini = n1 * p1 * (1 - p1) + n2 * p2 * (1 - p2)
            k = int(gini.argmin())
            if best is None or gini[k] < best[0]:
                best = gini[k], f, int(v[cut[k] - 1])
        if best is None:
            return int(round(LEAF * (y[at].sum() + 0.5) / (len(at) + 1)))
        _, f, t = best
        low = x[at, f] <= t
        return f, t, grow(at[low], left - 1), grow(at[~low], left - 1)

    return [grow(r.integers(0, len(y), len(y)), depth) for _ in range(trees)]


def tree_sql(tree) -> str:
    if isinstance(tree, int):
        return str(tree)
    f, t, low, high = tree
    return f"CASE WHEN {NAMES[f]} <= {t} THEN {tree_sql(low)} ELSE {tree_sql(high)} END"


@lru_cache(maxsize=1)
def default_forest() -> tuple:
    return tuple(train(findings()))


def find_secrets(docs: DataFrame, forest: tuple | list | None = None, least_score: float = 0.5) -> DataFrame:
    """docs (doc_id, text, path): doc_id, first_char (from 1), n_chars, secret_sha256, score of each finding that the forest keeps."""
    q = lambda x: quoted(x, "spark")
    p = q(CANDIDATE)
    rows = docs.where(f"regexp(text, {p})").selectExpr("doc_id", "coalesce(path, '') AS p", f"regexp_extract_all(text, {p}, 0) AS found", f"split(text, {p}, -1) AS rest")
    rows = rows.selectExpr(
        "doc_id",
        "p",
        "found",
        "transform(rest, t -> struct(length(t) AS n, right(t, 40) AS b, left(t, 8) AS a)) AS rest",
    ).withColumn("row", F.monotonically_increasing_id())
    each = rows.selectExpr(
        "doc_id",
        "row",
        "p",
        "size(found) AS many",
        "posexplode(zip_with(zip_with(found, concat(array(''), found), (c, z) -> struct(c, z)), zip_with(slice(rest, 1, size(found)), slice(rest, 2, size(found)), (x, y) -> struct(x AS before, y AS after)), (c, z) -> struct(c.c AS found, c.z AS last, z.before AS before, z.after AS after))) AS (n, x)",
    )
    each = each.where("x.found IS NOT NULL").selectExpr(
        "doc_id",
        "row",
        "p",
        "n",
        "many",
        "x.found AS raw",
        "x.last AS last",
        "x.before AS before",
        "x.after AS after",
        f"regexp_extract(x.found, {q('^' + NAMED)}, 0) AS head",
    )
    each = each.selectExpr(
        "*",
        f"CASE WHEN head = '' THEN raw ELSE regexp_replace(substring(raw, length(head) + 1), {q(CLOSING)}, '') END AS v",
        "regexp_extract(after.a, '^={1,2}', 0) AS pad",
    )
    each = each.selectExpr(
        "*",
        "CASE WHEN head = '' AND pad <> '' AND (length(v) + length(pad)) % 4 = 0 AND NOT (after.n = length(pad) AND n + 1 < many) THEN concat(v, pad) ELSE v END AS c",
    )
    each = each.selectExpr(
        "doc_id",
        "row",
        "p",
        "n",
        "before.n + length(raw) AS size",
        "length(raw) - length(head) AS back",
        "c",
        "right(concat(last, before.b, head), 40) AS b",
        f"left(concat(CASE WHEN length(c) <= length(raw) - length(head) THEN substring(raw, length(head) + length(c) + 1) ELSE '' END, after.a), 8) AS a",
    )
    each = each.selectExpr("doc_id", "row", "p", "n", "size", "back", "inline(array(struct(c, b, a)))")  # what features ask for many times is made once
    named = ", ".join(f"'{n}', {e}" for e, n in zip(feature_sql("spark"), NAMES, strict=True))
    each = each.selectExpr("doc_id", "row", "n", "size", "back", f"CASE WHEN length(c) >= {LEAST} THEN named_struct('c', c, {named}) END AS f")
    order = Window.partitionBy("doc_id", "row").orderBy("n")  # features stand below this, so a filter on the score can't copy them into each tree
    each = each.withColumn("end", F.sum("size").over(order)).where("f IS NOT NULL").select("doc_id", "end", "back", "f.*")
    trees = forest or default_forest()
    total = f"aggregate(array({', '.join(map(tree_sql, trees))}), 0, (sum, x) -> sum + x)"  # so many branches are no part of one generated method
    scored = each.selectExpr(
        "doc_id",
        "end - back + 1 AS first_char",
        "CAST(length(c) AS BIGINT) AS n_chars",
        "sha2(c, 256) AS secret_sha256",
        f"CAST({total} AS DOUBLE) / {len(trees) * LEAF}D AS score",
    )
    return scored.where(F.col("score") >= least_score)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "source AS path"))


def oracle(forest: tuple | None = None, least_score: float = 0.5) -> str:
    """The same scan as DuckDB SQL."""
    forest = forest or default_forest()
    q = lambda x: quoted(x, "duckdb")
    named = ", ".join(f"{e} AS {n}" for e, n in zip(feature_sql("duckdb"), NAMES, strict=True))
    total = " + ".join(f"({tree_sql(t)})" for t in forest)
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS p, regexp_extract_all(text, {q(CANDIDATE)}) AS found, regexp_split_to_array(text, {q(CANDIDATE)}) AS rest FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, p, unnest(range(1, len(found) + 1)) AS n, found, rest FROM d WHERE len(found) > 0),
h AS (SELECT *, found[n] AS raw, regexp_extract(found[n], {q('^' + NAMED)}) AS head, regexp_extract(rest[n + 1], '^={{1,2}}') AS pad FROM e),
v AS (SELECT *, CASE WHEN head = '' THEN raw ELSE regexp_replace(raw[length(head) + 1:], {q(CLOSING)}, '') END AS v FROM h),
w AS (SELECT *, CASE WHEN head = '' AND pad <> '' AND (length(v) + length(pad)) % 4 = 0 AND NOT (rest[n + 1] = pad AND n < len(found)) THEN v || pad ELSE v END AS c FROM v),
x AS (SELECT doc_id, p, c, right((CASE WHEN n > 1 THEN found[n - 1] ELSE '' END) || rest[n] || head, 40) AS b, left((CASE WHEN length(c) <= length(v) THEN raw[length(head) + length(c) + 1:] ELSE '' END) || rest[n + 1], 8) AS a,
  CAST(list_sum(list_transform(rest[1:n], lambda t: length(t))) + coalesce(list_sum(list_transform(found[1:n - 1], lambda t: length(t))), 0) + length(head) + 1 AS BIGINT) AS first_char FROM w WHERE length(c) >= {LEAST}),
f AS (SELECT doc_id, c, first_char, {named} FROM x)
SELECT * FROM (SELECT doc_id, first_char, CAST(length(c) AS BIGINT) AS n_chars, sha256(c) AS secret_sha256, CAST({total} AS DOUBLE) / CAST({len(forest) * LEAF} AS DOUBLE) AS score FROM f) WHERE score >= {least_score}"""


QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLES = {"op8_secret_scan": oracle}
