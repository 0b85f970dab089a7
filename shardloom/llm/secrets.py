"""Operator 9: secret scan with a random forest that removes false findings. DataFrame functions only.

Candidates and their features are SQL expressions. The forest is trained on the driver from labelled
findings, made by rule with a fixed seed, whose features the same expressions give; it is applied as CASE
expressions.
"""

from __future__ import annotations

import functools
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words near a secret.
NEAR_SECRET = "token|secret|passw(?:or)?d|pwd|api[_ -]?key|apikey|access[_ -]?key|private|credential|auth|bearer|client_secret"
#: What can be a secret: a private key's first line, any value behind = or : whose name has a word of NEAR_SECRET, a quoted value
#: behind another name's = or :, a key with a well-known beginning, or a long run with a digit.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    rf"|(?<=[:=>] ?[\"']?)(?<=(?i:{NEAR_SECRET})[\w-]{{0,20}}[\"']? ?[:=]{{1,2}}>? ?[\"']?)(?![:=>])[^\s\"']+"
    r"|(?<=[:=] ?[\"'])[^\s\"']{8,}(?=[\"'])"
    r"|(?<![A-Za-z0-9_+/-])(?:gh[pousr]_|sk[-_](?:live|test)[-_]|xox[abprs]-|AIza|eyJ)[A-Za-z0-9_+/-]{12,}={0,2}"
    r"|(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]{0,64}[0-9])[A-Za-z0-9_+/-]{16,}={0,2}"
)
BEFORE, AFTER = 48, 24
CHUNK = 128  # candidates whose places are added up at a time
#: Words whose letters count as covered by a dictionary; words near other things that look like a secret.
DICTIONARY = "the and ing tion example sample test dummy your place holder insert change here user admin name file data image index page home version config public static assets build release value number order item account customer string secret password token key client server service update report image content article default hello world foo bar baz qwerty letmein abc".split()
NEAR_OTHER = "commit|sha-?\\d*|md5|checksum|digest|hash|etag|revision|integrity|uuid|guid|card|phone|order|invoice|isbn|tracking|serial|version|build"
PLACEHOLDER = "x{4,}|example|sample|dummy|changeme|placeholder|your[_-]|<|\\$\\{|\\*{3,}|0{8,}|1234567"
TREES, DEPTH, LEAST = 25, 6, 0.5


def features(before: Column, value: Column, after: Column) -> list[tuple[str, Column]]:
    """Numbers that the forest sees, all double."""
    n = F.greatest(F.char_length(value), F.lit(1))
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    flag = lambda col, pattern: F.when(col.rlike(f"(?i){pattern}"), 1.0).otherwise(0.0)
    covered = n - F.char_length(F.regexp_replace(F.lower(value), "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    kinds = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"
    return [
        ("length", n.cast("double")),
        ("transitions", (F.size(F.split(value, kinds)) - 1) / n),
        ("digits", share("[0-9]")),
        ("upper", share("[A-Z]")),
        ("hex", share("[0-9a-fA-F]")),
        ("marks", share("[^A-Za-z0-9]")),
        ("distinct", F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(40))),
        ("dictionary", covered / n),
        ("path", F.when(F.concat(F.substring(before, -1, 1), value, F.substring(after, 1, 1)).rlike(r"/[^/]+/|^[/.]|[/.]$|\.[a-z]{2,4}$"), 1.0).otherwise(0.0)),
        ("url", flag(before, r"(?:https?:|www\.)[^\s]*$")),
        ("assigned", flag(before, r"[:=] ?[\"']?$")),
        ("near_secret", flag(before, rf"(?:{NEAR_SECRET})[^\n]{{0,20}}$")),
        ("near_other", flag(before, rf"(?:{NEAR_OTHER})[^\n]{{0,20}}$")),
        ("placeholder", flag(value, PLACEHOLDER)),
        ("known", flag(value, r"^(?:AKIA[0-9A-Z]{16}$|gh[pousr]_|sk[-_](?:live|test)|xox[abprs]-|AIza|eyJ|-----BEGIN)")),
        ("uuid", flag(value, r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")),
    ]


def labelled_findings(seed: int = 11, each: int = 70) -> list[tuple[str, str, str, int]]:
    """(before, value, after, label) rows made by rule: label 1 is a secret."""
    rnd = random.Random(seed)
    pick = lambda chars, a, b=None: "".join(rnd.choice(chars) for _ in range(rnd.randint(a, b or a)))
    hexa, alnum, b64 = string.hexdigits[:16], string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    word = lambda: "".join(rnd.choice("th er on an re he in ed nd ha at en es of or nt ea ti to it".split()) for _ in range(rnd.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(rnd.randint(0, 5)))
    name = lambda: rnd.choice(["token", "secret", "api_key", "password", "apikey", "access_key", "client_secret", "auth_token", "TOKEN", "SECRET_KEY", "private_key"])
    sep = lambda: rnd.choice([' = "', ': "', "=", ": ", "='", ' := "'])
    other = lambda: rnd.choice(["commit ", "sha1: ", "md5=", "checksum: ", "digest ", "etag: ", "hash = ", "revision ", "integrity=", "build "])
    plain = lambda: rnd.choice(["", "id ", "see ", "no. ", "card ", "order ", "ref "])
    rows = []
    for _ in range(each):
        for value in (pick(hexa, 32), pick(hexa, 40), pick(hexa, 64), pick(hexa, 40).upper(), pick(alnum, 20, 44), pick(b64, 24, 60) + "=" * rnd.randint(0, 2), pick(alnum + "!@#%^&*", 10, 20)):
            rows.append((f"{prose()} {name()}{sep()}", value, '" ' + prose(), 1))
        for value in ("AKIA" + pick(string.ascii_uppercase + string.digits, 16), "ghp_" + pick(alnum, 36), "sk_live_" + pick(alnum, 24), "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24)):
            rows.append((f"{prose()} {rnd.choice(['', name() + sep(), 'key '])}", value, " " + prose(), 1))
        rows.append((prose() + " ", "-----BEGIN " + rnd.choice(["RSA ", "EC ", ""]) + "PRIVATE KEY-----", "\n", 1))
        for value in (pick(hexa, 32), pick(hexa, 40), pick(hexa, 64)):
            rows.append((f"{prose()} {other()}", value, " " + prose(), 0))
        for value in (pick(string.digits, 16), pick(string.digits, 16, 22), f"{pick(hexa, 8)}-{pick(hexa, 4)}-4{pick(hexa, 3)}-{pick(hexa, 4)}-{pick(hexa, 12)}", pick("-_", 1) + pick(string.digits, 18)):
            rows.append((f"{prose()} {plain()}", value, " " + prose(), 0))
        slug = "-".join(word() for _ in range(4)) + "-" + pick(string.digits, 1, 4)
        rows.append((f"{prose()} https://{word()}.example/", f"{word()}/{word()}/{slug}", "/ " + prose(), 0))
        rows.append((f"{prose()} ", f"{word()}_{word()}_{word()}_{word()}_{pick(string.digits, 1, 3)}", " " + prose(), 0))
        rows.append((f"{prose()} {name()}{sep()}", rnd.choice(["your_api_key_12345678", "XXXXXXXXXXXXXXXX1234", "example_token_1234567", "changeme12345678", "dummy-secret-00000000", "<your-token-1234567>", "placeholder_value_01"]), '" ' + prose(), 0))
        rows.append((f"{prose()} {rnd.choice(['title', 'name', 'label', 'city'])}{sep()}", f"{word()}{word()}{word()}{pick(string.digits, 0, 3)}".ljust(8, "e"), '" ' + prose(), 0))
        rows.append((f"{prose()} ", f"{rnd.randint(2000, 2030)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}-{word()}-{word()}-release", " " + prose(), 0))
        rows.append((f"{prose()} ", word() + word() + word() + word() + word() + pick(string.digits, 1, 2), " " + prose(), 0))
    return rows


def grow(x: np.ndarray, y: np.ndarray, rnd: np.random.Generator, depth: int):
    """A tree: a leaf's share of label 1, or (feature, threshold, tree if <=, tree if >)."""
    p = float(y.mean())
    if depth == 0 or len(y) < 6 or p in (0.0, 1.0):
        return p
    best = None
    for f in rnd.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False):
        for t in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 15))):
            left = x[:, f] <= t
            n = int(left.sum())
            if not 0 < n < len(y):
                continue
            a, b = y[left].mean(), y[~left].mean()
            gini = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
            if best is None or gini < best[0]:
                best = (gini, int(f), float(t), left)
    if best is None:
        return p
    _, f, t, left = best
    return f, t, grow(x[left], y[left], rnd, depth - 1), grow(x[~left], y[~left], rnd, depth - 1)


@functools.lru_cache(maxsize=1)
def train_forest(spark: SparkSession, seed: int = 5) -> tuple:
    """TREES trees, each on a bootstrap sample of the labelled findings."""
    rows = labelled_findings()
    df = spark.createDataFrame(rows, "b string, v string, a string, y int")
    got = df.select(*(c.cast("double").alias(n) for n, c in features(F.col("b"), F.col("v"), F.col("a"))), "y").collect()
    data = np.array([list(r) for r in got], float)
    x, y = data[:, :-1], data[:, -1]
    rnd = np.random.default_rng(seed)
    trees = []
    for _ in range(TREES):
        at = rnd.integers(0, len(y), len(y))
        trees.append(grow(x[at], y[at], rnd, DEPTH))
    return tuple(trees)


def as_sql(tree, names: list[str]) -> str:
    """A tree as a CASE expression."""
    if isinstance(tree, float):
        return f"{tree:.6f}D"
    f, t, a, b = tree
    return f"CASE WHEN {names[f]} <= {t!r}D THEN {as_sql(a, names)} ELSE {as_sql(b, names)} END"


def secret_findings(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per candidate: (key, position, length, value_sha256, score, secret).

    `position` counts code points from 0. `score` is the mean over the forest's trees of the share of
    secrets in the leaf; `secret` holds from LEAST up, other rows are findings that the forest takes for
    false. The value itself doesn't leave the operator. Null and empty texts and an empty table give no rows;
    repeated rows give repeated rows; other columns don't matter, and texts of any length are searched whole. No shuffle: a document's candidates come from its own text.
    """
    trees = train_forest(docs.sparkSession)
    cut = docs.where(F.col(text).rlike(CANDIDATE)).select(
        F.col(key).alias("k"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("m"), F.split(text, CANDIDATE, -1).alias("p")
    )
    # code points up to each candidate: the text between candidates, and the candidates before
    sizes = F.expr("transform(m, (x, i) -> char_length(p[i]) + if(i > 0, char_length(m[i - 1]), 0))")
    # their running sum in two steps, over chunks and within them, so that a text with many candidates costs no square of their number
    chunks = F.expr(f"transform(sequence(0, greatest(size(sizes) - 1, 0) div {CHUNK}), c -> slice(sizes, c * {CHUNK} + 1, {CHUNK}))")
    bases = F.expr("aggregate(chunks, array(0), (acc, ch) -> concat(acc, array(element_at(acc, -1) + aggregate(ch, 0, (s, x) -> s + x))))")
    starts = F.expr("flatten(transform(chunks, (ch, c) -> transform(ch, (x, i) -> bases[c] + aggregate(slice(ch, 1, i + 1), 0, (s, y) -> s + y))))")
    spots = cut.withColumn("sizes", sizes).withColumn("chunks", chunks).withColumn("bases", bases).withColumn("starts", starts)
    found = spots.select("k", F.posexplode(F.expr(f"transform(m, (x, i) -> struct(x as v, starts[i] as at, right(p[i], {BEFORE}) as b, left(p[i + 1], {AFTER}) as a))")).alias("i", "c"))
    columns = features(F.col("c.b"), F.col("c.v"), F.col("c.a"))
    scored = found.select("k", "c", *(x.cast("double").alias(n) for n, x in columns))
    names = [n for n, _ in columns]
    score = F.round(F.expr(" + ".join(as_sql(t, names) for t in trees)) / TREES, 6)
    return scored.select(
        F.col("k").alias(key), F.col("c.at").alias("position"), F.char_length("c.v").alias("length"), F.sha2("c.v", 256).alias("value_sha256"), score.alias("score")
    ).withColumn("secret", F.col("score") >= LEAST)
