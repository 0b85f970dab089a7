"""Operator 8: benchmark decontamination by a prefix-filtered join of exact word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.shared import through_table

#: What stands between words (once A-Z are folded), and the folding of ASCII letters alone.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: Up to so many windows (some hundred bytes each) they are broadcast; beyond, they are joined by shuffle.
BROADCAST_WINDOWS = 100_000


def pieces(text: Column) -> Column:
    """Words of a text in order, not folded, with an empty string before a leading and after a trailing gap."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN, -1)


def fold(text: Column) -> Column:
    """A-Z in lower case, anything else as it is. Text in ASCII alone takes the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def n_words(text: Column) -> Column:
    ws = pieces(text)
    return (F.size(ws) - F.when(ws[0] == "", 1).otherwise(0) - F.when((F.size(ws) > 1) & (F.element_at(ws, -1) == ""), 1).otherwise(0)).cast("bigint")


def item_windows(items: DataFrame, width: int = WINDOW, text: str = "text", key: str = "item_id") -> DataFrame:
    """Distinct windows of the items: (w: array of words, items: array of keys as strings)."""
    words = items.select(F.col(key).cast("string").alias("item"), F.array_remove(F.transform(pieces(F.col(text)), fold), "").alias("ws")).where(F.size("ws") > 0)
    each = words.select("item", F.expr(f"explode(transform(sequence(0, greatest(size(ws) - {width}, 0)), i -> slice(ws, i + 1, {width})))").alias("w"))
    return each.groupBy("w").agg(F.collect_set("item").alias("items"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: (key, n_words, n_hit, n_items, items, contaminated).

    A document word is hit if it stands inside an occurrence of any window (`width` consecutive words of
    an item, or all words of a shorter one). Null has no words; items without words have no windows; an
    item with a null key counts for hits, but is not listed. Repeated rows give repeated rows.

    All words of a window must occur, so one of them is enough to find it: its rarest by the counts of
    the benchmark's words in all documents. Document words are joined to windows by that word alone; the
    offset in the window gives the only possible start, which must lie within the document, and the join
    condition compares all words there, so that only true occurrences leave the join.
    """
    windows = item_windows(items, width).withColumn("id", F.xxhash64("w"))
    small = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    hint = F.broadcast if small else (lambda df: df)
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    # a leading empty piece moves all places of a document by one, which changes no distance between them
    worded = rows.select("k", "h", pieces(F.col("t")).alias("ws"))

    vocabulary = windows.select(F.explode("w").alias("word")).distinct()
    counts = worded.select(F.explode("ws").alias("raw")).select(fold(F.col("raw")).alias("word")).join(hint(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    placed = windows.select("id", F.posexplode("w").alias("at", "word"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("r")
    first = placed.join(counts, "word", "left").groupBy("id").agg(rarest)
    windows = windows.join(first, "id").select("w", "items", F.col("r.word").alias("word"), F.col("r.at").alias("at"), F.size("w").alias("len"), F.array_join("w", " ").alias("said"))

    spots = worded.select("k", "h", "ws", F.posexplode("ws").alias("pos", "raw")).select("k", "h", "ws", "pos", fold(F.col("raw")).alias("word"))
    there = (F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.col("len") <= F.size("ws"))
    same = fold(F.expr("array_join(slice(ws, pos - at + 1, len), ' ')")) == F.col("said")
    found = spots.join(hint(windows), (spots.word == windows.word) & F.when(there, same).otherwise(False))
    hits = (
        found.select("k", "h", F.struct((F.col("pos") - F.col("at")).alias("s"), F.col("len")).alias("span"), "items")
        .groupBy("k", "h")
        .agg(F.array_sort(F.collect_set("span")).alias("spans"), F.collect_set("items").alias("items"))
        .select(
            "k",
            "h",
            F.expr(
                "aggregate(spans, struct(0 as upto, 0L as n), (a, x) -> struct(greatest(a.upto, x.s + x.len) as upto,"
                " a.n + greatest(x.s + x.len - greatest(a.upto, x.s), 0) as n)).n"
            ).alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
        )
    )
    # a plain table of hits, so that the join below can be split or broadcast
    hits = through_table(hits, "contamination-hits")
    sized = rows.select("k", "h", n_words(F.col("t")).alias("n_words"))
    joined = sized.alias("a").join(hits.alias("b"), F.col("a.k").eqNullSafe(F.col("b.k")) & F.col("a.h").eqNullSafe(F.col("b.h")), "left")
    listed = F.coalesce("b.items", F.array().cast("array<string>"))
    n_hit = F.coalesce("b.n_hit", F.lit(0).cast("bigint"))
    return joined.select(
        F.col("a.k").alias(key), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("bigint").alias("n_items"), listed.alias("items"), (n_hit > 0).alias("contaminated")
    )
