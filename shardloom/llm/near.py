"""Operator 7: near-duplicate classes by order MinHash and banded alignment."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.bytehash import byte_blocks, grams, mix, sequences, words
from shardloom.llm.exact import settings
from shardloom.llm.shared import map_arrow, scratch, through_table

K = 2  # words in a k-mer
PICK = 2  # k-mers in a sketch, in the order of the text
SKETCHES = 24
#: Texts of so many words can only be linked by one edit at most; they also meet by all ways to leave out one word.
LEAST_WORDS, ONE_EDIT = 5, 9
SIMILARITY = 0.8
#: Buckets of up to so many texts are paired in SQL, larger ones in blocks of so many texts.
SMALL, BLOCK = 16, 2048
#: Words in the longest texts of a length class, as a multiple of those in its shortest; over 1 / SIMILARITY, so that a text
#: can only be linked within its class or with the next one.
CLASS = 2.0
#: Up to so many text ids are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bits of a sieve, in words of 64, so that it has about BROADCAST_ROWS rows at most.
SIEVE = 1 << 25
#: Rows of two word lists each in an Arrow batch.
PAIR_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}
#: Of the sketch table, the largest one.
ZSTD = {"spark.sql.parquet.compression.codec": "zstd"}
#: Bits of a text's bitmap of words: two to four times its words, as a power of two between these.
FEWEST, MOST = 128, 8192
NONE = np.uint64(2**64 - 1)
#: Words in a block of a large bucket, where its texts are long, and pairs aligned at a time there.
BLOCK_WORDS, ALIGNED = 1_000_000, 256
#: Pairs of a group whose lengths, classes and bitmaps are compared at a time, in some 50 bytes each.
CELLS = 1 << 18
#: Rows of an alignment after which pairs that can't be near any more are dropped.
LOOK = 16
#: Bins into which the words of a block's texts are hashed: four times a text's words, as a power of two, at most this many.
BINS = 4096


def sketch_block(raw: np.ndarray, off: np.ndarray, sketches: int = SKETCHES):
    """For the texts of a block: word hashes and offsets, and sketch keys [sketch, text] with the number of k-mers used."""
    hashes, w_off = words(raw, off)
    h, g_off = grams(hashes, w_off, K)
    n = np.diff(g_off)
    text = np.repeat(np.arange(len(n)), n)
    # occurrence labels: equal k-mers of a text are told apart by their rank in it
    order = np.lexsort((h, text))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    if same.any():
        place = np.arange(len(h))
        begin = np.maximum.accumulate(np.where(same, 0, place))
        label = np.empty(len(h), np.uint64)
        label[order] = (place - begin).astype(np.uint64)
        h = mix(h + label * np.uint64(0x9E3779B97F4A7C15))
    keys = np.zeros((sketches, len(n)), np.uint64)
    some = np.flatnonzero(n > 0)
    starts = g_off[:-1][some]
    for r in range(sketches):
        if not len(some):
            break
        g = mix(h ^ mix(np.uint64([r + 1])))
        picked = []
        for _ in range(PICK):
            low = np.minimum.reduceat(g, starts)
            at = np.flatnonzero(g == np.repeat(low, n[some]))
            # the first place of each text's minimum
            t, first = np.unique(text[at], return_index=True)
            at = at[first]
            value = np.where(low == NONE, NONE, h[at])
            picked.append((np.where(low == NONE, len(h), at), value))
            g[at] = NONE
        places, values = (np.stack(x) for x in zip(*picked, strict=True))
        key = np.full(len(some), np.uint64(r + 1))
        for value in np.take_along_axis(values, np.argsort(places, axis=0, kind="stable"), axis=0):
            key = mix(key * np.uint64(3) + mix(value))
        keys[r, some] = key
    return hashes, w_off, keys, n


def without_a_word(hashes: np.ndarray, w_off: np.ndarray) -> list[np.ndarray]:
    """For each text of LEAST_WORDS to ONE_EDIT words the hashes of it and of it without each word in turn; nothing for others.

    Two such texts within one edit of each other share at least one of them.
    """
    out = [np.zeros(0, np.int64)] * (len(w_off) - 1)
    sizes = np.diff(w_off)
    for n in range(LEAST_WORDS, ONE_EDIT + 1):
        at = np.flatnonzero(sizes == n)
        if not len(at):
            continue
        ws = hashes[w_off[:-1][at][:, None] + np.arange(n)]
        ways = []
        for skip in range(-1, n):
            h = np.full(len(at), 0x51ED270B9F3A6C15, np.uint64)
            for i in range(n):
                if i != skip:
                    h = mix(h * np.uint64(3) + ws[:, i])
            ways.append(h)
        for t, row in zip(at.tolist(), np.stack(ways, axis=1).view(np.int64), strict=True):
            out[t] = row
    return out


def ranks(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each value how many equal ones of the same group come before it."""
    order = np.lexsort((values, of))
    first = np.ones(len(order), bool)
    first[1:] = (values[order][1:] != values[order][:-1]) | (of[order][1:] != of[order][:-1])
    place = np.arange(len(order))
    out = np.empty(len(order), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return out


def bitmaps(hashes: np.ndarray, w_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of each text's words, told apart by their rank among equal ones: (int64 words, offsets).

    A bit that only one of two texts has stands for a word that the other lacks, so the number of such bits
    bounds the number of edits between them from below.
    """
    size = np.diff(w_off)
    width = np.clip(1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64), FEWEST, MOST)
    begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(width)))
    of = np.repeat(np.arange(len(size)), size)
    h = mix(hashes[: len(of)] * np.uint64(3) + ranks(hashes[: len(of)], of).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bits = np.zeros(int(begin[-1]), bool)
    bits[begin[of] + (h & (width[of] - 1).astype(np.uint64)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.int64), begin // 64


def lacking(a: str, b: str):
    """The greater number of bits that one of two bitmaps (columns) has and the other lacks, after both are folded to the shorter length."""
    fold = "if(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p | q), {x})"
    one = "aggregate(zip_with({f}, {g}, (p, q) -> bit_count(p & ~q)), 0, (s, c) -> s + c)"
    f, g = fold.format(x=a, y=b), fold.format(x=b, y=a)
    return F.greatest(F.expr(one.format(f=f, g=g)), F.expr(one.format(f=g, g=f)))


def sketches(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(k, d1, d2: digest of the word sequence, n: words, keys: sketches, ways: of short texts, bits: bitmap of words, ws: words as int32 bytes)."""
    kind = docs.schema[key].dataType.simpleString()

    def make():
        def f(batch):
            for a, b, raw, off in byte_blocks(batch.column(1)):
                hashes, w_off, keys, n = sketch_block(raw, off)
                d1, d2 = sequences(hashes, w_off, 1), sequences(hashes, w_off, 2)
                small = (hashes >> np.uint64(33)).astype("<i4").tobytes()
                n_words = np.diff(w_off)
                rows = keys.T.astype(np.uint64).view(np.int64)
                has = n_words >= LEAST_WORDS
                ways = without_a_word(hashes, w_off)
                bits, bit_off = bitmaps(hashes, w_off)
                flat = pa.array(np.ascontiguousarray(rows[has]).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(has * rows.shape[1]))), pa.int32()), flat)
                bounds = (w_off * 4).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(d1.view(np.int64)),
                        pa.array(d2.view(np.int64)),
                        pa.array(n_words.astype(np.int64)),
                        lists,
                        pa.array(ways, pa.list_(pa.int64())),
                        pa.ListArray.from_arrays(pa.array(bit_off, pa.int32()), pa.array(bits)),
                        pa.array([small[x:y] for x, y in zip(bounds, bounds[1:], strict=False)], pa.binary()),
                    ],
                    ["k", "d1", "d2", "n", "keys", "ways", "bits", "ws"],
                )

        return f

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_arrow(rows, make, f"k {kind}, d1 bigint, d2 bigint, n bigint, keys array<bigint>, ways array<bigint>, bits array<bigint>, ws binary")


# -- alignment -------------------------------------------------------------------------------------


def common_runs(pairs: list[tuple[np.ndarray, np.ndarray]], q: int) -> np.ndarray:
    """For each pair the number of runs of q words that both texts have, with repeats (or a little more, where hashes collide)."""
    sides = []
    for side in (0, 1):
        sizes = np.array([len(p[side]) for p in pairs])
        flat = np.concatenate([p[side] for p in pairs]).astype(np.uint64)
        of = np.repeat(np.arange(len(pairs)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
        h = mix(of.astype(np.uint64) + np.uint64(1))
        for j in range(q):
            h = mix(h * np.uint64(3) + np.concatenate((flat[j:], np.zeros(min(j, len(flat)), np.uint64))))
        h, of = h[left >= q], of[left >= q]
        order = np.argsort(h, kind="stable")
        h, of = h[order], of[order]
        # equal runs are told apart by their rank
        place = np.arange(len(h))
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        rank = place - np.maximum.accumulate(np.where(first, place, 0))
        sides.append((mix(h + rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), of))
    (x, of), (y, _) = sides
    y = np.sort(y)
    if not len(y):
        return np.zeros(len(pairs), np.int64)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return np.bincount(of[y[at] == x], minlength=len(pairs))


def may_be_near(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray) -> np.ndarray:
    """False where texts have too few runs of words in common for an edit distance of `most`.

    An edit changes at most q of a text's runs of q words, so at least longer length - q + 1 - q * most must be left.
    """
    long = np.array([max(len(a), len(b)) for a, b in pairs], np.int64)
    keep = np.ones(len(pairs), bool)
    for q in (1, 3):
        at = np.flatnonzero(keep & (long - q + 1 - q * most > 0))
        upto = np.cumsum(long[at]) // 400_000
        for part in range(int(upto[-1]) + 1 if len(at) else 0):
            some = at[upto == part]
            if len(some):
                keep[some] = common_runs([pairs[i] for i in some], q) >= long[some] - q + 1 - q * most[some]
    return keep


def band_distance(pairs: list[tuple[np.ndarray, np.ndarray]], band: int, most: np.ndarray | None = None) -> np.ndarray:
    """Edit distance of each pair within a band around the diagonal; exact wherever it is at most `band`, and `most` if given.

    A pair whose cells of a row, with the edits that it takes from there to the last diagonal, are all above both
    bounds is left with a distance far above them.
    """
    na, nb = (np.array([len(p[i]) for p in pairs]) for i in (0, 1))
    top, width = int(na.max()), 2 * band + 1
    a = np.full((len(pairs), top), -1, np.int32)
    b = np.full((len(pairs), max(int(nb.max()), top) + width + 1), -2, np.int32)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)] = x
        b[i, band : band + len(y)] = y
    far = np.int32(1 << 29)
    lane = np.arange(width, dtype=np.int32)
    row = np.where(lane >= band, lane - band, far).astype(np.int32)
    cur = np.repeat(row[None], len(pairs), 0)
    out = np.full(len(pairs), far, np.int32)
    end = nb - na + band
    inside = (end >= 0) & (end < width)
    done = (na == 0) & inside
    out[done] = cur[done, end[done]]
    index, limit = np.arange(len(pairs)), np.minimum(band, most) if most is not None else None
    for i in range(1, top + 1):
        # lane d holds column j = i + d - band; b is shifted by band, so its word j - 1 stands at i + d - 1
        new = cur + (b[:, i - 1 : i - 1 + width] != a[:, i - 1 : i])
        new[:, :-1] = np.minimum(new[:, :-1], cur[:, 1:] + 1)
        if i <= band:
            new[:, : band - i] = far
            new[:, band - i] = i
        cur = (np.minimum.accumulate(new - lane, axis=1) + lane).astype(np.int32)
        done = (na == i) & inside
        if done.any():
            out[index[done]] = cur[done, end[done]]
        if limit is not None and i % LOOK == 0:
            live = (na > i) & inside & ((cur + np.abs(lane - end[:, None])).min(1) <= limit)
            if not live.any():
                break
            if live.sum() < 0.75 * len(live):
                a, b, cur, na, end, inside, index, limit = (v[live] for v in (a, b, cur, na, end, inside, index, limit))
    return out


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], least: float = SIMILARITY) -> np.ndarray:
    """A lower bound, of at least `least`, of the edit similarity of word sequences, 1 - distance / longer length;
    0 where the similarity is less.

    Pairs whose common runs of words alone rule it out go first. The others are aligned in a narrow band. An
    alignment in it that is good enough settles a pair; for the others the band widens fourfold, until it
    covers every distance that would do.
    """
    out = np.zeros(len(pairs))
    long = np.array([max(len(a), len(b), 1) for a, b in pairs])
    most = np.floor((1 - least) * long + 1e-9).astype(int)
    todo = [i for i, (a, b) in enumerate(pairs) if abs(len(a) - len(b)) <= most[i]]
    todo = [todo[i] for i in np.flatnonzero(may_be_near([pairs[i] for i in todo], most[todo]))]
    band = 8
    while todo:
        todo.sort(key=lambda i: long[i])
        rest, at = [], 0
        while at < len(todo):
            size = max(1, min(512, 1_000_000 // int((long[todo[min(at + 511, len(todo) - 1)]] + 2 * band) * 2)))
            part = todo[at : at + size]
            at += size
            bound = most[part]
            d = band_distance([pairs[i] for i in part], min(band, int(bound.max())), bound)
            for i, x in zip(part, d.tolist(), strict=True):
                if x <= most[i]:
                    out[i] = 1 - x / long[i]
                elif band < most[i]:
                    rest.append(i)
        todo, band = rest, band * 4
    return out


def verify(pairs: DataFrame, least: float) -> DataFrame:
    """Of (a, b, wa, wb) the links (a, b, similarity)."""
    kind = pairs.schema["a"].dataType.simpleString()

    def make():
        def f(batch):
            wa, wb = (batch.column(i).to_pylist() for i in (2, 3))
            sim = similar([(np.frombuffer(x, "<i4"), np.frombuffer(y, "<i4")) for x, y in zip(wa, wb, strict=True)], least)
            keep = pa.array(np.flatnonzero(sim > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(sim[sim > 0])], ["a", "b", "similarity"])

        return f

    return map_arrow(pairs, make, f"a {kind}, b {kind}, similarity double")


# -- candidates and classes ------------------------------------------------------------------------


def buckets(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, k, n, c) of buckets with c > 1 texts: of small ones, and of large ones with `central`, the sum of c over the text's buckets."""
    full = through_table(bands.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "near-full")
    met = through_table(sieved(bands, full, "key").join(full, "key"), "near-buckets")
    # a text is in few buckets, so its rows fit one list
    of = met.groupBy("k").agg(F.sum("c").alias("central"), F.collect_list(F.when(F.col("c") > SMALL, F.struct("key", "n", "c"))).alias("b")).where(F.size("b") > 0)
    return met.where(F.col("c") <= SMALL), through_table(of.select("k", F.explode("b").alias("b"), "central").select("k", "b.*", "central"), "near-large")


def ordered_pairs(pairs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Distinct (a, b, n: the longer length), a < b, of rows (x, nx, y, ny) whose lengths allow a link."""
    long = F.greatest("nx", "ny")
    near = long - F.least("nx", "ny") <= F.floor(long * (1 - least) + 1e-9)
    return pairs.where(near & (F.col("x") != F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), long.alias("n")).distinct()


def to_hubs(large: DataFrame, ranks: list) -> DataFrame:
    """Each row of a large bucket with the bucket's first text by each rank, as (x, nx, y, ny)."""
    hub = lambda r: F.max(F.struct(r.alias("r"), F.struct(F.col("k").alias("y"), F.col("n").alias("ny")).alias("h")))["h"]
    hubs = through_table(large.groupBy("key").agg(F.array(*(hub(r) for r in ranks)).alias("hubs")), "near-hubs")
    return large.join(hubs, "key").select(F.col("k").alias("x"), F.col("n").alias("nx"), F.explode("hubs").alias("h")).select("x", "nx", "h.*")


def small_pairs(small: DataFrame) -> DataFrame:
    """All pairs (x, nx, y, ny) of small buckets."""
    m = small.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("m"))
    return m.select(F.explode(F.expr("flatten(transform(m, (v, i) -> transform(slice(m, i + 2, size(m)), w -> struct(v.k as x, v.n as nx, w.k as y, w.n as ny))))")).alias("p")).select("p.*")


def candidates(small: DataFrame, large: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b), a < b, that unite most texts: all those of small buckets and some of large ones.

    In a large bucket each text is paired with a few others: the one that meets the most others over all its
    buckets (the origin of a family of copies does), and the first by two hash orders, which mostly is the
    same one in all buckets of a family. So pairs stay proportional to texts.
    """
    ranks = [F.struct("central", F.xxhash64("k"))] + [F.struct(F.xxhash64("k", F.lit(i))) for i in (1, 2)]
    return ordered_pairs(small_pairs(small).unionByName(to_hubs(large, ranks)), least)


#: Roles of a large bucket's rows in one length class, as places in their list: rows of the class or of the next shorter
#: one, of the bucket's commonest label or of another; and which roles are compared with which.
HOME_MAIN, HOME, LOWER_MAIN, LOWER = range(4)
COMPARED = [(HOME_MAIN, HOME), (HOME_MAIN, LOWER), (HOME, HOME), (HOME, LOWER_MAIN), (HOME, LOWER)]
FIRST, SECOND, BOTH = 0, 1, 2


def open_pairs(group: pa.Table, n: np.ndarray, bits: np.ndarray, off: np.ndarray, forest: bool, least: float):
    """Strips (texts on one side, texts on the other, matrix of pairs that lengths, bitmaps and, with `forest`, classes allow) of a group.

    A strip has about CELLS pairs, so that memory grows with a group's texts and not with their pairs. Two bitmaps are
    folded to the shorter one of the pair: folded to the shortest of the group, those of texts four times as long are nearly full.
    """
    at = group.column("at").to_numpy()
    label = group.column("label").combine_chunks().dictionary_encode().indices.to_numpy() if forest else None
    width = 64 * np.diff(off)
    for w in np.unique(width).tolist():
        # texts of this width with those of it or wider ones that are short enough, then such wider ones with texts of it
        own = width == w
        wider = (width > w) & (n * least <= n[own].max() + 1)
        bools = None
        for left, right in ((own, own | wider), (wider, own)):
            x, y = np.flatnonzero(left & (at != SECOND)), np.flatnonzero(right & (at != FIRST))
            step = max(1, CELLS // max(1, len(y)))
            others = None
            for i in range(0, len(x) if len(y) else 0, step):
                u = x[i : i + step]
                long = np.maximum(n[u][:, None], n[y])
                most = np.floor((1 - least) * long + 1e-9)
                out = long - np.minimum(n[u][:, None], n[y]) <= most
                out &= (u[:, None] < y) | (at[y] != BOTH)
                if forest:
                    out &= label[u][:, None] != label[y]
                if out.any():
                    if bools is None:
                        some = np.flatnonzero(own | wider)
                        place = np.zeros(len(n), np.int64)
                        place[some] = np.arange(len(some))
                        bools = np.stack([np.unpackbits(bits[off[t] : off[t + 1]].view(np.uint8), bitorder="little").reshape(-1, w).any(0) for t in some.tolist()])
                        total = bools.sum(1, dtype=np.float32)
                    if others is None:
                        others = bools[place[y]].T.astype(np.float32)
                    out &= np.maximum(total[place[u]][:, None], total[place[y]]) - bools[place[u]].astype(np.float32) @ others <= most
                yield u, y, out


def block_links(large: DataFrame, table: DataFrame, labels: DataFrame | None = None, least: float = SIMILARITY) -> DataFrame:
    """Links (a, b), a < b, among texts that meet in a large bucket: all of them, or with `labels` (of their classes so far)
    as many as unite the same texts.

    A bucket is split by length class, and a class, with the next shorter one, into blocks of about BLOCK
    texts; every two blocks are compared by one group, so that a hot bucket is spread over tasks. Blocks of
    the bucket's commonest label aren't compared with each other. A class that fits one block with the next
    shorter one is one group, to which each of its rows goes once. All pairs of a group whose lengths and words
    allow a link are aligned, but those that links of the group have put into one class: so no group gives
    more links than it has texts. Keys are dealt out first, then bitmaps for a first look, and words only for texts
    that may be linked to one of their group.
    """
    kind = large.schema["k"].dataType.simpleString()
    rows, main = large.select("key", "k", "n"), F.lit(False)
    if labels is None:
        rows = rows.withColumn("label", F.lit(None).cast(kind))
    else:
        rows = through_table(rows.join(labels, "k", "left").withColumn("label", F.coalesce("label", "k")), "near-blocked")
        sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("key")
        of = through_table(sizes.agg(F.max_by("label", "c").alias("commonest"), F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels"), "near-commonest")
        rows, main = rows.join(of, "key"), F.col("label") == F.col("commonest")
    step = float(np.log(max(CLASS, 1 / least)))
    length, reach = F.floor(F.log("n") / step + 1e-9), F.floor((F.log("n") - float(np.log(least))) / step + 1e-9)
    homes = F.transform(F.sequence(length, F.greatest(length, reach)), lambda g: F.struct(g.alias("g"), (F.when(main, F.lit(0)).otherwise(1) + F.when(g > length, 2).otherwise(0)).alias("role")))
    rows = through_table(rows.select("key", "k", "n", "label", F.explode(homes).alias("h")).select("key", "k", "n", "label", "h.g", "h.role"), "near-roles")
    share = F.greatest(F.lit(1.0 / BLOCK), F.col("n") / float(BLOCK_WORDS))
    total = F.sum(share).alias("total")
    counts = rows.groupBy("key", "g").agg(total, F.array(*(F.ceil(F.coalesce(F.sum(F.when(F.col("role") == r, share)), F.lit(0.0)) - 1e-6) for r in range(4))).alias("blocks"))
    rows = rows.join(through_table(counts.where(F.col("blocks")[HOME_MAIN] + F.col("blocks")[HOME] > 0), "near-counts"), ["key", "g"])
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("k"), F.element_at("blocks", F.col("role") + 1)))

    def partners(a: int, b: int, at: int):
        """The groups in which a row of role `a` (at FIRST) or `b` (at SECOND) meets the other role's blocks."""
        n, mine = F.col("blocks")[b if at == FIRST else a], F.col("mine")
        each = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))

        def group(j):
            x, y = (F.least(mine, j), F.greatest(mine, j)) if a == b else (mine, j) if at == FIRST else (j, mine)
            side = F.when(j == mine, BOTH).when(j > mine, FIRST).otherwise(SECOND) if a == b else F.lit(at)
            return F.struct(F.concat_ws("-", F.lit(f"{a}{b}"), x, y).alias("p"), side.alias("at"))

        return F.transform(each, group)

    def meets(role: int):
        found = [partners(a, b, FIRST) for a, b in COMPARED if a == role] + [partners(a, b, SECOND) for a, b in COMPARED if b == role and a != b]
        return F.concat(*found)

    once = F.array(F.struct(F.lit("all").alias("p"), F.when(F.col("role") <= HOME, BOTH).otherwise(SECOND).alias("at")))
    to = F.when(F.col("total") <= 1 + 1e-6, once).when(F.col("role") == HOME, meets(HOME))
    for r in (HOME_MAIN, LOWER_MAIN, LOWER):
        to = to.when(F.col("role") == r, meets(r))
    rows = rows.select("key", "g", F.explode(to).alias("t"), "k", "label").select("key", "g", "t.p", "t.at", "k", "label")
    # groups with nothing to compare go before the words come
    forest = labels is not None
    several = F.min("label") != F.max("label") if forest else F.lit(True)
    sides = rows.groupBy("key", "g", "p").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count(F.lit(1)).alias("c"), several.alias("several"))
    useful = sides.where("several").where(((F.col("low") == FIRST) & (F.col("high") == SECOND)) | ((F.col("high") == BOTH) & (F.col("c") > 1)))
    useful = through_table(useful.select("key", "g", "p"), "near-groups")
    rows = through_table(rows.join(useful, ["key", "g", "p"]), "near-dealt")

    def look(group: pa.Table) -> pa.Table:
        """The rows of texts that may be linked to one of their group."""
        group = group.combine_chunks()
        bits = group.column("bits").combine_chunks()
        keep = np.zeros(len(group), bool)
        for x, y, may in open_pairs(group, group.column("n").to_numpy(), bits.flatten().to_numpy(), bits.offsets.to_numpy() - bits.offsets[0].as_py(), forest, least):
            keep[x[may.any(1)]] = True
            keep[y[may.any(0)]] = True
        return group.select(["key", "g", "p", "at", "k", "label"]).filter(pa.array(keep))

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        k = group.column("k").combine_chunks()
        ws = [np.frombuffer(w, "<i4") for w in group.column("ws").to_pylist()]
        sizes = np.array([len(w) for w in ws])
        bits, off = bitmaps(np.concatenate(ws).astype(np.uint64), np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes))))
        # a pair is aligned in the bucket of one sketch that it shares, the first from a place that depends on the pair, so that
        # pairs which meet in many buckets are spread over them. All texts of a bucket have its sketch at the same place, but in
        # those of short texts that meet by words left out, which take the pairs that share no sketch
        keys = group.column("keys").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)
        place = np.flatnonzero(keys[0] == group.column("key")[0].as_py())
        mark = np.array([zlib.crc32(w) for w in ws])

        def own_pairs(x: np.ndarray, y: np.ndarray, may: np.ndarray) -> np.ndarray:
            u, v = np.nonzero(may)
            u, v = x[u], y[v]
            here, turn = np.ones(len(u), bool), mark[u] ^ mark[v]
            own = (place[0] - turn) % SKETCHES if len(place) else np.full(len(u), SKETCHES)
            for r in range(SKETCHES):
                here &= (keys[u, r] != keys[v, r]) | ((r - turn) % SKETCHES >= own)
            return np.stack((u[here], v[here]), axis=1)

        root = list(range(len(ws)))
        if forest:
            first: dict[int, int] = {}
            root = [first.setdefault(of, i) for i, of in enumerate(group.column("label").combine_chunks().dictionary_encode().indices.to_pylist())]

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out = []

        def align(some: list[tuple[int, int]]) -> None:
            some = [(i, j) for i, j in some if not forest or find(i) != find(j)]
            found = similar([(ws[i], ws[j]) for i, j in some], least) if some else []
            for (i, j), sim in zip(some, found, strict=True):
                if sim > 0 and (not forest or find(i) != find(j)):
                    root[find(i)] = find(j)
                    out.append((i, j))

        todo = np.zeros((0, 2), np.int64)
        for strip in open_pairs(group, sizes, bits, off, forest, least):
            todo = np.concatenate((todo, own_pairs(*strip)))
            while len(todo) >= ALIGNED:
                align(todo[:ALIGNED].tolist())
                todo = todo[ALIGNED:]
        align(todo.tolist())
        u, v = (pa.array([p[side] for p in out], pa.int64()) for side in (0, 1))
        return pa.table({"x": k.take(u), "y": k.take(v)})

    seen = rows.join(of_texts(table, rows, "n", "bits"), "k").groupBy("key", "g", "p")
    near = through_table(seen.applyInArrow(look, rows.select("key", "g", "p", "at", "k", "label").schema), "near-looked")
    links = near.join(of_texts(table, near, "ws", "keys"), "k").groupBy("key", "g", "p").applyInArrow(compare, f"x {kind}, y {kind}")
    return links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(k, label): for each id in links (a, b) the smallest id connected to it.

    Each round maps every id to its smallest neighbour and that one's, and contracts the links by it; at
    least half of the ids that still have links vanish. Links and labels go to the shared folder.
    """
    ids = links.select(F.col("a").alias("k")).union(links.select("b")).distinct()
    labels = ids.select("k", F.col("k").alias("label"))
    edges = links.select("a", "b")
    while True:
        ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a"))
        low = through_table(ends.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")), "near-low")
        hop = low.alias("x").join(low.alias("y"), F.col("x.to") == F.col("y.u")).select("x.u", F.col("y.to").alias("to"))
        hop = through_table(hop, "near-hop")
        moved = labels.join(hop, labels.label == hop.u, "left").select("k", F.coalesce("to", "label").alias("label"))
        labels = through_table(moved, "near-labels")
        a, b = hop.select(F.col("u").alias("a"), F.col("to").alias("ta")), hop.select(F.col("u").alias("b"), F.col("to").alias("tb"))
        edges = through_table(edges.join(a, "a").join(b, "b").where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), "near-edges")
        if edges.isEmpty():
            return labels


def few(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if they are few."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def sieved(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """All rows whose key is among ids and some others: those that a broadcast bitmap of the ids' hashes lets through."""
    at = f"pmod(xxhash64({key}), {SIEVE}L)"
    bit = F.expr(f"shiftleft(1L, cast({at} % 64 as int))")
    marks = ids.select(F.expr(f"{at} div 64").alias("sieve_at"), bit.alias("sieve_bit")).groupBy("sieve_at").agg(F.bit_or("sieve_bit").alias("sieve_bits"))
    placed = rows.withColumn("sieve_at", F.expr(f"{at} div 64")).join(F.broadcast(through_table(marks, "near-sieve")), "sieve_at")
    return placed.where(F.col("sieve_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def one_each(table: DataFrame, member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketch table with one row for each key; its rows of representatives.

    Repeated rows are looked for by their keys first, so that lists of words aren't shuffled where there are none.
    """
    keys = member.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("k") == F.col("rep")).alias("named"))
    aside = through_table(keys.where("c > 1 or not named"), "near-aside")
    twice = aside.where("c > 1").select("k")
    if not twice.isEmpty():
        several = few(twice)
        if several is twice:
            table = table.dropDuplicates(["k"])
        else:
            table = table.join(several, "k", "left_anti").unionByName(table.join(several, "k", "left_semi").dropDuplicates(["k"]))
    return table, table.join(few(aside.where("not named").select("k")), "k", "left_anti")


def of_texts(table: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """(k and some columns) for each k of `rows`, from the sketch table with one row for each key."""
    ids = through_table(rows.select("k").distinct(), "near-ids")
    some, texts = few(ids), table.select("k", *columns)
    return (sieved(texts, ids, "k") if some is ids else texts).join(some, "k", "left_semi")


def with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with a column of the sketch table for either."""
    ends = pairs.select(F.col("a").alias("k")).union(pairs.select("b"))
    of = of_texts(table, ends, column)
    for side in ("a", "b"):
        pairs = pairs.join(of.select(F.col("k").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs


def check_pairs(pairs: DataFrame, table: DataFrame, least: float) -> DataFrame:
    """The links (a, b) among pairs (a, b, n: the longer length): those that bitmaps don't rule out are aligned."""
    most = F.floor(F.col("n") * (1 - least) + 1e-9)
    sifted = through_table(with_both(pairs, table, "bits").where(lacking("bits_a", "bits_b") <= most).select("a", "b"), "near-sifted")
    both = with_both(sifted, table, "ws").select("a", "b", "ws_a", "ws_b")
    with settings(pairs.sparkSession, PAIR_BATCH):
        return through_table(verify(both, least).select("a", "b"), "near-verified")


def near_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY, count_links: bool = True) -> DataFrame:
    """One row per input row: (key, class_id, n_links, kept).

    Two texts are linked if the edit similarity of their word sequences (ASCII case folded) is at least
    `least`; classes are the connected components of links, named by their smallest key, whose document is
    kept. Texts with equal word sequences are copies: they share a class without being paired, and n_links
    counts the links of their text to different texts that share a sketch with it; without `count_links` it
    is null, and pairs within a class needn't be tried. Either way, all texts of different classes that share
    a sketch have been compared. Texts without words (null and empty ones too) are
    copies of each other. A text of fewer than five words is only linked to copies. Rows with a null key
    come out as classes of their own with a null class_id. Repeated rows give repeated rows.

    Candidates share an order MinHash sketch: of SKETCHES hash orders, each picks the PICK smallest
    occurrence-labelled k-mers of K words and keeps them in text order. Texts that share a share j of their
    k-mers meet with a chance of about 1 - (1 - j^2)^SKETCHES. In a simulation of texts of random words at an
    edit similarity of 0.8, the least that links, 400 of 400 pairs of 150 words met with substitutions at
    random, and 99.25 % with every fifth word changed. Texts of up to ONE_EDIT words that can be linked
    always meet.
    """
    with scratch(docs.sparkSession, "near"):
        return through_table(_classes(docs, text, key, least, count_links), "near-classes", keep=True)


def _classes(docs: DataFrame, text: str, key: str, least: float, count_links: bool) -> DataFrame:
    keyed = docs.where(F.col(key).isNotNull())
    with settings(docs.sparkSession, ZSTD):
        table = through_table(sketches(keyed, text, key), "near-sketches")
    # a table of its own, so that the join below is of plain rows and a hot text can be split over tasks
    copies = through_table(table.groupBy("d1", "d2").agg(F.min("k").alias("rep")), "near-copies")
    member = through_table(table.select("k", "d1", "d2").join(copies, ["d1", "d2"]).select("k", "rep"), "near-members")
    table, reps = one_each(table, member)
    bands = reps.select("k", "n", F.explode(F.array_distinct(F.concat("keys", "ways"))).alias("key"))
    small, large = buckets(bands)
    if count_links:
        pairs = through_table(ordered_pairs(small_pairs(small), least), "near-pairs")
        links = check_pairs(pairs, table, least).unionByName(block_links(large, table, None, least)).distinct()
        links = through_table(links, "near-links")
    else:
        pairs = through_table(candidates(small, large, least), "near-pairs")
        links = check_pairs(pairs, table, least)
        if not large.isEmpty():
            # all that still lie in different classes
            links = links.unionByName(through_table(block_links(large, table, components(links), least), "near-links"))
    degree = links.select(F.col("a").alias("rep")).unionAll(links.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    if links.isEmpty():
        named = member.select("k", F.col("rep").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    else:
        labels = components(links).withColumnRenamed("k", "rep")
        known = labels.join(degree, "rep", "left")
        named = member.join(known, "rep", "left").select("k", F.coalesce("label", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    if not count_links:
        named = named.withColumn("n_links", F.lit(None).cast("bigint"))
    named = named.select(F.col("k").alias(key), "class_id", "n_links", (F.col("k") == F.col("class_id")).alias("kept"))
    alone = docs.where(F.col(key).isNull()).select(key, F.col(key).alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("kept"))
    return named.unionByName(alone)
