"""Operator 4: quality scores by logistic regression on hashed word n-grams, trained with FTRL."""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.bytehash import _CODE, FOLD, IS_WORD, _sums, byte_blocks, mix
from shardloom.llm.ftrl import LONGEST, SAMPLE_BYTES, Ftrl, activate, bounded_sample, crc_mod, text_bytes
from shardloom.llm.shared import bound_batches, from_driver, give_back, map_arrow

BITS = 18
SCALE = 4.0
#: Documents to learn from, at most twice as many; a documented bound, as the classifier doesn't get better beyond it.
SAMPLE = 8_000
EPOCHS = 3
THRESHOLD = 0.3
#: Rows from which examples are made at a time, and bytes of text that are cut into features at a time: these take many times as many.
SLICE, FEATURED = 256, 100_000
#: Scoring passes whole texts to Python and back, so that a task holds a batch four times: smaller ones than elsewhere.
SCORED = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}
_SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
#: Kind of a byte in a word's shape: upper case, other letter, digit; punctuation stands for itself.
_KIND = np.array([1 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 2 if IS_WORD[b] else b + 4 for b in range(256)], np.uint64)


def features(raw: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed word n-grams of a block of texts: several arrays with one feature for each token; offsets of tokens.

    Tokens are words and runs of punctuation. There are unigrams and bigrams of tokens (case folded), and
    the same of their shapes (case and kind of the first two and the last byte); a token that repeats
    the one before it has one shape of its own, so that repetition counts whatever the word.
    """
    cls = np.where(_SPACE[raw], 0, np.where(IS_WORD[raw], 1, 2)).astype(np.uint8)
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = cls[1:] != cls[:-1]
    edge[off] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    token = cls[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[token], ends[token]
    t_off = np.searchsorted(starts, off)
    surface = _sums(_CODE[FOLD[raw]], starts, ends)
    first = np.zeros(len(starts), bool)
    first[t_off[:-1][t_off[:-1] < len(starts)]] = True
    before = np.concatenate((np.zeros(1, np.uint64), surface[:-1])) if len(surface) else surface
    before = np.where(first, np.uint64(0), before)
    size = np.minimum(ends - starts, 3).astype(np.uint64)
    shape = _KIND[raw[starts]] + _KIND[raw[np.minimum(starts + 1, ends - 1)]] * np.uint64(512) + _KIND[raw[ends - 1]] * np.uint64(1 << 18) + size * np.uint64(1 << 27)
    # a word's neighbour is the word before it, whatever punctuation stands between
    far = np.concatenate((np.zeros(2, np.uint64), surface[:-2])) if len(surface) > 1 else np.zeros(len(surface), np.uint64)
    second = np.zeros(len(starts), bool)
    second[1:] = first[:-1]
    far = np.where(first | second, np.uint64(0), far)
    shape = np.where((surface == before) | (surface == far), np.uint64(7), shape)
    shape_before = np.where(first, np.uint64(0), np.concatenate((np.zeros(1, np.uint64), shape[:-1])) if len(shape) else shape)
    down = np.uint64(64 - BITS)
    three = np.uint64(3)
    return [
        (x >> down).astype(np.int64)
        for x in (mix(surface + np.uint64(11)), mix(mix(before + np.uint64(12)) * three + surface), mix(shape + np.uint64(13)), mix(mix(shape_before + np.uint64(14)) * three + shape))
    ], t_off


@dataclasses.dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # float32, one for each hash and the bias last

    def score(self, texts: pa.Array) -> np.ndarray:
        """Chance of label 1 for each text: a sparse dot product, with n-gram shares as values."""
        out = np.empty(len(texts))
        for a, b, raw, off in byte_blocks(texts, FEATURED):
            arrays, t_off = features(raw, off)
            dot = np.concatenate((np.zeros(1), np.cumsum(sum(self.weights[f].astype(np.float64) for f in arrays))))
            n = np.diff(t_off)
            logit = (dot[t_off[1:]] - dot[t_off[:-1]]) * SCALE / np.maximum(n, 1) + float(self.weights[-1])
            out[a:b] = activate(logit[:, None])[:, 0]
        return out


def _examples(rows: list[tuple[str | None, int]]):
    """Blocks of examples: (features, how often each occurs, offsets, weight of one occurrence, labels).

    A driver holds all examples of its sample at once, so numbers are as narrow as they can be, and a block of
    text is small, as what features() needs meanwhile is many times its size.
    """
    for a, b, raw, off in byte_blocks(pa.array([t or "" for t, _ in rows], pa.string()), FEATURED):
        arrays, t_off = features(raw, off)
        found = [np.unique(np.concatenate([f[t_off[i] : t_off[i + 1]] for f in arrays]), return_counts=True) for i in range(b - a)]
        counts = np.concatenate([n for _, n in found])
        ends = np.cumsum([0] + [len(at) for at, _ in found]).tolist()
        scale = SCALE / np.maximum(1, np.diff(t_off))
        yield np.concatenate([at.astype(np.int32) for at, _ in found]), counts.astype(np.min_scalar_type(counts.max(initial=0))), ends, scale, np.array([float(y) for _, y in rows[a:b]])


def fit_quality(rows: list[tuple[str | None, int]], epochs: int = EPOCHS) -> QualityModel:
    """Learns from (text, label) pairs in their order; without any, every score is one half."""
    model = Ftrl((1 << BITS) + 1, alpha=1.0, beta=0.2, l1=0.02, l2=0.02)
    blocks = [block for at in range(0, len(rows), SLICE) for block in _examples(rows[at : at + SLICE])]
    for _ in range(epochs):
        for at, n, off, scale, labels in blocks:
            for i, (a, b) in enumerate(zip(off, off[1:], strict=False)):
                x = n[a:b].astype(np.float64) * scale[i]
                model.learn(np.append(at[a:b], np.int32(1 << BITS)), np.append(x, 1.0), labels[i : i + 1])
    return QualityModel(model.weights()[:, 0].astype(np.float32))


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> QualityModel:
    """Fits on labelled documents whose crc32 of the key as text isn't 0 modulo 5: about `sample` of them.

    Texts over ftrl.LONGEST bytes aren't learned from, and of the sample as many texts, in the order of their
    keys' hashes, as ftrl.SAMPLE_BYTES hold. Keys labelled twice have the lower label; without labels every score
    is one half.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull() & (crc_mod(F.col(key), 5) != 0)).groupBy(key).agg(F.min("quality").alias("y"))
    chosen = bounded_sample(known, key, sample)
    spark = docs.sparkSession
    ids = from_driver(spark, [[r[key] for r in chosen], [r["y"] for r in chosen], list(range(len(chosen)))], known.select(key, F.col("y").cast("int"), F.lit(0).alias("place")).schema)
    found = docs.select(key, text).where(text_bytes(text) <= LONGEST).join(F.broadcast(ids), key)
    # bytes of the texts by hundredths of the sample, for the part of it that the driver can hold
    step = max(1, -(-len(chosen) // 100))
    sizes = dict(found.groupBy(F.floor(F.col("place") / step).alias("part")).agg(F.sum(text_bytes(text))).collect())
    total, parts = 0, 0
    for part in range(100):
        total += sizes.get(part, 0)
        if total > SAMPLE_BYTES:
            break
        parts = part + 1
    found = found.where(F.col("place") < parts * step).limit(2 * sample).collect()
    found.sort(key=lambda r: (r["place"], r[text] or ""))
    try:
        return fit_quality([(r[text], r["y"]) for r in found])
    finally:
        del found
        give_back()


def quality_scores(docs: DataFrame, model: QualityModel, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, score, and the columns of `keep`) for every row; null and empty texts get the bias alone.

    Repeated rows give repeated rows, an empty table none; columns may have any names. Very long texts are scored
    whole, in blocks of their own. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def f(batch):
            score = pa.array(m.score(batch.column(1)))
            cols = [batch.column(0), score, *(batch.column(i) for i in range(2, batch.num_columns))]
            yield pa.RecordBatch.from_arrays(cols, ["k", "score", *(f"c{i}" for i in range(len(keep)))])

        return f

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)))
    schema = "k {}, score double".format(rows.schema["k"].dataType.simpleString()) + "".join(f", c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep)))
    bound_batches(docs.sparkSession, SCORED)
    out = map_arrow(rows, make, schema)
    return out.select(F.col("k").alias(key), "score", *(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)))
