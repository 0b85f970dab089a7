"""Operator 5: language identification by multinomial regression on TF-IDF of character n-grams."""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.bpe import blocks
from shardloom.llm.bytehash import mix
from shardloom.llm.ftrl import Ftrl, activate, bounded_sample, crc_mod
from shardloom.llm.shared import bound_batches, give_back, map_arrow

BITS = 15
ORDERS = (1, 2, 3)
#: Documents to learn from, and the least of each language that has as many; at most twice their sum, a documented bound.
SAMPLE, LEAST = 4_000, 200
#: N-grams from which on a text's counts are added up in one array of all hashes instead of sorted.
MANY = 1 << 12
EPOCHS = 3
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(texts: list[str | None]):
    """(hashed n-grams of letters, lower case, anything else as a space; offsets) of texts."""
    low = [" " + (t or "").lower() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(t) for t in low])))
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(letters()[c], c, np.uint32(32))
    gap = np.concatenate((c == 32, np.ones(max(ORDERS), bool)))
    out, keep = [], []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        shifted = np.full(len(c), 32, np.uint64)
        shifted[: max(0, len(c) - n + 1)] = c[n - 1 :]
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(n))
        if n in ORDERS:
            # no gram goes across a space: it may only begin or end with one
            inner = [gap[j : j + len(c)] for j in range(1, n - 1)] or [gap[: len(c)] & gap[n - 1 : n - 1 + len(c)]]
            out.append((h >> np.uint64(64 - BITS)).astype(np.int32))
            keep.append(~np.logical_or.reduce(inner))
    is_letter = np.concatenate(([0], np.cumsum(c != 32)))
    return out, keep, off, is_letter[off[1:]] - is_letter[off[:-1]]


def counts(texts: list[str | None]):
    """For each text a sparse vector: (number of letters, hashes of its n-grams in order, count of each)."""
    arrays, keep, off, n_letters = grams(texts)
    for i in range(len(texts)):
        a, b = off[i], off[i + 1]
        own = np.concatenate([g[a:b][k[a:b]] for g, k in zip(arrays, keep, strict=True)]) if b > a else np.zeros(0, np.int32)
        if len(own) < MANY:
            yield int(n_letters[i]), *np.unique(own, return_counts=True)
        else:
            n = np.bincount(own, minlength=1 << BITS)
            at = np.flatnonzero(n)
            yield int(n_letters[i]), at, n[at]


@dataclasses.dataclass(frozen=True)
class LanguageModel:
    names: list[str]
    idf: np.ndarray
    weights: np.ndarray  # [hash, class]
    bias: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A product of a text's TF-IDF vector, of length 1, with the weights."""
        x = np.log1p(n).astype(np.float32) * self.idf[at]
        return (x @ self.weights[at] / max(np.sqrt((x * x).sum()), 1e-9) + self.bias).astype(np.float64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for block in blocks(texts):
            for n_letters, at, n in counts(block):
                if not n_letters or not self.names:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = activate(self.logits(at, n) / self.temperature) if len(self.names) > 1 else np.ones(1)
                best = int(np.argmax(p))
                names.append(self.names[best])
                scores.append(float(p[best]))
        return names, scores


def fit_language(rows: list[tuple[str, str]], epochs: int = EPOCHS, seen: tuple[int, np.ndarray] | None = None) -> LanguageModel:
    """Learns from (text, name) pairs in their order.

    `seen` is the number of documents and, for each hash, of those that have it; counted in the pairs if not given.
    Every tenth pair isn't learned from; on those the temperature is chosen that gives the least log loss.
    """
    rows = [(t, n) for t, n in rows if t]
    names = sorted({n for _, n in rows})
    size = 1 << BITS
    kept, df = [], np.zeros(size)
    for (_, name), (n_letters, at, n) in zip(rows, (c for block in blocks([t for t, _ in rows]) for c in counts(block)), strict=True):
        if n_letters:
            df[at] += 1
            kept.append((at, n, names.index(name)))
    of, df = seen or (len(kept), df)
    idf = (np.log((1 + of) / (1 + df)) + 1).astype(np.float32)
    model = Ftrl(size + 1, max(1, len(names)), alpha=2.0, beta=1.0, l1=0.01, l2=0.002)
    examples = []
    for at, n, y in kept:
        x = np.log1p(n) * idf[at]
        examples.append((np.append(at, size), np.append(x / np.sqrt(x @ x), 0.2), np.eye(len(names))[y]))
    held = examples[::10] if len(examples) >= 50 else []
    for _ in range(epochs if len(names) > 1 else 0):
        for i, e in enumerate(examples):
            if not held or i % 10:
                model.learn(*e)
    w = model.weights()
    temperature = 1.0
    if held and len(names) > 1:
        z = np.array([x @ w[at] for at, x, _ in held])
        y = np.array([np.argmax(t) for _, _, t in held])

        def loss(t):
            return -np.log(np.maximum(activate(z / t)[np.arange(len(y)), y], 1e-12)).mean()

        temperature = float(min(np.geomspace(0.1, 10, 81), key=loss))
    return LanguageModel(names, idf, w[:size].astype(np.float32), 0.2 * w[size], temperature)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """(documents with a letter, for each hash the number of documents that have it), over all rows.

    Counts are added up for each task, so that it sends one row a hash at most; the driver gets 2 ** BITS rows at most.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        df = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0).to_pylist()):
                for n_letters, at, _ in counts(block):
                    if n_letters:
                        df[at] += 1
                        df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["h", "n"])
        del df, at
        give_back()

    rows = docs.select(F.col(text).alias("t")).mapInArrow(run, "h int, n bigint").groupBy("h").agg(F.sum("n").alias("n")).collect()
    df = np.zeros((1 << BITS) + 1, np.int64)
    for r in rows:
        df[r["h"]] = r["n"]
    return int(df[-1]), df[:-1]


def train_language(docs: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id", lang: str = "lang", least: int = LEAST) -> LanguageModel:
    """Fits on documents with a language whose crc32 of the key as text isn't 2 modulo 4.

    Document frequencies are counted over all of them. The weights are learned from about `sample` of them, drawn
    by a hash of the key, of each language its share and at least `least` where it has as many, within
    ftrl.SAMPLE_BYTES of text; repeated rows count as often as they occur. An empty table gives a model without languages.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & (crc_mod(F.col(key), 4) != 2)).select(key, text, lang)
    seen = document_frequencies(known, text)
    return fit_language([(r[text], r[lang]) for r in bounded_sample(known, key, sample, text, lang, least)], seen=seen)


def languages(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) for every row: the likeliest language and its calibrated chance.

    `und` with score 0 for null, empty and letterless texts, and for all where the model has no languages. Of
    languages equally likely, the first by name. Repeated rows give repeated rows, an empty table none; other
    columns don't matter. Very long texts are scored whole, in blocks of their own. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def make():
        m = shared.value

        def f(batch):
            names, scores = m.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["k", "lang_pred", "score"])

        return f

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_arrow(rows, make, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)
