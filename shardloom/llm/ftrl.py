"""Follow-the-regularised-leader for sparse logistic and multinomial regression, and bounded samples to fit it on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Ftrl:
    """Per-coordinate FTRL-proximal with elastic net: w is 0 where |z| <= l1.

    One column of weights for logistic regression, one for each class for multinomial regression.
    """

    def __init__(self, size: int, classes: int = 1, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """One example: distinct coordinates, their values, and the target (one number, or one for each class)."""
        w = self.weights(at)
        p = activate(x @ w)
        g = x[:, None] * (p - y)[None]
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def activate(logits: np.ndarray) -> np.ndarray:
    """Sigmoid of one column, softmax of several; over the last axis."""
    if logits.shape[-1] == 1:
        return 1 / (1 + np.exp(-np.clip(logits, -50, 50)))
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def crc_mod(key: Column, by: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(by))


#: Bytes of text that a driver collects to fit a model, and the longest text it learns from; documented bounds.
SAMPLE_BYTES, LONGEST = 64 << 20, 1 << 20


def text_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def bounded_sample(df: DataFrame, key: str, bound: int, text: str | None = None, by: str | None = None, least: int = 0) -> list:
    """About `bound` rows of df, never over twice as many: those whose key has a small hash; all, if df has no more.

    With `text`, texts over LONGEST bytes are left out and the bound is lowered until SAMPLE_BYTES are expected
    to hold the sample. With `by`, every value of that column gets its share of the bound, but at least `least`
    rows where it has as many, which adds up to `least` rows for each value; it must have few values (classes).
    Sorted by hash, so that the same rows come in the same order whatever the partitions.
    """
    if text is not None:
        df = df.where(text_bytes(text) <= LONGEST)
    size = text_bytes(text) if text is not None else F.lit(0).cast("bigint")
    groups = df.groupBy(F.col(by) if by else F.lit(0).alias("_all")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).collect()  # a row for each class
    n, held = sum(r["n"] for r in groups), sum(r["b"] for r in groups)
    if not n:
        return []
    bound = max(1, min(bound, SAMPLE_BYTES * n // max(1, held)))
    share = [(r[0], min(1.0, max(bound / n, least / r["n"]))) for r in groups]
    some = df.withColumn("_h", F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 40)))
    if any(s < 1 for _, s in share):
        cut = F.lit(0).cast("bigint")
        for value, s in share:
            cut = F.when(F.col(by).eqNullSafe(F.lit(value)) if by else F.lit(True), int((1 << 40) * s)).otherwise(cut)
        some = some.where(F.col("_h") < cut).limit(2 * (bound + least * len(share)))
    return sorted(some.collect(), key=lambda r: (r["_h"], str(r[key])))
