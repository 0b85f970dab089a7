"""Operator 3: token counts by prefix, for totals, budgets and truncation."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.bpe import BpeCodec, blocks, codec, forget
from shardloom.llm.shared import map_arrow


class PrefixCounts:
    """Token counts of all prefixes of one text's encoding, stored once.

    `inner[i][j]` tokens cover the first j bytes of pretoken i, from the codec's dynamic programme; `counts[i]`
    tokens cover the first i + 1 pretokens. Totals, prefixes and budgets are read from them.
    """

    def __init__(self, pieces: list[str], inner: list[np.ndarray]):
        self.pieces, self.inner = pieces, inner
        self.counts = np.cumsum([c[-1] for c in inner], dtype=np.int64)
        self.ends = np.cumsum([len(c) - 1 for c in inner], dtype=np.int64)

    @property
    def total(self) -> int:
        return int(self.counts[-1]) if len(self.counts) else 0

    def at(self, byte: int) -> int:
        """Tokens that encode the first `byte` bytes, when the text is cut there and its pretokens stay as they are."""
        i = bisect.bisect_right(self.ends, byte)
        before, begin = (int(self.counts[i - 1]), int(self.ends[i - 1])) if i else (0, 0)
        return before + (int(self.inner[i][byte - begin]) if i < len(self.inner) else 0)

    def cut(self, budget: int) -> int:
        """The largest number of leading bytes, ending between characters, that takes at most `budget` tokens by `at`."""
        i = bisect.bisect_right(self.counts, budget)
        before, begin = (int(self.counts[i - 1]), int(self.ends[i - 1])) if i else (0, 0)
        if i == len(self.inner):
            return begin
        raw = self.pieces[i].encode()
        fits = np.flatnonzero(self.inner[i][: len(raw)] <= budget - before)
        whole = [j for j in fits[::-1].tolist() if j == 0 or raw[j] & 0xC0 != 0x80]
        return begin + whole[0] if whole else begin


def prefix_counts(c: BpeCodec, text: str | None) -> PrefixCounts:
    pieces = c.pretokens(text) if text else []
    return PrefixCounts(pieces, c.prefix_counts_of(pieces))


def count_tokens(docs: DataFrame, vocabulary: str, budgets: tuple[int, ...] = (), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Exact token counts of whole texts: (key, n_bytes, n_tokens, and cut_<b> for each budget b).

    Totals are the last of the stored prefix counts of a text's pretokens. cut_<b> is the largest number of
    leading bytes of UTF-8, ending between characters, that fits b tokens, with pretokens as in the whole text.
    Null and empty texts count 0. Repeated rows give repeated rows, an empty table none; other columns don't
    matter. No shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def make():
        c = codec(vocabulary)

        def f(batch):
            keys, at = batch.column(0), 0
            for block in blocks(batch.column(1).to_pylist()):
                n_bytes = [len(x.encode()) if x else 0 for x in block]
                if budgets:
                    all_counts = [prefix_counts(c, x) for x in block]
                    n, cuts = [p.total for p in all_counts], [[p.cut(b) for p in all_counts] for b in budgets]
                else:
                    n, cuts = c.count(block), []
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, len(block)), *(pa.array(x, pa.int64()) for x in (n_bytes, n, *cuts))],
                    ["k", "n_bytes", "n_tokens", *(f"cut_{b}" for b in budgets)],
                )
                at += len(block)

        return f

    more = "".join(f", cut_{b} bigint" for b in budgets)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_arrow(rows, make, f"k {kind}, n_bytes bigint, n_tokens bigint{more}", forget).withColumnRenamed("k", key)
