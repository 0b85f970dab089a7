"""Operator 6: token ids as directly addressable codes in binary files.

An id is split into chunks of 8 bits. Level 0 has the lowest chunk of every id; a bitmap says which ids
go on, and level 1 has the next chunk of those alone, and so on. A directory of ranks (the set bits
before every 512th bit) turns a place in one level into the place in the next, so any token can be read
without decoding the ones before it.

A block holds whole documents; its bytes are

    "DAC1", uint32 levels, uint64 documents, uint64 ids,
    int64 ids of documents, uint64 ends of documents (in ids from the block's start),
    then for each level: uint64 chunks, the chunks, and unless it is the last:
    the bitmap (8 places a byte, lowest bit first, padded to 64 bytes), uint32 ranks.

Blocks are stored one to a row in Parquet files, which any store that Spark can write to can hold, and
which a lost executor can't leave half written. Rows also have the part and block numbers that order
them and the numbers of documents and ids, so that places are found without touching the payload.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.bpe import _ODD, PATTERN, blocks, codec
from shardloom.llm.shared import bound_batches, map_arrow

MAGIC = b"DAC1"
RANK_BITS = 512
#: A block is closed once it has so many ids.
BLOCK_IDS = 1 << 20


def pack(ids: np.ndarray, keys: np.ndarray, ends: np.ndarray) -> bytes:
    """A block of `ids`; document i has the key keys[i] and the ids before ends[i]."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        levels.append(((rest & 255).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = [MAGIC, struct.pack("<IQQ", len(levels), len(keys), len(ids)), keys.astype("<i8").tobytes(), ends.astype("<u8").tobytes()]
    for i, (chunks, more) in enumerate(levels):
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes()]
        if i < len(levels) - 1:
            bits = np.packbits(np.pad(more, (0, -len(more) % RANK_BITS)), bitorder="little")
            per = np.bitwise_count(bits).reshape(-1, RANK_BITS // 8).sum(1, dtype=np.uint32)
            out += [bits.tobytes(), (np.cumsum(per, dtype=np.uint32) - per).astype("<u4").tobytes()]
    return b"".join(out)


class Block:
    """Reads a block without unpacking it."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        n_levels, self.n_docs, self.n_ids = struct.unpack_from("<IQQ", data, 4)
        at = 24
        self.keys = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.ends = np.frombuffer(data, "<u8", self.n_docs, at).astype(np.int64)
        at += 8 * self.n_docs
        self.levels = []
        for i in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            bits = ranks = None
            if i < n_levels - 1:
                words = -(-n // RANK_BITS)
                bits = np.frombuffer(data, np.uint8, words * (RANK_BITS // 8), at)
                at += len(bits)
                ranks = np.frombuffer(data, "<u4", words, at)
                at += 4 * words
            self.levels.append((chunks, bits, ranks))

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before place i."""
        word, byte = i // RANK_BITS, i // 8
        inside = int(np.bitwise_count(bits[word * (RANK_BITS // 8) : byte]).sum())
        last = int(bits[byte]) & ((1 << (i % 8)) - 1) if i % 8 else 0
        return int(ranks[word]) + inside + last.bit_count()

    def token(self, i: int) -> int:
        """The id at place i of the block."""
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if bits is None or not int(bits[i // 8]) >> (i % 8) & 1:
                return value
            i, shift = self._rank(bits, ranks, i), shift + 8
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """The ids at places a to b."""
        if a >= b:
            return np.zeros(0, np.uint32)
        out, at, shift = np.zeros(b - a, np.uint32), np.arange(b - a), 0
        for chunks, bits, ranks in self.levels:
            out[at] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            if bits is None:
                break
            more = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            if not more.any():
                break
            a = self._rank(bits, ranks, a)
            at, shift = at[more], shift + 8
            b = a + len(at)
        return out

    def document(self, i: int) -> np.ndarray:
        return self.slice(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


#: Bytes from which a run of white space, or of anything else, goes to the codec: the merge loop's pattern needs stack for
#: every blank of a run, and its time grows with the square of a pretoken.
LONG_RUN = 4_000
_ASCII_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"))
#: The bytes of U+0085 and U+00A0 may be white space or part of a letter: they count as both.
_MAY_BE_BLANK = _ASCII_BLANK | np.isin(np.arange(256), [0xC2, 0x85, 0xA0])


def has_long_run(text: str, least: int = LONG_RUN) -> bool:
    """Whether a run of white space, or of other characters, may have `least` bytes or more."""
    if len(text) * 2 < least:
        return False
    raw = np.frombuffer(text.encode(), np.uint8)
    for breaks in (~_MAY_BE_BLANK[raw], _ASCII_BLANK[raw]):
        if int(np.diff(np.flatnonzero(breaks), prepend=-1, append=len(raw)).max()) > least:
            return True
    return False


@functools.lru_cache(maxsize=2)
def fast_encoder(path: str):
    """A function from texts to arrays of ids, the same as those of the tokenizer file.

    Texts of Latin letters go through tiktoken's merge loop on this file's own vocabulary, four times as
    fast as the other libraries; texts with characters on whose class Unicode versions may differ, and texts with
    very long runs, go through the codec.
    """
    import tiktoken

    c = codec(path)
    special = dict(c.t.special)
    ranks = {b: i for i, b in enumerate(c.t.bytes_of) if b and i not in special.values()}
    enc = tiktoken.Encoding("dac", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(texts: list[str | None]) -> list[np.ndarray]:
        return [
            np.zeros(0, np.uint32) if not x else np.frombuffer(c.encode_raw([x])[0], "<u4") if _ODD.search(x) or has_long_run(x) else enc.encode_to_numpy(x, allowed_special="all", disallowed_special=())
            for x in texts
        ]

    return encode


def write_codes(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, block_ids: int = BLOCK_IDS, text: str = "text", key: str = "doc_id") -> None:
    """Writes the ids of all documents, each followed by `end_id`, in ascending order of the integer key.

    Rows are dealt by ranges of key and text hash, so that even one key with many rows is spread; blocks
    of a part follow each other, and so do parts. Null and empty texts have the end id alone; rows with a
    null key come first, with key -2**63; repeated rows are repeated. An empty table writes no blocks.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.expr("-9223372036854775807L - 1")).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    dealt = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h").select("k", "t")

    def run(batches):
        encode, part, number = fast_encoder(vocabulary), TaskContext.get().partitionId(), 0
        ids, keys, sizes, held = [], [], [], 0

        def close():
            size = np.array(sizes, np.int64)
            data = pack(np.concatenate(ids), np.array(keys, np.int64), np.cumsum(size))
            return pa.RecordBatch.from_pydict(
                {"part": [part], "block": [number], "n_docs": [len(keys)], "n_ids": [held], "payload": [data]},
                schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]),
            )

        tail = np.array([end_id], np.uint32)
        for batch in batches:
            at = 0
            for some in blocks(batch.column(1).to_pylist()):
                for k, x in zip(batch.column(0).slice(at, len(some)).to_pylist(), encode(some), strict=True):
                    ids += [x, tail]
                    keys.append(k)
                    sizes.append(len(x) + 1)
                    held += len(x) + 1
                    if held >= block_ids:
                        yield close()
                        number += 1
                        ids, keys, sizes, held = [], [], [], 0
                at += len(some)
        if keys:
            yield close()

    dealt.mapInArrow(run, "part int, block int, n_docs bigint, n_ids bigint, payload binary").write.parquet(path)


def block_starts(blocks_table: DataFrame) -> DataFrame:
    """(part, block, first): ids of all blocks before each. Sums go by part first; only totals of parts meet in one task."""
    sizes = blocks_table.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("p"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("w", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part").select("part", "block", (F.col("p") + F.col("w")).alias("first"))


def read_codes(spark, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: (doc_id, start, n_tokens, ids_crc32, and ids if asked for)."""
    stored = spark.read.parquet(path)

    def make():
        def f(batch):
            for part, number, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                b = Block(data)
                begin = np.concatenate(([0], b.ends[:-1])).astype(np.int64)
                whole = b.slice(0, b.n_ids).astype("<u4")
                crc = [zlib.crc32(whole[x:y].tobytes()) for x, y in zip(begin.tolist(), b.ends.tolist(), strict=True)]
                n = len(crc)
                cols = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array(b.keys), pa.array(begin), pa.array(b.ends - begin), pa.array(crc, pa.int64())]
                names = ["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate((begin, b.ends[-1:])), pa.int32()), pa.array(whole.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

        return f

    schema = "part int, block int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    rows = map_arrow(stored.select("part", "block", "payload"), make, schema)
    null = F.when(F.col("doc_id") != F.expr("-9223372036854775807L - 1"), F.col("doc_id"))
    out = rows.join(block_starts(stored), ["part", "block"])
    return out.select(null.alias("doc_id"), (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
