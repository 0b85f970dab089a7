"""Words of many texts at once, as hashes, from the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_B = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLOCK = 400_000  # bytes handled at a time


def mix(x):
    """A bijection on uint64 that spreads all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _fold() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


FOLD = _fold()
#: ASCII letters and digits, and all bytes of other characters.
IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_CODE = mix(np.arange(1, 257, dtype=np.uint64))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse, or more; one pair of tables is kept and grows."""
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        for i, base in enumerate((_B, _BI)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS


def _sums(values, starts, ends):
    """Hash of each run values[start:end], whatever its place."""
    if not len(values):
        return np.zeros(len(starts), np.uint64)
    up, down = _powers(len(values))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def byte_blocks(texts: pa.Array, size: int = BLOCK):
    """(first row, end row, bytes, offsets) of runs of rows with about `size` bytes."""
    raw, off = buffers(texts)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, side="right")) - 1)
        b = min(b, n)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross an offset."""
    before = np.empty(len(member), bool)
    before[:1] = False
    before[1:] = member[:-1]
    inner = off[off < len(member)]
    before[inner] = False
    starts = np.flatnonzero(member & ~before)
    after = np.empty(len(member), bool)
    after[-1:] = False
    after[:-1] = member[1:]
    last = off[off > 0] - 1
    after[last] = False
    return starts, np.flatnonzero(member & ~after) + 1


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, lower case in ASCII; offsets of each text's words)."""
    starts, ends = runs(IS_WORD[raw], off)
    return _sums(_CODE[FOLD[raw]], starts, ends), np.searchsorted(starts, off)


def sequences(hashes: np.ndarray, off: np.ndarray, salt: int) -> np.ndarray:
    """One hash for each text's sequence of hashes."""
    return _sums(mix(hashes ^ np.uint64(salt)), off[:-1], off[1:])


def grams(hashes: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every k consecutive words; offsets). A text of fewer words, but not none, has one gram."""
    n = off[1:] - off[:-1]
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_off = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))
    text = np.repeat(np.arange(len(n)), count)
    first = off[:-1][text] + (np.arange(out_off[-1]) - out_off[:-1][text])
    size = np.minimum(n, k)[text]
    h = np.zeros(len(first), np.uint64)
    for j in range(k):
        at = np.minimum(first + j, max(len(hashes) - 1, 0))
        h = np.where(j < size, mix(h * _B + hashes[at]), h) if len(hashes) else h
    return h, out_off
