"""Operator 1: BPE encoding and decoding of whole documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.bpe import codec, forget
from shardloom.llm.shared import map_arrow

SLICE = 256  # documents handled at a time within an Arrow batch


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """Ids and decoded text of every document, in the shape (key, n_tokens, ids, decoded).

    Null and empty texts have no ids and decode to the empty text. Repeated rows give repeated rows, an
    empty table gives none, other columns don't matter. There is no shuffle: each Arrow batch is encoded
    where it is read. With keep_text False the columns `ids` and `decoded` hold SHA-256 digests instead
    (of the decimal ids joined by commas, and of the text in UTF-8), so that the result stays narrow.
    """
    kind = docs.schema[key].dataType.simpleString()

    def make():
        c = codec(vocabulary)
        decimal, pieces = c.decimal, c.t.bytes_of

        def f(batch):
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, SLICE):
                n, ids_out, text_out = [], [], []
                for raw in c.encode_raw(texts.slice(at, SLICE).to_pylist()):
                    ids = np.frombuffer(raw, "<u4").tolist()
                    decoded = b"".join(map(pieces.__getitem__, ids))
                    decoded = decoded.decode("utf-8", "replace") if keep_text else decoded
                    n.append(len(ids))
                    if keep_text:
                        ids_out.append(ids)
                        text_out.append(decoded)
                    else:
                        ids_out.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                        text_out.append(hashlib.sha256(utf8(decoded)).hexdigest())
                ids_type = pa.list_(pa.int32()) if keep_text else pa.string()
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, SLICE), pa.array(n, pa.int64()), pa.array(ids_out, ids_type), pa.array(text_out, pa.string())],
                    ["k", "n_tokens", "ids", "decoded"],
                )

        return f

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    ids_type = "array<int>" if keep_text else "string"
    return map_arrow(rows, make, f"k {kind}, n_tokens bigint, ids {ids_type}, decoded string", forget).withColumnRenamed("k", key)


def utf8(raw: bytes) -> bytes:
    """The bytes as they are if they are UTF-8, else those of the text with U+FFFD for what isn't."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()


def decode_ids(rows: DataFrame, vocabulary: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """The text of each row's ids, special tokens included: (key, decoded). Null ids decode to the empty text."""
    kind = rows.schema[key].dataType.simpleString()

    def make():
        c = codec(vocabulary)

        def f(batch):
            out = [c.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["k", "decoded"])

        return f

    return map_arrow(rows.select(F.col(key).alias("k"), F.col(ids).alias("i")), make, f"k {kind}, decoded string").withColumnRenamed("k", key)
