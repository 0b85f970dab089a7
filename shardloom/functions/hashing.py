"""Routing hashes and digests as Columns.

The routing hash is 32-bit FNV-1a over UTF-16 code units, so that every row finds its bucket from its
own key. For short ASCII keys it is one flat expression inside whole-stage codegen; longer keys fold over
an array, and keys with other characters over their UTF-16 code units.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset basis, prime and mask of 32-bit FNV-1a.
FNV_BASIS, FNV_PRIME, MASK32 = 2166136261, 16777619, 4294967295
FLAT = 32  # characters that the flat form takes


def fnv1a_py(text: str) -> int:
    """The same hash of one string on the driver, for routing literals."""
    h, raw = FNV_BASIS, text.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = ((h ^ (raw[i] << 8 | raw[i + 1])) * FNV_PRIME) & MASK32
    return h


def utf16_units(text: Column) -> Column:
    """The UTF-16 code units of a text that isn't empty."""
    wide = F.encode(text, "UTF-16BE")
    return F.transform(
        F.sequence(F.lit(0), (F.octet_length(wide) / 2).cast("int") - 1),
        lambda i: F.conv(F.substring(F.hex(wide), i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"),
    )


def fnv1a(text: Column) -> Column:
    """Unsigned FNV-1a of a string as bigint; null stays null."""
    flat = F.lit(FNV_BASIS)
    for i in range(1, FLAT + 1):
        # behind the end ascii('') is 0 and the factor 1, which leaves the hash as it is
        factor = F.when(F.char_length(text) >= i, F.lit(FNV_PRIME)).otherwise(F.lit(1)).cast("bigint")
        flat = (flat.bitwiseXOR(F.ascii(F.substring(text, i, 1)).cast("bigint")) * factor).bitwiseAND(F.lit(MASK32))
    step = lambda h, c: ((h.bitwiseXOR(c)) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK32))
    start = F.lit(FNV_BASIS)
    ascii_fold = F.aggregate(F.split(text, ""), start, lambda h, c: step(h, F.ascii(c).cast("bigint")))
    return (
        F.when(text == "", F.lit(FNV_BASIS))
        .when(F.octet_length(text) != F.char_length(text), F.aggregate(utf16_units(text), start, step))
        .when(F.char_length(text) <= FLAT, flat)
        .otherwise(ascii_fold)
    )


def route_text(tenant: Column, table: str | Column, key: Column) -> Column:
    return F.concat_ws(":", tenant, F.lit(table) if isinstance(table, str) else table, key)


def vbucket(tenant: Column, table: str | Column, key: Column, total: int) -> Column:
    return (fnv1a(route_text(tenant, table, key)) % total).cast("int")


def catalog_shard(tenant: Column, n: int = 4) -> Column:
    return F.concat(F.lit("catalog-"), (fnv1a(tenant) % n).cast("string"))


def json_string(text: Column) -> Column:
    """A JSON string literal, or null."""
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'^\{"v":(.*)\}$', 1), F.lit("null"))


def json_scalar(value: Column, kind: str) -> Column:
    """A scalar as JSON text; whole doubles print without a fraction."""
    if kind == "string":
        return F.when(value.isNull(), F.lit("null")).otherwise(json_string(value))
    if kind in ("double", "float"):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        text = F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    elif kind == "boolean":
        text = F.when(value, "true").otherwise("false")
    elif kind.startswith("timestamp"):
        text = json_string(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("null"))


def json_array(values: list[tuple[Column, str]]) -> Column:
    """[a,b,...] without blanks: the identity of an index key; missing values are null."""
    return F.concat(F.lit("["), F.concat_ws(",", *(json_scalar(c, k) for c, k in values)), F.lit("]"))


def json_object(columns: dict[str, tuple[Column, str]]) -> Column:
    """A canonical row: keys in order, no blanks."""
    parts = [F.concat(F.lit(f'"{n}":'), json_scalar(*columns[n])) for n in sorted(columns)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def row_key(tenant: Column, table: str | Column, key: Column) -> Column:
    """Identity of a row that no delimiter inside its parts can confuse."""
    return json_array([(tenant, "string"), (F.lit(table) if isinstance(table, str) else table, "string"), (key, "string")])


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def index_shard(table: str, index: str, key_json: Column, ring: Column) -> Column:
    """The shard of a ring that holds an index key; null for an empty ring."""
    h = fnv1a(F.concat(F.lit(f"{table}:{index}:"), key_json))
    return F.when(F.size(ring) > 0, F.element_at(ring, (h % F.greatest(F.size(ring), F.lit(1)) + 1).cast("int")))


def ring_substitute(index: Column | str, candidates: Column) -> Column:
    """The candidate whose hash with the index name is smallest, ties by name; null if there is none."""
    name = F.lit(index) if isinstance(index, str) else index
    ranked = F.array_min(F.transform(candidates, lambda s: F.struct(fnv1a_fold(F.concat(name, F.lit(":"), s)).alias("h"), s.alias("shard"))))
    return ranked["shard"]


def fnv1a_fold(text: Column) -> Column:
    """FNV-1a as a fold, for use inside lambdas, where the flat form would be repeated for nothing."""
    step = lambda h, c: ((h.bitwiseXOR(c)) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK32))
    narrow = F.aggregate(F.split(text, ""), F.lit(FNV_BASIS), lambda h, c: step(h, F.ascii(c).cast("bigint")))
    wide = F.octet_length(text) != F.char_length(text)
    return F.when(text == "", F.lit(FNV_BASIS)).when(wide, F.aggregate(utf16_units(text), F.lit(FNV_BASIS), step)).otherwise(narrow)


def manifest_bucket(tx: Column, at: Column) -> list[Column]:
    """UTC day, and the last byte of the id's SHA-256 modulo 16."""
    part = (F.conv(F.right(F.sha2(tx, 256), F.lit(2)), 16, 10).cast("int") % 16).cast("int")
    return [F.date_format(at, "yyyy-MM-dd").alias("utc_day"), part.alias("bucket")]


def transaction_id(tenant: Column, request: Column) -> Column:
    return sha256(json_array([(tenant, "string"), (request, "string")]))


def request_hash(sql: Column, params: Column) -> Column:
    """Digest of a statement and its JSON array of parameters."""
    return sha256(F.concat(F.lit('{"params":'), params, F.lit(',"sql":'), json_string(sql), F.lit("}")))
