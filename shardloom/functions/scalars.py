"""Scalar functions of the API as Columns, with plain Python forms where the driver needs them."""

from __future__ import annotations

import base64
import hmac
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def affinity(declared: Column) -> Column:
    """Column affinity of a declared type name; the order of the tests matters."""
    t = F.upper(F.coalesce(declared, F.lit("")))
    has = lambda *words: F.greatest(*(F.instr(t, w) for w in words), F.lit(0)) > 0
    return (
        F.when(has("INT"), "INTEGER")
        .when(has("CHAR", "CLOB", "TEXT"), "TEXT")
        .when((F.trim(t) == "") | has("BLOB"), "BLOB")
        .when(has("REAL", "FLOA", "DOUB"), "REAL")
        .otherwise("NUMERIC")
    )


def affinity_py(declared: str) -> str:
    t = declared.upper()
    for words, name in ((("INT",), "INTEGER"), (("CHAR", "CLOB", "TEXT"), "TEXT"), (("BLOB",), "BLOB"), (("REAL", "FLOA", "DOUB"), "REAL")):
        if any(w in t for w in words) or name == "BLOB" and not t.strip():
            return name
    return "NUMERIC"


def canonical_json(value) -> str:
    """JSON with sorted keys at every level and no blanks; numbers that aren't finite are an error."""

    def check(v):
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError("number isn't finite")
        if isinstance(v, float) and v == int(v) and abs(v) < 1e21:
            return int(v)
        if isinstance(v, dict):
            return {k: check(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [check(x) for x in v]
        if v is None or isinstance(v, (str, int, float, bool)):
            return v
        raise TypeError(f"{type(v).__name__} has no canonical JSON")

    return json.dumps(check(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def quote_identifier(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def quote_identifier_col(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def same_secret(a: str, b: str) -> bool:
    """Compares in constant time."""
    return hmac.compare_digest(a.encode(), b.encode())


def bearer_token(header: str | None) -> str | None:
    kind, _, token = (header or "").partition(" ")
    return token.strip() or None if kind.lower() == "bearer" else None


def padded_key(*parts: tuple[Column, int]) -> Column:
    """Parts as numbers padded with zeros, joined by colons, so that text order is number order."""
    return F.concat_ws(":", *(F.lpad(p.cast("string"), w, "0") for p, w in parts))


def padded_part(key: Column, i: int) -> Column:
    """Part i (from 0) of such a key as a number."""
    return F.element_at(F.split(key, ":"), i + 1).cast("bigint")


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def backoff_ms(attempts: Column, base: int, top: int) -> Column:
    """base * 2^attempts, the exponent at most 30, the result at most top."""
    return F.least(F.lit(float(top)), F.lit(float(base)) * F.pow(F.lit(2.0), clamp(attempts, 0, 30))).cast("bigint")


def sql_max(*cols: Column) -> Column:
    """The two-argument MAX of the host dialect: null if any argument is; unlike greatest()."""
    return F.when(_any_null(cols), None).otherwise(F.greatest(*cols))


def sql_min(*cols: Column) -> Column:
    return F.when(_any_null(cols), None).otherwise(F.least(*cols))


def _any_null(cols) -> Column:
    out = cols[0].isNull()
    for c in cols[1:]:
        out = out | c.isNull()
    return out


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, taken as UTC whatever the session's zone."""
    return F.floor(F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())) / 1000).cast("bigint")


def base64_text(text: Column) -> Column:
    return F.base64(F.encode(text, "UTF-8"))


def encode_cursor(table: str, shard_cursors: dict[str, str]) -> str:
    return base64.b64encode(json.dumps({"table": table, "shardCursors": shard_cursors}, ensure_ascii=False, sort_keys=True).encode()).decode()


def decode_cursor(text: str) -> dict | None:
    """The cursor, or None if it is malformed."""
    try:
        out = json.loads(base64.b64decode(text, validate=True).decode())
    except (ValueError, UnicodeDecodeError):
        return None
    if not isinstance(out, dict) or not isinstance(out.get("table"), str) or not isinstance(out.get("shardCursors"), dict):
        return None
    return out if all(isinstance(k, str) and isinstance(v, str) for k, v in out["shardCursors"].items()) else None
