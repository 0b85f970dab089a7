"""The engine's front door: tables by name, and the routes for reads, writes, indexes and moves as methods.

Methods that read give lazy DataFrames; only cursors and reports run a job. Tables are kept routed; a
write gives a new state by folding its log and replaces the table in the registry, so that earlier
DataFrames stay what they were.
"""

from __future__ import annotations

import dataclasses
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.scalars import canonical_json, decode_cursor, encode_cursor
from shardloom.operators import movement, mutations, reads
from shardloom.plans import catalog as C
from shardloom.plans import sqlguard
from shardloom.plans.catalog import KEY, SHARD, TENANT, Catalog, TableDef


@dataclasses.dataclass
class Page:
    rows: list
    next_cursor: str | None
    report: dict


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None):
        self.spark, self.catalog = spark, catalog or Catalog()
        self.data: dict[str, DataFrame] = {}
        self.seen: dict[str, tuple[str, dict]] = {}
        self.audit: list[tuple[int, str, str]] = []

    # -- schema ------------------------------------------------------------------------------------

    def register(self, table: TableDef, df: DataFrame, check_key: bool = True) -> None:
        """Adds a table; its key must be unique."""
        if check_key and not C.key_violations(df, table.key).isEmpty():
            raise ValueError(f"{table.name}.{table.key} isn't unique")
        self.catalog.register(table)
        self.data[table.name] = self.catalog.with_routes(df, table)
        self._note("register-table", table.name)

    def create_table(self, sql: str, table: TableDef, schema) -> None:
        """An empty table; the text must be one CREATE TABLE of the same name, without IF NOT EXISTS."""
        if sqlguard.is_dangerous_schema(sql) or sqlguard.create_if_not_exists(sql) == sql or sqlguard.create_table_name(sql) != table.name:
            raise ValueError("not a CREATE TABLE of this table")
        if sqlguard.is_internal(table.name.lower()):
            raise ValueError("the name is reserved")
        self.register(table, self.spark.createDataFrame([], schema), check_key=False)

    def tables(self) -> list[str]:
        return sorted(self.data)

    def table(self, name: str) -> DataFrame:
        return self.data[name]

    # -- reads -------------------------------------------------------------------------------------

    def sql(self, sql: str, table: str, tenant: str, key: str, args: list | None = None) -> DataFrame:
        return reads.shard_sql(self.catalog, self.data[table], sql, table, tenant, key, args)

    def scatter(self, table: str, columns: list[Column], where: Column | None = None, limit: int | None = None, failed: tuple[str, ...] = ()) -> DataFrame:
        return reads.scatter(self.catalog, self.data[table], columns, where, limit, failed)

    def table_scan(self, table: str, tenant: str, limit: int = 100, cursor: str | None = None) -> Page:
        """One page of a tenant's rows. A cursor of another table or of unknown shards is refused."""
        state: dict[str, str] = {}
        if cursor is not None:
            decoded = decode_cursor(cursor)
            if decoded is None or decoded["table"] != table or set(decoded["shardCursors"]) - set(self.catalog.all_shards()):
                raise ValueError("malformed or foreign cursor")
            state = decoded["shardCursors"]
        df = self.data[table]
        rows = [r.asDict() for r in reads.tenant_scan(df, tenant, limit, state).drop(*reads.SYSTEM).collect()]
        after = reads.next_cursors(df, tenant, limit, state).collect()
        state = state | {r.shard_id: r.next_key for r in after if r.next_key is not None}
        more = any(r.more for r in after)
        return Page(rows, encode_cursor(table, state) if more else None, {"shardCount": self.catalog.shards, "scanned": sum(r.scanned for r in after)})

    def index_query(self, index: str, tenant: str, values: dict, limit: int = 20) -> DataFrame:
        table, columns, _ = self.catalog.indexes[index]
        if set(values) != set(columns):
            raise ValueError("an index query needs a value for each column of the index, and no other")
        return reads.index_query(self.data[table], tenant, {c: values[c] for c in columns}, limit)

    def create_index(self, name: str, table: str, columns: tuple[str, ...]) -> DataFrame:
        """Registers an index and gives its entries."""
        self.catalog.create_index(name, table, columns)
        self._note("create-index", name)
        return reads.index_backfill(self.data[table], list(columns), name, list(self.catalog.indexes[name][2]), table)

    # -- writes ------------------------------------------------------------------------------------

    def mutate(self, table: str, tenant: str, mutations_: list[dict], request_id: str) -> dict:
        """Applies one mutation or an atomic batch of up to eight rows: {op, key, where?, values?} each.

        The same request id with the same content gives the first result again; with other content it is a
        conflict. A batch in which an insert meets a live row, or an update or delete touches none, changes nothing.
        """
        digest = hashlib.sha256(canonical_json({"table": table, "tenant": tenant, "mutations": mutations_}).encode()).hexdigest()
        if request_id in self.seen:
            if self.seen[request_id][0] != digest:
                raise ValueError("request id was used for another request")
            return self.seen[request_id][1]
        if not request_id or len({m["key"] for m in mutations_}) > mutations.MAX_TX_ROWS:
            raise ValueError("a batch needs a request id and at most eight rows")
        d, df = self.catalog.tables[table], self.data[table]
        columns = [c for c in df.columns if c not in reads.SYSTEM]
        for m in mutations_:
            if set(m.get("values") or {}) - set(columns) or d.key in (m.get("values") or {}):
                raise ValueError("values name unknown columns or the key")
        keys = sorted({m["key"] for m in mutations_})
        touched = df.where(F.col(KEY).isin(keys) & (F.col(TENANT) == tenant))
        as_map = F.map_from_arrays(F.array(*(F.lit(c) for c in columns)), F.array(*(F.col(c).cast("string") for c in columns)))
        base = touched.select(F.col(KEY).alias("pk"), as_map.alias("row"))
        text = lambda v: None if v is None else str(v)
        rows = [
            (i, m["op"], m["key"], {k: text(v) for k, v in (m.get("where") or {}).items()} or None, {k: text(v) for k, v in (m.get("values") or {}).items()} | {d.key: m["key"]} if m["op"] != "delete" else None)
            for i, m in enumerate(mutations_)
        ]
        log = self.spark.createDataFrame(rows, "seq long, op string, pk string, `where` map<string,string>, values map<string,string>")
        folded = mutations.fold_log(base, log).collect()  # at most eight rows
        applied = sum(r.touched for r in folded)
        result = {"ok": applied == len(mutations_), "rowsAffected": applied if applied == len(mutations_) else 0}
        if result["ok"]:
            kinds = {f.name: f.dataType for f in df.schema.fields}
            live = [tuple((r.row or {}).get(c) for c in columns) + (r.pk,) for r in folded if r.live]
            new = self.spark.createDataFrame(live, ", ".join(f"`{c}` string" for c in columns) + f", {KEY} string")
            new = new.select(*(F.col(c).cast(kinds[c]).alias(c) for c in columns), KEY).withColumn(TENANT, F.lit(tenant))
            bucket = C.vbucket(F.col(TENANT), table, F.col(KEY), self.catalog.buckets)
            new = new.withColumn(C.BUCKET, bucket).withColumn(SHARD, self.catalog.shard_of(F.col(C.BUCKET)))
            rest = df.where(~(F.col(KEY).isin(keys) & (F.col(TENANT) == tenant)))
            self.data[table] = rest.unionByName(new.select(*df.columns))
        self.seen[request_id] = (digest, result)
        self._note("mutate", request_id)
        return result

    # -- topology ----------------------------------------------------------------------------------

    def status(self) -> dict:
        live = self.catalog.active()
        return {"initialized": True, "shards": {"total": self.catalog.shards, "active": len(live), "draining": self.catalog.shards - len(live)}, "tables": self.tables()}

    def shard_stats(self) -> DataFrame:
        frames = [df.groupBy(F.lit(n).alias("table_name"), F.col(SHARD).alias("shard_id")).agg(F.count(F.lit(1)).alias("n_rows")) for n, df in sorted(self.data.items())]
        return C.union_all(frames)

    def migrate(self, table: str, bucket: int, target: str, content: Column) -> bool:
        """Moves one bucket; the move stands only if its checksum is the same before and after."""
        before = self.data[table]
        after = movement.migrate(before, bucket, target)
        sums = [movement.bucket_checksums(df.where(F.col(C.BUCKET) == bucket), [C.BUCKET], KEY, content) for df in (before, after)]
        if not movement.compare_checksums(*sums, C.BUCKET).where("not same").isEmpty():
            return False
        self.data[table] = after
        self._note("migrate-vbucket", f"{table}:{bucket}->{target}")
        return True

    def set_row_owner(self, table: str, key: str, tenant: str, shard: str) -> bool:
        """Whether a tenant may own a key on a shard: the route must lead there."""
        return self.catalog.route(table, tenant, key)[1] == shard

    def audit_log(self, n: int = 100) -> list[tuple[int, str, str]]:
        return self.audit[::-1][:n]

    def _note(self, action: str, what: str) -> None:
        self.audit.append((len(self.audit) + 1, action, what))
