"""Control tables: routes with their rules, merged maps, close and enumeration pages, alarms, retry queues, topology locks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.functions.scalars import backoff_ms
from shardloom.operators.reads import keyset_page
from shardloom.plans.catalog import BUCKET, KEY

#: Base and top of the delay before a mirror or index job is tried again, jobs a turn, and the life of a topology lock.
MIRROR_RETRY, INDEX_RETRY, BATCH, LOCK_MS = (1_000, 60_000), (5_000, 60_000), 20, 30_000


def route_with_rules(keys: DataFrame, bucket_map: DataFrame, shards: DataFrame, rules: DataFrame) -> DataFrame:
    """Keys (table_name, bucket, ...) with shard_id, partition_key_column, status and, while a bucket moves, its target.

    `status` is 400 for a table without rules, 500 for a bucket without a shard, 503 for a shard that isn't active
    (its buckets must be assigned anew first), 200 otherwise. All three tables are control data.
    """
    known = bucket_map.join(shards.select("shard_id", F.col("status").alias("_shard")), "shard_id")
    known = known.select(F.col("vbucket").alias(BUCKET), "shard_id", "_shard", "migration_status", "target_shard_id")
    out = keys.join(known, BUCKET, "left").join(rules.select("table_name", "partition_key_column"), "table_name", "left")
    status = F.when(F.col("shard_id").isNull(), 500).when(F.col("partition_key_column").isNull(), 400).when(F.col("_shard") != "active", 503).otherwise(200)
    moving = F.col("migration_status") != "none"
    return out.withColumns({"status": status, "target_shard_id": F.when(moving, F.col("target_shard_id"))}).drop("_shard", "migration_status")


def merged_maps(maps: DataFrame) -> DataFrame:
    """Maps (catalog_id, vbucket, shard_id) of several catalogs side by side: per catalog its buckets and shards, and the sum of all buckets.

    Bucket numbers are a catalog's own, so they are never merged across catalogs.
    """
    per = maps.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("total_vbuckets"), F.countDistinct("shard_id").alias("shards"))
    return per.withColumn("all_vbuckets", F.sum("total_vbuckets").over(Window.partitionBy(F.lit(1))))  # one row a catalog


def refreshed_rows(base: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows with the tenant of their owner row, if there is one; `code` says that one is missing, without which a row isn't indexed."""
    out = base.join(owners.select(KEY, F.col("tenant_id").alias("owner")), KEY, "left")
    return out.withColumn("code", F.when(F.col("owner").isNull(), "PROVENANCE_MISSING"))


def enumeration_page(entries: DataFrame, operations: DataFrame, progress: DataFrame, generation: int, close_key: str, after: tuple[str, int], limit: int) -> DataFrame:
    """The next page of a snapshot's entries by (day, partition), with the receipt of a complete close where there is one."""
    done = operations.where((F.col("close_key") == close_key) & (F.col("status") == "complete")).select(F.col("close_key").alias("ck"), F.col("snapshot_generation").alias("generation"))
    receipts = progress.select(F.col("close_key").alias("ck"), "activation_sequence", "exact_receipt_hash")
    page = keyset_page(entries.where(F.col("generation") == generation), ["reservation_day", "partition"], list(after), limit)
    out = page.join(done, "generation", "left").join(receipts, ["ck", "activation_sequence"], "left")
    return out.select("reservation_day", "partition", "activation_sequence", "entry_hash", "exact_receipt_hash")


def close_progress_page(progress: DataFrame, operations: DataFrame, entries: DataFrame, close_key: str, after: int, limit: int) -> DataFrame:
    """The next page of a close's pending buckets, each with its entry in the snapshot that the close is of."""
    mine = progress.where((F.col("close_key") == close_key) & (F.col("status") == "pending"))
    page = keyset_page(mine, ["activation_sequence"], [after], limit)
    of = operations.select("close_key", F.col("snapshot_generation").alias("generation"))
    out = page.join(of, "close_key").join(entries.select("generation", "activation_sequence", "entry_hash"), ["generation", "activation_sequence"])
    return out.select("activation_sequence", "reservation_day", "partition", "entry_hash")


def missed_restores(coordinators: DataFrame, operations: DataFrame, work: DataFrame) -> DataFrame:
    """(coordinator_id, restore_id): the first complete restore fenced since a coordinator was made, of which it has no work left.

    Restores and their work are few; coordinators aren't, so the smaller side is joined by range to them.
    """
    done = operations.where("stage = 'complete' and fence_installed_ms is not null").select("restore_id", "fence_installed_ms", "completed_ms")
    after = coordinators.join(done, F.col("fence_installed_ms") >= F.col("created_ms"))
    seen = after.join(work.select("restore_id", "coordinator_id", F.col("status").alias("work")), ["restore_id", "coordinator_id"], "left")
    missed = seen.where(F.col("work").isNull() | (F.col("work") == "discarded"))
    return missed.groupBy("coordinator_id").agg(F.min_by("restore_id", F.struct("completed_ms", "restore_id")).alias("restore_id"))


# -- alarms and queues -----------------------------------------------------------------------------


def latest_purposes(schedule: DataFrame) -> DataFrame:
    """(purpose, fire_at_ms, generation) after scheduling rows (seq, purpose, fire_at_ms, generation): an older generation never replaces a newer one."""
    return schedule.groupBy("purpose").agg(F.max_by(F.struct("fire_at_ms", "generation"), F.struct("generation", "seq")).alias("s")).select("purpose", "s.*")


def due_purposes(purposes: DataFrame, now_ms: int, limit: int = 16) -> DataFrame:
    """The purposes that are due, earliest first."""
    return purposes.where(F.col("fire_at_ms") <= now_ms).orderBy("fire_at_ms", "purpose").limit(limit)


def next_alarm(purposes: DataFrame) -> DataFrame:
    return purposes.agg(F.min("fire_at_ms").alias("fire_at_ms"))


def next_deadline(rows: DataFrame, columns: list[str], keep_ms: int, now_ms: int) -> DataFrame:
    """The earliest time at which a row may go: the least of several columns' deadlines, not before now; null without any."""
    least = [F.min(F.col(c) + F.lit(keep_ms)) for c in columns]
    first = F.least(*least) if len(least) > 1 else least[0]
    return rows.agg(first.alias("d")).select(F.when(F.col("d").isNotNull(), F.greatest(F.col("d"), F.lit(now_ms))).alias("next_deadline_ms"))


def retention_schedule(schedule: DataFrame, records: DataFrame) -> DataFrame:
    """The schedule with a retention alarm at the records' first deadline: none without records, and none over one that is there."""
    first = records.agg(F.count(F.lit(1)).alias("n"), F.min("retention_deadline_ms").alias("fire_at_ms")).where("n > 0")
    new = first.select(F.lit("retention").alias("purpose"), "fire_at_ms", F.lit(0).cast("bigint").alias("generation"))
    return schedule.unionByName(new.join(schedule.select("purpose"), "purpose", "left_anti"))


def attempt_due(queue: DataFrame, now_ms: int, delivered: Column, retry: tuple[int, int], batch: int = BATCH) -> DataFrame:
    """The queues (shard_id, job_id, next_attempt_ms, attempt_count) after one turn of each shard.

    Of a shard's due jobs the first `batch` are tried; what is delivered goes, what isn't waits twice as long as
    the time before, from the base up to the top, without end.
    """
    due = F.col("next_attempt_ms") <= now_ms
    turn = F.row_number().over(Window.partitionBy("shard_id", due).orderBy("job_id"))
    tried = queue.withColumn("_tried", due & (turn <= batch)).withColumn("_gone", F.col("_tried") & delivered)
    later = F.lit(now_ms) + backoff_ms(F.col("attempt_count"), *retry)
    left = tried.where("not _gone")
    return left.withColumns(
        {"next_attempt_ms": F.when(F.col("_tried"), later).otherwise(F.col("next_attempt_ms")), "attempt_count": F.col("attempt_count") + F.col("_tried").cast("int")}
    ).drop("_tried", "_gone")


# -- locks and breakers ----------------------------------------------------------------------------


def topology_lock(requests: DataFrame, by: str, life_ms: int = LOCK_MS) -> DataFrame:
    """Requests (by, seq, at_ms, kind, operation) on each catalog's one lock, with their outcome.

    `kind` is acquire, heartbeat, release or holds. A lock that has outlived its last heartbeat counts as free.
    A catalog's requests pass through one task in their order, which sorts them with spilling and keeps no more
    than the lock's state from one to the next; catalogs are spread over tasks.
    """
    turn = F.row_number().over(Window.partitionBy(by).orderBy("seq", "at_ms", "kind", "operation"))
    rows = requests.select(F.col(by).alias("by"), "seq", "at_ms", "kind", "operation", (turn == 1).alias("first"))

    def run(batches):
        holder = until = None
        for batch in batches:
            outcomes = []
            for at, kind, operation, first in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                if first:
                    holder = until = None
                live = holder is not None and until is not None and at is not None and until > at
                mine = holder is not None and holder == operation
                if kind == "acquire":
                    outcome = "in_progress" if live else "acquired"
                elif kind == "heartbeat":
                    outcome = "refreshed" if live and mine else "lock_lost"
                elif kind == "release":
                    outcome = "released" if mine else "not_held"
                else:
                    outcome = "holds" if live and mine else "does_not_hold"
                if outcome == "acquired":
                    holder = operation
                elif outcome == "released":
                    holder = None
                if outcome in ("acquired", "refreshed"):
                    until = None if at is None else at + life_ms
                outcomes.append(outcome)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(outcomes, pa.string())], ["by", "seq", "outcome"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(run, f"by {kinds['by']}, seq {kinds['seq']}, outcome string")
    return out.select(F.col("by").alias(by), "seq", "outcome")

