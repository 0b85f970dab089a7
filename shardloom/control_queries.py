"""Registered queries of transactions and control tables, each next to the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.functions import hashing as H
from shardloom.functions import scalars as S
from shardloom.operators import control as N
from shardloom.operators import transactions as X
from shardloom.plans.catalog import BUCKET, KEY, TENANT
from shardloom.queries import CATALOG, MAP, RC, RE, RO, names, query
from shardloom.sources.tables import load, routed, ts_events

MS = "(epoch_us(ts) // 1000)"


def _events(spark, d):
    return ts_events(spark, d).withColumn("at_ms", S.epoch_ms(F.col("ts")))


# -- two-phase transactions ------------------------------------------------------------------------

PHASE = "case event_type when 'purchase' then 'commit' when 'click' then 'commit' when 'error' then 'abort' else 'prepare' end"
MESSAGES = (
    f"m as (select user_id % 4 as shard_id, event_id % 250 as tx, event_id as seq, {PHASE} as phase, (1 + (event_id % 37 = 0)::int - (event_id % 53 = 0)::int)::bigint as epoch, "
    "case when event_id % 41 = 0 then 'h1' else 'h0' end as hash, case when event_id % 11 = 0 then 'TX_PARTICIPANT_LOCKED' end as refused from events), "
    "r as (select *, row_number() over (partition by shard_id, tx order by seq) as rn from m), "
    "o as (select shard_id, tx, 0::bigint as rn, false as pending, 0::bigint as epoch, '' as hash, null::varchar as decision, null::bigint as seq, null::varchar as phase, '' as outcome from (select distinct shard_id, tx from m) union all "
    "select shard_id, tx, rn, case when outcome in ('committed', 'aborted') then false when first and outcome = 'prepared' then true else pending end, case when taken then mepoch else epoch end, case when taken then mhash else hash end, "
    "case when first and phase = 'abort' then 'abort' when outcome = 'committed' then 'commit' when outcome = 'aborted' then 'abort' else decision end, seq, phase, outcome from ("
    "select *, first and (outcome = 'prepared' or phase = 'abort') as taken from (select z.*, case when first and phase = 'prepare' then coalesce(refused, 'prepared') when first and phase = 'commit' then 'TX_DECISION_UNAVAILABLE' when first then 'already_resolved' "
    "when mepoch < epoch then 'TX_EPOCH_STALE' when mepoch > epoch then 'TX_EPOCH_CONFLICT' when mhash <> hash then 'TX_ENVELOPE_HASH_MISMATCH' when decision is not null and phase <> decision then 'TX_DECISION_CONFLICT' "
    "when decision is not null then 'already_resolved' when phase = 'prepare' then 'prepared' when phase = 'commit' then 'committed' else 'aborted' end as outcome from ("
    "select r.shard_id, r.tx, r.rn, o.pending, o.epoch, o.hash, o.decision, r.seq, r.phase, r.epoch as mepoch, r.hash as mhash, r.refused, not o.pending and o.decision is null as first from o join r on r.shard_id = o.shard_id and r.tx = o.tx and r.rn = o.rn + 1) z)))"
)


def _messages(spark, d):
    e, k = load(spark, d, "events"), F.col("event_id")
    phase = F.when(F.col("event_type").isin("purchase", "click"), "commit").when(F.col("event_type") == "error", "abort").otherwise("prepare")
    return e.select(
        (F.col("user_id") % 4).alias("shard_id"), (k % 250).alias("tx"), k.alias("seq"), phase.alias("phase"), (1 + (k % 37 == 0).cast("int") - (k % 53 == 0).cast("int")).alias("epoch"),
        F.when(k % 41 == 0, "h1").otherwise("h0").alias("hash"), F.when(k % 11 == 0, "TX_PARTICIPANT_LOCKED").alias("refused"),
    )


@query("tx_participants", "with recursive " + MESSAGES + " select shard_id, tx, seq, phase, outcome from o where rn > 0")
def tx_participants(spark, d):
    return X.participant_outcomes(_messages(spark, d))


ACTIONS = "case state " + " ".join(f"when '{a}' then '{b}'" for a, b in X.RESUME.items()) + " end as action"


@query(
    "tx_coordinate",
    "with recursive " + MESSAGES + ", v as (select tx, shard_id, case when bool_or(outcome = 'prepared') then 'prepared' when bool_or(outcome = 'TX_PARTICIPANT_LOCKED') then 'refused' end as vote, bool_or(outcome in ('committed', 'aborted')) as acked from o where rn > 0 group by all), "
    "p as (select tx, count(*) as participants, count(*) filter (vote = 'prepared') as p, count(*) filter (vote = 'refused') as r, count(*) filter (acked) as a from v group by tx), "
    "s as (select tx, participants, case when r > 0 then case when a = participants then 'aborted' when a > 0 then 'aborting' else 'abort_decided' end when p <> participants then 'preparing' when a = participants then 'committed' when a > 0 then 'committed_pending_ack' else 'committing' end as state from p) "
    f"select tx, participants, state, {ACTIONS} from s",
)
def tx_coordinate(spark, d):
    o, outcome = X.participant_outcomes(_messages(spark, d)), F.col("outcome")
    vote = F.when(F.bool_or(outcome == "prepared"), "prepared").when(F.bool_or(outcome == "TX_PARTICIPANT_LOCKED"), "refused")
    return X.coordinate(o.groupBy("tx", "shard_id").agg(vote.alias("vote"), F.bool_or(outcome.isin("committed", "aborted")).alias("acked")))


STEPS = (
    "st as (select o_orderkey // 8 as tx, o_orderkey as step, o_custkey % 7 + 1 as pk, case when o_orderkey % 13 = 0 then 'insert' when o_orderkey % 5 = 0 then 'delete' else 'update' end as op, "
    "case when o_orderkey % 3 = 0 then 'v' || (o_custkey % 3) else c_mktsegment end as expected, 'v' || (o_orderkey % 3) as value from orders left join customer on c_custkey = o_custkey % 7 + 1), "
    "sq as (select *, lag(op) over w as bop, lag(case when op <> 'delete' then value end) over w as bval from st window w as (partition by tx, pk order by step)), "
    "sj as (select tx, step, op, expected, case when bop is not null then bop <> 'delete' else c_custkey is not null end as live, case when bop is not null then bval else c_mktsegment end as actual from sq left join customer on c_custkey = pk), "
    "sb as (select tx, step, case when op = 'insert' then live else not (live and coalesce(actual = expected, false)) end as bad from sj)"
)


@query("tx_sequential_guards", f"with {STEPS} select tx, min(step) filter (bad) as first_mismatch, min(step) filter (bad) is null as committed from sb group by tx")
def tx_sequential_guards(spark, d):
    o, c = load(spark, d, "orders").withColumn("pk", F.col("o_custkey") % 7 + 1), load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("o_orderkey")
    g = o.join(c, o.pk == c.c_custkey, "left").select(
        F.floor(k / 8).alias("tx"), k.alias("step"), "pk", F.when(k % 13 == 0, "insert").when(k % 5 == 0, "delete").otherwise("update").alias("op"),
        F.when(k % 3 == 0, F.concat(F.lit("v"), F.col("o_custkey") % 3)).otherwise(F.col("c_mktsegment")).alias("expected"), F.concat(F.lit("v"), k % 3).alias("value"),
    )
    return X.step_results(c, g, "c_custkey", "c_mktsegment")


@query(
    "write_provenance",
    RC + ", w as (select event_id as seq, (user_id * 3)::varchar as pk, case when event_type = 'error' then 'delete' else 'upsert' end as op, 'u' || (user_id % 16) as tenant_id, (event_id % 1024)::int as vbucket, case when event_id % 9 = 0 then 0 else 1 end as n from events), "
    "l as (select pk, arg_max(op, seq) as op, arg_max(tenant_id, seq) as tenant_id, arg_max(vbucket, seq) as vbucket, max(seq) as updated_at from w where n > 0 group by pk) "
    "select 'customer' as table_name, coalesce(l.pk, c.pk) as pk, case when l.pk is null then c.tenant else l.tenant_id end as tenant_id, case when l.pk is null then c.vbucket else l.vbucket end as vbucket, case when l.pk is null then 0 else l.updated_at end as updated_at from customer_r c full outer join l on c.pk = l.pk where l.pk is null or l.op <> 'delete'",
)
def write_provenance(spark, d):
    owners = names(routed(spark, d, "customer", CATALOG)).select(F.lit("customer").alias("table_name"), "pk", F.col("tenant").alias("tenant_id"), "vbucket", F.lit(0).cast("bigint").alias("updated_at"))
    k = F.col("event_id")
    w = load(spark, d, "events").select(
        k.alias("seq"), F.lit("customer").alias("table_name"), (F.col("user_id") * 3).cast("string").alias("pk"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        F.concat(F.lit("u"), F.col("user_id") % 16).alias("tenant_id"), (k % 1024).cast("int").alias("vbucket"), F.when(k % 9 == 0, 0).otherwise(1).alias("rows_affected"), k.alias("at"),
    )
    return X.provenance(owners, w)


@query(
    "indexed_columns_required",
    "with w as (select event_id, case when event_id % 4 = 0 then 'insert' when event_id % 4 = 1 then 'upsert' else 'update' end as op, event_id % 3 as k from events), m as (select event_id, op, case when op = 'update' then '' when k = 0 then 'b,c' when k = 1 then 'c' else '' end as missing from w) "
    "select event_id, op, missing, case when missing <> '' then 'INDEXED_COLUMN_REQUIRES_VALUE' end as code from m",
)
def indexed_columns_required(spark, d):
    k = F.col("event_id")
    supplied = F.when(k % 3 == 0, F.array(F.lit("a"))).when(k % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("c")))
    w = load(spark, d, "events").select("event_id", F.when(k % 4 == 0, "insert").when(k % 4 == 1, "upsert").otherwise("update").alias("op"), supplied.alias("supplied"))
    return X.missing_indexed(w, ["b", "c"]).select("event_id", "op", F.array_join("missing", ",").alias("missing"), "code")


@query("ring_fences", RO + ", i as (select pk, vbucket, 'idx' || (o_custkey % 5) as index_name from orders_r) select pk, vbucket, index_name, case when vbucket in (5, 77, 900) then 'VBUCKET_FENCED' when index_name in ('idx2', 'idx4') then 'INDEX_RING_FENCED' end as code from i")
def ring_fences(spark, d):
    w = names(routed(spark, d, "orders", CATALOG)).select("pk", "vbucket", F.concat(F.lit("idx"), F.col("o_custkey") % 5).alias("index_name"))
    return X.ring_fenced(w, spark.createDataFrame([(5,), (77,), (900,)], "vbucket int"), spark.createDataFrame([("idx2",), ("idx4",)], "index_name string"))


JOURNAL = (
    RE + f", j as (select shard as shard_id, row_number() over (partition by shard order by event_id) as sequence, 'req-' || pk as request_id, sha256('[\"' || tenant || '\",\"events\",\"' || pk || '\"]:' || event_id) as write_hash, {MS} as applied_at_ms, "
    f"{MS} + {X.JOURNAL_DAYS * 86_400_000} as expires_at_ms from events_r)"
)


def _journal(spark, d):
    e = routed(spark, d, "events", CATALOG).withColumn("at_ms", S.epoch_ms(F.col("ts")))
    return X.loss_journal(e, "event_id", "at_ms", "events")


@query("write_loss_journal", JOURNAL + " select * from j")
def write_loss_journal(spark, d):
    return _journal(spark, d)


@query("journal_coverage", JOURNAL + " select shard_id, max(applied_at_ms) as journaled_through_ms, max(sequence) as journaled_through_sequence from j group by shard_id")
def journal_coverage(spark, d):
    return X.journal_coverage(_journal(spark, d))


@query("strict_row_match", "select o_orderkey from orders where (case when o_orderkey % 2 = 0 then o_orderstatus end) is not distinct from (case when o_orderkey % 3 = 0 then null else 'O' end)")
def strict_row_match(spark, d):
    k = F.col("o_orderkey")
    rows = load(spark, d, "orders").select("o_orderkey", F.when(k % 2 == 0, F.col("o_orderstatus")).alias("s"))
    return rows.where(X.row_matches(["s"], {"s": F.when(k % 3 == 0, F.lit(None)).otherwise("O")})).select("o_orderkey")


@query("mirror_enqueue", RO + "select distinct 'shard-2' as target_shard_id, vbucket, 'mirror:[\"' || tenant || '\",\"t\",\"' || pk || '\"]' as request_id from orders_r where vbucket between 70 and 90")
def mirror_enqueue(spark, d):
    m = CATALOG.bucket_map(spark).withColumn("target_shard_id", F.when(F.col("vbucket").between(70, 90), "shard-2"))
    return X.mirror_jobs(routed(spark, d, "orders", CATALOG), m)


# -- control tables --------------------------------------------------------------------------------

_MOVING = "case when vbucket between 70 and 90 then 'backfilling' else 'none' end"


@query(
    "route_with_rules",
    RO + ", " + MAP + ", k as (select pk, vbucket, case when o_orderkey % 10 = 0 then 'ghost' else 'orders' end as table_name from orders_r) "
    "select pk, vbucket, table_name, case when vbucket < 1000 then shard_id end as shard_id, case when table_name = 'orders' then 'o_orderkey' end as partition_key_column, "
    "case when vbucket >= 1000 then 500 when table_name <> 'orders' then 400 when shard_id = 'shard-3' then 503 else 200 end as status, case when vbucket between 70 and 90 then 'shard-2' end as target_shard_id from k join map using (vbucket)",
)
def route_with_rules(spark, d):
    keys = routed(spark, d, "orders", CATALOG).select(KEY, BUCKET, F.when(F.col("o_orderkey") % 10 == 0, "ghost").otherwise("orders").alias("table_name"))
    moving = F.col("vbucket").between(70, 90)
    m = CATALOG.bucket_map(spark).where("vbucket < 1000").withColumns({"migration_status": F.when(moving, "backfilling").otherwise("none"), "target_shard_id": F.when(moving, "shard-2")})
    shards = CATALOG.shard_table(spark).withColumn("status", F.when(F.col("shard_id") == "shard-3", "draining").otherwise(F.col("status")))
    rules = spark.createDataFrame([("orders", "o_orderkey")], "table_name string, partition_key_column string")
    out = N.route_with_rules(keys, m, shards, rules)
    return out.select(F.col(KEY).alias("pk"), F.col(BUCKET).alias("vbucket"), "table_name", "shard_id", "partition_key_column", "status", "target_shard_id")


@query("merged_maps", "with m as (select 'catalog-' || (o_custkey % 4) as catalog_id, o_orderkey % 700 as vbucket, o_orderkey % 7 as shard_id from orders group by all), p as (select catalog_id, count(*) as total_vbuckets, count(distinct shard_id) as shards from m group by catalog_id) select *, sum(total_vbuckets) over ()::bigint as all_vbuckets from p")
def merged_maps(spark, d):
    k = F.col("o_orderkey")
    m = load(spark, d, "orders").select(F.concat(F.lit("catalog-"), F.col("o_custkey") % 4).alias("catalog_id"), (k % 700).alias("vbucket"), (k % 7).alias("shard_id")).distinct()
    return N.merged_maps(m)


@query("refreshed_rows", RO + "select pk, o_orderstatus, case when o_orderkey % 10 <> 0 then tenant end as owner, case when o_orderkey % 10 = 0 then 'PROVENANCE_MISSING' end as code from orders_r")
def refreshed_rows(spark, d):
    rows = routed(spark, d, "orders", CATALOG)
    owners = rows.where("o_orderkey % 10 <> 0").select(KEY, F.col(TENANT).alias("tenant_id"))
    return N.refreshed_rows(rows.select(KEY, "o_orderstatus"), owners).withColumnRenamed(KEY, "pk")


_DAY = "strftime(ts, '%Y-%m-%d')"
SNAPSHOT = (
    f"en as (select 1 + g as generation, {_DAY} as reservation_day, (user_id % 16)::int as partition, min(event_id) * 2 + g as activation_sequence, sha256({_DAY} || ':' || (user_id % 16)) as entry_hash from events, (values (0), (1)) u(g) group by g, {_DAY}, user_id % 16), "
    "op as (select * from (values ('c1', 1, 'complete'), ('c2', 2, 'pending')) t(close_key, snapshot_generation, status)), "
    "pr as (select 'c' || generation as close_key, activation_sequence, reservation_day, partition, case when partition % 3 = 0 then 'complete' else 'pending' end as status, case when partition % 3 = 0 then sha256('r' || activation_sequence) end as exact_receipt_hash from en)"
)


def _snapshot(spark, d):
    e = ts_events(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("reservation_day"), (F.col("user_id") % 16).cast("int").alias("partition"), "event_id")
    first = e.groupBy("reservation_day", "partition").agg(F.min("event_id").alias("first"))
    both = first.withColumn("g", F.explode(F.array(F.lit(0), F.lit(1))))  # two generations of the snapshot
    entries = both.select((F.col("g") + 1).alias("generation"), "reservation_day", "partition", (F.col("first") * 2 + F.col("g")).alias("activation_sequence"), F.sha2(F.concat_ws(":", "reservation_day", "partition"), 256).alias("entry_hash"))
    ops = spark.createDataFrame([("c1", 1, "complete"), ("c2", 2, "pending")], "close_key string, snapshot_generation int, status string")
    done = F.col("partition") % 3 == 0
    progress = entries.select(
        F.concat(F.lit("c"), "generation").alias("close_key"), "activation_sequence", "reservation_day", "partition", F.when(done, "complete").otherwise("pending").alias("status"),
        F.when(done, F.sha2(F.concat(F.lit("r"), "activation_sequence"), 256)).alias("exact_receipt_hash"),
    )
    return entries, ops, progress


@query("enumeration_page", f"with {SNAPSHOT} select reservation_day, partition, en.activation_sequence, entry_hash, exact_receipt_hash from en left join op on op.close_key = 'c1' and op.snapshot_generation = en.generation and op.status = 'complete' left join (select close_key, activation_sequence, exact_receipt_hash from pr) p on p.close_key = op.close_key and p.activation_sequence = en.activation_sequence where en.generation = 1 and (reservation_day > '2024-01-03' or (reservation_day = '2024-01-03' and partition > 4)) order by reservation_day, partition limit 100")
def enumeration_page(spark, d):
    entries, ops, progress = _snapshot(spark, d)
    return N.enumeration_page(entries, ops, progress, 1, "c1", ("2024-01-03", 4), 100)


@query("close_progress_page", f"with {SNAPSHOT} select pr.activation_sequence, pr.reservation_day, pr.partition, en.entry_hash from pr join op on op.close_key = pr.close_key join en on en.generation = op.snapshot_generation and en.activation_sequence = pr.activation_sequence where pr.close_key = 'c2' and pr.activation_sequence > 500 and pr.status = 'pending' order by pr.activation_sequence limit 64")
def close_progress_page(spark, d):
    entries, ops, progress = _snapshot(spark, d)
    return N.close_progress_page(progress, ops, entries, "c2", 500, 64)


RESTORES = "re as (select * from (values ('r1', 1704500000000, 1704600000000, 'complete'), ('r2', 1705500000000, 1705600000000, 'complete'), ('r3', 1706000000000, null, 'staging')) t(restore_id, fence_installed_ms, completed_ms, stage))"


@query(
    "missed_restores",
    f"with {RESTORES}, co as (select user_id as coordinator_id, min({MS}) as created_ms from events where event_type = 'purchase' group by user_id), wk as (select distinct 'r1' as restore_id, user_id as coordinator_id, case when user_id % 2 = 0 then 'done' else 'discarded' end as status from events where user_id % 3 = 0) "
    "select co.coordinator_id, arg_min(re.restore_id, (completed_ms, re.restore_id)) as restore_id from co join re on fence_installed_ms >= created_ms left join wk on wk.restore_id = re.restore_id and wk.coordinator_id = co.coordinator_id where stage = 'complete' and (wk.coordinator_id is null or wk.status = 'discarded') group by co.coordinator_id",
)
def missed_restores(spark, d):
    ops = spark.createDataFrame([("r1", 1704500000000, 1704600000000, "complete"), ("r2", 1705500000000, 1705600000000, "complete"), ("r3", 1706000000000, None, "staging")], "restore_id string, fence_installed_ms long, completed_ms long, stage string")
    e = _events(spark, d)
    co = e.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("coordinator_id")).agg(F.min("at_ms").alias("created_ms"))
    work = e.where("user_id % 3 = 0").select(F.lit("r1").alias("restore_id"), F.col("user_id").alias("coordinator_id"), F.when(F.col("user_id") % 2 == 0, "done").otherwise("discarded").alias("status")).distinct()
    return N.missed_restores(co, ops, work)


ALARMS = f"al as (select 'p' || (event_id % 60) as purpose, {MS} as fire_at_ms, event_id % 7 as generation, event_id as seq from events), lp as (select purpose, arg_max(fire_at_ms, (generation, seq)) as fire_at_ms, arg_max(generation, (generation, seq)) as generation from al group by purpose)"


def _alarms(spark, d):
    k = F.col("event_id")
    return N.latest_purposes(_events(spark, d).select(F.concat(F.lit("p"), k % 60).alias("purpose"), F.col("at_ms").alias("fire_at_ms"), (k % 7).alias("generation"), k.alias("seq")))


@query("due_purposes", f"with {ALARMS} select * from lp where fire_at_ms <= 1706600000000 order by fire_at_ms, purpose limit 16")
def due_purposes(spark, d):
    return N.due_purposes(_alarms(spark, d), 1_706_600_000_000)


@query("next_alarm", f"with {ALARMS} select min(fire_at_ms) as fire_at_ms from lp")
def next_alarm(spark, d):
    return N.next_alarm(_alarms(spark, d))


@query("next_deadline", f"select greatest(least(min({MS} + 604800000), min(event_id + 604800000)), 1700000000000) as next_deadline_ms from events")
def next_deadline(spark, d):
    return N.next_deadline(_events(spark, d), ["at_ms", "event_id"], 604_800_000, 1_700_000_000_000)


@query("retention_schedule", f"with {ALARMS} select * from lp union all select 'retention', min({MS} + 86400000), 0 from events having count(*) > 0")
def retention_schedule(spark, d):
    return N.retention_schedule(_alarms(spark, d), _events(spark, d).select((F.col("at_ms") + 86_400_000).alias("retention_deadline_ms")))


def queue_sql(base: int, top: int) -> str:
    return (
        f"with q as (select user_id % 8 as shard_id, event_id as job_id, {MS} as next_attempt_ms, (event_id % 9)::int as attempt_count, event_id % 4 <> 0 as ok from events), t as (select *, next_attempt_ms <= 1705276800000 as due, row_number() over (partition by shard_id, next_attempt_ms <= 1705276800000 order by job_id) as turn from q) "
        f"select shard_id, job_id, case when due and turn <= 20 then 1705276800000 + least({top}, {base} * 2 ** attempt_count)::bigint else next_attempt_ms end as next_attempt_ms, attempt_count + (due and turn <= 20)::int as attempt_count from t where not (due and turn <= 20 and ok)"
    )


def _queue(spark, d, retry):
    q = _events(spark, d).select((F.col("user_id") % 8).alias("shard_id"), F.col("event_id").alias("job_id"), F.col("at_ms").alias("next_attempt_ms"), (F.col("event_id") % 9).cast("int").alias("attempt_count"))
    return N.attempt_due(q, 1_705_276_800_000, F.col("job_id") % 4 != 0, retry)


@query("mirror_queue_turn", queue_sql(*N.MIRROR_RETRY))
def mirror_queue_turn(spark, d):
    return _queue(spark, d, N.MIRROR_RETRY)


@query("index_queue_turn", queue_sql(*N.INDEX_RETRY))
def index_queue_turn(spark, d):
    return _queue(spark, d, N.INDEX_RETRY)


LOCK_KIND = "case event_type when 'view' then 'acquire' when 'signup' then 'heartbeat' when 'purchase' then 'release' when 'click' then 'holds' else 'acquire' end"


@query(
    "topology_lock",
    f"with recursive m as (select user_id % 20 as catalog_id, event_id as seq, event_id * 7000 as at_ms, {LOCK_KIND} as kind, 'op' || (event_id % 3) as operation from events), r as (select *, row_number() over (partition by catalog_id order by seq) as rn from m), "
    "o as (select catalog_id, 0::bigint as rn, null::varchar as holder, 0::bigint as until, null::bigint as seq, '' as outcome from (select distinct catalog_id from m) union all "
    "select catalog_id, rn, case when outcome = 'acquired' then operation when outcome = 'released' then null else holder end, case when outcome in ('acquired', 'refreshed') then at_ms + 30000 else until end, seq, outcome from (select *, case kind when 'acquire' then case when live then 'in_progress' else 'acquired' end "
    "when 'heartbeat' then case when live and mine then 'refreshed' else 'lock_lost' end when 'release' then case when mine then 'released' else 'not_held' end else case when live and mine then 'holds' else 'does_not_hold' end end as outcome from ("
    "select r.*, o.holder, o.until, o.holder is not null and o.until > r.at_ms as live, coalesce(o.holder = r.operation, false) as mine from o join r on r.catalog_id = o.catalog_id and r.rn = o.rn + 1))) select catalog_id, seq, outcome from o where rn > 0",
)
def topology_lock(spark, d):
    kind = F.when(F.col("event_type") == "signup", "heartbeat").when(F.col("event_type") == "purchase", "release").when(F.col("event_type") == "click", "holds").otherwise("acquire")
    m = load(spark, d, "events").select((F.col("user_id") % 20).alias("catalog_id"), F.col("event_id").alias("seq"), (F.col("event_id") * 7000).alias("at_ms"), kind.alias("kind"), F.concat(F.lit("op"), F.col("event_id") % 3).alias("operation"))
    return N.topology_lock(m, "catalog_id")


@query("shard_group_having", RO + "select o_orderstatus, shard, count(*) as n, grouping(shard)::int as whole from orders_r where shard in ('shard-1', 'shard-2') group by grouping sets ((o_orderstatus, shard), (o_orderstatus)) having count(*) > 20")
def shard_group_having(spark, d):
    rows = names(routed(spark, d, "orders", CATALOG)).where(F.col("shard").isin("shard-1", "shard-2"))
    rows.select("o_orderstatus", "shard").createOrReplaceTempView("shard_orders")
    return spark.sql("select o_orderstatus, shard, count(*) as n, cast(grouping(shard) as int) as whole from shard_orders group by grouping sets ((o_orderstatus, shard), (o_orderstatus)) having count(*) > 20")


@query("index_entries_page", RC + """, e as (select '["' || c_mktsegment || '"]' as index_key_json, pk, tenant as tenant_id from customer_r) select index_key_json, pk, tenant_id from e where (index_key_json, pk) > ('["BUILDING"]', '5') order by index_key_json, pk limit 500""")
def index_entries_page(spark, d):
    from shardloom.operators import reads as R

    rows = routed(spark, d, "customer", CATALOG)
    entries = R.index_backfill(rows, ["c_mktsegment"], "by_segment", CATALOG.all_shards(), "customer").select("index_key_json", "pk", "tenant_id")
    return R.keyset_page(entries, ["index_key_json", "pk"], ['["BUILDING"]', "5"], 500)


@query("wide_key_hash", "select n_nationkey, " + "list_reduce(list_transform(range(1, length(n_name) + 1), lambda i: ascii(n_name[i])::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) as h from nation")
def wide_key_hash(spark, d):
    return load(spark, d, "nation").select("n_nationkey", H.fnv1a_fold(F.col("n_name")).alias("h"))

