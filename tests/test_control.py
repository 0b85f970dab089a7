"""Transactions and control tables: cases that the fixtures' oracles don't reach."""

import time

import pytest
from pyspark.sql import functions as F

from shardloom.operators import control, transactions


def outcomes(spark, messages):
    rows = [("s", 1, i, *m) for i, m in enumerate(messages)]
    log = spark.createDataFrame(rows, "shard_id string, tx long, seq long, phase string, epoch long, hash string, refused string")
    return [r.outcome for r in transactions.participant_outcomes(log).orderBy("seq").collect()]


@pytest.mark.parametrize(
    "messages, want",
    [
        ([("prepare", 1, "h", None), ("prepare", 1, "h", None), ("commit", 1, "h", None), ("commit", 1, "h", None), ("abort", 1, "h", None)], ["prepared", "prepared", "committed", "already_resolved", "TX_DECISION_CONFLICT"]),
        ([("commit", 1, "h", None), ("abort", 1, "h", None), ("prepare", 1, "h", None)], ["TX_DECISION_UNAVAILABLE", "already_resolved", "TX_DECISION_CONFLICT"]),
        ([("prepare", 2, "h", None), ("commit", 1, "h", None), ("commit", 3, "h", None), ("commit", 2, "x", None), ("abort", 2, "h", None)], ["prepared", "TX_EPOCH_STALE", "TX_EPOCH_CONFLICT", "TX_ENVELOPE_HASH_MISMATCH", "aborted"]),
        ([("prepare", 1, "h", "TX_PARTICIPANT_LOCKED"), ("prepare", 1, "h", None)], ["TX_PARTICIPANT_LOCKED", "prepared"]),
    ],
)
def test_participant_messages(spark, messages, want):
    assert outcomes(spark, messages) == want


def test_steps_see_what_earlier_steps_of_their_transaction_did(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "1")], "k string, v string")
    steps = [
        (1, 0, "a", "update", "1", "2"), (1, 1, "a", "update", "2", "3"),  # the second needs what the first wrote
        (2, 0, "a", "update", "1", "2"), (2, 1, "a", "update", "1", "3"),  # the second is stale
        (3, 0, "b", "delete", "1", None), (3, 1, "b", "insert", None, "9"), (3, 2, "b", "insert", None, "9"),
        (4, 0, "c", "insert", None, "1"), (4, 1, "c", "update", "1", "2"),
    ]
    got = transactions.step_results(base, spark.createDataFrame(steps, "tx long, step long, pk string, op string, expected string, value string"), "k", "v").collect()
    assert {r.tx: (r.committed, r.first_mismatch) for r in got} == {1: (True, None), 2: (False, 1), 3: (False, 2), 4: (True, None)}


def test_every_state_but_new_has_a_next_action(spark):
    from shardloom.operators.mutations import TRANSITIONS

    states = spark.createDataFrame([(s,) for s in TRANSITIONS], "s string")
    assert [r.s for r in states.where(transactions.resume_action(F.col("s")).isNull()).collect()] == ["new"]


def test_retry_delays_double_up_to_the_top(spark):
    jobs = spark.createDataFrame([("s", i, 0, i) for i in range(25)], "shard_id string, job_id long, next_attempt_ms long, attempt_count int")
    left = control.attempt_due(jobs, 1000, F.lit(False), control.MIRROR_RETRY).orderBy("job_id").collect()
    assert [r.next_attempt_ms for r in left] == [1000 + min(60_000, 1000 * 2**i) for i in range(20)] + [0] * 5
    assert [r.attempt_count for r in left] == [i + 1 for i in range(20)] + list(range(20, 25))


def test_lock_outlives_nothing(spark):
    rows = [("c", 1, 0, "acquire", "x"), ("c", 2, 10, "acquire", "y"), ("c", 3, 29_999, "heartbeat", "x"), ("c", 4, 59_000, "holds", "x"), ("c", 5, 60_000, "heartbeat", "x"), ("c", 6, 60_001, "acquire", "y"), ("c", 7, 60_002, "release", "x")]
    got = control.topology_lock(spark.createDataFrame(rows, "c string, seq long, at_ms long, kind string, operation string"), "c").orderBy("seq").collect()
    assert [r.outcome for r in got] == ["acquired", "in_progress", "refreshed", "holds", "lock_lost", "acquired", "not_held"]


def test_a_long_log_of_one_lock_takes_linear_time(spark):
    n = 120_000
    rows = spark.range(n).selectExpr("'c' as c", "id as seq", "id * 1000 as at_ms", "case id % 40 when 0 then 'acquire' when 20 then 'heartbeat' when 39 then 'release' else 'holds' end as kind", "'x' as operation").repartition(5)
    began = time.monotonic()
    got = {r.outcome: r.n for r in control.topology_lock(rows, "c").groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"acquired": n // 40, "refreshed": n // 40, "released": n // 40, "holds": n // 40 * 37}
    assert time.monotonic() - began < 60  # copying the states so far for each request took minutes


def test_locks_of_null_catalogs_and_odd_requests(spark):
    rows = [
        (None, 1, 0, "acquire", "x"), (None, 2, 1, "holds", "x"), (1.0, 1, 0, "release", "x"), (1.0, 2, 5, "acquire", None), (1.0, 3, 6, "acquire", "y"),
        (float("nan"), 1, 0, "acquire", "x"), (float("nan"), 2, 1, None, "x"), (float("nan"), 3, None, "heartbeat", "x"), (float("nan"), 4, None, "release", "x"),
    ]
    got = control.topology_lock(spark.createDataFrame(rows, "c double, seq long, at_ms long, kind string, operation string"), "c").orderBy("c", "seq").collect()
    assert [r.outcome for r in got] == ["acquired", "holds", "not_held", "acquired", "acquired", "acquired", "holds", "lock_lost", "released"]


def test_empty_control_tables(spark):
    schedule = spark.createDataFrame([], "purpose string, fire_at_ms long, generation long")
    assert control.retention_schedule(schedule, spark.createDataFrame([], "retention_deadline_ms long")).count() == 0
    assert control.next_deadline(spark.createDataFrame([], "a long"), ["a"], 5, 7).first()[0] is None
    assert control.next_alarm(schedule).first()[0] is None
