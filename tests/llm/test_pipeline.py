"""The corpus pipeline, stage by stage, and the registration of queries."""

import hashlib
import re

import pytest

import corpus_pipeline as P
from shardloom.llm.queries import llm_oracle_sql, llm_queries, vocabulary
from tests.llm.test_text_ops import brute_contamination, brute_exact

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_named_and_ordered():
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "bpe"] and P.ORACLE_SQL is None


def test_run_against_the_stages_by_hand(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    docs = P.table(spark, SF, "documents")
    kept = P.through_table(P.quality(spark, docs, SF), "t")
    rows = sorted(kept.collect(), key=lambda r: r.doc_id)
    assert kept.columns == COLUMNS and 0.5 * docs.count() < len(rows) <= docs.count()
    marks = brute_exact([r.text for r in rows])
    rows = [r for r, m in zip(rows, marks, strict=True) if m[2]]
    exact = P.through_table(P.exact(spark, kept, SF), "t")
    assert exact.columns == COLUMNS and sorted(r.doc_id for r in exact.collect()) == [r.doc_id for r in rows]
    near = P.through_table(P.near(spark, exact, SF), "t")
    rows = sorted(near.collect(), key=lambda r: r.doc_id)
    assert near.columns == COLUMNS and len({" ".join(re.findall(r"\w+", r.text.lower())) for r in rows}) == len(rows)
    items = [(r.item_id, r.text) for r in P.table(spark, SF, "benchmark").collect()]
    clean = [r for r, c in zip(rows, brute_contamination([r.text for r in rows], items), strict=True) if not c[1]]
    assert 0 < len(clean) < len(rows)
    out = {r.doc_id: r for r in P.run(spark, SF).collect()}
    assert sorted(out) == [r.doc_id for r in clean]
    for r in clean:
        ids = tok.encode(r.text, add_special_tokens=False).ids
        assert out[r.doc_id].n_tokens == len(ids) and out[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_exact_stage_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (2, "ab", "en", "s", 2), (2, "other", "en", "s", 5), (None, "n", "en", "s", 1), (None, "n", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), r.text) for r in P.exact(spark, docs, SF).collect())
    assert got == [("1", "a b"), ("2", "other"), ("None", "n")]


def test_exact_stage_leaves_columns_of_clashing_names(spark):
    rows = [(1, "a b", "mine", 7, "k"), (2, "ab", "yours", 8, "l"), (3, "c", None, 9, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _digest string, kept int, k string")
    out = P.exact(spark, docs, SF)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [rows[0], rows[2]]


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_stages_take_empty_and_null_tables(spark, stage):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    assert stage(spark, spark.createDataFrame([], kind), SF).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None, None), (None, "some words here", None, None, None)], kind)
    assert stage(spark, nulls, SF).count() == 2


def test_shuffle_joins_give_the_same(spark, monkeypatch):
    docs = P.table(spark, SF, "documents")
    want = sorted(r.doc_id for r in P.decontaminated(spark, docs, SF).collect())
    monkeypatch.setattr(P, "BROADCAST_ROWS", 0)
    assert sorted(r.doc_id for r in P.decontaminated(spark, docs, SF).collect()) == want


@pytest.mark.parametrize("name", sorted(llm_queries()))
def test_queries_run_and_match_their_sql(spark, name):
    import duckdb

    df = llm_queries()[name](spark, SF)
    rows = sorted((tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect()))
    assert rows
    sql = llm_oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        rel = con.sql(sql)
        order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
        assert [rel.columns[i] for i in order] == sorted(df.columns)
        assert sorted(tuple(str(r[i]) for i in order) for r in rel.fetchall()) == rows


def test_contract_columns(spark):
    want = {
        "op1_bpe_codec": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op3_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
        "op4_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op5_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op6_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
        "op8_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
        "op10_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    }
    q = llm_queries()
    for name, columns in want.items():
        assert dict(q[name](spark, SF).dtypes) == columns, name


def test_native_operators_have_no_python_in_their_plans(spark):
    for name in ("op2_licenses", "op8_decontaminate", "op9_secrets", "op10_exact_dedup"):
        plan = llm_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_entry_registers_them():
    import __spark_entry__ as E

    assert set(llm_queries()) | {"pipeline"} <= set(E.queries()) and set(llm_oracle_sql()) <= set(E.oracle_sql())
