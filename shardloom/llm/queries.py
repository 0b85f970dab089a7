"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.counts import count_tokens
from shardloom.llm.dac import read_codes, write_codes
from shardloom.llm.decontaminate import contamination
from shardloom.llm.encode import encode_documents
from shardloom.llm.exact import exact_groups
from shardloom.llm.ftrl import crc_mod
from shardloom.llm.language import languages, train_language
from shardloom.llm.licenses import licence_findings
from shardloom.llm.near import near_classes
from shardloom.llm.quality import THRESHOLD, quality_scores, train_quality
from shardloom.llm.secrets import secret_findings
from shardloom.llm.shared import shared_path, table

LIMIT = 1024  # tokens, of op3's over_limit


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_findings(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(table(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality_scores(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = languages(docs, train_language(docs))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    write_codes(table(spark, sf_dir, "documents"), path, vocabulary())
    return read_codes(spark, path)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), count_links=False).drop("n_links")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from benchmark
), w as (
  select distinct item_id, least(10, len(ws)) as n, array_to_string(ws[i:i + 9], ' ') as win
  from b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as u(i) where len(ws) > 0
), spot as (
  select doc_id, ws, p from d, unnest(range(1, len(ws) + 1)) as u(p)
), place as (
  select doc_id, p, n, array_to_string(ws[p:p + n - 1], ' ') as win from spot, (select distinct n from w) where p + n - 1 <= len(ws)
), hit as (
  select doc_id, p, place.n, item_id from place join w on place.win = w.win and place.n = w.n
), n_hit as (
  select doc_id, count(distinct q) as n_hit from hit, unnest(range(p, p + n)) as u(q) group by doc_id
), its as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hit) group by doc_id
)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n_hit using (doc_id) left join its using (doc_id)
"""


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_findings(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


OP10_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents
), g as (
  select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id, count(*) over (partition by text_sha256) as group_size from d
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""


def llm_queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def llm_oracle_sql() -> dict[str, str]:
    return {"op8_decontaminate": OP8_SQL, "op10_exact_dedup": OP10_SQL}
