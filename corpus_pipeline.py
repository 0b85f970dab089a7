"""The corpus pipeline: stages that each apply one operator to what the stage before kept.

All stages but the last return the columns of documents. A stage's result is written as Parquet in the
shared folder and read again as the next one's input.

In every stage an empty table gives an empty one, null texts count as empty, null keys are keys of their own
that match nothing but nulls, texts are taken whole whatever their length, and columns may have any names. A
document is known by its doc_id; rows that share one are told apart where the stage says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.decontaminate import contamination
from shardloom.llm.encode import encode_documents
from shardloom.llm.exact import exact_groups, normalised, sha256_of
from shardloom.llm.near import near_classes
from shardloom.llm.quality import THRESHOLD, quality_scores, train_quality
from shardloom.llm.queries import vocabulary
from shardloom.llm.shared import drop_table, table, through_table

#: Up to so many keys of rejected rows (some 16 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000


def without(docs: DataFrame, rejected: DataFrame, on: list[str]) -> DataFrame:
    """The rows of docs that don't match a row of `rejected` in the columns `on`; nulls match nulls."""
    rejected = through_table(rejected.select(*on).distinct(), "pipeline-rejected")
    if rejected.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rejected = F.broadcast(rejected)
    match = [F.col(f"d.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on]
    return docs.alias("d").join(rejected.alias("r"), match, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least the threshold (operator 4); each row is judged by its own text, repeated ones alike."""
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    others = [c for c in docs.columns if c != "doc_id"]
    return quality_scores(docs, model, keep=tuple(others)).where(F.col("score") >= THRESHOLD).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal without white space, the one that stays (operator 10).

    Of rows that share a doc_id and a text but for white space, one stays; of rows that share a doc_id only, each
    is judged by its own text. Ties go to the smallest doc_id.
    """
    groups = through_table(exact_groups(docs), "pipeline-exact")
    mark = "_digest"
    while mark.lower() in {c.lower() for c in docs.columns}:
        mark = "_" + mark
    keyed = docs.withColumn(mark, sha256_of(normalised(F.col("text"))))
    kept = without(keyed, groups.where("not kept").withColumnRenamed("digest", mark), ["doc_id", mark])
    twice = groups.where("kept").groupBy("doc_id", F.col("digest").alias(mark)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not twice.isEmpty():
        match = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col(f"d.{mark}") == F.col(f"t.{mark}"))
        once = kept.alias("d").join(twice.alias("t"), match, "left_semi").dropDuplicates(["doc_id", mark])
        kept = without(kept, twice, ["doc_id", mark]).unionByName(once)
    return kept.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (operator 7); of rows that share a doc_id, all go if one does."""
    return without(docs, near_classes(docs, count_links=False).where("not kept"), ["doc_id"])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs (operator 8); of rows that share a doc_id, all go if one does."""
    return without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"), ["doc_id"])


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of what is left (operator 1); repeated rows give repeated rows."""
    out = encode_documents(docs, vocabulary())
    return out.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminated), ("bpe", bpe)]
#: A trained score and sampled sketches aren't SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = through_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_table(before)
        before = docs
    return docs
