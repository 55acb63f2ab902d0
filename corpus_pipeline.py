"""A training corpus from the table documents: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.decontaminate import contaminated
from quarry.llm.mixing import mixed
from quarry.llm.pii import redacted
from quarry.llm.shared import written
from quarry.llm.simhash_dedup import near_duplicates
from quarry.llm.toxicity import THRESHOLD, scored, train

#: Ids to drop are broadcast up to this many; beyond it the join shuffles.
MOST_BROADCAST = 2_000_000


def _small(ids: DataFrame) -> DataFrame:
    ids = written(ids)
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic documents: those whose probability reaches the threshold, ties included. Null and empty texts stay. Rows without a doc_id and
    repeated rows are judged by their own texts, of whatever length. A column of the documents' own called toxicity stays as it is. No documents, none out."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = docs.withColumnsRenamed({"toxicity": "__toxicity"})
    return scored(own, model).filter(F.col("toxicity") < THRESHOLD).drop("toxicity").withColumnsRenamed({"__toxicity": "toxicity"}).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the least doc_id, and one row of it: of repeated rows the one whose text has the
    least hash, then the least text, then the least JSON of the row. What is in no group stays with all its rows: null, empty and
    wordless texts, and rows without a doc_id. Extra columns stay, whatever they are called."""
    members = written(near_duplicates(docs))
    again = docs.join(_small(members.filter("kept").select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = written(again)
    gone = members.filter("not kept").select("doc_id")
    rest = docs.join(_small(gone.union(again)), "doc_id", "left_anti")
    if again.limit(1).count():
        rows = docs.join(_small(again), "doc_id", "left_semi").select(*docs.columns)
        all_ = F.struct(*docs.columns)
        first = rows.groupBy("doc_id").agg(F.min_by(all_, F.struct(F.xxhash64("text"), F.col("text"), F.to_json(all_))).alias("__row"))
        rest = rest.select(*docs.columns).unionByName(first.select("__row.*"))
    return rest.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark, all rows of a doc_id together. Null and empty texts stay, as do rows without a doc_id,
    which no match can name. An empty benchmark drops nothing. Extra columns stay, whatever they are called."""
    hits = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(_small(hits.select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by their type; n_chars follows. All rows stay: null texts are null still (with their n_chars), empty ones empty,
    repeated ones and those without a doc_id are dealt with like any other. Extra columns stay, whatever they are called."""
    clean = redacted(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return clean.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents to the target weights of sources, languages and topics, and adds topic, n_tokens, weight and probability (in place of columns
    of these names; topic is taken from one that is there). Null sources, languages and topics count as `unknown`; a null or empty text has one
    token; rows without a doc_id are drawn by their text; repeated rows are kept or left together. No documents, none out."""
    return mixed(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates_stage), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]

#: SQL can't express the classifiers, the fingerprints or the alignment.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
