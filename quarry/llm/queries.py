"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import mixing
from quarry.llm.ann import neighbours
from quarry.llm.decontaminate import contaminated
from quarry.llm.lm_scoring import lm_scores
from quarry.llm.pii import pii_spans
from quarry.llm.simhash_dedup import near_duplicates
from quarry.llm.substring_dedup import repeated_spans
from quarry.llm.token_counts import token_counts
from quarry.llm.toxicity import toxic_documents
from quarry.llm.url_filter import filter_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every vector whose id is divisible by 100 among all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.filter("vec_id % 100 = 0"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sampled(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op6_mixing": op6_mixing,
    "op5_token_counts": op5_token_counts,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op4_toxicity": op4_toxicity,
    "op7_decontaminate": op7_decontaminate,
    "op8_pii": op8_pii,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE: dict[str, str] = {
    "op6_mixing": mixing.SQL,
    "op3_nearest_neighbours": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_cosine_similarity(a.e, b.e), 12) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, neighbor_id) AS n FROM p)
        SELECT vec_id, neighbor_id, n::INTEGER AS rank, round(c, 6) AS cosine FROM r WHERE n <= 10
    """,
}
