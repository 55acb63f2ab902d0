"""Exact nearest neighbours and keyword search."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import documents, vectors
from quarry.functions.text import field_weights, tokens
from quarry.operators.collections import predicate
from quarry.storage import written

K1, B = 1.2, 0.75


def metadata_filter(df: DataFrame, where: Mapping[str, object] | None, where_not: Mapping[str, object] | None, metadata: str | None, any_not: bool = False) -> DataFrame:
    """Conditions on columns, or on the VARIANT column `metadata`. where_not drops what matches all of its conditions (any of them, if any_not)."""

    def all_of(conditions: Mapping[str, object]) -> Column:
        return documents.matches(F.col(metadata), dict(conditions)) if metadata else predicate(df, conditions)

    if where is not None:
        df = df.filter(all_of(where))
    if where_not is not None:
        dropped = all_of(where_not)
        if any_not:
            dropped = F.lit(False)
            for key, value in where_not.items():
                dropped = dropped | all_of({key: value})
        df = df.filter(~F.coalesce(dropped, F.lit(False)))
    return df


def knn(
    df: DataFrame, query: Sequence[float], k: int = 10, min_score: float | None = None, where: Mapping[str, object] | None = None, where_not: Mapping[str, object] | None = None,
    id_: str = "id", vector: str = "vector", metadata: str | None = None, any_not: bool = False,
) -> DataFrame:
    """The k nearest by cosine among the rows that pass the filters, score rounded to 6 digits: id, score, and the other columns but the vector.

    The filters run before the ranking. Vectors without a direction are left out; a query without one scores 0 everywhere.
    """
    if k < 0:
        raise ValueError("k must be 0 or more")
    rows = metadata_filter(df, where, where_not, metadata, any_not).filter(vectors.usable(F.col(vector)))
    norm = sum(float(x) * float(x) for x in query) ** 0.5
    # the query's own length is known: one pass over each vector gives both sums
    both = F.aggregate(
        F.zip_with(F.col(vector), vectors.as_vector(query), lambda a, b: F.struct(a.cast("double").alias("a"), b.alias("b"))),
        F.struct(F.lit(0.0).alias("ab"), F.lit(0.0).alias("aa")),
        lambda s, x: F.struct((s["ab"] + x["a"] * x["b"]).alias("ab"), (s["aa"] + x["a"] * x["a"]).alias("aa")),
    )
    scored = rows.withColumn("__s", both).withColumn("score", F.when((F.size(vector) != len(query)) | (F.lit(norm) == 0), 0.0).otherwise(F.round(F.col("__s.ab") / (F.sqrt("__s.aa") * norm), 6))).drop("__s", vector)
    scored = scored.filter(~F.isnan("score"))
    if min_score is not None:
        scored = scored.filter(F.col("score") >= min_score)
    return scored.orderBy(F.desc("score"), id_).limit(k)


def knn_batch(df: DataFrame, queries: DataFrame, k: int = 10, id_: str = "id", vector: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector", group_bytes: int = 32 << 20) -> DataFrame:
    """query_id, id, rank, score of the k nearest to each query; both tables hold vectors of one length. A query with null for its id is left out.

    Queries go to the tasks in groups of at most `group_bytes`, as a matrix; rows stream past it where they are read, in matrix products, and
    only each task's k best for each query leave it. A group is a pass over the rows, so what a task holds is bounded whatever the number of queries.
    """
    spark = df.sparkSession
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("v")).filter(F.col("query_id").isNotNull() & vectors.usable(F.col("v")))
    kind, query_kind = dict(df.dtypes)[id_], dict(queries.dtypes)[query_id]
    sizes = asked.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").collect()
    out = spark.createDataFrame([], f"query_id {query_kind}, id {kind}, score double")
    if sizes:
        d, n = sizes[0]
        asked, rows = asked.filter(F.size("v") == d), df.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & vectors.usable(F.col("v")) & (F.size("v") == d))
        rows = rows if rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism else rows.repartition(spark.sparkContext.defaultParallelism)
        groups = -(-n * 8 * (d + 4 * k) // group_bytes)
        for g in range(groups):
            part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g).toArrow()  # about group_bytes
            if part.num_rows:
                x = part.column(1).combine_chunks().flatten().to_numpy().reshape(-1, d)
                held = spark.sparkContext.broadcast((part.column(0), x / np.linalg.norm(x, axis=1)[:, None]))
                out = out.union(rows.mapInArrow(_nearest(held, k), out.schema))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id", "rank", "score")


def _first(near: np.ndarray, k: int) -> np.ndarray:
    """Of each row the columns of the k largest of these scores of 6 digits, largest first; of equal ones, those before. Only k are sorted."""
    n = near.shape[1]
    with np.errstate(invalid="ignore"):
        keys = np.rint(near * 1e6).astype(np.int64) * n + np.arange(n - 1, -1, -1)  # all different
    top = np.argpartition(keys, n - k, axis=1)[:, n - k :] if 0 < k < n else np.broadcast_to(np.arange(n), near.shape)
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(keys, top, 1), axis=1), 1)[:, :k]


def _nearest(held, k: int, chunk: int = 4096, tile: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = held.value
        best, who = np.full((len(q), 0), 0.0), np.full((len(q), 0), 0)
        ids: list = []  # all that some query still keeps
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                v = v / np.linalg.norm(v, axis=1)[:, None]
                new = part.column(0).to_pylist()
                order = sorted(range(len(new)), key=new.__getitem__)  # so equal scores keep the order of ids
                known = sorted({ids[i] for i in np.unique(who)} | set(new)) if len(ids) else sorted(set(new))
                place = {x: i for i, x in enumerate(known)}
                old = np.array([place.get(x, 0) for x in ids] or [0])[who]
                fresh = np.array([place[new[i]] for i in order])
                v = v[order]
                scores, names_ = [], []
                for lo in range(0, len(q), tile):
                    near = np.round(q[lo : lo + tile] @ v.T, 6) + 0.0
                    top = _first(near, k)
                    both = np.concatenate((best[lo : lo + tile], np.take_along_axis(near, top, 1)), 1)
                    whom = np.concatenate((old[lo : lo + tile], fresh[top]), 1)
                    keep = np.lexsort((whom, -both), axis=1)[:, :k]
                    scores.append(np.take_along_axis(both, keep, 1))
                    names_.append(np.take_along_axis(whom, keep, 1))
                best, who, ids = np.concatenate(scores), np.concatenate(names_), known
        if kind is not None and best.shape[1]:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(len(q)), best.shape[1]))).combine_chunks(), pa.array(ids, kind).take(pa.array(who.ravel())), pa.array(best.ravel())], ["query_id", "id", "score"])

    return run


def term_frequencies(df: DataFrame, fields: Sequence[str], id_: str = "id") -> DataFrame:
    """id, field, term, tf."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("terms")) for f in fields])
    rows = df.select(F.col(id_).alias("id"), F.explode(parts).alias("p")).select("id", "p.field", F.explode("p.terms").alias("term"))
    return rows.groupBy("id", "field", "term").agg(F.count("*").alias("tf"))


def document_frequencies(df: DataFrame, fields: Sequence[str], id_: str = "id") -> DataFrame:
    """term, df."""
    terms = F.array_distinct(F.flatten(F.array(*[tokens(F.col(f)) for f in fields])))
    return df.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_statistics(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: n, total_tokens, avgdl."""
    length = sum((F.size(tokens(F.col(f))) for f in fields[1:]), F.size(tokens(F.col(fields[0]))))
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("total_tokens"), F.round(F.avg(length), 6).alias("avgdl"))


def query_terms(query: str) -> list[str]:
    """The query's tokens, with repeats."""
    return re.findall(r"[^\W_]+", query.lower())


def bm25(df: DataFrame, query: str, fields: Sequence[str] = ("text",), weights: Mapping[str, float] | None = None, where: Mapping[str, object] | None = None, limit: int | None = 10, id_: str = "id", query_tokens: Sequence[str] | None = None) -> DataFrame:
    """id and score (rounded to 6 digits) of the rows that hold a term of the query, best first, without an index (`index.SearchIndex` has one).

    Counts of the corpus are over all rows, whatever `where` leaves. Repeated terms count repeatedly; a term in half the rows or more adds
    nothing, but its rows still match; a field of weight 0 can't match. Each text is read and cut into tokens once: lengths and the counts of
    the query's terms (a few numbers a row) are written, and both the corpus sums and the scores come from those.
    """
    weight = field_weights(fields, weights)
    asked = list(query_tokens) if query_tokens is not None else query_terms(query)
    if not asked:
        return df.select(F.col(id_).alias("id"), F.lit(0.0).alias("score")).limit(0)
    terms = list(dict.fromkeys(asked))
    is_ = lambda w: lambda x: x == F.lit(w)
    counts = lambda t: F.struct(F.size(t).alias("dl"), *[F.size(F.filter(t, is_(w))).alias(f"c{k}") for k, w in enumerate(terms)])
    # a variable of a lambda is computed once, where a column that several others use is put into each of them
    each = F.transform(F.array(*[tokens(F.col(f)) for f in fields]), counts)
    inside = predicate(df, where) if where else F.lit(True)
    counted = written(df.select(F.col(id_).alias("id"), inside.alias("in"), each.alias("f")))
    length = F.aggregate("f", F.lit(0), lambda s, x: s + x["dl"])
    some = lambda k: lambda x: x[f"c{k}"] > 0
    present = [F.exists("f", some(k)) for k in range(len(terms))]
    corpus = counted.agg(F.count("*").cast("double").alias("n"), F.avg(length).alias("avgdl"), *[F.sum(p.cast("int")).cast("double").alias(f"df{k}") for k, p in enumerate(present)])
    wtf = [sum((F.lit(weight[f]) * F.col("f")[n][f"c{k}"] for n, f in enumerate(fields)), F.lit(0.0)) for k in range(len(terms))]
    matching = counted.filter(F.col("in") & _any(present)).select("id", length.alias("dl"), *[w.alias(f"w{k}") for k, w in enumerate(wtf)]).crossJoin(F.broadcast(corpus))  # one row
    return ranked(matching, asked, limit)


def ranked(matching: DataFrame, asked: Sequence[str], limit: int | None) -> DataFrame:
    """id and score of rows with id, dl, the weighted counts w0, w1 ... of the different terms asked, and n, avgdl, df0, df1 ... of the corpus."""
    terms = list(dict.fromkeys(asked))
    score, matched = F.lit(0.0), F.lit(False)
    for token in asked:
        k = terms.index(token)
        w, df = F.col(f"w{k}"), F.col(f"df{k}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5))
        part = idf * (w * (K1 + 1)) / (w + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        score = score + F.when((w > 0) & (idf > 0), part).otherwise(0.0)
        matched = matched | (w > 0)
    out = matching.filter(matched).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id")
    return out if limit is None else out.limit(limit)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
