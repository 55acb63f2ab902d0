"""A search index in files: postings by term, and documents by id, in segments that later ones override."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import field_weights, tokens
from quarry.operators.collections import predicate
from quarry.operators.search import query_terms, ranked
from quarry.storage import small, written

#: Postings of a bucket that go to one task, about, and documents alive up to which their ids are broadcast.
PART, MOST_BROADCAST = 4_000_000, 2_000_000


def _counted(fields: int, rows: int = 1024):
    """For each document its columns, the number of its words, that of different ones, and these with their counts in each field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                lists = [batch.column(batch.num_columns - fields + k) for k in range(fields)]
                lengths = [np.diff(x.offsets.to_numpy()) for x in lists]
                words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
                kinds = max(1, len(words.dictionary))
                owner = np.concatenate([np.repeat(np.arange(batch.num_rows), n) for n in lengths])
                keys, which = np.unique(owner * kinds + words.indices.to_numpy(), return_inverse=True)
                cuts = np.cumsum([0, *(int(n.sum()) for n in lengths)])
                tf = [pa.array(np.bincount(which[a:b], minlength=len(keys))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                ends = np.searchsorted(keys, np.arange(batch.num_rows + 1) * kinds).astype(np.int32)
                each = pa.StructArray.from_arrays([words.dictionary.cast(pa.string()).take(pa.array(keys % kinds)), *tf], ["term", *(f"tf{k}" for k in range(fields))])
                own = batch.num_columns - fields
                columns = [*(batch.column(k) for k in range(own)), pa.array(sum(lengths).astype(np.int32)), pa.array(np.diff(ends).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), each)]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:own], "dl", "n", "p"])

    return run


class SearchIndex:
    """BM25 over the documents put into a folder, with the scores of `search.bm25`.

    Putting documents writes one segment: postings (term, id, counts by field, length), in folders by a hash of the term and sorted by it
    in each, and a row for each document with the columns kept for filters. A search reads its terms' folders only, and in those the row
    groups with its terms. A document put again replaces what there was; removing writes a row that says so. Corpus counts are over what is
    alive. Segments are numbered in the order of their writers, of which there may be one at a time; one without its mark of
    completion isn't seen, so a job that dies leaves no half of itself. `compacted` writes all that is alive as one segment elsewhere.
    """

    def __init__(self, spark: SparkSession, folder: str, fields: Sequence[str] = ("text",), keep: Sequence[str] = (), buckets: int = 64):
        self.spark, self.folder, self.fields, self.keep, self.buckets = spark, folder.rstrip("/"), list(fields), list(keep), buckets
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self._alive: tuple[list[int], DataFrame] | None = None
        self.files = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def segments(self) -> list[int]:
        """The numbers of the segments that are whole."""
        at = self.path(f"{self.folder}/done")
        return sorted(int(x.getPath().getName()) for x in self.files.listStatus(at)) if self.files.exists(at) else []

    def put(self, docs: DataFrame, id_: str = "id") -> None:
        """Puts documents in, each id once; those that are there are replaced. A null id is left out."""
        rows = docs.filter(F.col(id_).isNotNull())
        if twice := rows.groupBy(id_).agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect():
            raise ValueError(f"document {twice[0][0]!r} comes more than once")
        cut = rows.select(F.col(id_).alias("id"), *self.keep, *[tokens(F.col(f)).alias(f"__t{n}") for n, f in enumerate(self.fields)])
        segment = (self.segments() or [0])[-1] + 1
        held = f"{self.folder}/held-{uuid.uuid4().hex}"
        # a document's words are together: they are counted where it is read, without a shuffle
        n = len(self.fields)
        counts = T.StructType([T.StructField("term", T.StringType()), *(T.StructField(f"tf{k}", T.LongType()) for k in range(n))])
        schema = T.StructType([*cut.schema.fields[: -n], T.StructField("dl", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("p", T.ArrayType(counts))])
        cut.mapInArrow(_counted(n), schema).write.parquet(held)
        cut = self.spark.read.schema(schema).parquet(held)
        total = cut.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        postings = cut.select("id", "dl", F.explode("p").alias("p")).select("id", "dl", "p.*")
        postings = postings.withColumns({"segment": F.lit(segment), "bucket": F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")})
        self._postings(postings, total, f"{self.folder}/postings/segment={segment}")
        cut.select("id", "dl", *self.keep, F.lit(segment).alias("number"), F.lit(False).alias("gone")).write.mode("overwrite").parquet(f"{self.folder}/docs/segment={segment}")
        self.files.delete(self.path(held), True)
        self._done(segment)

    def _postings(self, rows: DataFrame, total: int, at: str) -> None:
        """Writes about `total` postings by bucket, sorted by term in each file. Large buckets are dealt to several tasks, so the commonest term isn't one task's."""
        parts = max(1, -(-total // (self.buckets * PART)))
        rows = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(parts))) if parts > 1 else rows.repartition("bucket")
        rows.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(at)

    def remove(self, ids: DataFrame, id_: str = "id") -> None:
        """Takes documents out; ids that aren't there do nothing."""
        segment = (self.segments() or [0])[-1] + 1
        there = self.documents().select("id", "dl", *self.keep).join(ids.select(F.col(id_).alias("id")).distinct(), "id", "left_semi")
        there.select("*", F.lit(segment).alias("number"), F.lit(True).alias("gone")).write.mode("overwrite").parquet(f"{self.folder}/docs/segment={segment}")
        self._done(segment)

    def _done(self, segment: int) -> None:
        self.files.create(self.path(f"{self.folder}/done/{segment}"), False).close()

    def documents(self) -> DataFrame:
        """id, dl, the kept columns and `number` (its segment) of what is alive."""
        numbers = self.segments()
        if not numbers:
            raise ValueError("nothing has been put into the index")
        all_ = self.spark.read.parquet(*[f"{self.folder}/docs/segment={n}" for n in numbers])
        if len(numbers) == 1:
            return all_.drop("gone")
        if self._alive is None or self._alive[0] != numbers:  # found out once for each state
            rest = [c for c in all_.columns if c != "id"]
            alive = all_.groupBy("id").agg(F.max_by(F.struct(*rest), "number").alias("r")).select("id", "r.*").filter("not gone").drop("gone")
            self._alive = numbers, written(alive)
        return self._alive[1]

    def search(self, query: str, weights: Mapping[str, float] | None = None, where: Mapping[str, object] | None = None, limit: int | None = 10, query_tokens: Sequence[str] | None = None) -> DataFrame:
        """id and score, as of `search.bm25`; `where` is about kept columns."""
        weight = field_weights(self.fields, weights)
        asked = list(query_tokens) if query_tokens is not None else query_terms(query)
        docs = self.documents()
        if not asked:
            return docs.select("id", F.lit(0.0).alias("score")).limit(0)
        terms = list(dict.fromkeys(asked))
        at = [f"{self.folder}/postings/segment={n}" for n in self.segments() if self.files.exists(self.path(f"{self.folder}/postings/segment={n}"))]
        buckets = sorted({r[0] for r in self.spark.range(1).select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).cast("int") for t in terms]))).collect()})
        found = None
        for path in at:
            part = self.spark.read.option("basePath", path).parquet(path).filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
            found = part if found is None else found.unionByName(part)
        wtf = sum((F.lit(weight[f]) * F.col(f"tf{n}") for n, f in enumerate(self.fields)), F.lit(0.0))
        one = lambda k: F.col("term") == F.lit(terms[k])
        # a document's rows for the query's terms, which are few, together
        by_doc = found.groupBy("id", "dl", "segment").agg(*[F.sum(F.when(one(k), wtf).otherwise(0.0)).alias(f"w{k}") for k in range(len(terms))], *[F.max(one(k).cast("int")).alias(f"has{k}") for k in range(len(terms))])
        inside = predicate(docs, where) if where else F.lit(True)
        alive = docs.select("id", F.col("number").alias("segment"), inside.alias("in"))
        if where or len(self.segments()) > 1:
            by_doc = by_doc.join(alive, ["id", "segment"])
        else:
            by_doc = by_doc.withColumn("in", F.lit(True))
        corpus = docs.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))
        held = by_doc.agg(*[F.coalesce(F.sum(f"has{k}"), F.lit(0)).cast("double").alias(f"df{k}") for k in range(len(terms))])
        return ranked(by_doc.filter("in").crossJoin(F.broadcast(corpus)).crossJoin(F.broadcast(held)), asked, limit)  # one row each

    def compacted(self, folder: str) -> SearchIndex:
        """What is alive, as the only segment of an index in another folder."""
        out, docs = SearchIndex(self.spark, folder, self.fields, self.keep, self.buckets), self.documents()
        at = [f"{self.folder}/postings/segment={n}" for n in self.segments() if self.files.exists(self.path(f"{self.folder}/postings/segment={n}"))]
        rows = None
        for path in at:
            part = self.spark.read.option("basePath", path).parquet(path)
            rows = part if rows is None else rows.unionByName(part)
        live = rows.join(small(docs.select("id", F.col("number").alias("segment")), MOST_BROADCAST), ["id", "segment"]).withColumn("segment", F.lit(1))
        self._postings(live, rows.count(), f"{folder}/postings/segment=1")  # counted from the files' footers
        docs.withColumns({"number": F.lit(1), "gone": F.lit(False)}).write.mode("overwrite").parquet(f"{folder}/docs/segment=1")
        out._done(1)
        return out
