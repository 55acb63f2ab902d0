"""Queries by name over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import documents as doc
from quarry.functions import names, temporal
from quarry.functions.text import match_expression
from quarry.operators import audit, collections, fixtures, graph, mutations, search, statements
from quarry.operators.collections import Filter
from quarry.sources import files
from quarry.streaming import copies

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TERMS = "ention mentre thlyer ciónado keitung the"
LENS_AT = "2024-01-15T00:00:00.000Z"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# collections


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def coll_list_where(spark, sf):
    return collections.list_records(table(spark, sf, "orders"), Filter({"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}))


@query("SELECT * FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 100")
def coll_sort_page(spark, sf):
    df = table(spark, sf, "customer").withColumn("ordinal", F.col("c_custkey"))
    return collections.list_records(df, Filter(sort_by="c_acctbal", descending=True, limit=50, offset=100)).drop("ordinal")


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def coll_count_where(spark, sf):
    return collections.count_records(table(spark, sf, "lineitem"), Filter({"l_returnflag": "R", "l_linestatus": "F"}, limit=3))


@query("SELECT * FROM part WHERE p_size IN (1, 7, 23, 49)")
def coll_where_in(spark, sf):
    return collections.list_where_in(table(spark, sf, "part"), "p_size", [1, 7, 23, 49])


@query("SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def coll_semi_in(spark, sf):
    return collections.semi_in(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'"), "c_custkey")


@query("SELECT * FROM customer WHERE c_custkey = 7 LIMIT 1")
def coll_get(spark, sf):
    return collections.get(table(spark, sf, "customer"), 7, "c_custkey")


@query("SELECT count(*) > 0 AS found FROM supplier WHERE s_suppkey = 3")
def coll_has(spark, sf):
    return collections.has(table(spark, sf, "supplier"), 3, "s_suppkey")


@query("SELECT s_name FROM supplier WHERE starts_with(s_name, 'Supplier#00000001') ORDER BY 1")
def kv_prefix_keys(spark, sf):
    return collections.keys(table(spark, sf, "supplier"), "Supplier#00000001", "s_name")


@query("SELECT * EXCLUDE (o_orderstatus) FROM orders WHERE o_orderstatus = 'O'")
def namespace_view(spark, sf):
    return collections.in_namespace(table(spark, sf, "orders"), "O", "o_orderstatus")


def _props(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumn("data", F.parse_json("props"))


@query("SELECT event_id, user_id FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AND (props->'$.k')::INT = 42")
def json_where_num(spark, sf):
    return _props(spark, sf).filter(doc.equals(F.col("data"), "k", 42)).select("event_id", "user_id")


@query("SELECT event_id FROM (SELECT event_id, CASE event_type WHEN 'click' THEN '{\"x\": null}' WHEN 'view' THEN '{}' ELSE props END AS d FROM events) WHERE json_type(d, '$.x') = 'NULL'")
def json_null(spark, sf):
    d = F.when(F.col("event_type") == "click", '{"x": null}').when(F.col("event_type") == "view", "{}").otherwise(F.col("props"))
    return table(spark, sf, "events").filter(doc.equals(F.parse_json(d), "x", None)).select("event_id")


@query("SELECT event_id, (props->'$.k')::INT AS k FROM events WHERE (props->'$.k')::INT IN (1, 5, 9)")
def json_where_in(spark, sf):
    return _props(spark, sf).filter(doc.within(F.col("data"), "k", [1, 5, 9])).select("event_id", F.variant_get("data", "$.k", "int").alias("k"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def insert_only(spark, sf):
    new = table(spark, sf, "part").select("p_partkey", "p_name")
    return collections.insert_only(new, table(spark, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


# vectors


def _first_vector(spark, sf) -> list[float]:
    return table(spark, sf, "embeddings").filter("vec_id = 0").first().embedding


def _knn_sql(where: str = "true", floor: str = "true", k: int = 10) -> str:
    return f"""
        WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
        s AS (SELECT vec_id, label, round(list_cosine_similarity(v.embedding::DOUBLE[], q.e), 6) AS score FROM embeddings v, q WHERE {where})
        SELECT * FROM s WHERE {floor} ORDER BY score DESC, vec_id LIMIT {k}"""


def _knn(spark, sf, **options) -> DataFrame:
    return search.knn(table(spark, sf, "embeddings"), _first_vector(spark, sf), id_="vec_id", vector="embedding", **options)


@query(_knn_sql())
def knn_top10(spark, sf):
    return _knn(spark, sf)


@query(_knn_sql(floor="score >= 0.1", k=1000))
def knn_min_score(spark, sf):
    return _knn(spark, sf, k=1000, min_score=0.1)


@query(_knn_sql("label = 3"))
def knn_where(spark, sf):
    return _knn(spark, sf, where={"label": 3})


@query(_knn_sql("label <> 3"))
def knn_where_not(spark, sf):
    return _knn(spark, sf, where_not={"label": 3})


@query("""
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, v q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s)
    SELECT query_id, id, rank, score FROM r WHERE rank <= 5""")
def knn_batch_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    return search.knn_batch(v, v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 5, "vec_id", "embedding")


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS square, len(embedding) AS dims FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)")
def vector_norms(spark, sf):
    from quarry.functions import vectors

    v = F.col("embedding")
    return table(spark, sf, "embeddings").filter(vectors.usable(v)).select("vec_id", F.round(vectors.dot(v, v), 6).alias("square"), F.size(v).alias("dims"))


@query("SELECT vec_id, embedding FROM embeddings")
def vector_codec(spark, sf):
    from quarry.functions import vectors

    return table(spark, sf, "embeddings").select("vec_id", vectors.to_bytes("embedding").alias("b")).select("vec_id", vectors.from_bytes("b").alias("embedding"))


# text

_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _bm25_sql(source: str, fields: dict[str, float], where: str = "true", limit: int = 10) -> str:
    terms = ", ".join(f"('{t}', {n})" for n, t in enumerate(TERMS.split()))
    per_field = " UNION ALL ".join(f"SELECT id, {w}::DOUBLE AS w, unnest({_TOK.format(f)}) AS term FROM d" for f, w in fields.items())
    return f"""
        WITH d AS ({source}), t AS ({per_field}), q(term, n) AS (VALUES {terms}),
        dl AS (SELECT d.id, count(t.term) AS dl FROM d LEFT JOIN t USING (id) GROUP BY d.id),
        c AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
        df AS (SELECT term, count(DISTINCT id)::DOUBLE AS df FROM t GROUP BY term),
        wtf AS (SELECT id, term, sum(w) AS wtf FROM t GROUP BY id, term HAVING sum(w) > 0),
        s AS (SELECT wtf.id, sum(CASE WHEN ln((c.n - df + 0.5) / (df + 0.5)) > 0 THEN ln((c.n - df + 0.5) / (df + 0.5)) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END) AS score
              FROM q JOIN wtf USING (term) JOIN df USING (term) JOIN dl ON dl.id = wtf.id CROSS JOIN c GROUP BY wtf.id)
        SELECT s.id, round(score, 6) AS score FROM s JOIN d ON d.id = s.id WHERE {where} ORDER BY round(score, 6) DESC, s.id LIMIT {limit}"""


@query(_bm25_sql("SELECT doc_id AS id, text FROM documents", {"text": 1}))
def bm25_single(spark, sf):
    return search.bm25(table(spark, sf, "documents"), TERMS, id_="doc_id")


@query(_bm25_sql("SELECT doc_id AS id, text, lang FROM documents", {"text": 1}, "lang = 'en'"))
def bm25_filtered(spark, sf):
    return search.bm25(table(spark, sf, "documents"), TERMS, where={"lang": "en"}, id_="doc_id")


_ROLES = {"user": 1.0, "assistant": 3.0, "system": 0.0}


def _conversations(spark, sf) -> DataFrame:
    turns = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), " ").alias(role)
    return table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(*[turns(r) for r in _ROLES])


@query(_bm25_sql("SELECT conv_id AS id, " + ", ".join(f"coalesce(string_agg(text, ' ' ORDER BY turn, text) FILTER (role = '{r}'), '') AS {r}" for r in _ROLES) + " FROM conversations GROUP BY conv_id", _ROLES, limit=100))
def bm25_weighted(spark, sf):
    return search.bm25(_conversations(spark, sf), TERMS, list(_ROLES), _ROLES, limit=100)


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY term")
def term_df(spark, sf):
    return search.document_frequencies(table(spark, sf, "documents"), ["text"], "doc_id")


@query(f"SELECT doc_id AS id, 'text' AS field, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY ALL")
def term_tf(spark, sf):
    return search.term_frequencies(table(spark, sf, "documents"), ["text"], "doc_id")


@query(f"SELECT count(*) AS n, sum(len({_TOK.format('text')})) AS total_tokens, round(avg(len({_TOK.format('text')})), 6) AS avgdl FROM documents")
def corpus_stats(spark, sf):
    return search.corpus_statistics(table(spark, sf, "documents"), ["text"])


@query(f"SELECT item_id, array_to_string(list_transform({_TOK.format('text')}, lambda x: '\"' || x || '\"'), ' OR ') AS expression FROM benchmark")
def match_expressions(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", match_expression(F.col("text")).alias("expression"))


# graphs


def _supply(spark, sf) -> DataFrame:
    pairs = table(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("from"), F.concat(F.lit("s"), "l_suppkey").alias("to"), F.col("l_returnflag").alias("type")).distinct()
    return pairs.select(F.concat_ws("-", "from", "to", "type").alias("id"), "from", "to", "type")


_SUPPLY = "WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS f, 's' || l_suppkey AS t, l_returnflag AS type FROM lineitem), g AS (SELECT concat_ws('-', f, t, type) AS id, f AS \"from\", t AS \"to\", type FROM e) "


@query(_SUPPLY + "SELECT * FROM g WHERE \"from\" = 'p17'")
def graph_neighbors_out(spark, sf):
    return graph.neighbors(_supply(spark, sf), "p17", "out")


@query(_SUPPLY + "SELECT * FROM g WHERE \"to\" = 's5' AND type IN ('R', 'A')")
def graph_neighbors_in(spark, sf):
    return graph.neighbors(_supply(spark, sf), "s5", "in", ["R", "A"])


@query(_SUPPLY + "SELECT * FROM g WHERE (\"to\" = 's5' OR \"from\" = 's5') AND type = 'N'")
def graph_neighbors_both(spark, sf):
    return graph.neighbors(_supply(spark, sf), "s5", "both", where={"type": "N"})


_BFS = _SUPPLY + """, w AS (SELECT "from" AS a, "to" AS b, id FROM g WHERE type = 'R' UNION ALL SELECT "to", "from", id FROM g WHERE type = 'R'),
    r(node, dist) AS (SELECT 'p17', 0 UNION SELECT b, dist + 1 FROM r JOIN w ON a = node WHERE dist < 2), m AS (SELECT node, min(dist) AS dist FROM r GROUP BY node) """


@query(_BFS + "SELECT node, dist FROM m WHERE dist > 0")
def graph_bfs_depth2(spark, sf):
    return graph.traverse(_supply(spark, sf), "p17", 2, "both", ["R"])[0]


@query(_BFS + "SELECT * FROM g WHERE id IN (SELECT id FROM w JOIN m ON a = node WHERE dist < 2)")
def graph_bfs_edges(spark, sf):
    return graph.traverse(_supply(spark, sf), "p17", 2, "both", ["R"])[1]


def _lineage(spark, sf) -> DataFrame:
    """Customer to order, order to part, part to supplier."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    name = lambda p, c: F.concat(F.lit(p), c)
    pairs = o.select(name("c", "o_custkey").alias("from"), name("o", "o_orderkey").alias("to")).union(l.select(name("o", "l_orderkey"), name("p", "l_partkey"))).union(l.select(name("p", "l_partkey"), name("s", "l_suppkey")))
    # dealt out by where they begin: the rows that are distinct, and what is joined by that end, need no further shuffle
    return pairs.repartition("from").distinct().select(F.concat_ws("-", "from", "to").alias("id"), "from", "to", F.lit("made").alias("type"))


_LINEAGE = "e AS (SELECT 'c' || o_custkey AS f, 'o' || o_orderkey AS t FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem)"


@query(f"WITH RECURSIVE {_LINEAGE}, r(node, dist) AS (SELECT 'c7', 0 UNION SELECT t, dist + 1 FROM r JOIN e ON f = node) SELECT node, min(dist) AS dist FROM r GROUP BY node")
def lineage_reach(spark, sf):
    return graph.reachable(_lineage(spark, sf), spark.createDataFrame([("c7",)], "node string"))


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT 'n' || c_nationkey AS f, 'n' || s_nationkey AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
                         UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION SELECT 'n' || c_nationkey, 'm' || c_mktsegment FROM customer),
    p(a, b) AS (SELECT f, t FROM e UNION SELECT a, t FROM p JOIN e ON b = f),
    cyc AS (SELECT a AS n FROM p WHERE a = b),
    after AS (SELECT n FROM cyc UNION SELECT b FROM p JOIN cyc ON a = n), before AS (SELECT n FROM cyc UNION SELECT a FROM p JOIN cyc ON b = n)
    SELECT f || '-' || t AS id, f AS "from", t AS "to" FROM e WHERE f IN (SELECT n FROM after) AND t IN (SELECT n FROM before)""")
def graph_cycle_edges(spark, sf):
    l, o, c, s = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    name = lambda p, x: F.concat(F.lit(p), x)
    trade = l.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = trade.select(name("n", "c_nationkey").alias("from"), name("n", "s_nationkey").alias("to")).distinct().union(table(spark, sf, "nation").select(name("r", "n_regionkey"), name("n", "n_nationkey"))).union(c.select(name("n", "c_nationkey"), name("m", "c_mktsegment"))).distinct()
    return graph.cycle_edges(pairs.select(F.concat_ws("-", "from", "to").alias("id"), "from", "to"))


# statements


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _revisions(spark, sf) -> DataFrame:
    """Events as revisions of one statement for each user and type; every third is valid from its time on, every fourth has no known start."""
    from pyspark.sql import Window as W

    e = table(spark, sf, "events")
    by = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    bound = lambda none, at: F.struct(F.when(none, "unbounded").otherwise("instant").alias("kind"), _iso(at).alias("at"), F.lit(None).cast("string").alias("anchorId"))
    start, end = temporal.valid_keys(bound(F.col("event_id") % 4 == 0, F.col("ts")), bound(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 10 DAYS")))
    return e.select(
        F.lit("w").alias("world_id"), F.col("event_type").alias("branch_id"), F.col("user_id").alias("statement_id"), F.row_number().over(by).alias("revision"),
        F.when(F.col("value") > 80, "retracted").when(F.col("value") > 40, "accepted").otherwise("proposed").alias("status"),
        F.when(F.col("event_id") % 2 == 0, "asserted").otherwise("reported").alias("modality"), F.col("ts").alias("recorded_at"), start.alias("valid_from_key"), end.alias("valid_to_key"),
        F.array(F.concat(F.lit("src"), F.col("event_id") % 5)).alias("source_ids"),
    )


_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_REVISIONS = f"""
    WITH r AS (SELECT 'w' AS world_id, event_type AS branch_id, user_id AS statement_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::INTEGER AS revision,
        CASE WHEN value > 80 THEN 'retracted' WHEN value > 40 THEN 'accepted' ELSE 'proposed' END AS status, CASE WHEN event_id % 2 = 0 THEN 'asserted' ELSE 'reported' END AS modality, ts AS recorded_at,
        'instant:' || CASE WHEN event_id % 4 = 0 THEN '{temporal.EARLIEST}' ELSE {_ISO.format("ts")} END AS valid_from_key,
        'instant:' || CASE WHEN event_id % 3 = 0 THEN '{temporal.LATEST}' ELSE {_ISO.format("ts + INTERVAL 10 DAY")} END AS valid_to_key, ['src' || (event_id % 5)] AS source_ids FROM events),
    h AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY world_id, branch_id, statement_id ORDER BY revision DESC) = 1) """
_SHOWN = "branch_id, statement_id, revision, status, recorded_at"


@query(_REVISIONS + f"SELECT {_SHOWN} FROM h")
def bitemporal_heads(spark, sf):
    return statements.heads(_revisions(spark, sf)).select(*_SHOWN.split(", "))


@query(_REVISIONS + f"SELECT {_SHOWN}, lag(status) OVER (PARTITION BY world_id, branch_id, statement_id ORDER BY revision) AS previous_status FROM r")
def bitemporal_history(spark, sf):
    return statements.history(_revisions(spark, sf)).select(*_SHOWN.split(", "), "previous_status")


_LENS = f"FROM h WHERE branch_id = 'click' AND status IN ('proposed', 'accepted') AND valid_from_key <= 'instant:{LENS_AT}' AND valid_to_key >= 'instant:{LENS_AT}'"


@query(_REVISIONS + f"SELECT {_SHOWN} {_LENS} ORDER BY recorded_at DESC, statement_id LIMIT 100")
def bitemporal_lens(spark, sf):
    return statements.lens(_revisions(spark, sf), statements.Lens("w", "click", statuses=("proposed", "accepted"), valid_at=LENS_AT)).select(*_SHOWN.split(", "))


@query(_REVISIONS + f"SELECT {_SHOWN} FROM (SELECT * {_LENS} ORDER BY recorded_at DESC, statement_id LIMIT 20) WHERE list_has_any(source_ids, ['src1', 'src2'])")
def bitemporal_lens_sources(spark, sf):
    return statements.lens(_revisions(spark, sf), statements.Lens("w", "click", statuses=("proposed", "accepted"), valid_at=LENS_AT, source_ids=("src1", "src2"), limit=20)).select(*_SHOWN.split(", "))


@query(_REVISIONS + f"SELECT {_SHOWN} FROM r WHERE recorded_at <= TIMESTAMP '2024-01-10' QUALIFY row_number() OVER (PARTITION BY world_id, branch_id, statement_id ORDER BY revision DESC) = 1")
def bitemporal_as_known(spark, sf):
    return statements.as_known_at(_revisions(spark, sf), F.lit("2024-01-10").cast("timestamp_ntz")).select(*_SHOWN.split(", "))


@query(_REVISIONS + """, q AS (SELECT user_id AS statement_id, min(event_id) AS k, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY user_id),
    c AS (SELECT * FROM h WHERE branch_id = 'click'),
    x AS (SELECT q.statement_id, CASE WHEN k % 3 = 0 THEN 'admit' WHEN k % 3 = 1 THEN 'revise' ELSE 'retract' END AS op, CASE WHEN k % 5 = 0 THEN 1 ELSE c.revision END AS expected, c.revision AS rev, c.status AS st, CASE WHEN k % 2 = 0 THEN 'proposed' ELSE 'accepted' END AS want FROM q LEFT JOIN c USING (statement_id)),
    y AS (SELECT *, CASE WHEN op = 'retract' THEN 'retracted' ELSE want END AS new, CASE WHEN st IN ('rejected', 'superseded', 'retracted') THEN 'terminal-head' WHEN op = 'admit' AND rev IS NOT NULL THEN 'head-exists' WHEN op <> 'admit' AND rev IS NULL THEN 'missing-head'
        WHEN op <> 'admit' AND rev <> expected THEN 'expected-revision-mismatch' WHEN op = 'revise' AND NOT (st = 'proposed' OR (st = 'accepted' AND want = 'accepted')) THEN 'invalid-transition' END AS reason FROM x)
    SELECT statement_id, CASE WHEN reason IS NULL THEN 'committed' ELSE 'refused' END AS outcome, reason, CASE WHEN reason IS NULL THEN coalesce(rev, 0) + 1 END AS revision, CASE WHEN reason IS NULL THEN new END AS status FROM y""")
def statement_admission(spark, sf):
    h = statements.heads(_revisions(spark, sf)).filter("branch_id = 'click'")
    asked = table(spark, sf, "events").filter("event_type <> 'click'").groupBy(F.col("user_id").alias("statement_id")).agg(F.min("event_id").alias("k"))
    known = asked.join(h.select("statement_id", F.col("revision").alias("__r")), "statement_id", "left")
    requests = known.select(
        "statement_id", F.when(F.col("k") % 3 == 0, "admit").when(F.col("k") % 3 == 1, "revise").otherwise("retract").alias("operation"), F.col("k").cast("string").alias("idempotency_key"), F.lit("f").alias("fingerprint"),
        F.when(F.col("k") % 5 == 0, 1).otherwise(F.col("__r")).alias("expected_revision"), F.when(F.col("k") % 2 == 0, "proposed").otherwise("accepted").alias("decided_status"), F.lit("user").alias("source"), F.lit(False).alias("model_involved"), F.lit(None).cast("string").alias("superseded_by"),
    )
    return statements.admit(h, requests).select("statement_id", "outcome", "reason", "revision", "status")


# artifacts


def _records(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("object_key"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("digest"))


def _objects(spark, sf) -> DataFrame:
    """What labels say is stored: toxic documents have another size, those of low quality another digest; some ids are no document's."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("digest"))
    j = table(spark, sf, "labels").join(d, "doc_id")
    return j.select((F.col("doc_id") + F.when(F.col("doc_id") % 50 == 0, 1_000_000_000).otherwise(0)).alias("object_key"), (F.col("n_chars") + F.col("toxic")).alias("size"), F.when(F.col("quality") == 0, "other").otherwise(F.col("digest")).alias("digest"))


_AUDIT = """
    WITH r AS (SELECT doc_id AS id, n_chars AS size, sha256(text) AS digest FROM documents),
    o AS (SELECT l.doc_id + CASE WHEN l.doc_id % 50 = 0 THEN 1000000000 ELSE 0 END AS key, r.size + toxic AS size, CASE WHEN quality = 0 THEN 'other' ELSE digest END AS digest FROM labels l JOIN r ON r.id = l.doc_id),
    f AS (SELECT 'object-without-record' AS code, key::VARCHAR AS subject FROM o WHERE key NOT IN (SELECT id FROM r)
          UNION ALL SELECT 'record-without-object', id::VARCHAR FROM r WHERE id NOT IN (SELECT key FROM o)
          UNION ALL SELECT 'size-mismatch', id::VARCHAR FROM r JOIN o ON id = key WHERE r.size <> o.size
          UNION ALL SELECT 'digest-mismatch', id::VARCHAR FROM r JOIN o ON id = key WHERE r.digest <> o.digest) """


@query(_AUDIT + "SELECT * FROM f")
def audit_objects(spark, sf):
    return audit.object_findings(_records(spark, sf), _objects(spark, sf))


@query(_AUDIT + "SELECT code, count(*) AS n FROM f WHERE code = 'object-without-record' GROUP BY code")
def audit_orphans(spark, sf):
    return audit.object_findings(_records(spark, sf), _objects(spark, sf)).filter("code = 'object-without-record'").groupBy("code").agg(F.count("*").alias("n"))


@query(_AUDIT + """, a AS (SELECT CASE code WHEN 'object-without-record' THEN 'delete-unreferenced-object' WHEN 'record-without-object' THEN 'delete-record-without-object' ELSE 'reverify-imported-object' END AS operation, code, subject FROM f)
    SELECT sha256('' || chr(0) || operation || chr(0) || code || chr(0) || subject) AS action_id, * FROM a""")
def audit_repairs(spark, sf):
    return audit.repairs(audit.object_findings(_records(spark, sf), _objects(spark, sf)))


@query(f"""WITH {_LINEAGE}, g AS (SELECT f || '-' || t AS id, f, t FROM e WHERE f[1] <> 'p'), n AS (SELECT 'o' || o_orderkey AS id FROM orders UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_size < 40)
    SELECT 'lineage-missing-source' AS code, id AS subject FROM g WHERE f NOT IN (SELECT id FROM n) UNION ALL SELECT 'lineage-missing-result', id FROM g WHERE t NOT IN (SELECT id FROM n)""")
def audit_lineage(spark, sf):
    name = lambda p, x: F.concat(F.lit(p), x).alias("id")
    records = table(spark, sf, "orders").select(name("o", "o_orderkey")).union(table(spark, sf, "customer").filter("c_acctbal > 0").select(name("c", "c_custkey"))).union(table(spark, sf, "part").filter("p_size < 40").select(name("p", "p_partkey")))
    return audit.lineage_findings(records, _lineage(spark, sf).filter(~F.startswith("from", F.lit("p"))), cycles=False)


@query("SELECT page_id AS id, sha256(html) AS sha256, page_id % 7 <> 0 AS ok FROM pages")
def sha_verify(spark, sf):
    p = table(spark, sf, "pages")
    records = p.select(F.col("page_id").alias("id"), F.col("page_id").alias("object_key"), F.when(F.col("page_id") % 7 == 0, "stale").otherwise(F.sha2("html", 256)).alias("digest"))
    return audit.verify(records, p.select(F.col("page_id").alias("object_key"), F.col("html").alias("content")))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1997-01-01', 0) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def cursor_page(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return audit.page(o, 50, (F.lit("1997-01-01").cast("timestamp_ntz"), 0), "o_orderdate", "o_orderkey")


@query("SELECT conv_id, count(*) AS n_chunks, sum(strlen(text))::BIGINT AS size, sha256(string_agg(text, '' ORDER BY turn, text)) AS sha256 FROM conversations GROUP BY conv_id")
def chunk_assembly(spark, sf):
    whole = audit.assembled(table(spark, sf, "conversations"), "conv_id", "turn", "text")
    return whole.select("conv_id", "n_chunks", "size", F.sha2("content", 256).alias("sha256"))


@query("""
    WITH e AS (SELECT * FROM orders), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 17 <> 0)
    SELECT e.o_orderkey, 'missing' AS field, NULL::VARCHAR AS expected, NULL::VARCHAR AS actual FROM e WHERE o_orderkey % 17 = 0
    UNION ALL SELECT e.o_orderkey, 'o_orderstatus', e.o_orderstatus, a.o_orderstatus FROM e JOIN a USING (o_orderkey) WHERE e.o_orderstatus IS DISTINCT FROM a.o_orderstatus
    UNION ALL SELECT e.o_orderkey, 'o_orderpriority', e.o_orderpriority, a.o_orderpriority FROM e JOIN a USING (o_orderkey) WHERE e.o_orderpriority IS DISTINCT FROM a.o_orderpriority""")
def dual_read_diff(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    other = o.filter(k % 17 != 0).withColumns({"o_orderstatus": F.when(k % 11 == 0, "X").otherwise(F.col("o_orderstatus")), "o_orderpriority": F.when(k % 13 != 0, F.col("o_orderpriority"))})
    return audit.parity(o, other, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("SELECT event_type, round(quantile_disc(value, 0.5), 3) AS median, round(quantile_disc(value, 0.95), 3) AS p95, round(quantile_disc(value, 0.99), 3) AS p99, round(max(value), 3) AS max, count(*) AS n FROM events GROUP BY event_type")
def latency_quantiles(spark, sf):
    return audit.latencies(table(spark, sf, "events"), "value", "event_type")


# mutations and copies


@query("SELECT user_id, max_by(event_id, event_id) AS event_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value, min(event_id) AS ordinal FROM events GROUP BY user_id")
def latest_state(spark, sf):
    return mutations.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("""
    WITH l AS (SELECT user_id, event_id, value, event_type = 'purchase' AS gone FROM events), d AS (SELECT user_id, max(event_id) FILTER (gone) AS dead FROM l GROUP BY user_id)
    SELECT l.user_id, max(event_id) AS event_id, max_by(value, event_id) AS value, false AS gone, min(event_id) AS ordinal FROM l JOIN d USING (user_id) WHERE dead IS NULL OR event_id > dead GROUP BY l.user_id""")
def latest_state_deletes(spark, sf):
    log = table(spark, sf, "events").select("user_id", "event_id", "value", (F.col("event_type") == "purchase").alias("gone"))
    return mutations.latest(log, "user_id", "event_id", "gone")


@query("SELECT user_id || ':' || event_type || ':' || ts::DATE AS idempotency_key, min(event_id) AS event_id, min_by(value, event_id) AS value, count(*) AS attempts FROM events GROUP BY 1")
def idempotent_dedup(spark, sf):
    e = table(spark, sf, "events").select(F.concat_ws(":", "user_id", "event_type", F.col("ts").cast("date")).alias("idempotency_key"), "event_id", "value")
    return mutations.first_requests(e, "idempotency_key", "event_id")


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_targets(spark, sf):
    return mutations.repeated_targets(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query("""
    WITH pt AS (SELECT l_partkey AS p_partkey, l_orderkey * 10 + l_linenumber AS prio, CASE WHEN l_returnflag = 'R' THEN l_quantity::INTEGER END AS p_size, CASE WHEN l_linestatus = 'F' THEN l_extendedprice END AS p_retailprice FROM lineitem),
    t AS (SELECT p_partkey, arg_max(p_size, prio) FILTER (p_size IS NOT NULL) AS s, arg_max(p_retailprice, prio) FILTER (p_retailprice IS NOT NULL) AS r, count(*) AS n FROM pt GROUP BY p_partkey)
    SELECT p.p_partkey, p_name, coalesce(s, p_size) AS p_size, round(coalesce(r, p_retailprice), 2) AS p_retailprice, coalesce(n, 0) AS n_patches FROM part p LEFT JOIN t USING (p_partkey)""")
def layered_merge(spark, sf):
    l = table(spark, sf, "lineitem")
    patches = l.select(F.col("l_partkey").alias("p_partkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("priority"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("int")).alias("p_size"), F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice")).alias("p_retailprice"))
    return fixtures.layered_columns(table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), patches, "p_partkey").withColumn("p_retailprice", F.round("p_retailprice", 2))


@query("SELECT 'part:' || p_partkey AS ref, CASE WHEN p_size > 25 THEN '{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || ',\"tags\":{\"big\":true,\"made\":\"x\"}}' ELSE '{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || ',\"tags\":{\"made\":\"x\"}}' END AS value, CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS n_layers FROM part")
def layered_documents(spark, sf):
    p = table(spark, sf, "part").withColumn("ref", F.concat(F.lit("part:"), "p_partkey"))
    base = files.fixtures_from(p.withColumn("doc", F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.struct(F.lit("x").alias("made")).alias("tags")))), "ref", "doc", "base")
    patch = files.fixtures_from(p.filter("p_size > 25").withColumn("doc", F.concat(F.lit('{"$patch":"'), "ref", F.lit('","tags":{"big":true}}'))), "ref", "doc", "app", 10)
    return fixtures.layered(base.union(patch), "deep").select("ref", "value", F.size("provenance").alias("n_layers"))


@query("SELECT 'order:' || o_orderkey AS \"from\", 'customer:' || o_custkey AS \"to\", 'by' AS path FROM orders UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'lines.' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1) FROM lineitem")
def reference_edges(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    lines = l.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("part:"), x["l_partkey"])).alias("lines"))
    docs = o.join(lines, o.o_orderkey == lines.l_orderkey, "left").select(F.concat(F.lit("order:"), "o_orderkey").alias("ref"), F.to_json(F.struct(F.concat(F.lit("customer:"), "o_custkey").alias("by"), "lines")).alias("value"))
    return fixtures.references(docs).select("from", "to", F.array_join("field_path", ".").alias("path"))


@query("SELECT source || '/' || lang AS path, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_paths(spark, sf):
    held = table(spark, sf, "documents").select(F.lit("d").alias("source"), F.concat_ws("/", "source", "lang").alias("path"))
    return fixtures.duplicate_paths(held).select("path", "n")


@query("SELECT event_id, user_id, value FROM events WHERE event_id >= 2500")
def manifest_resume(spark, sf):
    return copies.manifest(table(spark, sf, "events"), 2500, "event_id").select("event_id", "user_id", "value")


@query("SELECT * FROM supplier")
def resumed_copy(spark, sf):
    import uuid

    from quarry.storage import shared_dir

    at = f"{shared_dir(spark)}/copy-{uuid.uuid4().hex}"
    s = table(spark, sf, "supplier")
    first = s.agg(F.min("s_suppkey")).first()[0] or 0
    rows = s.withColumn("ordinal", F.col("s_suppkey") - first)
    most = (rows.agg(F.max("ordinal")).first()[0] or 0) // 3 + 1

    class Interrupted(Exception):
        pass

    def stop(lane: str, done: int) -> None:
        raise Interrupted

    try:  # cut off after a batch, and gone on with
        copies.copy(rows, f"{at}/out", f"{at}/ledger", "suppliers", most, on_batch=stop)
    except Interrupted:
        copies.copy(rows, f"{at}/out", f"{at}/ledger", "suppliers", most)
    return spark.read.schema(rows.schema).parquet(f"{at}/out").drop("ordinal", "batch")


@query("SELECT * FROM nation")
def streamed_copy(spark, sf):
    import uuid

    from quarry.storage import shared_dir

    at, n = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", table(spark, sf, "nation")
    n.write.parquet(f"{at}/in")
    copies.stream_copy(spark, f"{at}/in", n.schema.simpleString()[7:-1].replace(":", " "), f"{at}/out", f"{at}/checkpoint", "n_nationkey").awaitTermination()
    return spark.read.schema(n.schema).parquet(f"{at}/out").drop("batch")


@query("SELECT user_id AS key, max(event_id) AS generation, max_by(ts + INTERVAL 1 DAY, event_id) AS expires_at FROM events WHERE ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-28' GROUP BY user_id")
def live_leases(spark, sf):
    leases = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("generation"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"))
    return copies.unexpired(leases, F.lit("2024-01-28").cast("timestamp_ntz"))


@query("SELECT p_partkey, p_brand || ':' || p_partkey AS cursor, lower(hex(p_name)) AS table_name, sha256(p_name) AS digest, 'record:' || length(p_brand) || ':' || p_brand || ':' || length(p_name) || ':' || p_name AS target, regexp_matches('part:' || p_partkey, '^[A-Za-z][A-Za-z0-9_-]*:[^:\\s/]+$') AS is_ref FROM part")
def name_functions(spark, sf):
    n, b = F.col("p_name"), F.col("p_brand")
    return table(spark, sf, "part").select("p_partkey", names.cursor(b, F.col("p_partkey").cast("string")).alias("cursor"), names.table_name(n).alias("table_name"), names.digest(n).alias("digest"), names.target_key(F.lit("record"), b, n).alias("target"), names.is_ref(F.concat(F.lit("part:"), "p_partkey")).alias("is_ref"))


# what the operators above leave of collections, vectors and search


@query("SELECT event_id FROM events WHERE (props->'$.k')::INT IN (1, 5)")
def json_where_in_strict(spark, sf):
    return collections.list_where_in(_props(spark, sf), "k", [1, "7", True, None, 5.0, [9]], data="data").select("event_id")


@query("SELECT p_partkey FROM part WHERE p_size IN (7, 23)")
def coll_where_in_kinds(spark, sf):
    return collections.list_where_in(table(spark, sf, "part"), "p_size", [7, "1", True, None, 23.0, 2**70, "x"]).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 0")
def coll_where_in_long(spark, sf):
    return collections.list_where_in(table(spark, sf, "part"), "p_size", [*range(0, 4000, 2), "3", True], most_literals=100).select("p_partkey")


@query("SELECT k.user_id AS key, k.event_type, CASE WHEN k.user_id % 3 <> 0 THEN v.version END AS version FROM (SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id) k LEFT JOIN (SELECT user_id, 'v' || max(event_id) AS version FROM events GROUP BY user_id) v USING (user_id)")
def versioned_records(spark, sf):
    now = mutations.latest(table(spark, sf, "events").select(F.col("user_id").alias("key"), "event_id", "event_type"), "key", "event_id")
    return collections.with_versions(now.select("key", "event_type"), now.filter("key % 3 <> 0").select("key", F.concat(F.lit("v"), "event_id").alias("version")))


@query(_knn_sql("label <> 3 AND v.vec_id <> 5"))
def knn_any_not(spark, sf):
    return _knn(spark, sf, where_not={"label": 3, "vec_id": 5}, any_not=True)


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, len(a.embedding) AS dims FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf):
    from quarry.functions import vectors

    v = table(spark, sf, "embeddings")
    d = v.select(F.size("embedding").alias("d")).first()
    next_ = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(next_, "vec_id").select("vec_id", F.round(vectors.cosine(vectors.checked(F.col("embedding"), d.d), F.col("other")), 6).alias("cosine"), F.size("embedding").alias("dims")) if d else v.select("vec_id", F.lit(0.0).alias("cosine"), F.lit(0).alias("dims"))


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN label + 100 ELSE label END AS label, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings UNION ALL SELECT vec_id + 1000000, label + 100, round(embedding[1]::DOUBLE, 6) FROM embeddings WHERE vec_id % 7 = 0")
def vector_upserts(spark, sf):
    from quarry.functions import vectors

    v = table(spark, sf, "embeddings")
    some = v.filter("vec_id % 7 = 0").withColumn("label", (F.col("label") + 100).cast(dict(v.dtypes)["label"]))
    new = some.unionByName(some.withColumn("vec_id", (F.col("vec_id") + 1_000_000).cast(dict(v.dtypes)["vec_id"])))
    d = v.select(F.size("embedding").alias("d")).first()
    out = vectors.upserted(v, new, d.d if d else 0, "vec_id", "embedding")
    return out.select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


_CHANGED = "SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'the keitung ' || lang ELSE text END AS text, lang FROM documents WHERE doc_id % 3 <> 1"


def _indexed(spark, sf):
    from uuid import uuid4

    from quarry.operators.index import SearchIndex
    from quarry.storage import shared_dir

    docs, held = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang"), SearchIndex(spark, f"{shared_dir(spark)}/index-{uuid4().hex}", keep=["lang"])
    held.put(docs)
    held.put(docs.filter("id % 5 = 0").withColumn("text", F.concat(F.lit("the keitung "), "lang")))
    held.remove(docs.filter("id % 3 = 1").select("id"))
    return held


@query(_bm25_sql(_CHANGED, {"text": 1}, "lang <> 'fr'", 50))
def index_search(spark, sf):
    """An index that documents were put into, put again and removed from, against the texts as they are then."""
    held = _indexed(spark, sf)
    langs = sorted(r[0] for r in held.documents().select("lang").distinct().collect() if r[0] not in (None, "fr"))
    out = None
    for lang in langs:  # a filter is an equality
        part = held.search(TERMS, where={"lang": lang}, limit=50)
        out = part if out is None else out.union(part)
    return out.orderBy(F.desc("score"), "id").limit(50) if out is not None else held.search(TERMS, limit=0)


@query(_bm25_sql(_CHANGED, {"text": 1}, "true", 50))
def index_compacted(spark, sf):
    held = _indexed(spark, sf)
    return held.compacted(f"{held.folder}-compacted").search(TERMS, limit=50)


@query(f"SELECT item_id, len({_TOK.format('text')}) AS n_tokens, 1 AS n_fields FROM benchmark")
def search_documents(spark, sf):
    from quarry.functions.text import fields_of_text, tokens

    fields = fields_of_text(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", F.size(tokens(fields["text"])).alias("n_tokens"), F.size(fields).alias("n_fields"))


# artifacts as a whole


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND starts_with('text/' || o_orderstatus, 'text/F') AND o_orderdate > TIMESTAMP '1993-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def artifact_query(spark, sf):
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.concat(F.lit("text/"), "o_orderstatus").alias("media_type"), F.col("o_orderdate").alias("created_at"))
    return o.filter(audit.query_predicate({"kind": "1-URGENT", "media_type_prefix": "text/F", "created_after": at("1993-01-01"), "created_before": at("1996-01-01")})).select("id")


def _ring(spark, sf) -> DataFrame:
    """Documents made of others: 100 after 100, and every 40th the other way round, which closes cycles."""
    d = table(spark, sf, "documents").select("doc_id")
    a = d.select(F.col("doc_id").alias("from"), (F.col("doc_id") + 1).alias("to")).filter("from % 100 < 30")
    b = d.filter("doc_id % 40 = 5").select(F.col("doc_id").alias("from"), (F.col("doc_id") - 3).alias("to"))
    return a.union(b).select(F.concat_ws("-", "from", "to").alias("id"), "from", "to")


_RING = """, e AS (SELECT doc_id || '-' || (doc_id + 1) AS id, doc_id AS f, doc_id + 1 AS t FROM documents WHERE doc_id % 100 < 30 UNION ALL SELECT doc_id || '-' || (doc_id - 3), doc_id, doc_id - 3 FROM documents WHERE doc_id % 40 = 5),
    p(a, b) AS (SELECT f, t FROM e UNION SELECT a, t FROM p JOIN e ON b = f), cyc AS (SELECT a AS n FROM p WHERE a = b),
    after AS (SELECT n FROM cyc UNION SELECT b FROM p JOIN cyc ON a = n), before AS (SELECT n FROM cyc UNION SELECT a FROM p JOIN cyc ON b = n),
    w AS (SELECT * FROM f UNION ALL SELECT 'lineage-missing-source', id FROM e WHERE f NOT IN (SELECT id FROM r) UNION ALL SELECT 'lineage-missing-result', id FROM e WHERE t NOT IN (SELECT id FROM r)
          UNION ALL SELECT 'lineage-cycle', id FROM e WHERE f IN (SELECT n FROM after) AND t IN (SELECT n FROM before)) """
_WHOLE = _AUDIT.replace("WITH r AS", "WITH RECURSIVE r AS", 1) + _RING


@query(_WHOLE + "SELECT * FROM w")
def audit_whole(spark, sf):
    return audit.audit(_records(spark, sf), _objects(spark, sf), _ring(spark, sf))


@query(_WHOLE + "SELECT code, false AS ok FROM w GROUP BY code")
def audit_valid(spark, sf):
    found = audit.audit(_records(spark, sf), _objects(spark, sf), _ring(spark, sf)).withColumn("severity", F.lit("error"))
    codes = [r[0] for r in found.select("code").distinct().collect()]  # of a fixed few
    out = None
    for code in codes:
        part = audit.valid(found.filter(F.col("code") == code)).select(F.lit(code).alias("code"), "ok")
        out = part if out is None else out.union(part)
    return out


@query(_WHOLE + ", left_ AS (SELECT 'records' AS what, count(*) AS n FROM r WHERE id::VARCHAR NOT IN (SELECT subject FROM w WHERE code = 'record-without-object') UNION ALL SELECT 'objects', count(*) FROM o WHERE key::VARCHAR NOT IN (SELECT subject FROM w WHERE code = 'object-without-record') UNION ALL SELECT 'edges', count(*) FROM e WHERE id NOT IN (SELECT subject FROM w WHERE code LIKE 'lineage%') UNION ALL SELECT 'applied', (SELECT count(*) FROM (SELECT DISTINCT code, subject FROM w)) UNION ALL SELECT 'stale', 1 UNION ALL SELECT 'object findings', 0) SELECT * FROM left_")
def audit_repaired(spark, sf):
    records, objects, edges = _records(spark, sf), _objects(spark, sf), _ring(spark, sf)
    plan = audit.repairs(audit.audit(records, objects, edges)).union(spark.createDataFrame([("gone", "delete-record-without-object", "record-without-object", "no such id")], "action_id string, operation string, code string, subject string"))
    records, objects, edges, receipts = audit.repaired(records, objects, edges, plan)
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    out = count(records, "records").union(count(objects, "objects")).union(count(edges, "edges")).union(count(audit.object_findings(records, objects), "object findings"))
    return out.union(count(receipts.filter("outcome = 'applied'"), "applied")).union(count(receipts.filter("outcome = 'stale'"), "stale"))


@query("SELECT l_partkey AS object_key, count(*) AS n, list(l_orderkey * 10 + l_linenumber ORDER BY l_orderkey * 10 + l_linenumber) AS ids FROM lineitem GROUP BY l_partkey")
def records_by_object(spark, sf):
    return audit.by_object(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("object_key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")))


@query("SELECT p_partkey AS id, ((row_number() OVER (ORDER BY p_size DESC, p_partkey DESC) - 1) // 40)::INTEGER AS page FROM part QUALIFY row_number() OVER (ORDER BY p_size DESC, p_partkey DESC) <= 120")
def cursor_walk(spark, sf):
    """Three pages, each from the cursor of the one before; a cursor of no row is refused."""
    p, rows, cursor = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("created_at")), [], None
    for n in range(3):
        got, cursor = audit.cursor_page(p, 40, cursor)
        rows += [(r["id"], n) for r in got]
        if cursor is None:
            break
    try:
        audit.cursor_page(p, 40, "7:nothing")
    except ValueError:
        return spark.createDataFrame(rows, f"id {dict(p.dtypes)['id']}, page int")
    raise AssertionError("a cursor of no row was taken")


@query("SELECT event_type AS name, count(*) AS n, round(sum(value), 3) AS total, round(max(value), 3) AS most FROM events GROUP BY event_type")
def harness_totals(spark, sf):
    each = table(spark, sf, "events").groupBy("event_type", F.pmod("user_id", F.lit(8)).alias("worker")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))
    return audit.merged(each, "event_type", sums=["n", "total"], most=["most"]).select(F.col("event_type").alias("name"), "n", F.round("total", 3).alias("total"), F.round("most", 3).alias("most"))


# names, fingerprints and documents


@query("SELECT DISTINCT 'nation' || ':' || c_nationkey AS ref, 'nation' AS type, c_nationkey::VARCHAR AS id FROM customer ORDER BY 1")
def reference_set(spark, sf):
    c = table(spark, sf, "customer")
    refs = c.select(names.format_ref(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("ref")).union(c.select(F.col("c_name").alias("ref"))).filter(names.is_ref(F.col("ref"))).distinct()
    return refs.select("ref", names.parse_ref(F.col("ref")).alias("p")).select("ref", "p.type", "p.id").orderBy("ref")


@query("SELECT p_partkey, url_encode(p_name || '/é?') AS component, regexp_replace('at /var/lib/' || p_partkey || '/x: ' || p_type, '/var/lib/[0-9]+/x', '<path>') AS shown FROM part")
def uris_and_paths(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", names.uri_component(F.concat("p_name", F.lit("/é?"))).alias("component"), names.redacted_path(F.concat(F.lit("at /var/lib/"), "p_partkey", F.lit("/x: "), "p_type")).alias("shown"))


@query("SELECT p_partkey, sha256('{\"brand\":\"' || p_brand || '\",\"kept\":{\"a\":null,\"b\":[1,true]},\"size\":' || p_size || '}') AS fingerprint FROM part")
def fingerprints(spark, sf):
    p = table(spark, sf, "part")
    text = F.concat(F.lit('{ "size": '), "p_size", F.lit(', "kept": {"b": [1, true], "a": null},  "brand": "'), "p_brand", F.lit('"}'))
    return p.select("p_partkey", doc.fingerprint(text).alias("fingerprint"))


@query("SELECT p_partkey, p_size <= 20 AS scalar_ok, p_size <= 21 AS empty_ok, p_size % 2 = 0 AS size_ok FROM part")
def json_bounds(spark, sf):
    n = F.col("p_size")
    nested = lambda inner: F.concat(F.repeat(F.lit('[{"a":["}"],"b":'), n), F.lit(inner), F.repeat(F.lit("}]"), n))
    deep = F.concat(F.repeat(F.lit("["), n), F.lit("1"), F.repeat(F.lit("]"), n))
    empty = F.concat(F.repeat(F.lit("["), n), F.repeat(F.lit("]"), n))
    return table(spark, sf, "part").select("p_partkey", doc.bounded(deep).alias("scalar_ok"), doc.bounded(empty).alias("empty_ok"), (doc.bounded(nested("1"), most_depth=1000) & doc.bounded(F.concat(F.lit('"'), F.repeat(F.lit("x"), 10 + n % 2), F.lit('"')), 12)).alias("size_ok"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN map {'by': o_clerk, 'state': o_orderstatus} ELSE map {'state': 'new', 'via': 'x'} END AS annotations FROM (SELECT o_orderkey, 'c' || o_custkey AS o_clerk, o_orderstatus FROM orders)")
def annotation_patches(spark, sf):
    own = F.create_map(F.lit("by"), F.concat(F.lit("c"), "o_custkey"), F.lit("state"), F.col("o_orderstatus"))
    patch = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("none"), F.lit(None).cast("string"))).otherwise(F.create_map(F.lit("state"), F.lit("new"), F.lit("by"), F.lit(None).cast("string"), F.lit("via"), F.lit("x")))
    return table(spark, sf, "orders").select("o_orderkey", doc.patched(own, patch).alias("annotations"))


# fixtures as a whole


def _fixture_documents(spark, sf) -> DataFrame:
    """Orders that name their customers, customers that name their nations (of which odd ones are missing), nations."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    make = lambda df, kind, key, to: df.select(F.concat(F.lit(f"{kind}:"), key).alias("ref"), to.alias("value"))
    to = lambda kind, key: F.concat(F.lit('{"of":{"$ref":"' + kind + ':'), key, F.lit('"}}'))
    return make(o, "order", "o_orderkey", to("customer", "o_custkey")).union(make(c, "customer", "c_custkey", to("nation", "c_nationkey"))).union(make(n.filter("n_nationkey % 2 = 0"), "nation", "n_nationkey", F.lit("{}")))


@query("SELECT 'order:' || o_orderkey AS ref, true AS resolved FROM orders UNION ALL SELECT 'customer:' || c_custkey, true FROM customer UNION ALL SELECT 'nation:' || n_nationkey, true FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT DISTINCT 'nation:' || c_nationkey, false FROM customer WHERE c_nationkey % 2 = 1 UNION ALL SELECT DISTINCT 'customer:' || o_custkey, false FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def reference_nodes(spark, sf):
    return fixtures.reference_graph(_fixture_documents(spark, sf))[0]


@query("SELECT 'customer:' || c_custkey AS ref, 'error' AS severity, 'missing-reference' AS code FROM customer WHERE c_nationkey % 2 = 1 UNION ALL SELECT 'order:' || o_orderkey, 'error', 'missing-reference' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def fixture_validation(spark, sf):
    layers = files.fixtures_from(_fixture_documents(spark, sf), "ref", "value", "base")
    return fixtures.validate(layers).select("ref", "severity", "code")


@query("SELECT 'order:' || o_orderkey AS ref, CASE WHEN c_custkey IS NULL THEN 0 WHEN c_nationkey % 2 = 0 THEN 2 ELSE 1 END AS level FROM orders LEFT JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'customer:' || c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 0 FROM nation WHERE n_nationkey % 2 = 0")
def material_levels(spark, sf):
    docs = _fixture_documents(spark, sf)
    return fixtures.material_order(fixtures.references(docs), docs)


@query("SELECT 'nation:' || n_nationkey AS ref, CASE WHEN n_nationkey % 3 = 0 THEN '{\"own\":1}' ELSE '{\"name\":\"' || n_name || '\"}' END AS value FROM nation")
def fixture_seeds(spark, sf):
    n = table(spark, sf, "nation")
    named = n.select(F.concat(F.lit("nation:"), "n_nationkey").alias("ref"), F.to_json(F.struct(F.col("n_name").alias("name"))).alias("value"))
    held = n.filter("n_nationkey % 3 = 0").select(F.concat(F.lit("nation:"), "n_nationkey").alias("ref"), F.lit('{"own":1}').alias("value"))
    return fixtures.seeded(held, files.fixtures_from(named, "ref", "value", "base"), lambda value: [] if "name" in value else ["no name"])


# files, copies and batches


def _new_folder(spark, name: str) -> str:
    from uuid import uuid4

    from quarry.storage import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


@query("SELECT 'n' || n_nationkey AS id, n_name AS name, 'About ' || n_name AS lead, 'It is in region ' || n_regionkey || '.' AS place FROM nation")
def markdown_round_trip(spark, sf):
    n, at = table(spark, sf, "nation"), _new_folder(spark, "markdown")
    body = F.concat(F.lit("About "), "n_name", F.lit("\n\n## Place\n\nIt is in region "), "n_regionkey", F.lit(".\n\n## Other\n\nx\n"))
    files.write_markdown(n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.to_json(F.struct(F.col("n_name").alias("name"))).alias("data"), body.alias("body")), at)
    got = files.markdown(spark, at, preamble_field="lead", sections={"place": ("Place", 2)})
    return got.select("id", *[F.get_json_object("data", f"$.{c}").alias(c) for c in ("name", "lead", "place")])


@query("SELECT r_regionkey || '/' || r_name AS object_key, strlen(CASE WHEN r_regionkey = 0 THEN 'again' ELSE r_name END) AS size FROM region WHERE r_regionkey <> 1")
def object_writes(spark, sf):
    at, rows = _new_folder(spark, "objects"), table(spark, sf, "region").collect()
    for r in rows:
        files.put_object(spark, at, f"{r.r_regionkey}/{r.r_name}", r.r_name.encode())
        assert not files.put_object(spark, at, f"{r.r_regionkey}/{r.r_name}", b"other", if_absent=True)
        if r.r_regionkey == 0:
            files.put_object(spark, at, f"{r.r_regionkey}/{r.r_name}", b"again")
        if r.r_regionkey == 1:
            assert files.delete_object(spark, at, f"{r.r_regionkey}/{r.r_name}")
    return files.objects(spark, at, content=False).select("object_key", "size")


@query("SELECT 'nation' AS name, n_nationkey::BIGINT AS key FROM nation UNION ALL SELECT 'region', r_regionkey FROM region")
def copied_tables(spark, sf):
    at, n, r = _new_folder(spark, "copies"), table(spark, sf, "nation"), table(spark, sf, "region")
    tables = [("nation", n.select(F.col("n_nationkey").alias("key"), F.col("n_nationkey").alias("ordinal"))), ("region", r.select(F.col("r_regionkey").alias("key"), F.col("r_regionkey").alias("ordinal")))]
    copies.copy_all(tables, f"{at}/out", f"{at}/ledger", batch_size=7)
    return spark.read.parquet(f"{at}/out/nation").select(F.lit("nation").alias("name"), F.col("key").cast("long")).union(spark.read.parquet(f"{at}/out/region").select(F.lit("region"), F.col("key").cast("long")))


@query("SELECT * FROM (VALUES ('another plan', 'refused'), ('no plan', 'refused'), ('same plan', '25'), ('unbound', 'refused'), ('bound', '25')) t(resume, outcome)")
def plan_bound_copies(spark, sf):
    at, n = _new_folder(spark, "plans"), table(spark, sf, "nation").withColumn("ordinal", F.col("n_nationkey"))
    plan = dict(schema="copy/v2", plan_digest="d1", source_identity="a", destination_identity="b")
    copies.copy(n.filter("ordinal < 10"), f"{at}/out", f"{at}/ledger", "nation", 5, plan=plan)
    copies.copy(n.filter("ordinal < 10"), f"{at}/old", f"{at}/old-ledger", "nation", 5)

    def tried(to: str, ledger: str, given: dict | None) -> str:
        try:
            return str(copies.copy(n, f"{at}/{to}", f"{at}/{ledger}", "nation", 5, plan=given))
        except ValueError:
            return "refused"

    rows = [("another plan", tried("out", "ledger", plan | {"plan_digest": "d2"})), ("no plan", tried("out", "ledger", None)), ("same plan", tried("out", "ledger", plan)), ("unbound", tried("old", "old-ledger", plan))]
    copies.bound(spark, f"{at}/old-ledger", plan, f"{at}/new-ledger")
    return spark.createDataFrame([*rows, ("bound", tried("old", "new-ledger", plan))], "resume string, outcome string")


@query("SELECT * FROM (VALUES (1, 'committed', NULL), (2, 'conflict', 'a'), (3, 'committed', NULL), (4, 'replayed', NULL), (5, 'idempotency-conflict', NULL), (6, 'committed', NULL)) t(step, outcome, key)")
def atomic_outcomes(spark, sf):
    """Batches over the names of regions; what is expected of keys decides them."""
    from quarry.operators.mutations import AtomicStore, Condition, Operation

    store, regions = AtomicStore(spark, _new_folder(spark, "atomic")), [r.r_name for r in table(spark, sf, "region").orderBy("r_regionkey").collect()]
    first = store.mutate([Condition("a", "missing")], [Operation("a", "set", regions[0]), Operation("b", "set", regions[1])], "k1")
    steps = [
        first, store.mutate([Condition("a", "missing"), Condition("b", "present")], [Operation("a", "set", 1)]), store.mutate([Condition("a", "version", first["version"])], [Operation("a", "set", regions[2])]),
        store.mutate([Condition("a", "missing")], [Operation("a", "set", regions[0]), Operation("b", "set", regions[1])], "k1"), store.mutate([], [Operation("a", "delete")], "k1"), store.mutate([Condition("b", "present")], [Operation("b", "delete")]),
    ]
    assert [r.key for r in store.state().collect()] == ["a"]
    return spark.createDataFrame([(n, x["outcome"], x.get("key")) for n, x in enumerate(steps, 1)], "step int, outcome string, key string")


@query("SELECT * FROM (VALUES ('b1', 'events', 'running', '{\"offset\":20}'), ('b2', 'events', 'completed', NULL)) t(backfill_id, source_name, status, cursor)")
def backfill_cursors(spark, sf):
    held = statements.Backfills(spark, _new_folder(spark, "backfills"))
    held.begin("b1", "events", {"offset": 10})
    held.begin("b2", "events")
    held.update("b1", "events", "running", {"offset": 20})
    held.update("b2", "events", "completed")
    assert held.get("b1")["cursor"] == {"offset": 20} and held.get("none") is None
    return held.states().drop("updated_at")
