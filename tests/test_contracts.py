"""What the operators promise beyond the queries of the catalogue."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from quarry.functions import documents as doc
from quarry.functions import vectors
from quarry.operators import audit, collections, fixtures, index, search
from quarry.sources import files
from quarry.streaming import copies


@pytest.fixture(scope="module")
def kinds(spark):
    rows = [(1, True, "1", 1.0, datetime.date(2024, 1, 2)), (2, False, "x", 2.5, datetime.date(2024, 1, 3)), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "i int, b boolean, s string, d double, day date").withColumns({"dec": F.col("d").cast("decimal(10,2)"), "bin": F.col("s").cast("binary"), "arr": F.array("i")})


VALUES = [1, 2.5, 1.0, True, "1", "x", "2024-01-02", "no day", None, 2**70, float("nan"), float("inf"), datetime.date(2024, 1, 3), b"x", [1], {"a": 1}]
WANT = {"i": {1}, "b": {True}, "s": {"1", "x", "2024-01-02"}, "d": {1.0, 2.5}, "day": {datetime.date(2024, 1, 2), datetime.date(2024, 1, 3)}}


@pytest.mark.parametrize("column", ["i", "b", "s", "d", "day", "dec", "bin", "arr"])
@pytest.mark.parametrize("literals", [1000, 0])
def test_values_of_any_kind_raise_nothing(kinds, column, literals):
    hashable = [v for v in VALUES if not isinstance(v, (list, dict))]
    got = collections.list_where_in(kinds, column, hashable, most_literals=literals).select(column).collect()
    assert any(r[0] is None for r in got) or column == "arr"
    if column in WANT:
        assert {r[0] for r in got if r[0] is not None} == WANT[column] & {r[0] for r in kinds.select(column).collect()}
    for v in VALUES:
        collections.list_records(kinds, collections.Filter({column: v})).collect()
    assert collections.list_where_in(kinds, column, []).count() == 0


@pytest.mark.parametrize("literals", [1000, 0])
def test_values_within_documents(spark, literals):
    rows = [(1, '{"k": 1}'), (2, '{"k": "1"}'), (3, '{"k": null}'), (4, "{}"), (5, '{"k": {"b": 2, "a": [1, null]}}'), (6, '{"k": true}'), (7, None)]
    df = spark.createDataFrame(rows, "id int, j string").select("id", F.parse_json("j").alias("data"))
    ids = lambda values: sorted(r.id for r in collections.list_where_in(df, "k", values, data="data", most_literals=literals).collect())
    assert ids([1]) == [1] and ids(["1", True]) == [2, 6] and ids([None]) == [3] and ids([{"a": [1, None], "b": 2}, None]) == [3, 5] and ids([]) == []


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_cuts_each_text_once(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(search, "written", lambda df: seen.append(df) or df.sparkSession.createDataFrame(df.collect(), df.schema))
    search.bm25(spark.read.parquet(f"{sf}/documents.parquet"), "one two three four", id_="doc_id").collect()
    (cut,) = seen
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_batches_of_queries_need_no_join(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    one, many = (search.knn_batch(v, q, 4, "vec_id", "embedding", group_bytes=g) for g in (1 << 30, 20_000))
    assert "Join" not in plan(one) and "Cartesian" not in plan(one)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    named = v.select(F.concat(F.lit("v"), "vec_id").alias("id"), F.col("embedding").alias("vector")).limit(40)
    got = search.knn_batch(named, named.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), 3).filter("rank = 1").collect()
    assert len(got) == 40 and all(r.query_id == r.id and r.score == 1.0 for r in got)
    assert search.knn_batch(v, q.limit(0), 4, "vec_id", "embedding").count() == 0 and search.knn_batch(v.limit(0), q, 4, "vec_id", "embedding").count() == 0


def test_index_reads_only_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word{k % 7} shared text{k}") for k in range(60)], "id int, text string")
    held = index.SearchIndex(spark, f"file://{tmp_path}/index", buckets=16)
    with pytest.raises(ValueError):
        held.documents()
    held.put(docs)
    found = held.search("word3 text17", limit=None)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, search.bm25(docs, "word3 text17", limit=None).collect()))
    assert "PushedFilters: [In(term" in plan(found).replace("IsNotNull(term), ", "") and "PartitionFilters: [bucket" in plan(found)
    with pytest.raises(ValueError):
        held.put(docs.union(docs))
    held.remove(docs.filter("id < 50"))
    assert sorted(map(tuple, held.search("word3 shared", limit=None).collect())) == sorted(map(tuple, search.bm25(docs.filter("id >= 50"), "word3 shared", limit=None).collect()))
    # a segment that wasn't finished isn't there
    (tmp_path / "index" / "docs" / "segment=3").mkdir()
    assert held.segments() == [1, 2] and held.documents().count() == 10
    assert held.search("!!", limit=None).count() == 0


def test_cursors(spark):
    df = spark.createDataFrame([(k, k // 3) for k in range(10)], "id int, created_at int")
    rows, cursor = audit.cursor_page(df, 4)
    assert [r["id"] for r in rows] == [9, 8, 7, 6] and cursor == "2:6"
    rows, cursor = audit.cursor_page(df, 6, cursor)
    assert [r["id"] for r in rows] == [5, 4, 3, 2, 1, 0] and cursor is None
    for bad in ("2:99", "x", "2"):
        with pytest.raises(ValueError, match="invalid artifact cursor"):
            audit.cursor_page(df, 4, bad)


def test_json_bounds(spark):
    cases = [('{"a":[1,{"b":"]]]]"}]}', 3), ("7", 0), ("[]", 0), ("[[]]", 1), ('["\\\\"]', 1), ('{"a" : { } }', 1)]
    got = [r[0] for r in spark.createDataFrame([(t, d) for t, d in cases], "t string, d int").select(doc.depth(F.col("t"))).collect()]
    assert got == [d for _, d in cases]
    row = spark.range(1).select(doc.bounded(F.lit("{")).alias("a"), doc.bounded(F.lit(None).cast("string")).alias("b"), doc.bounded(F.lit('"xx"'), 3).alias("c")).first()
    assert tuple(row) == (False, False, False)


def test_vectors_are_put_in_whole_or_not_at_all(spark):
    have = spark.createDataFrame([(1, [1.0, 0.0])], "id int, vector array<double>")
    for rows in ([(2, [1.0])], [(2, None)], [(2, [1.0, 1.0]), (2, [0.0, 1.0])]):
        with pytest.raises(ValueError):
            vectors.upserted(have, spark.createDataFrame(rows, have.schema), 2)
    assert sorted(r.id for r in vectors.upserted(have, spark.createDataFrame([(1, [0.0, 1.0]), (3, [0.0, 1.0])], have.schema), 2).collect()) == [1, 3]


def test_seeds_are_all_or_nothing(spark):
    have = spark.createDataFrame([("a:1", "{}")], "ref string, value string")
    layers = spark.createDataFrame([("a:2", 0, 0, "p", '{"x": {"$ref": "a:9"}}'), ("a:3", 0, 0, "q", "{}")], "ref string, priority int, ord int, path string, doc string")
    with pytest.raises(ValueError, match="a:9"):
        fixtures.seeded(have, layers)
    assert sorted(r.ref for r in fixtures.seeded(have, layers.filter("ref = 'a:3'")).collect()) == ["a:1", "a:3"]
    loaded = fixtures.layered(layers)
    assert fixtures.resolved(loaded, "a:3") == {}
    with pytest.raises(KeyError):
        fixtures.resolved(loaded, "a:7")


def test_plans_must_be_whole(spark, tmp_path):
    with pytest.raises(ValueError):
        copies.plan_text({"schema": "x"})
    with pytest.raises(ValueError):
        copies.bound(spark, f"file://{tmp_path}/none", dict.fromkeys(copies.PLAN, "x"), f"file://{tmp_path}/to")


def test_fixture_files(spark, tmp_path):
    (tmp_path / "f" / "maps").mkdir(parents=True)
    (tmp_path / "f" / "maps" / "a.json").write_text('{"n": 1}')
    (tmp_path / "f" / "maps" / "b.csv").write_text("x,1")
    (tmp_path / "f" / "maps" / "c.txt").write_text("no")
    parse = lambda text: dict([text.split(",")])
    got = {r.ref: r.doc for r in files.fixtures(spark, f"file://{tmp_path}/f", {"maps": "map"}, "s", parsers={".csv": parse}).collect()}
    assert got == {"map:a": '{"n": 1}', "map:b": '{"x": "1"}'}
    (tmp_path / "secret.json").write_text("{}")
    os.symlink(tmp_path / "secret.json", tmp_path / "f" / "maps" / "d.json")
    with pytest.raises(ValueError, match="leads out"):
        files.fixtures(spark, f"file://{tmp_path}/f", {"maps": "map"}, "s")


def test_object_keys(spark, tmp_path):
    at = f"file://{tmp_path}/o"
    for bad in ("", "/x", "a/../b", "a//b", "."):
        with pytest.raises(ValueError):
            files.put_object(spark, at, bad, b"")
    assert files.put_object(spark, at, "a/b", b"1", if_absent=True) and not files.put_object(spark, at, "a/b", b"2", if_absent=True)
    assert files.put_object(spark, at, "a/b", b"3") and [bytes(r.content) for r in files.objects(spark, at).collect()] == [b"3"]
    assert files.delete_object(spark, at, "a/b") and not files.delete_object(spark, at, "a/b")


def test_lineage_is_shuffled_once_for_distinct_edges_and_their_sources(spark, sf):
    from quarry.plans.catalogue import QUERIES

    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        shown = QUERIES["audit_lineage"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert shown.count("Exchange hashpartitioning(") <= 5
