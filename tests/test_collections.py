import pytest
from pyspark.sql import functions as F

from quarry.functions import documents, names, temporal, text, vectors
from quarry.operators import collections as c
from quarry.operators.collections import Filter


def ids(df):
    return [r.id for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("1", '{"x": null, "n": 1, "a.b": 1}'), ("2", '{"n": true, "a": {"b": 1}}'), ("3", '{"x": 5, "n": 1.0, "o": {"q": 1, "p": [1, 2]}}'), ("4", '{"n": "1", "x\') OR 1=1 --": 1}')]
    return spark.createDataFrame([(i, d, k) for k, (i, d) in enumerate(rows)], "id string, d string, ordinal int").withColumn("data", F.parse_json("d")).drop("d")


def test_null_is_not_missing(docs):
    assert ids(c.list_records(docs, Filter({"x": None}), data="data")) == ["1"]


def test_equality_is_strict_about_types(docs):
    assert ids(c.list_records(docs, Filter({"n": 1}), data="data")) == ["1", "3"]
    assert ids(c.list_records(docs, Filter({"n": True}), data="data")) == ["2"]
    assert ids(c.list_records(docs, Filter({"n": "1"}), data="data")) == ["4"]


def test_keys_are_literal(docs):
    assert ids(c.list_records(docs, Filter({"a.b": 1}), data="data")) == ["1"]
    assert ids(c.list_records(docs, Filter({"x') OR 1=1 --": 1}), data="data")) == ["4"]


def test_deep_equality_ignores_key_order(docs):
    assert ids(c.list_records(docs, Filter({"o": {"p": [1, 2], "q": 1}}), data="data")) == ["3"]


def test_nulls_sort_last_both_ways(spark):
    df = spark.createDataFrame([("1", 2, 0), ("2", None, 1), ("3", 1, 2)], "id string, n int, ordinal int")
    assert ids(c.list_records(df, Filter(sort_by="n"))) == ["3", "1", "2"]
    assert ids(c.list_records(df, Filter(sort_by="n", descending=True))) == ["1", "3", "2"]
    pages = [ids(c.list_records(df, Filter(sort_by="n", offset=k, limit=1))) for k in range(3)]
    assert sum(pages, []) == ["3", "1", "2"]
    assert c.count_records(df, Filter(limit=1)).first().n == 3


def test_typed_columns(spark):
    df = spark.createDataFrame([("1", True), ("2", False), ("3", None)], "id string, p boolean")
    assert ids(c.list_records(df, Filter({"p": True}))) == ["1"]
    assert ids(c.list_records(df, Filter({"p": 1}))) == []
    assert ids(c.list_records(df, Filter({"p": None}))) == ["3"]
    assert ids(c.list_where_in(df, "p", [False, None])) == ["2", "3"]
    assert ids(c.list_where_in(df, "p", [])) == []


def test_long_lists_join(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("id"), F.col("id").alias("ordinal"))
    assert ids(c.list_where_in(df, "id", [str(k) for k in range(0, 20, 2)], most_literals=3)) == [str(k) for k in range(0, 20, 2)]


@pytest.mark.parametrize("bad", [{"limit": -1}, {"offset": -1}, {"limit": 1.5}, {"limit": True}])
def test_bad_pages(bad):
    with pytest.raises(ValueError):
        Filter(**bad)


def test_prefix_is_literal(spark):
    df = spark.createDataFrame([("a_b", 1), ("axb", 2), ("a_c", 3), ("A_d", 4)], "key string, value int")
    assert [r.key for r in c.keys(df, "a_").collect()] == ["a_b", "a_c"]
    assert c.has(df, "axb").first().found and not c.has(df, "zz").first().found


def test_names(spark):
    one = spark.createDataFrame([("theme:dark", "a b/ü", "é/x y")], "r string, n string, u string")
    row = one.select(names.parse_ref(F.col("r")).alias("p"), names.is_ref(F.col("n")).alias("q"), names.url_safe(F.col("n")).alias("b"), names.uri_component(F.col("u")).alias("u"), names.redacted_path(F.lit("at /home/me/x.json now")).alias("h")).first()
    assert (row.p.type, row.p.id, row.q) == ("theme", "dark", False)
    assert row.b == "YSBiL8O8" and row.u == "%C3%A9%2Fx%20y" and row.h == "at <path> now"
    assert names.fnv1a("") == "ztntfp" and names.canonical({"b": 1, "a": [None, "é"]}) == '{"a":[null,"é"],"b":1}'
    with pytest.raises(ValueError):
        names.canonical(float("nan"))


def test_tokens(spark):
    one = spark.createDataFrame([("Café, don't 42!",), (None,)], "t string")
    assert [r.t for r in one.select(text.tokens(F.col("t")).alias("t")).collect()] == [["café", "don", "t", "42"], []]
    with pytest.raises(ValueError):
        text.field_weights(["a"], {"b": 1})
    with pytest.raises(ValueError):
        text.field_weights(["a"], {"a": -1})


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), (None,)], "v array<double>")
    assert [r.u for r in df.select(vectors.usable(F.col("v")).alias("u")).collect()] == [True, False, False, False]
    with pytest.raises(Exception, match="expected 3 dimensions"):
        df.limit(1).select(vectors.checked(F.col("v"), 3)).collect()


def test_temporal(spark):
    bound = "struct<kind string, at string, anchorId string>"
    df = spark.createDataFrame([(("instant", "1900", None),), (("before", None, "x"),), (("unknown", None, None),), (None,)], f"b {bound}")
    assert [r.k for r in df.select(temporal.bound_key(F.col("b"), "9")).toDF("k").collect()] == ["instant:1900", "before:x", "instant:9", "instant:9"]
    s = spark.createDataFrame([("proposed", "rejected"), ("accepted", "superseded"), ("accepted", "proposed"), ("retracted", "accepted")], "a string, b string")
    assert [r.k for r in s.select(temporal.may_change(F.col("a"), F.col("b"))).toDF("k").collect()] == [True, True, False, False]


def test_annotations(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"})], "m map<string,string>, p map<string,string>")
    assert df.select(documents.patched(F.col("m"), F.col("p")).alias("m")).first().m == {"a": "1", "c": "3"}
