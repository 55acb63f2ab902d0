import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import audit, fixtures, graph, mutations, search, statements
from quarry.operators.mutations import AtomicStore, Condition, Operation

EDGES = [("1", "a", "b", "x", True), ("2", "b", "c", "x", True), ("3", "c", "a", "y", True), ("4", "a", "d", "y", False), ("5", "d", "e", "x", True), ("6", "b", "b", "x", True)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "id string, `from` string, `to` string, type string, published boolean").coalesce(1)


def walked(edges, start, depth, direction):
    """What a plain walk gives."""
    seen, frontier, nodes, used = {start}, [start], set(), set()
    hop = 0
    while hop < depth and frontier and math.isfinite(depth):
        nearby = []
        for at in frontier:
            for i, a, b, *_ in edges:
                for near, far in ((a, b), (b, a)) if direction == "both" else ((a, b),) if direction == "out" else ((b, a),):
                    if near == at:
                        used.add(i)
                        if far not in seen:
                            seen.add(far)
                            nodes.add(far)
                            nearby.append(far)
        frontier, hop = nearby, hop + 1
    return sorted(nodes), sorted(used)


@pytest.mark.parametrize(("start", "depth", "direction"), [("a", 1, "out"), ("a", 2, "both"), ("b", 3, "in"), ("a", 1.5, "out"), ("a", 0, "out"), ("a", float("nan"), "out"), ("z", 2, "both")])
def test_traverse(edges, start, depth, direction):
    nodes, used = graph.traverse(edges, start, depth, direction)
    assert ([r.node for r in nodes.collect()], [r.id for r in used.collect()]) == walked(EDGES, start, depth, direction)


def test_policy(edges):
    nodes, _ = graph.traverse(edges, "a", 3, "out", where={"published": True})
    assert [r.node for r in nodes.collect()] == ["b", "c"]
    assert {r.id for r in graph.neighbors(edges, "b", "both", ["x"]).collect()} == {"1", "2", "6"}
    assert {r.id for r in graph.neighbors(edges, "b", "out", where={"from": "zz"}).collect()} == {"2", "6"}


def test_reach_and_cycles(edges):
    assert graph.reaches(edges, "a", "e") and not graph.reaches(edges, "e", "a")
    assert {r.id for r in graph.cycle_edges(edges).collect()} == {"1", "2", "3", "6"}
    assert graph.cycle_edges(edges.filter("id in ('4', '5')")).count() == 0


VECTORS = [("d1", [1, 0, 0, 0], "document"), ("d2", [0.9, 0.1, 0, 0], "document"), ("n1", [0.99, 0.01, 0, 0], "note"), ("z", [0, 0, 0, 0], "document"), ("m", [0, 1, 0, 0], None)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, [float(x) for x in v], None if t is None else json.dumps({"type": t})) for i, v, t in VECTORS], "id string, vector array<double>, m string").withColumn("metadata", F.try_parse_json("m")).drop("m")


def test_filters_come_before_the_ranking(vectors):
    found = lambda **k: [r.id for r in search.knn(vectors, [1, 0, 0, 0], 2, metadata="metadata", **k).collect()]
    assert found() == ["d1", "n1"]
    assert found(where={"type": "document"}) == ["d1", "d2"]
    assert found(where_not={"type": "document"}) == ["n1", "m"]
    assert found(where={}) == ["d1", "n1"] and found(where_not={}) == ["m"]
    assert found(min_score=0.995) == ["d1", "n1"]


def test_query_without_direction(vectors):
    assert [(r.id, r.score) for r in search.knn(vectors, [0, 0, 0, 0], 3).collect()] == [("d1", 0.0), ("d2", 0.0), ("m", 0.0)]


def test_knn_batch(spark, vectors):
    q = spark.createDataFrame([("q1", [1.0, 0.0, 0.0, 0.0]), ("q2", [0.0, 1.0, 0.0, 0.0])], "query_id string, query_vector array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in search.knn_batch(vectors, q, 2).collect()}
    assert got == {("q1", 1): "d1", ("q1", 2): "n1", ("q2", 1): "m", ("q2", 2): "d2"}
    assert search.knn_batch(vectors, q.limit(0), 2).count() == 0


def plain_bm25(docs, query, weights):
    cut = {i: {f: t.lower().split() for f, t in d.items()} for i, d in docs.items()}
    n = len(cut)
    dl = {i: sum(map(len, d.values())) for i, d in cut.items()}
    out = {}
    for i, d in cut.items():
        score, hit = 0.0, False
        for t in query.split():
            df = sum(any(t in x for x in e.values()) for e in cut.values())
            wtf = sum(weights[f] * d[f].count(t) for f in d)
            if wtf:
                hit, idf = True, math.log((n - df + 0.5) / (df + 0.5))
                score += max(0, idf) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * dl[i] / (sum(dl.values()) / n)))
        if hit:
            out[i] = round(score, 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_bm25(spark):
    r = random.Random(3)
    docs = {f"d{k}": {f: " ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.randint(0, 9))) for f in ("title", "body")} for k in range(30)}
    df = spark.createDataFrame([(i, d["title"], d["body"]) for i, d in docs.items()], "id string, title string, body string")
    for weights in ({"title": 5.0, "body": 1.0}, {"title": 0.0, "body": 2.0}):
        got = [(x.id, x.score) for x in search.bm25(df, "ax by ax cz", ["title", "body"], weights, limit=None).collect()]
        want = plain_bm25(docs, "ax by ax cz", weights)
        assert [i for i, _ in got] == [i for i, _ in want]
        assert [x for _, x in got] == pytest.approx([x for _, x in want], abs=2e-6)
    assert search.bm25(df, "...", ["title"]).count() == 0


def test_layers(spark):
    rows = [
        ("theme:dark", 0, 0, "base/dark", {"name": "dark", "colors": {"background": "black", "foreground": "white"}}),
        ("theme:dark", 10, 0, "app/dark", {"$patch": "theme:dark", "colors": {"accent": "purple"}}),
        ("theme:lost", 0, 0, "base/lost", {"$patch": "theme:lost", "x": 1}),
        ("theme:new", 0, 0, "base/new", {"$patch": "theme:new", "a": 1}), ("theme:new", 5, 0, "app/new", {"b": "theme:none"}), ("theme:new", 5, 1, "app/new2", {"$patch": "theme:new", "c": 1}),
    ]
    df = spark.createDataFrame([(*r[:4], json.dumps(r[4])) for r in rows], "ref string, priority int, ord int, path string, doc string")
    got = {r.ref: r for r in fixtures.layered(df).collect()}
    assert json.loads(got["theme:dark"].value) == {"name": "dark", "colors": {"background": "black", "foreground": "white", "accent": "purple"}}
    assert [p.kind for p in got["theme:dark"].provenance] == ["base", "patch"]
    assert got["theme:lost"].error == "patch-without-base"
    assert [p.kind for p in got["theme:new"].provenance] == ["shadowed", "base", "shadowed"]
    bad = {(r.ref, r.code) for r in fixtures.validate(df, lambda d: ["no name"] if "name" not in d else [], bare=True).collect()}
    assert bad == {("theme:lost", "patch-without-base"), ("theme:new", "schema"), ("theme:new", "missing-reference")}


def test_references(spark):
    df = spark.createDataFrame([("a:1", json.dumps({"x": {"$ref": "b:1"}, "y": ["c:1", "no ref"], "z": "a:1"})), ("b:1", "{}")], "ref string, value string")
    assert {(r["from"], r["to"], ".".join(r.field_path)) for r in fixtures.references(df).collect()} == {("a:1", "b:1", "x"), ("a:1", "c:1", "y.0"), ("a:1", "a:1", "z")}
    assert {r["to"] for r in fixtures.references(df, bare=False).collect()} == {"b:1"}
    nodes, edges = fixtures.reference_graph(df)
    text = fixtures.to_dot(nodes, edges)
    assert '"c:1" [label="c:1", style=dashed];' in text and '"a:1" -> "c:1" [label="y.0"];' in text
    order = {r.ref: r.level for r in fixtures.material_order(fixtures.references(df, bare=False), df).collect()}
    assert order == {"b:1": 0, "a:1": 1}


@pytest.mark.parametrize(("strategy", "want"), [("replace", {"b": 2}), ("array-replace", {"a": 1, "b": 2, "o": {"p": 1}}), ("deep", {"a": 1, "b": 2, "o": {"p": 1}}), (lambda a, b: [a, b], None)])
def test_merge(strategy, want):
    a, b = {"a": 1, "b": 1, "o": {"p": 1}}, {"b": 2}
    assert fixtures.merge(a, b, strategy) == (want or [a, b])


def test_atomic(spark, tmp_path):
    store = AtomicStore(spark, f"file://{tmp_path}/store")
    assert store.mutate([Condition("a", "missing")], [Operation("a", "set", {"n": 1})], "k1")["outcome"] == "committed"
    assert store.mutate([Condition("a", "missing")], [Operation("a", "set", {"n": 1})], "k1")["outcome"] == "replayed"
    assert store.mutate([], [Operation("a", "set", 2)], "k1")["outcome"] == "idempotency-conflict"
    assert store.mutate([Condition("b", "present"), Condition("a", "version", "v9")], [], "k2") == {"outcome": "conflict", "key": "a"}
    assert store.mutate([Condition("a", "version", "v1")], [Operation("a", "delete"), Operation("b", "set", 5)])["outcome"] == "committed"
    assert [(r.key, r.value, r.version) for r in store.state().collect()] == [("b", "5", "v2")]
    with pytest.raises(ValueError):
        store.mutate([], [Operation("a", "set", 1), Operation("a", "set", 2)])


def test_audit(spark):
    records = spark.createDataFrame([(1, 1, 5, "x"), (2, 2, 5, "x"), (3, 3, 5, "x"), (4, 9, None, None)], "id long, object_key long, size long, digest string")
    objects = spark.createDataFrame([(1, 5, "x"), (2, 6, "y"), (7, 1, "z"), (9, None, None)], "object_key long, size long, digest string")
    edges = spark.createDataFrame([("e1", 1, 2), ("e2", 2, 1), ("e3", 8, 1), ("e4", 3, 8)], "id string, `from` long, `to` long")
    got = [(r.code, r.subject) for r in audit.audit(records, objects, edges).collect()]
    assert got == [("digest-mismatch", "2"), ("lineage-cycle", "e1"), ("lineage-cycle", "e2"), ("lineage-missing-result", "e4"), ("lineage-missing-source", "e3"), ("object-without-record", "7"), ("record-without-object", "3"), ("size-mismatch", "2")]
    assert audit.repairs(audit.audit(records, objects, edges)).count() == 8


def test_artifact_query(spark):
    rows = [("a", "image/png", "k", 10, ("s", "j", None, None)), ("b", "image/gif", "k", 20, ("s", "i", None, None)), ("c", "text/plain", "k", 30, None)]
    df = spark.createDataFrame(rows, "id string, media_type string, kind string, created_at long, producer struct<system string, job_id string, attempt_id string, output_slot string>")
    found = lambda **q: [r.id for r in df.filter(audit.query_predicate(q)).orderBy("id").collect()]
    assert found(media_type_prefix="image/") == ["a", "b"] and found(producer_job_id="i") == ["b"] and found(created_after=10, created_before=30) == ["b"]
    first = audit.page(df, 2).collect()
    assert [r.id for r in first] == ["c", "b"] and [r.id for r in audit.page(df, 2, (first[-1].created_at, first[-1].id)).collect()] == ["a"]


def test_admission(spark):
    heads = spark.createDataFrame([("s1", 2, "accepted"), ("s2", 1, "retracted"), ("s3", 1, "proposed")], "statement_id string, revision int, status string")
    ask = lambda s, op, k, exp=None, want="accepted", src="user", model=False, by=None: (s, op, k, f"f{k}", exp, want, src, model, by)
    rows = [ask("s0", "admit", "1"), ask("s0b", "admit", "2", model=True), ask("s1", "admit", "3"), ask("s1", "revise", "4", 1), ask("s1", "revise", "5", 2, "superseded"), ask("s1", "revise", "6", 2, "superseded", by="s9"), ask("s2", "revise", "7", 1), ask("s4", "retract", "8", 1), ask("s3", "retract", "9", 1), ask("s3", "revise", "10", 1), ask("s1", "revise", "11", 2, "rejected")]
    requests = spark.createDataFrame(rows, "statement_id string, operation string, idempotency_key string, fingerprint string, expected_revision int, decided_status string, source string, model_involved boolean, superseded_by string")
    receipts = spark.createDataFrame([("10", "other"), ("9", "f9")], "idempotency_key string, fingerprint string")
    got = {r.idempotency_key: (r.outcome, r.reason, r.revision, r.status) for r in statements.admit(heads, requests, receipts).collect()}
    assert got["1"] == ("committed", None, 1, "accepted") and got["2"] == ("committed", None, 1, "proposed")
    assert [got[str(k)][1] for k in (3, 4, 5, 7, 8, 10, 11)] == ["head-exists", "expected-revision-mismatch", "superseded-requires-reference", "terminal-head", "missing-head", "idempotency-conflict", "invalid-transition"]
    assert got["6"] == ("committed", None, 3, "superseded") and got["9"][0] == "replayed"


def test_latest_keeps_places(spark):
    log = spark.createDataFrame([("a", 1, 1, False), ("b", 1, 2, False), ("a", 2, 3, False), ("b", None, 4, True), ("b", 3, 5, False), ("c", 1, 6, False), ("c", None, 7, True)], "key string, value int, seq int, gone boolean")
    assert [(r.key, r.value, r.ordinal) for r in mutations.latest(log, deleted="gone").orderBy("ordinal").collect()] == [("a", 2, 1), ("b", 3, 5)]


def test_layers_that_go_on_in_the_next_batch(spark):
    """Layers are folded in a stream of sorted rows, not by a call for each document."""
    from quarry.operators import fixtures

    rows = [(f"a:{k}", p, p % 2, f"p{p}", f'{{"v":{{"n{p}":{p}}}}}' if p == 0 else f'{{"$patch":"a:{k}","v":{{"n{p}":{p}}}}}') for k in range(20) for p in range(7)]
    rows += [("a:alone", 0, 0, "p", '{"$patch":"a:alone"}'), ("a:broken", 0, 0, "p", "{"), ("a:none", None, 0, "p", "{}")]
    layers = spark.createDataFrame(rows, "ref string, priority int, ord int, path string, doc string").repartition(5)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        out = fixtures.layered(layers)
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
        got = {r.ref: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == 23
    for k in range(20):
        r = got[f"a:{k}"]
        assert r.value == '{"v":{' + ",".join(f'"n{p}":{p}' for p in range(7)) + "}}" and r.error is None
        assert [(s.path, s.kind) for s in r.provenance] == [("p0", "base"), *((f"p{p}", "patch") for p in range(1, 7))]
    assert got["a:alone"].error == "patch-without-base" and got["a:broken"].error.startswith("parse: ") and got["a:none"].error.startswith("parse: ")


def test_validation_folds_each_document_once(spark, tmp_path):
    from quarry.operators import fixtures

    at = str(tmp_path / "merges")

    def merge(old, new):
        with open(at, "a") as f:
            f.write("x\n")
        return old | new

    rows = [(f"a:{k}", p, 0, f"p{p}", '{"to":{"$ref":"a:99"}}' if p == 0 else f'{{"$patch":"a:{k}"}}') for k in range(5) for p in range(2)]
    layers = spark.createDataFrame(rows, "ref string, priority int, ord int, path string, doc string")
    found = fixtures.validate(layers, check=lambda value: ["bad"], strategy=merge).collect()
    assert [(r.ref, r.code) for r in found] == [(f"a:{k}", c) for k in range(5) for c in ("missing-reference", "schema")]
    assert open(at).read().count("x") == 5


def test_index_counts_words_where_they_are_read(spark, tmp_path, monkeypatch):
    """Two fields, repeats, nulls, a term dealt to several tasks; what is alive is found out once for each state."""
    from quarry.operators import index

    monkeypatch.setattr(index, "PART", 1, raising=False)
    docs = spark.createDataFrame([(1, "a b a", "b"), (2, None, "a"), (3, "", ""), (4, "c c", None), (5, "b", "x")], "id long, t string, u string")
    held = index.SearchIndex(spark, f"file://{tmp_path}/i", ["t", "u"], buckets=2)
    held.put(docs)
    got = {(r.id, r.term, r.tf0, r.tf1, r.dl) for r in spark.read.parquet(f"{held.folder}/postings/segment=1").collect()}
    assert got == {(1, "a", 2, 0, 4), (1, "b", 1, 1, 4), (2, "a", 0, 1, 1), (4, "c", 2, 0, 2), (5, "b", 1, 0, 2), (5, "x", 0, 1, 2)}
    held.put(docs.filter("id = 4").withColumn("t", F.lit("a")))
    held.remove(docs.filter("id = 5"))
    assert held.documents() is held.documents()
    now = docs.filter("id < 5").withColumn("t", F.when(F.col("id") == 4, "a").otherwise(F.col("t")))
    want = [tuple(r) for r in search.bm25(now, "a b", ["t", "u"], limit=None).collect()]
    assert [tuple(r) for r in held.search("a b", limit=None).collect()] == want
    assert [tuple(r) for r in held.compacted(f"file://{tmp_path}/j").search("a b", limit=None).collect()] == want


@pytest.mark.parametrize("k", [0, 1, 5, 40, 50])
def test_the_first_of_scores_with_ties(k):
    import numpy as np

    near = np.round(np.random.default_rng(1).integers(-9, 9, (30, 40)) / 9, 6)
    assert (search._first(near, k) == np.argsort(-near, axis=1, kind="stable")[:, :k]).all()
