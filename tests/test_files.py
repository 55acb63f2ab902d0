import json

import pytest
from pyspark.sql import functions as F

from quarry.sources import files
from quarry.streaming import copies

NOTE = """---
id: n1
title: "A title"
tags: [x, y]
flag: true
---
Before.

## Summary
First.

### Part
Deeper.

## Other
Second.
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/b.md").write_text(NOTE)
    (tmp_path / "notes/a.md").write_text("---\nid: a0\n---\nOnly text.\n")
    (tmp_path / "fx/themes").mkdir(parents=True)
    (tmp_path / "fx/themes/dark.json").write_text('{"name": "dark"}')
    return tmp_path


def test_markdown(spark, folder):
    got = files.markdown(spark, f"file://{folder}/notes", "body", "preamble", {"summary": ("Summary", 2), "none": ("Nothing", 2)}).collect()
    assert [r.id for r in got] == ["a0", "n1"]
    data = json.loads(got[1].data)
    assert data["title"] == "A title" and data["tags"] == ["x", "y"] and data["flag"] is True
    assert data["preamble"] == "Before." and data["summary"] == "First.\n\n### Part\nDeeper." and data["none"] == ""
    assert json.loads(got[0].data)["body"] == "Only text."
    assert files.index(spark.createDataFrame([(r.id,) for r in got], "id string"), F.concat(F.lit("- "), "id"), "Notes").first().text == "# Notes\n\n- a0\n- n1"


def test_markdown_needs_an_id(spark, tmp_path):
    (tmp_path / "x.md").write_text("no head")
    with pytest.raises(Exception, match="non-empty string id"):
        files.markdown(spark, f"file://{tmp_path}").collect()


def test_head_without_yaml():
    assert files.scalar("12") == 12 and files.scalar("null") is None and files.scalar("'it''s'") == "it's" and files.scalar("[a, 2]") == ["a", 2]


def test_objects(spark, folder):
    keys = [(r.object_key, r.size) for r in files.objects(spark, f"file://{folder}", content=False).orderBy("object_key").collect()]
    assert [k for k, _ in keys] == ["fx/themes/dark.json", "notes/a.md", "notes/b.md"]
    assert files.objects(spark, f"file://{folder}", prefix="notes/").count() == 2


def test_fixtures(spark, folder):
    got = files.fixtures(spark, f"file://{folder}/fx", {"themes": "theme"}, "base").collect()
    assert [(r.ref, json.loads(r.doc)) for r in got] == [("theme:dark", {"name": "dark"})]


def test_interrupted_copy(spark, tmp_path):
    df = spark.range(10).select("id", F.col("id").alias("ordinal"))
    seen = []

    def stop(lane, done):
        seen.append(done)
        if done == 6:
            raise RuntimeError("cut off")

    with pytest.raises(RuntimeError):
        copies.copy(df, f"file://{tmp_path}/out", f"file://{tmp_path}/ledger", "l", 3, on_batch=stop)
    assert copies.lanes_done(spark, f"file://{tmp_path}/ledger") == {"l": 6}
    assert copies.copy(df, f"file://{tmp_path}/out", f"file://{tmp_path}/ledger", "l", 3) == 10
    assert sorted(r.id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == list(range(10))
    with pytest.raises(ValueError):
        copies.copy_all([("a", df), ("a", df)], "x", "y")


def test_stream_goes_on(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    df.write.parquet(f"file://{tmp_path}/in")
    where = (f"file://{tmp_path}/in", "k long, v string", f"file://{tmp_path}/out", f"file://{tmp_path}/check", "k")
    copies.stream_copy(spark, *where).awaitTermination()
    spark.createDataFrame([(2, "b"), (3, "c")], "k long, v string").write.mode("append").parquet(f"file://{tmp_path}/in")
    copies.stream_copy(spark, *where).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [1, 2, 3]


def test_leases(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 30), ("b", 1, 5)], "key string, generation int, expires_at int")
    assert [(r.key, r.generation) for r in copies.unexpired(df, 8).collect()] == [("a", 2)]
    assert [r.key for r in copies.expired(df, 12, 1).collect()] == ["b"]


def test_command_line(spark, folder, tmp_path):
    import io

    from quarry.__main__ import main

    (tmp_path / "app/themes").mkdir(parents=True)
    (tmp_path / "app/themes/dark.json").write_text('{"$patch": "theme:dark", "base": {"$ref": "theme:light"}}')
    where = ["--folder", f"file://{folder}/fx", "--folder", f"file://{tmp_path}/app", "--type", "themes=theme"]

    def run(*args):
        out = io.StringIO()
        return main([*args, *where], spark, out), out.getvalue()

    code, text = run("show", "theme:dark")
    assert code == 0 and json.loads(text)["value"] == {"name": "dark", "base": {"$ref": "theme:light"}}
    code, text = run("explain", "theme:dark")
    assert [x["kind"] for x in json.loads(text)["layers"]] == ["base", "patch"]
    assert run("list")[0] == 0 and run("show", "theme:none")[0] == 1
    code, text = run("validate")
    assert code == 1 and json.loads(text)["diagnostics"][0]["code"] == "missing-reference"
    assert '"theme:dark" -> "theme:light" [label="base"];' in run("graph", "--format", "dot")[1]
