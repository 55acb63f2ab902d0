"""python -m quarry validate|list|show|explain|graph --folder DIR --type dir=type ... : fixtures below a folder, in layers."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.operators import fixtures
from quarry.sources import files


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    """0: fine, 1: something is wrong with the fixtures, 3: with the call."""
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    parser.add_argument("command", choices=["validate", "list", "show", "explain", "graph"])
    parser.add_argument("ref", nargs="?", help="type:id, for show and explain")
    parser.add_argument("--folder", action="append", required=True, help="a layer; later ones have a higher priority")
    parser.add_argument("--type", action="append", required=True, metavar="DIR=TYPE", help="which type the files of a directory are of")
    parser.add_argument("--only", help="list one type")
    parser.add_argument("--format", choices=["json", "dot"], default="json")
    asked = parser.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    types = dict(t.split("=", 1) for t in asked.type)
    layers = None
    for priority, folder in enumerate(asked.folder):
        one = files.fixtures(spark, folder, types, f"layer{priority}", priority)
        layers = one if layers is None else layers.union(one)
    say = lambda x: print(json.dumps(x, indent=2, ensure_ascii=False), file=out)
    if asked.command == "list":
        refs = [r.ref for r in layers.select("ref").distinct().orderBy("ref").collect()]
        say({"refs": [r for r in refs if not asked.only or r.startswith(f"{asked.only}:")]})
        return 0
    if asked.command == "validate":
        found = [r.asDict() for r in fixtures.validate(layers).collect()]
        say({"ok": not found, "diagnostics": found})
        return int(bool(found))
    loaded = fixtures.layered(layers)
    if asked.command == "graph":
        nodes, edges = fixtures.reference_graph(loaded.filter("error is null"))
        if asked.format == "dot":
            print(fixtures.to_dot(nodes, edges), file=out)
        else:
            say({"nodes": [r.asDict() for r in nodes.orderBy("ref").collect()], "edges": [r.asDict() for r in edges.orderBy("from", "to", "field_path").collect()]})
        return 0
    if not asked.ref:
        print(f"{asked.command} needs a reference (type:id)", file=sys.stderr)
        return 3
    row = loaded.filter(F.col("ref") == asked.ref).first()
    if row is None or row.error:
        say({"ref": asked.ref, "error": row.error if row else "missing-fixture"})
        return 1
    steps = [p.asDict() for p in row.provenance]
    say({"ref": row.ref, "layers": steps} if asked.command == "explain" else {"ref": row.ref, "value": json.loads(row.value), "layers": steps})
    return 0


if __name__ == "__main__":
    sys.exit(main())
