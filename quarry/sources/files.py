"""Files as tables: Markdown records, objects, fixtures."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def objects(spark: SparkSession, folder: str, content: bool = True, prefix: str = "") -> DataFrame:
    """object_key (the path below the folder), size, modified, content of every file; without content no file is opened."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/")
    key = F.regexp_replace(F.col("path"), "^.*?" + re.escape(re.sub(r"^file:/*", "/", root)) + "/", "")
    out = df.select(key.alias("object_key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return out.filter(F.startswith("object_key", F.lit(prefix))) if prefix else out


def texts(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """path, text of whole files."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    return df.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def front_matter(text: Column) -> tuple[Column, Column]:
    """The head between lines of three hyphens, null if there is none, and the body."""
    plain = F.regexp_replace(text, "^﻿", "")
    head = F.regexp_extract(plain, r"(?s)\A---[ \t]*\r?\n(.*?)(?:\r?\n)?---[ \t]*(?:\r?\n|\z)", 1)
    has = plain.rlike(r"(?s)\A---[ \t]*\r?\n(.*?)(?:\r?\n)?---[ \t]*(?:\r?\n|\z)")
    return F.when(has, head), F.when(has, F.regexp_replace(plain, r"(?s)\A---[ \t]*\r?\n.*?(?:\r?\n)?---[ \t]*(?:\r?\n|\z)", "")).otherwise(plain)


def preamble(body: Column) -> Column:
    """What stands before the first heading."""
    return F.trim(F.regexp_replace(F.regexp_extract(F.concat(F.lit("\n"), body), r"(?s)\A(.*?)(?:\n#{1,6}\s.*)?\z", 1), r"\A\s+|\s+\z", ""))


def section(body: Column, heading: str, level: int = 2) -> Column:
    """The text below a heading, up to the next of its level or a higher one; empty if there is no such heading."""
    mark = re.escape("#" * level + " " + heading)
    found = F.regexp_extract(F.concat(F.lit("\n"), body, F.lit("\n")), rf"(?s)\n{mark}[ \t\r]*\n(.*?)(?=\n#{{1,{level}}}\s|\z)", 1)
    return F.regexp_replace(found, r"\A\s+|\s+\z", "")


def scalar(text: str) -> object:
    """A YAML scalar or flow value, as far as front matter needs it."""
    text = text.strip()
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+)([eE][-+]?\d+)?", text):
        return float(text)
    if text[0] == text[-1] == "'" and len(text) > 1:
        return text[1:-1].replace("''", "'")
    if text[0] in '"[{':
        try:
            return json.loads(text)
        except ValueError:
            if text[0] == "[" and text[-1] == "]":
                return [scalar(x) for x in text[1:-1].split(",") if x.strip()]
    return text


def head_values(head: str) -> dict[str, object]:
    """Keys and values of a head: scalars, flow lists, lists of lines that begin with a hyphen, and nested keys by indentation."""
    try:
        import yaml

        got = yaml.safe_load(head)
        return got if isinstance(got, dict) else {}
    except ImportError:
        pass
    out: dict[str, object] = {}
    stack: list[tuple[int, object, str | None]] = [(-1, out, None)]
    for line in head.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        while indent <= stack[-1][0] and not (body.startswith("- ") and indent == stack[-1][0]):
            stack.pop()
        holder, name = stack[-1][1], stack[-1][2]
        if body.startswith("- "):
            if name is not None and not isinstance(holder[name], list):
                holder[name] = []
            holder[name].append(scalar(body[2:]))
            continue
        if name is not None:
            if not isinstance(holder[name], dict):
                holder[name] = {}
            holder = holder[name]
        key, _, value = body.partition(":")
        key = str(scalar(key))
        holder[key] = scalar(value)
        if not value.strip():
            stack.append((indent, holder, key))
    return out


def markdown(spark: SparkSession, folder: str, body_field: str | None = None, preamble_field: str | None = None, sections: Mapping[str, tuple[str, int]] | None = None) -> DataFrame:
    """path, id, data (JSON of the head's values with the asked parts of the body), ordered by id. A file without a non-empty string id is an error."""
    head, body = front_matter(F.col("text"))
    files = texts(spark, folder, ".md").select("path", head.alias("head"), body.alias("body"))
    parts = {}
    if body_field:
        parts[body_field] = F.regexp_replace("body", r"\n\z", "")
    if preamble_field:
        parts[preamble_field] = preamble(F.col("body"))
    for name, (heading, level) in (sections or {}).items():
        parts[name] = section(F.col("body"), heading, level)
    added = F.to_json(F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)])) if parts else F.lit("{}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text, more in zip(pdf.path, pdf["head"], pdf.added, strict=True):
                data = head_values(text or "")
                if not isinstance(data.get("id"), str) or not data["id"]:
                    raise ValueError(f"{path}: the front matter must hold a non-empty string id")
                rows.append((path, data["id"], json.dumps(data | json.loads(more), ensure_ascii=False, default=str)))
            yield pd.DataFrame(rows, columns=["path", "id", "data"])

    return files.select("path", "head", added.alias("added")).mapInPandas(run, "path string, id string, data string").orderBy("id")


def index(records: DataFrame, line: Column, heading: str) -> DataFrame:
    """One row, text: a heading and a line for each record, by id."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"])
    return records.agg(F.concat_ws("\n", F.lit(f"# {heading}\n"), F.array_join(lines, "\n")).alias("text"))


def fixtures(spark: SparkSession, folder: str, types: Mapping[str, str], source: str, priority: int = 0, parsers: Mapping[str, Callable[[str], object]] | None = None) -> DataFrame:
    """ref, priority, ord, path, doc of the files below a folder's directories, which are mapped to types. `.json` files are taken as they are; other
    endings need a parser (text to JSON value). Where the folder is local, files that links lead to out of it are an error."""
    endings = ["json", *(e.lstrip(".") for e in parsers or {})]
    found = objects(spark, folder).filter(F.regexp_extract("object_key", r"\.([^./]+)$", 1).isin(endings))
    if folder.startswith(("file:", "/")):
        _contained(re.sub(r"^file:/*", "/", folder))
    kind = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])[F.regexp_extract("object_key", r"^(.*)/[^/]+$", 1)]
    name = F.regexp_extract("object_key", r"([^/]+)\.[^./]+$", 1)
    rows = found.filter(kind.isNotNull()).select(F.concat_ws(":", kind, name).alias("ref"), F.lit(priority).alias("priority"), F.lit(0).alias("ord"), F.concat(F.lit(f"{source}/"), "object_key").alias("path"), F.decode("content", "utf-8").alias("doc"))
    if not parsers:
        return rows
    held = {e.lstrip("."): f for e, f in parsers.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(doc=[json.dumps(held[e](d), ensure_ascii=False) if (e := p.rsplit(".", 1)[1]) in held else d for p, d in zip(pdf.path, pdf.doc, strict=True)])

    return rows.mapInPandas(run, rows.schema)


def _contained(folder: str) -> None:
    import os

    root = os.path.realpath(folder)
    for at, directories, names in os.walk(folder):
        for name in (*directories, *names):
            path = os.path.join(at, name)
            if os.path.islink(path) and not os.path.realpath(path).startswith(root + os.sep):
                raise ValueError(f"{path} leads out of {folder}")


def _safe_key(key: str) -> str:
    if not key or key.startswith("/") or any(part in ("", ".", "..") for part in key.split("/")) or "\0" in key:
        raise ValueError(f"{key!r} is no object key")
    return key


def put_object(spark: SparkSession, folder: str, key: str, content: bytes, if_absent: bool = False) -> bool:
    """Writes an object, whole or not at all; with if_absent only where there is none (False then)."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    to, temporary = Path(f"{folder}/{_safe_key(key)}"), Path(f"{folder}/.put-{uuid.uuid4().hex}")
    files = to.getFileSystem(spark._jsc.hadoopConfiguration())
    if if_absent and files.exists(to):
        return False
    out = files.create(temporary, False)
    out.write(bytearray(content))
    out.close()
    files.mkdirs(to.getParent())
    if not if_absent:
        files.delete(to, False)
    if not files.rename(temporary, to):
        files.delete(temporary, False)
        return False
    return True


def delete_object(spark: SparkSession, folder: str, key: str) -> bool:
    """Whether there was one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{_safe_key(key)}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def write_markdown(records: DataFrame, folder: str, body: str = "body") -> None:
    """One file for each record (id, a JSON column `data` of head values, and a body), named by the URL-safe form of its id: many at a time, by the executors."""
    from quarry.functions.names import url_safe

    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    head = F.array_join(F.transform(F.map_entries(F.from_json("data", "map<string,string>")), lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"]))), "\n")
    text = F.concat(F.lit("---\nid: "), quoted(F.col("id")), F.lit("\n"), head, F.lit("\n---\n"), F.col(body))
    rows = records.select(url_safe(F.col("id")).alias("name"), text.alias("text"))
    scheme = re.match(r"^(?:file:)?/", folder)
    if not scheme:
        raise ValueError("Markdown is written to a folder that all executors mount")
    root = re.sub(r"^file:/*", "/", folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.makedirs(root, exist_ok=True)
        for pdf in batches:
            for name, t in zip(pdf.name, pdf.text, strict=True):
                at = f"{root}/.{name}.{uuid.uuid4().hex}"
                with open(at, "w", encoding="utf-8", newline="") as out:
                    out.write(t)
                os.replace(at, f"{root}/{name}.md")
            yield pdf[["name"]]

    rows.mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()


def fixtures_from(rows: DataFrame, ref: str, doc: str, source: str, priority: int = 0) -> DataFrame:
    """The same from a table."""
    return rows.select(F.col(ref).alias("ref"), F.lit(priority).alias("priority"), F.lit(0).alias("ord"), F.concat(F.lit(f"{source}/"), F.col(ref)).alias("path"), F.col(doc).alias("doc"))
