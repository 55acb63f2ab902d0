"""Documents as VARIANT: equality that is strict about types and tells null from missing."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_of(key: str) -> str:
    """The path of one top-level key, whatever characters it holds."""
    return '$["' + key.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def field(data: Column, key: str) -> Column:
    """The value of a top-level key as VARIANT; SQL null where it is missing."""
    return F.try_variant_get(data, path_of(key), "variant")


def equals(data: Column, key: str, value: object) -> Column:
    """Deep equality with a JSON value. None matches an explicit null only; 1 isn't true; the order of keys doesn't count."""
    found = field(data, key)
    if value is None:
        return F.coalesce(F.is_variant_null(found), F.lit(False))
    want = F.to_json(F.parse_json(F.lit(json.dumps(value))))
    return F.coalesce(F.to_json(found) == want, F.lit(False))


def within(data: Column, key: str, values: list[object]) -> Column:
    out = F.lit(False)
    for value in values:
        out = out | equals(data, key, value)
    return out


def matches(data: Column, where: dict[str, object]) -> Column:
    """All conditions hold. Without data nothing matches, not even no conditions."""
    out = data.isNotNull()
    for key, value in where.items():
        out = out & equals(data, key, value)
    return out


def canonical_text(value: object) -> str:
    return json.dumps(value, sort_keys=True, allow_nan=False)


def depth(text: Column) -> Column:
    """How many arrays and objects the deepest value of a JSON text is in."""
    bare = F.regexp_replace(text, r'"(?:\\.|[^"\\])*"', "s")
    marks = F.split(F.regexp_replace(F.regexp_replace(bare, r"[^\[\]{}\s,:]+", "s"), r"[\s,:]", ""), "")
    opens, closes = (lambda c: c.isin("[", "{")), (lambda c: c.isin("]", "}"))
    found = F.aggregate(
        marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, c: F.struct((s["now"] + F.when(opens(c), 1).when(closes(c), -1).otherwise(0)).alias("now"), F.when(closes(c) | (c == ""), s["most"]).otherwise(F.greatest(s["most"], s["now"])).alias("most")),
    )
    return found["most"]


def bounded(text: Column, most_bytes: int = 64 << 10, most_depth: int = 20) -> Column:
    """Whether a JSON text is within both bounds; false where it is no JSON."""
    return F.coalesce(F.try_parse_json(text).isNotNull() & (F.octet_length(text) <= most_bytes) & (depth(text) <= most_depth), F.lit(False))


def fingerprint(text: Column) -> Column:
    """SHA-256 of a JSON text in canonical form: keys in code-point order, no white space."""
    return F.sha2(F.to_json(F.parse_json(text)), 256)


def patched(annotations: Column, patch: Column) -> Column:
    """A map with another's entries put over it; null values of the patch take keys away."""
    return F.map_filter(F.map_concat(F.map_filter(annotations, lambda k, _: ~F.map_contains_key(patch, k)), patch), lambda _, v: v.isNotNull())
