"""Names, references, cursors and digests."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

REF = r"^[A-Za-z][A-Za-z0-9_-]*:[^:\s/]+$"
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
_ENCODER = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fnv1a(text: str) -> str:
    """32-bit FNV-1a over UTF-16 code units, in base 36."""
    h = 0x811C9DC5
    units = text.encode("utf-16-le")
    for k in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[k : k + 2], "little")) * 0x01000193) & 0xFFFFFFFF
    out = ""
    while h:
        h, r = divmod(h, 36)
        out = _DIGITS[r] + out
    return out or "0"


def canonical(value: object) -> str:
    """JSON with keys in code-point order and no white space; numbers that aren't finite are refused."""
    return _ENCODER.encode(value)


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def parse_ref(ref: Column) -> Column:
    """struct(type, id), null where the reference isn't canonical."""
    return F.when(is_ref(ref), F.struct(F.substring_index(ref, ":", 1).alias("type"), F.substring_index(ref, ":", -1).alias("id")))


def format_ref(type_: Column, id_: Column) -> Column:
    return F.concat_ws(":", type_, id_)


def is_ref(ref: Column) -> Column:
    return F.coalesce(ref.rlike(REF), F.lit(False))


def ref_matches(ref: object) -> bool:
    return isinstance(ref, str) and re.fullmatch(REF, ref) is not None


def cursor(created_at: Column, id_: Column) -> Column:
    return F.concat_ws(":", created_at.cast("string"), id_)


def target_key(kind: Column, collection: Column, key: Column) -> Column:
    """A key that no other target has: parts are preceded by their lengths."""
    sized = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    return F.concat_ws(":", kind, sized(F.coalesce(collection, F.lit(""))), sized(key))


def url_safe(name: Column) -> Column:
    """base64url without padding, of the UTF-8 bytes."""
    return F.rtrim(F.translate(F.base64(F.encode(name, "utf-8")), "+/\r\n", "-_"), F.lit("="))


def table_name(name: Column) -> Column:
    return F.lower(F.hex(F.encode(name, "utf-8")))


def uri_component(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def redacted_path(text: Column) -> Column:
    """Absolute paths of the machine give way to a mark."""
    return F.regexp_replace(F.regexp_replace(text, r"file://[^\s\"']+", "<path>"), r"(?<![\w<])(?:/[^\s/\"':]+){2,}", "<path>")


def dot_string(text: str) -> str:
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = text.replace(plain, escaped)
    return f'"{text}"'
