"""Collections: filtered, sorted and paged lists, counts, and keys."""

from __future__ import annotations

import datetime
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Context, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import documents

_WHOLE, _REAL = ("tinyint", "smallint", "int", "bigint"), ("float", "double")


@dataclass(frozen=True)
class Filter:
    """What to list. Conditions are equalities and hold together; nulls sort last in either direction, equals keep the order of `ordinal`."""

    where: Mapping[str, object] = field(default_factory=dict)
    sort_by: str | None = None
    descending: bool = False
    limit: int | None = None
    offset: int = 0

    def __post_init__(self) -> None:
        for name in ("limit", "offset"):
            value = getattr(self, name)
            if value is not None and (not isinstance(value, int) or isinstance(value, bool) or value < 0):
                raise ValueError(f"{name} must be a whole number of 0 or more")


def literal(kind: str, value: object) -> Column | None:
    """The value as one of a column of that type; None where nothing of the type equals it. Booleans are no numbers, numbers no text; a text is
    compared with dates and times where it can be read as one."""
    if isinstance(value, bool):
        return F.lit(value) if kind == "boolean" else None
    if isinstance(value, (int, float, Decimal)):
        if isinstance(value, float) and not math.isfinite(value):
            return F.lit(value) if kind in _REAL else None
        if kind in _REAL:
            return F.lit(float(value))
        if kind.startswith("decimal"):
            digits, scale = map(int, kind[8:-1].split(","))
            exact = Decimal(str(value))
            fits = exact == exact.quantize(Decimal(1).scaleb(-scale), context=Context(prec=80)) and abs(exact) < Decimal(10) ** (digits - scale)
            return F.lit(exact.quantize(Decimal(1).scaleb(-scale), context=Context(prec=80))).cast(kind) if fits else None
        if kind in _WHOLE and value == int(value) and -(1 << 63) <= value < 1 << 63:
            return F.lit(int(value))
        return None
    if isinstance(value, str):
        if kind == "string" or kind.startswith(("varchar", "char")):
            return F.lit(value)
        return F.lit(value).try_cast(kind) if kind.startswith(("date", "timestamp")) else None
    if isinstance(value, (datetime.date, datetime.datetime)):
        return F.lit(value) if kind.startswith(("date", "timestamp")) else None
    if isinstance(value, (bytes, bytearray)):
        return F.lit(bytes(value)) if kind == "binary" else None
    return None


def equal(df: DataFrame, name: str, value: object) -> Column:
    """Equality that is strict about types: a column of another kind matches nothing. None matches null."""
    if value is None:
        return F.col(name).isNull()
    want = literal(dict(df.dtypes)[name], value)
    return F.lit(False) if want is None else F.coalesce(F.col(name) == want, F.lit(False))


def predicate(df: DataFrame, where: Mapping[str, object], data: str | None = None) -> Column:
    """The conditions over columns, or over the top-level keys of the VARIANT column `data`."""
    each = [documents.equals(F.col(data), k, v) if data else equal(df, k, v) for k, v in where.items()]
    return reduce(lambda a, b: a & b, each, F.lit(True))


def list_records(df: DataFrame, wanted: Filter = Filter(), ordinal: str = "ordinal", data: str | None = None) -> DataFrame:
    """The records, whole. Without sort_by they come in the order of `ordinal`, if there is such a column."""
    out = df.filter(predicate(df, wanted.where, data)) if wanted.where else df
    order = []
    if wanted.sort_by is not None:
        by = documents.field(F.col(data), wanted.sort_by) if data else F.col(wanted.sort_by)
        # numbers before text, each in its own order
        keys = [F.try_variant_get(F.col(data), documents.path_of(wanted.sort_by), "double"), F.try_variant_get(F.col(data), documents.path_of(wanted.sort_by), "string")] if data else [by]
        order = [k.desc_nulls_last() if wanted.descending else k.asc_nulls_last() for k in keys]
    if ordinal in df.columns:
        order.append(F.col(ordinal).asc())
    if order:
        out = out.orderBy(*order)
    if wanted.offset:
        out = out.offset(wanted.offset)
    return out if wanted.limit is None else out.limit(wanted.limit)


def count_records(df: DataFrame, wanted: Filter = Filter(), data: str | None = None) -> DataFrame:
    """One row, n. Paging doesn't count."""
    return (df.filter(predicate(df, wanted.where, data)) if wanted.where else df).agg(F.count("*").alias("n"))


def list_where_in(df: DataFrame, name: str, values: Sequence[object], wanted: Filter = Filter(), ordinal: str = "ordinal", most_literals: int = 1000, data: str | None = None) -> DataFrame:
    """Records whose field is one of the values, as strictly as `equal`; a None among them matches null. No values, no records.

    With `data` the field is a top-level key of that VARIANT column, equality is deep, and None matches an explicit null. Values that nothing
    of the field's type equals are left out; the others are one IN, which the scan gets, or beyond `most_literals` a join.
    """
    if data:
        texts = list(dict.fromkeys(documents.canonical_text(v) for v in values if v is not None))
        found = documents.field(F.col(data), name)
        hit = F.coalesce(F.is_variant_null(found), F.lit(False)) if any(v is None for v in values) else F.lit(False)
        if len(texts) <= most_literals:
            canonical = [F.to_json(F.parse_json(F.lit(t))) for t in texts]
            return list_records(df.filter(hit | F.coalesce(F.to_json(found).isin(*canonical), F.lit(False)) if texts else hit), wanted, ordinal, data)
        held = df.sparkSession.createDataFrame([(t,) for t in texts], "__v string").select(F.to_json(F.parse_json("__v")).alias("__v")).distinct()
        out = df.withColumn("__v", F.to_json(found)).join(held.withColumn("__in", F.lit(True)), "__v", "left").filter(hit | F.col("__in"))
        return list_records(out.select(*df.columns), wanted, ordinal, data)
    kind = dict(df.dtypes)[name]
    real = [x for v in dict.fromkeys((type(v), v) for v in values if v is not None) if (x := literal(kind, v[1])) is not None]
    null = F.col(name).isNull() if any(v is None for v in values) else F.lit(False)
    if len(real) <= most_literals:
        return list_records(df.filter(null | F.coalesce(F.col(name).isin(*real), F.lit(False)) if real else null), wanted, ordinal)
    held = df.sparkSession.range(1).select(F.explode(F.array(*real)).alias(name)).select(F.col(name).try_cast(kind).alias(name)).filter(F.col(name).isNotNull()).distinct()
    out = df.join(held, name, "left_semi")
    if any(v is None for v in values):
        out = out.unionByName(df.filter(null))
    return list_records(out.select(*df.columns), wanted, ordinal)


def semi_in(df: DataFrame, name: str, other: DataFrame, other_name: str) -> DataFrame:
    """Records whose field is among another table's values."""
    return df.join(other.select(F.col(other_name).alias(name)).distinct(), name, "left_semi").select(*df.columns)


def get(df: DataFrame, key: object, name: str = "id") -> DataFrame:
    return df.filter(F.col(name) == F.lit(key)).limit(1)


def has(df: DataFrame, key: object, name: str = "key") -> DataFrame:
    """One row, found."""
    return df.filter(F.col(name) == F.lit(key)).limit(1).agg((F.count("*") > 0).alias("found"))


def keys(df: DataFrame, prefix: str = "", name: str = "key") -> DataFrame:
    """Keys in order. The prefix is literal: no character of it is a pattern, and case counts."""
    return df.filter(F.startswith(F.col(name), F.lit(prefix))).select(name).orderBy(name)


def in_namespace(df: DataFrame, namespace: str, name: str = "namespace") -> DataFrame:
    """A view of one namespace's rows, which can't see another's; as a partition column its folder alone is read."""
    return df.filter(F.col(name) == F.lit(namespace)).drop(name)


def insert_only(new: DataFrame, existing: DataFrame, on: str = "id") -> DataFrame:
    return new.join(existing.select(on), on, "left_anti").select(*new.columns)


def with_versions(records: DataFrame, versions: DataFrame, key: str = "key") -> DataFrame:
    """Records with the version of each, null for those that have none yet."""
    return records.join(versions.select(key, "version"), key, "left")


def upserted(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """existing with the rows of new in place of those with their keys, and the others added. Of a key that comes twice in new, any row is an error."""
    twice = new.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][0]!r} comes more than once")
    return existing.join(new.select(key), key, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))
