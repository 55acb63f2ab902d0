"""Tokens and search text."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; none of a null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def match_expression(text: Column) -> Column:
    """The tokens, each in quotes, joined by OR: the form that full-text engines take."""
    return F.concat_ws(" OR ", F.transform(tokens(text), lambda t: F.concat(F.lit('"'), t, F.lit('"'))))


def fields_of_text(text: Column) -> Column:
    """A text is a document of one field, `text`."""
    return F.create_map(F.lit("text"), text)


def field_weights(fields: Sequence[str], weights: Mapping[str, float] | None) -> dict[str, float]:
    """A weight for each field, 1 unless given; weights are finite and not negative, and of known fields."""
    for name, weight in (weights or {}).items():
        if name not in fields:
            raise ValueError(f"unknown search field {name!r}")
        if not math.isfinite(weight) or weight < 0:
            raise ValueError(f"weight of {name!r} must be finite and not negative")
    return {name: float((weights or {}).get(name, 1.0)) for name in fields}
