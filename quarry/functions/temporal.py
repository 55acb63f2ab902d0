"""Valid-time keys and the status machine of statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARLIEST, LATEST = "0000-00-00T00:00:00.000Z", "9999-99-99T99:99:99.999Z"
TERMINAL = ("rejected", "superseded", "retracted")
MODEL_SOURCES = ("inferred", "perceived", "consolidated")


def bound_key(bound: Column, fallback: str) -> Column:
    """The text key of a bound struct(kind, at, anchorId): instants compare as text; before and after have keys of their own."""
    kind = bound["kind"]
    return (
        F.when(kind == "instant", F.concat(F.lit("instant:"), bound["at"]))
        .when(kind == "before", F.concat(F.lit("before:"), bound["anchorId"]))
        .when(kind == "after", F.concat(F.lit("after:"), bound["anchorId"]))
        .otherwise(F.lit(f"instant:{fallback}"))
    )


def valid_keys(start: Column, end: Column) -> tuple[Column, Column]:
    return bound_key(start, EARLIEST), bound_key(end, LATEST)


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def stored_status(source: Column, model_involved: Column, decided: Column) -> Column:
    """What a model had a part in is only proposed."""
    return F.when(model_involved | source.isin(*MODEL_SOURCES), "proposed").otherwise(decided)


def may_change(before: Column, after: Column) -> Column:
    return (before == "proposed") | ((before == "accepted") & after.isin("accepted", "superseded"))
