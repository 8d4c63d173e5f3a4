"""Text forms of nested columns, for reports and JSON output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from obsq.schema import EXCERPT_CHARS, OK


def tags_text(tags: Column) -> Column:
    """``key=value`` pairs in stored order, separated by semicolons."""
    pairs = F.transform(tags, lambda t: F.concat_ws("=", t["key"], t["value"]))
    return F.array_join(pairs, ";")


def places_text(places: Column) -> Column:
    """``guid=name`` pairs of private locations."""
    pairs = F.transform(places, lambda p: F.concat_ws("=", p["guid"], p["name"]))
    return F.array_join(pairs, ";")


def excerpt(text: Column) -> Column:
    return F.substring(text, 1, EXCERPT_CHARS)


def json_text(*columns: str | Column, pretty: bool = False) -> Column:
    """One row as JSON text; null fields are left out."""
    return F.to_json(F.struct(*columns), {"pretty": str(pretty).lower()})


def reply_text(data: Column, outcome: Column, message: Column | None = None) -> Column:
    """The answer to one request as JSON text: its data, or why there is none."""
    said = F.coalesce(message, outcome) if message is not None else outcome
    errors = F.array(F.struct(said.alias("message"))).alias("errors")
    answered = F.to_json(F.struct(data.alias("data")))
    return F.when(outcome == OK, answered).otherwise(F.to_json(F.struct(errors)))
