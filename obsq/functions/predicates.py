"""Predicates as Columns. Caller text is always a literal, never spliced SQL."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(terms: Iterable[Column]) -> Column:
    """Conjunction of the terms that are present; true when there are none."""
    return reduce(and_, terms, F.lit(True))


def contains_pattern(text: str) -> str:
    """LIKE pattern for "contains text", keeping the caller's % and _ wildcards.

    A backslash is doubled, because a lone one is an escape error in Spark.
    """
    doubled = text.replace("\\", "\\\\")
    return f"%{doubled}%"


def name_contains(name: Column, text: str) -> Column:
    return name.like(contains_pattern(text))


def contains_ignoring_case(name: Column, text: str) -> Column:
    return F.lower(name).contains(F.lower(F.lit(text)))


def has_tag(tags: Column, key: str, value: str) -> Column:
    """True when any tag equals key and value; a key may occur several times."""
    return F.exists(
        tags, lambda t: (t["key"] == F.lit(key)) & (t["value"] == F.lit(value))
    )


def well_formed_tags(tags: Column) -> Column:
    """The tags that have both a key and a value; null when none is left."""
    kept = F.filter(tags, lambda t: t["key"].isNotNull() & t["value"].isNotNull())
    return F.when(F.size(kept) > 0, kept)


def given(value: Column) -> Column:
    """True for a request argument that counts: neither null nor empty."""
    return F.coalesce(F.length(value) > 0, F.lit(False))
