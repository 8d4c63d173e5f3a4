"""Typed rows from an archive of replies whose shape nobody declared."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsq.operators.replies import DATA

#: What a schema says of types that columns name otherwise, and names in it, which stay.
_NAMES = re.compile(r"`(?:[^`]|``)*`|OBJECT<|VOID")
_COLUMN_TYPES = {"OBJECT<": "STRUCT<", "VOID": "STRING"}


def reply_schema(parsed: DataFrame) -> str | None:
    """The type that all data rows of `parse_replies` have in common, None without any.

    Fields that differ between rows beyond what widens are VARIANT; a field that is
    always null is a string.
    """
    content = F.try_parse_json("content")
    found = parsed.filter(F.col("kind") == DATA).agg(F.schema_of_variant_agg(content).alias("schema")).first()[0]
    if found is None or found == "VOID":
        return None
    return _NAMES.sub(lambda m: _COLUMN_TYPES.get(m[0], m[0]), found)


def typed_rows(parsed: DataFrame, schema: str | None = None) -> DataFrame:
    """The data rows of `parse_replies` with a column per field in place of the JSON text.

    The schema is that of `reply_schema` unless one is given, as for a second archive
    of the same calls. Rows that are no objects come as one column, ``value``. A field
    of the name of an archive's column is called ``row_`` and its name.
    """
    schema = schema or reply_schema(parsed)
    kept = [c for c in parsed.columns if c not in ("kind", "content", "detail")]
    rows = parsed.filter(F.col("kind") == DATA)
    if schema is None:
        return rows.select(*kept).limit(0)
    content = F.try_parse_json("content")
    if not schema.startswith("STRUCT<"):
        value = content if schema == "VARIANT" else F.try_variant_get(content, "$", schema)
        return rows.select(*kept, value.alias("value"))
    typed = rows.select(*kept, F.try_variant_get(content, "$", schema).alias("_row"))
    row = F.col("_row")
    fields = [f.name for f in typed.schema["_row"].dataType]
    return typed.select(*kept, *[row.getField(f).alias(f"row_{f}" if f in kept else f) for f in fields])
