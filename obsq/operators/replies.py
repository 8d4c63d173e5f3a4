"""An archive of JSON replies, taken apart into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsq.errors import RequestError
from obsq.functions.rendering import excerpt

DATA = "data"
ERROR = "error"
UNDECODABLE = "undecodable"
UNEXPECTED = "unexpected"
EMPTY = "empty"


def parse_replies(
    archive: DataFrame, rows_path: Sequence[str], raw: str = "raw"
) -> DataFrame:
    """One output row per data row, per error, and per reply without either.

    ``rows_path`` leads from ``data`` to the list of rows inside a reply. The
    archive's other columns are kept, and added are

    - ``kind``: data, error, undecodable (not a JSON object of the expected
      shape), unexpected (neither data nor errors, or data of another shape) or
      empty (data that is null or an empty list, or an empty list of errors),
    - ``position``: place within the reply's list, from 0,
    - ``content``: a data row as JSON text, an error's message (the whole error
      where it has none), the first 500 characters of an undecodable reply, or
      the whole of any other,
    - ``detail``: the whole error as JSON text, null for the other kinds.

    No reply is lost: each gives at least one row.

    A reply may hold data and errors at once, and ``"data": null`` holds no rows.
    The text is read once for all kinds; filter on ``kind`` or partition a write
    by it to separate them.
    """
    if not rows_path:
        raise RequestError("rows_path must name at least one field below data")
    shape = "array<string>"
    for field in reversed(rows_path):
        shape = f"struct<`{_identifier(field)}`: {shape}>"
    schema = f"data {shape}, errors array<string>, _malformed string"

    text = F.col(raw)
    reply = F.from_json(
        text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}
    )
    rows = F.col("_reply.data")
    for field in rows_path:
        rows = rows[field]
    none = F.array().cast("array<struct<kind: string, position: int, content: string, detail: string>>")
    nothing = F.lit(None).cast("string")

    def item(kind, position, content, detail=nothing):
        return F.struct(
            F.lit(kind).alias("kind"), position.alias("position"), content.alias("content"), detail.alias("detail")
        )

    def whole(kind, content):
        return F.array(item(kind, F.lit(0), content))

    full = F.coalesce(text, F.lit(""))
    decoded = F.col("_reply").isNotNull() & F.col("_reply._malformed").isNull()
    items = F.concat(
        F.coalesce(F.transform(rows, lambda row, i: item(DATA, i, row)), none),
        F.coalesce(
            F.transform(
                "_reply.errors",
                lambda e, i: item(ERROR, i, F.coalesce(F.get_json_object(e, "$.message"), e), e),
            ),
            none,
        ),
    )
    # what is there but holds nothing: a null, or an empty list
    empty = F.coalesce(F.size(rows) == 0, F.lit(False)) | F.coalesce(
        F.size("_reply.errors") == 0, F.lit(False)
    ) | (F.arrays_overlap(F.json_object_keys(text), F.array(F.lit("data"))) & F.col("_reply.data").isNull())
    content = (
        F.when(~decoded, whole(UNDECODABLE, excerpt(full)))
        .when(F.size(items) > 0, items)
        .when(F.coalesce(empty, F.lit(False)), whole(EMPTY, full))
        .otherwise(whole(UNEXPECTED, full))
    )
    return (
        archive.withColumn("_reply", reply)
        .withColumn("_item", F.explode(content))
        .select(*[c for c in archive.columns if c != raw], "_item.*")
    )


def _identifier(field: str) -> str:
    return field.replace("`", "``")
