"""Event attributes as a VARIANT, parsed once when events are written.

JSON text is parsed by every query that reads an attribute of it. A VARIANT column is
parsed at the write; Spark shreds the attributes that most rows of a file have into
Parquet columns of their own, and a query reads those it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsq.errors import RequestError
from obsq.schema import EVENT

#: ``props`` holds what is not JSON, so that no text is lost.
EVENT_ROW = (
    T.StructType(list(EVENT.fields)).add("attributes", T.VariantType()).add("event_date", "date")
)


def with_attributes(events: DataFrame, props: str = "props") -> DataFrame:
    """Events with ``attributes`` in place of the JSON text; text that is not JSON stays."""
    parsed = F.try_parse_json(props)
    return events.withColumns(
        {"attributes": parsed, props: F.when(parsed.isNull(), F.col(props))}
    )


def write_attribute_events(events: DataFrame, root: str, mode: str = "append") -> None:
    """Write events by day, sorted by account and time, with parsed attributes."""
    dated = with_attributes(events).withColumn("event_date", F.to_date("ts"))
    rows = dated.select([F.col(f.name).cast(f.dataType) for f in EVENT_ROW])
    order = ["event_date", "account_id", "ts"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("event_date").parquet(root)


def read_attribute_events(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(EVENT_ROW).parquet(root)


def variant_attribute(name: str, kind: str = "string", column: str = "attributes") -> Column:
    """An attribute, as a facet or inside an aggregate; null where there is none of this kind.

    ``kind`` is a type such as ``string``, ``double`` or ``array<string>``. As a string, a
    number is in its shortest form and an object is JSON text.
    """
    if "'" in name and '"' in name:
        raise RequestError(f"an attribute's name cannot hold both kinds of quotes: {name}")
    quote = '"' if "'" in name else "'"
    return F.try_variant_get(F.col(column), f"$[{quote}{name}{quote}]", kind).alias(name)
