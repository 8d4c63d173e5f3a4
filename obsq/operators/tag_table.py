"""Entities by their tags, from a table laid out by tag key.

The catalog holds tags as a list per entity, which no scan can skip by. `write_tags`
turns it round: a row per entity and tag, in a folder per key, sorted by value. A
search for tags opens the folders of its keys alone; a table of searches finds out at
run time which those are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsq.errors import RequestError
from obsq.functions.predicates import well_formed_tags
from obsq.operators.search import BASIC_FIELDS
from obsq.plans.sizes import fits_broadcast

#: ``tag_key`` and ``tag_value`` keep any text; ``key`` names the folder.
TAG = T.StructType().add("guid", "string").add("tag_key", "string").add("tag_value", "string").add("key", "string")


def write_tags(entities: DataFrame, root: str) -> None:
    """Write the tags of a catalog to ``root``; an entity has a tag once."""
    tag = F.explode(F.array_distinct("tags"))
    rows = (
        entities.select("guid", tag.alias("_tag"))
        .filter(F.col("_tag.key").isNotNull() & F.col("_tag.value").isNotNull())
        .select("guid", F.col("_tag.key").alias("tag_key"), F.col("_tag.value").alias("tag_value"))
        .withColumn("key", _folder("tag_key"))
    )
    # ranges of key and value, so that a tag most entities have fills several files
    ordered = ["key", "tag_value", "guid"]
    rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered).write.mode("overwrite").partitionBy("key").parquet(root)


def read_tags(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(TAG).parquet(root)


def _folder(key: str):
    """A name for a key that keys of other case or with odd characters do not share."""
    return F.concat(F.lit("k"), F.hex(F.col(key)))


def guids_with_tags(tags: DataFrame, wanted: Sequence[Mapping[str, str]]) -> DataFrame:
    """GUIDs of the entities that have all these tags; one without key and value is ignored."""
    pairs = {
        (t["key"], str(t["value"])) for t in wanted if isinstance(t, Mapping) and "key" in t and "value" in t
    }
    if not pairs:
        raise RequestError("give at least one tag with a key and a value")
    named = F.lit(False)
    for key, value in sorted(pairs):
        folder = "k" + key.encode().hex().upper()
        named = named | ((F.col("key") == folder) & (F.col("tag_key") == key) & (F.col("tag_value") == value))
    return tags.filter(named).groupBy("guid").agg(F.count("*").alias("n")).filter(F.col("n") == len(pairs)).select("guid")


def search_by_tags(tags: DataFrame, entities: DataFrame, requests: DataFrame) -> DataFrame:
    """``req_id`` with the basic fields of every entity that has all tags of the request.

    Requests without a usable tag match nothing. Those that ask for the same tags are
    one search, and of its tags the rarest one is not singled out: an entity counts
    how many of them it has, before anything but GUIDs is joined.
    """
    asked = requests.select("req_id", F.array_sort(F.array_distinct(well_formed_tags(F.col("tags")))).alias("_tags"))
    asked = asked.filter(F.col("_tags").isNotNull()).withColumn("search", F.sha2(F.to_json(F.struct("_tags")), 256))
    wanted = (
        asked.select("search", "_tags").dropDuplicates(["search"])
        .select("search", F.size("_tags").alias("tags"), F.explode("_tags").alias("_tag"))
        .select("search", "tags", F.col("_tag.key").alias("tag_key"), F.col("_tag.value").alias("tag_value"))
        .withColumn("key", _folder("tag_key"))
        # a filter that all pass; for it Spark prunes folders by the keys at run time
        .filter(F.col("key") >= "k")
    )
    if fits_broadcast(requests):
        wanted = F.broadcast(wanted)
    found = (
        tags.join(wanted, ["key", "tag_key", "tag_value"])
        .groupBy("search", "tags", "guid").agg(F.count("*").alias("n"))
        .filter(F.col("n") == F.col("tags")).select("search", "guid")
    )
    return (
        asked.select("req_id", "search").join(found, "search")
        .join(entities.select(BASIC_FIELDS), "guid").select("req_id", *BASIC_FIELDS)
    )
