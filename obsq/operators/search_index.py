"""Searches of the entity catalog through a kept index.

The index holds postings: for every probe (one, two, three or six letters of a name, a
tag, a domain, a type, an account) the sorted numbers of the entities that satisfy
it. A search asks for all its probes and intersects their postings; only what is in
all of them is compared in full, as short pieces of a name may meet in another order.

Entities are numbered within shards, so that a posting has bounded length whatever
the probe, and a probe that most entities satisfy is spread over all tasks. The
rarest probe of a search leads; its shards are looked up in the lists of the other
probes that are not much longer, and a shard that lacks one of them has no match.
Postings are sorted
by probe, with a Bloom filter per row group, and the numbers are stored as Parquet's
packed deltas; a search of known probes opens the row groups that may hold them.

The index is built once and extended by batches of new, changed or removed entities.
A batch is a segment with postings of its own, published together with the list of
the older rows that it replaces; `compact` makes one segment of all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsq.errors import RequestError
from obsq.operators.bulk_search import BulkSearch, answers, checked_requests, distinct_searches, satisfies
from obsq.operators.paging import BY_GUID, Listing
from obsq.operators.search import BASIC_FIELDS, _whole_number
from obsq.plans.sizes import fits_broadcast
from obsq.schema import ENTITY, SEARCH_LIMIT, SEARCH_REQUEST
from obsq.sources.published import Part, Published, Version

#: About so many entities share a shard, and a posting has at most so many numbers.
SHARD_ENTITIES = 1 << 16
#: Lengths of the pieces of a name that have postings. A search uses the longest that
#: fits: lists of short pieces grow with the catalog, and so would the work of each search.
PIECES = (6, 3, 2, 1)
#: Entities whose postings are gathered in one task before they are shuffled.
CHUNK = 1 << 13
#: Lists of a search that are intersected: so many, and at most so many times the
#: length of the shortest. The others are settled by the comparison in full.
MOST_LISTS, LONGER = 6, 16
#: Requests with up to this share of the broadcast threshold have their probes read first.
PROBE_GROWTH = 64

ANY = "any"
FIELDS = [*BASIC_FIELDS, "type"]
PLACE = ["segment", "shard", "no"]

REPLACED = T.StructType().add("segment", "integer").add("shard", "integer").add("no", "integer")
ENTITY_ROW = T.StructType([*REPLACED.fields, *[ENTITY[name] for name in FIELDS]])
POSTING = (
    T.StructType()
    .add("probe", "string")
    .add("segment", "integer")
    .add("shard", "integer")
    .add("n", "integer")
    .add("numbers", T.ArrayType(T.IntegerType()))
)
FREQUENCY = T.StructType().add("probe", "string").add("n", "long")

#: How postings are written.
POSTING_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary#numbers.list.element": "false",
    "parquet.bloom.filter.enabled#probe": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.block.size": str(16 << 20),
}


class SearchIndex:
    """A kept index under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.store = Published(spark, root)

    # --- writing ---

    def build(self, entities: DataFrame) -> Version:
        """An index of these entities in place of what there was."""
        base = self.store.current()
        return self.store.publish(base, self._segment(entities, _next_segment(base)))

    def extend(self, entities: DataFrame, removed: DataFrame | None = None) -> Version:
        """Add entities, in place of older ones of the same GUID, and leave out the
        GUIDs of ``removed``."""
        base = self.store.current()
        parts = self._segment(entities, _next_segment(base))
        gone = entities.select("guid")
        if removed is not None:
            gone = gone.unionByName(removed.select("guid"))
        replaced = self._live(base).join(gone.distinct(), "guid", "left_semi").select(PLACE)
        parts.append(self.store.stage(replaced, "replaced"))
        return self.store.publish(base, [*base.parts, *parts])

    def compact(self) -> Version:
        """One segment of all entities that no later one replaced."""
        base = self.store.current()
        live = self._live(base).select(FIELDS)
        return self.store.publish(base, self._segment(live, _next_segment(base)))

    def _segment(self, entities: DataFrame, segment: int) -> list[Part]:
        """Stage numbered entities and their postings."""
        count = entities.count()
        shards = max(1, -(-count // SHARD_ENTITIES))
        in_shard = W.partitionBy("shard").orderBy("guid")
        numbered = (
            entities.select(FIELDS)
            .withColumn("shard", F.pmod(F.xxhash64("guid"), F.lit(shards)).cast("int"))
            .withColumn("no", F.row_number().over(in_shard) - 1)
            .select(F.lit(segment).alias("segment"), "shard", "no", *FIELDS)
        )
        kept = self.store.stage(numbered, "entity", segment, compression="zstd")
        # an entity has many times its size in postings, so tasks are dealt by number of entities
        dealt = self.store.open([kept], ENTITY_ROW).repartition(
            max(1, -(-count // CHUNK)), "shard", F.floor(F.col("no") / CHUNK)
        )
        postings = (
            dealt
            .select("segment", "shard", "no", F.explode(_offered()).alias("probe"))
            .groupBy("probe", "segment", "shard").agg(F.sort_array(F.collect_list("no")).alias("numbers"))
            .select("probe", "segment", "shard", F.size("numbers").alias("n"), "numbers")
            # the grouping has dealt them by probe and shard already
            .sortWithinPartitions("probe", "shard")
        )
        lists = self.store.stage(postings, "posting", segment, **POSTING_OPTIONS)
        counts = self.store.open([lists], POSTING).groupBy("probe").agg(F.sum("n").alias("n"))
        return [kept, lists, self.store.stage(counts, "frequency", segment, compression="zstd")]

    # --- reading ---

    def _live(self, version: Version) -> DataFrame:
        entities = self.store.open(version.of_kind("entity"), ENTITY_ROW)
        replaced = version.of_kind("replaced")
        if not replaced:
            return entities
        return entities.join(self.store.open(replaced, REPLACED), PLACE, "left_anti")

    def entities(self) -> DataFrame:
        """The basic fields of all entities of the index."""
        return self._live(self.store.current()).select(BASIC_FIELDS)

    def search(self, requests: DataFrame) -> BulkSearch:
        """One search per request row, by the rules of `search_entities_bulk`."""
        valid, errors = checked_requests(requests)
        keyed, searches = distinct_searches(valid)
        return answers(keyed, self._found(searches, fits_broadcast(requests, PROBE_GROWTH)), errors)

    def search_one(
        self,
        name: str | None = None,
        entity_type: str | None = None,
        domain: str | None = None,
        tags: Sequence[Mapping[str, str]] | None = None,
        account: int | None = None,
        limit: int | None = SEARCH_LIMIT,
    ) -> Listing:
        """Entities that satisfy every criterion given, by the rules of `search_entities`."""
        pairs = [
            (t["key"], str(t["value"])) for t in tags or [] if isinstance(t, Mapping) and "key" in t and "value" in t
        ]
        if not (name or entity_type or domain or pairs):
            raise RequestError("give at least one of name, type, domain and tags")
        account = None if account is None else _whole_number(account)
        asked = [(0, account, name, domain, entity_type, pairs)]
        valid, _ = checked_requests(self.spark.createDataFrame(asked, SEARCH_REQUEST))
        searches = valid.withColumn("search", F.lit("one")).drop("req_id")
        return Listing(self._found(searches, True).select(BASIC_FIELDS), BY_GUID, limit)

    def _found(self, searches: DataFrame, few: bool) -> DataFrame:
        """``search`` with the fields of the entities it matches."""
        version = self.store.current()
        postings = self.store.open(version.of_kind("posting"), POSTING)
        asked = searches.select("search", F.explode(_asked()).alias("probe"))
        if few:
            # known probes reach the scan, which then skips row groups
            probes = [r["probe"] for r in asked.select("probe").distinct().collect()]
            postings = postings.filter(F.col("probe").isin(probes))
        # the rarest probe leads, and the lists that are not much longer are intersected with its
        counts = self.store.open(version.of_kind("frequency"), FREQUENCY).groupBy("probe").agg(F.sum("n").alias("n"))
        weighed = asked.join(counts, "probe", "left").select("search", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "probe").alias("list"))
        ordered = weighed.groupBy("search").agg(F.sort_array(F.collect_list("list")).alias("lists"))
        least = F.get("lists", F.lit(0))
        short = F.filter(F.slice("lists", 1, MOST_LISTS), lambda x: x["n"] <= least["n"] * LONGER)
        chosen = ordered.filter(least["n"] > 0).select("search", F.size(short).alias("k"), short.alias("lists"))
        leading = chosen.select("search", "k", least["probe"].alias("probe")).join(postings, "probe")
        following = (
            leading.select("search", "segment", "shard")
            .join(chosen.select("search", "k", F.explode(F.slice("lists", 2, MOST_LISTS)).alias("list")), "search")
            .select("search", "k", "segment", "shard", "list.probe")
            .join(postings, ["probe", "segment", "shard"])
        )
        columns = ["search", "k", "segment", "shard", "n", "numbers"]
        by_length = F.transform(F.sort_array(F.collect_list(F.struct("n", "numbers"))), lambda x: x["numbers"])
        common = F.aggregate(F.slice("lists", 2, MOST_LISTS), F.get("lists", F.lit(0)), F.array_intersect)
        met = (
            leading.select(columns).unionByName(following.select(columns))
            .groupBy("search", "k", "segment", "shard").agg(by_length.alias("lists"))
            # a shard that lacks one of the probes has no match
            .filter(F.size("lists") == F.col("k"))
            .select("search", "segment", "shard", F.explode(common).alias("no"))
        )
        replaced = version.of_kind("replaced")
        if replaced:
            met = met.join(self.store.open(replaced, REPLACED), PLACE, "left_anti")
        entities = self.store.open(version.of_kind("entity"), ENTITY_ROW)
        return met.join(entities, PLACE).join(searches, "search").filter(satisfies()).select("search", *BASIC_FIELDS)


def _next_segment(version: Version) -> int:
    return 1 + max((part.number for part in version.parts), default=-1)


def _pieces(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    none = F.array().cast("array<string>")
    return F.when(
        F.length(text) >= size, F.transform(starts, lambda i: F.concat(F.lit("name:"), F.substring(text, i, size)))
    ).otherwise(none)


def _tag(tag: Column) -> Column:
    # the length keeps a key that contains "=" apart from one that does not
    return F.concat(F.lit("tag:"), F.length(tag["key"]).cast("string"), F.lit(":"), tag["key"], F.lit("="), tag["value"])


def _others(account: str, domain: str, entity_type: str, tags: str) -> list[Column]:
    given = [("account:", account), ("domain:", domain), ("type:", entity_type)]
    return [
        F.coalesce(F.transform(tags, _tag), F.array().cast("array<string>")),
        F.array(*[F.concat(F.lit(kind), F.col(c).cast("string")) for kind, c in given]),
    ]


def _offered() -> Column:
    """All probes that an entity satisfies, each once."""
    pieces = [_pieces(F.coalesce("name", F.lit("")), size) for size in PIECES]
    rest = _others("account_id", "domain", "type", "tags")
    return F.array_distinct(F.array_compact(F.concat(*pieces, *rest, F.array(F.lit(ANY)))))


def _asked() -> Column:
    """The probes of a search: of each run of letters between wildcards the pieces of
    the greatest length that fits."""
    runs = F.filter(F.split(F.coalesce("r_name", F.lit("")), "[%_]"), lambda run: F.length(run) > 0)

    def of_run(run: Column) -> Column:
        return F.coalesce(*[F.when(F.length(run) >= size, _pieces(run, size)) for size in PIECES])

    pieces = F.flatten(F.transform(runs, of_run))
    probes = F.array_distinct(F.array_compact(F.concat(pieces, *_others("r_account_id", "r_domain", "r_type", "r_tags"))))
    # a name of wildcards alone leaves nothing to go by
    return F.when(F.size(probes) > 0, probes).otherwise(F.array(F.lit(ANY)))
