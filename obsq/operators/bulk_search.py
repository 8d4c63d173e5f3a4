"""Many searches against the catalog in one job.

A search has no single equality to join on: some name an account or a domain,
some only a piece of a name. Each entity therefore offers a set of probes, every
one a condition it satisfies: a piece of its name, a tag, its domain, its type.
Each search picks one probe, the one the fewest entities offer, and the two are
joined on it. Only entities that share a search's rarest condition are compared
with the rest of its criteria, so nothing is paired with everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsq.errors import RequestError
from obsq.functions.predicates import given, well_formed_tags
from obsq.operators.search import BASIC_FIELDS
from obsq.plans.sizes import fits_broadcast
from obsq.plans.skew import salted_left_join

# Lengths of the pieces of a name that serve as probes. A search uses the longest
# that fits, which is the rarest; the short ones are for searches that are short.
PIECES = (6, 3, 2, 1)

# The probes of a request together take up to this many times its own size.
PROBE_GROWTH = 64

# Numbers that probes are hashed to, to tell early which ones nobody asks for.
HASH_SLOTS = 2**20


@dataclass(frozen=True)
class BulkSearch:
    matches: DataFrame
    """``req_id`` with the basic fields of every entity it matches."""

    errors: DataFrame
    """``req_id`` and ``message`` of the searches without a usable criterion."""

    counted: DataFrame
    """``req_id`` and ``n``, the matches of the search that a request asks for."""

    def first(self, limit: int) -> DataFrame:
        """The first ``limit`` matches of each search, by GUID."""
        if limit <= 0:
            raise RequestError(f"limit must be positive, not {limit}")
        by_guid = Window.partitionBy("req_id").orderBy("guid")
        return (
            self.matches.withColumn("_rank", F.row_number().over(by_guid))
            .filter(F.col("_rank") <= limit)
            .drop("_rank")
        )

    @property
    def totals(self) -> DataFrame:
        """Matches per search; a search without any is not listed."""
        return self.counted.groupBy("req_id").agg(F.sum("n").alias("total_count"))


def distinct_searches(valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with the key of the search they ask for, and each search once.

    Requests that ask the same are one search, so what it finds is found once.
    """
    criteria = [c for c in valid.columns if c != "req_id"]
    keyed = valid.withColumn("search", F.sha2(F.to_json(F.struct(*criteria)), 256))
    searches = keyed.groupBy("search").agg(*[F.first(c).alias(c) for c in criteria])
    return keyed.select("req_id", "search"), searches


def answers(keyed: DataFrame, found: DataFrame, errors: DataFrame) -> BulkSearch:
    """What the searches of ``keyed`` requests found, given back to the requests."""
    matches = keyed.join(found, "search").select("req_id", *BASIC_FIELDS)
    # counted per search, so that a total needs no row for each request and match
    counts = found.groupBy("search").agg(F.count("*").alias("n"))
    return BulkSearch(matches, errors, keyed.join(counts, "search").select("req_id", "n"))


def search_entities_bulk(entities: DataFrame, requests: DataFrame) -> BulkSearch:
    """Run one search per request row: ``req_id`` and any of ``account_id``,
    ``name``, ``domain``, ``type`` and ``tags``, with the rules of a single
    search. Null, an empty string or an empty tag list is no criterion.
    """
    valid, errors = checked_requests(requests)
    few = fits_broadcast(requests, PROBE_GROWTH)
    keyed, searches = distinct_searches(valid)
    asked = searches.select("search", F.explode(_request_probes()).alias("probe"))
    asked_for = asked.groupBy("probe").agg(F.count("*").alias("requests"))
    used = _forms_used(valid)
    # An entity offers many times its own size, so the catalog is dealt to all tasks first.
    catalog = entities if few else _dealt(entities)
    offered = _offered(catalog, used)
    if few:
        of_interest = offered.join(F.broadcast(asked_for.select("probe")), "probe", "left_semi")
    else:
        of_interest = _maybe_asked(offered, asked_for).join(
            asked_for.select("probe"), "probe", "left_semi"
        )
    frequency = of_interest.groupBy("probe").agg(F.count("*").alias("n"))
    if few:
        weighed = asked.join(frequency, "probe", "left")
    else:
        # Many names share a beginning, so one probe may be in most requests.
        weighed = salted_left_join(asked, frequency, ["probe"], "search", asked_for, "requests")
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "probe"))
    rarest = (
        weighed.groupBy("search").agg(best.alias("best")).select("search", "best.probe")
    )
    chosen = searches.join(rarest, "search")
    if few:
        # One row per search: the catalog stays where it is.
        offered = _offered(entities, used, *BASIC_FIELDS, "type")
        candidates = offered.join(F.broadcast(chosen), "probe")
        keyed = F.broadcast(keyed)
    else:
        # Only GUIDs and probes are shuffled; the fields join the pairs that meet.
        met = _maybe_asked(_offered(catalog, used, "guid"), chosen).join(chosen, "probe")
        candidates = met.join(entities.select(*BASIC_FIELDS, "type"), "guid")
    found = candidates.filter(satisfies()).select("search", *BASIC_FIELDS)
    return answers(keyed, found, errors)


def _dealt(entities: DataFrame) -> DataFrame:
    """What probes are made of, in as many partitions as a shuffle has: AQE would join
    them by their size, which is small beside that of the probes."""
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return entities.select("guid", "name", "account_id", "domain", "type", "tags").repartition(parts, "guid")


def checked_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with a usable criterion, their arguments as ``r_`` columns; and errors of the others."""
    wanted = requests.select(
        "req_id",
        F.col("account_id").alias("r_account_id"),
        F.when(given(F.col("name")), F.col("name")).alias("r_name"),
        F.when(given(F.col("domain")), F.col("domain")).alias("r_domain"),
        F.when(given(F.col("type")), F.col("type")).alias("r_type"),
        well_formed_tags(F.col("tags")).alias("r_tags"),
    )
    criterion = F.coalesce("r_name", "r_domain", "r_type").isNotNull() | F.col("r_tags").isNotNull()
    valid = wanted.filter(criterion)
    errors = wanted.filter(~criterion).select(
        "req_id",
        F.lit("at least one of name, type, domain and tags is needed").alias("message"),
    )
    return valid, errors


def _maybe_asked(offered: DataFrame, asked: DataFrame) -> DataFrame:
    """Offered probes without most of those that nobody asks for.

    What is sent to every task are hash slots, so at most ``HASH_SLOTS`` numbers
    however many requests there are. Probes that share a slot by chance stay in
    and are dropped by the join that follows.
    """
    slots = asked.select(_hash_slot().alias("_hash")).distinct()
    return (
        offered.withColumn("_hash", _hash_slot())
        .join(F.broadcast(slots), "_hash", "left_semi")
        .drop("_hash")
    )


def _hash_slot() -> Column:
    return F.pmod(F.xxhash64("probe"), F.lit(HASH_SLOTS))


def satisfies() -> Column:
    """Whether an entity meets all criteria of the request beside it."""
    pattern = F.concat(F.lit("%"), F.replace(F.col("r_name"), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    missing_tags = F.size(F.array_except("r_tags", "tags"))
    return (
        (F.col("r_account_id").isNull() | (F.col("account_id") == F.col("r_account_id")))
        & (F.col("r_domain").isNull() | (F.col("domain") == F.col("r_domain")))
        & (F.col("r_type").isNull() | (F.col("type") == F.col("r_type")))
        & (F.col("r_name").isNull() | F.like(F.col("name"), pattern))
        & (F.col("r_tags").isNull() | (missing_tags == 0))
    )


def _name_probe(piece: Column) -> Column:
    return F.concat(F.lit("name:"), piece)


def _tag_probe(tag: Column) -> Column:
    # The length keeps a key that contains "=" apart from one that does not.
    key = tag["key"]
    return F.concat(F.lit("tag:"), F.length(key).cast("string"), F.lit(":"), key, F.lit("="), tag["value"])


def _domain_probe(domain: Column) -> Column:
    return F.concat(F.lit("domain:"), domain)


def _type_probe(entity_type: Column) -> Column:
    return F.concat(F.lit("type:"), entity_type)


ANY_PROBE = "any:"


def _within(account: Column, probe: Column) -> Column:
    return F.concat(F.lit("in "), account.cast("string"), F.lit(" "), probe)


def _runs() -> Column:
    """The parts of a searched name between its wildcards."""
    return F.filter(F.split("r_name", "[%_]"), lambda run: F.length(run) > 0)


def _piece_length(run: Column) -> Column:
    return F.coalesce(*[F.when(F.length(run) >= p, F.lit(p)) for p in PIECES])


@dataclass(frozen=True)
class _Forms:
    """What kinds of probes any request has; one value each, read once before the job."""

    sizes: Column
    plain: Column
    scoped: Column


def _forms_used(valid: DataFrame) -> _Forms:
    lengths = valid.select(F.explode(F.transform(_runs(), _piece_length)).alias("size"))
    unscoped = F.col("r_account_id").isNull()
    return _Forms(
        # at most as many as there are lengths of pieces
        lengths.agg(F.sort_array(F.collect_set("size"))).scalar(),
        valid.agg(F.bool_or(unscoped)).scalar(),
        valid.agg(F.bool_or(~unscoped)).scalar(),
    )


def _request_probes() -> Column:
    """One probe per criterion of a request, within its account if it has one."""
    none = F.array().cast("array<string>")

    def pieces(run: Column) -> Column:
        size = _piece_length(run)
        starts = F.sequence(F.lit(1), F.length(run) - size + 1)
        return F.transform(starts, lambda start: _name_probe(F.substring(run, start, size)))

    probes = F.concat(
        F.coalesce(F.flatten(F.transform(_runs(), pieces)), none),
        F.coalesce(F.transform("r_tags", _tag_probe), none),
        F.coalesce(F.array_compact(F.array(_domain_probe(F.col("r_domain")))), none),
        F.coalesce(F.array_compact(F.array(_type_probe(F.col("r_type")))), none),
    )
    # A name of wildcards alone leaves nothing to go by, and matches any name.
    probes = F.when(F.size(probes) > 0, probes).otherwise(F.array(F.lit(ANY_PROBE)))
    scoped = F.transform(probes, lambda probe: _within(F.col("r_account_id"), probe))
    return F.array_distinct(
        F.when(F.col("r_account_id").isNull(), probes).otherwise(scoped)
    )


def _offered(entities: DataFrame, used: _Forms, *columns: str) -> DataFrame:
    """Every probe an entity offers that has a form in use, each once: pieces of
    the lengths searched for, and probes alone or within the account.

    The probes are numbered: pieces of the name by place and length, then tags,
    then domain, type and the probe every entity has. One sequence of numbers
    per entity is exploded, and each number is turned into its probe.
    """
    name, tags, slot = F.col("name"), F.col("_tags"), F.col("_slot")
    pieces, labels = F.col("_pieces"), F.col("_labels")
    kinds = F.greatest(F.size("_sizes"), F.lit(1))
    start = F.floor(slot / kinds).cast("int") + 1
    size = F.get("_sizes", slot % kinds)
    piece = F.substring(name, start, size)
    # A piece that occurs again, or is cut short by the end, is offered elsewhere.
    first_of_its_kind = (F.length(piece) == size) & (F.instr(name, piece) == start)
    probe = (
        F.when(slot < pieces, _name_probe(piece))
        .when(slot < pieces + labels, _tag_probe(F.get(tags, slot - pieces)))
        .when(slot == pieces + labels, _domain_probe(F.col("domain")))
        .when(slot == pieces + labels + 1, _type_probe(F.col("type")))
        .otherwise(F.lit(ANY_PROBE))
    )
    forms = F.array_compact(
        F.array(
            F.when(used.plain, F.col("probe")),
            F.when(used.scoped, _within(F.col("account_id"), F.col("probe"))),
        )
    )
    return (
        entities.withColumn("_tags", F.array_distinct("tags"))
        .withColumn("_sizes", used.sizes)
        .withColumn("_pieces", F.coalesce(F.length(name) * F.size("_sizes"), F.lit(0)))
        .withColumn("_labels", F.coalesce(F.size("_tags"), F.lit(0)))
        .withColumn("_slot", F.explode(F.sequence(F.lit(0), pieces + labels + 2)))
        .filter((slot >= pieces) | first_of_its_kind)
        .withColumn("probe", probe)
        .select(*columns, F.explode(forms).alias("probe"))
    )
