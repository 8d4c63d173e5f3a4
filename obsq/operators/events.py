"""Counting, faceting, bucketing and comparing events.

Every aggregate takes a list of Spark aggregate Columns, each with an alias.
Facets are column names or aliased Columns, such as an attribute read from JSON.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, TimestampNTZType

from obsq.errors import RequestError

EPOCH = datetime(1970, 1, 1)
#: Buckets made from one row at a time when gaps are filled.
BLOCK = 4096


def attribute(name: str, props: str = "props") -> Column:
    """An event attribute kept in JSON text, as a facet or inside an aggregate."""
    if "'" in name:  # a path cannot name it
        found = F.try_element_at(F.from_json(F.col(props), "map<string, string>"), F.lit(name))
    else:
        found = F.get_json_object(F.col(props), f"$['{name}']")
    return found.alias(name)


def scan_events(
    events: DataFrame,
    event_types: Sequence[str] | None = None,
    begin: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Events of some types in the half-open window from ``begin`` to ``end``.

    Both conditions reach the files. On a table laid out by ``event_date`` the
    window also skips whole days.
    """
    rows = events
    if event_types is not None:
        if not event_types:
            raise RequestError("the list of event types is empty")
        rows = rows.filter(F.col("event_type").isin(list(event_types)))
    if begin is not None and end is not None and begin >= end:
        raise RequestError(f"the window is empty: {begin} to {end}")
    by_day = "event_date" in events.columns
    if begin is not None:
        rows = rows.filter(F.col("ts") >= _instant(events, begin))
        if by_day:
            rows = rows.filter(F.col("event_date") >= F.lit(begin.date()))
    if end is not None:
        rows = rows.filter(F.col("ts") < _instant(events, end))
        if by_day:
            # a window that ends at midnight needs nothing of the day that begins
            rows = rows.filter(F.col("event_date") <= F.lit((end - timedelta(microseconds=1)).date()))
    return rows


def facet(events: DataFrame, aggregates: Sequence[Column], facets: Sequence[str | Column]) -> DataFrame:
    """Aggregates per combination of facet values; over all rows without facets."""
    return events.groupBy(*facets).agg(*aggregates)


def facet_with_total(
    events: DataFrame, aggregates: Sequence[Column], facets: Sequence[str | Column]
) -> DataFrame:
    """Faceted rows and, marked by ``is_total``, one row over everything.

    The total is computed from the events, so it is also right for averages and
    distinct counts.
    """
    keyed, names = _named(events, facets)
    if not names:
        raise RequestError("a total beside facets needs a facet")
    return (
        keyed.groupingSets([names, []], *names)
        .agg(F.grouping(names[0]).cast("int").alias("is_total"), *aggregates)
    )


def timeseries(
    events: DataFrame,
    aggregates: Sequence[Column],
    bucket: timedelta,
    facets: Sequence[str | Column] = (),
    origin: datetime = EPOCH,
) -> DataFrame:
    """Aggregates per time bucket and facet; buckets count from ``origin``.

    Works on a streaming DataFrame too, see :mod:`obsq.streaming`.
    """
    size = _seconds(bucket)
    offset = int((origin - EPOCH).total_seconds()) % size
    keyed, names = _named(events, facets)
    slot = F.window("ts", f"{size} seconds", f"{size} seconds", f"{offset} seconds")
    grouped = keyed.groupBy(slot.alias("slot"), *names).agg(*aggregates)
    rest = [c for c in grouped.columns if c != "slot"]
    return grouped.select(
        F.col("slot.start").alias("bucket_start"), F.col("slot.end").alias("bucket_end"), *rest
    )


def timeseries_filled(
    events: DataFrame,
    aggregates: Sequence[Column],
    bucket: timedelta,
    begin: datetime,
    end: datetime,
    facets: Sequence[str | Column] = (),
    origin: datetime = EPOCH,
    zero: bool = True,
    total: bool = False,
) -> DataFrame:
    """As :func:`timeseries` over a window, with rows for empty buckets.

    In these, measures are zero, or without ``zero`` only those that are never
    null, which counts are; the others are null.

    Every facet value seen in the window gets every bucket of it. The events are
    read once: gaps are filled between the buckets that were found, in a window
    that holds one row per bucket of a facet value, not one per event. A gap is
    cut into blocks, which are dealt to all tasks before they become buckets.

    With ``total`` and facets there is one more row over everything, from the same
    scan, and rows are marked by ``is_total``.
    """
    scanned = scan_events(events, None, begin, end)
    names = _names(events, facets)
    size = _seconds(bucket)
    if total:
        found = _buckets_with_total(scanned, aggregates, size, facets, origin)
        names = [*names, "is_total"]
    else:
        found = timeseries(scanned, aggregates, bucket, facets, origin)
    measures = [c for c in found.columns if c not in ("bucket_start", "bucket_end", *names)]
    first = _slot_of(events, begin, size, origin)
    last = _slot_of(events, end - timedelta(microseconds=1), size, origin)
    step = _interval(size)
    if names:
        within = Window.partitionBy(*names).orderBy("bucket_start")
        before = F.lag("bucket_start").over(within)
        behind = F.lead("bucket_start").over(within)
        # A bucket stands for the gap behind it, the first one also for that before.
        spread = found.withColumn(
            "_from", F.when(before.isNull(), first).otherwise(F.col("bucket_start"))
        ).withColumn("_to", F.coalesce(behind - step, last))
        if total:
            # the total stands for one bucket, which is none
            spread = spread.withColumn("_to", F.when(F.col("is_total") == 1, first).otherwise(F.col("_to")))
        slots = _each_slot(spread, size)
    else:
        whole = events.sparkSession.range(1).select(first.alias("_from"), last.alias("_to"))
        spine = _each_slot(whole, size).select("_slot")
        slots = spine.join(found, F.col("_slot") == F.col("bucket_start"), "left")
    fields = {f.name: f for f in found.schema}
    counts = [m for m in measures if not fields[m].nullable and isinstance(fields[m].dataType, NumericType)]
    empty = {m: F.lit(0 if zero or m in counts else None) for m in measures}
    own, start, end_ = F.col("_slot") == F.col("bucket_start"), F.col("_slot"), F.col("_slot") + step
    if total:
        overall = F.col("is_total") == 1
        own, start, end_ = own | overall, F.when(~overall, start), F.when(~overall, end_)
    return slots.select(
        start.alias("bucket_start"),
        end_.alias("bucket_end"),
        *names,
        *[F.when(own, F.col(m)).otherwise(empty[m]).alias(m) for m in measures],
    )


def _buckets_with_total(
    events: DataFrame, aggregates: Sequence[Column], size: int, facets: Sequence[str | Column], origin: datetime = EPOCH
) -> DataFrame:
    """Time buckets and facets, and one row over everything, marked by ``is_total``."""
    offset = int((origin - EPOCH).total_seconds()) % size
    placed = events.withColumn("_slot", F.window("ts", f"{size} seconds", f"{size} seconds", f"{offset} seconds"))
    ends = [F.col(f"_slot.{end}").alias(f"bucket_{end}") for end in ("start", "end")]
    return facet_with_total(placed, aggregates, [*ends, *facets])


def _each_slot(spans: DataFrame, size: int) -> DataFrame:
    """A row for each bucket ``_slot`` from ``_from`` to ``_to``, by way of blocks of buckets."""
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = spans.withColumn(
        "_block", F.explode(F.sequence("_from", "_to", _interval(size * BLOCK)))
    ).repartition(parts, "_block", "_from", "_to")
    block_end = F.least(F.col("_to"), F.col("_block") + _interval(size * (BLOCK - 1)))
    return blocks.withColumn("_slot", F.explode(F.sequence("_block", block_end, _interval(size))))


def compare(
    events: DataFrame,
    aggregates: Sequence[Column],
    begin: datetime,
    end: datetime,
    back: timedelta,
    facets: Sequence[str | Column] = (),
    bucket: timedelta | None = None,
    origin: datetime = EPOCH,
    total: bool = False,
) -> DataFrame:
    """Aggregates of a window beside those of the same window ``back`` earlier.

    Gives ``current_x`` and ``previous_x`` for each aggregate x, null where a
    period has no rows. Earlier events are moved forward by ``back`` before they
    are bucketed. Both periods come from one scan, and so does, with ``total``, one
    more row over everything; rows are then marked by ``is_total``.
    """
    if back <= timedelta(0):
        raise RequestError("the comparison window must lie before the current one")
    shift = F.make_dt_interval(
        F.lit(back.days), F.lit(0), F.lit(0), F.lit(back.seconds + back.microseconds / 1_000_000)
    )
    scanned = scan_events(events, None, begin - back, end)
    if "event_date" in events.columns and end - back < begin:
        # the days between the two windows are not read
        scanned = scanned.filter(
            (F.col("event_date") <= F.lit((end - back - timedelta(microseconds=1)).date()))
            | (F.col("event_date") >= F.lit(begin.date()))
        )
    ts = F.col("ts")
    in_current = ts >= _instant(events, begin)
    in_previous = ts < _instant(events, end - back)
    as_current = F.struct(F.lit("current").alias("period"), ts.alias("ts"))
    as_previous = F.struct(F.lit("previous").alias("period"), (ts + shift).alias("ts"))
    if end - back > begin:
        # The windows overlap, and an event in both counts in both.
        none = F.array().cast(scanned.select(F.array(as_current)).schema[0].dataType)
        placed = F.explode(
            F.concat(
                F.when(in_current, F.array(as_current)).otherwise(none),
                F.when(in_previous, F.array(as_previous)).otherwise(none),
            )
        )
        tagged = scanned.withColumn("_place", placed)
    else:
        tagged = scanned.filter(in_current | in_previous).withColumn(
            "_place", F.when(in_current, as_current).otherwise(as_previous)
        )
    tagged = tagged.withColumn("period", F.col("_place.period")).withColumn(
        "ts", F.col("_place.ts")
    ).drop("_place")

    names = _names(events, facets)
    by_period = [*facets, F.col("period")]
    if total:
        summed, keys = _periods_with_total(tagged, aggregates, facets, bucket, origin)
    elif bucket is None:
        summed = facet(tagged, aggregates, by_period)
        keys = names
    else:
        summed = timeseries(tagged, aggregates, bucket, by_period, origin)
        keys = ["bucket_start", "bucket_end", *names]
    measures = [c for c in summed.columns if c not in (*keys, "period")]
    return summed.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("period") == period, F.col(m))).alias(f"{period}_{m}")
            for m in measures
            for period in ("current", "previous")
        ]
    )


def _periods_with_total(
    tagged: DataFrame, aggregates: Sequence[Column], facets: Sequence[str | Column],
    bucket: timedelta | None, origin: datetime,
) -> tuple[DataFrame, list[str]]:
    """Aggregates by period, facets and buckets, and by period alone; and the keys besides the period."""
    keyed, keys = _named(tagged, facets)
    if bucket is not None:
        size = _seconds(bucket)
        offset = int((origin - EPOCH).total_seconds()) % size
        slot = F.window("ts", f"{size} seconds", f"{size} seconds", f"{offset} seconds")
        keyed = keyed.withColumn("_slot", slot).withColumns(
            {f"bucket_{end}": F.col(f"_slot.{end}") for end in ("start", "end")}
        )
        keys = ["bucket_start", "bucket_end", *keys]
    is_total = F.grouping(keys[0]).cast("int").alias("is_total")
    summed = keyed.groupingSets([[*keys, "period"], ["period"]], *keys, "period").agg(is_total, *aggregates)
    return summed, [*keys, "is_total"]


def describe(
    events: DataFrame,
    event_types: Sequence[str] | None = None,
    facets: Sequence[str | Column] = (),
    begin: datetime | None = None,
    end: datetime | None = None,
    back: timedelta | None = None,
) -> DataFrame:
    """One row about a query: the event types it found, facets and window.

    Event types are made distinct in parallel first; the list holds one short
    name per type, not per event.
    """
    scanned = scan_events(events, event_types, begin, end)
    found = scanned.select("event_type").distinct()
    ts_type = events.schema["ts"].dataType

    def moment(value: datetime | None) -> Column:
        return F.lit(value.isoformat(sep=" ") if value else None).cast(ts_type)

    compared = begin - back if begin is not None and back is not None else None
    return found.agg(F.sort_array(F.collect_list("event_type")).alias("event_types")).select(
        "event_types",
        F.array([F.lit(n) for n in _names(events, facets)]).cast("array<string>").alias("facets"),
        moment(begin).alias("window_begin"),
        moment(end).alias("window_end"),
        moment(compared).alias("compare_with"),
    )


@dataclass(frozen=True)
class EventQuery:
    """One question to the events, as plain arguments.

    ``rows`` picks the form that fits: counts, facets, buckets, filled buckets
    or a comparison. ``total`` and ``metadata`` describe the same question.
    """

    events: DataFrame
    aggregates: Sequence[Column]
    event_types: Sequence[str] | None = None
    begin: datetime | None = None
    end: datetime | None = None
    facets: Sequence[str | Column] = field(default_factory=tuple)
    bucket: timedelta | None = None
    compare_back: timedelta | None = None
    fill: bool = False

    def __post_init__(self):
        if not self.aggregates:
            raise RequestError("an event query needs an aggregate")
        if self.fill and (self.bucket is None or self.compare_back is not None):
            raise RequestError("only time buckets of a single window can be filled")
        windowed = self.begin is not None and self.end is not None
        if (self.fill or self.compare_back is not None) and not windowed:
            raise RequestError("filling and comparing need a begin and an end")

    @property
    def _of_types(self) -> DataFrame:
        return scan_events(self.events, self.event_types)

    @property
    def _in_window(self) -> DataFrame:
        return scan_events(self.events, self.event_types, self.begin, self.end)

    @property
    def rows(self) -> DataFrame:
        if self.compare_back is not None:
            return compare(
                self._of_types, self.aggregates, self.begin, self.end,
                self.compare_back, self.facets, self.bucket,
            )
        if self.bucket is None:
            return facet(self._in_window, self.aggregates, self.facets)
        if self.fill:
            return timeseries_filled(
                self._of_types, self.aggregates, self.bucket, self.begin, self.end, self.facets,
                zero=False,
            )
        return timeseries(self._in_window, self.aggregates, self.bucket, self.facets)

    @property
    def total(self) -> DataFrame:
        return facet(self._in_window, self.aggregates, [])

    @property
    def with_total(self) -> DataFrame:
        """``rows`` and, marked by ``is_total``, the same question without facets and buckets."""
        if self.fill or self.compare_back is not None:
            if self.bucket is None and not self.facets:
                raise RequestError("a total beside facets needs a facet")
            if self.compare_back is not None:
                return compare(
                    self._of_types, self.aggregates, self.begin, self.end,
                    self.compare_back, self.facets, self.bucket, total=True,
                )
            if self.facets:
                return timeseries_filled(
                    self._of_types, self.aggregates, self.bucket, self.begin, self.end, self.facets,
                    zero=False, total=True,
                )
            # without facets the buckets are made apart from the events, and the total beside them
            return self.rows.withColumn("is_total", F.lit(0)).unionByName(
                self.total.withColumn("is_total", F.lit(1)), allowMissingColumns=True
            )
        if self.bucket is None:
            return facet_with_total(self._in_window, self.aggregates, self.facets)
        return _buckets_with_total(self._in_window, self.aggregates, _seconds(self.bucket), self.facets)

    @property
    def metadata(self) -> DataFrame:
        return describe(
            self.events, self.event_types, self.facets, self.begin, self.end, self.compare_back
        )


def _instant(events: DataFrame, value: datetime) -> Column:
    """A literal of the type of ``ts``, so that the comparison reaches the files."""
    return F.lit(value.isoformat(sep=" ")).cast(events.schema["ts"].dataType)


def _interval(seconds: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def _slot_of(events: DataFrame, value: datetime, size: int, origin: datetime) -> Column:
    """The start of the bucket of a moment; instants are placed on the grid in UTC, as ``window`` does."""
    if events.schema["ts"].dataType == TimestampNTZType():
        return _instant(events, _floor(value, size, origin))
    offset = int((origin - EPOCH).total_seconds()) * 1_000_000
    micros = F.unix_micros(_instant(events, value))
    return F.timestamp_micros(micros - F.pmod(micros - F.lit(offset), F.lit(size * 1_000_000)))


def _seconds(bucket: timedelta) -> int:
    size = int(bucket.total_seconds())
    if size < 1 or timedelta(seconds=size) != bucket:
        raise RequestError(f"a bucket is a positive number of whole seconds, not {bucket}")
    return size


def _floor(value: datetime, size: int, origin: datetime) -> datetime:
    return origin + (value - origin) // timedelta(seconds=size) * timedelta(seconds=size)


def _names(events: DataFrame, facets: Sequence[str | Column]) -> list[str]:
    return events.select(*facets).columns if facets else []


def _named(events: DataFrame, facets: Sequence[str | Column]) -> tuple[DataFrame, list[str]]:
    """The events with computed facets as columns, and the facets' names."""
    names = _names(events, facets)
    for name, value in zip(names, facets):
        if isinstance(value, Column):
            events = events.withColumn(name, value)
    return events, names
