"""Ordered pages, cursors and totals."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsq.errors import RequestError


@dataclass(frozen=True)
class Order:
    """A total order: the last key must be unique."""

    keys: tuple[str, ...]
    descending: bool = False

    def columns(self) -> list[Column]:
        return [F.col(k).desc() if self.descending else F.col(k).asc() for k in self.keys]

    def after(self, rows: DataFrame, cursor: Sequence) -> Column:
        """Rows strictly behind the cursor."""
        if len(cursor) != len(self.keys):
            raise RequestError(f"a cursor needs {len(self.keys)} value(s): {self.keys}")
        marks = [_literal(rows, k, v) for k, v in zip(self.keys, cursor)]
        steps = []
        for i, key in enumerate(self.keys):
            equal = [F.col(k) == m for k, m in zip(self.keys[:i], marks)]
            beyond = F.col(key) < marks[i] if self.descending else F.col(key) > marks[i]
            steps.append(reduce(lambda a, b: a & b, [*equal, beyond]))
        # The first key alone bounds the scan, in a form that reaches the files.
        first = F.col(self.keys[0])
        bound = first <= marks[0] if self.descending else first >= marks[0]
        return bound & reduce(or_, steps)


BY_GUID = Order(("guid",))
BY_POLICY = Order(("policy_id",))
NEWEST_INCIDENT = Order(("started_at", "incident_id"), descending=True)


def _literal(rows: DataFrame, key: str, value) -> Column:
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast(rows.schema[key].dataType)


@dataclass(frozen=True)
class Listing:
    """All matching rows in an order, cut to ``limit`` when there is one.

    ``complete`` adds what other tables know about rows, one row each, and is told
    whether they are a page. Totals and cursors do without.
    """

    matches: DataFrame
    order: Order
    limit: int | None = None
    complete: Callable[[DataFrame, bool], DataFrame] | None = None

    def __post_init__(self):
        if self.limit is not None and self.limit <= 0:
            raise RequestError(f"limit must be positive, not {self.limit}")

    @cached_property
    def rows(self) -> DataFrame:
        """The page; without a limit, every match in no particular order."""
        if self.limit is None:
            return self.complete(self.matches, False) if self.complete else self.matches
        page = self._cut(self.matches)
        return self._cut(self.complete(page, True)) if self.complete else page

    def _cut(self, rows: DataFrame) -> DataFrame:
        return rows.orderBy(*self.order.columns()).limit(self.limit)

    @property
    def total(self) -> DataFrame:
        """One row: how many match, before the limit."""
        return self.matches.agg(F.count("*").alias("total_count"))

    def with_total(self) -> DataFrame:
        """The page with the total on each row, as a subquery and not a join."""
        return self.rows.withColumn("total_count", self.total.scalar())

    def after(self, *cursor) -> Listing:
        """The listing behind a cursor, i.e. behind the last row of a page."""
        behind = self.matches.filter(self.order.after(self.matches, cursor))
        return Listing(behind, self.order, self.limit, self.complete)

    @property
    def next_cursor(self) -> DataFrame:
        """One row with the keys of the page's last row; null on the last page.

        One row more than the page is enough to know whether another follows,
        so this handles a page of keys, not the rest of the table.
        """
        if self.limit is None:
            raise RequestError("a listing without a limit has no next page")
        ahead = (
            self.matches.select(*self.order.keys)
            .orderBy(*self.order.columns())
            .limit(self.limit + 1)
            .agg(F.collect_list(F.struct(*self.order.keys)).alias("keys"))
        )
        in_order = F.sort_array("keys", asc=not self.order.descending)
        last = F.when(F.size("keys") > self.limit, F.get(in_order, F.lit(self.limit - 1)))
        return ahead.select(last.alias("last")).select(
            [F.col(f"last.{k}").alias(k) for k in self.order.keys]
        )
