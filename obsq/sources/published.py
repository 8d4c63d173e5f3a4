"""Folders of tables that change in whole steps.

Rows are staged as Parquet files under ``parts``, which nobody reads yet. One small
manifest under ``versions`` then names the parts that make up the next version, so
a reader sees all of a step or nothing of it, whatever is lost on the way. Of two
writers that start from one version, the second finds the next version taken and
starts over from it. Files of older versions stay until `vacuum`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from obsq.sources.files import SharedFiles


class PublishConflict(RuntimeError):
    """Another writer published the next version first."""


@dataclass(frozen=True)
class Part:
    """A folder of Parquet files; ``kind`` says what they hold, ``number`` orders them."""

    kind: str
    path: str
    number: int = 0


@dataclass(frozen=True)
class Version:
    number: int = 0
    parts: tuple[Part, ...] = ()
    batches: Mapping[str, int] = field(default_factory=dict)
    """The name of every batch ever applied, with its number."""

    def of_kind(self, *kinds: str) -> list[Part]:
        return [part for part in self.parts if part.kind in kinds]


class Published:
    """The versions of one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._files = SharedFiles(spark, self.root)

    def current(self) -> Version:
        """The latest version; an empty one where nothing was published."""
        numbers = self._numbers()
        return self.version(numbers[-1]) if numbers else Version()

    def version(self, number: int) -> Version:
        content = json.loads(self._files.read(f"versions/{number:010d}.json"))
        return Version(
            number, tuple(Part(**part) for part in content["parts"]), content["batches"]
        )

    def _numbers(self) -> list[int]:
        return [int(name[:-5]) for name in self._files.names("versions") if name.endswith(".json")]

    def stage(self, rows: DataFrame, kind: str, number: int = 0, **options: str) -> Part:
        """Write rows to a folder of their own, for a version to name."""
        part = Part(kind, f"parts/{kind}-{uuid.uuid4().hex}", number)
        rows.write.options(**options).parquet(f"{self.root}/{part.path}")
        return part

    def publish(
        self, base: Version, parts: Sequence[Part], batches: Mapping[str, int] | None = None
    ) -> Version:
        """Make ``parts`` the version after ``base``."""
        after = Version(base.number + 1, tuple(parts), dict(batches or base.batches))
        content = {"parts": [vars(part) for part in after.parts], "batches": dict(after.batches)}
        name = f"versions/{after.number:010d}.json"
        if not self._files.create(name, json.dumps(content), f"staged-{uuid.uuid4().hex}"):
            raise PublishConflict(f"version {after.number} was published by another writer")
        return after

    def open(self, parts: Sequence[Part], schema: StructType) -> DataFrame:
        """The rows of some parts, and only of these."""
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p.path}" for p in parts])

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all but the last ``keep`` versions and the parts that only they name.

        Parts that were staged and not published yet go as well, so no writer may
        be at work.
        """
        numbers = self._numbers()
        kept = numbers[-keep:] if keep > 0 else []
        named = {part.path for number in kept for part in self.version(number).parts}
        for number in numbers[: len(numbers) - len(kept)]:
            self._files.delete(f"versions/{number:010d}.json")
        unused = [f"parts/{name}" for name in self._files.names("parts") if f"parts/{name}" not in named]
        for path in unused:
            self._files.delete(path)
        return unused
