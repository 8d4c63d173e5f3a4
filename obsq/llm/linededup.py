"""Line dedup: lines that many documents share, as keep bitmaps per document.

One row per document and distinct line key (a 128-bit hash, the positions of the
key) is dealt by ranges of (hash, document), so that the rows of one very common
line spread over as many partitions as they fill. Within a partition the rows
stream by in order; a key's occurrences are held only until they reach the
threshold. A key whose rows go on in a neighbouring partition and are too few
here is left open: at most two keys a partition with fewer rows than the
threshold each, decided by adding up the partitions' counts. Texts do not travel
with the lines: the result is a compressed bitmap for each document that loses
lines.

Defined cases: a null or empty text is one empty line, which has no key and
stays. A row is a document: equal rows count each. Keys of fewer than
``min_chars`` code points are never dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from obsq.llm.common import SPACES, map_texts, row_key, store

MIN_DOCS = 10
MIN_CHARS = 1
_STRIP = SPACES.encode()


def line_key(line: bytes) -> bytes:
    """Stripped of white space, A-Z in lower case."""
    return line.strip(_STRIP).lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars


def _key_rows(docs: DataFrame, text: str, id_column: str, min_chars: int) -> DataFrame:
    """``row, salt, hash, places``: one row per document and distinct key."""

    def per_text(texts: list[str]) -> list[list]:
        out = []
        for t in texts:
            places: dict[bytes, list[int]] = {}
            for i, line in enumerate(t.encode("utf-8", "surrogatepass").split(b"\n")):
                key = line_key(line)
                if key and _long_enough(key, min_chars):
                    places.setdefault(key, []).append(i)
            out.append(
                [
                    {"hash": xxhash.xxh3_128_digest(k), "places": np.array(p, "<u4").tobytes()}
                    for k, p in places.items()
                ]
            )
        return [out]

    keyed = map_texts(
        docs, text, [row_key(id_column, text).alias("row")],
        "keys array<struct<hash: binary, places: binary>>", per_text,
    )
    return keyed.select("row", F.explode("keys").alias("key")).select("row", "key.hash", "key.places")


def _decided(min_docs: int):
    """Rows of a partition in order of hash -> ``row, hash, places, n``.

    ``n`` is 0 for a place to drop, -1 for one of an open key, and the count of an
    edge key in this partition in a row of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.string()), ("hash", pa.binary()), ("places", pa.binary()), ("n", pa.int64())])
        current, count, first, held = None, 0, True, []
        out: list[tuple] = []

        def close(edge: bool) -> None:
            if edge and current is not None:
                if count < min_docs:
                    out.extend((row, current, places, -1) for row, places in held)
                out.append((None, current, None, count))

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        for batch in batches:
            for row, key, places in zip(*(batch.column(n).to_pylist() for n in ("row", "hash", "places"))):
                if key != current:
                    close(first)
                    first = current is None
                    current, count, held = key, 0, []
                count += 1
                if count >= min_docs:
                    out.extend((r, key, p, 0) for r, p in held)
                    held = []
                    out.append((row, key, places, 0))
                else:
                    held.append((row, places))
            yield emit()
            out.clear()
        close(True)
        yield emit()

    return run


def dropped_places(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id",
    min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
) -> DataFrame:
    """``row, places``: the lines of a document whose keys are in ``min_docs`` documents or more."""
    keyed = store(_key_rows(docs, text, id_column, min_chars))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "hash", "row").sortWithinPartitions("hash", "row")
    decided = store(
        ordered.mapInArrow(_decided(min_docs), "row string, hash binary, places binary, n long")
    )
    edges = decided.filter("n > 0").groupBy("hash").agg(F.sum("n").alias("docs")).filter(F.col("docs") >= min_docs)
    late = decided.filter("n = -1").join(edges, "hash", "left_semi")
    return decided.filter("n = 0").select("row", "places").unionByName(late.select("row", "places"))


def _bitmap(n_lines: int, dropped: np.ndarray) -> bytes:
    keep = np.ones(-(-n_lines // 8) * 8, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def keep_bitmaps(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id",
    min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
) -> DataFrame:
    """``row, bitmap`` for each document that loses lines; the others have no row.

    ``row`` is the key of the document (id and text), ``bitmap`` the packed bits of
    its lines, 1 for a line that stays, padded to whole bytes and deflated.
    """
    places = dropped_places(docs, text, id_column, min_docs, min_chars)
    # equal rows bring their places several times; the bits are set once
    gathered = places.groupBy("row").agg(F.collect_set("places").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for parts in batch.column("places").to_pylist():
                dropped = np.concatenate([np.frombuffer(p, "<u4") for p in parts])
                # lines after the last dropped one stay, whatever their number
                maps.append(_bitmap(int(dropped.max()) + 1, dropped))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(maps, pa.binary())], ["row", "bitmap"])

    return gathered.mapInArrow(run, "row string, bitmap binary")


def apply_bitmap(text: str, bitmap: bytes | None) -> tuple[int, int, str]:
    """Lines, dropped lines and the text that stays. Lines past the bitmap stay."""
    n_lines = text.count("\n") + 1
    if bitmap is None:
        return n_lines, 0, text
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).astype(bool)
    lines = text.split("\n")
    left = [line for i, line in enumerate(lines) if i >= len(keep) or keep[i]]
    return n_lines, n_lines - len(left), "\n".join(left)


def line_dedup(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id",
    min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep: list | None = None,
) -> DataFrame:
    """Columns ``keep`` (the id) with ``n_lines, n_dropped, kept_text`` of every row."""
    maps = store(keep_bitmaps(docs, text, id_column, min_docs, min_chars))
    chosen = docs.select(
        *(keep or [id_column]), row_key(id_column, text).alias("_row"), F.col(text).alias("_whole")
    )
    joined = chosen.join(maps.withColumnRenamed("row", "_row"), "_row", "left")
    kept = [c for c in joined.columns if c not in ("_row", "_whole", "bitmap")]
    return joined.select(
        *kept, F.struct("_whole", "bitmap").alias("_pair")
    ).transform(_apply, kept)


def _apply(rows: DataFrame, kept: list[str]) -> DataFrame:
    fields = [f for f in rows.schema.fields if f.name in kept]
    out = StructType(
        fields + [StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept_text", StringType())]
    )
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                made = [apply_bitmap(p["_whole"] or "", p["bitmap"]) for p in part.column("_pair").to_pylist()]
                columns = [part.column(f.name).cast(arrow.field(i).type) for i, f in enumerate(fields)]
                columns += [
                    pa.array([m[i] for m in made], arrow.field(len(fields) + i).type) for i in range(3)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(run, out)


def line_dedup_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row."""
    return line_dedup(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def drop_shared_lines(docs: DataFrame) -> DataFrame:
    """The documents without the lines many of them share, columns as they came.

    A document that loses lines has its new text and ``n_chars``; one that loses
    all of them stays, empty. A null text stays null.
    """
    names = docs.columns
    done = line_dedup(docs, keep=[F.struct(*names).alias("_doc")])
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("_doc.text"))
    fresh = {"text": text}
    if "n_chars" in names:
        fresh["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept_text")).otherwise(
            F.col("_doc.n_chars")
        ).cast(docs.schema["n_chars"].dataType)
    return done.select(*[fresh.get(n, F.col("_doc").getField(n)).alias(n) for n in names])
