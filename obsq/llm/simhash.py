"""SimHash near-dedup by deletion-variant signatures.

64 bits are cut into three segments. Fingerprints that differ in at most four
bits differ in at most one bit in some segment, so both have one variant of that
segment in common in which one bit is blanked. Every fingerprint is indexed under
its 64 variants (a segment, the blanked bit, the other bits), and candidates are
those that meet under one; all are verified against the whole fingerprints.

Equal texts are one fingerprint, whatever their number. Under a variant, links
are first verified only with its smallest and its largest fingerprint, which is
linear and joins most of a large group of near copies. What is still in different
components then meets under the variants where more than one component is left;
pairs inside one component are never formed, so that a group of copies is not
expanded into its pairs, and no link that matters is lost.

Defined cases: a null or empty text has no shingles and the fingerprint zero. A
null id has no say in which id names a component; a component of null ids only is
named null. Repeated ids are one document in the names, one row each in the
result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsq.llm.common import discard, map_texts, store
from obsq.llm.graph import components

WIDTH = 4
SEED = 42
DISTANCE = 4
#: First bit and length of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))

_WEIGHTS = (np.uint64(1) << np.arange(64, dtype=np.uint64)).astype(np.uint64)


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included; A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist())]
    return np.array(hashes, np.uint64)


def fingerprint(text: str, width: int = WIDTH) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes; no shingles: 0."""
    return majority(shingle_hashes(text, width))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; none of no hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_WEIGHTS[counts * 2 > len(hashes)].sum(dtype=np.uint64))


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def fingerprints(docs: DataFrame, text: str = "text", keep: list | None = None, width: int = WIDTH) -> DataFrame:
    """Columns ``keep`` (the id) with ``fp``, the fingerprint as a signed long."""

    def per_text(texts: list[str]) -> list[list]:
        return [[_signed(fingerprint(t, width)) for t in texts]]

    return map_texts(docs, text, keep or ["doc_id"], "fp long", per_text)


def _variants(fp: Column) -> Column:
    """The 64 variants: (blanked bit, rest of its segment) in one long, bit number on top."""
    out = []
    for first, length in SEGMENTS:
        segment = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << length) - 1))
        for bit in range(length):
            rest = segment.bitwiseAND(F.lit(((1 << length) - 1) & ~(1 << bit)))
            out.append(rest.bitwiseOR(F.lit((first + bit) << 24)))
    return F.array(*out)


def _close(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def near_components(fps: DataFrame) -> DataFrame:
    """``fp, component`` of distinct fingerprints; a component is its smallest fingerprint.

    The rows are stored, for `discard`.
    """
    indexed = store(fps.select("fp", F.explode(_variants(F.col("fp"))).alias("variant")))
    ends = indexed.groupBy("variant").agg(
        F.min("fp").alias("low"), F.max("fp").alias("high")
    ).filter("low < high")
    end = F.explode(F.array("low", "high"))
    stars = (
        indexed.join(
            ends,
            (indexed["variant"] == ends["variant"])
            & ((F.col("fp") != F.col("low")) & _close("fp", "low") | (F.col("fp") != F.col("high")) & _close("fp", "high")),
        )
        .select("fp", end.alias("end"))
        .filter((F.col("fp") != F.col("end")) & _close("fp", "end"))
        .select(F.greatest("fp", "end").alias("a"), F.least("fp", "end").alias("b"))
        .distinct()
    )
    stars = store(stars)
    linked = components(stars)
    found = store(linked)
    placed = store(
        fps.join(found.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", F.coalesce("component", "fp").alias("component"))
    )
    discard(stars, linked, found)
    # variants all of whose fingerprints are joined already need no more looks
    listed = indexed.join(placed, "fp")
    closed = listed.groupBy("variant").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")
    ).filter("low = high AND n > 1").select("variant")
    left = listed.join(closed, "variant", "left_anti")
    one, other = left.alias("one"), left.alias("other")
    late = one.join(
        other,
        (F.col("one.variant") == F.col("other.variant"))
        & (F.col("one.component") < F.col("other.component"))
        & _close("one.fp", "other.fp"),
    ).select(F.col("other.component").alias("a"), F.col("one.component").alias("b")).distinct()
    late = store(late)
    discard(indexed)
    if late.isEmpty():
        discard(late)
        return placed
    linked = components(late)
    merged = linked.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    whole = store(
        placed.join(merged, "component", "left").select("fp", F.coalesce("whole", "component").alias("component"))
    )
    discard(late, linked, placed)
    return whole


def near_dedup(docs: DataFrame, text: str = "text", id_column: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; the smallest id of a component names it."""
    return _grouped(docs, text, [F.col(id_column).alias("id")], width).select(
        F.col("id").alias(id_column), "fp", "component_id"
    )


def _grouped(docs: DataFrame, text: str, keep: list[Column], width: int = WIDTH) -> DataFrame:
    """Columns ``keep``, among them ``id``, with ``fp``, ``component`` (its smallest
    fingerprint) and ``component_id`` (its smallest id) of every row."""
    marked = store(fingerprints(docs, text, keep, width))
    fps = store(marked.groupBy("fp").agg(F.min("id").alias("least")))
    placed = near_components(fps.select("fp"))
    members = store(placed.join(fps, "fp").select("fp", "least", "component"))
    discard(placed)
    names = store(members.groupBy("component").agg(F.min("least").alias("component_id")))
    named = store(members.join(names, "component").select("fp", "component", "component_id"))
    return marked.join(named, "fp")


def near_dedup_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    return near_dedup(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, columns as they came.

    A null id is larger than any; of documents with one id, null or repeated, the
    one with the smaller hash of its text counts as smaller. Equal texts under one
    id are one document, of which one row stays.
    """
    text = F.col("text").cast("string")
    # what tells documents of one id apart
    own = [F.col("doc_id").alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("g")]
    found = _grouped(docs.select("text", "doc_id"), "text", own)
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h", "g")).alias("head")
    heads = store(found.groupBy("component").agg(least).select("head.id", "head.h", "head.g"))
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), *own)
    kept = rows.join(
        heads,
        rows["id"].eqNullSafe(heads["id"]) & (rows["h"] == heads["h"]) & (rows["g"] == heads["g"]),
        "left_semi",
    )
    once = W.partitionBy("id", "h", "g").orderBy(F.xxhash64("_doc"))
    return kept.withColumn("_n", F.row_number().over(once)).filter("_n = 1").select("_doc.*")
