"""Secret scans weighed by who owns a candidate across the corpus.

Each text is scanned once for the base kinds and for further tokens that look
like keys (letters and digits mixed, long, of high entropy). Candidates are
hashed, and the corpus is asked how widely a hash is spread: over how many
documents (each a repository of its own) and how many owners (the sources).
A candidate that ``COPIED_OWNERS`` share is a copied example; one that fewer
have, and that looks random, is taken as live. Only further tokens that
look live become spans of their own; the base spans always stay.

Only candidates are shuffled, counts are summed per task before that, and the
few documents that have candidates are joined to their counts by hash, where AQE
splits a key that very many documents hold.

Defined cases: a null or empty text has no spans. A null source is one owner.
Equal rows are one document. Ties do not arise: spans are ordered by start, kind
and end.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsq.llm.common import map_texts, row_key, store

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
#: Further kind: what a key looks like when nothing names it.
TOKEN = "key"
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}")
MIN_ENTROPY = 3.5
#: A candidate of this many owners or more is a copied example.
COPIED_OWNERS = 3

_CANDIDATE = "struct<kind: string, at: long, upto: long, hash: string, random: boolean>"


def entropy(text: str) -> float:
    """Bits per character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def looks_random(value: str) -> bool:
    digits = sum(c.isdigit() for c in value)
    return entropy(value) >= MIN_ENTROPY or (digits >= 8 and entropy(value) >= 3.0)


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """``kind, start, end, secret`` by start, then kind as listed."""
    out = []
    # all kinds need one of these; most texts have none
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    out += [("hex", m.start(), m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def further_spans(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Key-like tokens that no base span touches."""
    out = []
    for m in _TOKEN.finditer(text):
        value = m.group()
        mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        if mixed and entropy(value) >= MIN_ENTROPY and not any(s < m.end() and m.start() < e for _, s, e, _ in base):
            out.append((TOKEN, m.start(), m.end(), value))
    return out


def _digest(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def _written(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, *_ in spans)


def scan(docs: DataFrame, text: str = "text", keep: list | None = None) -> DataFrame:
    """Columns ``keep`` with base counts, ``base`` (the base spans) and ``candidates``."""

    def per_text(texts: list[str]) -> list[list]:
        columns: list[list] = [[], [], [], [], []]
        for t in texts:
            base = base_spans(t)
            kinds = Counter(kind for kind, *_ in base)
            every = base + further_spans(t, base)
            for column, value in zip(
                columns,
                [
                    *(kinds[k] for k in KINDS),
                    _written(base),
                    [
                        {"kind": k, "at": s, "upto": e, "hash": _digest(v), "random": looks_random(v)}
                        for k, s, e, v in every
                    ],
                ],
            ):
                column.append(value)
        return columns

    schema = f"n_assign long, n_access long, n_hex long, base string, candidates array<{_CANDIDATE}>"
    return map_texts(docs, text, keep or ["doc_id"], schema, per_text)


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash, documents, owners`` from ``row, owner, hash`` rows."""
    return (
        candidates.select("row", "owner", "hash").distinct()
        .groupBy("hash", "owner").agg(F.count("*").alias("documents"))
        .groupBy("hash").agg(F.sum("documents").alias("documents"), F.count("*").alias("owners"))
    )


def find_secrets(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", source: str = "source",
    copied_owners: int = COPIED_OWNERS,
) -> DataFrame:
    """Every row: ``doc_id, n_assign, n_access, n_hex, base, spans, n_live, n_copied``."""
    scanned = store(
        scan(docs, text, [F.col(id_column).alias("doc_id"), F.col(source).alias("owner"), row_key(id_column, text).alias("row")])
    )
    counts = ["doc_id", "n_assign", "n_access", "n_hex", "base"]
    held = store(
        scanned.filter(F.size("candidates") > 0)
        .select("row", "owner", F.explode("candidates").alias("c")).select("row", "owner", "c.*")
    )
    known = store(ownership(held))
    copied = F.col("owners") >= copied_owners
    weighed = held.drop("owner").distinct().join(known, "hash").select(
        "row", "kind", "at", "upto",
        copied.alias("copied"), (~copied & F.col("random")).alias("live"),
    )
    place = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, TOKEN)]), F.col("kind"))
    spans = store(
        weighed.filter(F.col("live") | (F.col("kind") != TOKEN))
        .groupBy("row").agg(
            F.array_sort(
                F.collect_list(F.struct("at", place.alias("place"), "upto", "kind"))
            ).alias("s"),
            F.sum(F.col("live").cast("long")).alias("n_live"),
            F.sum(F.col("copied").cast("long")).alias("n_copied"),
        )
        .select(
            "row", "n_live", "n_copied",
            F.array_join(
                F.transform("s", lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["upto"].cast("string"))), ","
            ).alias("spans"),
        )
    )
    none = F.lit(0).cast("long")
    return scanned.select(*counts, "row").join(spans, "row", "left").select(
        *counts, F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_live", none).alias("n_live"), F.coalesce("n_copied", none).alias("n_copied"),
    )


def secret_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` and the two counts by ownership."""
    return find_secrets(docs).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        "spans", "n_live", "n_copied",
    )
