"""Personal data by weak supervision, in SQL functions only.

Patterns propose spans: the base kinds, which always stay, and looser further
kinds. Three labelers vote on each: its form (check digits, ranges), a gazetteer
(top-level domains, country codes, issuer prefixes), and its context (words
before it, another span close by). Expectation-maximisation estimates how
reliable each labeler is and how likely each kind is to be real, and a logistic
classifier trained on those estimates judges the further spans.

The corpus is read once, into a written table of proposed spans. What the fit
needs from it is the number of spans per kind and combination of votes, at most
``len(KINDS) * 16`` rows whatever the corpus, counted by Spark; the fit itself is
arithmetic on these counts.

Positions come from splitting a text at a pattern: the lengths of the gaps and
of the matches add up to them. Repeated groups in the patterns are replaced by
masks of equal length (a dot or separator that cannot be inside a match becomes
another character), so that no pattern backtracks or recurses on long texts.

Defined cases: a null or empty text has no spans; repeated rows are judged each;
spans of one text are ordered by kind as listed, then start.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsq.llm.common import store

BASE = ("email", "ip", "card", "phone")
FURTHER = ("number", "national", "ssn")
KINDS = BASE + FURTHER
LABELERS = ("form", "known", "context")

# Patterns of the masked texts (see the module's text), with \G for
# a match that starts where the last one ended.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9][0-9\x20-]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_NATIONAL = r"(?<![0-9A-Za-z+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
_SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
_LOOSE_DOT = r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])"
_LOOSE_SEPARATOR = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"

# The gazetteers and the words of the context labeler.
DOMAINS = "com org net edu gov io info de fr es it uk eu ch at nl pl ru jp cn in br au ca us co".split()
COUNTRY_CODES = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90"
    " 91 92 93 94 95 98 212 213 216 351 352 353 354 358 370 371 372 380 385 386 420 421 852 880 886 971 972"
).split()
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6(?:011|5)"
CONTEXT = (
    "mail|email|e-mail|contact|phone|tel|telefon|téléphone|teléfono|mobile|call|fax|card|credit|visa|mastercard|karte|carte"
    "|tarjeta|account|konto|ssn|social security|ip|host|server|address"
)
#: Code points before a span in which words of context count, and around it another span.
NEAR = 40

_SPAN = "array<struct<at: bigint, upto: bigint, value: string>>"


def _spans(text: Column, pattern: str) -> Column:
    """``at, upto, value`` of the matches, leftmost first, in code points."""
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.length(s).cast("long"))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        upto = at + F.coalesce(F.length(x["hit"]).cast("long"), F.lit(0))
        span = F.struct(at.alias("at"), upto.alias("upto"), x["hit"].alias("value"))
        out = F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span)))
        return F.struct(upto.alias("at"), out.alias("out"))

    return F.aggregate(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), start, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    each = F.transform(
        F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            F.get(F.array(*[F.lit(n) for n in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _octets(value: Column) -> Column:
    def small(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+", "")
        return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), small)


def _is_base(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return _octets(value)
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _form(kind: str, value: Column) -> Column:
    """Vote of the form: what the base kinds check, and the ranges of further kinds."""
    if kind == "number":
        return F.lit(False)  # its check digit is wrong
    if kind == "national":
        return value.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]")
    if kind == "ssn":
        return ~value.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _known(kind: str, value: Column) -> Column:
    """Vote of the gazetteers."""
    if kind == "email":
        return F.element_at(F.split(F.lower(value), r"\."), -1).isin(*DOMAINS)
    if kind == "ip":
        return ~value.rlike(r"^(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^192\.168\.|^169\.254\.")
    if kind in ("card", "number"):
        return value.rlike(f"^(?:{ISSUERS})")
    if kind == "phone":
        return _digits(value).rlike(f"^(?:{'|'.join(COUNTRY_CODES)})")
    return value.rlike(r"[2-9]")


def propose(docs: DataFrame, text: str = "text", keep: list | None = None) -> DataFrame:
    """Columns ``keep`` (the id) of every row with ``spans``, all that any pattern proposes.

    A span has ``kind, at, upto, base, form, known, context, near``.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*(keep or ["doc_id"]), whole.alias("_t"))
    names = rows.columns[:-1]
    t = F.col("_t")
    # what any pattern of numbers needs; most texts stop here after one look
    rows = rows.select(*names, "_t", t.rlike(r"[0-9][0-9\x20().-]{6}").alias("_n"))
    numbers = F.col("_n")
    many_digits = numbers & t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")
    rows = rows.select(
        *names, "_t", "_n",
        F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, _LOOSE_DOT, "%")).alias("_dots"),
        F.when(many_digits, F.regexp_replace(t, _LOOSE_SEPARATOR, "x")).alias("_runs"),
    )
    none = F.array().cast(_SPAN)

    def when(condition: Column, made: Column) -> Column:
        return F.when(condition, made).otherwise(none)

    rows = rows.select(
        *names, "_t",
        when(F.col("_dots").isNotNull(), _spans(F.col("_dots"), _EMAIL)).alias("email"),
        when(numbers & t.rlike(r"[0-9]\.[0-9]+\.[0-9]"), _spans(t, _IP)).alias("ip"),
        when(F.col("_runs").isNotNull(), _spans(F.col("_runs"), _CARD)).alias("card"),
        when(numbers & F.contains(t, F.lit("+")), _spans(t, _PHONE)).alias("phone"),
        when(numbers & t.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"), _spans(t, _NATIONAL)).alias("national"),
        when(numbers & t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), _spans(t, _SSN)).alias("ssn"),
    )

    def judged(kind: str, spans: Column, base: bool) -> Column:
        def mark(s: Column) -> Column:
            before = F.lower(F.substr(t, F.greatest(s["at"] - NEAR + 1, F.lit(1)).cast("int"), F.least(s["at"], F.lit(NEAR)).cast("int")))
            return F.struct(
                F.lit(kind).alias("kind"), s["at"].alias("at"), s["upto"].alias("upto"), F.lit(base).alias("base"),
                _form(kind, s["value"]).alias("form"), _known(kind, s["value"]).alias("known"),
                before.rlike(rf"(?<![\p{{L}}])(?:{CONTEXT})(?![\p{{L}}])").alias("context"),
            )

        return F.transform(spans, mark)

    def touches(s: Column, others: Column) -> Column:
        return F.exists(others, lambda o: (o["at"] < s["upto"]) & (s["at"] < o["upto"]))

    def valid(kind: str) -> Column:
        return F.filter(kind, lambda s: _is_base(kind, s["value"]))

    parts = [judged(k, valid(k), True) for k in BASE]
    loose = F.filter("card", lambda s: F.length(_digits(s["value"])).between(16, 19) & ~_luhn(_digits(s["value"])))
    parts += [
        judged("number", loose, False),
        judged("national", F.filter("national", lambda s: ~touches(s, F.col("phone")) & ~touches(s, F.col("card"))), False),
        judged("ssn", F.filter("ssn", lambda s: ~touches(s, F.col("phone"))), False),
    ]
    # most rows propose nothing, and are done here
    some = F.greatest(*[F.size(k) for k in (*BASE, "national", "ssn")]) > 0
    rows = rows.select(*names, F.when(some, F.concat(*parts)).alias("spans"))

    def beside(s: Column, i: Column) -> Column:
        """Whether the span before or after, by start, is close."""
        last = F.get("spans", i - 1)
        following = F.get("spans", i + 1)
        close = F.coalesce(s["at"] - last["upto"] < NEAR, F.lit(False)) | F.coalesce(following["at"] - s["upto"] < NEAR, F.lit(False))
        return s.withField("near", close)

    def mark_near(rows: DataFrame) -> DataFrame:
        by_start = F.array_sort("spans", lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
        return rows.select(*names, by_start.alias("spans")).select(*names, F.transform("spans", beside).alias("spans"))

    return mark_near(rows)


def vote_counts(proposed: DataFrame) -> list[tuple]:
    """``(kind, form, known, context, near, n)``: a row per combination there is."""
    votes = proposed.select(F.explode("spans").alias("s")).groupBy(
        "s.kind", "s.form", "s.known", "s.context", "s.near"
    ).agg(F.count("*").alias("n"))
    return sorted(tuple(r) for r in votes.collect())


def reliabilities(counts: list[tuple], rounds: int = 50) -> tuple[dict, list[float], list[float]]:
    """EM: the share of real spans by kind, and each labeler's votes given real and not.

    Votes are taken as independent given the truth. Counts are smoothed by one
    vote each way, so that a labeler that never disagrees is not taken as certain.
    """
    share = {row[0]: 0.5 for row in counts}
    yes_real, yes_not = [0.8] * 3, [0.2] * 3
    for _ in range(rounds):
        posterior = [_posterior(row, share, yes_real, yes_not) for row in counts]
        for kind in share:
            n = sum(r[5] for r in counts if r[0] == kind)
            real = sum(p * r[5] for p, r in zip(posterior, counts) if r[0] == kind)
            share[kind] = (real + 1) / (n + 2)
        real = sum(p * r[5] for p, r in zip(posterior, counts))
        every = sum(r[5] for r in counts)
        for j in range(3):
            both = sum(p * r[5] for p, r in zip(posterior, counts) if r[1 + j])
            voted = sum(r[5] for r in counts if r[1 + j])
            yes_real[j] = (both + 1) / (real + 2)
            yes_not[j] = (voted - both + 1) / (every - real + 2)
    return share, yes_real, yes_not


def _posterior(row: tuple, share: dict, yes_real: list[float], yes_not: list[float]) -> float:
    real, other = share[row[0]], 1 - share[row[0]]
    for j in range(3):
        real *= yes_real[j] if row[1 + j] else 1 - yes_real[j]
        other *= yes_not[j] if row[1 + j] else 1 - yes_not[j]
    return real / (real + other)


def _inputs(row: tuple) -> list[float]:
    """Inputs of the classifier: the kind, the votes, another span near, a constant."""
    return [*(float(row[0] == k) for k in KINDS), *(float(v) for v in row[1:5]), 1.0]


def train_classifier(counts: list[tuple], rounds: int = 300, rate: float = 0.5) -> list[float]:
    """Weights of a logistic classifier fitted to the estimated truth of each combination."""
    weights = [0.0] * (len(KINDS) + 5)
    if not counts:
        return weights
    share, yes_real, yes_not = reliabilities(counts)
    every = sum(r[5] for r in counts)
    rows = [(_inputs(r), _posterior(r, share, yes_real, yes_not), r[5] / every) for r in counts]
    for _ in range(rounds):
        slope = [1e-4 * w for w in weights]
        for x, truth, n in rows:
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, x))))
            for i, v in enumerate(x):
                slope[i] += n * (p - truth) * v
        weights = [w - rate * s for w, s in zip(weights, slope)]
    return weights


def _score(s: Column, weights: list[float]) -> Column:
    total = F.lit(weights[-1])
    for k, w in zip(KINDS, weights):
        total = total + F.when(s["kind"] == k, F.lit(w)).otherwise(F.lit(0.0))
    for name, w in zip((*LABELERS, "near"), weights[len(KINDS) :]):
        total = total + F.when(s[name], F.lit(w)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def personal_data(docs: DataFrame, text: str = "text", keep: list | None = None, threshold: float = 0.5) -> DataFrame:
    """Columns ``keep`` (the id) of every row with ``spans`` (``kind, at, upto, base, score``)."""
    proposed = store(propose(docs, text, keep))
    weights = train_classifier(vote_counts(proposed))
    scored = F.transform(
        "spans",
        lambda s: F.struct(s["kind"].alias("kind"), s["at"].alias("at"), s["upto"].alias("upto"), s["base"].alias("base"), _score(s, weights).alias("score")),
    )
    names = [c for c in proposed.columns if c != "spans"]
    kept = F.filter(scored, lambda s: s["base"] | (s["score"] >= threshold))
    kept = F.concat(*[_of_kind(kept, kind) for kind in KINDS])
    return proposed.select(*names, F.coalesce(kept, F.array().cast("array<struct<kind: string, at: bigint, upto: bigint, base: boolean, score: double>>")).alias("spans"))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _written(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["upto"].cast("string"))), ","
    )


def pii_digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts by base kind, ``base_sha256`` and ``spans`` of every row."""
    found = personal_data(docs)
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, BASE), F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )
