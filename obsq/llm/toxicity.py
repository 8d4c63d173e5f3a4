"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned too: words and word beginnings that occur far more often
in toxic documents than in others. Labelled rows are dealt by a hash of their id
into three parts, so that no model is fitted on texts that shaped its inputs:
one for the lexicon, one for the trees, one for the calibration. Each part is
bounded by ``SAMPLE``; scoring reads every whole text once and shuffles nothing.

Defined cases: a null or empty text scores by its all-zero features. Repeated
rows score alike. Without labels of both classes the score is 0.5 times nothing:
the share of toxic labels, or 0 without any. Neither label, language, source nor
id is an input.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsq.llm import boosting
from obsq.llm.common import labelled_sample, map_texts

#: Most labelled rows all three fits take together.
SAMPLE = 30_000
#: Most entries of the lexicon, and what an entry needs.
LEXICON = 4_000
MIN_TOXIC = 6
MIN_LOG_ODDS = 1.5
#: Word beginnings of these lengths are entries as well.
STEMS = (4, 5, 6, 7)

# Second-person words of four languages, and characters that
# stand for letters in disguised words.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre"
    " usted tú ti tus vosotros".split()
)
DISGUISE = str.maketrans("0134578@$!", "oieastbasi")

FEATURES = (
    "hits_per_word", "weight_per_word", "max_weight", "distinct_hits", "stem_hits_per_word",
    "stem_max_weight", "stem_distinct", "disguised_hits", "second_person_share", "near_second_person",
    "caps_word_share", "upper_share", "exclaim_per_word", "punctuation_share", "obfuscated_share",
    "log_words",
)
MONOTONE = {"hits_per_word": 1, "max_weight": 1, "stem_max_weight": 1, "distinct_hits": 1}
_WORDS = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_]+[0134578@$!*][^\W\d_]+")


class Lexicon(NamedTuple):
    words: dict[str, float]
    stems: dict[str, float]


class ToxicModel(NamedTuple):
    lexicon: Lexicon
    forest: boosting.Forest
    points: tuple[np.ndarray, np.ndarray]


def held_out(id_column: str = "doc_id") -> Column:
    """True for the fold labels are never learned from; null ids are held out too."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def entries_of(text: str) -> list[str]:
    """The distinct lexicon entries a text could hit: words, and stems with a dash."""
    words = set(_WORDS.findall(text.lower()))
    stems = {w[:k] + "-" for w in words for k in STEMS if len(w) > k}
    return list(words | stems)


def learn_lexicon(sample: DataFrame, text: str = "text", size: int = LEXICON) -> Lexicon:
    """Entries with the largest log-odds of a toxic label, at most ``size`` of them."""
    def per_text(texts: list[str]) -> list[list]:
        return [[entries_of(t) for t in texts]]

    found = map_texts(sample, text, ["_label"], "entries array<string>", per_text)
    totals = sample.agg(F.sum("_label").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = float(totals["t"] or 0), float(totals["n"] - (totals["t"] or 0))
    if not toxic or not clean:
        return Lexicon({}, {})
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    top = (
        found.select("_label", F.explode("entries").alias("entry"))
        .groupBy("entry").agg(F.sum("_label").alias("t"), F.count("*").alias("n"))
        .filter(F.col("t") >= MIN_TOXIC).withColumn("odds", odds)
        .filter(F.col("odds") >= MIN_LOG_ODDS)
        .orderBy(F.desc(F.col("odds") * F.sqrt("t")), "entry").limit(size)
    ).collect()
    return Lexicon(
        {r["entry"]: r["odds"] for r in top if not r["entry"].endswith("-")},
        {r["entry"][:-1]: r["odds"] for r in top if r["entry"].endswith("-")},
    )


def features(text: str, lexicon: Lexicon) -> list[float]:
    lowered = text.lower()
    words = _WORDS.findall(lowered)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    distinct = set(words)
    hits = {w: lexicon.words[w] for w in distinct & lexicon.words.keys()}
    stem_hits: dict[str, float] = {}
    for w in distinct:
        for k in STEMS:
            if len(w) > k and (weight := lexicon.stems.get(w[:k])) is not None:
                stem_hits[w] = max(weight, stem_hits.get(w, 0.0))
    marked = hits.keys() | stem_hits.keys()
    spots = [i for i, w in enumerate(words) if w in marked] if marked else []
    total = sum(hits.get(words[i], 0.0) for i in spots)
    disguised = 0
    unusual = 0
    for token in _MIXED.findall(lowered):
        unusual += 1
        disguised += token.translate(DISGUISE).replace("*", "") in lexicon.words
    persons = [i for i, w in enumerate(words) if w in SECOND_PERSON] if distinct & SECOND_PERSON else []
    near = 0
    if spots and persons:
        at = np.searchsorted(persons, spots)
        p = np.array([-99, *persons, 10**9])
        near = int(np.minimum(np.array(spots) - p[at], p[at + 1] - np.array(spots)).__le__(5).sum())
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    marks = int((((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64))).sum())
    caps = sum(map(str.isupper, text.split()))
    return [
        sum(words[i] in hits for i in spots) / n,
        total / n,
        max(hits.values(), default=0.0),
        float(len(hits)),
        sum(words[i] in stem_hits for i in spots) / n,
        max(stem_hits.values(), default=0.0),
        float(len(stem_hits)),
        float(disguised),
        len(persons) / n,
        float(near),
        caps / n,
        upper / len(raw),
        text.count("!") / n,
        marks / len(raw),
        unusual / n,
        float(np.log1p(n)),
    ]


def _matrix(rows: DataFrame, text: str, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    def per_text(texts: list[str]) -> list[list]:
        return [[features(t, lexicon) for t in texts]]

    got = map_texts(rows, text, ["_label"], "features array<double>", per_text).collect()
    return (
        np.array([r["features"] for r in got]).reshape(-1, len(FEATURES)),
        np.array([r["_label"] for r in got], float),
    )


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", sample: int = SAMPLE
) -> ToxicModel:
    """Lexicon, trees and calibration from labels outside the held-out fold."""
    chosen = labelled_sample(
        docs.select(id_column, text), labels, "toxic", sample, id_column, where=~held_out("_label_id")
    )
    part = F.pmod(F.xxhash64(F.lit("part"), F.col(id_column)), F.lit(20))
    lexicon = learn_lexicon(chosen.filter(part < 9), text)
    x, y = _matrix(chosen.filter((part >= 9) & (part < 16)), text, lexicon)
    forest = boosting.fit(x, y, np.array([MONOTONE.get(name, 0) for name in FEATURES]))
    x, y = _matrix(chosen.filter(part >= 16), text, lexicon)
    points = boosting.isotonic(boosting.raw_scores(forest, x), y)
    return ToxicModel(lexicon, forest, points)


def toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", sample: int = SAMPLE
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    model = fit_toxicity(docs, labels, text, id_column, sample)

    def per_text(texts: list[str]) -> list[list]:
        x = np.array([features(t, model.lexicon) for t in texts]).reshape(-1, len(FEATURES))
        score = boosting.calibrate(model.points, boosting.raw_scores(model.forest, x))
        return [score.tolist(), (score >= 0.5).astype(int).tolist()]

    keep = [F.col(id_column), held_out(id_column).alias("held_out")]
    return map_texts(docs, text, keep, "score double, predicted int", per_text)
