"""Quality rules: boosted trees over document statistics, beside fixed base rules.

Each text is read once, in Arrow batches, and never shuffled. The forest is
fitted on the driver from at most ``SAMPLE`` labelled rows (its bound), sent to
the tasks as numpy node arrays, and scored a batch at a time.

Defined cases: a null or empty text has no words and fails the base rules. Rows
that repeat are scored each on its own. Without labels of both classes the
forest has no verdict and only the base rules decide. Further columns are left
alone, whatever their names.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsq.llm import boosting
from obsq.llm.common import labelled_sample, map_texts

#: Most labelled rows the forest is fitted on.
SAMPLE = 20_000
MIN_WORDS = 10
#: Reject when the forest is at least this sure that a document is junk.
JUNK = 0.5

# The symbols the base rules count.
SYMBOLS = "#*$%&|<>"

FEATURES = (
    "log_words", "mean_word", "symbol_share", "pipe_share", "dup_line_share", "repeat_share",
    "upper_share", "digit_share", "end_symbol_share", "shout_share", "distinct_share",
    "words_per_line", "letter_share", "stop_per_word",
)
#: A score of junk may only rise (+1) or fall (-1) with these.
MONOTONE = {"symbol_share": 1, "repeat_share": 1, "dup_line_share": 1, "letter_share": -1}

_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _window_ids(ids: np.ndarray, width: int) -> np.ndarray:
    """Equal numbers for equal windows, without collisions."""
    out = np.unique(ids, return_inverse=True)[1]
    words = out
    for step in range(1, width):
        size = words.max() + 1
        out = np.unique(out[:-1] * size + words[step:], return_inverse=True)[1]
    return out


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words))
    mixed = ids[:n].astype(np.uint64)
    for step in range(1, width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[step : step + n].astype(np.uint64)
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():  # equal windows always mix alike
        return 0
    number: dict[bytes, int] = {}
    exact = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    windows = _window_ids(exact, width)
    again = np.bincount(windows)[windows] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base counts of a text and the features of the forest."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    each = [raw.count(s.encode()) for s in SYMBOLS]
    symbols = sum(each)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    dup = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    base = [n, chars, symbols, dup, repeated]
    if not n:
        return base, [0.0] * len(FEATURES)
    codes = np.frombuffer(raw, np.uint8)
    upper = int(((codes >= 65) & (codes <= 90)).sum())
    lower = int(((codes >= 97) & (codes <= 122)).sum())
    digits = int(((codes >= 48) & (codes <= 57)).sum())
    beyond = int((codes >= 0xC0).sum())
    ends = sum(w[-1] in b"#*$%&|<>" for w in words)
    return base, [
        float(np.log1p(n)),
        chars / n,
        symbols / chars,
        each[SYMBOLS.index("|")] / n,
        dup / max(1, len(lines)),
        repeated / n,
        upper / chars,
        digits / chars,
        ends / n,
        raw.count(b"!") / n,
        len(set(words)) / n,
        n / max(1, len(lines)),
        (upper + lower + beyond) / chars,
        (raw.count(b".") + raw.count(b",")) / n,
    ]


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    sample: int = SAMPLE,
) -> boosting.Forest | None:
    """A forest for junk (label ``quality`` 0); None without labels of both classes."""
    chosen = labelled_sample(docs.select(id_column, text), labels, "quality", sample, id_column)

    def per_text(texts: list[str]) -> list[list]:
        return [[statistics(t)[1] for t in texts]]

    rows = map_texts(chosen, text, ["_label"], "features array<double>", per_text).collect()
    x = np.array([r["features"] for r in rows]).reshape(-1, len(FEATURES))
    junk = 1.0 - np.array([r["_label"] for r in rows], float)
    if not len(junk) or junk.min() == junk.max():
        return None
    monotone = np.array([MONOTONE.get(name, 0) for name in FEATURES])
    return boosting.fit(x, junk, monotone)


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    sample: int = SAMPLE,
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` (the id) with the base counts, ``base_failed``, ``junk`` and ``kept``."""
    return _judge(docs, fit_quality(docs, labels, text, id_column, sample), text, keep or [id_column])


def _judge(docs: DataFrame, forest: boosting.Forest | None, text: str, keep: list[str]) -> DataFrame:
    def per_text(texts: list[str]) -> list[list]:
        both = [statistics(t) for t in texts]
        x = np.array([features for _, features in both]).reshape(-1, len(FEATURES))
        junk = boosting.probabilities(forest, x) if forest else np.zeros(len(x))
        base = list(zip(*(counts for counts, _ in both)))
        failed = [n < MIN_WORDS or 100 * r > 20 * n for n, *_, r in zip(*base)]
        kept = [not f and bool(j < JUNK) for f, j in zip(failed, junk)]
        return [*map(list, base), failed, junk.tolist(), kept]

    schema = f"{_STATS}, base_failed boolean, junk double, kept boolean"
    return map_texts(docs, text, keep, schema, per_text)


def drop_junk(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text")
    forest_of = docs.select("doc_id", "text")
    return _judge(whole, fit_quality(forest_of, labels), "text", ["_doc"]).filter("kept").select("_doc.*")
