"""Periodic runs of words, found online by catchers over power-of-two blocks.

A run is a maximal stretch of words with one smallest period. If a stretch has
period ``q`` and ``2b <= q < 4b`` for a power of two ``b``, each of its halves
holds a whole block of ``b`` words that starts at a multiple of ``b``, and the
block is seen again ``q`` words later. A catcher over every completed block
therefore watches the suffix of ``b`` words from ``2b`` to ``4b`` words after the
block's start; at any time two catchers of each length are awake, so an appended
word costs two comparisons of fingerprints per power of two. Where they agree,
the words themselves are compared, back and forth; a match that reaches the end
of what was appended stays open and grows with the next words. Squares of one
period that overlap are one stretch, so what is inside a stretch already known
is left out. Fingerprints decide only where to look: runs are exact.

Words are appended in slices, for which a level's comparisons are one step in
numpy. Periods under eight need no fingerprints: one word in as many as the
shortest run repeats is compared at each of these distances.

Defined cases: a null or empty text has no words and no runs. Repeated rows are
answered one by one. A null id leaves its text as it is in `run_digests`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsq.llm.common import map_batches, sha256_hex

MIN_LENGTH = 24
MIN_EXPONENT = 3
#: Words appended at once; bounds the numpy work arrays of a long text.
SLICE = 1 << 16
#: Least block length; shorter periods are watched word by word.
LEAST_BLOCK = 4

_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)


class RunCatcher:
    """The runs of a growing sequence of word numbers.

    ``append`` takes the next words, ``runs`` gives ``(start, length, period)`` of
    the runs of what was appended so far, by start, then period.
    """

    def __init__(self, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT):
        if min_exponent < 2:
            raise ValueError("a run repeats its period at least twice")
        self.min_length, self.min_exponent = min_length, min_exponent
        self.n = 0
        self._words = np.empty(1024, np.int64)
        #: per block length 1, 2, 4, ...: first position kept, fingerprints from there on
        self._levels: list[tuple[int, np.ndarray]] = []
        self._open: dict[tuple[int, int], int] = {}  # (period, start) of stretches that reach the end
        self._closed: dict[tuple[int, int], int] = {}  # (start, end) to the smallest period seen

    def append(self, words: Sequence[int]) -> None:
        new = np.asarray(words, np.int64)
        if not len(new):
            return
        old, self.n = self.n, self.n + len(new)
        if self.n > len(self._words):
            grown = np.empty(max(self.n, 2 * len(self._words)), np.int64)
            grown[:old] = self._words[:old]
            self._words = grown
        self._words[old : self.n] = new
        #: stretches that end after the old end, which is where new squares end
        self._recent: list[tuple[int, int, int]] = []
        for (period, start), end in list(self._open.items()):
            self._settle(start, self._forward(end, period), period)
        for period in range(1, 2 * LEAST_BLOCK):
            self._watch_words(old, period)
        self._watch_blocks(old)

    def runs(self) -> list[tuple[int, int, int]]:
        found = dict(self._closed)
        for (period, start), end in self._open.items():
            if self._is_run(start, end, period):
                found[start, end] = min(period, found.get((start, end), period))
        return sorted((start, end - start, period) for (start, end), period in found.items())

    def _is_run(self, start: int, end: int, period: int) -> bool:
        return end - start >= max(self.min_length, self.min_exponent * period)

    def _settle(self, start: int, end: int, period: int) -> None:
        """Note a stretch that nothing extends among the words there are."""
        self._recent.append((start, end, period))
        if end == self.n:
            self._open[period, start] = end
            return
        self._open.pop((period, start), None)
        if self._is_run(start, end, period):
            self._closed[start, end] = min(period, self._closed.get((start, end), period))

    def _forward(self, at: int, period: int) -> int:
        """Where words stop to equal those a period before, from ``at`` on."""
        w, step = self._words, 16
        while at < self.n:
            end = min(self.n, at + step)
            differ = w[at:end] != w[at - period : end - period]
            if differ.any():
                return at + int(differ.argmax())
            at, step = end, step * 2
        return at

    def _backward(self, at: int, period: int) -> int:
        """Start of the stretch of which ``at`` is the first word known to equal that a period before."""
        w, step = self._words, 16
        while at > period:
            start = max(period, at - step)
            differ = w[start:at] != w[start - period : at - period]
            if differ.any():
                return at - int(differ[::-1].argmax()) - period
            at, step = start, step * 2
        return at - period

    def _watch_words(self, old: int, period: int) -> None:
        need = max(self.min_length, self.min_exponent * period) - period
        first = -(-max(old, period) // need) * need
        w = self._words
        at = np.arange(first, self.n, need)
        at = at[w[at] == w[at - period]]
        # the block of one word that is seen again, a period later
        self._extend(at - period, np.full(len(at), period), 1)

    def _watch_blocks(self, old: int) -> None:
        below_start, below = old, self._words[old : self.n].astype(np.uint64) * _ODD[0]
        below ^= below >> _SHIFT
        block, level = 1, 0
        while True:
            # fingerprints of the suffixes of this length that end in the new words
            if level == len(self._levels):
                self._levels.append((below_start, below[:0]))
            first, kept = self._levels[level]
            known = first + len(kept)
            prints = np.concatenate([kept, below[known - below_start :]])
            self._levels[level] = first, prints
            if block >= LEAST_BLOCK:
                self._wake(first, prints, known, block)
            # what later suffixes of twice this length and their catchers still need
            drop = max(0, self.n - 6 * block - first)
            self._levels[level] = first + drop, prints[drop:]
            if self.n < 2 * block:
                return
            start = max(0, old - 2 * block + 1)
            if level + 1 < len(self._levels):
                start = sum(map(int, (self._levels[level + 1][0], len(self._levels[level + 1][1]))))
            left = prints[start - first : self.n - 2 * block + 1 - first]
            right = prints[start + block - first : self.n - block + 1 - first]
            below = left * _ODD[0] + right * _ODD[1]
            below ^= below >> _SHIFT
            below_start, block, level = start, 2 * block, level + 1

    def _wake(self, first: int, prints: np.ndarray, known: int, block: int) -> None:
        """Hold the new suffixes of one length against the two catchers that watch each."""
        # a run of least length is seen last where this many words precede; three
        # blocks are there by then
        start = max(known, (2 * self.min_exponent - 2) * block, 3 * block)
        end = first + len(prints)
        if start >= end:
            return
        number = start // block
        new = prints[start - first :]
        starts, periods = [], []
        for back in (2, 3):
            caught = prints[(number - back) * block - first : end - back * block - first : block]
            same = np.flatnonzero(new == np.repeat(caught, block)[start - number * block :][: len(new)])
            if len(same):
                at = same + start
                begins = (at // block - back) * block
                starts.append(begins)
                periods.append(at - begins)
        if starts:
            begins, distance = np.concatenate(starts), np.concatenate(periods)
            order = np.argsort(begins, kind="stable")
            self._extend(begins[order], distance[order], block)

    def _extend(self, starts: np.ndarray, periods: np.ndarray, block: int) -> None:
        """Stretches around blocks seen again; ``starts`` ascend."""
        if not len(starts):
            return
        ends = starts + periods + block
        wanted = np.ones(len(starts), bool)
        for known in self._recent:
            self._leave_out(wanted, starts, periods, ends, known)
        for i in range(len(starts)):
            if wanted[i]:
                start, period, end = int(starts[i]), int(periods[i]), int(ends[i])
                at = start + period
                begin, stop = self._backward(at, period), self._forward(at, period)
                if stop < end:
                    continue  # fingerprints of different words
                self._settle(begin, stop, period)
                self._leave_out(wanted, starts, periods, ends, (begin, stop, period))

    def _leave_out(self, wanted, starts, periods, ends, known: tuple[int, int, int]) -> None:
        """Squares inside a stretch whose period divides theirs are that stretch again."""
        begin, stop, period = known
        i, j = np.searchsorted(starts, (begin, stop))
        if i < j:
            wanted[i:j] &= (ends[i:j] > stop) | (periods[i:j] % period != 0)


def word_numbers(words: Sequence) -> np.ndarray:
    """Equal numbers for equal words."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """The words between space characters (0x20, 0x09 to 0x0D, what bytes are split at), in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def find_runs(
    words: Sequence, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of a list of words."""
    catcher = RunCatcher(min_length, min_exponent)
    numbers = word_numbers(words)
    for at in range(0, len(numbers), SLICE):
        catcher.append(numbers[at : at + SLICE])
    return catcher.runs()


def collapsed(words: Sequence, runs: Sequence[tuple[int, int, int]]) -> list:
    """The words without those that a run repeats: of each run, its first period stays."""
    if not runs:
        return list(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def periodic_runs(
    docs: DataFrame, text: str = "text", keep: Sequence[str | Column] = ("doc_id",),
    min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """Columns ``keep`` with ``runs`` and ``collapsed``, the text with each run cut to
    one period and words joined by one space."""

    def per_batch(texts: list[str | None]) -> list[list]:
        out: list[list] = [[], []]
        for t in texts:
            words = words_of(t)
            runs = find_runs(words, min_length, min_exponent)
            out[0].append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            out[1].append(b" ".join(collapsed(words, runs)).decode("utf-8", "replace"))
        return out

    schema = "runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return map_batches(docs, [F.col(text).cast("string")], keep, schema, per_batch)


def with_periodic_tail(words: list, h: int | None) -> list:
    """The words of a document with hash ``h``; for one in ten, the tail repeats."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def most_repeated(runs: Sequence[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact exponent; of several the first, then that of the smallest period."""
    best = None
    for run in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def run_digests(docs: DataFrame) -> DataFrame:
    """A row per document: number of runs, the most repeated one, digests of all runs
    and of the collapsed text, over words of which one document in ten (by the CRC-32
    of its id) has its tail made periodic first."""

    def per_batch(texts: list[str | None], hashes: list[int | None]) -> list[list]:
        out: list[list] = [[] for _ in range(7)]
        for t, h in zip(texts, hashes):
            words = with_periodic_tail(words_of(t), h)
            runs = find_runs(words)
            best = most_repeated(runs)
            start, length, period = best or (None, None, None)
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            left = b" ".join(collapsed(words, runs))
            row = [
                len(runs), start, length, period, 1000 * length // period if best else None,
                sha256_hex(listed), hashlib.sha256(left).hexdigest(),
            ]
            for column, value in zip(out, row):
                column.append(value)
        return out

    schema = (
        "n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string"
    )
    inputs = [F.col("text").cast("string"), F.crc32(F.col("doc_id").cast("string"))]
    return map_batches(docs, inputs, ["doc_id"], schema, per_batch)
