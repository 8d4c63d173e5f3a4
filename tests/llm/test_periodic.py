"""Periodic runs against a comparison of every word with every distance."""

import hashlib
import random
import re
import zlib

import pytest

from obsq.llm.periodic import RunCatcher, find_runs, periodic_runs, run_digests, word_numbers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(words, min_length=24, exponent=3):
    found = {}
    for period in range(1, len(words) // exponent + 1):
        at = period
        while at < len(words):
            end = at
            while end < len(words) and words[end] == words[end - period]:
                end += 1
            if end > at and end - at + period >= max(min_length, exponent * period):
                found.setdefault((at - period, end), period)
            at = max(end, at + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def made_words(kind, n, rng):
    if kind < 3:
        return rng.choices("abcd"[: kind + 1], k=n)
    if kind == 3:  # the word whose runs are densest
        short, long = ["a"], ["a", "b"]
        while len(long) < n:
            short, long = long, long + short
        return long[:n]
    words = []
    while len(words) < n:
        words += rng.choices("abcdefgh", k=rng.randint(1, 40)) * rng.randint(1, 6) + [rng.choice("axyz")]
    return words[:n]


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("limits", [(24, 3), (2, 2), (10, 4)])
def test_catchers_find_all_runs_whatever_the_slices(kind, limits):
    rng = random.Random(kind)
    for n in [0, 1, 2, 23, 24, 60, 150, 400]:
        words = made_words(kind, n, rng)
        want, numbers = all_runs(words, *limits), word_numbers(words)
        for step in (1, 5, 64, 1000):
            catcher = RunCatcher(*limits)
            for at in range(0, n, step):
                catcher.append(numbers[at : at + step])
            assert catcher.runs() == want


def test_long_texts():
    assert find_runs(["a"] * 300_000) == [(0, 300_000, 1)]
    unit = [str(i) for i in range(40_000)]
    assert find_runs(["x"] + unit * 3 + unit[:7]) == [(1, 120_007, 40_000)]
    blocks = [str(i) for i in range(2_000) for _ in range(24)]
    assert find_runs(blocks) == [(24 * i, 24, 1) for i in range(2_000)]


def test_digests_match_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "a " * 30, "x y " * 12 + "z", "a\x1cb " * 24, "é è \t" * 9 + "\x0b", "x " * 5_000 + "y " * 5_000]
    texts += [" ".join(made_words(4, 200, rng)) for _ in range(60)] + [" ".join(map(str, range(300)))] * 30
    rows = [(i, t, "row") for i, t in enumerate(texts)] + [(3, "a " * 30, "row"), (None, "b " * 25, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    want = []
    for i, t, _ in rows:
        words = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        n = len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        runs = all_runs(words) if n < 1000 else find_runs(words)
        kept = [w for j, w in enumerate(words) if not any(s + p <= j < s + length for s, length, p in runs)]
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        want.append((
            i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest(),
        ))
    got = [tuple(r) for r in run_digests(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 20
    assert run_digests(docs.limit(0)).count() == 0


def test_collapsed_text_and_columns(spark):
    docs = spark.createDataFrame([(1, "go " + "la lu " * 20 + "end", "k")], "doc_id long, text string, _in_ string")
    row = periodic_runs(docs, keep=["doc_id", "_in_"]).first()
    assert row["collapsed"] == "go la lu end" and row["_in_"] == "k"
    assert [tuple(r) for r in row["runs"]] == [(1, 40, 2)]
