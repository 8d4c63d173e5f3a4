"""The conversation trie against one that is built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from obsq.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(sequences):
    """Rows of the trie of ``{conv_id: [(role, text), ...]}``."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(sequences):
        turns = tuple(sequences[c])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        if not children[node]:
            leaves[node] = 1
        if node:
            saved[node] += (len(members[node]) - 1) * len(node[-1][1])
            children[node[:-1]] += 1
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return sorted((
        (
            ids[0], len(node), members[node[:-1]][0] if node else None, len(ids), children[node], leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest(),
        ) for node, ids in members.items()
    ), key=str)


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def in_order(frame):
    return sorted((tuple(r) for r in frame.select(COLUMNS).collect()), key=str)


def made_rows(rng, n):
    """Conversations of up to 12 turns with many shared beginnings, and a third of copies."""
    texts = [None, "", "a", "bb", "é🙂", "long " * 50]
    rows = []
    for c in rng.sample(range(600), n):
        for turn in range(rng.randint(1, 12)):
            rows.append((c, turn, rng.choice(["user", None]), rng.choice(texts) if rng.random() < 0.4 else "x", "d"))
    for c in range(1000, 1000 + n // 2):
        rows += [(c, 0, "user", "copy", None), (c, 1, "bot", "of one", None)]
    return rows


@pytest.mark.parametrize("block_rows", [1, 2, 7, 1 << 15])
def test_trie_matches_plain(spark, monkeypatch, block_rows):
    monkeypatch.setattr(trie, "BLOCK_ROWS", block_rows)
    rng = random.Random(block_rows)
    rows = made_rows(rng, 120)
    rows += [(5000, None, "user", "first", None), (5000, 3, "user", "last", None), (None, 1, "user", "nobody", None)]
    rows += [(5001, t, "user", "same", None) for t in range(700)] + [(5002, t, "user", "same", None) for t in range(350)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = in_order(trie.conversation_trie(docs))
    assert got == plain_trie(plain_rebuilt(rows))


def test_blocks_of_any_sequences():
    """Blocks cut anywhere give the same nodes, turnless sequences included."""
    rng = random.Random(3)
    for _ in range(200):
        count = rng.randint(1, 14)
        marks = {c: [rng.choice("ab") for _ in range(rng.choice([0, 0, 1, 2, 5]))] for c in rng.sample(range(99), count)}
        rows = sorted(("".join(m * trie.MARK for m in s), c) for c, s in marks.items())
        size = rng.randint(1, count)
        written = []
        for at in range(0, count, size):
            part = rows[at : at + size]
            keys, ids = [k for k, _ in part], [c for _, c in part]
            written += trie.block_forest(at, keys, [[1 + d for d in range(len(k) // trie.MARK)] for k in keys], ids)
        paths = sorted((r for r in written if r[0] == trie.PATH), key=lambda r: r[1:4])
        merged = list(trie.merge_paths([(*r[1:5], *r[6:10], r[11], r[12], r[13]) for r in paths]))
        node = {r[:3]: r[3] for r in merged}
        ended = defaultdict(list)
        for r in sorted((r for r in written if r[0] == trie.ENDS), key=lambda r: r[1]):
            ended[node[r[1], r[2], r[3]]].append(r[14])
        least = {r[:3]: r[4] for r in merged}
        got = [
            (r[4], r[3], least[r[1], r[2], r[3] - 1] if r[5] is None else r[5], *r[6:10], r[10])
            for r in written if r[0] == trie.NODE
        ]
        got += [
            (r[4], r[2], r[5], *r[6:10], hashlib.sha256(",".join(ended[r[3]]).encode()).hexdigest())
            for r in merged if r[10]
        ]
        want = plain_trie({c: [(m, "x" * (d + 1)) for d, m in enumerate(s)] for c, s in marks.items()})
        assert sorted(got, key=str) == want


def test_empty_table(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", "c")], SCHEMA)).count() == 0
