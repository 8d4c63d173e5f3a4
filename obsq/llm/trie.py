"""The prefix trie of conversations, by union-find over sorted neighbours.

A conversation is a sequence of turns; a node of the trie is a distinct sequence
of first turns. Conversations are sorted by their turns (a 128-bit mark per turn)
and dealt to range partitions, where copies of one conversation are spread by
their id. A task cuts its rows into blocks of bounded size. In a block, each row
is a component; the edges between neighbours, weighted by the number of first
turns they share, are taken in descending order, and whatever two components an
edge merges, the merged one is a node at that depth: a new branching node, or one
of the two if it has that depth already. Nodes between a component's depth and
its parent's have the same members and are written out from it.

Nodes of a block that hold neither its first nor its last row are complete. The
others form the block's two outer paths; to these the block is contracted, with
sums over what hangs off them. Paths of neighbouring blocks are merged node by
node, again by union-find along the first turns they share, in one task that
reads two paths per block and nothing else; the sums then run up the merged paths.
Complete nodes below an outer path learn their parent by a join on their block.
The ids of conversations that end in a node on an outer path travel as one text
per block and are hashed in order, block by block.

Defined cases: a null conversation id is no conversation. A null role or text is
empty. Turns are in order of their number, null first; equal numbers by role, then
mark. A conversation's marks and lengths (36 bytes a turn) are one row. An empty
table has no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from obsq.llm.common import store

#: Hexadecimal digits of a turn's mark.
MARK = 32
#: Most conversations and turns of a block (one longer conversation is a block).
BLOCK_ROWS, BLOCK_TURNS = 1 << 15, 1 << 17
#: Rows of a batch that leaves a task.
BATCH = 1 << 13

#: What a block writes, by ``kind``: complete nodes, nodes of its outer paths, and
#: the ids that end in the latter. ``place`` is the block; ``side`` and ``depth``
#: name a node of its paths: side 0 is the first row's path, 1 the last row's
#: below what both share. A complete node whose parent is on a path has that
#: node's side and depth (its own less one).
NODE, PATH, ENDS = 0, 1, 2
_WRITTEN = (
    "kind int, place long, side int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, mark string, chars long, shared long, ids string"
)
_NO_IDS = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` (an array of ``turn, role, mark, chars`` in order) of every conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.lower(
        F.concat(F.lpad(F.hex(F.xxhash64(role, text)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(7), text, role)), 16, "0"))
    )
    turn = F.struct(F.col("turn"), role.alias("role"), mark.alias("mark"), F.char_length(text).cast("long").alias("chars"))
    return (
        conversations.filter(F.col("conv_id").isNotNull())
        .select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("_turn"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("turns"))
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Conversations that begin with the first turns of the one their hundred is named by."""
    whole = store(sequences(conversations).select("conv_id", F.col("turns.mark").alias("marks"), F.col("turns.chars").alias("chars")))
    c = F.col("conv_id")
    heads = whole.filter(c % 100 == 0).select(
        c.alias("_base"), F.slice("marks", 1, 5).alias("_marks"), F.slice("chars", 1, 5).alias("_chars")
    )
    h = (F.crc32(c.cast("string")) % 6).cast("int")
    both = whole.withColumns({"_base": c - c % 100, "_h": h}).join(heads, "_base", "left")

    def mixed(own: str, head: str):
        first = F.coalesce(F.slice(head, F.lit(1), F.col("_h")), F.slice(own, 1, 0))
        return F.concat(first, F.slice(own, F.col("_h") + 1, F.greatest(F.size(own), F.lit(1))))

    return both.select("conv_id", mixed("marks", "_marks").alias("marks"), mixed("chars", "_chars").alias("chars"))


# --- one block ---------------------------------------------------------------


class _Component:
    """The deepest node that holds rows ``first`` to ``last`` of a block."""

    __slots__ = ("depth", "first", "last", "least", "ends", "closed", "leaves", "saved", "parts")

    def __init__(self, depth: int, row: int, conv_id: int):
        self.depth, self.first, self.last, self.least = depth, row, row, conv_id
        self.ends = [row]
        self.closed = 0  # complete children; what hangs below them:
        self.leaves = 0
        self.saved = 0
        self.parts: list[list] = []  # rows of complete children, until this node's members are known

    def take(self, other: _Component) -> None:
        """Rows of another component, which follows or precedes."""
        self.first, self.last = min(self.first, other.first), max(self.last, other.last)
        self.least = min(self.least, other.least)


def shared_turns(one: str, other: str) -> int:
    """Number of first marks that two sequences share."""
    most = min(len(one), len(other)) // MARK
    if one[: most * MARK] == other[: most * MARK]:
        return most
    low, high = 0, most - 1
    while low < high:
        middle = (low + high + 1) // 2
        if one[: middle * MARK] == other[: middle * MARK]:
            low = middle
        else:
            high = middle - 1
    return low


def block_forest(place: int, keys: list[str], chars: list[list[int]], ids: list[int]) -> Iterator[tuple]:
    """Rows of ``_WRITTEN`` for sorted sequences; ``keys`` are their marks in one text."""
    m = len(keys)
    lengths = [len(k) // MARK for k in keys]
    edges = [shared_turns(keys[i], keys[i + 1]) for i in range(m - 1)]
    parent = list(range(m))
    component = [_Component(lengths[i], i, ids[i]) for i in range(m)]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def is_outer(c: _Component) -> bool:
        return c.first == 0 or c.last == m - 1

    written: list[list] = []

    def attach(child: _Component, depth: int, target: _Component) -> None:
        """``child``, all of whose rows are known, below a node at ``depth``."""
        n = child.last - child.first + 1
        turns = chars[child.first]
        if is_outer(child):
            write_path(child, depth)
        else:
            leaf = not child.closed
            leaves = 1 if leaf else child.leaves
            own = hashlib.sha256(",".join(str(ids[r]) for r in child.ends).encode()).hexdigest() if child.ends else _NO_IDS
            saved = child.saved + (n - 1) * (turns[child.depth - 1] if child.depth else 0)
            for d in range(child.depth, depth, -1):
                deepest = d == child.depth
                if not deepest:
                    saved += (n - 1) * turns[d - 1]
                above = child.least if d - 1 > depth else None
                row = [
                    NODE, place, None, d, child.least, above, n, child.closed if deepest else 1, leaves, saved,
                    own if deepest else _NO_IDS, None, None, None, None,
                ]
                written.append(row)
                if above is None:
                    target.parts.append(row)
            target.closed += 1
            target.leaves += leaves
            target.saved += saved
        for row in child.parts:
            if is_outer(child):
                row[2] = 0 if child.first == 0 else 1
            else:
                row[5] = child.least
        child.parts = []

    def write_path(c: _Component, depth: int) -> None:
        n, row = c.last - c.first + 1, c.first
        for d in range(c.depth, depth, -1):
            deepest = d == c.depth
            side = 0 if c.first == 0 else 1
            key = (PATH, place, side, d, c.least, None, n)
            sums = (c.closed, c.leaves, c.saved) if deepest else (0, 0, 0)
            mark = keys[row][(d - 1) * MARK : d * MARK] if d else None
            shared = int(c.first == 0 and c.last == m - 1)
            written.append([*key, *sums, None, mark, chars[row][d - 1] if d else 0, shared, None])
            if deepest and c.ends:
                ended = ",".join(str(ids[r]) for r in c.ends)
                written.append([ENDS, place, side, d, *[None] * 10, ended])

    for i in sorted(range(m - 1), key=lambda i: -edges[i]):
        depth, a, b = edges[i], find(i), find(i + 1)
        one, other = component[a], component[b]
        if one.depth == depth and other.depth == depth:
            # two nodes of one depth are one node
            one.ends += other.ends
            one.closed, one.leaves = one.closed + other.closed, one.leaves + other.leaves
            one.saved += other.saved
            one.parts += other.parts
            whole = one
        elif one.depth == depth:
            attach(other, depth, one)
            whole = one
        elif other.depth == depth:
            attach(one, depth, other)
            whole = other
        else:
            whole = _Component(depth, one.first, one.least)
            whole.ends = []
            attach(one, depth, whole)
            attach(other, depth, whole)
        whole.take(one)
        whole.take(other)
        parent[b] = a
        component[a] = whole
    root = component[find(0)]
    attach(root, -1, _Component(-1, 0, root.least))
    return iter(written)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[list[int]], list[int]]]:
    keys, chars, ids, turns = [], [], [], 0
    for batch in batches:
        for key, lengths, conv_id in zip(*(batch.column(c).to_pylist() for c in ("key", "chars", "conv_id"))):
            if keys and (len(keys) >= BLOCK_ROWS or turns + len(lengths) > BLOCK_TURNS):
                yield keys, chars, ids
                keys, chars, ids, turns = [], [], [], 0
            keys.append(key)
            chars.append(lengths)
            ids.append(conv_id)
            turns += len(lengths)
    if keys:
        yield keys, chars, ids


def forests(rows: DataFrame) -> DataFrame:
    """Complete nodes and contracted paths of every block of ``conv_id, marks, chars``."""
    keyed = rows.select("conv_id", F.array_join("marks", "").alias("key"), "chars")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    schema = StructType.fromDDL(_WRITTEN)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, (keys, chars, ids) in enumerate(_blocks(batches)):
            yield from _in_batches(block_forest(first + number, keys, chars, ids), arrow)

    return ordered.mapInArrow(run, schema)


def _in_batches(rows: Iterator, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


# --- contracted blocks ---------------------------------------------------------

_MERGED = (
    "place long, side int, depth long, node long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, is_node boolean"
)


def merge_paths(rows: list[tuple]) -> Iterator[tuple]:
    """Rows of ``_MERGED`` for the path nodes of all blocks, by place, side and depth.

    ``rows`` are ``place, side, depth, conv_id, n_convs, n_children, n_leaves,
    saved_tokens, mark, chars, shared``. Each comes back with the number of its merged
    node and that node's values; ``is_node`` holds for one row of each.
    """
    paths: list[tuple[list[int], list[int]]] = []  # of each block, its path nodes by depth
    above: list[int] = []
    place = None
    for i, row in enumerate(rows):
        if row[0] != place:
            place = row[0]
            paths.append(([], []))
        first, last = paths[-1]
        path = last if row[1] else first
        above.append(path[-1] if path else i)
        path.append(i)
        if row[10] and not row[1]:
            last.append(i)
    node = list(range(len(rows)))

    def find(i: int) -> int:
        while node[i] != i:
            node[i] = node[node[i]]
            i = node[i]
        return i

    for (_, left), (right, _) in zip(paths, paths[1:]):
        depth, most = 0, min(len(left), len(right)) - 1
        while depth < most and rows[left[depth + 1]][8] == rows[right[depth + 1]][8]:
            depth += 1
        for d in range(depth, -1, -1):
            one, other = find(left[d]), find(right[d])
            node[other] = one
    least: dict[int, int] = {}
    n, closed, leaves, saved = (defaultdict(int) for _ in range(4))
    for i, row in enumerate(rows):
        g = find(i)
        least[g] = min(row[3], least.get(g, row[3]))
        for sums, value in zip((n, closed, leaves, saved), row[4:8]):
            sums[g] += value
    for g in sorted(least, key=lambda g: -rows[g][2]):
        if not closed[g]:
            leaves[g] = 1
        saved[g] += (n[g] - 1) * rows[g][9]
        if rows[g][2]:
            p = find(above[g])
            closed[p] += 1
            leaves[p] += leaves[g]
            saved[p] += saved[g]
    for i, row in enumerate(rows):
        g = find(i)
        parent = least[find(above[g])] if row[2] else None
        yield (*row[:3], g, least[g], parent, n[g], closed[g], leaves[g], saved[g], i == g)


def _merged(written: DataFrame) -> DataFrame:
    columns = "place side depth conv_id n_convs n_children n_leaves saved_tokens mark chars shared".split()
    paths = written.filter(F.col("kind") == PATH).select(columns).repartition(1).sortWithinPartitions("place", "side", "depth")
    schema = StructType.fromDDL(_MERGED)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for b in batches for row in zip(*(b.column(c).to_pylist() for c in columns))]
        yield from _in_batches(merge_paths(rows), arrow)

    return paths.mapInArrow(run, schema)


def _ends(written: DataFrame, merged: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of the merged nodes in which conversations end."""
    place = ["place", "side", "depth"]
    ids = written.filter(F.col("kind") == ENDS).select(*place, "ids").join(merged.select(*place, "node"), place)
    schema = StructType.fromDDL("node long, ends_sha256 string")
    arrow = to_arrow_schema(schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, digest = None, None
        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if node == at:
                    digest.update(b"," + text.encode())
                    continue
                if at is not None:
                    yield at, digest.hexdigest()
                at, digest = node, hashlib.sha256(text.encode())
        if at is not None:
            yield at, digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(digests(batches), arrow)

    return ids.select("node", "place", "ids").repartition("node").sortWithinPartitions("node", "place").mapInArrow(run, schema)


def prefix_trie(rows: DataFrame) -> DataFrame:
    """A row per node of the trie of ``conv_id, marks, chars``, one row per conversation."""
    written = store(forests(rows))
    merged = store(_merged(written))
    values = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    columns = ["conv_id", "depth", "parent_conv_id", *values, "ends_sha256"]
    complete = written.filter(F.col("kind") == NODE)
    known = complete.filter(F.col("parent_conv_id").isNotNull()).select(columns)
    outer = merged.select("place", "side", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_parent"))
    below = (
        complete.filter(F.col("parent_conv_id").isNull()).join(outer, ["place", "side", "depth"])
        .withColumn("parent_conv_id", F.col("_parent")).select(columns)
    )
    top = (
        merged.filter("is_node").join(_ends(written, merged), "node", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_IDS))).select(columns)
    )
    return known.unionByName(below).unionByName(top)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefix_trie(rebuilt(conversations))
