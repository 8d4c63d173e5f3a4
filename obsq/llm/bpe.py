"""BPE encoding and decoding through a table of distinct words.

The tokenizer never looks past white space, so a text's ids are those of its
words in order. Texts are read in blocks of about ``BLOCK_WORDS`` words (a part
of one input partition). A block keeps, per text, the places of its words in the
block's list of distinct words. That list is dealt to buckets by a hash of the
word, a packed list per block and bucket, so that one task meets all blocks'
copies of a word: it encodes each distinct word once and sends every block its
ids back. Then ids are joined back by position inside each block, and decoded
through the id-to-piece table, which has a row per id of the vocabulary (49,408
here) and is held as an array: a broadcast join of a known size.

A task holds one block's words, or the distinct words of its buckets up to
``CACHE_WORDS``, at a time. A block's key is a digest of its texts in order:
should the input come in another order when a part is computed again, the run
fails instead of mixing up words.

Defined cases: a null or empty text, or one of white space, has no ids and the
empty string as decoded text. Special tokens written out in a text become their
ids, as in the library. Repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words and distinct words after which a block is closed, at the next text.
BLOCK_WORDS = 2_000_000
BLOCK_DISTINCT = 500_000
#: Distinct words after which an encoding task starts its list anew.
CACHE_WORDS = 2_000_000
#: Buckets of words for each shuffle partition.
BUCKETS = 4

# Str.split() also splits at these, the tokenizer does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[^\\S\x1c-\x1f]+")


def split_words(text: str) -> list[str]:
    """The runs between the white space the tokenizer drops."""
    if _NOT_SPACE.search(text):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


def _pack(places: np.ndarray) -> bytes:
    """Places as byte planes, compressed."""
    planes = places.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpack(packed: bytes) -> list[int]:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().tolist()


class _Block:
    """Distinct words of some texts and the texts as places in that list."""

    def __init__(self):
        self.index: dict[str, int] = defaultdict(count().__next__)
        self.digest = xxhash.xxh3_128()
        self.words = 0
        self.found: list[np.ndarray] = []
        self.rows: list = []

    def add(self, text: str, row) -> None:
        words = split_words(text)
        self.found.append(np.fromiter(map(self.index.__getitem__, words), np.uint32, len(words)))
        raw = text.encode("utf-8", "surrogatepass")
        self.digest.update(len(raw).to_bytes(8, "little") + raw)
        self.words += len(words)
        self.rows.append(row)

    @property
    def full(self) -> bool:
        return self.words >= BLOCK_WORDS or len(self.index) >= BLOCK_DISTINCT

    def lists(self, buckets: int) -> list[list[str]]:
        """The distinct words by bucket, in order; a word's place counts through all of them."""
        out: list[list[str]] = [[] for _ in range(buckets)]
        digest = xxhash.xxh32_intdigest
        for word in self.index:
            out[digest(word.encode("utf-8", "surrogatepass")) % buckets].append(word)
        for words in out:
            words.sort()
        return out

    def packed(self, buckets: int) -> Iterator[bytes]:
        """The texts as places, in the order of ``lists``."""
        place = np.empty(len(self.index), np.uint32)
        old = [self.index[w] for words in self.lists(buckets) for w in words]
        place[old] = np.arange(len(old), dtype=np.uint32)
        return (_pack(place[found]) for found in self.found)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    block = _Block()
    for batch in batches:
        for text, row in zip(batch.column("text"), batch.column("row")):
            block.add(text.as_py() or "", row)
            if block.full:
                yield block
                block = _Block()
    if block.rows:
        yield block


def _distinct_words(rows: DataFrame, buckets: int) -> DataFrame:
    """``block, bucket, words``: a block's distinct words of a bucket, packed."""
    schema = T.StructType.fromDDL("block binary, bucket int, words binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            lists = [(i, words) for i, words in enumerate(block.lists(buckets)) if words]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block.digest.digest()] * len(lists), pa.binary()),
                    pa.array([i for i, _ in lists], pa.int32()),
                    pa.array([_squeeze("\n".join(words)) for _, words in lists], pa.binary()),
                ],
                schema=arrow,
            )

    return rows.mapInArrow(run, schema)


def _placed_texts(rows: DataFrame, buckets: int) -> DataFrame:
    """``block, row, packed``: every row with its words as places in its block's list."""
    schema = T.StructType(
        [T.StructField("block", T.BinaryType()), rows.schema["row"], T.StructField("packed", T.BinaryType())]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            key, packed = block.digest.digest(), block.packed(buckets)
            for at in range(0, len(block.rows), 1024):
                part = block.rows[at : at + 1024]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key] * len(part), pa.binary()),
                        pa.array([r.as_py() for r in part], arrow.field(1).type),
                        pa.array(list(islice(packed, len(part))), pa.binary()),
                    ],
                    schema=arrow,
                )

    return rows.mapInArrow(run, schema)


def _squeeze(text: str) -> bytes:
    return zstandard.compress(text.encode("utf-8", "surrogatepass"), 3)


def _spread(packed: bytes) -> list[str]:
    return zstandard.decompress(packed).decode("utf-8", "surrogatepass").split("\n")


def _encode_once(words: DataFrame, tokenizer_json: str) -> DataFrame:
    """``block, bucket, ids``: the packed ids of packed words, each word encoded once in a task."""
    schema = T.StructType.fromDDL("block binary, bucket int, ids binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        known: dict[str, str] = {}
        for batch in batches:
            out = []
            for packed in batch.column("words").to_pylist():
                words = _spread(packed)
                if len(known) > CACHE_WORDS:
                    known.clear()
                fresh = [w for w in words if w not in known]
                for at in range(0, len(fresh), 4096):
                    part = fresh[at : at + 4096]
                    coded = tokenizer.encode_batch_fast(part, add_special_tokens=False)
                    known.update((w, " ".join(map(str, e.ids))) for w, e in zip(part, coded))
                out.append(_squeeze("\n".join([known[w] for w in words])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], schema=arrow
            )

    return words.mapInArrow(run, schema)


def pieces_of(tokenizer_json: str) -> list[str]:
    """The id-to-piece table: the piece of each id, special tokens included."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    return [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]


def _plain_tokenizer(path: str) -> str:
    """The tokenizer's file without truncation and padding, checked for what blocks rely on."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["truncation"] = spec["padding"] = None
    if "\\s+" not in json.dumps(spec.get("normalizer")).replace("\\\\", "\\") or spec.get("decoder"):
        raise ValueError("words can be encoded alone only by a tokenizer that drops white space and has no decoder")
    return json.dumps(spec)


def encode_words(rows: DataFrame, path: str, finish: str, per_text) -> DataFrame:
    """``row`` and what ``per_text(ids, pieces)`` makes of each text.

    ``rows`` has columns ``row`` (anything, handed through) and ``text``. ``ids`` is
    a list of the words' ids, each as decimals joined by spaces; ``pieces`` gives
    the pieces of such a text of ids. ``finish`` is the DDL of the columns made.
    """
    tokenizer_json = _plain_tokenizer(path)
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS * parts
    pieces = spark.sparkContext.broadcast(pieces_of(tokenizer_json))
    coded = _encode_once(_distinct_words(rows, buckets).repartition(parts, "bucket"), tokenizer_json)
    row_field = T.StructField("row", rows.schema["row"].dataType)
    nothing = F.lit(None)
    both = coded.select(
        "block", "bucket", "ids", nothing.cast(row_field.dataType).alias("row"), nothing.cast("binary").alias("packed")
    ).unionByName(
        _placed_texts(rows, buckets).select(
            "block", F.lit(buckets).alias("bucket"), nothing.cast("binary").alias("ids"), "row", "packed"
        )
    )
    together = both.repartition(parts, "block").sortWithinPartitions("block", "bucket")
    out = T.StructType([row_field, *T.StructType.fromDDL(finish).fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces.value

        def decode(ids: str) -> str:
            return " ".join([table[int(i)] for i in ids.split()])

        current, last, ids, texts = None, -1, [], []
        for batch in batches:
            keys, numbers = batch.column("block").to_pylist(), batch.column("bucket").to_pylist()
            at = 0
            while at < len(keys):
                if keys[at] != current:
                    current, last, ids, texts = keys[at], -1, [], []
                if numbers[at] < buckets:
                    # blocks of equal texts share a key and bring their words twice
                    if numbers[at] != last:
                        last = numbers[at]
                        fresh = _spread(batch.column("ids")[at].as_py())
                        ids += fresh
                        texts += map(decode, fresh)
                    at += 1
                    continue
                end = at
                while end < len(keys) and end - at < 1024 and keys[end] == current:
                    end += 1
                blank = "" in ids
                made = []
                for packed in batch.column("packed").slice(at, end - at).to_pylist():
                    found = _unpack(packed)
                    if found and max(found) >= len(ids):
                        raise RuntimeError("input rows came in another order when they were read again")
                    if blank:  # a word of nothing the tokenizer knows has no ids
                        found = [i for i in found if ids[i]]
                    made.append(per_text(list(map(ids.__getitem__, found)), list(map(texts.__getitem__, found))))
                columns = list(zip(*made))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(at, end - at).cast(arrow.field(0).type)]
                    + [pa.array(c, arrow.field(i + 1).type) for i, c in enumerate(columns)],
                    schema=arrow,
                )
                at = end

    return together.mapInArrow(run, out)


def encode(docs: DataFrame, path: str, text: str = "text", keep: list | None = None) -> DataFrame:
    """Columns ``keep`` (the id) of every row with ``ids`` (array of int)."""

    def per_text(ids: list[str], _: list[str]) -> tuple:
        return ([int(i) for i in " ".join(ids).split()],)

    return _over(docs, path, text, keep or ["doc_id"], "ids array<int>", per_text)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """``id, piece``, a row per id of the vocabulary."""
    pieces = pieces_of(_plain_tokenizer(path))
    return spark.createDataFrame(list(enumerate(pieces)), "id int, piece string")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Columns of ``encoded`` with ``decoded``: the pieces of its ids joined by spaces.

    The ids are spread with their positions, joined to the id-to-piece table (a
    broadcast of the vocabulary's size) and put in order again. Ids outside the
    vocabulary give nothing; null or empty ids give the empty string.
    """
    numbered = encoded.select(F.struct(*encoded.columns).alias("_row"), F.monotonically_increasing_id().alias("_at"))
    found = (
        numbered.select("_row", "_at", F.posexplode_outer(F.col("_row").getField(ids)).alias("_pos", "id"))
        .join(F.broadcast(piece_table(encoded.sparkSession, path)), "id", "left")
        .groupBy("_at").agg(
            F.first("_row").alias("_row"),
            F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("_pos", "piece")))).alias("_pieces"),
        )
    )
    return found.select("_row.*", F.array_join(F.col("_pieces.piece"), " ").alias("decoded"))


def encode_digests(docs: DataFrame, path: str, text: str = "text", keep: list | None = None) -> DataFrame:
    """Columns ``keep`` (the id) with ``n_tokens, ids_sha256, decoded_sha256`` of every row."""

    def per_text(ids: list[str], texts: list[str]) -> tuple:
        joined, decoded = " ".join(ids), " ".join(texts)
        return (
            joined.count(" ") + 1 if joined else 0,
            hashlib.sha256(joined.encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest(),
        )

    finish = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _over(docs, path, text, keep or ["doc_id"], finish, per_text)


def _over(docs: DataFrame, path: str, text: str, keep: list, finish: str, per_text) -> DataFrame:
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("text"))
    made = encode_words(rows, path, finish, per_text)
    return made.select("row.*", *[f.name for f in T.StructType.fromDDL(finish).fields])
