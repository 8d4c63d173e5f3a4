"""The whole pipeline beside a plain chain of its stages."""

from collections import Counter

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from obsq.llm.oracle import ORACLE_SQL

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_shared_lines(docs):
    def keys(text):
        return [line.strip(SPACE).translate(LOWER) for line in (text or "").split("\n")]

    found = Counter(k for d in docs for k in set(keys(d["text"])) if k)
    out = []
    for d in docs:
        lines = (d["text"] or "").split("\n")
        kept = [line for line, k in zip(lines, keys(d["text"])) if found[k] < 10]
        out.append({**d, "text": "\n".join(kept)})
    return out


def shingles(text):
    words = text.encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def one_of_each_group(docs):
    """Groups are linked by similarities of 0.8 or more; the smallest id stays."""
    sets = [shingles(d["text"]) for d in docs]
    group = list(range(len(docs)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                group[find(i)] = find(j)
    least = {}
    for i, d in enumerate(docs):
        g = find(i)
        if g not in least or d["doc_id"] < least[g]["doc_id"]:
            least[g] = d
    return list(least.values())


def mixed(docs, spark, tmp_path):
    """Each document as often as the SQL of source mixing takes it."""
    path = str(tmp_path / "kept.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(path)
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    names = [c[0] for c in connection.execute(ORACLE_SQL["op9_mixing"]).description]
    rows = [dict(zip(names, r)) for r in connection.execute(ORACLE_SQL["op9_mixing"]).fetchall()]
    copies = {r["doc_id"]: r["copies"] for r in rows}
    return [d for d in docs for _ in range(copies[d["doc_id"]])]


@pytest.mark.parametrize("scale", ["sf0.001"])
def test_run_equals_the_chain(spark, sample_dir, tmp_path, scale):
    folder = sample_dir.replace("sf0.01", scale)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [r.asDict() for r in corpus_pipeline.quality(spark, docs, folder).collect()]
    assert 0 < len(kept) < docs.count() and len({d["doc_id"] for d in kept}) == len(kept)
    lines = without_shared_lines(kept)
    near = one_of_each_group(lines)
    assert len(near) < len(lines)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(
        (d["doc_id"], d["lang"], d["source"], tokenizer.encode(d["text"], add_special_tokens=False).ids)
        for d in mixed(near, spark, tmp_path)
    )
    got = sorted((r.doc_id, r.lang, r.source, list(r.ids)) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want
