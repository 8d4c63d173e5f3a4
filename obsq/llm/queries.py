"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsq.llm.bpe import encode_digests
from obsq.llm.htmltext import extract_pages
from obsq.llm.imatch import edited_digests
from obsq.llm.linededup import line_dedup_digests
from obsq.llm.mixing import mix_sources
from obsq.llm.periodic import run_digests
from obsq.llm.pii import pii_digests
from obsq.llm.quality import quality_rules
from obsq.llm.secrets import secret_digests
from obsq.llm.simhash import near_dedup_digests
from obsq.llm.topk import top_k, vectors
from obsq.llm.toxicity import toxicity
from obsq.llm.trie import conversation_trie


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_bpe(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path("word_bpe_49k.json")
    return encode_digests(_table(spark, folder, "documents"), path)


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii_digests(_table(spark, folder, "documents"))


def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    points = vectors(_table(spark, folder, "embeddings"))
    return top_k(points, points.filter(F.col("vec_id") % 50 == 0))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup_digests(_table(spark, folder, "documents"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup_digests(_table(spark, folder, "documents"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_digests(_table(spark, folder, "documents"))


def op8_html(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(_table(spark, folder, "pages"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(_table(spark, folder, "documents"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op11_runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_digests(_table(spark, folder, "documents"))


def op12_imatch(spark: SparkSession, folder: str) -> DataFrame:
    return edited_digests(_table(spark, folder, "documents"))


def op13_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(_table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe, op2_pii, op3_topk, op4_line_dedup, op5_simhash, op6_quality, op7_secrets, op8_html, op9_mixing,
        op10_toxicity, op11_runs, op12_imatch, op13_trie,
    )
}
