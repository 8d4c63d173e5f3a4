"""The registered queries beside SQL, and the stages of the pipeline."""

import os

import duckdb
import pytest

import corpus_pipeline
from obsq.llm.oracle import ORACLE_SQL
from obsq.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sample_dir, name):
    connection = duckdb.connect()
    for file in os.listdir(sample_dir):
        connection.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sample_dir}/{file}'")
    want = connection.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, sample_dir).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    got, want = (f[columns].sort_values(columns).reset_index(drop=True) for f in (got, want))
    assert len(got) == len(want) and (got == want).all().all()


def test_pipeline_stages_take_effect(spark, sample_dir):
    docs = spark.read.parquet(f"{sample_dir}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, sample_dir).cache()
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "encoding"]
    mixed = corpus_pipeline.mixing(spark, kept, sample_dir)
    assert mixed.columns == docs.columns
    coded = corpus_pipeline.encoding(spark, kept.limit(20), sample_dir)
    assert coded.filter("n_tokens = 0").count() == 0
