"""The pipeline's stages and the operators' queries; test_pipeline_near holds the pipeline against brute force."""

import public_tokenizers as P

import corpus_pipeline
from pagemill.llm import queries


def test_stages_but_the_last_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert P.PATTERN
