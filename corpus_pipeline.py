"""Documents through the corpus stages, each written as Parquet and read again.

What holds for every stage: a null text counts as empty, texts of any length are taken whole, null ids and rows with equal ids are kept
apart, an empty table gives an empty table, and all but the last return the columns that they get, whatever their names, with their
values. A stage's input is read more than once and must be the same each time; written tables are, and a difference raises an error.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import op02_source_mix, op04_jaccard_join, op06_quality_rules, op07_byte_bpe, op08_exact_dedup
from pagemill.llm.shared import discard, table, written

#: Near copies: words of a shingle, and the similarity from which documents link, NUM / DEN.
SHINGLE, NUM, DEN = 5, 80, 100


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; empty texts are too short and go. Repeated rows fare alike."""
    return op06_quality_rules.good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space the row with the most characters stays, of ties the one with the smallest id (null ids last),
    then the first. All empty texts are one group."""
    return op08_exact_dedup.one_of_each(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their 5-word shingles (a Jaccard similarity of 0.8 or more), directly or over others, the one with the smallest id
    stays (null ids last), of ties the first. Texts without words are linked with nothing and stay. The operator's defaults are those of the op4 query."""
    return op04_jaccard_join.one_of_each(docs, size=SHINGLE, num=NUM, den=DEN)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice. A null source is a source. Rows with equal id and text
    share their fate."""
    return op02_source_mix.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of what they decode to, a row for each row; an empty text has 0 tokens."""
    return op07_byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("byte_bpe", byte_bpe)]

#: The last stage's ids can't be had from SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:  # no later stage reads it
            discard(before)
        before = docs
    return docs
