"""Clashing column names, inputs that change between readings, and all code points."""

import uuid

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import op01_token_files as op1
from pagemill.llm import op02_source_mix as op2
from pagemill.llm import op04_jaccard_join as op4
from pagemill.llm import op06_quality_rules as op6
from pagemill.llm import op07_byte_bpe as op7
from pagemill.llm import op08_exact_dedup as op8
from pagemill.llm import op09_token_counts as op9
from pagemill.llm.shared import shared_dir
from test_operators import encoding, hard_rows

#: Names that the operators have, or had, inside.
NAMES = ["prefix", "left", "whole", "h__", "copies__", "copy__", "row__", "m__", "doc", "row", "mark", "stay_row", "stay_mark", "copies", "col", "d_source", "s_source", "words", "m", "part", "a.b", "with space"]


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clash") / "d")
    rows = [r[:5] for r in hard_rows()]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.select("*", *[F.lit(f"kept {i}").alias(k) for i, k in enumerate(NAMES)]).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("stage", [lambda d: op2.mixed(d), lambda d: op4.one_of_each(d), lambda d: op6.good(d), lambda d: op8.one_of_each(d), *[lambda d, f=f: f(d.sparkSession, d, "") for _, f in corpus_pipeline.STAGES[:-1]]])
def test_clashing_columns_come_back_as_they_are(clashing, stage):
    found = stage(clashing)
    assert found.columns == clashing.columns and found.schema.simpleString() == clashing.schema.simpleString()
    rows = found.collect()
    assert rows and all([r[k] for k in NAMES] == [f"kept {i}" for i in range(len(NAMES))] for r in rows)


def test_stages_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, row string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_stages_follow_each_other_on_hard_rows(spark, clashing):
    docs = clashing
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
        assert 0 < docs.count() <= before, name
        before = docs.count()


@pytest.mark.parametrize("stage", [lambda d: op4.one_of_each(d), lambda d: op8.one_of_each(d)])
def test_an_input_that_changes_raises(spark, stage):
    new = F.udf(lambda: f"{uuid.uuid4()} b c d e").asNondeterministic()
    changing = spark.range(40).select(F.col("id").alias("doc_id"), new().alias("text"))
    with pytest.raises(Exception, match="later reading"):
        stage(changing).collect()


def test_an_input_that_loses_rows_raises(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(30).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")).coalesce(1).write.parquet(path)
    from pagemill.llm.shared import mark, picked

    docs = spark.read.parquet(path)
    stay = docs.select(F.monotonically_increasing_id().alias("row"), mark(F.col("doc_id"), F.col("text")).alias("mark")).collect()
    stay = spark.createDataFrame(stay, "row long, mark long")
    assert picked(docs, stay, 30, "doc_id", "text").count() == 30
    with pytest.raises(Exception, match="later reading"):
        picked(docs.where("doc_id < 20"), stay, 30, "doc_id", "text").collect()


def test_a_folder_of_one_machine_is_no_shared_folder():
    class Context:
        master = "spark://somewhere:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    session = type("Session", (), {"conf": type("C", (), {"get": staticmethod(lambda k, d=None: None)})(), "sparkContext": Context()})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session)


def all_code_points():
    rng = np.random.default_rng(11)
    points = [*range(1, 0x3100), *range(0xA640, 0xA800), *range(0xFB00, 0xFE00), *range(0x1D400, 0x1D500), *range(0x1F300, 0x1F400), *rng.integers(0x3100, 0xD800, 400).tolist(), *rng.integers(0x10000, 0x110000, 400).tolist()]
    signs = [chr(p) for p in points]
    texts = [f"a{c}. {c}, B{c}A {c}{c}.\n{c} 'S{c}" for c in signs]
    picks = rng.integers(0, len(signs), (3000, 12))
    return texts + ["".join(signs[k] if k % 3 else signs[k] + ".," for k in row) for row in picks]


def test_ids_of_all_code_points():
    from tokenizers import Tokenizer

    path, texts = P.path("word_bpe_49k.json"), all_code_points()
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    data, at = op1.encode(path, 2, pa.array(texts))
    ids = np.frombuffer(data, "<u2")
    assert [ids[a // 2 : z // 2].tolist() for a, z in zip(at[:-1], at[1:], strict=True)] == want


def test_counts_of_all_code_points():
    from tokenizers import Tokenizer

    path, texts = P.path("byte_bpe_50k.json"), all_code_points()
    want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert op9.lengths(path, pa.array(texts)).tolist() == want


def test_words_of_all_code_points():
    enc, texts = encoding(), all_code_points()
    words, numbers, at = op7.split_words(P.PATTERN, pa.array(texts))
    ids = [enc._core_bpe.encode_single_piece(w.encode()) for w in words]
    assert [[t for k in numbers[a:z].tolist() for t in ids[k]] for a, z in zip(at[:-1], at[1:], strict=True)] == enc.encode_ordinary_batch(texts)
