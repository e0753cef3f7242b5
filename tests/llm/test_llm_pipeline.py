"""The pipeline: every stage on what its predecessor kept, and the driver's contract."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from guardlake.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == columns and got.join(docs, "doc_id", "left_anti").count() == 0
            docs = got
    kept = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in got.collect()} == kept and len(kept) > 100
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    leaked = {r.doc_id for r in llm_queries.queries()["op9_decontamination"](spark, SF).collect()}
    assert not leaked & kept and labels


def test_registered():
    names = llm_queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and len(corpus_pipeline.STAGES) == 5


def test_hot_rows_and_empty_tables(spark, tmp_path):
    """Every stage on tables without rows."""
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, stage):
    """Nulls in any column, empty texts, repeated rows and columns with clashing names."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id " * 30, None, None, None), (3, "same words here", "en", "s", 15), (3, "same words here", "en", "s", 15), (None, None, None, None, None), (4, "a\nb\n\nc " * 20, "de", None, 160)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("doc", "tag", "key", "unwanted", "rep", "gone_", "runs")})
    out = stage(spark, odd, SF)
    ids = [x.doc_id for x in out.select("doc_id").collect()]
    assert 4 in ids and (out.columns == odd.columns or "sequence_id" in out.columns)
