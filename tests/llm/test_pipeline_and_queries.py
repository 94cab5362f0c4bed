"""The pipeline's stages in a row, and every text query against its SQL."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftpanel.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, SF_DIR).toPandas()
    assert len(found)
    if name in ORACLES:
        con = duckdb.connect()
        for table in ("documents", "benchmark", "embeddings"):
            con.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
        expected = con.execute(ORACLES[name]).fetch_df()
        columns = sorted(expected.columns)
        found = found.astype({c: kind for c, kind in expected.dtypes.items() if str(kind) == "Int64"})  # longs with nulls
        assert columns == sorted(found.columns)
        as_rows = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))
        assert as_rows(found) == as_rows(expected)


def test_native_queries_run_no_python(spark):
    for name in ("op9_personal_data", "op10_license_scan"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Arrow" not in plan and "Python" not in plan


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    shared = "one two three four five six seven eight nine ten eleven twelve"
    own = [f"word{i} " * 1 + " ".join(f"own{i}x{k}" for k in range(30)) for i in range(6)]
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first()["text"]
    rows = [(10**6 + i, t, "en", "src1", len(t)) for i, t in enumerate(
        [own[0], own[1] + "\n" + shared, own[2] + "\n" + shared, own[0], own[3] + "\n" + own[4].replace("own4x7 ", ""), own[4], item + "\n" + own[5], "", "short one"])]
    docs = docs.union(spark.createDataFrame(rows, docs.schema)).unionByName(
        spark.createDataFrame([(None, None, None, None, None), rows[1], rows[1]], docs.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == COLUMNS, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert texts[10**6] == own[0] and texts[10**6 + 1] == own[1] + "\n" + shared
    assert texts[10**6 + 2] == own[2] and 10**6 + 3 not in texts and 10**6 + 5 not in texts and 10**6 + 6 not in texts and 10**6 + 7 not in texts
    assert docs.filter("doc_id = 1000001").count() == 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert last.count() == docs.count() and last.filter(~F.col("lossless")).isEmpty()


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 100


def test_short_lines_are_compared(spark, tmp_path):
    texts = ["Share this on Facebook\nfirst", "own line\nshare THIS on facebook", "First\n\nAll rights reserved", "all rights reserved", "share this on facebook now"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()}
    assert [(found[i]["n_lines"], found[i]["n_equal"], found[i]["n_near"]) for i in range(5)] == [(2, 0, 0), (2, 1, 0), (2, 1, 0), (1, 1, 0), (1, 0, 0)]
    assert found[1]["text_sha256"] == hashlib.sha256(b"own line").hexdigest()


def test_documents_with_other_text_stay(spark):
    shared = "one two three four five six seven eight nine ten eleven twelve"
    verse = "\n".join(f"short line {i}" for i in range(200))
    texts = [f"{shared}\nthe first", f"{shared}\n{verse}", f"{shared}\n{verse}", shared, None, " \n"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: r for r in corpus_pipeline.line_dedup(spark, docs, SF_DIR).collect()}
    assert {i: r["text"] for i, r in found.items()} == {0: texts[0], 1: verse, 4: None, 5: " \n"}
    assert found[1]["n_chars"] == len(verse)
