"""The queries against their SQL, and the pipeline against its operators by brute force."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from grainspan.llm import registry
from grainspan.llm.scratch import table

from . import test_decontaminate, test_neardup
from .helpers import awkward, prose

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = registry.QUERIES[name](spark, SF)
    order = sorted(frame.columns)
    rel = con.sql(registry.SQL[name])
    at = [rel.columns.index(c) for c in order]
    want = sorted((tuple(r[k] for k in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in order) for r in frame.collect()), key=repr) == want


def test_registered():
    every = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in every) for k in range(1, 11)] == [1] * 10 and "pipeline" in every


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in docs.collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and all(after[i] == before[i] for i in after), name
        if k == 1:
            want = {c for _, _, c in test_neardup.brute([(r.doc_id, r.text) for r in before.values()])}
            assert set(after) == want
        if k == 2:
            assert set(after) == {i for i, r in before.items() if not test_decontaminate.brute(r.text, items)[1]}
        if k == 4:
            assert set(after) == set(before) and docs.select("shard").distinct().count() == min(8, len(after))
        assert len(after) >= 0.5 * len(before)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"shard", "slot", "doc_id", "text"} <= set(out.columns) and out.count() > 50


def test_a_second_run_leaves_the_first_result(spark):
    a = corpus_pipeline.run(spark, SF)
    n = a.count()
    b = corpus_pipeline.run(spark, SF)
    assert b.count() == n == a.count()


def awkward_tables(spark, path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, stats long, shard string, fp int"
    full = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None, "r", k, "x", None) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, schema).write.parquet(f"{path}/documents.parquet")
    marks = [(i, k % 2, 0) for k, (i, _) in enumerate(rows)] + [(None, 1, 1), (7, None, None)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "one passage of a benchmark that is here"), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_awkward_tables(spark, tmp_path):
    rows = awkward() + [(20 + k, " ".join(prose(50, 60 + k))) for k in range(12)]
    awkward_tables(spark, str(tmp_path / "some"), rows)
    out = corpus_pipeline.run(spark, str(tmp_path / "some"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "stats", "fp", "shard", "slot"]
    assert {(r.doc_id, r.text) for r in out.collect()} <= set(rows)
    spark.createDataFrame([], spark.read.parquet(str(tmp_path / "some" / "documents.parquet")).schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / "some" / f"{t}.parquet")).filter("false").write.parquet(str(tmp_path / "none" / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_no_stage_loses_rows_that_share_an_id(spark, tmp_path):
    """Of two texts under one id, each stage keeps or drops each for itself."""
    texts = [" ".join(prose(120, 40 + k, 3000)) + "." for k in range(6)]
    awkward_tables(spark, str(tmp_path), [(5, t) for t in texts])
    docs = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, str(tmp_path))
        assert sorted(r.text for r in docs.collect()) == sorted(texts), name
