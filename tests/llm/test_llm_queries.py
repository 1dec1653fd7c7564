"""Registered queries and the pipeline, on the smallest tables."""

import os
from unittest.mock import MagicMock

import duckdb
import pytest

import corpus_pipeline
from millrace.llm import catalogue
from millrace.llm._common import ready, scratch, settled, shared_dir, table, written

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")


@pytest.mark.parametrize("key", sorted(catalogue.oracle_sql()))
def test_matches(spark, key):
    con = duckdb.connect()
    for name in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{TABLES}/{name}.parquet')")
    theirs = con.execute(catalogue.oracle_sql()[key])
    names = [d[0] for d in theirs.description]
    mine = catalogue.queries()[key](spark, TABLES)
    assert sorted(mine.columns) == sorted(names)
    show = lambda rows: sorted(repr([r[c] for c in sorted(names)]) for r in rows)
    assert show(r.asDict() for r in mine.collect()) == show(dict(zip(names, r, strict=True)) for r in theirs.fetchall())


def test_pipeline(spark):
    docs = table(spark, TABLES, "documents")
    begun = {r["doc_id"] for r in docs.select("doc_id").collect()}
    last = None
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, TABLES)
        if name != "packing":
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
            kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert kept <= begun
            last = kept
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == last
    begun = set(os.listdir(_local(spark)))
    packed = corpus_pipeline.run(spark, TABLES)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == last
    left = {name.split("-")[0] for name in set(os.listdir(_local(spark))) - begun}
    assert "decontamination" in left  # the last stage reads it
    assert not left & {"toxicity", "quality", "near_duplicates", "counts", "sample", "signed", "sets", "members", "classes"}


def _local(spark):
    return shared_dir(spark).removeprefix("file:")


@pytest.mark.parametrize("master, fits", [("local", True), ("local[4]", True), ("local[*]", True), ("local-cluster[2,1,1024]", False), ("yarn", False), ("spark://host:7077", False)])
def test_own_folder_on_one_machine_only(master, fits):
    session = MagicMock()
    session.conf.get.return_value = None
    context = session.sparkContext
    context.master = master
    held = context._jsc.sc().getCheckpointDir()
    held.isDefined.return_value = False
    held.get.return_value = "file:/own/"
    if fits:
        assert shared_dir(session) == "file:/own"
        context.setCheckpointDir.assert_called_once()
        os.rmdir(context.setCheckpointDir.call_args.args[0])
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session)


def test_settled_drops_its_scratch_only(spark):
    mine = scratch(spark, "kept")
    spark.range(3).write.parquet(mine)
    out = settled(spark, lambda: written(spark.range(5), "within").where("id > 1"), scratch(spark, "out"))
    assert out.count() == 3 and os.path.isdir(mine.removeprefix("file:"))
    assert not [name for name in os.listdir(_local(spark)) if name.startswith("within-")]
    with pytest.raises(ZeroDivisionError):
        settled(spark, lambda: written(spark.range(5), "within").limit(1 // 0), scratch(spark, "out"))
    assert not [name for name in os.listdir(_local(spark)) if name.startswith("within-")]


@pytest.mark.parametrize("had, has", [("10000", "1000"), ("0", "1000"), ("200", "200")])
def test_rows_at_once(spark, had, has):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, had)
        ready(spark)
        assert spark.conf.get(key) == has
    finally:
        spark.conf.set(key, before)
