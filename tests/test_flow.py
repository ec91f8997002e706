"""The ingestion flow: repeated files, failures, a batch that is stopped midway and a second run."""

import pytest
from paperloom.streaming import flow
from pyspark.sql import functions as F


def add(spark, folder, rows):
    spark.createDataFrame(rows, "path string, content string").coalesce(1).write.mode("append").parquet(str(folder))


def tables(spark, folder):
    return {t: sorted(map(str, flow.stored(spark, str(folder), t).drop("batch").collect())) for t in flow.TABLES}


def run(spark, source, folder, parse=flow.line_blocks):
    stream = spark.readStream.schema("path string, content string").parquet(str(source))
    flow.ingest(stream, str(folder), str(folder) + "-checkpoint", parse)


FIRST = [("b", "one\n\ntwo\fthree"), ("a", "one\n\ntwo\fthree"), ("c", " \n\f"), ("d", None)]
LATER = [("e", "one\n\ntwo\fthree"), ("f", "new"), ("g", " \n\f")]


def test_contents_are_taken_in_once(spark, tmp_path):
    add(spark, tmp_path / "in", FIRST)
    run(spark, tmp_path / "in", tmp_path / "out")
    add(spark, tmp_path / "in", LATER)
    run(spark, tmp_path / "in", tmp_path / "out")
    run(spark, tmp_path / "in", tmp_path / "out")  # nothing new
    rows = {(r.path, r.parse_status): (r.pages, r.blocks) for r in flow.current(spark, str(tmp_path / "out")).collect()}
    assert rows == {("a", "parsed"): (2, 3), ("f", "parsed"): (1, 1), ("g", "parse_failed"): (0, 0), ("d", "parse_failed"): (0, 0)}
    pages = {(r.page, r.text, len(r.child_ids)) for r in flow.stored(spark, str(tmp_path / "out"), "pages").collect()}
    assert pages == {(1, "one\ntwo", 2), (2, "three", 1), (1, "new", 1)}


def test_a_stopped_batch_leaves_the_same_tables(spark, tmp_path):
    add(spark, tmp_path / "in", FIRST + LATER)
    run(spark, tmp_path / "in", tmp_path / "whole")
    calls = []

    def stops(docs):
        calls.append(1)
        parsed = flow.line_blocks(docs)
        return parsed.withColumn("text", F.raise_error(F.lit("stopped"))) if len(calls) == 1 else parsed

    with pytest.raises(Exception):
        run(spark, tmp_path / "in", tmp_path / "stopped", stops)
    run(spark, tmp_path / "in", tmp_path / "stopped", stops)
    assert len(calls) == 2 and tables(spark, tmp_path / "stopped") == tables(spark, tmp_path / "whole")
