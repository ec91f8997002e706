"""Operators without SQL, against plain Python, and readers and streams against files."""

import re

import pytest
from paperloom.functions import text as T
from paperloom.operators import evidence, retrieval, training
from paperloom.sources import files
from paperloom.streaming import ingest
from pyspark.sql import functions as F


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(("text", "want"), [("$1,200.50", 1200.5), ("(3.5)", -3.5), ("-7 of 9", -7.0), ("12%", 12.0), ("none", None), ("", None)])
def test_parse_number(spark, text, want):
    assert value(spark, T.parse_number, text) == want


@pytest.mark.parametrize(("text", "want"), [("Hello, World! 3.5%", "hello world 3.5%"), ("  A\n\tB ", "a b"), ("", "")])
def test_normalize(spark, text, want):
    assert value(spark, T.normalize, text) == want


def test_smart_truncate_cuts_in_the_second_half(spark):
    assert value(spark, lambda t: T.smart_truncate(t, 10), "aaaa bbbb cccc") == "aaaa bbbb"
    assert value(spark, lambda t: T.smart_truncate(t, 10), "a bbbbbbbbbbbbbb") == "a bbbbbbbb"
    assert value(spark, lambda t: T.smart_truncate(t, 10), "a  b") == "a b"


def test_f1_counts_repeats(spark):
    row = spark.createDataFrame([("a a b", "a b b")], "p string, g string").select(T.token_f1(F.col("p"), F.col("g")).alias("f"), T.character_f1(F.col("p"), F.col("g")).alias("c")).first()
    assert abs(row.f - 2 / 3) < 1e-9 and abs(row.c - 2 / 3) < 1e-9


def test_unique_ignoring_case(spark):
    row = spark.createDataFrame([(["A b", " a  B ", "", "c"],)], "x array<string>").select(T.unique_ignoring_case(F.col("x")).alias("u")).first()
    assert row.u == ["A b", "c"]


def test_fusion_matches_hand_values(spark):
    rows = [(1, "a", "x", 1), (1, "b", "x", 2), (1, "a", "y", 2), (1, "b", "z", 1)]
    got = retrieval.fused_top(spark.createDataFrame(rows, "qid int, source string, block_id string, rank int"), 3).orderBy("rank").collect()
    assert [(r.block_id, round(r.rrf, 6)) for r in got] == [("x", round(1 / 61 + 1 / 62, 6)), ("z", round(1 / 61, 6)), ("y", round(1 / 62, 6))]


def merge(texts, small=100, most=1000):
    out = []
    for t in texts:
        if out and len(t) < small and len(out[-1]) + len(t) + 1 <= most:
            out[-1] += "\n" + t
        else:
            out.append(t)
    return out


def test_merge_small_is_the_fold(spark):
    texts = ["a" * n for n in (50, 99, 100, 400, 20, 20, 900, 99, 1, 500, 70, 70, 70, 70, 70, 70, 70, 70)]
    lines = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(texts)], "doc_id int, page int, ord int, text string")
    assert [r.text for r in evidence.merge_small(lines).orderBy("part").collect()] == merge(texts)


def test_split_large_keeps_sentences(spark):
    text = " ".join("word " * (i % 37 + 1) + "end." for i in range(120))
    got = [r.text for r in evidence.split_large(spark.createDataFrame([(1, text)], "id int, text string"), "id").orderBy("part").collect()]
    want = []
    for s in re.split(r"(?<=[.!?])\s+", text):
        if want and len(want[-1]) + 1 + len(s) <= 1200:
            want[-1] += " " + s
        else:
            want.append(s)
    assert got == want


def test_quotas_sum():
    assert training.largest_remainder({"a": 0.4, "b": 0.5, "c": 0.1}, 128) == {"a": 51, "b": 64, "c": 13}


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é\n"), (2, None)], "id long, text string")
    files.write_jsonl(rows, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "out"), "id long, text string").collect())) == [(1, "é\n"), (2, None)]
    (tmp_path / "in.jsonl").write_text('﻿{"id": 1}\n\n{"id": 2}\n')
    assert [r.id for r in files.read_jsonl(spark, str(tmp_path / "in.jsonl"), "id long").orderBy("id").collect()] == [1, 2]


def test_text_pages_and_register(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\f \ftwo  x")
    (tmp_path / "b.bin").write_text("no")
    assert [(r.page, r.text) for r in files.read_text_pages(spark, str(tmp_path / "a.txt")).orderBy("page").collect()] == [(1, "one"), (3, "two x")]
    (row,) = files.register_files(spark, str(tmp_path)).collect()
    assert (row.name, row.size, len(row.id)) == ("a.txt", 12, 16)


def test_streams_match_batches(spark, tmp_path, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.run_once(ingest.window_counts(stream, "ts", "event_type", late="100 days"), str(tmp_path / "out"), str(tmp_path / "c1"), "complete")
    want = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    ingest.run_once(ingest.new_content(stream, "event_id", "event_type"), str(tmp_path / "seen"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "seen")).count() == events.select("event_type").distinct().count()
