"""The best of each question in one pass, against the scores of all pairs."""

import random

import numpy as np
import pytest
from paperloom.operators import evidence, retrieval, scan
from paperloom.operators import vectors as V
from pyspark.sql import functions as F


def made(spark, seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "ü", "一", "cat", "dog", "x1", "run", "ran", "sun"]
    rows = [(f"d{i % 7}", f"b{i:03d}", " ".join(rng.choices(words, k=rng.randint(0, 14)))) for i in range(120)]
    rows += [("d1", f"c{i:03d}", "cat dog the") for i in range(60)] + [("d9", "n", None), ("d9", "e", ""), rows[3], rows[3], ("d2", "b005", "sun sun")]
    asked = [(i, " ".join(rng.choices([*words, "none"], k=rng.randint(1, 5)))) for i in range(25)] + [(90, ""), (91, None), (92, "the of")]
    return spark.createDataFrame(rows, "doc_id string, block_id string, text string"), spark.createDataFrame(asked, "qid long, question string")


def found(df, *names):
    return sorted((tuple(r[n] for n in names), round(r["score"], 5), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("held", [2_000_000, 40])
def test_search_in_one_pass_has_the_rows_of_all_pairs(spark, monkeypatch, held):
    monkeypatch.setattr(scan, "HELD", held)
    blocks, asked = made(spark)
    blocks = blocks.where("block_id <> 'b005'")  # of blocks that share a key and differ, all-pairs scores take each length by itself
    got = retrieval.bm25_top(blocks, asked, 5)
    assert found(got, "qid", "block_id") == found(retrieval.top(retrieval.bm25(blocks, asked).where("score > 0"), 5), "qid", "block_id")
    for k in (1, 3):
        got = retrieval.bm25_top_scoped(blocks, asked, k, "doc_id")
        assert found(got, "qid", "doc_id", "block_id") == found(retrieval.top(retrieval.bm25(blocks, asked, scope=("doc_id",)), k, by=("qid", "doc_id")), "qid", "doc_id", "block_id")


def test_search_shuffles_no_row_a_question_and_block(spark):
    blocks, asked = made(spark)
    blocks = blocks.dropDuplicates(["block_id"])  # those that share a key are made one by a join of their own
    plan = retrieval.bm25_top(blocks, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 1


@pytest.mark.parametrize("held", [2_000_000, 40])
def test_products_have_the_rows_of_all_pairs(spark, monkeypatch, held):
    monkeypatch.setattr(scan, "HELD", held)
    blocks, asked = made(spark)
    blocks = blocks.dropDuplicates(["block_id"])
    near = retrieval.hashed_top(blocks, asked, 6)
    index = V.build(V.text_vectors(blocks, "block_id"))
    want = V.search(index, V.text_vectors(asked, "qid", "question").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query")), 6)
    assert found(near, "qid", "block_id") == found(want, "qid", "vec_id")
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.integers(-2, 3, 4)] + [1.0]) for i in range(300)], "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 7 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    got = retrieval.dense_top(vectors, queries, 9)
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    monkeypatch.setattr(retrieval, "MAX_PASSES", 0)
    assert found(got, "qid", "vec_id") == found(retrieval.dense_top(vectors, queries, 9), "qid", "vec_id")


def test_spans_meet_by_a_trie_or_a_join(spark, monkeypatch):
    rng = random.Random(5)
    words = ["a", "b", "ab", "A.", "一", "b,"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(60)] + [(60, None)]
    parts = [(i, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(60)] + [(60, None), (61, texts[5][1][:40])]
    given = spark.createDataFrame(texts, "t long, text string"), spark.createDataFrame(parts, "p long, answer string")
    got = sorted(map(tuple, evidence.spans_in(*given, "t", "text", "p", "answer").collect()))
    monkeypatch.setattr(evidence, "few", lambda df, rows=0: False)
    assert got and got == sorted(map(tuple, evidence.spans_in(*given, "t", "text", "p", "answer").collect()))
