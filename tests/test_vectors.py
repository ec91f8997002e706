"""The vector index against all pairs, on hard vectors too."""

import numpy as np
import pytest
from paperloom.operators import vectors as V
from paperloom.plans import vectors as P


def brute(rows, queries, k):
    out = set()
    for q, v in queries:
        a = np.array(v, float)
        scores = sorted((-round(float(a @ np.array(w, float) / (np.linalg.norm(a) * np.linalg.norm(w))), 6), i) for i, w in rows)
        out |= {(q, i, -s, r + 1) for r, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("copies, passes", [(1, 32), (40, 0)])
def test_search_is_exact(spark, monkeypatch, copies, passes):
    monkeypatch.setattr(V, "MAX_PASSES", passes)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8) + 3 * (i % 3 == 0)]) for i in range(150)]
    rows += [(1000 + i, rows[0][1]) for i in range(copies)]
    hard = [(2000, None), (2001, [0.0] * 8), (2002, [1.0] * 7 + [None])]
    df = spark.createDataFrame(rows + hard, "vec_id long, embedding array<float>")
    asked = rows[:6]
    queries = spark.createDataFrame([*asked, (99, None)], "qid long, query array<float>")
    got = {(r.qid, r.vec_id, r.rank) for r in V.search(V.build(df), queries, 7, probes=1).collect()}
    rounded = [(i, list(np.float32(v).astype(float))) for i, v in rows]
    assert got == {(q, i, r) for q, i, _, r in brute(rounded, rounded[:6], 7)}


def test_fewer_vectors_than_asked_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, 1.0])], "qid long, query array<double>")
    assert sorted((r.vec_id, r.rank) for r in V.search(V.build(df), queries, 5).collect()) == [(1, 1), (2, 2)]
    assert V.search(V.build(df.where("false")), queries, 5).collect() == []


def test_recall_of_the_bounded_search_is_whole(spark, medium):
    rows = {r.step: r for r in P.vector_index_recall(spark, medium).collect()}
    assert rows["bounded"].n == 100 and rows["bounded"].recall == 1.0
    assert rows["first_cells"].recall < 1  # vectors of that table have no clusters: the bound is what makes the search whole


def test_search_makes_no_row_for_a_query_and_cell_in_any_number_of_passes(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("a row for each query and cell")

    monkeypatch.setattr(V, "open_cells", refused)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, size=3) + 0.5]) for i in range(300)]  # many copies and ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame(rows[:7], "qid long, query array<double>")
    index, wanted = V.build(df), None
    for block, passes in ((512, 32), (2, 2)):
        monkeypatch.setattr(V.R, "QUERY_BLOCK", block)
        monkeypatch.setattr(V.R, "MAX_PASSES", passes)
        monkeypatch.setattr(V, "MAX_PASSES", passes)
        got = {(r.qid, r.vec_id, r.rank) for r in V.search(index, queries, 4, probes=1, skip_self=True).collect()}
        wanted = wanted or {(r.qid, r.vec_id, r.rank) for r in V.R.dense_top(df, queries, 4).collect()}
        assert got == wanted and len(got) == 28
        assert {(r.qid, r.vec_id, r.rank) for r in V.R.dense_top(df, queries, 4).collect()} == wanted


def test_vectors_of_one_file_are_dealt_over_tasks(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "vec_id long, embedding array<float>").coalesce(1)
    plan = V.R.dense_top(df, df.where("vec_id < 3").toDF("qid", "query"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(vec_id" in plan
