"""Checks and citations against plain values, nulls and empty inputs among them."""

from paperloom.operators import checks, citations, documents, retrieval
from paperloom.plans import training
from pyspark.sql import functions as F


def column(spark, values, fn, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in rows.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_cell_numbers(spark):
    cells = ["$1,234.50", "(12.5)", "( $ -3 )", "12 %", "n/a", "", None, "5 units", "-7", "(abc)"]
    assert column(spark, cells, checks.cell_number) == [1234.5, -12.5, -3.0, 12.0, None, None, None, None, -7.0, None]
    assert column(spark, ["about (45%) of", "x", None, "-$3,000 due"], checks.diagnostic_number) == [-45.0, None, None, -3000.0]


def test_years_and_pages(spark):
    texts = ["in 2005 from 1999", "from 2001 to 2003", "FY 07 and FY98, 2007", "none", None]
    assert column(spark, texts, checks.calculation_years) == [["1999", "2005"], ["2001", "2003"], ["2007", "1998"], [], None]
    assert column(spark, ["page 3, p. 4 and Page 3", "第 5 页", "page 0", None], checks.page_refs) == [[3, 4], [5], None, None]


def test_rewrite_keeps_a_question_that_is_all_politeness(spark):
    texts = ["Could you please list dates in this document?", "this pdf", " Help me  find totals. "]
    assert column(spark, texts, checks.light_rewrite) == ["list dates", "this pdf", "find totals"]


def test_short_texts_and_headings(spark):
    texts = ["Annual report", "the of", "12,500", "table", "", None, "word " * 15, "Z"]
    assert column(spark, texts, checks.valid_short_text) == [True, False, True, True, False, False, False, True]
    assert column(spark, texts, checks.valid_heading) == [True, False, False, False, False, False, False, True]


def test_length_percentile_takes_the_truncated_place(spark):
    values = [5, 1, 1, 9, 7, 3, 3, 3, 2, 8]
    rows = spark.createDataFrame([("a", v) for v in values], "g string, v int")
    got = checks.length_percentile(rows, "g", "v", (0.5, 0.9, 1.0)).first()
    want = sorted(values)
    assert (got.p50, got.p90, got.p100) == tuple(want[int(9 * r)] for r in (0.5, 0.9, 1.0))


def test_candidate_contract(spark):
    outputs = ['{"answer": "a", "reasoning_summary": "r", "citations": []}', '{"answer": 1, "reasoning_summary": "r", "citations": []}', "[1]", None, "{}"]
    found = column(spark, outputs, citations.candidate_fault)
    assert found == [None, citations.NO_STRING, "parsed output is not an object", "parsed output is not an object", "missing fields: answer, reasoning_summary, citation_block_ids"]


def test_dates_of_all_formats(spark):
    rows = spark.createDataFrame([(1, "On March 3, 2001 and 3/4/99, then 2002 - 07, 2003-05."), (2, None), (3, "")], "id int, text string")
    got = {}
    for r in documents.dates(rows, "id", "text").collect():
        got.setdefault(r.id, set()).add(r.value)
    assert got == {1: {"March 3, 2001", "3/4/99", "2002 - 07", "2003-05", "2001", "2002", "2003"}}


def test_corpus_errors_see_null_texts_and_ids(spark, tmp_path):
    rows = [(1, "a"), (1, "b"), (2, None), (3, "same"), (4, "same"), (None, "x"), (5, "alone"), (6, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.error) for r in training.corpus_errors(spark, str(tmp_path)).collect())
    assert got == sorted([("1", "duplicate_id"), ("1", "duplicate_id"), ("2", "empty_text"), ("3", "duplicate_text"), ("4", "duplicate_text"), ("None", "missing_id"), ("6", "empty_text")])


def test_models_enter_as_callables(spark):
    rows = spark.createDataFrame([(1, "what", "abc"), (2, "who", None), (3, "how", "")], "id int, question string, text string")
    vectors = {r.id: list(r.vector) for r in retrieval.encode_with(rows, "id", "text", lambda texts: [[len(t), 1.0] for t in texts], batch=2).collect()}
    assert vectors == {1: [3.0, 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0]}
    scored = retrieval.score_with(rows, "question", "text", lambda pairs: [len(q) - len(t) for q, t in pairs]).collect()
    assert {r.id: r.model_score for r in scored} == {1: 1.0, 2: 3.0, 3: 3.0}
