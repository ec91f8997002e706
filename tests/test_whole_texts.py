"""Scanners and evaluators on cases that no table holds."""

import pytest
from paperloom.functions import text as T
from paperloom.operators import arithmetic, candidates, records, tables
from pyspark.sql import functions as F

SUMS = {
    "1+2*3": 7.0, "(1+2)*3": 9.0, "2**3**2": 512.0, "-2**2": -4.0, "2**-1": 0.5, "--3": 3.0, "1.5e2+.5": 150.5, "4*(2-(3+1))-5": -13.0, "8/4/2": 1.0, "1-2-3": -4.0,
    "1/0": "division by zero", "0**-1": "division by zero", "((1)": "unbalanced parentheses", "3)": "unbalanced parentheses", "1+": "operand missing", "()": "operand missing", "1 2": "operator missing",
    "a+1": "unknown token", "": "empty", None: "empty", "(0-8)**.5": "no real result", "9**9**9": "too large",
}


def test_sums(spark):
    rows = spark.createDataFrame([(e,) for e in SUMS], "e string").select("e", arithmetic.calculate(F.col("e")).alias("c")).collect()
    assert {r.e: r.c.result if r.c.error is None else r.c.error for r in rows} == SUMS


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"x": 1}', ('{"x": 1}', "whole")), ('set {x} {"answer": "a}b"} {"answer": "c"}', ('{"answer": "a}b"}', "object")), ('say "{ {"answer": "q"}', ('{"answer": "q"}', "object")),
        ('<think>{"answer": "no"}</think> {"answer": "yes"', ('{"answer": "yes"}', "fields")), ('{"answer": "a", "citations": ["b"', ('{"answer": "a"}', "fields")), ('{"other": 1} tail', (None, "none")),
        ('[{"answer": "in a list"}]', ('{"answer": "in a list"}', "object")), ('"answer": 5', (None, "none")), (None, (None, "none")), ("", (None, "none")), ("{" * 3000, (None, "none")),
    ],
)
def test_outputs(text, want):
    assert records.read_output(text) == want


def test_answer_spans(spark):
    rows = [("The Cat sat, on the mat.", "cat SAT"), ("The Cat ; sat / on", "cat sat on"), ("a b a b c", "a b c"), ("a;b", "a b"), ("none", "x"), ("x", " "), (None, "x"), ("x", None), ("5% of 3", "of 3")]
    got = spark.createDataFrame(rows, "t string, a string").select(T.answer_span(F.col("t"), F.col("a")).alias("s")).collect()
    assert [tuple(r.s) if r.s else None for r in got] == [(4, 11), (4, 18), (4, 9), (0, 3), None, None, None, None, (3, 7)]


def test_headers(spark):
    cases = [
        ([["", "2019", "2018"], ["Revenue", "5", "4"]], ["", "2019", "2018"], 1),
        ([["(in thousands)", "Net", "Net"], ["", "2019", "2018"], ["Name", "Year ended", "Total"], ["Cash", "1", "2"]], ["(in thousands) Name", "Net 2019 Year ended", "Net 2018 Total"], 1),
        ([["Item", "Price"], ["Pen", "3"]], ["Item", "Price"], 1),
        ([["1", "2"], ["3", "4"]], [], 2),
        ([["2019", "2018"]], ["2019", "2018"], 1),
        ([], [], 0),
        ([["only"]], ["only"], 1),
    ]
    got = spark.createDataFrame([(r,) for r, _, _ in cases], "rows array<array<string>>").select(tables.split_header(F.col("rows")).alias("t")).collect()
    assert [(r.t.header, len(r.t.body)) for r in got] == [(h, n) for _, h, n in cases]


def test_rows_from_texts(spark):
    texts = ["Year Sales\n1999 $1,200\n2000 (30)", "In 1999 it was 5 and in 2000 then 7%.", "just words here", "word", "", None, "<b>a</b> 1"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tables.rows_from_text(F.col("t")).alias("r")).collect()
    assert [r.r for r in got][:2] == [[["Year", "Sales"], ["1999", "$1,200"], ["2000", "(30)"]], [["Year", "Value"], ["1999", "5"], ["2000", "7%"]]]
    assert [len(r.r) for r in got][2:] == [1, 0, 0, 0, 1]


def test_table_operations(spark):
    rows = [["", "2019", "2018"], ["Granted", "10", "30"], ["High", "9", "8"], ["Low", "4", "2"], ["Vested", "1", "1"], ["Granted", "20", "5"], ["Total", "100", "50"]]
    asked = {
        "difference between low and high in 2018": ("difference", 6.0), "what is the average granted": ("average", 15.0), "Vested as a percentage of Total?": ("percentage_of_total", 2.0), "what is the percentage change of the total from 2018 to 2019": ("percentage_change", 100.0),
        "sum of vested in 2019 and 2018": ("sum", 2.0),
    }
    given = spark.createDataFrame([(q, rows) for q in asked], "question string, rows array<array<string>>")
    assert {r.question: (r.operation, r.result) for r in tables.answer_table(given).collect()} == asked


def test_boards_of_hard_spans(spark):
    spans = [(1, "What is the source?", "c01", None, 0.5, 1, None), (1, "What is the source?", "c02", "", 0.5, 2, 10), (2, None, "c01", "Total: 5\n\x0bTotal: 5", None, None, None), (3, "", "c01", "x" * 200_000 + " 17", 2.0, 9, 999)]
    board = candidates.boards(spark.createDataFrame(spans, "qid long, question string, candidate_id string, text string, score double, page_rank int, top int")).collect()
    assert {r.qid for r in board} == {2, 3} and all(r["rank"] >= 1 for r in board)
    assert not candidates.boards(spark.createDataFrame([], "qid long, question string, candidate_id string, text string, score double, page_rank int, top int")).collect()
