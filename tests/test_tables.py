from pyspark.sql import functions as F

from paperloom.operators import tables


def test_answers_and_how_often_words_are_made(spark):
    """A question's words are made a few times a table, not for each of its rows and cells."""
    rows = [["Year", "Orders", "Total"], ["2019", "3", "1,200"], ["2020", "5", "(40)"], ["Low", "1", "7"], ["High", "2", "9"]]
    asked = ["What is the difference in total from 2019 to 2020?", "What is the difference in total between High and Low?", "What is the average orders from 2019 to 2020?"]
    given = spark.createDataFrame([(i, q, rows) for i, q in enumerate(asked)], "qid int, question string, rows array<array<string>>")
    done = tables.answer_table(given)
    assert [r.text for r in done.orderBy("qid").collect()] == ["The difference is -1240.", "The difference is 2.", "The average is 601.5."]
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_extract_all(lower(question") <= 6


def test_bound_is_null_safe(spark):
    row = spark.range(1).select(tables.bound(F.lit(None).cast("string"), lambda x: F.coalesce(x, F.lit("none"))).alias("a"), tables.bound(F.lit(2), lambda x: x * x).alias("b")).first()
    assert (row.a, row.b) == ("none", 4)
