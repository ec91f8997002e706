"""Candidate answers: tasks of the reports, texts full of numbers, short texts against plain Python."""

import random
import re
import time

from paperloom.functions import text as T
from paperloom.operators import candidates
from paperloom.operators import checks as C
from paperloom.plans import candidates as P
from pyspark.sql import functions as F

SPAN = "qid long, question string, candidate_id string, text string, score double, page_rank int, top int"


def test_reports_are_dealt_to_all_cores(spark, small):
    """The rows behind the reports fill less than one partition by bytes, and all their texts were read in one task."""
    filled = P.report_spans(spark, small).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(n > 0 for n in filled) >= spark.sparkContext.defaultParallelism


def test_texts_full_of_numbers(spark):
    """All numbers of a text were read again for each of them: 12 million here."""
    numbers = [f"{7 * k % 2500}" for k in range(3500)]
    spans = spark.createDataFrame([(1, "Who was it?", "c01", "(12) " + " ".join(numbers), 1.0, 1, None)], SPAN)
    began = time.time()
    rows = [r for r in candidates.candidates(candidates.asked(spans)).selectExpr("inline(found)").collect() if r.rule == "numeric"]
    took = time.time() - began
    years = {str(k) for k in range(1000, 2500)}  # dates of their own
    assert [r.value for r in rows] == [n for n in dict.fromkeys(numbers) if n not in years | {"12"}]
    assert took < 45
    assert all(r.plain == r.value for r in rows)


def test_short_texts(spark):
    rng = random.Random(5)
    pool = ["the", "a", "an", "and", "of", "the.", "Total", "x", "5%", "–", "é", "ab-c", "  ", "to", "\n", "表", ","]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["", " ", None, "a" * 91, "theand", "a an", "anand the"]

    def short(text, most_words, most_chars):
        if text is None or not text.strip(" ") or len(text.strip(" ")) > most_chars:
            return False
        words = re.sub(r"[^a-z0-9一-鿿.%+-]+", " ", text.lower()).split()
        return len(words) <= most_words and any(w not in C.SHORT_STOPWORDS for w in words)

    for limits in ((12, 90), (3, 20)):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select(C.valid_short_text(F.col("t"), *limits).alias("s")).collect()
        assert [r.s for r in got] == [short(t, *limits) for t in texts]
    assert spark.range(1).select(T.normalize_answer(F.lit("$1,200 ,$ Up"))).first()[0] == "1200 up"
