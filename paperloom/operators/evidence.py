"""Evidence: scoring, packing, candidate answers, contexts, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import STOPWORDS, few, small
from .scan import runs_met

# Patterns of candidate answers.
CANDIDATES = (("percent", r"\d+(?:\.\d+)?%"), ("money", r"\$\d[\d,]*(?:\.\d+)?"), ("date", r"\d{4}-\d{2}-\d{2}"), ("parenthesized", r"\(\d[^)]*\)"))


def keywords(question: Column) -> Column:
    return F.filter(F.array_distinct(T.tokens(question)), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def block_score(question: Column, text: Column, rank: Column, hint: Column) -> Column:
    """Keyword share (inside words too), values for numeric questions, place in the ranking, block type."""
    asked = keywords(question)
    hits = F.size(F.filter(asked, lambda k: F.contains(F.lower(text), k)))
    lexical = 0.4 * F.least(hits / F.greatest(F.size(asked), F.lit(1)), F.lit(1.0))
    values = F.when(text.rlike("[0-9]") & hint.isin("numeric", "date"), 0.12).otherwise(0.0)
    return lexical + values + F.greatest(F.lit(0.0), 0.18 - 0.03 * (rank - 1)) + 0.06


def candidates(blocks: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind and value of every candidate answer, each once."""
    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    rows = blocks.select(key, F.explode(F.concat(*[of(*c) for c in CANDIDATES])).alias("found"))
    return rows.select(key, "found.kind", "found.value")


def penalise_duplicates(rows: DataFrame, group: str, answer: str, score: str, key: str) -> DataFrame:
    """Later candidates with the same answer lose .15, .22, ... at most .35; rank by what is left."""
    nth = F.row_number().over(Window.partitionBy(group, answer).orderBy(F.desc(score), key)) - 1
    left = rows.withColumn("final", F.round(F.col(score) - F.when(nth == 0, 0.0).otherwise(F.least(0.08 + 0.07 * nth, F.lit(0.35))), 6))
    return left.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("final"), key)))


def context(ranked: DataFrame, limit: int, budget: int) -> DataFrame:
    """Texts cut to the limit, as long as their running length stays within the budget."""
    cut = ranked.withColumn("shown", T.smart_truncate(F.col("text"), limit))
    used = F.sum(F.length("shown")).over(Window.partitionBy("qid").orderBy("rank"))
    return cut.withColumn("used", used).where(F.col("used") <= budget)


def recovery_windows(ranked: DataFrame, k: int) -> DataFrame:
    """Overlapping windows of k ranks, half a window apart: the ids of each."""
    starts = ranked.select("qid", "block_id", "rank", F.explode(F.array(F.lit(0), F.lit(k // 2), F.lit(k))).alias("start")).where((F.col("rank") > F.col("start")) & (F.col("rank") <= F.col("start") + k))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block_id"))), lambda x: x["block_id"])
    return starts.groupBy("qid", "start").agg(F.array_join(ids, ",").alias("block_ids"))


def heuristic_answer(question: Column, text: Column) -> Column:
    """What follows a label that the question asks for, else the first line."""
    low, value = F.lower(question), r"[:：]\s*([A-Za-z0-9$.,% -]+)"
    pick = lambda p: F.regexp_extract(text, f"(?i)(?:{p}){value}", 1)
    found = F.when(F.contains(low, F.lit("date")), pick(r"invoice\s+date|date")).when(T.any_in(low, ("revenue", "total", "amount")), pick("revenue|total|amount")).otherwise(pick(r"answer|date|revenue|invoice(?: no)?|total"))
    return F.when(F.trim(found) != "", F.trim(found)).otherwise(F.substring(F.substring_index(text, "\n", 1), 1, 120))


def neighbour_window(primary: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Blocks within k places of a primary block (qid, doc_id, ord) in its document."""
    around = primary.select("qid", "doc_id", F.explode(F.sequence(F.col("ord") - k, F.col("ord") + k)).alias("ord"))
    return small(around).join(blocks, ["doc_id", "ord"])


def merge_small(lines: DataFrame, small: int = 100, most: int = 1000) -> DataFrame:
    """Blocks under `small` characters join the one before them on the page while both have at most `most`: doc_id, page, part, text."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (F.length(x) < small) & (F.length(last) + F.length(x) + 1 <= most)
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n"), x)))).otherwise(F.concat(acc, F.array(x)))

    merged = lines.groupBy("doc_id", "page").agg(texts.alias("texts")).select("doc_id", "page", F.aggregate("texts", none, step).alias("parts"))
    return merged.select("doc_id", "page", F.posexplode("parts").alias("part", "text"))


def split_large(blocks: DataFrame, key: str, most: int = 1200) -> DataFrame:
    """Texts over `most` characters as runs of whole sentences of at most that (a longer sentence stays whole): key, part, text."""
    sentences = F.split("text", r"(?<=[.!?])\s+")
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (F.length(last) + 1 + F.length(x) <= most)
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), x)))).otherwise(F.concat(acc, F.array(x)))

    parts = F.when(F.length("text") <= most, F.array("text")).otherwise(F.aggregate(sentences, none, step))
    return blocks.select(key, F.posexplode(parts).alias("part", "text"))


def spans_in(texts: DataFrame, answers: DataFrame, key: str, text: str, answer_key: str, answer: str, anchor: int = 4) -> DataFrame:
    """key, answer_key, start and end of each answer in each text that holds it (T.answer_span), for answers of anchor + 2 words or more.

    Whoever holds an answer holds its words but the first and last whole and in order; so the words after the first make an anchor, and texts
    and answers meet by anchors alone. If answers are more than can be broadcast, texts are read again for those that meet.
    """
    index = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(rf"{T.SPAN_TOKEN}+"), F.lit(0))
    grams = lambda words, first, last: F.transform(F.sequence(first, last), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(anchor)), " ")))
    asked = answers.select(answer_key, answer, F.regexp_extract_all(F.lower(F.col(answer)), F.lit(rf"{T.SPAN_TOKEN}+"), F.lit(0)).alias("__words")).where(F.size("__words") >= anchor + 2)
    asked = asked.select(answer_key, answer, F.slice("__words", 2, anchor).alias("__run"), F.get(grams(F.col("__words"), F.lit(2), F.lit(2)), F.lit(0)).alias("__anchor"))
    if few(asked):
        runs = [(r["__run"], r["__anchor"]) for r in asked.select("__run", "__anchor").distinct().collect()]
        met = runs_met(texts.select(key, text, index.alias("__words")), "__words", runs, "__anchor")
        both = met.join(F.broadcast(asked.drop("__run")), "__anchor")
    else:
        held = texts.select(key, index.alias("__words")).where(F.size("__words") >= anchor)
        held = held.select(key, F.explode(F.array_distinct(grams(F.col("__words"), F.lit(1), F.size("__words") - anchor + 1))).alias("__anchor"))
        pairs = held.join(asked.select(answer_key, "__anchor"), "__anchor").select(key, answer_key).distinct()
        both = pairs.join(asked.select(answer_key, answer), answer_key).join(texts.select(key, text), key)
    # The outer form makes the span once; a filter on it alone would make it again.
    found = both.select(key, answer_key, F.explode_outer(F.array(T.answer_span(F.col(text), F.col(answer)))).alias("s")).where("s is not null")
    return found.select(key, answer_key, "s.start", "s.end")
