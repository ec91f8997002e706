"""Logical inputs built from the tables: each as a DataFrame, and as a DuckDB common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document that isn't blank is a text block: doc_id, block_id, ord, text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    kept = docs.where(F.trim("text") != "").withColumn("ord", F.col("pos") + 1)
    return kept.select("doc_id", F.format_string("%s_p001_b%04d", "doc_id", "ord").alias("block_id"), "ord", "text")


BLOCKS = r"""blocks as (select doc_id, printf('%s_p001_b%04d', doc_id, ord) as block_id, ord, text from (
  select doc_id::varchar as doc_id, generate_subscripts(string_split(text, chr(10)), 1)::int as ord, unnest(string_split(text, chr(10))) as text from documents) where trim(text) <> '')"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 12 tokens of each benchmark passage ask for it: qid, question, answer."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(F.slice(T.tokens(F.col("text")), 1, 12), " ").alias("question"), F.col("text").alias("answer"))


QUESTIONS = r"""questions as (select item_id as qid, array_to_string(list_slice(regexp_extract_all(lower(text), '[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]'), 1, 12), ' ') as question, text as answer from benchmark)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction for each benchmark passage that leaves out every fifth word, and none in every fourth passage: qid, gold, prediction."""
    words = F.split("text", " ")
    kept = F.filter(words, lambda w, i: (F.col("item_id") % 4 == 0) | ((i + F.col("item_id")) % 5 != 0))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("gold"), F.array_join(kept, " ").alias("prediction"))


PREDICTIONS = r"""predictions as (select item_id as qid, text as gold, array_to_string([w for w, i in string_split(text, ' ') if item_id % 4 = 0 or (i - 1 + item_id) % 5 <> 0], ' ') as prediction from benchmark)"""

INTENTS = (
    "How many pages are in this document?", "How many tables does it have?", "What is on page 3?", "List all pages", "Extract all tables", "List section headings", "Give me an overview", "Summarize page 4",
    "What is this document about?", "What is shown in the picture?", "Which row has the highest value?", "What was the revenue in 2019?", "Help me", "Who signed the letter?", "Show the outline", "What is the average cost and then the total",
    "总结这份文件", "In 2019, what was the revenue?", "Show the text from page 7", "How many figure regions were detected?", "这份文档讲什么", "Which OCR blocks are stored?",
)


def intents(spark: SparkSession) -> DataFrame:
    """Questions of every kind: qid, question."""
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, INTENTS))).alias("qid", "question"))


INTENTS_SQL = "intents as (select * from (values " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(INTENTS)) + ") t(qid, question))"


def year_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals by year and status, in whole units: year, status, n, total."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum(F.floor("o_totalprice").cast("long")).alias("total"))


YEAR_ROWS = "year_rows as (select year(o_orderdate)::int as year, o_orderstatus as status, count(*) as n, sum(floor(o_totalprice)::bigint)::bigint as total from orders group by 1, 2)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages: doc_id, page (turn + 1), role, text."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "role", "text")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each page as blocks: doc_id, page, ord (in the page), block_id, text."""
    lines = messages(spark, sf_dir).select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(F.trim("text") != "")
    return lines.select("doc_id", "page", (F.col("pos") + 1).alias("ord"), F.format_string("%d_p%03d_b%04d", "doc_id", "page", F.col("pos") + 1).alias("block_id"), "text")


PAGE_LINES = r"""page_lines as (select doc_id, page, ord, printf('%d_p%03d_b%04d', doc_id, page, ord) as block_id, text from (
  select conv_id as doc_id, turn + 1 as page, generate_subscripts(string_split(text, chr(10)), 1)::int as ord, unnest(string_split(text, chr(10))) as text from conversations) where trim(text) <> '')"""
