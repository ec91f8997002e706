"""Documents: blocks, pages, registry, extraction, summaries, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Words that make a page element informative or boilerplate, and date formats.
INFORMATIVE = ("abstract", "background", "conclusion", "findings", "overview", "purpose", "report", "result", "summary", "背景", "报告", "结果", "结论", "目的", "主要", "摘要")
BOILERPLATE = ("all rights reserved", "confidential", "page ", "copyright", "www.", "http://", "https://")
DATES = (
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    r"\b\d{4}[/-]\d{2}\b",
    r"\b\d{4}\s*[-/]\s*\d{2}\b",
    r"(?i)\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{1,2},?\s+\d{4}\b",
    r"\b(?:19|20)\d{2}\b",
)
# Terms and patterns of questions.
TABLE_TERMS = ("average", "calculated", "change", "decrease", "increase", "largest", "less", "more", "percentage", "ratio", "smallest", "table", "total", "value", "amount", "revenue", "sales", "year", "years")
VISUAL_TERMS = ("chart", "figure", "image", "infographic", "visual")
MEASURES = "(revenue|sales|income|profit|expense|cost|value|amount|rate)"
ROUTES = (
    (
        "document_statistics",
        r"\b(how many|number of|count|page count)\b.*\bpages?\b|\bpages?\b.*\b(count|number)\b"
        r"|\b(how many|number of|count|table count)\b.*\btables?\b|\btables?\b.*\b(count|number)\b"
        r"|\b(how many|number of|count|image count|figure count)\b.*\b(images?|figures?|image regions?|figure regions?)\b|\b(images?|figures?)\b.*\b(count|number|detected)\b"
        r"|\b(how many|number of|count)\b.*\b(ocr\s+)?blocks?\b|\bblocks?\b.*\b(count|number|stored)\b",
    ),
    ("page_lookup", r"\b(page|p\.)\s*\d+\b|\b(show|display|text from|what is on|summarize)\b.*\bpage\s*\d+\b|\blist\s+(all\s+)?pages\b"),
    ("structured_extraction", r"\b(extract|list|show)\s+all\b.*\b(tables?|figures?|images?|dates?|sections?|headings?)\b|\blist\s+(section\s+)?headings\b|\b(document\s+)?outline\b"),
    (
        "document_summary",
        r"\b(summarize|summary|overview|recap|abstract|takeaways?)\b|\bwhat is this (pdf|document|file)( mainly)? about\b|\bkey points?\b|\bmain points?\b"
        r"|总结|概括|摘要|主要内容|主要讲什么|这份(文件|文档).*讲什么",
    ),
    ("visual_question", r"\b(chart|graph)\b.*\b(color|trend|shown|look like|mean)\b|\bwhat is shown\b.*\b(picture|image|figure)\b|\b(picture|image|figure)\b.*\b(show|shown|depict|look like)\b"),
    (
        "table_or_calculation",
        r"\b(row|column|highest|lowest|maximum|minimum|difference|sum|average|ratio|percent change|growth)\b"
        rf"|\b{MEASURES}\b.*\b(19|20)\d{{2}}\b|\b(19|20)\d{{2}}\b.*\b{MEASURES}\b",
    ),
)
AMBIGUOUS = ("help", "help me", "can you help", "can you help me", "what about this", "tell me about it")


def page_aggregates(lines: DataFrame) -> DataFrame:
    """One block for each page of lines (doc_id, page, ord, block_id, text): children in reading order and their text."""
    children = F.array_sort(F.collect_list(F.struct("ord", "block_id", "text")))
    grouped = lines.groupBy("doc_id", "page").agg(children.alias("children"))
    return grouped.select("doc_id", "page", F.format_string("%d_p%03d_page", "doc_id", "page").alias("block_id"), F.array_join(F.transform("children", lambda c: c["text"]), "\n").alias("text"), F.transform("children", lambda c: c["block_id"]).alias("child_ids"))


def neighbours(lines: DataFrame) -> DataFrame:
    """Each block with the one before and after it in its document."""
    order = Window.partitionBy("doc_id").orderBy("page", "ord")
    return lines.withColumns({"previous_id": F.lag("block_id").over(order), "next_id": F.lead("block_id").over(order)})


def quality_report(lines: DataFrame) -> DataFrame:
    """Counts and checks of each document's structure, with a status."""
    own = Window.partitionBy("doc_id", "page").orderBy("ord")
    marked = lines.withColumn("gap", (F.col("ord") != F.row_number().over(own)).cast("int"))
    counted = marked.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.countDistinct("page").alias("pages"), F.countDistinct("block_id").alias("ids"), F.sum("gap").alias("gaps"), F.sum(F.length("text")).alias("chars"))
    return counted.withColumn("status", F.when(F.col("ids") < F.col("blocks"), "failed").when(F.col("gaps") > 0, "warnings").otherwise("passed"))


def register(docs: DataFrame) -> DataFrame:
    """Content hash, id from its first 16 digits, size; one row for each distinct content, that of the smallest doc_id."""
    rows = docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size"))
    return rows.groupBy("sha256", "size").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).withColumn("id", F.substring("sha256", 1, 16))


def upsert(old: DataFrame, new: DataFrame, key: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows in place of those with the same key; columns in `kept` stay as they were."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    pick = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c in kept else F.when(F.col(f"b.{key}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return both.select(*[pick(c).alias(c) for c in old.columns])


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def dates(blocks: DataFrame, key: str, text: str) -> DataFrame:
    """Each date of a block once: key, value."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for p in DATES]))
    return blocks.select(key, F.explode(F.array_distinct(found)).alias("value"))


def heading_like(text: Column) -> Column:
    plain = F.trim(text)
    return F.length(plain).between(4, 100) & ~F.substring(plain, -1, 1).isin(".", "。", "?", "？", "!", "！", ";", "；")


def summary_score(text: Column, page: Column) -> Column:
    """How well a block stands for its document: length, heading, an early page, telling words, less for boilerplate."""
    low = F.lower(text)
    part = lambda test, worth: F.when(test, worth).otherwise(0.0)
    return F.least(F.length(text) / 400.0, F.lit(1.0)) + part(heading_like(text), 0.3) + part(page.isin(1, 2), 0.1) + part(T.any_in(low, INFORMATIVE), 0.1) - part(T.any_in(low, BOILERPLATE), 0.25)


def summary_blocks(lines: DataFrame, pages: int = 8, per_page: int = 4) -> DataFrame:
    """The best blocks of each document's first pages."""
    scored = lines.withColumn("score", F.round(summary_score(F.col("text"), F.col("page")), 6))
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("score"), "ord")))
    return best.withColumn("page_no", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page"))).where((F.col("n") <= per_page) & (F.col("page_no") <= pages))


def route(question: Column) -> Column:
    """The kind of task a question asks for: the first rule that fits, else a local fact."""
    plain = F.lower(T.collapse(F.regexp_replace(question, "[?!.]+$", "")))
    found = F.when(plain == "", "invalid")
    for name, pattern in ROUTES:
        found = found.when(plain.rlike(pattern), name)
    return found.when(plain.isin(*AMBIGUOUS), "ambiguous").otherwise("local_fact")


def keywords(question: Column) -> Column:
    """Distinct lower-case keywords: years, numbers, words."""
    parts = [F.regexp_extract_all(question, F.lit(p), F.lit(0)) for p in (r"\b(?:19|20)\d{2}\b", r"\b\d+(?:\.\d+)?%?\b", r"[A-Za-z][A-Za-z0-9_-]+|[\x{4e00}-\x{9fff}]+")]
    return F.array_distinct(F.transform(F.concat(*parts), lambda w: F.lower(w)))


def evidence_types(question: Column) -> Column:
    """Kinds of evidence to look in; terms count inside words too."""
    low = F.lower(question)
    pair = lambda a: F.array(F.lit(a), F.lit("text"))
    return F.when(T.any_in(low, VISUAL_TERMS), pair("image")).when(T.any_in(low, TABLE_TERMS), pair("table")).otherwise(F.array(F.lit("text")))


def answer_hint(question: Column) -> Column:
    low = F.lower(question)
    return (
        F.when(T.any_in(low, ("date", "when", "year", "month", "day")), "date")
        .when(T.any_in(low, ("heading", "title", "subject")), "heading")
        .when(T.any_in(low, ("source", "cited", "bottom", "footer")), "source")
        .when(T.any_in(low, ("how many", "amount", "total", "number")), "numeric")
        .when(T.any_in(low, ("name", "company", "organization", "what is")), "text")
        .otherwise("unknown")
    )


def markdown(rows: DataFrame, by: str, row_order: str, cells: list[Column], header: list[str]) -> DataFrame:
    """by and a markdown table of its rows."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = F.transform(F.array_sort(F.collect_list(F.struct(F.col(row_order).alias("k"), line.alias("line")))), lambda r: r["line"])
    head = [f"| {' | '.join(header)} |", f"| {' | '.join('---' for _ in header)} |"]
    return rows.groupBy(by).agg(F.array_join(F.concat(F.array(*map(F.lit, head)), body), "\n").alias("table_text"))


def parse_markdown(tables: DataFrame, by: str, text: str) -> DataFrame:
    """by, row_idx, col_idx, cell of the body of markdown tables."""
    lines = tables.select(by, F.posexplode(F.split(text, "\n")).alias("row_idx", "line")).where("row_idx >= 2")
    cells = lines.select(by, (F.col("row_idx") - 2).alias("row_idx"), F.posexplode(F.split(F.regexp_replace("line", r"^\| | \|$", ""), r" \| ")).alias("col_idx", "cell"))
    return cells


def calculate(values: DataFrame, by: str, first: Column, last: Column, value: str) -> DataFrame:
    """Average, sum, difference, change in percent and share of the total over each group's values."""
    f, g = F.max(F.when(first, F.col(value))), F.max(F.when(last, F.col(value)))
    total = F.sum(value)
    return values.groupBy(by).agg(F.round(F.avg(value), 4).alias("average"), total.alias("sum"), (g - f).alias("difference"), F.round(F.try_divide((g - f) * 100.0, F.abs(f)), 4).alias("percent_change"), F.round(f * 100.0 / total, 4).alias("percent_of_total"))
