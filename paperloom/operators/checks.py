"""Checks of texts, answers and locations: readings of numbers, years and pages, validity tests, coverage and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Words that don't count in short texts, words that aren't headings alone, path marks of benchmark roles, and polite openings.
SHORT_STOPWORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "with")
NO_HEADINGS = ("page", "table", "figure")
BENCHMARK_ROLES = (("smoke_eval", "smoke_fixture"), ("globocan_africa_2022", "globocan_scenario_acceptance"), ("scenario_qa", "globocan_scenario_acceptance"), ("retrieved", "pre_retrieved_reader_data"), ("mp_docvqa", "retrieval_benchmark"))
POLITE = (
    r"^\s*(please\s+)?(can|could|would)\s+you\s+(please\s+)?",
    r"^\s*(please\s+)?help\s+me\s+",
    r"^\s*tell\s+me\s+",
    r"\b(in|from)\s+(this\s+)?(document|pdf|file)\b",
    r"\bthis\s+(document|pdf|file)\b",
)
LEGACY_FIELDS = ("answer", "evidence_location", "evidence", "reason")


def diagnostic_text(text: Column) -> Column:
    """Lower case without $ and commas; only a-z, digits and . % ( ) / - stay."""
    return T.collapse(F.regexp_replace(F.translate(F.lower(text), "$,", ""), r"[^a-z0-9.%()/-]+", " "))


def coverage_text(text: Column) -> Column:
    """Lower case; only a-z, digits, . and % stay."""
    return T.collapse(F.regexp_replace(F.lower(text), r"[^a-z0-9.%]+", " "))


def cell_number(cell: Column) -> Column:
    """The number that a whole table cell is: $ , % and parentheses dropped, an opening parenthesis before a figure negates; else null."""
    plain = F.regexp_replace(F.translate(cell, "$,%()", ""), r"\s+", "")
    figure = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))
    return F.when(cell.rlike(r"\(\s*\$?\s*-?\d") & cell.contains(")"), -F.abs(figure)).otherwise(figure)


def diagnostic_number(text: Column) -> Column:
    """The first number of a text; parentheses around it negate."""
    raw = F.regexp_extract(text, r"\(?-?\$?\d[\d,]*(?:\.\d+)?%?\)?", 0)
    figure = F.translate(raw, "$,%()", "").try_cast("double")
    return F.when(raw.startswith("(") & raw.endswith(")"), -figure).otherwise(figure)


def holds_answer(text: Column, answer: Column) -> Column:
    """Containment of collapsed lower-case texts; an empty answer is never held."""
    target = F.lower(T.collapse(answer))
    return F.coalesce((target != "") & F.contains(F.lower(T.collapse(text)), target), F.lit(False))


def years(text: Column) -> Column:
    """Years of the last two centuries, then FY nn (below 50: this century), as text, each once."""
    whole = F.regexp_extract_all(text, F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0))
    short = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bFY\s*([0-9]{2})\b"), F.lit(1)), lambda y: F.concat(F.when(y.cast("int") < 50, "20").otherwise("19"), y))
    return F.array_distinct(F.concat(whole, short))


def calculation_years(text: Column) -> Column:
    """`in A from B` gives B, A; `from A to B` gives A, B; else all years()."""
    year, later = r"((?:19|20)\d{2})", lambda p, g: F.regexp_extract(text, p, g)
    back, forth = rf"(?i)\bin\s+{year}\s+from\s+{year}\b", rf"(?i)\bfrom\s+{year}\s+to\s+{year}\b"
    return F.when(text.rlike(back), F.array(later(back, 2), later(back, 1))).when(text.rlike(forth), F.array(later(forth, 1), later(forth, 2))).otherwise(years(text))


def page_refs(text: Column) -> Column:
    """Pages that a question names (page n, p. n, then the Chinese form), positive, each once; null without any."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:page|p\.)\s*(\d+)\b"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"第\s*(\d+)\s*页"), F.lit(1)))
    pages = F.array_distinct(F.filter(F.transform(found, lambda p: p.try_cast("int")), lambda p: p > 0))
    return F.when(F.size(pages) > 0, pages)


def light_rewrite(question: Column) -> Column:
    """A question without polite openings and mentions of this document; as it was if nothing is left."""
    bare = reduce(lambda q, p: F.regexp_replace(q, f"(?i){p}", " "), POLITE, F.trim(question))
    bare = F.btrim(T.collapse(bare), F.lit(" ?."))
    return F.when(bare != "", bare).otherwise(F.trim(question))


def visual_status(summary: Column, nearby: Column, caption: Column, resource: Column) -> Column:
    """Where an image's text comes from: each argument says whether there is one."""
    return F.when(summary, "vlm_summarized").when(nearby, "ocr_or_nearby_text").when(caption, "caption_only").when(resource, "resource_only").otherwise("empty")


def short_form(plain: Column, most_words: int) -> Column:
    """Whether a normalised text has one to `most_words` words, not all of them stopwords."""
    stop = "|".join(SHORT_STOPWORDS)
    return plain.rlike(rf"^(?!(?:(?:{stop})(?: |$))+$)[^ ]++(?: [^ ]++){{0,{most_words - 1}}}$")


def valid_short_text(text: Column, most_words: int = 12, most_chars: int = 90) -> Column:
    """Short enough, and with a word that isn't a stopword."""
    return F.coalesce((F.trim(text) != "") & (F.length(F.trim(text)) <= most_chars) & short_form(T.normalize(text), most_words), F.lit(False))


def valid_heading(text: Column) -> Column:
    """A short text that is neither a number nor one of the words that number things."""
    plain = T.normalize(text)
    number = F.trim(text).rlike(r"^-?\(?\$?\d[\d,]*(?:\.\d+)?%?\)?$")
    return valid_short_text(text, 14, 110) & ~number & ~plain.isin(*NO_HEADINGS) & ((F.size(T.words(text)) >= 2) | text.rlike(r"\p{L}"))


def format_score(there: dict[str, Column], location_is_object: Column) -> Column:
    """1 if all legacy fields are there and the location is an object, .5 if any field is there, else 0."""
    every, some = (reduce(op, there.values()) for op in (lambda a, b: a & b, lambda a, b: a | b))
    return F.when(every & location_is_object, 1.0).when(some, 0.5).otherwise(0.0)


def location_check(page: Column, block: Column, pages: Column, blocks: Column) -> Column:
    """Whether the page or the block was retrieved."""
    return F.coalesce(F.array_contains(pages, page), F.lit(False)) | F.coalesce(F.array_contains(blocks, block) & (block != ""), F.lit(False))


def best_over_golds(rows: DataFrame, key: str, prediction: str, gold: str) -> DataFrame:
    """For each key over its gold answers (a row each): exact match and hit by any, largest token F1."""
    p, g = F.col(prediction), F.col(gold)
    hit = (T.normalize(g) != "") & F.contains(T.normalize(p), T.normalize(g))
    return rows.groupBy(key).agg(F.bool_or(T.exact_match(p, g)).alias("em"), F.round(F.max(T.token_f1(p, g)), 6).alias("f1"), F.bool_or(hit).alias("hit"))


def length_percentile(rows: DataFrame, by: str, value: str, ratios: tuple[float, ...]) -> DataFrame:
    """The value at place int((n - 1) * ratio) of a group's values in order, for each ratio.

    Equal values are counted first, so a group is as large as its distinct values.
    """
    counts = rows.groupBy(by, value).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(by).orderBy(value))
    total = F.sum("__n").over(Window.partitionBy(by))
    placed = counts.select(by, value, upto.alias("__upto"), total.alias("__total"))
    return placed.groupBy(by).agg(*[F.min(F.when(F.col("__upto") > F.floor((F.col("__total") - 1) * r), F.col(value))).alias(f"p{round(r * 100)}") for r in ratios])


def first_last_mean(rows: DataFrame, by: str, step: str, value: str) -> DataFrame:
    """First and last value by step, mean, and steps whose value isn't zero."""
    return rows.groupBy(by).agg(F.min_by(value, step).alias("first"), F.max_by(value, step).alias("last"), F.round(F.avg(value), 6).alias("mean"), F.count_if(F.col(value) != 0).alias("nonzero"))


def page_coverage(observed: DataFrame, total: DataFrame, doc: str, page: str, pages: str) -> DataFrame:
    """Distinct observed pages over a document's pages, at most 1; documents without any observed page have 0."""
    seen = observed.groupBy(doc).agg(F.countDistinct(page).alias("__seen"))
    return total.join(seen, doc, "left").select(doc, F.round(F.least(F.coalesce("__seen", F.lit(0)) / F.col(pages), F.lit(1.0)), 6).alias("coverage"))


def cap_per_group(rows: DataFrame, group: str, order: list[Column], most: int, limit: int) -> DataFrame:
    """At most so many rows of each group, and so many in all, by the order."""
    placed = rows.withColumn("__at", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__at") <= most)
    return placed.orderBy(*order).limit(limit).drop("__at")


def record_key(id_: Column, content: Column) -> Column:
    """The id, or a hash of the content where there is none."""
    return F.when(F.coalesce(id_, F.lit("")) != "", id_).otherwise(F.sha2(content, 256))


def benchmark_role(path: Column) -> Column:
    plain = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    (mark, role), *rest = BENCHMARK_ROLES
    return reduce(lambda found, r: found.when(plain.contains(r[0]), r[1]), rest, F.when(plain.contains(mark), role)).otherwise("candidate_benchmark")


def alignment(rows: DataFrame, key: str) -> DataFrame:
    """bucket and min_distance of rows (key, gold, pages, hits, readable): arrays of gold pages, all pages, pages with the answer, readable gold pages."""
    shifted = lambda d: F.array_intersect(F.transform("gold", lambda p: p + d), F.col("pages"))
    meets = lambda pages: F.arrays_overlap("hits", pages)
    bucket = (
        F.when(meets(F.col("gold")), "answer_on_gold_page")
        .when(meets(shifted(-1)), "answer_on_gold_minus_one_page")
        .when(meets(shifted(1)), "answer_on_gold_plus_one_page")
        .when(F.size("hits") > 0, "answer_elsewhere_in_document")
        .when(F.size("readable") == 0, "gold_page_without_retrievable_blocks")
        .otherwise("answer_not_found_in_document_text")
    )
    distance = F.array_min(F.flatten(F.transform("hits", lambda h: F.transform("gold", lambda g: F.abs(h - g)))))
    return rows.select(key, bucket.alias("bucket"), distance.alias("min_distance"))


def merge_allowlist(retrieved: Column, preferred: Column) -> Column:
    """Retrieved ids, then preferred ones that are new."""
    return F.array_distinct(F.concat(retrieved, preferred))


def children(parents: DataFrame, ids: str, blocks: DataFrame, block: str, text: str) -> DataFrame:
    """The parents' child texts in the order of their ids, as child_texts; ids that no block has are left out."""
    keys = [c for c in parents.columns if c != ids]
    each = parents.select(*keys, F.posexplode(ids).alias("__at", block)).join(blocks.select(block, text), block)
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", text))), lambda x: x[text]).alias("child_texts"))
