"""Planned queries, record audits, candidate filters, recovery triggers, review queues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import documents as D
from . import scoring as S

# Patterns and templates of planned queries, kinds of candidates, labels of audits and reviews.
PAGE = r"(?i)\b(?:page|p\.)\s*(\d+)\b"
PLANNED = (
    ("table_lookup_or_calculation", r"(?i)\b(table|row|column|revenue|sales|income|profit|expense|cost|value|amount|rate|ratio|average|sum|difference|growth)\b", ("table ",)),
    ("visual_pixel_qa", r"(?i)\b(image|figure|chart|graph|picture|visual)\b", ("image figure ",)),
    ("document_statistics", r"(?i)\b(how many|number of|count|pages?|tables?|images?|figures?|blocks?|statistics|metadata)\b", ("metadata ", "document statistics ")),
    ("document_summary", None, ("summary overview ",)),
)
NUMERIC_KINDS = ("numeric", "percentage", "index")
NUMERIC_TARGETS = ("numeric", "index", "percentage", "date", "quarter")
VISUAL_HINTS = ("visual", "image", "figure", "chart", "visual_pixel_qa")
VISUAL_MARKERS = ("image", "figure", "chart", "graph", "visual", "picture", "图片", "图像", "图表", "视觉")
NEXT_TO_GOLD = ("answer_on_gold_minus_one_page", "answer_on_gold_plus_one_page")
REVIEWS = (
    (NEXT_TO_GOLD, "manual_compare_gold_and_adjacent_page_images"),
    (("answer_elsewhere_in_document",), "manual_check_gold_annotation_or_duplicate_answer"),
    (("answer_not_found_in_document_text",), "manual_check_ocr_text_or_answer_alias"),
    (("gold_page_without_retrievable_blocks",), "manual_check_mineru_page_block_materialization"),
)


def planned_queries(question: Column, task: Column) -> Column:
    """Retrieval queries of a question: page, table, image, statistics and summary templates with its first ten keywords, those, and itself."""
    plain = T.collapse(question)
    asked = F.array_join(F.slice(D.keywords(plain), 1, 10), " ")
    page = F.regexp_extract(plain, PAGE, 1)
    items = [F.when((page != "") | (task == "page_lookup"), F.concat(F.lit("page "), page)), F.when(page != "", F.concat(F.lit("text page "), page))]
    for name, pattern, starts in PLANNED:
        wanted = (task == name) | plain.rlike(pattern) if pattern else task == name
        items += [F.when(wanted, F.concat(F.lit(start), asked)) for start in starts]
    return T.unique_ignoring_case(F.array_compact(F.array(*items, asked, plain)))


def fuse_queries(rules: Column, others: Column, limit: int = 8) -> Column:
    """The rules' queries, then others; each once whatever its case, blank ones left out, at most `limit`."""
    return F.slice(T.unique_ignoring_case(F.concat(rules, others)), 1, limit)


def asks_several(question: Column) -> Column:
    """Whether more than one route but the visual one fits, or the wording joins two requests."""
    plain = F.lower(T.collapse(F.regexp_replace(question, "[?!.]+$", "")))
    fits = reduce(lambda a, b: a + b, [plain.rlike(p).cast("int") for name, p in D.ROUTES if name != "visual_question"])
    return (fits > 1) | plain.rlike(r"\b(and then|then also|also)\b")


def profile_warnings(question: Column, tables: Column, images: Column) -> Column:
    """What a question needs and its document, by its counts of tables and images, hasn't; unknown counts warn of nothing."""
    plain = F.lower(T.collapse(F.regexp_replace(question, "[?!.]+$", "")))
    routes = dict(D.ROUTES)
    needs = lambda route, word: plain.rlike(routes[route]) | (plain.rlike(routes["structured_extraction"]) & plain.rlike(word))
    table = F.when(needs("table_or_calculation", r"\btables?\b") & (tables == 0), "document_profile_no_tables")
    image = F.when(needs("visual_question", r"\b(images?|figures?)\b") & (images == 0), "document_profile_no_images")
    return F.array_compact(F.array(table, image))


def record_issues(prompt: Column, target: Column, answered: Column, answer_type: Column, most: int = 300) -> Column:
    """What is wrong with a training record, as an array.

    target: answer, evidence and location (a struct of ids, null: none); answered: the target is an assistant's own. A target
    that can't be read is the gold one, whose evidence isn't judged.
    """
    location, evidence = target["location"], F.coalesce(target["evidence"], F.lit(""))
    ids = F.array_compact(F.array(*[location[k].cast("string") for k in ("block_id", "table_id", "image_id", "page_id")]))
    said = F.coalesce(prompt, F.lit(""))
    answer = T.normalize(F.coalesce(target["answer"], F.lit("")))
    held = (answer != "") & F.contains(T.normalize(evidence), answer)
    return F.array_compact(
        F.array(
            F.when(location.isNull(), "location_not_object").when((F.size(ids) > 0) & ~F.exists(ids, lambda i: F.contains(said, i)), "location_not_in_prompt"),
            F.when(answered & (F.length(evidence) > most), "evidence_too_long"),
            F.when(answered & (F.length(evidence) >= most) & F.substring(evidence, -1, 1).rlike(r"[\p{L}\p{N}]"), "evidence_may_be_midword_truncated"),
            F.when(answered & (answer_type == "extractive") & (evidence != "") & ~held, "extractive_answer_not_in_target_evidence"),
            F.when(said == "", "missing_user_prompt"),
        )
    )


def failure_labels(em: Column, f1: Column, answer: Column, answer_type: Column, readable: Column, formed: Column, located: Column) -> Column:
    """What went wrong with an answer: labels in alphabetical order."""
    wrong = F.when(answer_type == "numeric", "wrong_number").when(F.length(answer) > 0, "wrong_entity")
    parts = [F.when(~readable, "invalid_json"), F.when(~formed, "format_error"), F.when(~located, "location_error"), F.when(~em, F.when(f1 > 0, "partial_answer").otherwise("answer_miss")), F.when(~em, wrong)]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*parts))))


def bucket_transitions(rows: DataFrame, by: str, bucket: str) -> DataFrame:
    """How far better extraction (bucket D) would widen the pool of covered answers (E and F), with the gaps of C and E."""
    n = lambda *names: F.count_if(F.col(bucket).isin(*names))
    return rows.groupBy(by).agg(n("D").alias("fixed_by_extraction"), n("E", "F").alias("covered"), n("D", "E", "F").alias("covered_after"), n("C").alias("span_gap"), n("E").alias("reader_gap"))


def filter_reasons(kind: Column, rule: Column, score: Column, parts: Column, target: Column) -> Column:
    """Why a candidate should be dropped or ranked lower. parts: local_context_match, long_text_penalty, noisy_text_penalty, generic_numeric_penalty (null: 0)."""
    part = lambda name: F.coalesce(parts[name], F.lit(0.0))
    numeric = kind.isin(*NUMERIC_KINDS)
    other = numeric & ~target.isin(*NUMERIC_TARGETS, "unknown")
    weak = (score < 0.55) | (part("local_context_match") <= 0)
    return F.array_compact(
        F.array(
            F.when(other & weak, "drop:generic_numeric_type_mismatch").when(other, "downrank:numeric_type_mismatch"),
            F.when((target == "percentage") & numeric & (kind != "percentage"), "drop:non_percentage_numeric"),
            F.when((target == "index") & numeric & (rule != "parenthesized_index"), "downrank:non_parenthesized_index_numeric"),
            F.when(part("long_text_penalty") < -0.15, "downrank:long_text"),
            F.when(part("noisy_text_penalty") < -0.15, "drop:noisy_fragment"),
            F.when(numeric & (part("generic_numeric_penalty") < -0.4), "drop:weak_numeric_context"),
        )
    )


def filter_penalty(reasons: Column) -> Column:
    """.45 for each reason to drop, .18 for each other one, at most 1."""
    total = F.aggregate(reasons, F.lit(0.0), lambda acc, r: acc + F.when(r.startswith("drop:"), 0.45).otherwise(0.18))
    return F.least(total, F.lit(1.0))


def type_aware_top(board: Column, target: Column, k: int) -> Column:
    """At most k candidates of a board, best first: an array of structs with score, rank, kind, key, eligible, reasons.

    Numeric kinds fill all places where a number is asked for, six where the target is unknown, else three; each key comes
    once. Eligible candidates first, then others but noisy ones. Ties go by rank. A board is one question's candidates.
    """
    quota = F.when(target.isin(*NUMERIC_TARGETS), k).when(target == "unknown", min(6, k)).otherwise(min(3, k))
    ordered = F.transform(F.array_sort(F.transform(board, lambda c: F.struct((-c["score"]).alias("s"), c["rank"].alias("r"), c.alias("c")))), lambda x: x["c"])

    def chosen(start: Column, test) -> Column:
        def step(acc: Column, c: Column) -> Column:
            numeric = c["kind"].isin(*NUMERIC_KINDS)
            fits = (F.size(acc["kept"]) < k) & test(c) & ~(numeric & (acc["n"] >= quota)) & ~F.exists(acc["kept"], lambda x: x["key"] == c["key"])
            return F.struct(F.when(fits, F.concat(acc["kept"], F.array(c))).otherwise(acc["kept"]).alias("kept"), (acc["n"] + (fits & numeric).cast("int")).alias("n"))

        return F.aggregate(ordered, start, step)

    first = chosen(F.struct(F.slice(ordered, 1, 0).alias("kept"), F.lit(0).alias("n")), lambda c: c["eligible"])
    return chosen(first, lambda c: ~F.exists(c["reasons"], lambda r: r.startswith("drop:noisy")))["kept"]


def recovery_trigger(status: Column, answer: Column, cited: Column, question: Column, hint: Column, visuals: Column, reviewing: Column) -> Column:
    """Why an answer should be sought again, null if it needn't; the first that applies."""
    visual = F.coalesce(F.lower(hint).isin(*VISUAL_HINTS), F.lit(False)) | T.any_in(F.lower(question), VISUAL_MARKERS)
    plain = F.trim(F.coalesce(answer, F.lit("")))
    return (
        F.when(F.trim(status) == "insufficient", "support_status_insufficient")
        .when(plain == "", "answer_empty")
        .when(S.says_insufficient(plain), "answer_insufficient_text")
        .when((F.trim(status) == "supported") & ~cited, "supported_without_valid_citation")
        .when(reviewing & visual & (visuals <= 0), "visual_evidence_missing")
    )


def rendered_sources(answer: Column, citations: Column) -> Column:
    """An answer with its sources below, one line each; citations: page, block_type, preview. Those without a preview stay out."""
    told = F.filter(citations, lambda c: F.trim(c["preview"]) != "")
    kind = lambda c: F.coalesce(F.nullif(c["block_type"], F.lit("")), F.lit("evidence"))
    lines = F.transform(told, lambda c: F.concat(F.lit("- "), F.when(c["page"].isNotNull(), F.concat(F.lit("Page "), c["page"].cast("string"), F.lit(", "))).otherwise(""), kind(c), F.lit(": "), F.trim(c["preview"])))
    plain = F.trim(F.coalesce(answer, F.lit("")))
    return F.when(F.coalesce(F.size(lines), F.lit(0)) <= 0, plain).otherwise(F.concat(plain, F.lit("\n\nSources:\n"), F.array_join(lines, "\n")))


def review_bucket(bucket: Column) -> Column:
    """What a person should look at, by where the answer was found."""
    named = reduce(lambda found, x: found.when(bucket.isin(*x[0]), x[1]), REVIEWS[1:], F.when(bucket.isin(*REVIEWS[0][0]), REVIEWS[0][1]))
    return named.otherwise("manual_review_unclassified")


def actionability(bucket: Column, retrieved: Column, selected: Column, cited: Column) -> Column:
    """Which part of the work the review is about."""
    found = bucket.isin(*NEXT_TO_GOLD, "answer_elsewhere_in_document")
    return (
        F.when(found & retrieved & selected & cited, "gold_page_alignment_review_not_retrieval_defect")
        .when(found & retrieved, "context_or_citation_selection_review")
        .when(found, "retrieval_or_duplicate_answer_review")
        .when(bucket == "answer_not_found_in_document_text", "ocr_or_answer_alias_review")
        .when(bucket == "gold_page_without_retrievable_blocks", "evidence_block_materialization_review")
        .otherwise("manual_review_unclassified")
    )


def adjacent_pages(page: Column, pages: Column) -> Column:
    """The pages before and after, if the document has them; pages: its number of pages, null if unknown."""
    return F.filter(F.array(page - 1, page + 1), lambda p: (p >= 1) & F.coalesce(p <= pages, F.lit(True)))


def boosted_top(hits: DataFrame, k: int, key: str = "block_id") -> DataFrame:
    """The k best of each question after boosts: a tenth of its best score for a wanted type, .45 of it for tables where a number is asked.

    hits: qid, key, score, rank, block_type, types (wanted), hint. Ties keep their rank. Pools are cut to a few of each question before.
    """
    best = F.max("score").over(Window.partitionBy("qid"))
    boost = F.when(F.array_contains("types", F.col("block_type")), 0.10).otherwise(0.0) + F.when((F.col("hint") == "numeric") & (F.col("block_type") == "table"), 0.45).otherwise(0.0)
    scored = hits.withColumn("boosted", F.round(F.col("score") + boost * best, 6))
    order = Window.partitionBy("qid").orderBy(F.desc("boosted"), "rank")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def select_spans(board: Column, per_page: int = 3, most: int = 12, blocks: int = 32, budget: int | None = None) -> Column:
    """Evidence spans of a question, best first: an array of structs page, primary, block_ids.

    board: one question's blocks as structs score, rank (of the page), ord, block_id, page, window (the blocks around it and itself
    in reading order, as structs block_id and chars). A span is a block with what of its window no earlier span holds. At most
    `per_page` spans a page, `most` in all, `blocks` blocks; blocks scored 0 or less only as the first span. With a budget, spans
    whose text (lines joined) would pass that many estimated tokens are left out, but for the first. Ties go by rank, ord, block_id.
    """
    keyed = F.transform(board, lambda b: F.struct((-b["score"]).alias("s"), b["rank"].alias("r"), b["ord"].alias("o"), b["block_id"].alias("i"), b.alias("b")))
    ordered = F.transform(F.array_sort(keyed), lambda x: x["b"])

    def step(acc: Column, b: Column) -> Column:
        spans, used = acc["spans"], acc["used"]
        new = F.filter(b["window"], lambda w: (w["block_id"] == b["block_id"]) | ~F.array_contains(used, w["block_id"]))
        new = F.slice(new, F.lit(1), F.greatest(F.lit(blocks) - F.size(used), F.lit(0)))
        chars = F.aggregate(new, F.lit(0), lambda n, w: n + w["chars"].cast("int")) + F.size(new) - 1
        tokens = F.floor((chars + 3) / 4).cast("int")
        fits = (F.size(spans) < most) & (F.size(used) < blocks) & (F.size(new) > 0) & ~F.exists(spans, lambda x: x["primary"] == b["block_id"])
        fits &= (F.size(F.filter(spans, lambda x: x["page"] == b["page"])) < per_page) & ((b["score"] > 0) | (F.size(spans) == 0))
        if budget:
            fits &= (acc["tokens"] + tokens <= budget) | (F.size(spans) == 0)
        ids = F.transform(new, lambda w: w["block_id"])
        span = F.array(F.struct(b["page"].alias("page"), b["block_id"].alias("primary"), ids.alias("block_ids")))
        return F.struct(
            F.when(fits, F.concat(spans, span)).otherwise(spans).alias("spans"),
            F.when(fits, F.array_union(used, ids)).otherwise(used).alias("used"),
            (acc["tokens"] + F.when(fits, tokens).otherwise(0)).alias("tokens"),
        )

    ids = lambda x: F.transform(x["window"], lambda w: w["block_id"])
    none = F.transform(F.slice(board, 1, 0), lambda x: F.struct(x["page"].alias("page"), x["block_id"].alias("primary"), ids(x).alias("block_ids")))
    start = F.struct(none.alias("spans"), F.flatten(F.transform(none, lambda x: x["block_ids"])).alias("used"), F.lit(0).alias("tokens"))
    return F.aggregate(ordered, start, step)["spans"]


def windows_around(blocks: DataFrame, around: int = 1) -> DataFrame:
    """blocks (page, ord, block_id, text) with a window: those up to `around` places away on the page, in order, as block_id and chars."""
    near = Window.partitionBy("page").orderBy("ord", "block_id").rowsBetween(-around, around)
    return blocks.withColumn("window", F.collect_list(F.struct("block_id", F.length("text").alias("chars"))).over(near))
