"""Manifests of documents: page identities, questions' pages, window conflicts, counts, recognised lines, states, training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scoring as S

# The states of a document and which may follow which, and the roles that end a training record.
STATES = ("registered", "parsing", "parsed", "parse_failed", "indexing", "ready", "index_failed")
FOLLOWS = (
    ("registered", ("parsing",)),
    ("parsing", ("parsed", "parse_failed")),
    ("parse_failed", ("parsing",)),
    ("parsed", ("indexing", "parsing")),
    ("indexing", ("ready", "index_failed")),
    ("index_failed", ("indexing", "parsing")),
    ("ready", ("indexing", "parsing")),
)
LAST_ROLES = ("system", "user", "assistant")


def page_identities(windows: DataFrame, pages: DataFrame) -> DataFrame:
    """Each page of a window (doc_id, page_ids) with its aggregate of pages (doc_id, page, block_id, child_ids): doc_id, ordinal (from 1), page_id, block_id, child_ids, errors."""
    listed = windows.select("doc_id", F.posexplode("page_ids").alias("pos", "page_id")).select("doc_id", (F.col("pos") + 1).alias("ordinal"), "page_id")
    both = listed.join(pages.withColumnRenamed("page", "ordinal"), ["doc_id", "ordinal"], "left")
    missing = F.when(F.col("block_id").isNull(), "missing_page_aggregate").when(F.coalesce(F.size("child_ids"), F.lit(0)) <= 0, "page_aggregate_has_no_child_blocks")
    return both.withColumn("errors", F.array_compact(F.array(missing)))


def question_pages(questions: DataFrame, windows: DataFrame, identities: DataFrame) -> DataFrame:
    """questions (qid, doc_id, answer_page_idx, gold_ordinal, gold_page_id) with their page's aggregate and what doesn't agree."""
    known = questions.join(windows, "doc_id", "left")
    page = identities.select("doc_id", F.col("ordinal").alias("gold_ordinal"), "block_id", "child_ids", F.col("errors").alias("page_errors"))
    both = known.join(page, ["doc_id", "gold_ordinal"], "left")
    errors = F.array(
        F.when(F.col("gold_ordinal") != F.col("answer_page_idx") + 1, "answer_page_idx_gold_page_ordinal_mismatch"),
        F.when(~F.coalesce(F.col("gold_page_id") == F.get("page_ids", F.col("answer_page_idx")), F.lit(False)), "gold_page_id_mismatch"),
        F.when(F.col("page_errors").isNull(), "missing_page_identity"),
    )
    return both.withColumn("errors", F.array_compact(F.concat(errors, F.coalesce("page_errors", F.array().cast("array<string>"))))).drop("page_errors")


def window_conflicts(rows: DataFrame, window: str, hashes: str) -> DataFrame:
    """Of each window: rows, variants (different lists of page hashes), duplicates, conflicting, repeated (a page's content stands twice)."""
    variants = rows.groupBy(window, hashes).agg(F.count("*").alias("n"))
    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    merged = variants.groupBy(window).agg(F.sum("n").alias("rows"), F.count("*").alias("variants"), F.max(repeated).alias("repeated"))
    return merged.withColumns({"duplicates": F.col("rows") - F.col("variants"), "conflicting": F.col("variants") > 1})


def document_counts(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Of each of docs (doc_id, page_count): pages and where their number is from, blocks, tables, images, and whether it has any.

    blocks: doc_id, page, block_type. Pages are the registered count, else those of page blocks, else those of all blocks.
    """
    kind, page = F.col("block_type"), F.col("page")
    counted = blocks.groupBy("doc_id").agg(
        F.countDistinct(F.when(kind == "page", page)).alias("page_blocks"), F.countDistinct(page).alias("seen"), F.count_if(kind != "page").alias("blocks"),
        F.count_if(kind == "table").alias("tables"), F.count_if(kind.isin("image", "figure")).alias("images"),
    )
    both = docs.select("doc_id", "page_count").join(counted, "doc_id", "left").fillna(0, ["page_blocks", "seen", "blocks", "tables", "images"])
    pages = F.when(F.col("page_count").isNotNull(), F.col("page_count").cast("long")).when(F.col("page_blocks") > 0, F.col("page_blocks")).otherwise(F.col("seen"))
    source = F.when(F.col("page_count").isNotNull(), "documents.page_count").when(F.col("page_blocks") > 0, "evidence_blocks.page_blocks").otherwise("evidence_blocks.page_ids")
    return both.select("doc_id", pages.alias("pages"), source.alias("source"), "blocks", "tables", "images", (F.col("tables") > 0).alias("has_tables"), (F.col("images") > 0).alias("has_images"))


def recognised_text(lines: DataFrame, *by: str) -> DataFrame:
    """by, text (recognised lines in order, empty ones left out) and the mean of the scores that are there; lines: by, ord, text, score."""
    told = F.when(F.length("text") > 0, F.struct("ord", "text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["text"]), "\n")
    return lines.groupBy(*by).agg(F.trim(joined).alias("text"), F.round(F.avg(F.when(F.length("text") > 0, F.col("score"))), 6).alias("score"))


def state_log(log: DataFrame, doc: str, order: str, state: str) -> DataFrame:
    """Of each document its last state, how often it changed, and how many changes FOLLOWS doesn't allow."""
    own = Window.partitionBy(doc).orderBy(order)
    before = F.lag(state).over(own)
    known = F.lit(False)
    for first, then in FOLLOWS:
        known = known | ((F.col("before") == first) & F.col(state).isin(*then))
    changes = log.withColumn("before", before).withColumn("wrong", F.col("before").isNotNull() & ~known)
    return changes.groupBy(doc).agg(F.max_by(state, order).alias("state"), F.count("before").alias("changes"), F.count_if("wrong").alias("illegal"))


def record_error(roles: Column, target: Column, allowed: Column) -> Column:
    """Why a record can't be learnt from, null if it can; roles: of its messages; target: the last message as read (null: can't be read)."""
    fault = S.schema_error(target, allowed)
    return (
        F.when(F.coalesce(F.size(roles), F.lit(0)) < 3, "missing_messages")
        .when(F.slice(roles, -3, 3) != F.array(*map(F.lit, LAST_ROLES)), "messages_must_end_system_user_assistant")
        .when(target.isNull(), "invalid_assistant_json")
        .when(fault.isNotNull(), F.concat(F.lit("invalid_v3_target:"), fault))
    )
