"""Candidate answers' contract, citations, locations and captions, and summaries of evaluated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Messages of the candidate contract, what opens a caption, and kinds of blocks that carry one.
MISSING, NO_STRING, NO_SUMMARY, TOO_LONG = "missing fields: ", "answer must be a string", "reasoning_summary must be a string", "reasoning_summary exceeds 300 characters"
CAPTION = r"(?i)^\s*(fig(?:ure)?\.?|table|chart|图|表)\s*[\w\d一二三四五六七八九十\-\.]*\s*[:：.\-]?"
CAPTIONED = ("image", "figure", "table")
#: Characters of a citation's text, and of a summary of reasons.
PREVIEW, MOST_REASON = 220, 300


def candidate_fault(output: Column) -> Column:
    """What breaks the candidate contract in a JSON object given as text; null if nothing does.

    Fields are read as JSON, so that a string is told from a number by its quotes.
    """
    there = lambda name: F.get_json_object(output, f"$.{name}").isNotNull()
    cited = there("citation_block_ids") | there("citations") | there("evidence_used")
    missing = F.concat(F.when(~there("answer"), F.array(F.lit("answer"))).otherwise(F.array().cast("array<string>")), F.when(~there("reasoning_summary"), F.array(F.lit("reasoning_summary"))).otherwise(F.array().cast("array<string>")))
    missing = F.concat(missing, F.when(~cited, F.array(F.lit("citation_block_ids"))).otherwise(F.array().cast("array<string>")))
    raw = F.from_json(output, "map<string,string>")
    text_ = lambda name: output.rlike(rf'"{name}"\s*:\s*"')
    return (
        F.when(raw.isNull(), "parsed output is not an object")
        .when(F.size(missing) > 0, F.concat(F.lit(MISSING), F.array_join(missing, ", ")))
        .when(~text_("answer"), NO_STRING)
        .when(~text_("reasoning_summary"), NO_SUMMARY)
        .when(F.length(F.get_json_object(output, "$.reasoning_summary")) > MOST_REASON, TOO_LONG)
    )


def primary_location(location: Column, cited: Column, used: Column, ids: Column) -> Column:
    """The evidence location (page, block_id), else the first cited or used item's that has one, else the first id that isn't blank."""
    filled = lambda items: F.filter(items, lambda x: x["page"].isNotNull() | (F.coalesce(x["block_id"], F.lit("")) != ""))
    first = lambda items: F.try_element_at(filled(items), F.lit(1))
    named = F.try_element_at(F.filter(ids, lambda i: F.trim(i) != ""), F.lit(1))
    by_id = F.when(named.isNotNull(), F.struct(F.lit(None).cast("int").alias("page"), named.alias("block_id")))
    return F.coalesce(location, first(cited), first(used), by_id)


def citation(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, page, page_id, block_id, block_type, text, caption) as citations: the page falls back to page_id, texts are previews, empty ones null."""
    text = F.nullif(F.substring(T.collapse(F.col("text")), 1, PREVIEW), F.lit(""))
    return blocks.select("doc_id", F.coalesce("page", "page_id").alias("page"), "block_id", "block_type", text.alias("text_preview"), F.nullif(F.trim("caption"), F.lit("")).alias("caption"))


def attach_captions(blocks: DataFrame, doc: str, order: str) -> DataFrame:
    """Images, figures and tables without a caption take the text block before them, or else after them, if it is on their page and opens like a caption."""
    own = Window.partitionBy(doc).orderBy(order)
    neighbour = lambda side: F.struct(*[side(c).over(own).alias(c) for c in ("page", "block_type", "text", "block_id")])
    fit = lambda n: (n["page"] == F.col("page")) & (n["block_type"] == "text") & n["text"].rlike(CAPTION)
    placed = blocks.withColumns({"__before": neighbour(F.lag), "__after": neighbour(F.lead)})
    found = F.when(fit(F.col("__before")), F.col("__before")).when(fit(F.col("__after")), F.col("__after"))
    open_ = F.col("block_type").isin(*CAPTIONED) & (F.coalesce(F.trim("caption"), F.lit("")) == "")
    given = placed.withColumn("__found", F.when(open_, found))
    return given.withColumns({"caption": F.coalesce(F.nullif("caption", F.lit("")), F.trim(F.col("__found")["text"])), "caption_block_id": F.col("__found")["block_id"]}).drop("__before", "__after", "__found")


def breakdown(rows: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """How often each metric holds and fails: by, metric, ok, n. Null counts as failed."""
    each = rows.select(F.coalesce(by, F.lit("unknown")).alias(by), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), F.lit(False)).alias("ok")) for m in metrics])).alias("x"))
    return each.select(by, "x.metric", "x.ok").groupBy(by, "metric", "ok").agg(F.count("*").alias("n"))


def merge_shards(shards: list[DataFrame], key: str, metrics: list[str]) -> DataFrame:
    """One row: samples and the mean of each metric over all shards; 0 without rows."""
    rows = shards[0]
    for shard in shards[1:]:
        rows = rows.unionByName(shard)
    return rows.agg(F.count(key).alias("num_samples"), *[F.round(F.coalesce(F.avg(F.col(m).cast("double")), F.lit(0.0)), 6).alias(m) for m in metrics])


def calibration(rows: DataFrame, variant: str, reward: str, target: str, most_negative: float, least_target: float) -> DataFrame:
    """Rewards by variant (count, mean, min, max), and on each row whether the calibration passes: the target's least is high enough, every other's most low enough."""
    stats = rows.groupBy(variant).agg(F.count("*").alias("n"), F.round(F.avg(reward), 6).alias("mean"), F.min(reward).alias("least"), F.max(reward).alias("most"))
    gate = stats.agg(F.coalesce(F.max(F.when(F.col(variant) == target, F.col("least"))), F.lit(0.0)).alias("__t"), F.coalesce(F.max(F.when(F.col(variant) != target, F.col("most"))), F.lit(0.0)).alias("__n"))
    passed = gate.select(((F.col("__t") >= least_target) & (F.col("__n") <= most_negative)).alias("passed"))
    return stats.crossJoin(F.broadcast(passed))  # one row


def distractors(candidates: DataFrame, board: str, kind: str, target: str) -> DataFrame:
    """Candidates of the target's kind on each board besides the right one; for an unknown target, of the commonest kind."""
    counts = candidates.groupBy(board, target, kind).agg(F.count("*").alias("n"))
    same = F.max(F.when((F.col(target) == "unknown") | (F.col(kind) == F.col(target)), F.col("n")))
    return counts.groupBy(board, target).agg(F.greatest(F.coalesce(same, F.lit(0)) - 1, F.lit(0)).alias("distractors"))
