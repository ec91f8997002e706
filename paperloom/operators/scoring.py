"""Metrics, rewards, validation of answers, comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# How an answer says that evidence is missing.
INSUFFICIENT = ("insufficient", "not enough evidence", "cannot determine", "can't determine", "not provided", "not available", "not found", "no evidence", "no candidate")


def answer_reward(prediction: Column, gold: Column, answer_type: Column) -> Column:
    """Numeric answers: 0 or 1; others: 1 on an exact match, else token F1."""
    other = F.when(T.exact_match(prediction, gold), 1.0).otherwise(T.token_f1(prediction, gold))
    return F.when(answer_type == "numeric", T.numeric_match(prediction, gold).cast("double")).otherwise(other)


def location_reward(predicted: Column, gold: Column) -> Column:
    """1 if page, block_id or table_id agree with a gold value that is there."""
    same = F.lit(False)
    for key in ("page", "block_id", "table_id"):
        same = same | F.coalesce(predicted[key] == gold[key], F.lit(False))
    return same.cast("double")


def grounded_reward(fmt: Column, answer: Column, location: Column | None) -> Column:
    """Format, answer and location in parts of .2, .6, .2; the answer counts at the right location alone. Without a location .25 and .75."""
    if location is None:
        return 0.25 * fmt + 0.75 * answer
    return 0.2 * fmt + 0.6 * F.when(location == 1.0, answer).otherwise(0.0) + 0.2 * location


def schema_error(output: Column, allowed: Column | None = None, most: int = 300) -> Column:
    """The first fault of an output (answer, supporting_refs, support_status, reasoning_summary); null if none."""
    refs = clean_refs(output["supporting_refs"])
    missing = F.array_compact(F.array(*[F.when(output[f].isNull(), F.lit(f)) for f in ("answer", "reasoning_summary", "support_status", "supporting_refs")]))
    found = (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", ")))
        .when(F.length(output["reasoning_summary"]) > most, f"reasoning_summary exceeds {most} characters")
        .when(~output["support_status"].isin("supported", "insufficient"), "support_status must be supported or insufficient")
        .when((output["support_status"] == "supported") & (F.size(refs) == 0), "supported output requires at least one supporting_ref")
        .when((output["support_status"] == "insufficient") & (F.size(refs) > 0), "insufficient output must not include supporting_refs")
    )
    if allowed is not None:
        invalid = F.array_except(refs, allowed)
        found = found.when(F.size(invalid) > 0, F.concat(F.lit("invalid supporting_refs: "), F.array_join(invalid, ", ")))
    return found


def clean_refs(refs: Column) -> Column:
    """Distinct references that aren't blank, in order."""
    return F.array_distinct(F.filter(F.transform(refs, lambda r: F.trim(r)), lambda r: r != ""))


def says_insufficient(answer: Column) -> Column:
    return T.any_in(F.lower(T.collapse(answer)), INSUFFICIENT)


def contract_reward(output: Column, gold: Column, positive: Column, answer_type: Column, insufficient: Column) -> Column:
    """Reward of an output: nothing on a schema fault; parts for format, answer, status and references, less .15 for a wrong reference."""
    refs = clean_refs(output["supporting_refs"])
    fault = schema_error(output)
    refusal = F.greatest(says_insufficient(output["answer"]).cast("double"), answer_reward(output["answer"], gold, F.lit("extractive")))
    refused = 0.2 + 0.3 * (output["support_status"] == "insufficient").cast("double") + 0.2 * (F.size(refs) == 0).cast("double") + 0.3 * refusal
    wrong = F.when(F.size(F.array_except(refs, positive)) > 0, 0.15).otherwise(0.0)
    backed = 0.15 + 0.35 * answer_reward(output["answer"], gold, answer_type) + 0.2 * (output["support_status"] == "supported").cast("double") + 0.3 * F.arrays_overlap(refs, positive).cast("double")
    return F.when(fault.isNotNull(), 0.0).when(insufficient, refused).otherwise(F.greatest(F.lit(0.0), backed - wrong))


def nearest_rank(values: Column, q: float) -> Column:
    """The ceil(q n)-th smallest of an array; 0 of an empty one."""
    ordered = F.sort_array(values)
    return F.coalesce(F.try_element_at(ordered, F.greatest(F.lit(1), F.ceil(F.size(values) * q).cast("int"))), F.lit(0.0))


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean, median and 95th percentile (nearest rank) of each group; values are counted first, so a group's memory follows its distinct values."""
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, F.lit(0.5)), 6).alias("median"), F.round(F.expr(f"percentile_disc(0.95) within group (order by {value})"), 6).alias("p95"))


def compare_runs(before: DataFrame, after: DataFrame, key: str, score: str) -> DataFrame:
    """Rows of both runs with how they moved."""
    both = before.select(key, F.col(score).alias("before")).join(after.select(key, F.col(score).alias("after")), key)
    change = F.when(F.col("after") > F.col("before"), "improved").when(F.col("after") < F.col("before"), "regressed").otherwise("same")
    return both.withColumn("change", change)


def movement(before: DataFrame, after: DataFrame, key: str, ok: str) -> DataFrame:
    """Every row of either run with its class of movement."""
    both = before.select(key, F.col(ok).alias("was")).join(after.select(key, F.col(ok).alias("now")), key, "full_outer")
    label = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") & F.col("now"), "kept").when(F.col("was"), "lost").when(F.col("now"), "gained").otherwise("missed")
    return both.select(key, label.alias("movement"))


def metric_deltas(base: DataFrame, new: DataFrame, metric: str, value: str) -> DataFrame:
    """Absolute and relative change by metric; relative is null at a base of 0."""
    both = base.select(metric, F.col(value).alias("base")).join(new.select(metric, F.col(value).alias("new")), metric)
    return both.withColumns({"delta": F.round(F.col("new") - F.col("base"), 6), "relative": F.round(F.try_divide(F.col("new") - F.col("base"), F.nullif(F.col("base"), F.lit(0.0))), 6)})


def group_advantages(rows: DataFrame, group: str, reward: str) -> DataFrame:
    """Rewards less their group's mean over its standard deviation; 0 where a group doesn't vary."""
    own = Window.partitionBy(group)
    spread = F.stddev_pop(reward).over(own)
    return rows.withColumn("advantage", F.when(spread < 1e-6, 0.0).otherwise(F.round((F.col(reward) - F.avg(reward).over(own)) / (spread + 1e-6), 6)))
