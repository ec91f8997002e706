"""Greedy cover of features by rows, in rounds of many rows at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import removed, scratch_path, written
from . import prefix as P
from . import retrieval as R
from .training import stable_key


def greedy_cover(rows: DataFrame, key: str, features: str, seed: str, n: int) -> DataFrame:
    """key, gain (features that the row is the first to bring) and place (from 1) of n rows.

    The next row is the one that brings most features that no chosen row has, of equals the one with the smallest stable hash; once
    no row brings any, the smallest hashes fill up, with gain 0. Rows with equal features can't both bring any, so a row of each set
    of features stands for them. Gains only fall, so rows wait in folders by the gain they had when last looked at, and only the folder
    of the greatest gain is looked at again. In it, a row is chosen as soon as none before it has a feature of its own: such rows
    take nothing from each other, so all are chosen in one round, in the same places as one by one. Rows with null or no features only fill up;
    keys are unique.
    """
    spark = rows.sparkSession
    given = written(rows.select(F.col(key).alias("id"), stable_key(F.col(key), seed).alias("hash"), F.array_distinct(F.coalesce(features, F.array().cast("array<string>"))).alias("features")))
    sets = given.where(F.size("features") > 0).groupBy(F.array_sort(F.array_compact("features")).alias("features")).agg(F.min(F.struct("hash", "id")).alias("row"))
    waiting, covered_path, chosen_path = (scratch_path(spark, name) for name in ("cover-waiting", "cover-seen", "cover-chosen"))
    shape = sets.select("row", "features").withColumn("gain", F.size("features")).where("gain > 0")
    shape.write.partitionBy("gain").parquet(waiting)
    gains = {r[0] for r in spark.read.schema(shape.schema).parquet(waiting).select("gain").distinct().collect()}  # no more than the longest set
    covered = spark.createDataFrame([], "feature string")
    covered.write.parquet(covered_path)
    chosen, taken = spark.createDataFrame([], shape.select("row", "gain").schema), 0
    chosen.write.parquet(chosen_path)
    while gains and taken < n:
        gain = max(gains)
        gains.discard(gain)
        band = spark.read.schema(shape.schema).parquet(waiting).where(F.col("gain") == gain).select("row", F.explode("features").alias("feature"))
        while True:
            seen = spark.read.schema(covered.schema).parquet(covered_path)
            fresh = band.join(R.small(seen), "feature", "left_anti")
            left = written(fresh.groupBy("row").agg(F.collect_list("feature").alias("features")).withColumn("gain", F.size("features")))
            less = left.where(F.col("gain") < gain)
            lower = [r[0] for r in less.select("gain").distinct().collect()]
            if lower:
                less.write.mode("append").partitionBy("gain").parquet(waiting)
                gains.update(lower)
            whole = left.where(F.col("gain") == gain).select("row", F.explode("features").alias("feature"))
            first = whole.groupBy("feature").agg(F.min("row").alias("row"))
            won = written(first.groupBy("row").agg(F.count("*").alias("leads"), F.collect_list("feature").alias("features")).where(F.col("leads") == gain))
            new = won.count()
            if not new:
                break
            won.select("row", F.lit(gain).alias("gain")).write.mode("append").parquet(chosen_path)
            won.select(F.explode("features").alias("feature")).write.mode("append").parquet(covered_path)
            taken += new
            band = whole
    chosen = spark.read.schema(chosen.schema).parquet(chosen_path).select("row.id", "row.hash", F.col("gain").cast("int").alias("gain"))
    # one order for all: falling gains, then hashes; who wasn't chosen has gain 0
    everyone = given.select("id", "hash").join(chosen.select("id", "gain"), "id", "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    order = F.concat(F.lpad((F.lit((1 << 31) - 1) - F.col("gain")).cast("string"), 10, "0"), F.lit("-"), "hash")
    best = everyone.withColumn("order", order)
    ranked = P.running(written(best.select("id", "gain", "hash", "order")).withColumn("first", F.conv(F.substring("hash", 1, 12), 16, 10).cast("double") - F.col("gain") * float(1 << 48)), "first", ["order", "id"], name="place")
    out = written(ranked.where(F.col("place") <= n).select(F.col("id").alias(key), "gain", "place"))
    for path in (waiting, covered_path, chosen_path):
        removed(spark, path)
    return out
