"""Exact order over tables too large for one task: byte keys that sort as their columns do, a radix drill-down, and ranks.

A drill-down step counts (or sums) the rows of one bucket by the next byte of their keys; at most 256 rows a step reach the
driver. It descends into the bucket in which a limit is crossed, skipping the bytes that all its keys share.
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import common

LOWEST = -(1 << 63)


def number_key(number: Column) -> Column:
    """Eight bytes that sort as the long does."""
    return F.unhex(F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(LOWEST))), 16, "0"))


def text_key(text: Column) -> Column:
    """Bytes that sort as the text's UTF-8 does and are no prefix of another text's: zero bytes are marked, two end it."""
    return F.concat(F.replace(text, F.lit("\0"), F.lit("\0\1")), F.lit("\0\0")).cast("binary")


def digit(key: Column, at: Column | int) -> Column:
    """The byte of the key at place `at` (from 0), as two hex digits: '' where the key has ended."""
    return F.hex(F.substring(key, F.lit(at) + 1 if isinstance(at, int) else at + 1, F.lit(1)))


def crossing(rows: DataFrame, allowed: int) -> bytes | None:
    """The smallest key up to which (itself included) the weights sum to more than allowed; None where all fit.

    rows: key (binary, unique), weight (long, 0 or more). Rows below the key are the longest prefix that fits.
    """
    left = allowed
    found = rows.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.sum("weight").alias("weight")).first()
    low, high = found["low"], found["high"]
    if low is None or found["weight"] <= allowed:
        return None
    while low != high:
        inside = rows.where(F.col("key").between(F.lit(bytes(low)), F.lit(bytes(high))))
        depth = len(commonprefix([bytes(low), bytes(high)]))
        totals = inside.groupBy(digit(F.col("key"), depth).alias("digit")).agg(F.sum("weight").alias("weight"), F.min("key").alias("low"), F.max("key").alias("high"))
        for bucket in sorted(totals.collect()):  # at most 257 rows
            if bucket["weight"] > left:
                low, high = bucket["low"], bucket["high"]
                break
            left -= bucket["weight"]
    return bytes(low)


def ranked(rows: DataFrame, name: str = "index") -> DataFrame:
    """rows (key: binary, unique) with their rank by key, from 0: ranges of keys, and the ranges' counts as offsets."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = common.materialise(rows.repartitionByRange(parts, "key").withColumn("__range", F.spark_partition_id()))
    counts = dict(placed.groupBy("__range").count().collect())  # a row a partition
    upto, offsets = 0, []
    for k in range(max(counts, default=-1) + 1):
        offsets.append(upto)
        upto += counts.get(k, 0)
    if not offsets:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("__range")
    offset = F.get(F.expr(f"cast(split('{','.join(map(str, offsets))}', ',') as array<bigint>)"), F.col("__range"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy("key"))
    return placed.withColumn(name, (offset + inside - 1).cast("long")).drop("__range")


def narrowed(state: DataFrame, totals: DataFrame, by: list[str], order: Column) -> DataFrame:
    """state (by, low, high, n, need) of each group whose buckets are in totals (by, bucket, low, high, n): the bucket, in
    order, in which its need-th row lies, and how many of that bucket's first rows are needed."""
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy(order))  # as many rows a group as there are buckets
    found = totals.join(state.select(*by, "need"), by).withColumn("upto", upto)
    return found.where("upto >= need and upto - n < need").select(*by, "low", "high", "n", (F.col("need") - F.col("upto") + F.col("n")).alias("need"))


def shared_bytes(state: DataFrame, by: list[str]) -> DataFrame:
    """state with depth: the number of bytes that low and high share."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lows, highs = (batch.column(c).to_pylist() for c in ("low", "high"))
            yield batch.append_column("depth", pa.array([len(commonprefix([a, b])) for a, b in zip(lows, highs, strict=True)], pa.int32()))

    return state.mapInArrow(run, StructType([*state.schema.fields, StructField("depth", IntegerType())]))


def top(rows: DataFrame, by: list[str], value: str, item: str, k: int, enough: int = 4096, bits: int = 10) -> DataFrame:
    """The k rows of each group (columns `by`) with the largest values (long), ties by the item's UTF-8 bytes ascending; with rank, from 1.

    Radix-select: a histogram of 2**bits buckets over each group's open range of values gives the bucket of its k-th one, until
    that bucket holds one value, or no more rows than are sorted at once (`enough`). Ties at that value are narrowed by the
    next byte of their items in the same way. Rows past the open bucket are dropped after each step. (by, item) is unique.
    """
    state = common.materialise(rows.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n")).withColumn("need", F.lit(k).cast("long")))
    live = rows
    while not state.where(f"n > greatest({enough}, need) and low < high").isEmpty():
        placed = live.join(state.select(*by, F.col("low").alias("__low"), F.col("high").alias("__high"), (F.expr(f"n > greatest({enough}, need) and low < high")).alias("__open")), by)
        inside = placed.where(f"__open and `{value}` between __low and __high")
        bucket = F.expr(f"shiftright(`{value}` - __low, greatest(0, length(bin(__high - __low)) - {bits}))")
        totals = inside.groupBy(*by, bucket.alias("bucket")).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"))
        settled = state.where(f"not (n > greatest({enough}, need) and low < high)")
        after = common.materialise(narrowed(state, totals, by, F.desc("bucket")).unionByName(settled))
        kept = common.materialise(live.join(after.select(*by, F.col("low").alias("__low")), by).where(f"`{value}` >= __low").select(*live.columns))
        for table in (state, live):
            common.release(table)
        state, live = after, kept
    # Where a bucket of one value is still too large, its items decide; elsewhere every row that is left is sorted.
    tied = state.where(f"n > greatest({enough}, need)").select(*by, F.col("low").alias("__tie"), "need")
    ties = live.join(tied.drop("need"), by).where(f"`{value}` = __tie").select(*by, F.col(item).cast("binary").alias("key"))
    ends = common.materialise(ties.groupBy(*by).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).join(tied.select(*by, "need"), by))
    while not ends.where(f"n > greatest({enough}, need) and low < high").isEmpty():
        going = shared_bytes(ends.where(f"n > greatest({enough}, need) and low < high").select(*by, "low", "high"), by)
        inside = ties.join(going.toDF(*by, "__low", "__high", "__depth"), by).where("key between __low and __high")
        totals = inside.groupBy(*by, digit(F.col("key"), F.col("__depth")).alias("bucket")).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
        settled = ends.where(f"not (n > greatest({enough}, need) and low < high)")
        after = common.materialise(narrowed(ends, totals, by, F.asc("bucket")).unionByName(settled))
        common.release(ends)
        ends = after
    bounds = tied.drop("need").join(ends.select(*by, F.col("high").alias("__last")), by)
    left = live.join(bounds, by, "left").where(f"__tie is null or `{value}` > __tie or cast(`{item}` as binary) <= __last").select(*live.columns)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), F.col(item).cast("binary")))
    return left.withColumn("rank", rank).where(F.col("rank") <= k)
