"""Streams: ingestion that skips content already seen, and counts by time window (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_content(stream: DataFrame, key: str, text: str) -> DataFrame:
    """Each content of a stream once, with its hash; the state grows with distinct contents."""
    return stream.select(key, F.sha2(text, 256).alias("sha256")).dropDuplicates(["sha256"])


def window_counts(stream: DataFrame, time: str, by: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by tumbling window and group; windows older than the watermark leave the state."""
    counted = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), by, "n")


def run_once(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; append writes files, complete replaces them after every batch."""
    writer = result.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return query
