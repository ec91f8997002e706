"""Ingestion as one flow: a stream of files is registered, parsed, aggregated by page and stored; it can stop and restart anywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "registered": "doc_id string, sha256 string, path string, content string",
    "blocks": "doc_id string, page int, ord int, block_id string, text string",
    "pages": "doc_id string, page int, block_id string, child_ids array<string>, text string",
    "documents": "doc_id string, sha256 string, path string, pages long, blocks long, parse_status string, error string",
    "log": "doc_id string, step int, state string",
}


def stored(spark: SparkSession, folder: str, table: str, before: int | None = None) -> DataFrame:
    """A table of the flow, with the batch that wrote each row; of earlier batches only, if `before` is given."""
    rows = spark.read.schema(f"{TABLES[table]}, batch long").parquet(f"{folder}/{table}")
    return rows if before is None else rows.where(F.col("batch") < before)


def line_blocks(docs: DataFrame) -> DataFrame:
    """The usual parser: form feeds part pages, every line that isn't blank is a block (doc_id, page, ord, text)."""
    pages = docs.select("doc_id", F.posexplode(F.split("content", "\f")).alias("page", "said"))
    lines = pages.select("doc_id", (F.col("page") + 1).alias("page"), F.posexplode(F.split("said", "\n")).alias("ord", "text"))
    return lines.where(F.trim("text") != "").select("doc_id", "page", (F.col("ord") + 1).alias("ord"), "text")


def store_batch(batch: DataFrame, number: int, folder: str, parse: Callable[[DataFrame], DataFrame] = line_blocks) -> None:
    """Take in one batch (path, content).

    A content is known by its SHA-256, under its smallest path; contents that an earlier batch parsed are skipped, those it failed on
    are tried again, and those without a block fail. A batch writes only its own folder of each table and reads only earlier batches' ones: repeated
    after a stop at any step, it overwrites what it left with the same rows.
    """
    spark = batch.sparkSession

    def keep(table: str, rows: DataFrame) -> DataFrame:
        path = f"{folder}/{table}/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        return spark.read.schema(TABLES[table]).parquet(path)

    hashed = batch.select("path", F.coalesce("content", F.lit("")).alias("content")).withColumn("sha256", F.sha2("content", 256))
    once = hashed.groupBy("sha256").agg(F.min("path").alias("path"), F.first("content").alias("content"))
    known = stored(spark, folder, "documents", number).where("parse_status = 'parsed'").select("sha256")
    fresh = keep("registered", once.join(known, "sha256", "left_anti").select(F.substring("sha256", 1, 16).alias("doc_id"), "sha256", "path", "content"))
    name = lambda suffix: F.format_string(f"%s_p%03d{suffix}", "doc_id", "page")
    parsed = parse(fresh).withColumn("block_id", F.concat(name("_b"), F.lpad("ord", 4, "0")))
    blocks = keep("blocks", parsed.select("doc_id", F.col("page").cast("int").alias("page"), F.col("ord").cast("int").alias("ord"), "block_id", "text"))
    lines = blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "block_id", "text"))).alias("lines"))
    pages = keep("pages", lines.select("doc_id", "page", name("").alias("block_id"), F.col("lines.block_id").alias("child_ids"), F.array_join("lines.text", "\n").alias("text")))
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.size("child_ids")).alias("blocks"))
    states = fresh.join(counts, "doc_id", "left").withColumn("parse_status", F.when(F.col("pages") > 0, "parsed").otherwise("parse_failed"))
    error = F.when(F.col("parse_status") == "parse_failed", "no_blocks")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    documents = keep("documents", states.select("doc_id", "sha256", "path", zero("pages"), zero("blocks"), "parse_status", error.alias("error")))
    steps = F.array(F.lit("registered"), F.lit("parsing"), F.col("parse_status"))
    keep("log", documents.select("doc_id", F.posexplode(steps).alias("step", "state")))


def ingest(stream: DataFrame, folder: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame] = line_blocks) -> None:
    """Take in what a stream (path, content) holds by now and stop; run again with the same folders, it goes on where it stopped."""
    spark = stream.sparkSession
    for table, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{table}/batch=-1")
    taken = stream.writeStream.foreachBatch(lambda batch, number: store_batch(batch, number, folder, parse)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    taken.awaitTermination()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of each document."""
    rows = stored(spark, folder, "documents")
    return rows.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "doc_id"]), "batch").alias("row")).select("doc_id", "row.*")
