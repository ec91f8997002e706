"""Readers and writers: JSON lines, paged text, typed content lists, file registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T

# Raw element types and the block types they become.
BLOCK_TYPES = {"table": "table", "image": "image", "figure": "image", "chart": "image", "page": "page"}
BOILERPLATE_TYPES = ("header", "footer", "page_number")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; blank lines are skipped, a byte order mark at the start is dropped."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line")).where(F.trim("line") != "")
    return lines.select(F.from_json("line", kind).alias("row")).select("row.*")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def split_pages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, page (from 1), text of the pages that form feeds separate; blank pages go, numbers stay."""
    pages = docs.select(key, F.posexplode(F.split(F.col(text), "\f")).alias("pos", "page_text"))
    trimmed = pages.select(key, (F.col("pos") + 1).alias("page"), T.collapse(F.col("page_text")).alias("text"))
    return trimmed.where("text <> ''")


def read_text_pages(spark: SparkSession, path: str) -> DataFrame:
    return split_pages(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"), "file", "value")


def page_number_like(text: Column) -> Column:
    plain = F.btrim(F.lower(T.collapse(text)), F.lit(" -–—|·•"))
    return (plain == "") | plain.rlike(r"^(page\s*)?\d{1,4}(\s*(of|/)\s*\d{1,4})?$") | plain.rlike("^[ivxlcdm]{1,8}$")


def boilerplate(raw_type: Column, text: Column) -> Column:
    """Headers, footers and page numbers that say nothing: a page number, or no figure and under six words."""
    telling = text.rlike(r"[$€£¥%]|\d") | (F.size(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))) >= 6)
    return raw_type.isin(*BOILERPLATE_TYPES) & (page_number_like(text) | ~telling)


def block_type(raw_type: Column) -> Column:
    found = F.lit("text")
    for raw, kind in BLOCK_TYPES.items():
        found = F.when(raw_type == raw, kind).otherwise(found)
    return found


def content_blocks(items: DataFrame) -> DataFrame:
    """Blocks of typed items (doc_id, idx, type, text, page_idx, bbox): pages from 1, boxes of four numbers only;
    empty items go unless they are boilerplate, which is kept out of retrieval by its flag."""
    flagged = items.withColumn("is_boilerplate", boilerplate(F.col("type"), F.coalesce("text", F.lit(""))))
    kept = flagged.where(F.col("is_boilerplate") | (T.collapse(F.coalesce("text", F.lit(""))) != ""))
    page = F.col("page_idx") + 1
    return kept.select("doc_id", F.format_string("%s_p%03d_b%04d", F.col("doc_id").cast("string"), page, F.col("idx") + 1).alias("block_id"), block_type(F.col("type")).alias("block_type"), T.collapse(F.coalesce("text", F.lit(""))).alias("text"), page.alias("page"), F.when(F.size("bbox") == 4, F.col("bbox")).alias("bbox"), "is_boilerplate")


def register_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("txt", "pdf", "json", "md")) -> DataFrame:
    """Path, name, size, hash and id of files with a known suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    rows = files.select("path", name.alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"))
    return rows.where(F.col("suffix").isin(*suffixes)).withColumn("id", F.substring("sha256", 1, 16))
