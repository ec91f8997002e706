"""Query of the ingestion flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from ..streaming import flow
from . import fixtures as X
from .registry import query


@query("""select left(sha256(content), 16) as doc_id, min(doc_id::varchar) as path, count(distinct case when trim(line, ' ') <> '' then page end) as pages, count(distinct case when trim(line, ' ') <> '' then page * 1000000000 + ord end) as blocks,
case when bool_or(trim(line, ' ') <> '') then 'parsed' else 'parse_failed' end as parse_status from (
select doc_id, content, page, unnest(string_split(said, chr(10))) as line, generate_subscripts(string_split(said, chr(10)), 1) as ord from (
select doc_id, content, unnest(string_split(content, chr(12))) as said, generate_subscripts(string_split(content, chr(12)), 1) as page from (select doc_id, coalesce(text, '') as content from documents))) group by content""")
def ingested_documents(spark, sf_dir):
    """All documents as a stream of files, each content taken in once."""
    path = f"{sf_dir}/document[s].parquet"  # as a pattern it may be a file or a folder
    stream = spark.readStream.schema(X.table(spark, sf_dir, "documents").schema).parquet(path)
    folder = scratch_path(spark, "ingested")
    flow.ingest(stream.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")), folder, f"{folder}/checkpoint")
    return flow.current(spark, folder).select("doc_id", "path", "pages", "blocks", "parse_status")
