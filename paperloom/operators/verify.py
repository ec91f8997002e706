"""Manifests held against what is there: canonical JSON, digests that don't depend on order, files read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 4  # of 32 bits each


def canonical(text: Column) -> Column:
    """JSON text with sorted keys at every depth and no spaces; null where it isn't JSON. Of repeated keys nothing is kept: that isn't JSON here."""
    return F.to_json(F.try_parse_json(text))


def row_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, each with its length before it, so that no two lists of parts look the same; null is told from empty."""
    told = [F.when(p.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p)) for p in parts]
    return F.sha2(F.concat(*told), 256)


def digest(hashes: Column) -> Column:
    """Digest of a group's row hashes in any order: sums of their first words of 32 bits, so partial sums meet and nothing is gathered."""
    word = lambda i: F.conv(F.substring(hashes, 8 * i + 1, 8), 16, 10).cast("long")
    return F.concat_ws("-", *[F.sum(word(i)).cast("string") for i in range(WORDS)])


def group_manifest(rows: DataFrame, by: list[str], size: Column, *parts: Column) -> DataFrame:
    """by, n, bytes and digest of each group of rows: what a manifest says of it."""
    return rows.withColumns({"__size": size, "__hash": row_hash(*parts)}).groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum("__size"), F.lit(0)).alias("bytes"), digest(F.col("__hash")).alias("digest"))


def contract_errors(manifest: DataFrame, actual: DataFrame, by: list[str]) -> DataFrame:
    """by and errors of each entry of a manifest or group that is there; entries that agree have none.

    Both sides are of group_manifest(). A group in only one of them is missing or unlisted; null keys meet.
    """
    said, found = manifest.alias("m"), actual.alias("a")
    same = F.lit(True)
    for name in by:
        same = same & F.col(f"m.{name}").eqNullSafe(F.col(f"a.{name}"))
    both = said.join(found, same, "full")
    listed, there = F.col("m.n").isNotNull(), F.col("a.n").isNotNull()
    wrong = lambda name, error: F.when(listed & there & (F.col(f"m.{name}") != F.col(f"a.{name}")), error)
    errors = F.array_compact(F.array(F.when(~there, "missing_artifact"), F.when(~listed, "unlisted_artifact"), wrong("n", "count_mismatch"), wrong("bytes", "byte_size_mismatch"), wrong("digest", "hash_mismatch")))
    return both.select(*[F.coalesce(f"m.{name}", f"a.{name}").alias(name) for name in by], errors.alias("errors"))


def file_errors(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """path and errors of a manifest's entries (path under the folder, byte_size, sha256), whose files are read again.

    A manifest can't list itself; null sizes and hashes are mismatches. Repeated entries are judged each.
    Spark's reader gives no row for a file of no bytes, so such a file counts as missing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/"
    inside = F.substring_index(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?(?=/)", ""), root, -1)
    held = files.select(inside.alias("path"), F.col("length").alias("actual_size"), F.sha2("content", 256).alias("actual_sha"))
    both = manifest.select("path", "byte_size", "sha256").join(held, "path", "left")
    itself = F.regexp_extract("path", "([^/]+)$", 1) == "manifest.json"
    there = F.col("actual_size").isNotNull()
    found = F.when(itself, F.array(F.lit("manifest_self_hash_present"))).when(~there, F.array(F.lit("missing_artifact")))
    wrong = F.array(F.when(~F.col("byte_size").eqNullSafe(F.col("actual_size")), "byte_size_mismatch"), F.when(~F.col("sha256").eqNullSafe(F.col("actual_sha")), "sha256_mismatch"))
    return both.select("path", F.coalesce(found, F.array_compact(wrong)).alias("errors"))
