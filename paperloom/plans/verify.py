"""Queries of manifests and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import verify as V
from . import fixtures as X
from .registry import query

HASH = "sha256(strlen({id}::varchar)::varchar || ':' || {id}::varchar || coalesce(strlen({text})::varchar || ':' || {text}, '-'))"
DIGEST = "concat_ws('-', " + ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::bigint)::varchar" for i in range(V.WORDS)) + ")"


def listing(text: str, where: str = "true") -> str:
    """SQL of a manifest by source and language of documents with that text."""
    return f"select source, lang, count(*) as n, coalesce(sum(strlen(text)), 0) as bytes, {DIGEST} as digest from (select *, {HASH.format(id='doc_id', text='text')} as h from (select doc_id, source, lang, {text} as text from documents where {where})) group by 1, 2"


def manifest(docs):
    return V.group_manifest(docs, ["source", "lang"], F.octet_length("text"), F.col("doc_id").cast("string"), F.col("text"))


@query(f"select source, lang, n, bytes::bigint as bytes, digest from ({listing('text')})")
def corpus_digests(spark, sf_dir):
    return manifest(X.table(spark, sf_dir, "documents"))


@query(f"""select coalesce(m.source, a.source) as source, coalesce(m.lang, a.lang) as lang, array_to_string([e for e in [case when a.n is null then 'missing_artifact' end, case when m.n is null then 'unlisted_artifact' end, case when m.n <> a.n then 'count_mismatch' end,
case when m.bytes <> a.bytes then 'byte_size_mismatch' end, case when m.digest <> a.digest then 'hash_mismatch' end] if e is not null], ',') as errors
from ({listing('text')}) m full join ({listing('trim(text)', 'doc_id in (select doc_id from labels) or length(source) > 4')}) a on m.source is not distinct from a.source and m.lang is not distinct from a.lang""")
def manifest_contract(spark, sf_dir):
    """The corpus' manifest against a copy of it with trimmed texts, from which unlabelled documents of sources with short names are gone."""
    docs = X.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    labelled = X.table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled")).distinct()
    kept = docs.join(labelled, "doc_id", "left").where(F.col("labelled") | (F.length("source") > 4)).withColumn("text", F.btrim("text", F.lit(" ")))
    errors = V.contract_errors(manifest(docs), manifest(kept), ["source", "lang"])
    return errors.select("source", "lang", F.array_join("errors", ",").alias("errors"))


@query()
def canonical_props(spark, sf_dir):
    """How many clicks carry each content of props, whatever the order of its keys and its spaces: hash, n, spellings."""
    props = X.table(spark, sf_dir, "clicks").select("props", F.sha2(V.canonical(F.col("props")), 256).alias("sha256"))
    return props.groupBy("sha256").agg(F.count("*").alias("n"), F.countDistinct("props").alias("spellings"))
