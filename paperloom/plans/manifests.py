"""Queries of manifests, counts, states and training records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifests as M
from . import fixtures as X
from . import scoring as C
from .registry import query

IDENTITIES = """windows as (select conv_id as doc_id, list('p' || turn order by turn) as page_ids from conversations group by 1),
identities as (select doc_id, ordinal, 'p' || (ordinal - 1) as page_id, block_id, child_ids, case when block_id is null then 'missing_page_aggregate' when child_ids = '' then 'page_aggregate_has_no_child_blocks' else '' end as errors from (
select doc_id, page as ordinal, case when (doc_id + page) % 7 <> 0 then doc_id || '_' || page end as block_id, case when (doc_id + page) % 7 <> 0 then case when (doc_id + page) % 5 = 0 then '' else string_agg(block_id, ',' order by ord) end end as child_ids from page_lines group by doc_id, page))"""


def windows(spark, sf_dir):
    """doc_id and the ids of its pages, in order."""
    turns = F.array_sort(F.collect_list("turn"))
    return X.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.transform(turns, lambda t: F.concat(F.lit("p"), t.cast("string"))).alias("page_ids"))


def identities(spark, sf_dir):
    key = F.col("doc_id") + F.col("page")
    pages = X.page_lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "block_id"))).alias("lines"))
    children = F.when(key % 5 == 0, F.array().cast("array<string>")).otherwise(F.transform("lines", lambda x: x["block_id"]))
    return M.page_identities(windows(spark, sf_dir), pages.where(key % 7 != 0).select("doc_id", "page", F.concat_ws("_", "doc_id", "page").alias("block_id"), children.alias("child_ids")))


@query("select doc_id, ordinal, page_id, block_id, child_ids, errors from identities", X.PAGE_LINES, IDENTITIES)
def page_identities(spark, sf_dir):
    return identities(spark, sf_dir).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "page_id", "block_id", F.array_join("child_ids", ",").alias("child_ids"), F.array_join("errors", ",").alias("errors"))


@query("""select qid, block_id, array_to_string([x for x in [case when gold <> idx + 1 then 'answer_page_idx_gold_page_ordinal_mismatch' end, case when gold_page_id is distinct from page_ids[idx + 1] then 'gold_page_id_mismatch' end, case when i.doc_id is null then 'missing_page_identity' end, nullif(errors, '')] if x is not null], ',') as errors
from (select doc_id, doc_id as qid, page_ids, doc_id % 3 as idx, doc_id % 3 + 1 + (doc_id % 4 = 0)::int as gold, case when doc_id % 6 = 1 then 'p9' else 'p' || (doc_id % 3) end as gold_page_id from windows) q left join identities i on i.doc_id = q.doc_id and i.ordinal = gold""", X.PAGE_LINES, IDENTITIES)
def question_page_map(spark, sf_dir):
    key = F.col("doc_id")
    idx = (key % 3).cast("int")
    gold = idx + 1 + (key % 4 == 0).cast("int")
    asked = windows(spark, sf_dir).select(key, key.alias("qid"), idx.alias("answer_page_idx"), gold.alias("gold_ordinal"), F.when(key % 6 == 1, "p9").otherwise(F.concat(F.lit("p"), idx.cast("string"))).alias("gold_page_id"))
    return M.question_pages(asked, windows(spark, sf_dir), identities(spark, sf_dir)).select("qid", "block_id", F.array_join("errors", ",").alias("errors"))


@query("""select o_custkey as w, sum(n)::bigint as rows, count(*) as variants, sum(n)::bigint - count(*) as duplicates, count(*) > 1 as conflicting, bool_or(a = b) as repeated from (select o_custkey, sha256(o_orderstatus) as a, sha256(case when o_orderkey % 4 = 0 then o_orderstatus else left(o_orderpriority, 1) end) as b, count(*) as n from orders group by 1, 2, 3) group by 1""")
def window_conflicts(spark, sf_dir):
    second = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus")).otherwise(F.substring("o_orderpriority", 1, 1))
    rows = X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("w"), F.array(F.sha2("o_orderstatus", 256), F.sha2(second, 256)).alias("hashes"))
    return M.window_conflicts(rows, "w", "hashes").select("w", "rows", "variants", "duplicates", "conflicting", "repeated")


@query("""select doc_id, case when doc_id % 3 = 0 then 5 when page_blocks > 0 then page_blocks else seen end::bigint as pages, case when doc_id % 3 = 0 then 'documents.page_count' when page_blocks > 0 then 'evidence_blocks.page_blocks' else 'evidence_blocks.page_ids' end as source, blocks, tables, images, tables > 0 as has_tables, images > 0 as has_images from (
select doc_id, count(distinct case when kind = 'page' then page end) as page_blocks, count(distinct page) as seen, count(*) filter (kind <> 'page') as blocks, count(*) filter (kind = 'table') as tables, count(*) filter (kind in ('image', 'figure')) as images from (
select doc_id, page, case when ord = 1 and doc_id % 3 = 1 and page % 2 = 0 then 'page' when ord % 4 = 0 then 'table' when ord % 4 = 1 then 'text' when ord % 4 = 2 then 'image' else 'figure' end as kind from page_lines) group by 1)""", X.PAGE_LINES)
def document_profiles(spark, sf_dir):
    ord_, doc = F.col("ord"), F.col("doc_id")
    kind = F.when((ord_ == 1) & (doc % 3 == 1) & (F.col("page") % 2 == 0), "page").when(ord_ % 4 == 0, "table").when(ord_ % 4 == 1, "text").when(ord_ % 4 == 2, "image").otherwise("figure")
    docs = X.messages(spark, sf_dir).select("doc_id", F.when(doc % 3 == 0, 5).alias("page_count")).distinct()
    return M.document_counts(docs, X.page_lines(spark, sf_dir).select("doc_id", "page", kind.alias("block_type")))


@query("""select doc_id, page, trim(string_agg(text, chr(10) order by ord)) as text, round(avg(case when ord % 5 <> 0 then ((ord * 37) % 100) / 100.0 end), 6)::double as score from page_lines group by 1, 2""", X.PAGE_LINES)
def recognised_pages(spark, sf_dir):
    lines = X.page_lines(spark, sf_dir).withColumn("score", F.when(F.col("ord") % 5 != 0, (F.col("ord") * 37) % 100 / 100.0))
    return M.recognised_text(lines, "doc_id", "page")


STATED = "stated as (select user_id, event_id, case event_id * 5 % 7 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(M.STATES)) + " end as state from events)"
ALLOWED = " or ".join(f"(before = '{a}' and state in ({', '.join(f"'{s}'" for s in then)}))" for a, then in M.FOLLOWS)


@query(f"select user_id, arg_max(state, event_id) as state, count(before) as changes, count(*) filter (before is not null and not ({ALLOWED})) as illegal from (select *, lag(state) over (partition by user_id order by event_id) as before from stated) group by 1", STATED)
def state_changes(spark, sf_dir):
    state = F.get(F.array(*map(F.lit, M.STATES)), (F.col("event_id") * 5 % 7).cast("int"))
    return M.state_log(X.table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("state")), "user_id", "event_id", "state")


@query("select qid, case when qid % 4 = 1 then 'missing_messages' when qid % 4 = 2 then 'messages_must_end_system_user_assistant' when qid % 9 = 5 then 'invalid_assistant_json' when error is not null then 'invalid_v3_target:' || error end as error from checked", X.PREDICTIONS, C.OUTPUTS)
def training_record_errors(spark, sf_dir):
    qid, say = F.col("qid"), lambda *names: F.array(*map(F.lit, names))
    roles = F.when(qid % 4 == 0, say("system", "user", "assistant")).when(qid % 4 == 1, say("user", "assistant")).when(qid % 4 == 2, say("system", "user", "assistant", "user")).otherwise(say("user", "system", "user", "assistant"))
    return C.outputs(spark, sf_dir).select("qid", M.record_error(roles, F.when(qid % 9 != 5, F.col("output")), say("E1", "E2")).alias("error"))
