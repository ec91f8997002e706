"""Queries of planned queries, record audits, candidate filters, recovery triggers and review queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..operators import evidence as E
from ..operators import review as V
from . import fixtures as X
from . import retrieval as Q
from . import scoring as C
from .documents import PLAIN
from .registry import query

NORM = r"trim(regexp_replace(lower({}), '[^a-z0-9\x{{4e00}}-\x{{9fff}}.%+-]+', ' ', 'g'))"
FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
TASKS = ("page_lookup", "table_lookup_or_calculation", "visual_pixel_qa", "document_statistics", "document_summary", "")
ASKING = "asking as (select qid::bigint as qid, question, case qid % 6 " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(TASKS)) + " end as task from (select * from intents union all select qid + 1000, question from questions))"
ASKING_VIEWS = (X.INTENTS_SQL, X.QUESTIONS, ASKING)


def asking(spark, sf_dir):
    rows = X.intents(spark).union(X.questions(spark, sf_dir).select(F.col("qid") + 1000, "question"))
    return rows.select(F.col("qid").cast("long").alias("qid"), "question", F.get(F.array(*map(F.lit, TASKS)), (F.col("qid") % 6).cast("int")).alias("task"))


KEYS = r"""list_transform(list_concat(list_concat(regexp_extract_all(said, '\b(?:19|20)\d{2}\b'), regexp_extract_all(said, '\b\d+(?:\.\d+)?%?\b')), regexp_extract_all(said, '[A-Za-z][A-Za-z0-9_-]+|[\x{4e00}-\x{9fff}]+')), lambda w: lower(w))"""
FIRST_SEEN = "[y for y, i in {0} if list_position([lower(z) for z in {0}], lower(y)) = i]"
PLANNED_SQL = ", ".join(f"case when task = '{name}'{f" or regexp_matches(said, '{pattern}')" if pattern else ''} then '{start}' || keys end" for name, pattern, starts in V.PLANNED for start in starts)
PLANS = rf"""planned as (select qid, said, {FIRST_SEEN.format('items')} as queries from (select qid, said, [trim(x) for x in [case when page <> '' or task = 'page_lookup' then 'page ' || page end, case when page <> '' then 'text page ' || page end, {PLANNED_SQL}, keys, said] if trim(x) <> ''] as items
from (select qid, task, said, regexp_extract(said, '{V.PAGE}', 1) as page, array_to_string(list_slice([y for y, i in ks if list_position(ks, y) = i], 1, 10), ' ') as keys from (select *, {KEYS} as ks from (select qid, task, {FLAT.format('question')} as said from asking)))))"""


@query("select qid, array_to_string(queries, ' | ') as queries from planned", *ASKING_VIEWS, PLANS)
def rule_queries(spark, sf_dir):
    return asking(spark, sf_dir).select("qid", F.array_join(V.planned_queries(F.col("question"), F.col("task")), " | ").alias("queries"))


@query(f"select qid, array_to_string(list_slice({FIRST_SEEN.format('joined')}, 1, 5), ' | ') as queries from (select qid, list_concat(queries, [upper(said), 'find ' || said, 'find more']) as joined from planned)", *ASKING_VIEWS, PLANS)
def fused_queries(spark, sf_dir):
    q = F.col("question")
    more = F.array(F.upper(q), F.concat(F.lit(" find  "), q), F.lit("  "), F.lit("find more"))
    return asking(spark, sf_dir).select("qid", F.array_join(V.fuse_queries(V.planned_queries(q, F.col("task")), more, 5), " | ").alias("queries"))


FITS = " + ".join(f"regexp_matches(plain, '{p}')::int" for n, p in D.ROUTES if n != "visual_question")
ROUTES = dict(D.ROUTES)


@query(rf"""select qid, {FITS} > 1 or regexp_matches(plain, '\b(and then|then also|also)\b') as several,
array_to_string([w for w in [case when qid % 2 = 0 and (regexp_matches(plain, '{ROUTES['table_or_calculation']}') or (regexp_matches(plain, '{ROUTES['structured_extraction']}') and regexp_matches(plain, '\btables?\b'))) then 'document_profile_no_tables' end,
case when qid % 3 = 0 and (regexp_matches(plain, '{ROUTES['visual_question']}') or (regexp_matches(plain, '{ROUTES['structured_extraction']}') and regexp_matches(plain, '\b(images?|figures?)\b'))) then 'document_profile_no_images' end] if w is not null], ',') as warnings from (select qid, {PLAIN} as plain from asking)""", *ASKING_VIEWS)
def question_warnings(spark, sf_dir):
    q, qid = F.col("question"), F.col("qid")
    return asking(spark, sf_dir).select("qid", V.asks_several(q).alias("several"), F.array_join(V.profile_warnings(q, qid % 2, qid % 3), ",").alias("warnings"))


RECORDS = """records as (select item_id as id, case when item_id % 11 = 0 then '' else 'Block b' || (item_id % 7) || ': ' || text end as prompt, case when item_id % 13 <> 0 then 'b' || (item_id % 7) || case when item_id % 5 = 0 then 'x' else '' end end as block, left(text, 100 + ((item_id * 37) % 400)::int) as evidence,
case when item_id % 3 = 0 then 'no such words' else left(text, 20) end as answer, item_id % 6 <> 0 as answered, case when item_id % 4 = 0 then 'numeric' else 'extractive' end as kind from benchmark)"""
ISSUES = rf"""audited_records as (select id, [x for x in [case when block is null then 'location_not_object' when not contains(prompt, block) then 'location_not_in_prompt' end, case when answered and length(evidence) > 300 then 'evidence_too_long' end,
case when answered and length(evidence) >= 300 and regexp_matches(right(evidence, 1), '[\p{{L}}\p{{N}}]') then 'evidence_may_be_midword_truncated' end,
case when answered and kind = 'extractive' and evidence <> '' and not ({NORM.format('answer')} <> '' and contains({NORM.format('evidence')}, {NORM.format('answer')})) then 'extractive_answer_not_in_target_evidence' end, case when prompt = '' then 'missing_user_prompt' end] if x is not null] as issues from records)"""


def audited_records(spark, sf_dir):
    id_, text = F.col("item_id"), F.col("text")
    block = F.when(id_ % 13 != 0, F.concat(F.lit("b"), (id_ % 7).cast("string"), F.when(id_ % 5 == 0, "x").otherwise("")))
    location = F.when(block.isNotNull(), F.struct(block.alias("block_id"), *[F.lit(None).cast("string").alias(k) for k in ("table_id", "image_id", "page_id")]))
    target = F.struct(F.when(id_ % 3 == 0, "no such words").otherwise(F.substring(text, 1, 20)).alias("answer"), F.substr(text, F.lit(1), (100 + (id_ * 37) % 400).cast("int")).alias("evidence"), location.alias("location"))
    prompt = F.when(id_ % 11 == 0, "").otherwise(F.concat(F.lit("Block b"), (id_ % 7).cast("string"), F.lit(": "), text))
    rows = X.table(spark, sf_dir, "benchmark").select(id_.alias("id"), prompt.alias("prompt"), target.alias("target"))
    return rows.select("id", V.record_issues(F.col("prompt"), F.col("target"), F.col("id") % 6 != 0, F.when(F.col("id") % 4 == 0, "numeric").otherwise("extractive")).alias("issues"))


@query("select id, array_to_string(issues, ',') as issues, len(issues) = 0 as clean from audited_records", RECORDS, ISSUES)
def training_record_issues(spark, sf_dir):
    return audited_records(spark, sf_dir).select("id", F.array_join("issues", ",").alias("issues"), (F.size("issues") == 0).alias("clean"))


@query("select issue, count(*) as n from (select unnest(issues) as issue from audited_records) group by 1", RECORDS, ISSUES)
def training_issue_counts(spark, sf_dir):
    return audited_records(spark, sf_dir).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query(f"""select qid, array_to_string(list_sort([x for x in [case when qid % 5 = 0 then 'invalid_json' end, case when qid % 3 = 0 then 'format_error' end, case when qid % 4 <> 0 then 'location_error' end, case when not em then case when f1 > 0 then 'partial_answer' else 'answer_miss' end end,
case when not em then case when qid % 2 = 0 then 'wrong_number' when length(said) > 0 then 'wrong_entity' end end] if x is not null]), ',') as labels from (select qid, {NORM.format('prediction')} = {NORM.format('gold')} as em, f1, prediction as said from predictions join f1 using (qid))""", *C.SCORED)
def answer_failure_labels(spark, sf_dir):
    p, g, qid = F.col("prediction"), F.col("gold"), F.col("qid")
    kind = F.when(qid % 2 == 0, "numeric").otherwise("extractive")
    labels = V.failure_labels(T.exact_match(p, g), T.token_f1(p, g), p, kind, qid % 5 != 0, qid % 3 != 0, qid % 4 == 0)
    return X.predictions(spark, sf_dir).select("qid", F.array_join(labels, ",").alias("labels"))


@query("""select o_orderstatus as status, count(*) filter (b = 'D') as fixed_by_extraction, count(*) filter (b in ('E', 'F')) as covered, count(*) filter (b in ('D', 'E', 'F')) as covered_after, count(*) filter (b = 'C') as span_gap, count(*) filter (b = 'E') as reader_gap from (select o_orderstatus, substr('ABCDEFG', (o_orderkey % 7 + 1)::int, 1) as b from orders) group by 1""")
def bucket_transitions(spark, sf_dir):
    rows = X.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.substr(F.lit("ABCDEFG"), (F.col("o_orderkey") % 7 + 1).cast("int"), F.lit(1)).alias("bucket"))
    return V.bucket_transitions(rows, "status", "bucket")


KINDS = ("numeric", "percentage", "index", "date", "text")
TARGETS = ("text", "numeric", "unknown", "percentage", "index", "date")
CASES = lambda names, value: f"case {value} % {len(names)} " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(names)) + " end"
BOARD = f"""board as (select l_orderkey as qid, l_linenumber as rank, l_quantity / 50 as score, {CASES(KINDS, 'l_partkey')} as kind, {CASES(TARGETS, 'l_orderkey')} as target, case when l_suppkey % 2 = 0 then 'parenthesized_index' else 'number' end as rule, l_tax - 0.04 as context, -l_discount * 2 as long, -l_discount * 3 as noisy, -l_tax * 6 as weak from lineitem)"""
REASONS = """reasoned as (select *, [x for x in [case when numeric and target = 'text' then case when score < 0.55 or context <= 0 then 'drop:generic_numeric_type_mismatch' else 'downrank:numeric_type_mismatch' end end, case when target = 'percentage' and kind in ('numeric', 'index') then 'drop:non_percentage_numeric' end,
case when target = 'index' and numeric and rule <> 'parenthesized_index' then 'downrank:non_parenthesized_index_numeric' end, case when long < -0.15 then 'downrank:long_text' end, case when noisy < -0.15 then 'drop:noisy_fragment' end, case when numeric and weak < -0.4 then 'drop:weak_numeric_context' end] if x is not null] as reasons from (select *, kind in ('numeric', 'percentage', 'index') as numeric from board))"""


def board(spark, sf_dir):
    """Candidates with the reasons against them: qid, rank, score, kind, target, key, reasons."""
    pick = lambda names, value: F.get(F.array(*map(F.lit, names)), (F.col(value) % len(names)).cast("int"))
    parts = F.struct((F.col("l_tax") - 0.04).alias("local_context_match"), (-F.col("l_discount") * 2).alias("long_text_penalty"), (-F.col("l_discount") * 3).alias("noisy_text_penalty"), (-F.col("l_tax") * 6).alias("generic_numeric_penalty"))
    rule = F.when(F.col("l_suppkey") % 2 == 0, "parenthesized_index").otherwise("number")
    rows = X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("rank"), (F.col("l_quantity") / 50).alias("score"), pick(KINDS, "l_partkey").alias("kind"), pick(TARGETS, "l_orderkey").alias("target"), (F.col("l_partkey") % 3).cast("string").alias("key"), rule.alias("rule"), parts.alias("parts"))
    return rows.select("qid", "rank", "score", "kind", "target", "key", V.filter_reasons(F.col("kind"), F.col("rule"), F.col("score"), F.col("parts"), F.col("target")).alias("reasons"))


@query("select qid, rank, array_to_string(reasons, ',') as reasons, round(least(list_sum(list_concat([0.0], [case when starts_with(r, 'drop:') then 0.45 else 0.18 end for r in reasons])), 1.0)::double, 6) as penalty from reasoned", BOARD, REASONS)
def candidate_filter_reasons(spark, sf_dir):
    return board(spark, sf_dir).select("qid", "rank", F.array_join("reasons", ",").alias("reasons"), F.round(V.filter_penalty(F.col("reasons")), 6).alias("penalty"))


@query()
def type_aware_topk(spark, sf_dir):
    """A greedy choice with quotas: no SQL, the tests hold it against plain Python."""
    boards = board(spark, sf_dir).withColumn("eligible", F.size("reasons") == 0).groupBy("qid", "target").agg(F.collect_list(F.struct("score", "rank", "kind", "key", "eligible", "reasons")).alias("board"))
    chosen = boards.select("qid", F.posexplode(V.type_aware_top(F.col("board"), F.col("target"), 3)).alias("pos", "c"))
    return chosen.select("qid", (F.col("pos") + 1).alias("topk_rank"), F.col("c.rank").alias("rank"), F.col("c.key").alias("key"))


@query("""select qid, case when qid % 7 = 0 then 'support_status_insufficient' when qid % 6 = 1 then 'answer_empty' when qid % 9 = 4 then 'answer_insufficient_text' when qid % 4 <> 0 and qid % 2 = 1 then 'supported_without_valid_citation' when qid % 3 > 0 and (qid % 5 = 0 or regexp_matches(lower(question), 'image|figure|chart|graph|visual|picture')) and qid % 8 < 5 then 'visual_evidence_missing' end as trigger from asking""", *ASKING_VIEWS)
def recovery_triggers(spark, sf_dir):
    qid = F.col("qid")
    status = F.when(qid % 7 == 0, " insufficient ").when(qid % 4 == 0, "").otherwise("supported")
    answer = F.when(qid % 6 == 1, F.lit(None)).when(qid % 9 == 4, "The total was  Not Provided here").otherwise("42")
    hint = F.when(qid % 5 == 0, "Chart").otherwise(F.lit(None))
    trigger = V.recovery_trigger(status, answer, qid % 2 == 0, F.col("question"), hint, F.when(qid % 8 < 5, 0).otherwise(1), qid % 3 > 0)
    return asking(spark, sf_dir).select("qid", trigger.alias("trigger"))


@query(rf"""select conv_id, case when n = 0 then answer else answer || chr(10) || chr(10) || 'Sources:' || chr(10) || lines end as said from (select conv_id, 'Conversation ' || conv_id as answer, count(*) filter (said <> '') as n,
string_agg('- ' || case when turn % 3 > 0 then 'Page ' || turn || ', ' else '' end || case when turn % 4 = 1 then 'evidence' else role end || ': ' || said, chr(10) order by turn) filter (said <> '') as lines from (select *, case when turn % 5 = 2 then '' else trim(left({FLAT.format('text')}, 60)) end as said from conversations) group by 1)""")
def rendered_sources(spark, sf_dir):
    turn = F.col("turn")
    cited = F.struct(turn, F.when(turn % 3 > 0, turn).alias("page"), F.when(turn % 4 == 1, F.lit(None)).otherwise(F.col("role")).alias("block_type"), F.when(turn % 5 == 2, " ").otherwise(T.preview(F.col("text"), 60)).alias("preview"))
    rows = X.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(cited)).alias("citations"))
    return rows.select("conv_id", V.rendered_sources(F.concat(F.lit(" Conversation "), F.col("conv_id").cast("string")), F.col("citations")).alias("said"))


PLACES = ("answer_on_gold_minus_one_page", "answer_on_gold_plus_one_page", "answer_elsewhere_in_document", "answer_not_found_in_document_text", "gold_page_without_retrievable_blocks", "other")


@query(f"""select conv_id, turn, case when turn % 6 < 2 then 'manual_compare_gold_and_adjacent_page_images' when turn % 6 = 2 then 'manual_check_gold_annotation_or_duplicate_answer' when turn % 6 = 3 then 'manual_check_ocr_text_or_answer_alias' when turn % 6 = 4 then 'manual_check_mineru_page_block_materialization' else 'manual_review_unclassified' end as review,
case when turn % 6 < 3 then case when conv_id % 2 = 0 and conv_id % 3 = 0 and role = 'user' then 'gold_page_alignment_review_not_retrieval_defect' when conv_id % 2 = 0 then 'context_or_citation_selection_review' else 'retrieval_or_duplicate_answer_review' end when turn % 6 = 3 then 'ocr_or_answer_alias_review' when turn % 6 = 4 then 'evidence_block_materialization_review' else 'manual_review_unclassified' end as part,
array_to_string([p for p in [turn, turn + 2] if p >= 1 and (conv_id % 4 = 0 or p <= 5)], ',') as pages from conversations""")
def review_queue(spark, sf_dir):
    key, turn = F.col("conv_id"), F.col("turn")
    bucket = F.get(F.array(*map(F.lit, PLACES)), (turn % 6).cast("int"))
    part = V.actionability(bucket, key % 2 == 0, key % 3 == 0, F.col("role") == "user")
    pages = V.adjacent_pages(turn + 1, F.when(key % 4 != 0, 5))
    return X.table(spark, sf_dir, "conversations").select("conv_id", "turn", V.review_bucket(bucket).alias("review"), part.alias("part"), F.array_join(F.transform(pages, lambda p: p.cast("string")), ",").alias("pages"))


@query("""select qid, block_id, boosted, place from (select *, row_number() over (partition by qid order by boosted desc, rank) as place from (
select qid, block_id, rank, round(score + (case when kind = 'text' then 0.10 else 0 end + case when qid % 2 = 0 and kind = 'table' then 0.45 else 0 end) * max(score) over (partition by qid), 6) as boosted from (
select *, case when rank % 3 = 0 then 'table' when rank % 3 = 1 then 'text' else 'image' end as kind from ranked where rank <= 50))) where place <= 5""", *Q.ALL)
def boosted_search(spark, sf_dir):
    hits = Q.searched(spark, sf_dir, 50)
    kind = F.when(F.col("rank") % 3 == 0, "table").when(F.col("rank") % 3 == 1, "text").otherwise("image")
    rows = hits.withColumns({"block_type": kind, "types": F.array(F.lit("text")), "hint": F.when(F.col("qid") % 2 == 0, "numeric").otherwise("text")})
    return V.boosted_top(rows, 5).select("qid", "block_id", "boosted", "place")


def span_boards(spark, sf_dir):
    """The blocks found for each question with their scores and windows: qid, board. Five lines of a document are a page."""
    page = F.concat_ws("_", "doc_id", F.floor((F.col("ord") - 1) / 5).cast("string"))
    hits = Q.searched(spark, sf_dir, 30).select("qid", "block_id", "rank")
    rows = X.blocks(spark, sf_dir).withColumn("page", page)
    pages = rows.join(Q.R.small(hits.select("block_id").distinct()), "block_id", "left_semi").select("page").distinct()
    near = V.windows_around(rows.join(Q.R.small(pages), "page", "left_semi"))
    known = hits.join(near, "block_id").join(Q.R.small(X.questions(spark, sf_dir).select("qid", "question")), "qid")
    score = F.round(E.block_score(F.col("question"), F.col("text"), F.col("rank"), D.answer_hint(F.col("question"))) - 0.15, 6)
    item = F.struct(score.alias("score"), "rank", "ord", "block_id", "page", "window")
    return known.groupBy("qid").agg(F.collect_list(item).alias("board"))


@query()
def span_selection(spark, sf_dir):
    """A greedy choice under budgets: no SQL, the tests hold it against plain Python."""
    chosen = span_boards(spark, sf_dir).select("qid", F.posexplode(V.select_spans(F.col("board"), 2, 6, 12, 400)).alias("pos", "span"))
    return chosen.select("qid", (F.col("pos") + 1).alias("place"), "span.page", "span.primary", F.array_join("span.block_ids", ",").alias("block_ids"))
