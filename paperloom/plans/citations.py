"""Queries of the candidate contract, citations, captions and summaries of evaluated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations as C
from . import fixtures as X
from .registry import query

OUTPUTS = """outputs as (select item_id, case item_id % 6 when 0 then '{"answer": "a", "reasoning_summary": "' || left(text, 290 + (item_id % 5)::int * 5) || '", "citations": []}' when 1 then '{"answer": 5, "reasoning_summary": "r", "citation_block_ids": ["b"]}' when 2 then '{"answer": "a"}' when 3 then '{"answer": "a", "reasoning_summary": 7, "evidence_used": "x"}' when 4 then 'no json' else '{"reasoning_summary": "r", "citations": [1]}' end as out, text from (select item_id, repeat('word ', 80) as text from benchmark))"""


@query("""select item_id, case item_id % 6 when 0 then case when length(left(text, 290 + (item_id % 5)::int * 5)) > 300 then 'reasoning_summary exceeds 300 characters' end when 1 then 'answer must be a string' when 2 then 'missing fields: reasoning_summary, citation_block_ids' when 3 then 'reasoning_summary must be a string' when 4 then 'parsed output is not an object' else 'missing fields: answer' end as fault from outputs""", OUTPUTS)
def candidate_contract(spark, sf_dir):
    key = F.col("item_id")
    long = F.expr("left(repeat('word ', 80), cast(290 + (item_id % 5) * 5 as int))")
    out = (
        F.when(key % 6 == 0, F.concat(F.lit('{"answer": "a", "reasoning_summary": "'), long, F.lit('", "citations": []}')))
        .when(key % 6 == 1, '{"answer": 5, "reasoning_summary": "r", "citation_block_ids": ["b"]}')
        .when(key % 6 == 2, '{"answer": "a"}')
        .when(key % 6 == 3, '{"answer": "a", "reasoning_summary": 7, "evidence_used": "x"}')
        .when(key % 6 == 4, "no json")
        .otherwise('{"reasoning_summary": "r", "citations": [1]}')
    )
    return X.table(spark, sf_dir, "benchmark").select("item_id", C.candidate_fault(out).alias("fault"))


@query("""select conv_id, turn, case when turn % 4 = 0 then turn when turn % 4 = 1 and turn % 3 <> 0 then turn + 10 when turn % 5 = 2 then turn + 20 end as page, case when turn % 4 = 0 then 'L' when turn % 4 = 1 and turn % 3 <> 0 then 'C' when turn % 5 = 2 then 'U' when conv_id % 3 = 0 then 'x' || conv_id end as block_id from conversations""")
def primary_locations(spark, sf_dir):
    turn = F.col("turn").cast("int")
    place = lambda page, block: F.struct(page.cast("int").alias("page"), F.lit(block).alias("block_id"))
    blank = F.struct(F.lit(None).cast("int").alias("page"), F.lit("").alias("block_id"))
    location = F.when(turn % 4 == 0, place(turn, "L"))
    cited = F.when((turn % 4 == 1) & (turn % 3 != 0), F.array(blank, place(turn + 10, "C"))).otherwise(F.array(blank))
    used = F.when(turn % 5 == 2, F.array(place(turn + 20, "U"))).otherwise(F.array(blank))
    ids = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit(" "), F.concat(F.lit("x"), F.col("conv_id").cast("string")))).otherwise(F.array(F.lit("")))
    rows = X.table(spark, sf_dir, "conversations").select("conv_id", "turn", C.primary_location(location, cited, used, ids).alias("l"))
    return rows.select("conv_id", "turn", F.col("l.page").cast("long").alias("page"), "l.block_id")


KINDS = """kinds as (select doc_id, page, ord, row_number() over (partition by doc_id order by page, ord) as pos, block_id, case ord % 4 when 0 then 'table' when 2 then 'image' else 'text' end as block_type, case when ord % 3 = 0 then 'Figure ' || ord || ': ' || text else text end as text, case when ord % 10 = 4 then 'own' end as caption from page_lines)"""


def kinds(spark, sf_dir):
    ord_ = F.col("ord")
    kind = F.when(ord_ % 4 == 0, "table").when(ord_ % 4 == 2, "image").otherwise("text")
    text = F.when(ord_ % 3 == 0, F.concat(F.lit("Figure "), ord_.cast("string"), F.lit(": "), F.col("text"))).otherwise(F.col("text"))
    return X.page_lines(spark, sf_dir).select("doc_id", "page", F.struct("page", "ord").alias("pos"), "block_id", kind.alias("block_type"), text.alias("text"), F.when(ord_ % 10 == 4, "own").alias("caption"))


@query(r"""select block_id, case when block_type <> 'text' and caption is null then case when bt = 'text' and bp = page and regexp_matches(bx, '(?i)^\s*(fig(?:ure)?\.?|table|chart|图|表)') then trim(bx) when lt = 'text' and lp = page and regexp_matches(lx, '(?i)^\s*(fig(?:ure)?\.?|table|chart|图|表)') then trim(lx) end else caption end as caption,
case when block_type <> 'text' and caption is null then case when bt = 'text' and bp = page and regexp_matches(bx, '(?i)^\s*(fig(?:ure)?\.?|table|chart|图|表)') then bi when lt = 'text' and lp = page and regexp_matches(lx, '(?i)^\s*(fig(?:ure)?\.?|table|chart|图|表)') then li end end as caption_block_id
from (select *, lag(text) over w as bx, lag(block_type) over w as bt, lag(page) over w as bp, lag(block_id) over w as bi, lead(text) over w as lx, lead(block_type) over w as lt, lead(page) over w as lp, lead(block_id) over w as li from kinds window w as (partition by doc_id order by pos))""", X.PAGE_LINES, KINDS)
def neighbour_captions(spark, sf_dir):
    return C.attach_captions(kinds(spark, sf_dir), "doc_id", "pos").select("block_id", "caption", "caption_block_id")


@query(r"""select doc_id, coalesce(case when ord % 2 = 0 then page end, page + 100) as page, block_id, block_type, nullif(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 220), '') as text_preview, caption from kinds""", X.PAGE_LINES, KINDS)
def block_citations(spark, sf_dir):
    rows = kinds(spark, sf_dir).withColumns({"page_id": F.col("page") + 100, "page": F.when(F.col("pos.ord") % 2 == 0, F.col("page"))})
    return C.citation(rows)


EVAL = """evals as (select doc_id, lang, quality = 1 as schema_ok, toxic = 0 as location_ok, n_chars % 3 = 0 as answer_em from documents left join labels using (doc_id))"""


def evals(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").join(X.table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select("doc_id", "lang", (F.col("quality") == 1).alias("schema_ok"), (F.col("toxic") == 0).alias("location_ok"), (F.col("n_chars") % 3 == 0).alias("answer_em"))


@query("""select lang, metric, ok, count(*) as n from (select lang, 'schema_ok' as metric, coalesce(schema_ok, false) as ok from evals union all select lang, 'location_ok', coalesce(location_ok, false) from evals union all select lang, 'answer_em', coalesce(answer_em, false) from evals) group by 1, 2, 3""", EVAL)
def metric_breakdown(spark, sf_dir):
    return C.breakdown(evals(spark, sf_dir), "lang", ["schema_ok", "location_ok", "answer_em"])


@query("""select count(doc_id) as num_samples, round(avg(schema_ok::int::double), 6) as schema_ok, round(avg(answer_em::int::double), 6) as answer_em from evals""", EVAL)
def merged_shards(spark, sf_dir):
    rows = evals(spark, sf_dir)
    shards = [rows.where(F.pmod("doc_id", F.lit(3)) == k) for k in range(3)]  # three shards that hold all rows
    return C.merge_shards(shards, "doc_id", ["schema_ok", "answer_em"])


@query("""select *, bool_and(case when event_type = 'purchase' then least >= 1 else most <= 1000 end) over () as passed from (select event_type, count(*) as n, round(avg(value), 6) as mean, min(value) as least, max(value) as most from events group by 1)""")
def reward_calibration(spark, sf_dir):
    return C.calibration(X.table(spark, sf_dir, "events"), "event_type", "value", "purchase", 1000.0, 1.0)


@query("""select conv_id, target, greatest(coalesce(max(case when target = 'unknown' or role = target then n end), 0) - 1, 0) as distractors from (select conv_id, case conv_id % 3 when 0 then 'unknown' when 1 then 'user' else 'nobody' end as target, role, count(*) as n from conversations group by 1, 2, 3) group by 1, 2""")
def board_distractors(spark, sf_dir):
    key = F.col("conv_id") % 3
    rows = X.table(spark, sf_dir, "conversations").withColumn("target", F.when(key == 0, "unknown").when(key == 1, "user").otherwise("nobody"))
    return C.distractors(rows, "conv_id", "role", "target")
