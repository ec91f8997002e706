"""Queries of text readings, validity checks, coverage and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks as C
from ..operators import scoring as S
from . import fixtures as X
from .registry import query

NORM = r"trim(regexp_replace(lower({}), '[^a-z0-9\x{{4e00}}-\x{{9fff}}.%+-]+', ' ', 'g'))"
FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
ASKED = """asked as (select o_orderkey as id, case o_orderkey % 6 when 0 then 'Could you please tell how sales grew from ' || year(o_orderdate) || ' to 2001 in this document?' when 1 then 'change in 2000 from ' || year(o_orderdate) || ' on page ' || (o_orderkey % 9) || ' and p. 3' when 2 then 'Help me find FY ' || lpad((o_orderkey % 100)::varchar, 2, '0') || ' and fy07, then ' || year(o_orderdate) when 3 then 'tell me the total of page 12, Page 12 and page 0' when 4 then '第 ' || (o_orderkey % 7) || ' 页 from the file' else 'this pdf' end as said from orders)"""
CELLS = """cells as (select o_orderkey as id, case o_orderkey % 7 when 0 then '$ ' || printf('%.2f', o_totalprice) when 1 then '(' || printf('%.2f', o_totalprice) || ')' when 2 then ' ( $' || o_orderkey || ' )' when 3 then 'n/a' when 4 then '1,' || lpad((o_orderkey % 1000)::varchar, 3, '0') || ' %' when 5 then o_orderkey || ' units of 5' else '' end as said from orders)"""


def asked(spark, sf_dir):
    key, year = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    said = (
        F.when(key % 6 == 0, F.concat(F.lit("Could you please tell how sales grew from "), year, F.lit(" to 2001 in this document?")))
        .when(key % 6 == 1, F.concat(F.lit("change in 2000 from "), year, F.lit(" on page "), (key % 9).cast("string"), F.lit(" and p. 3")))
        .when(key % 6 == 2, F.concat(F.lit("Help me find FY "), F.lpad((key % 100).cast("string"), 2, "0"), F.lit(" and fy07, then "), year))
        .when(key % 6 == 3, "tell me the total of page 12, Page 12 and page 0")
        .when(key % 6 == 4, F.concat(F.lit("第 "), (key % 7).cast("string"), F.lit(" 页 from the file")))
        .otherwise("this pdf")
    )
    return X.table(spark, sf_dir, "orders").select(key.alias("id"), said.alias("said"))


def cells(spark, sf_dir):
    key, price = F.col("o_orderkey"), F.format_string("%.2f", "o_totalprice")
    said = (
        F.when(key % 7 == 0, F.concat(F.lit("$ "), price))
        .when(key % 7 == 1, F.concat(F.lit("("), price, F.lit(")")))
        .when(key % 7 == 2, F.concat(F.lit(" ( $"), key.cast("string"), F.lit(" )")))
        .when(key % 7 == 3, "n/a")
        .when(key % 7 == 4, F.concat(F.lit("1,"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(" %")))
        .when(key % 7 == 5, F.concat(key.cast("string"), F.lit(" units of 5")))
        .otherwise("")
    )
    return X.table(spark, sf_dir, "orders").select(key.alias("id"), said.alias("said"))


@query(rf"""select doc_id, {FLAT.format("regexp_replace(translate(lower(text), '$,', ''), '[^a-z0-9.%()/-]+', ' ', 'g')")} as diagnostic, {FLAT.format("regexp_replace(lower(text), '[^a-z0-9.%]+', ' ', 'g')")} as coverage from documents""")
def diagnostic_coverage_text(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", C.diagnostic_text(F.col("text")).alias("diagnostic"), C.coverage_text(F.col("text")).alias("coverage"))


RAW = r"regexp_extract(said, '\(?-?\$?\d[\d,]*(?:\.\d+)?%?\)?')"
BARE = r"regexp_replace(translate(said, '$,%()', ''), '\s+', '', 'g')"


@query(rf"""select id, case when regexp_matches(said, '\(\s*\$?\s*-?\d') and contains(said, ')') then -abs(cell) else cell end as cell, case when starts_with({RAW}, '(') and ends_with({RAW}, ')') then -first else first end as first
from (select id, said, case when regexp_matches({BARE}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') then try_cast({BARE} as double) end as cell, try_cast(translate({RAW}, '$,%()', '') as double) as first from cells)""", CELLS)
def cell_numbers(spark, sf_dir):
    return cells(spark, sf_dir).select("id", C.cell_number(F.col("said")).alias("cell"), C.diagnostic_number(F.col("said")).alias("first"))


@query(rf"""select qid, coalesce({FLAT.format('lower(gold)')} <> '' and contains(lower({FLAT.format('prediction')}), lower({FLAT.format('gold')})), false) as held, contains(' ' || {NORM.format("translate(prediction, ',$', '')")} || ' ', ' ' || {NORM.format("translate(left(gold, 20), ',$', '')")} || ' ') as words_held from predictions""", X.PREDICTIONS)
def contains_answer(spark, sf_dir):
    p, g = F.col("prediction"), F.col("gold")
    return X.predictions(spark, sf_dir).select("qid", C.holds_answer(p, g).alias("held"), T.contains_words(p, F.substring(g, 1, 20)).alias("words_held"))


ALL_YEARS = r"list_concat(regexp_extract_all(said, '\b(?:19|20)\d{2}\b'), [(case when y::int < 50 then '20' else '19' end) || y for y in regexp_extract_all(said, '(?i)\bFY\s*([0-9]{2})\b', 1)])"
DISTINCT = "array_to_string([y for y, i in {0} if list_position({0}, y) = i], ' ')"


@query(rf"""select id, {DISTINCT.format('ys')} as years, case when regexp_matches(said, '(?i)\bin\s+(19|20)\d{{2}}\s+from\s+(19|20)\d{{2}}\b') then regexp_extract(said, '(?i)\bin\s+((19|20)\d{{2}})\s+from\s+((19|20)\d{{2}})\b', 3) || ' ' || regexp_extract(said, '(?i)\bin\s+((19|20)\d{{2}})\s+from\s+((19|20)\d{{2}})\b', 1)
when regexp_matches(said, '(?i)\bfrom\s+(19|20)\d{{2}}\s+to\s+(19|20)\d{{2}}\b') then regexp_extract(said, '(?i)\bfrom\s+((19|20)\d{{2}})\s+to\s+((19|20)\d{{2}})\b', 1) || ' ' || regexp_extract(said, '(?i)\bfrom\s+((19|20)\d{{2}})\s+to\s+((19|20)\d{{2}})\b', 3) else {DISTINCT.format('ys')} end as ordered from (select *, {ALL_YEARS} as ys from asked)""", ASKED)
def question_years(spark, sf_dir):
    return asked(spark, sf_dir).select("id", F.array_join(C.years(F.col("said")), " ").alias("years"), F.array_join(C.calculation_years(F.col("said")), " ").alias("ordered"))


@query(rf"""select id, nullif({DISTINCT.format('ps')}, '') as pages from (select id, [p::int::varchar for p in list_concat(regexp_extract_all(said, '(?i)\b(?:page|p\.)\s*(\d+)\b', 1), regexp_extract_all(said, '第\s*(\d+)\s*页', 1)) if p::int > 0] as ps from asked)""", ASKED)
def question_pages(spark, sf_dir):
    return asked(spark, sf_dir).select("id", F.array_join(C.page_refs(F.col("said")), " ").alias("pages"))


BARED = "trim(said)"
for _pattern in C.POLITE:
    BARED = f"regexp_replace({BARED}, '{_pattern}', ' ', 'gi')"


@query(f"select id, coalesce(nullif(trim({FLAT.format(BARED)}, ' ?.'), ''), trim(said)) as rewrite from asked", ASKED)
def light_query_rewrite(spark, sf_dir):
    return asked(spark, sf_dir).select("id", C.light_rewrite(F.col("said")).alias("rewrite"))


@query("""select page_id, status, status in ('caption_only', 'resource_only') as needs_reading from (select page_id, case when page_id % 11 = 0 then 'vlm_summarized' when page_id % 5 = 0 then 'ocr_or_nearby_text' when contains(html, '<h1') and page_id % 3 = 0 then 'caption_only' when url is not null and page_id % 2 = 0 then 'resource_only' else 'empty' end as status from pages)""")
def visual_content_status(spark, sf_dir):
    key = F.col("page_id")
    status = C.visual_status(key % 11 == 0, key % 5 == 0, F.contains("html", F.lit("<h1")) & (key % 3 == 0), F.col("url").isNotNull() & (key % 2 == 0))
    return X.table(spark, sf_dir, "pages").select("page_id", status.alias("status")).withColumn("needs_reading", F.col("status").isin("caption_only", "resource_only"))


STOP = ", ".join(f"'{w}'" for w in C.SHORT_STOPWORDS)
SHORT = "coalesce(trim(text) <> '' and length(trim(text)) <= {1} and len(ws) <= {0} and len([w for w in ws if w not in (" + STOP + ")]) > 0, false)"


@query(rf"""select block_id, {SHORT.format(12, 90)} as short, {SHORT.format(14, 110)} and not regexp_matches(trim(text), '^-?\(?\$?\d[\d,]*(?:\.\d+)?%?\)?$') and plain not in ('page', 'table', 'figure') and (len(ws) >= 2 or regexp_matches(text, '\p{{L}}')) as heading from (select block_id, text, {NORM.format('text')} as plain, [w for w in string_split({NORM.format('text')}, ' ') if w <> ''] as ws from blocks)""", X.BLOCKS)
def short_text_heading(spark, sf_dir):
    return X.blocks(spark, sf_dir).select("block_id", C.valid_short_text(F.col("text")).alias("short"), C.valid_heading(F.col("text")).alias("heading"))


@query("""select conv_id, turn, case when role is not null and text is not null and turn % 4 <> 3 and turn % 5 <> 4 then 1.0 else 0.5 end::double as score, turn % 3 = 0 or conv_id % 4 = 1 as located from conversations""")
def format_location_check(spark, sf_dir):
    turn = F.col("turn")
    there = dict(zip(C.LEGACY_FIELDS, (F.col("text").isNotNull(), F.lit(True), F.col("role").isNotNull(), turn % 4 != 3), strict=True))
    located = C.location_check((turn % 3).cast("int"), F.concat(F.lit("b"), (F.col("conv_id") % 4).cast("string")), F.array(F.lit(0)), F.array(F.lit("b1")))
    return X.table(spark, sf_dir, "conversations").select("conv_id", "turn", C.format_score(there, turn % 5 != 4).alias("score"), located.alias("located"))


@query(f"""select qid, bool_or({NORM.format('prediction')} = {NORM.format('g')}) as em, bool_or({NORM.format('g')} <> '' and contains({NORM.format('prediction')}, {NORM.format('g')})) as hit from (select qid, prediction, unnest([gold, left(gold, 12), '']) as g from predictions) group by 1""", X.PREDICTIONS)
def best_over_golds(spark, sf_dir):
    rows = X.predictions(spark, sf_dir).select("qid", "prediction", F.explode(F.array("gold", F.substring("gold", 1, 12), F.lit(""))).alias("g"))
    return C.best_over_golds(rows, "qid", "prediction", "g").select("qid", "em", "hit")


@query("""select lang, min(case when r > floor((n - 1) * 0.5) then n_chars end) as p50, min(case when r > floor((n - 1) * 0.9) then n_chars end) as p90, min(case when r > floor((n - 1) * 0.99) then n_chars end) as p99 from (select lang, n_chars, row_number() over (partition by lang order by n_chars) as r, count(*) over (partition by lang) as n from documents) group by 1""")
def length_percentiles(spark, sf_dir):
    return C.length_percentile(X.table(spark, sf_dir, "documents"), "lang", "n_chars", (0.5, 0.9, 0.99))


@query("""select event_type, arg_min(value, event_id) as first, arg_max(value, event_id) as last, round(avg(value), 6) as mean, count(*) filter (value <> 0) as nonzero from events group by 1""")
def step_log_summary(spark, sf_dir):
    return C.first_last_mean(X.table(spark, sf_dir, "events"), "event_type", "event_id", "value")


@query("""select doc_id, round(least(coalesce(seen, 0) / pages, 1.0), 6) as coverage from (select conv_id as doc_id, count(*) as pages, count(distinct case when role = 'user' then turn end) as seen from conversations group by 1)""")
def page_coverage(spark, sf_dir):
    pages = X.messages(spark, sf_dir)
    return C.page_coverage(pages.where("role = 'user'"), pages.groupBy("doc_id").agg(F.count("*").alias("pages")), "doc_id", "page", "pages")


@query(f"""select qid, loc, round(case when qid % 5 = 0 then 0.25 * fmt + 0.75 * em else 0.2 * fmt + 0.6 * (case when loc = 1 then em else 0 end) + 0.2 * loc end, 6) as reward from (select qid, ({NORM.format('prediction')} = {NORM.format('gold')})::int::double as em, (qid % 3 = 0 or qid % 4 = 1)::int::double as loc, case when qid % 2 = 0 then 1.0 else 0.5 end as fmt from predictions)""", X.PREDICTIONS)
def grounded_rewards(spark, sf_dir):
    qid = F.col("qid")
    place = lambda page, block: F.struct(page.alias("page"), block.alias("block_id"), F.lit(None).cast("string").alias("table_id"))
    gold = place(F.lit(0), F.lit("b1"))
    loc = S.location_reward(place((qid % 3).cast("int"), F.concat(F.lit("b"), (qid % 4).cast("string"))), gold)
    em = T.exact_match(F.col("prediction"), F.col("gold")).cast("double")
    fmt = F.when(qid % 2 == 0, 1.0).otherwise(0.5)
    rows = X.predictions(spark, sf_dir).select("qid", loc.alias("loc"), em.alias("em"), fmt.alias("fmt"))
    f, e, at = F.col("fmt"), F.col("em"), F.col("loc")
    return rows.select("qid", "loc", F.round(F.when(qid % 5 == 0, S.grounded_reward(f, e, None)).otherwise(S.grounded_reward(f, e, at)), 6).alias("reward"))


@query("""select doc_id, source from (select *, row_number() over (partition by source order by n_chars, doc_id) as r from documents) where r <= 3 order by n_chars, doc_id limit 40""")
def cap_per_group(spark, sf_dir):
    return C.cap_per_group(X.table(spark, sf_dir, "documents"), "source", [F.col("n_chars"), F.col("doc_id")], 3, 40).select("doc_id", "source")


@query("select conv_id, turn, case when turn % 2 = 0 then conv_id || '-' || turn else sha256(text) end as key from conversations")
def record_keys(spark, sf_dir):
    id_ = F.when(F.col("turn") % 2 == 0, F.concat_ws("-", "conv_id", "turn")).otherwise("")
    return X.table(spark, sf_dir, "conversations").select("conv_id", "turn", C.record_key(id_, F.col("text")).alias("key"))


@query("""select role, count(*) as n from (select case when contains(p, 'smoke_eval') then 'smoke_fixture' when contains(p, 'globocan_africa_2022') or contains(p, 'scenario_qa') then 'globocan_scenario_acceptance' when contains(p, 'retrieved') then 'pre_retrieved_reader_data' when contains(p, 'mp_docvqa') then 'retrieval_benchmark' else 'candidate_benchmark' end as role
from (select lower(case doc_id % 6 when 0 then 'data/Smoke_Eval/' when 1 then 'data/scenario_qa/' when 2 then 'globocan_africa_2022/' when 3 then 'mp_docvqa/retrieved/' when 4 then 'x/MP_DocVQA/' else '' end || source) as p from documents)) group by 1""")
def benchmark_roles(spark, sf_dir):
    key = F.col("doc_id") % 6
    folder = F.when(key == 0, "data\\Smoke_Eval\\").when(key == 1, "data/scenario_qa/").when(key == 2, "globocan_africa_2022/").when(key == 3, "mp_docvqa/retrieved/").when(key == 4, "x/MP_DocVQA/").otherwise("")
    rows = X.table(spark, sf_dir, "documents").select(C.benchmark_role(F.concat(folder, "source")).alias("role"))
    return rows.groupBy("role").agg(F.count("*").alias("n"))


@query("""select conv_id, case when len(list_intersect(hits, gold)) > 0 then 'answer_on_gold_page' when len(list_intersect(hits, [g - 1 for g in gold if list_contains(pages, g - 1)])) > 0 then 'answer_on_gold_minus_one_page' when len(list_intersect(hits, [g + 1 for g in gold if list_contains(pages, g + 1)])) > 0 then 'answer_on_gold_plus_one_page' when len(hits) > 0 then 'answer_elsewhere_in_document' when len(readable) = 0 then 'gold_page_without_retrievable_blocks' else 'answer_not_found_in_document_text' end as bucket,
list_min(flatten([[abs(h - g) for g in gold] for h in hits])) as min_distance from (select conv_id, [conv_id % 4] as gold, list(turn) as pages, coalesce(list(turn) filter (length(text) % 5 = conv_id % 7), []) as hits, coalesce(list(turn) filter (turn = conv_id % 4 and role = 'user'), []) as readable from conversations group by 1)""")
def page_alignment(spark, sf_dir):
    key, turn = F.col("conv_id"), F.col("turn")
    listed = lambda keep: F.collect_list(F.when(keep, turn))
    rows = X.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("pages"), listed(F.length("text") % 5 == key % 7).alias("hits"), listed((turn == key % 4) & (F.col("role") == "user")).alias("readable"))
    return C.alignment(rows.withColumn("gold", F.array(key % 4)), "conv_id")


@query("""select conv_id, string_agg(block, ' ' order by pos) as blocks from (select conv_id, block, min(pos) as pos from (select conv_id, 'b' || (turn % 3) as block, turn as pos from conversations union all select distinct conv_id, 'b' || (conv_id % 4), 1000000 from conversations) group by 1, 2) group by 1""")
def merged_allowlist(spark, sf_dir):
    turns = F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.concat(F.lit("b"), (t % 3).cast("string")))
    rows = X.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("got"))
    preferred = F.array(F.concat(F.lit("b"), (F.col("conv_id") % 4).cast("string")))
    return rows.select("conv_id", F.array_join(C.merge_allowlist(F.col("got"), preferred), " ").alias("blocks"))


@query("""select doc_id, page, string_agg(text, ' / ' order by ord desc) as texts from page_lines group by 1, 2""", X.PAGE_LINES)
def child_blocks(spark, sf_dir):
    lines = X.page_lines(spark, sf_dir)
    parents = lines.groupBy("doc_id", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "block_id")), asc=False), lambda x: x["block_id"]).alias("ids"))
    return C.children(parents, "ids", lines, "block_id", "text").select("doc_id", "page", F.array_join("child_texts", " / ").alias("texts"))


@query(f"""select doc_id, case when length(text) <= 60 then text else rtrim(left(text, 57)) || '...' end as cut, left({FLAT.format('text')}, 160) as preview from documents""")
def truncate_preview(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text"), 60).alias("cut"), T.preview(F.col("text")).alias("preview"))
