"""Queries of documents, pages, extraction, routing and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..operators import retrieval as R
from . import fixtures as X
from .registry import query

NORM = r"trim(regexp_replace(lower({}), '[^a-z0-9\x{{4e00}}-\x{{9fff}}.%+-]+', ' ', 'g'))"
FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def docs(spark, sf_dir):
    return X.table(spark, sf_dir, "documents")


@query(f"select doc_id, {NORM.format('text')} as normalized, replace({NORM.format('text')}, ' ', '') as compacted from documents")
def normalize_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.normalize(F.col("text")).alias("normalized"), T.compact(F.col("text")).alias("compacted"))


@query(f"""select id, {NORM.format("translate(said, ',$', '')")} as answer from (select o_orderkey as id, 'Total: $' || floor(o_totalprice)::bigint || ', paid' as said from orders)""")
def answer_norm(spark, sf_dir):
    said = F.concat(F.lit("Total: $"), F.floor("o_totalprice").cast("string"), F.lit(", paid"))
    return X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.normalize_answer(said).alias("answer"))


@query("select doc_id, ((length(text) + 3) // 4)::bigint as tokens from documents")
def estimate_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


CUT = f"""flat as (select doc_id, {FLAT.format('text')} as t from documents), cut as (select doc_id, t, left(t, 120) as p, greatest(case when contains(left(t, 120), ' ') then 120 - strpos(reverse(left(t, 120)), ' ') else -1 end,
 case when contains(left(t, 120), ';') then 120 - strpos(reverse(left(t, 120)), ';') else -1 end, case when contains(left(t, 120), ',') then 120 - strpos(reverse(left(t, 120)), ',') else -1 end) as pos from flat)"""


@query("select doc_id, case when length(t) <= 120 then t else rtrim(case when pos >= 60 then left(p, pos::int) else p end, ' ,;:-') end as short, left(t, 160) as preview, case when length(t) <= 90 then t else rtrim(left(t, 87), ' ') || '...' end as dotted from cut", CUT)
def smart_truncate(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", T.smart_truncate(t, 120).alias("short"), T.preview(t).alias("preview"), T.truncate(T.collapse(t), 90).alias("dotted"))


@query(rf"select page_id, {FLAT.format('''regexp_replace(html, '<[^>]+>', ' ', 'g')''')} as plain, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped from pages")
def strip_html(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("plain"), T.escape_html(F.col("html")).alias("escaped"))


@query(f"""select qid, case when length(t) <= 300 then t else trim(substr(t, l + 1, r - l), ' ,;:-') end as part from (select qid, t, case when short and l0 > 0 and r0 = length(t) then greatest(0, length(t) - 300) else l0 end as l, case when short and l0 = 0 then least(300, length(t)) else r0 end as r from (
select *, greatest(s - side, 0) as l0, least(s + n + side, length(t)) as r0, least(s + n + side, length(t)) - greatest(s - side, 0) < 300 as short from (
select qid, t, strpos(lower(t), lower(a)) - 1 as s, length(a) as n, greatest((300 - length(a)) // 2, 0) as side from (select qid, {FLAT.format('d.text')} as t, left({FLAT.format('q.answer')}, 60) as a,
row_number() over (partition by qid order by doc_id) as k from questions q join documents d on contains({FLAT.format('d.text')}, left({FLAT.format('q.answer')}, 60))) where k = 1)))""", X.QUESTIONS)
def centered_window(spark, sf_dir):
    asked = X.questions(spark, sf_dir).select("qid", F.substring(T.collapse(F.col("answer")), 1, 60).alias("a"))
    held = R.holding(docs(spark, sf_dir).select("doc_id", T.collapse(F.col("text")).alias("t")), asked, "doc_id", "t", "qid", "a")
    first = D.latest(held.withColumn("neg", -F.col("doc_id")), "qid", "neg")
    return first.select("qid", T.centered_window(F.col("t"), F.col("a"), 300).alias("part"))


@query("select doc_id, page, printf('%d_p%03d_page', doc_id, page) as block_id, string_agg(text, chr(10) order by ord) as text, count(*) as children from page_lines group by 1, 2", X.PAGE_LINES)
def page_aggregate(spark, sf_dir):
    return D.page_aggregates(X.page_lines(spark, sf_dir)).select("doc_id", "page", "block_id", "text", F.size("child_ids").cast("long").alias("children"))


@query("select block_id, lag(block_id) over w as previous_id, lead(block_id) over w as next_id from page_lines window w as (partition by doc_id order by page, ord)", X.PAGE_LINES)
def neighbor_links(spark, sf_dir):
    return D.neighbours(X.page_lines(spark, sf_dir)).select("block_id", "previous_id", "next_id")


@query("""select doc_id, count(*) as blocks, count(distinct page) as pages, sum(gap)::bigint as gaps, sum(length(text))::bigint as chars, case when count(distinct block_id) < count(*) then 'failed' when sum(gap) > 0 then 'warnings' else 'passed' end as status
from (select *, (ord <> row_number() over (partition by doc_id, page order by ord))::int as gap from page_lines) group by 1""", X.PAGE_LINES)
def structure_quality(spark, sf_dir):
    return D.quality_report(X.page_lines(spark, sf_dir)).drop("ids")


@query("select sha256(text) as sha256, substr(sha256(text), 1, 16) as id, strlen(text) as size, min(doc_id) as first_doc, count(*) as copies from documents group by 1, 2, 3")
def document_registry(spark, sf_dir):
    return D.register(docs(spark, sf_dir)).withColumn("size", F.col("size").cast("long"))


@query("""select coalesce(n.doc_id, o.doc_id) as doc_id, coalesce(n.source, o.source) as source, case when n.doc_id is not null then n.n_chars else o.n_chars end as n_chars, coalesce(o.created, n.created) as created
from (select doc_id, source, n_chars, 1 as created from documents where doc_id % 2 = 0) o full join (select doc_id, source || '+' as source, n_chars + 1 as n_chars, 2 as created from documents where doc_id % 3 = 0) n using (doc_id)""")
def upsert_documents(spark, sf_dir):
    rows = docs(spark, sf_dir)
    old = rows.where("doc_id % 2 = 0").select("doc_id", "source", "n_chars", F.lit(1).alias("created"))
    new = rows.where("doc_id % 3 = 0").select("doc_id", F.concat("source", F.lit("+")).alias("source"), (F.col("n_chars") + 1).alias("n_chars"), F.lit(2).alias("created"))
    return D.upsert(old, new, "doc_id", kept=("created",))


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def latest_rows(spark, sf_dir):
    return D.latest(X.table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as step from events")
def trace_log(spark, sf_dir):
    from pyspark.sql import Window

    return X.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"))


SAID = "said as (select o_orderkey as id, 'Order of ' || strftime(o_orderdate, '%Y-%m-%d') || ', due 3/' || (o_orderkey % 28 + 1) || '/2001, sent March ' || (o_orderkey % 28 + 1) || ', ' || year(o_orderdate) || ' (' || year(o_orderdate) || ' / 07).' as text from orders)"
FOUND = "[]::varchar[]"
for _pattern in D.DATES:
    FOUND = f"list_concat({FOUND}, regexp_extract_all(text, '{_pattern}'))"


@query(f"select distinct id, unnest({FOUND}) as value from said", SAID)
def extract_dates(spark, sf_dir):
    day, year = (F.col("o_orderkey") % 28 + 1).cast("string"), F.year("o_orderdate").cast("string")
    text = F.concat(F.lit("Order of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", due 3/"), day, F.lit("/2001, sent March "), day, F.lit(", "), year, F.lit(" ("), year, F.lit(" / 07)."))
    return D.dates(X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text")), "id", "text")


LISTED = ", ".join(f"'{w}'" for w in D.INFORMATIVE)
SCORE = f"""scored as (select *, round(least(length(text) / 400.0, 1) + (case when length(trim(text)) between 4 and 100 and right(trim(text), 1) not in ('.', '。', '?', '？', '!', '！', ';', '；') then 0.3 else 0 end) + (case when page in (1, 2) then 0.1 else 0 end)
 + (case when len(list_filter([{LISTED}], lambda w: contains(lower(text), w))) > 0 then 0.1 else 0 end) - (case when len(list_filter([{', '.join(f"'{w}'" for w in D.BOILERPLATE)}], lambda w: contains(lower(text), w))) > 0 then 0.25 else 0 end), 6) as score from page_lines)"""


@query("""select block_id, score from (select *, row_number() over (partition by doc_id, page order by score desc, ord) as n, dense_rank() over (partition by doc_id order by page) as k from scored) where n <= 4 and k <= 8""", X.PAGE_LINES, SCORE)
def extractive_summary(spark, sf_dir):
    return D.summary_blocks(X.page_lines(spark, sf_dir)).select("block_id", "score")


PLAIN = r"lower(trim(regexp_replace(regexp_replace(question, '[?!.]+$', ''), '\s+', ' ', 'g')))"
ROUTED = " ".join("when regexp_matches(" + PLAIN + f", '{p}') then '{n}'" for n, p in D.ROUTES)


@query(f"select qid, case when {PLAIN} = '' then 'invalid' {ROUTED} when {PLAIN} in ({', '.join(f"'{a}'" for a in D.AMBIGUOUS)}) then 'ambiguous' else 'local_fact' end as route from (select * from intents union all select qid + 1000, question from questions)", X.INTENTS_SQL, X.QUESTIONS)
def rule_route(spark, sf_dir):
    asked = X.intents(spark).union(X.questions(spark, sf_dir).select(F.col("qid") + 1000, "question"))
    return asked.select(F.col("qid").cast("long").alias("qid"), D.route(F.col("question")).alias("route"))


TERMS = lambda terms: "len(list_filter([" + ", ".join(f"'{t}'" for t in terms) + "], lambda w: contains(lower(question), w))) > 0"


@query(f"""select qid, case when {TERMS(D.VISUAL_TERMS)} then 'image' when {TERMS(D.TABLE_TERMS)} then 'table' else 'text' end as first_type, case when {TERMS(('date', 'when', 'year', 'month', 'day'))} then 'date' when {TERMS(('heading', 'title', 'subject'))} then 'heading' when {TERMS(('source', 'cited', 'bottom', 'footer'))} then 'source'
 when {TERMS(('how many', 'amount', 'total', 'number'))} then 'numeric' when {TERMS(('name', 'company', 'organization', 'what is'))} then 'text' else 'unknown' end as hint from (select * from intents union all select qid + 1000, question from questions)""", X.INTENTS_SQL, X.QUESTIONS)
def question_hints(spark, sf_dir):
    asked = X.intents(spark).union(X.questions(spark, sf_dir).select(F.col("qid") + 1000, "question"))
    q = F.col("question")
    return asked.select(F.col("qid").cast("long").alias("qid"), D.evidence_types(q)[0].alias("first_type"), D.answer_hint(q).alias("hint"))


@query(r"""select distinct qid, lower(unnest(list_concat(list_concat(regexp_extract_all(question, '\b(?:19|20)\d{2}\b'), regexp_extract_all(question, '\b\d+(?:\.\d+)?%?\b')), regexp_extract_all(question, '[A-Za-z][A-Za-z0-9_-]+|[\x{4e00}-\x{9fff}]+')))) as keyword from (select * from intents union all select qid + 1000, question from questions)""", X.INTENTS_SQL, X.QUESTIONS)
def query_rewrite(spark, sf_dir):
    asked = X.intents(spark).union(X.questions(spark, sf_dir).select(F.col("qid") + 1000, "question"))
    return asked.select(F.col("qid").cast("long").alias("qid"), F.explode(D.keywords(F.col("question"))).alias("keyword"))


TABLES = """tables as (select status, '| year | orders | total |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || year || ' | ' || n || ' | ' || total || ' |', chr(10) order by year) as table_text from year_rows group by 1)"""


def tables(spark, sf_dir):
    return D.markdown(X.year_rows(spark, sf_dir), "status", "year", [F.col("year").cast("string"), F.col("n").cast("string"), F.col("total").cast("string")], ["year", "orders", "total"])


@query("select status, table_text from tables", X.YEAR_ROWS, TABLES)
def table_render(spark, sf_dir):
    return tables(spark, sf_dir)


@query("select status, (k - 1)::int as row_idx, c.col_idx, case c.col_idx when 0 then year::varchar when 1 then n::varchar else total::varchar end as cell from (select *, row_number() over (partition by status order by year) as k from year_rows), (values (0), (1), (2)) c(col_idx)", X.YEAR_ROWS)
def table_render_parse(spark, sf_dir):
    return D.parse_markdown(tables(spark, sf_dir), "status", "table_text")


@query("""select status, round(avg(total), 4) as average, sum(total)::bigint as sum, max(total) filter (year = 1996) - max(total) filter (year = 1995) as difference, round((max(total) filter (year = 1996) - max(total) filter (year = 1995)) * 100.0 / nullif(abs(max(total) filter (year = 1995)), 0), 4) as percent_change,
round(max(total) filter (year = 1995) * 100.0 / sum(total), 4) as percent_of_total from year_rows group by 1""", X.YEAR_ROWS)
def table_calculations(spark, sf_dir):
    return D.calculate(X.year_rows(spark, sf_dir), "status", F.col("year") == 1995, F.col("year") == 1996, "total")


@query("select status, year, total from (select *, row_number() over (partition by status order by total desc, year) as k from year_rows) where k = 1", X.YEAR_ROWS)
def table_row_lookup(spark, sf_dir):
    from pyspark.sql import Window

    best = F.row_number().over(Window.partitionBy("status").orderBy(F.desc("total"), "year"))
    return X.year_rows(spark, sf_dir).withColumn("n_", best).where("n_ = 1").select("status", "year", "total")
