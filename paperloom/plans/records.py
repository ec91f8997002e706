"""Queries of records, alignment and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from ..operators import training as D
from . import fixtures as X
from .registry import query

OUT = """outputs as (select item_id, '<think>plan {x}</think> Result: ' || '{"answer": "item ' || item_id || '", "support_status": "' || (case when item_id % 2 = 0 then 'supported' else 'insufficient' end) || '", "supporting_refs": ["E' || (item_id % 3) || '"]} done' as text from benchmark)"""


@query("select item_id, 'item ' || item_id as answer, case when item_id % 2 = 0 then 'supported' else 'insufficient' end as support_status, 'E' || (item_id % 3) as ref from benchmark")
def json_recovery(spark, sf_dir):
    key = F.col("item_id")
    text = F.concat(F.lit('<think>plan {x}</think> Result: {"answer": "item '), key.cast("string"), F.lit('", "support_status": "'), F.when(key % 2 == 0, "supported").otherwise("insufficient"), F.lit('", "supporting_refs": ["E'), (key % 3).cast("string"), F.lit('"]} done'))
    rows = X.table(spark, sf_dir, "benchmark").select("item_id", R.recover_json(text).alias("o"))
    return rows.select("item_id", "o.answer", "o.support_status", F.col("o.supporting_refs")[0].alias("ref"))


SHAPES = """shapes as (select item_id, text, item_id % 8 as shape, text || ' "quoted" {brace} \\ end' as said from benchmark)"""


@query("""select item_id, case when shape = 7 then 'none' when shape in (0, 6) then 'whole' when shape in (4, 5) then 'fields' else 'object' end as how, case when shape in (4, 6) or shape < 4 then said when shape = 5 then 'short' end as answer,
case when shape in (0, 1, 2, 3) then 'supported' when shape = 5 then 'insufficient' end as support_status, case when shape in (0, 1, 2, 3) then 'E' || item_id % 3 end as ref from shapes""", SHAPES)
def json_recovery_shapes(spark, sf_dir):
    """Outputs of eight shapes over the benchmark's texts: whole; after thoughts; after prose with a brace and an odd quote; the second of two objects; cut off in a
    later field; cut off after a nested object; whole with other fields; none."""
    key, said = F.col("item_id"), F.concat(F.col("text"), F.lit(' "quoted" {brace} \\ end'))
    full = F.to_json(F.struct(said.alias("answer"), F.lit("supported").alias("support_status"), F.array(F.concat(F.lit("E"), (key % 3).cast("string"))).alias("supporting_refs")))
    alone = F.to_json(F.struct(said.alias("answer")))
    shapes = (
        full, F.concat(F.lit('<think>{"answer": "no"} plan {x}</think>\n'), full, F.lit(" done }")), F.concat(F.lit('He said "set {x} of the '), full, F.lit(" and more")), F.concat(F.lit('{"note": {"a": 1}} then '), full, F.lit(' {"answer": "late"}')),
        F.concat(F.substr(alone, F.lit(1), F.length(alone) - 1), F.lit(', "supporting_refs": ["E1", "E')), F.lit('{"answer": "short", "evidence_location": {"page": 1}, "support_status": "insufficient", "reasoning_summary": "cut'),
        F.concat(F.substr(alone, F.lit(1), F.length(alone) - 1), F.lit(', "extra": [1, {"b": null}]}')), F.concat(F.lit("no object here: {"), F.col("text")),
    )
    rows = X.table(spark, sf_dir, "benchmark").withColumn("output", F.get(F.array(*shapes), (key % len(shapes)).cast("int")))
    read = rows.select("item_id", R.recovered(F.col("output")).alias("r")).select("item_id", "r.how", F.from_json("r.json", R.OUTPUT).alias("o"))
    return read.select("item_id", "how", "o.answer", "o.support_status", F.get("o.supporting_refs", F.lit(0)).alias("ref"))


@query("select event_id, contains(props, '\"gold') or regexp_matches(props, '\"(answer_key|label)\"') as leaks from events")
def gold_leakage(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_id", R.leaks_gold(F.col("props")).alias("leaks"))


@query("select source, n, marked from (select source || case when right(source, 1) in ('1', '3') then '/dev/x' else '/train' end as source, right(source, 1) in ('1', '3') as marked, count(*) as n from documents group by 1, 2)")
def validation_markers(spark, sf_dir):
    path = F.concat("source", F.when(F.substring("source", -1, 1).isin("1", "3"), "/dev/x").otherwise("/train"))
    return X.table(spark, sf_dir, "documents").groupBy(path.alias("source")).agg(F.count("*").alias("n")).withColumn("marked", R.held_out_path(F.col("source")))


@query("select conv_id, sha256(string_agg(sha256(text), chr(10) order by turn)) as signature from conversations group by 1")
def signature_audit(spark, sf_dir):
    return R.signature(X.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("""select doc_id, page, coalesce((select min_by(s, abs(s) * 10 + s) from (values (-2), (-1), (0), (1), (2)) t(s) where exists (select 1 from conversations c where c.conv_id = g.doc_id and c.turn + 1 = g.page + s and c.role = 'assistant')), 99) as shift from (select distinct conv_id as doc_id, turn + 1 as page from conversations where role = 'user') g""")
def page_shift_align(spark, sf_dir):
    pages = X.messages(spark, sf_dir)
    gold = pages.where("role = 'user'").select("doc_id", "page").distinct()
    return R.shift_alignment(gold, pages.where("role = 'assistant'")).fillna(99, ["shift"])  # 99: none within reach


@query("select user_id, event_id, coalesce(last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding), -1) as context from events")
def section_context(spark, sf_dir):
    rows = X.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return R.carry_forward(rows, "user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id"))).select("user_id", "event_id", F.coalesce("context", F.lit(-1)).alias("context"))


@query("select doc_id, lang, turn from (select doc_id, lang, row_number() over (partition by lang order by sha256('final' || chr(0) || doc_id::varchar), doc_id) as turn from documents) order by turn, lang limit 80")
def balanced_buckets(spark, sf_dir):
    rows = X.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return R.balanced(rows, "lang", D.stable_key(F.col("doc_id"), "final"), "doc_id", 80).select("doc_id", "lang", "turn")


@query("select status, (k - 1)::int as row_idx, c.col_idx, case c.col_idx when 0 then year::varchar else total::varchar end as cell from (select *, row_number() over (partition by status order by year) as k from year_rows), (values (0), (1)) c(col_idx)", X.YEAR_ROWS)
def html_table_parse(spark, sf_dir):
    line = F.concat(F.lit("<tr><td>"), F.col("year").cast("string"), F.lit("</td><td><b>"), F.col("total").cast("string"), F.lit("</b></td></tr>"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("year", line.alias("line")))), lambda r: r["line"])
    tables = X.year_rows(spark, sf_dir).groupBy("status").agg(F.concat(F.lit("<table>"), F.array_join(body, ""), F.lit("<tr><td> </td></tr></table>")).alias("html"))
    return R.html_cells(tables, "status", "html")


@query("select user_id, min_by(value, event_id) as first_value, max_by(value, event_id) as last_value, round(avg(value), 6) as mean, count(*) filter (value <> 0) as nonzero from events group by 1")
def run_log_summary(spark, sf_dir):
    return X.table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("value", "event_id").alias("first_value"), F.max_by("value", "event_id").alias("last_value"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") != 0).alias("nonzero"))


@query("select sha256(to_json({'doc': l_orderkey, 'page': l_linenumber})::varchar) as id, count(*) as n from lineitem group by 1")
def window_identity(spark, sf_dir):
    rows = X.table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.sha2(F.to_json(F.struct(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"))), 256).alias("id")).agg(F.count("*").alias("n"))


@query("select n_lines, count(*) as n, count(distinct o_custkey) as customers from (select l_orderkey, count(*) as n_lines from lineitem group by 1) join orders on l_orderkey = o_orderkey group by 1")
def windows_per_doc(spark, sf_dir):
    per = X.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    return per.join(X.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_lines").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("""select doc_id, array_to_string(list_distinct_sorted, ',') as ids from (select doc_id, list_sort(list_distinct(['b' || (doc_id % 7), 'b' || (doc_id % 3), 'b' || (doc_id % 5)])) as list_distinct_sorted from documents)""")
def citation_id_union(spark, sf_dir):
    mark = lambda m: F.array(F.concat(F.lit("b"), (F.col("doc_id") % m).cast("string")), F.lit(" "))
    out = F.struct(mark(7).alias("citation_block_ids"), mark(3).alias("citations"), mark(5).alias("evidence_used"))
    return X.table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(R.citation_ids(out)), ",").alias("ids"))


@query("""select doc_id, case when doc_id % 3 = 0 then '' else source end as answer, case when doc_id % 2 = 0 then left(text, 40) else 'kept' end as evidence, case when doc_id % 9 in (1, 2) then (doc_id % 9)::int else 1 end as page from documents""")
def repair_answers(spark, sf_dir):
    key = F.col("doc_id")
    fixed = R.repair(F.when(key % 3 != 0, F.col("source")), F.when(key % 2 != 0, F.lit("kept")), (key % 9).cast("int"), F.substring("text", 1, 40), F.lit(1), F.array(F.lit(1), F.lit(2)))
    return X.table(spark, sf_dir, "documents").select("doc_id", fixed.alias("f")).select("doc_id", "f.answer", "f.evidence", "f.page")
