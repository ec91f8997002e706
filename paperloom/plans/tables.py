"""Queries of tables in text: the same cells from text, markdown and HTML, headers, and answers of calculation questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import tables as B
from . import fixtures as X
from .registry import query

#: For each customer a question about the years of its orders; {a} and {b} are the first and last one.
ASKED = (
    "What is the difference in total from {a} to {b}?", "What is the percentage change in total from {a} to {b}?", "What is the average orders from {a} to {b}?", "What is the sum of total from {a} to {b}?",
    "How much did the orders increase in {b} from {a}?", "What is the total of status Open as a percentage of status All?", "What is the difference in total between High and Low?",
)


def yearly(spark, sf_dir):
    """Orders of each customer and year in whole units: cust, year, n, total."""
    orders = X.table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.sum(F.floor("o_totalprice").cast("long")).alias("total"))


YEARLY = "yearly as (select o_custkey as cust, year(o_orderdate)::int as year, count(*) as n, sum(floor(o_totalprice)::bigint)::bigint as total from orders group by 1, 2)"
FIGURE = "regexp_replace(reverse(regexp_replace(reverse({}::varchar), '(\\d{{3}})', '\\1,', 'g')), '^,', '')"


def figure(value):
    return F.format_number(value, 0)


def customer_tables(spark, sf_dir):
    """cust, first and last (year), and three tables each as rows of text: by year, with the years as columns, and by status with its ends."""
    ordered = F.array_sort(F.collect_list(F.struct("year", "n", "total")))
    by_year = yearly(spark, sf_dir).groupBy("cust").agg(ordered.alias("y"), F.min("year").alias("a"), F.max("year").alias("b"))
    orders = X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.floor("o_totalprice").cast("long").alias("price"), F.col("o_orderstatus").alias("status"))
    status = orders.groupBy("cust").agg(F.sum(F.when(F.col("status") == "O", F.col("price")).otherwise(0)).alias("open"), F.sum("price").alias("whole"), F.max("price").alias("high"), F.min("price").alias("low"))
    return by_year.join(status, "cust")


CUSTOMERS = """customers as (select * from (select cust, list({'year': year, 'n': n, 'total': total} order by year) as y, min(year) as a, max(year) as b from yearly group by 1)
join (select o_custkey as cust, coalesce(sum(floor(o_totalprice)::bigint) filter (o_orderstatus = 'O'), 0)::bigint as open, sum(floor(o_totalprice)::bigint)::bigint as whole, max(floor(o_totalprice)::bigint) as high, min(floor(o_totalprice)::bigint) as low from orders group by 1) using (cust))"""


def texts(rows):
    """The table by year in three forms: text lines, markdown, HTML."""
    line = lambda y, *ends: F.concat(F.lit(ends[0]), F.concat_ws(ends[1], y["year"].cast("string"), y["n"].cast("string"), figure(y["total"])), F.lit(ends[2]))
    told = lambda *ends: F.transform("y", lambda y: line(y, *ends))
    head = lambda *ends: F.array(F.lit(ends[0] + ends[1].join(("Year", "Orders", "Total")) + ends[2]))
    text = F.concat_ws("\n", F.concat(head("", " ", ""), told("", "  ", " ")))
    markdown = F.concat_ws("\n", F.concat(head("| ", " | ", " |"), F.array(F.lit("|---|:--|---|")), told("| ", " | ", " |")))
    html = F.concat(F.lit("<table class='x'><thead>"), F.array_join(F.concat(head("<tr><th>", "</th><th>", "</th></tr>"), told("<tr><td>", "</td>\n<td><b>", "</b></td></tr>")), "\n"), F.lit("<tr><td> </td></tr></table>"))
    return rows.select("cust", F.inline(F.array(F.struct(F.lit("text").alias("form"), B.rows_from_text(text).alias("cells")), F.struct(F.lit("markdown").alias("form"), B.rows_from_markdown(markdown).alias("cells")), F.struct(F.lit("html").alias("form"), B.rows_from_html(html).alias("cells")))))


@query(f"""select cust, form, row_idx, col_idx, cell from (select cust, form, rows, unnest(range(len(rows))) as row_idx from (select cust, [['Year', 'Orders', 'Total']] || list_transform(y, lambda x: [x.year::varchar, x.n::varchar, {FIGURE.format('x.total')}]) as rows from customers), (values ('text'), ('markdown'), ('html')) f(form)),
lateral (select unnest(range(3)) as col_idx), lateral (select rows[row_idx + 1][col_idx + 1] as cell)""", YEARLY, CUSTOMERS)
def table_cells(spark, sf_dir):
    """The same cells, whatever form a table has."""
    rows = texts(customer_tables(spark, sf_dir)).select("cust", "form", F.posexplode("cells").alias("row_idx", "row"))
    return rows.select("cust", "form", F.col("row_idx").cast("long").alias("row_idx"), F.posexplode("row").alias("col_idx", "cell")).withColumn("col_idx", F.col("col_idx").cast("long"))


@query("""select cust, array_to_string(case cust % 4 when 0 then ['(in thousands)', 'Orders ' || a, 'Total ' || b] when 1 then ['Item', 'Orders', 'Total reported'] when 2 then ['', a::varchar, b::varchar] else [] end, '|') as header,
case cust % 4 when 3 then len(y) else len(y) end as body_rows from customers""", YEARLY, CUSTOMERS)
def table_headers(spark, sf_dir):
    """Headers of one, two and no rows, found by the scan: units over years, a head with a continued row, years alone, none."""
    kind, text = F.col("cust") % 4, lambda c: F.col(c).cast("string")
    empty = F.expr("cast(array() as array<array<string>>)")
    heads = (
        F.when(kind == 0, F.array(F.array(F.lit("(in thousands)"), F.lit("Orders"), F.lit("Total")), F.array(F.lit(""), text("a"), text("b"))))
        .when(kind == 1, F.array(F.array(F.lit("Item"), F.lit("Orders"), F.lit("Total reported"))))
        .when(kind == 2, F.array(F.array(F.lit(""), text("a"), text("b")))).otherwise(empty)
    )
    body = F.transform("y", lambda y: F.when(kind == 3, F.array(y["n"].cast("string"), figure(y["total"]), F.lit("7"))).otherwise(F.array(F.lit("row"), y["n"].cast("string"), figure(y["total"]))))
    cut = customer_tables(spark, sf_dir).select("cust", B.split_header(F.concat(heads, body)).alias("t"))
    return cut.select("cust", F.array_join("t.header", "|").alias("header"), F.size("t.body").cast("long").alias("body_rows"))


def asked_tables(spark, sf_dir):
    """qid, question and three tables: table_id, rows, caption."""
    known = customer_tables(spark, sf_dir)
    text, at = lambda c: F.col(c).cast("string"), lambda y, f: F.transform("y", lambda x: f(x))  # noqa: E731, ARG005
    template = F.get(F.array(*map(F.lit, ASKED)), (F.col("cust") % len(ASKED)).cast("int"))
    question = F.replace(F.replace(template, F.lit("{a}"), text("a")), F.lit("{b}"), text("b"))
    by_year = F.concat(F.array(F.array(F.lit("Year"), F.lit("Orders"), F.lit("Total"))), at("y", lambda x: F.array(x["year"].cast("string"), x["n"].cast("string"), figure(x["total"]))))
    head = F.array(F.concat(F.array(F.lit("")), at("y", lambda x: x["year"].cast("string"))))
    across = F.concat(head, F.array(F.concat(F.array(F.lit("Orders")), at("y", lambda x: x["n"].cast("string"))), F.concat(F.array(F.lit("Total")), at("y", lambda x: figure(x["total"])))))
    pair = lambda name, value: F.array(F.lit(name), figure(F.col(value)))
    ends = F.array(F.array(F.lit("Status"), F.lit("Total")), pair("Open", "open"), pair("All", "whole"), pair("High", "high"), pair("Low", "low"))
    made = F.array(*[F.struct(F.lit(i).alias("table_id"), rows.alias("rows"), (caption if isinstance(caption, Column) else F.lit(caption)).alias("caption")) for i, (rows, caption) in enumerate(((by_year, None), (across, F.when((F.col("cust") % 2 == 0) | (F.col("cust") % len(ASKED) == 2), "By columns")), (ends, "Total by status")))])
    return known.select(F.col("cust").alias("qid"), question.alias("question"), F.inline(made))


OPERATIONS = "case cust % 7 when 1 then 'percentage_change' when 2 then 'average' when 3 then 'sum' when 5 then 'percentage_of_total' else 'difference' end"
TRUTH = f"""truth as (select *, {OPERATIONS} as operation, case cust % 7 when 0 then (y[-1].total - y[1].total)::double when 1 then (y[-1].total - y[1].total) / abs(y[1].total) * 100 when 2 then (y[1].n + y[-1].n) / 2 when 3 then (y[1].total + y[-1].total)::double
  when 4 then (y[-1].n - y[1].n)::double when 5 then open / whole * 100 else (high - low)::double end as result from customers where a < b)"""


@query("""select cust as qid, operation, round(result, 6) as result, 'The ' || replace(operation, '_', ' ') || ' is ' || case when round(result, 6) = floor(round(result, 6)) then round(result, 6)::bigint::varchar else rtrim(rtrim(round(round(result, 6)::decimal(30, 6), 4)::varchar, '0'), '.') end || case when starts_with(operation, 'percentage') then '%' else '' end || '.' as text from truth""", YEARLY, CUSTOMERS, TRUTH)
def table_answers(spark, sf_dir):
    """A question about two years, a share or the ends: table, row and column are chosen by its words alone; SQL knows the orders."""
    best = B.best_tables(asked_tables(spark, sf_dir))
    years = customer_tables(spark, sf_dir).where("a < b").select(F.col("cust").alias("qid"))
    return B.answer_table(best).join(years, "qid", "left_semi").select("qid", "operation", "result", "text")
