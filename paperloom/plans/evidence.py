"""Queries of evidence packing and candidate answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import arithmetic as A
from ..operators import documents as D
from ..operators import evidence as E
from ..operators import retrieval as R
from . import fixtures as X
from . import retrieval as Q
from .registry import query

STOP = ", ".join(f"'{w}'" for w in R.STOPWORDS)
TOP = "best as (select r.qid, question, r.block_id, r.rank, b.text, b.doc_id, b.ord from ranked r join blocks b using (block_id) join questions using (qid) where r.rank <= 10)"
BEST = (*Q.ALL, TOP)


def best(spark, sf_dir, k=10):
    found = Q.searched(spark, sf_dir, k).select("qid", "block_id", "rank")
    asked = R.small(X.questions(spark, sf_dir).select("qid", "question"))
    return R.small(found).join(X.blocks(spark, sf_dir), "block_id").join(asked, "qid")


KEYS = f"list_filter(list_distinct({Q.TOK.format('question')}), lambda t: length(t) > 1 and t not in ({STOP}))"
HINTED = lambda terms: "len(list_filter([" + ", ".join(f"'{t}'" for t in terms) + "], lambda w: contains(lower(question), w))) > 0"


@query(f"""select qid, block_id, round(0.4 * least(len(list_filter({KEYS}, lambda k: contains(lower(text), k)))::double / greatest(len({KEYS}), 1), 1) + (case when regexp_matches(text, '[0-9]') and ({HINTED(('date', 'when', 'year', 'month', 'day'))} or (not {HINTED(('heading', 'title', 'subject', 'source', 'cited', 'bottom', 'footer'))} and {HINTED(('how many', 'amount', 'total', 'number'))})) then 0.12 else 0 end) + greatest(0, 0.18 - 0.03 * (rank - 1)) + 0.06, 6) as score from best""", *BEST)
def block_scores(spark, sf_dir):
    q = F.col("question")
    return best(spark, sf_dir).select("qid", "block_id", F.round(E.block_score(q, F.col("text"), F.col("rank"), D.answer_hint(q)), 6).alias("score"))


SAID = "said as (select o_orderkey as id, 'Paid $' || printf('%.2f', o_totalprice) || ' (' || (o_orderkey % 90) || '), ' || (o_orderkey % 40) || '% off on ' || strftime(o_orderdate, '%Y-%m-%d') as text from orders)"


@query(f"""select distinct id, kind, value from ({' union all '.join(f"select id, '{k}' as kind, unnest(regexp_extract_all(text, '{p}')) as value from said" for k, p in E.CANDIDATES)})""", SAID)
def regex_candidates(spark, sf_dir):
    key = F.col("o_orderkey")
    said = F.concat(F.lit("Paid $"), F.format_string("%.2f", "o_totalprice"), F.lit(" ("), (key % 90).cast("string"), F.lit("), "), (key % 40).cast("string"), F.lit("% off on "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return E.candidates(X.table(spark, sf_dir, "orders").select(key.alias("id"), said.alias("text")), "id", "text")


@query("""select user_id, event_id, final, row_number() over (partition by user_id order by final desc, event_id) as rank from (select *, round(value / 100 - case when nth = 0 then 0 else least(0.08 + 0.07 * nth, 0.35) end, 6) as final from (
select *, row_number() over (partition by user_id, event_type order by value / 100 desc, event_id) - 1 as nth from events))""")
def candidate_rank_dup_penalty(spark, sf_dir):
    rows = X.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("value") / 100).alias("score"))
    return E.penalise_duplicates(rows, "user_id", "event_type", "score", "event_id").select("user_id", "event_id", "final", "rank")


@query("""select count(*) as n, round(avg((first is not null)::int), 6) as any_rank, round(avg((coalesce(first, 99) <= 1)::int), 6) as top1, round(avg((coalesce(first, 99) <= 3)::int), 6) as top3, round(avg((coalesce(first, 99) <= 10)::int), 6) as top10 from (
select qid, min(rank) filter (block_id in (select block_id from gold g where g.qid = r.qid)) as first from questions left join (select * from ranked where rank <= 20) r using (qid) group by qid)""", *Q.ALL, Q.GOLD)
def candidate_coverage(spark, sf_dir):
    first = Q.searched(spark, sf_dir, 20).join(Q.gold_blocks(spark, sf_dir), ["qid", "block_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("first"))
    rows = X.questions(spark, sf_dir).select("qid").join(first, "qid", "left")
    share = lambda k: F.round(F.avg((F.coalesce("first", F.lit(99)) <= k).cast("double")), 6)
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.col("first").isNotNull().cast("double")), 6).alias("any_rank"), share(1).alias("top1"), share(3).alias("top3"), share(10).alias("top10"))


NORM = r"trim(regexp_replace(lower({}), '[^a-z0-9\x{{4e00}}-\x{{9fff}}.%+-]+', ' ', 'g'))"


@query(f"""select qid, case when not covered then 'G_unavailable' when first is null then 'A_retrieval_miss' when {NORM.format('prediction')} = {NORM.format('gold')} then 'F_right' else 'E_wrong' end as bucket from predictions join (
select qid, qid in (select qid from gold) as covered, min(rank) filter (block_id in (select block_id from gold g where g.qid = r.qid)) as first from questions left join (select * from ranked where rank <= 5) r using (qid) group by qid) using (qid)""", *Q.ALL, Q.GOLD, X.PREDICTIONS)
def answer_buckets(spark, sf_dir):
    gold = Q.gold_blocks(spark, sf_dir)
    first = Q.searched(spark, sf_dir, 5).join(gold, ["qid", "block_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("first"))
    rows = X.predictions(spark, sf_dir).join(gold.select("qid", F.lit(True).alias("covered")).distinct(), "qid", "left").join(first, "qid", "left")
    right = T.exact_match(F.col("prediction"), F.col("gold"))
    return rows.select("qid", F.when(F.col("covered").isNull(), "G_unavailable").when(F.col("first").isNull(), "A_retrieval_miss").when(right, "F_right").otherwise("E_wrong").alias("bucket"))


VALUE = r"[:：]\s*([A-Za-z0-9$.,% -]+)"


@query(rf"""select qid, case when trim(found) <> '' then trim(found) else left(split_part(text, chr(10), 1), 120) end as answer from (select qid, text, case when contains(low, 'date') then regexp_extract(text, '(?i)(?:invoice\s+date|date){VALUE}', 1)
when contains(low, 'revenue') or contains(low, 'total') or contains(low, 'amount') then regexp_extract(text, '(?i)(?:revenue|total|amount){VALUE}', 1) else regexp_extract(text, '(?i)(?:answer|date|revenue|invoice(?: no)?|total){VALUE}', 1) end as found from (select *, lower(question) as low from best where rank = 1))""", *BEST)
def heuristic_answer(spark, sf_dir):
    return best(spark, sf_dir, 1).select("qid", E.heuristic_answer(F.col("question"), F.col("text")).alias("answer"))


@query(rf"""select client_id, candidate, case when trim(found) <> '' then trim(found) else left(split_part(text, chr(10), 1), 120) end as answer from (select client_id, candidate, text, case when client_id % 4 = 0 then regexp_extract(text, '(?i)(?:invoice\s+date|date){VALUE}', 1) when client_id % 4 = 1 then regexp_extract(text, '(?i)(?:revenue|total|amount){VALUE}', 1)
else regexp_extract(text, '(?i)(?:answer|date|revenue|invoice(?: no)?|total){VALUE}', 1) end as found from (select client_id, sale_id as candidate, 'Sale ' || sale_id || chr(10) || case sale_id % 3 when 0 then 'Invoice  Date: ' || strftime(sold_at, '%Y-%m-%d') || chr(10) || 'Amount: $' || printf('%.2f', total) when 1 then 'Total: ' || printf('%.2f', total) || ';' else 'Answer: ' || status || chr(10) || 'Revenue: none' end as text from sales where client_id is not null and sale_id is not null and sold_at is not null and total is not null and not isnan(total) and status is not null))""")
def labelled_answers(spark, sf_dir):
    """Answers after the label that the question asks for, on the texts of all whole sales: each of its branches."""
    sales = X.table(spark, sf_dir, "sales").where("client_id is not null and sale_id is not null and sold_at is not null and total is not null and not isnan(total) and status is not null")
    asked = F.get(F.array(*map(F.lit, ("On what date was it?", "What is the total?", "Who was it?", "What was it?"))), (F.col("client_id") % 4).cast("int"))
    price, n = F.format_string("%.2f", "total"), F.col("sale_id")
    lines = F.when(n % 3 == 0, F.concat(F.lit("Invoice  Date: "), F.date_format("sold_at", "yyyy-MM-dd"), F.lit("\nAmount: $"), price)).when(n % 3 == 1, F.concat(F.lit("Total: "), price, F.lit(";"))).otherwise(F.concat(F.lit("Answer: "), F.col("status"), F.lit("\nRevenue: none")))
    text = F.concat(F.lit("Sale "), n.cast("string"), F.lit("\n"), lines)
    return sales.select("client_id", F.col("sale_id").alias("candidate"), E.heuristic_answer(asked, text).alias("answer"))


FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
SHOWN = f"""shown as (select qid, block_id, rank, case when length(t) <= 300 then t else rtrim(case when pos >= 150 then left(t, pos::int) else left(t, 300) end, ' ,;:-') end as shown from (
select *, greatest(case when contains(left(t, 300), ' ') then 300 - strpos(reverse(left(t, 300)), ' ') else -1 end, case when contains(left(t, 300), ';') then 300 - strpos(reverse(left(t, 300)), ';') else -1 end, case when contains(left(t, 300), ',') then 300 - strpos(reverse(left(t, 300)), ',') else -1 end) as pos from (select *, {FLAT} as t from best)))"""


@query("select qid, block_id, shown, used from (select *, sum(length(shown)) over (partition by qid order by rank)::bigint as used from shown) where used <= 1500", *BEST, SHOWN)
def evidence_context(spark, sf_dir):
    return E.context(best(spark, sf_dir), 300, 1500).select("qid", "block_id", "shown", "used")


@query("select qid, start, string_agg(block_id, ',' order by rank) as block_ids from ranked, (values (0), (2), (4)) w(start) where rank <= 8 and rank > start and rank <= start + 4 group by 1, 2", *Q.ALL)
def recovery_windows(spark, sf_dir):
    return E.recovery_windows(Q.searched(spark, sf_dir, 8), 4)


@query("select t.qid, b.block_id from (select qid, doc_id, ord from best where rank = 1) t join blocks b on b.doc_id = t.doc_id and b.ord between t.ord - 1 and t.ord + 1", *BEST)
def neighbor_window(spark, sf_dir):
    return E.neighbour_window(best(spark, sf_dir, 1), X.blocks(spark, sf_dir), 1).select("qid", "block_id")


@query("""select qid, ref, block_id, b.block_id is not null as valid from (select qid, 'E' || rank as ref, block_id from ranked where rank <= 3 union all select qid, 'E9', 'none' from questions) c left join (select block_id from blocks) b using (block_id)""", *Q.ALL)
def citations_validate(spark, sf_dir):
    cited = Q.searched(spark, sf_dir, 3).select("qid", F.concat(F.lit("E"), F.col("rank").cast("string")).alias("ref"), "block_id").union(X.questions(spark, sf_dir).select("qid", F.lit("E9"), F.lit("none")))
    known = X.blocks(spark, sf_dir).select("block_id", F.lit(True).alias("there")).join(R.small(cited.select("block_id").distinct()), "block_id", "left_semi")
    return cited.join(known, "block_id", "left").select("qid", "ref", "block_id", F.col("there").isNotNull().alias("valid"))


@query("select qid, string_agg('[E' || rank || '] ' || left(t, 80), chr(10) order by rank) as prompt from (select qid, rank, " + FLAT + " as t from best where rank <= 5) group by 1", *BEST)
def evidence_prompt(spark, sf_dir):
    rows = best(spark, sf_dir, 5).select("qid", F.struct("rank", F.concat(F.lit("[E"), F.col("rank").cast("string"), F.lit("] "), F.substring(T.collapse(F.col("text")), 1, 80)).alias("line")).alias("e"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["line"]), "\n").alias("prompt"))


@query()
def small_block_merge(spark, sf_dir):
    return E.merge_small(X.page_lines(spark, sf_dir))


@query()
def split_large_blocks(spark, sf_dir):
    return E.split_large(X.blocks(spark, sf_dir).select("block_id", "text"), "block_id")


#: A text with other marks between the words, and one in capitals, so that spans are found in each way.
HELD = "held as (select doc_id, case doc_id % 3 when 1 then translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') when 2 then replace(replace(text, ', ', ' / '), '. ', '.  ') else text end as text from documents)"
WORDS = r"regexp_extract_all(lower({}), '[A-Za-z0-9\x{{4e00}}-\x{{9fff}}.%+-]+')"


@query(rf"""select doc_id, item_id, start, "end" from (select *, case when direct > 0 then direct - 1 when first > 0 then coalesce(list_sum(list_transform(pieces[1:first], lambda p: length(p))), 0) - length(words[first]) end::int as start,
case when direct > 0 then direct - 1 + length(answer) when first > 0 then list_sum(list_transform(pieces[1:first + len(asked) - 1], lambda p: length(p))) end::int as "end" from (
select *, strpos(lower(text), lower(answer)) as direct, list_filter(range(1, len(words) + 1), lambda i: words[i] = asked[1] and words[i:i + len(asked) - 1] = asked)[1] as first from (
select doc_id, item_id, h.text, trim(b.text, ' ' || chr(9) || chr(10) || chr(13)) as answer, {WORDS.format('h.text')} as words, regexp_extract_all(h.text, '[^A-Za-z0-9\x{{4e00}}-\x{{9fff}}.%+-]*[A-Za-z0-9\x{{4e00}}-\x{{9fff}}.%+-]+') as pieces, {WORDS.format('b.text')} as asked
from held h join benchmark b on contains(' ' || array_to_string({WORDS.format('h.text')}, ' ') || ' ', ' ' || array_to_string({WORDS.format('b.text')}[2:5], ' ') || ' ') where len({WORDS.format('b.text')}) >= 6))) where start is not null""", HELD)
def answer_spans(spark, sf_dir):
    """Where each document holds a benchmark passage, to the character."""
    doc, text = F.col("doc_id"), F.col("text")
    texts = X.table(spark, sf_dir, "documents").select("doc_id", F.when(doc % 3 == 1, F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(doc % 3 == 2, F.replace(F.replace(text, F.lit(", "), F.lit(" / ")), F.lit(". "), F.lit(".  "))).otherwise(text).alias("text"))
    return E.spans_in(texts, X.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("answer")), "doc_id", "text", "item_id", "answer")


@query(r"""select o_orderkey as id, case when kind = 3 and q = 0 then null else round(case kind when 0 then p + q * 3 - 2 when 1 then (p - q) / 4 * -2 when 2 then 2 ** ((q % 5) ** 2) - p when 3 then p / q when 4 then -((p + 1) * (q + 2)) + p when 5 then -(3.0 ** 2) + q when 6 then null else null end, 4) end as result,
case when kind = 3 and q = 0 then 'division by zero' when kind = 6 then 'unbalanced parentheses' when kind = 7 then 'unknown token' end as error from (select o_orderkey, o_orderkey % 8 as kind, round(o_totalprice, 2) as p, (o_custkey % 7)::double as q from orders)""")
def expression_results(spark, sf_dir):
    """Expressions over the orders' columns: precedence, signs, powers, nesting, division by zero, and two that are broken."""
    p, q, r = F.format_string("%.2f", "o_totalprice"), (F.col("o_custkey") % 7).cast("string"), (F.col("o_custkey") % 7 % 5).cast("string")
    kind = (F.col("o_orderkey") % 8).cast("int")
    of = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    shapes = (of(p, " + ", q, "*3 - 2"), of("(", p, "-", q, ") / 4 * -2"), of("2**(", r, ")**2 - ", p), of(p, "/", q), of("-((", p, "+1)*(", q, " + 2)) + ", p), of("-3**2 + ", q), of("((", p, ") + ", q, "*(2"), of(p, " times ", q))
    done = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), A.calculate(F.get(F.array(*shapes), kind)).alias("c"))
    return done.select("id", F.round("c.result", 4).alias("result"), "c.error")
