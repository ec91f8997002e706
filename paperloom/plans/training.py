"""Queries of training data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import prefix as P
from ..operators import retrieval as R
from ..operators import training as D
from . import fixtures as X
from .registry import query

KEY = "sha256('{seed}' || chr(0) || {key}::varchar)"
PART = "('0x' || substr({}, 49, 16))::ubigint % 10"


def docs(spark, sf_dir):
    return X.table(spark, sf_dir, "documents")


@query(f"select doc_id from documents order by {KEY.format(seed='subset', key='doc_id')}, doc_id limit 100")
def stable_subset(spark, sf_dir):
    return D.stable_subset(docs(spark, sf_dir).select("doc_id"), "doc_id", "subset", 100)


SPLIT = f"split as (select doc_id, text, case {PART.format(KEY.format(seed='split', key='doc_id'))} when 0 then 'test' when 1 then 'dev' else 'train' end as part from documents)"


@query("select doc_id, part from split", SPLIT)
def doc_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", D.split_by_key(F.col("doc_id"), "split").alias("part"))


@query("select sha256(text) as sha256, count(distinct part) as parts, count(*) as n from split group by 1 having count(distinct part) > 1", SPLIT)
def split_leakage(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.sha2("text", 256).alias("sha256"), D.split_by_key(F.col("doc_id"), "split").alias("part"))
    return rows.groupBy("sha256").agg(F.countDistinct("part").alias("parts"), F.count("*").alias("n")).where("parts > 1")


@query(f"select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by {KEY.format(seed='mix', key='doc_id')}, doc_id) as n from documents) where n <= case lang when 'en' then 51 when 'fr' then 64 when 'de' then 13 else 0 end")
def mixed_pack_quota(spark, sf_dir):
    quotas = D.largest_remainder({"en": 0.4, "fr": 0.5, "de": 0.1}, 128)
    return D.quota(docs(spark, sf_dir).select("doc_id", "lang"), "lang", quotas, D.stable_key(F.col("doc_id"), "mix"), F.col("doc_id"))


FILLED = """numbered as (select doc_id, lang, row_number() over (partition by lang order by {KEY_}, doc_id) as n, (select count(*) * 6 // 100 from documents) as t from documents where lang in ('en', 'es', 'de')),
quotas as (select *, n - t * case lang when 'en' then 4 when 'es' then 5 else 1 end as over_ from numbered)"""


@query("select doc_id, lang from quotas where over_ <= 0 union all select doc_id, lang from (select *, row_number() over (order by over_, lang) as k from quotas where over_ > 0) where k <= t * 10 - (select count(*) from quotas where over_ <= 0)", FILLED.replace("{KEY_}", KEY.format(seed="fill", key="doc_id")))
def mixed_pack_filled(spark, sf_dir):
    """A mix of six tenths of the documents in three languages, of which one has too few: the others fill up."""
    rows = docs(spark, sf_dir).select("doc_id", "lang")
    total = rows.count() * 6 // 100 * 10
    have = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    quotas = D.backfilled(D.largest_remainder({"en": 0.4, "es": 0.5, "de": 0.1}, total), have, total)
    return D.quota(rows, "lang", quotas, D.stable_key(F.col("doc_id"), "fill"), F.col("doc_id"))


@query("select doc_id, lang, row_number() over (order by turn, lang) as place from (select doc_id, lang, row_number() over (partition by lang order by doc_id) as turn from documents)")
def interleave(spark, sf_dir):
    return D.interleave(docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id")


def issue(i):
    name, p = D.SECRETS[i]
    return f"case when regexp_matches(text, '{p}') then '{name}' end"


AUDIT = f"audited as (select doc_id, list_filter([case when trim(text) = '' then 'empty' end, case when length(text) > 5000 then 'too_long' end, case when not regexp_matches(right(trim(text, ' '), 1), '[.!?]') then 'cut_off' end, {', '.join(issue(i) for i in range(len(D.SECRETS)))}], lambda x: x is not null) as issues from documents)"


@query("select doc_id, array_to_string(issues, ',') as issues, len(issues) = 0 as clean from audited", AUDIT)
def audit_records(spark, sf_dir):
    rows = D.audit(docs(spark, sf_dir), "text")
    return rows.select("doc_id", F.array_join("issues", ",").alias("issues"), (F.size("issues") == 0).alias("clean"))


@query("select issue, count(*) as n, array_to_string(list_slice(list_sort(list(doc_id)), 1, 3), ',') as examples from (select doc_id, unnest(issues) as issue from audited) group by 1", AUDIT)
def audit_summary(spark, sf_dir):
    rows = D.audit(docs(spark, sf_dir), "text").select("doc_id", F.explode("issues").alias("issue"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("issue").orderBy("doc_id")))  # the three examples keep no group in memory
    return first.groupBy("issue").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.col("doc_id")))), ",").alias("examples"))


@query("select doc_id, case when l.doc_id is null then 'missing' else 'both' end as side from documents d left join (select distinct doc_id from labels) l using (doc_id) union all select doc_id, 'extra' from (select distinct doc_id from labels) where doc_id not in (select doc_id from documents)")
def set_diff_ids(spark, sf_dir):
    return D.set_difference(docs(spark, sf_dir), X.table(spark, sf_dir, "labels"), "doc_id")


@query("select doc_id, source from (select doc_id, 'a' as source from documents where doc_id % 2 = 0 union all select doc_id, 'b' from documents where doc_id % 3 = 0 and doc_id % 2 <> 0 union all select doc_id, 'c' from documents where doc_id % 5 = 0 and doc_id % 2 <> 0 and doc_id % 3 <> 0)")
def dedup_union(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id")
    return D.first_wins([rows.where(f"doc_id % {m} = 0").withColumn("source", F.lit(s)) for m, s in ((2, "a"), (3, "b"), (5, "c"))], "doc_id")


@query("""select conv_id, count(*) as n_messages, string_agg(role || ': ' || text, chr(10) order by turn, role, text) as rendered from conversations group by 1""")
def sft_records(spark, sf_dir):
    rows = D.messages(X.table(spark, sf_dir, "conversations"), "conv_id")
    return rows.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("rendered"))


@query("""select conv_id, max(text) filter (turn = last and role = 'assistant') as gold_answer, count(*) filter (turn < last) as prompt_turns from (select *, max(turn) over (partition by conv_id) as last from conversations) group by 1""")
def grpo_records(spark, sf_dir):
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    rows = X.table(spark, sf_dir, "conversations").withColumn("last", last)
    return rows.groupBy("conv_id").agg(F.max(F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), F.col("text"))).alias("gold_answer"), F.sum((F.col("turn") < F.col("last")).cast("long")).alias("prompt_turns"))


@query("""select p.item_id, (select min_by(o.item_id, s) from (select unnest(range(1, (select count(*) from benchmark))) as s) t join placed o on o.pos = (p.pos + s) % (select count(*) from benchmark) where o.item_id <> p.item_id and not contains(lower(o.text), lower(p.answer))) as decoy from placed p""",
       "placed as (select item_id, text, string_split(text, ' ')[1] as answer, row_number() over (order by item_id) - 1 as pos from benchmark)")
def decoy_negatives(spark, sf_dir):
    boards = X.table(spark, sf_dir, "benchmark").select("item_id", "text", F.split("text", " ")[0].alias("answer"))
    return D.decoys(boards, "item_id", "item_id", "answer", "text")


@query("""select item_id, count(distinct d.doc_id) as docs, count(distinct d.doc_id) > 0 as covered from benchmark b left join documents d on contains(d.text, b.text) group by 1""")
def gold_coverage(spark, sf_dir):
    items = X.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    hits = R.holding(docs(spark, sf_dir).select("doc_id", "text"), items, "doc_id", "text", "item_id", "passage").groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"))
    return items.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("docs", F.lit(0)).alias("docs"), F.col("docs").isNotNull().alias("covered"))


@query("""select doc_id, line_no, line from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1)::int as line_no, unnest(string_split(text, chr(10))) as line from documents) qualify max(regexp_matches(line, '(?i)licen[cs]e')::int) over (partition by doc_id order by line_no rows between 1 preceding and 1 following) = 1""")
def log_context(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_no"), "line")
    near = F.max(F.col("line").rlike("(?i)licen[cs]e").cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(-1, 1))
    return lines.withColumn("near", near).where("near = 1").drop("near")


@query("""select source, count(*) as n, count(distinct lang) as langs, round(avg(quality), 6) as quality, round(avg(toxic), 6) as toxic from documents left join labels using (doc_id) group by 1""")
def source_histogram(spark, sf_dir):
    rows = docs(spark, sf_dir).join(X.table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))


@query("""select doc_id, case when doc_id is null then 'missing_id' when ids > 1 then 'duplicate_id' when trim(coalesce(text, '')) = '' then 'empty_text' else 'duplicate_text' end as error from (select *, count(*) over (partition by sha256(text)) as n, count(*) over (partition by doc_id) as ids from documents) where doc_id is null or ids > 1 or trim(coalesce(text, '')) = '' or n > 1""")
def corpus_errors(spark, sf_dir):
    """Counts come from aggregates and join back, so that neither a frequent text nor a frequent id is one task's window."""
    rows = docs(spark, sf_dir).select("doc_id", F.trim(F.coalesce("text", F.lit(""))).alias("plain"), F.sha2("text", 256).alias("h"))
    many = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1 and h is not null")
    again = rows.groupBy("doc_id").agg(F.count("*").alias("ids")).where("ids > 1 and doc_id is not null")
    marked = rows.join(many, "h", "left").join(again, "doc_id", "left")
    error = F.when(F.col("doc_id").isNull(), "missing_id").when(F.col("ids") > 1, "duplicate_id").when(F.col("plain") == "", "empty_text").when(F.col("n") > 1, "duplicate_text")
    return marked.select("doc_id", error.alias("error")).where("error is not null")


WINDOWS = """windows as (select conv_id, count(*) as pages, count(*) filter (role = 'user') as questions, case when count(*) <= 2 then 'one' when count(*) <= 4 then 'few' else 'many' end as bucket, conv_id % 5 = 0 as preferred, conv_id % 10 = 3 as baseline from conversations where conv_id is not null group by 1),
limits as (select (sum(questions) * 2 // 5)::bigint as target from windows)"""


@query(f"""select conv_id, bucket, questions, place, upto from (select *, row_number() over w as place, sum(questions) over (w rows unbounded preceding) + (select coalesce(sum(questions), 0) from windows where baseline) as upto from (
select *, row_number() over (partition by bucket order by not preferred, h, conv_id) + (select count(*) from windows b where b.baseline and b.bucket = x.bucket) as turn from (select *, {KEY.format(seed='more', key='conv_id')} as h from windows where not baseline) x) window w as (order by turn, not preferred, h, conv_id)), limits where upto - questions < target
union all select conv_id, bucket, questions, null, null from windows where baseline""", WINDOWS)
def windows_to_target(spark, sf_dir):
    """Conversations as windows: two fifths of all questions, from short, middle and long ones in turn."""
    pages = F.count("*")
    bucket = F.when(pages <= 2, "one").when(pages <= 4, "few").otherwise("many")
    turns = X.table(spark, sf_dir, "conversations").where("conv_id is not null")
    windows = turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("questions"), bucket.alias("bucket"))
    windows = windows.withColumns({"preferred": F.col("conv_id") % 5 == 0, "baseline": F.col("conv_id") % 10 == 3})
    whole = windows.agg(F.sum("questions")).first()[0] or 0
    chosen = D.windows_to_target(windows, "conv_id", "bucket", "questions", "preferred", "baseline", whole * 2 // 5, whole, "more")
    return chosen.select("conv_id", "bucket", "questions", "place", "upto")


@query("select order_key as o_orderkey, rank, total from (select o_orderkey as order_key, row_number() over (order by o_totalprice, o_orderkey) as rank, sum(o_custkey) over (order by o_totalprice, o_orderkey rows unbounded preceding)::bigint as total from orders)")
def running_totals(spark, sf_dir):
    """Rank and running total of all orders by price, without a window over all rows."""
    orders = X.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    summed = P.running(orders, "o_totalprice", ["o_orderkey"], F.col("o_custkey"), "total")
    return P.running(summed, "o_totalprice", ["o_orderkey"], name="rank").select("o_orderkey", "rank", "total")
