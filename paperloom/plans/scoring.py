"""Queries of metrics, rewards and run comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import scoring as S
from . import fixtures as X
from .registry import query

NORM = r"trim(regexp_replace(lower({}), '[^a-z0-9\x{{4e00}}-\x{{9fff}}.%+-]+', ' ', 'g'))"
WORDS = rf"words as (select qid, 'p' as side, unnest(string_split({NORM.format('prediction')}, ' ')) as w from predictions union all select qid, 'g', unnest(string_split({NORM.format('gold')}, ' ')) from predictions)"
F1 = """f1 as (select qid, case when shared = 0 then 0 else 2.0 * (shared / np) * (shared / ng) / (shared / np + shared / ng) end as f1 from (
  select qid, sum(least(p, g))::double as shared, sum(p)::double as np, sum(g)::double as ng from (
    select qid, w, count(*) filter (side = 'p') as p, count(*) filter (side = 'g') as g from words where w <> '' group by 1, 2) group by 1))"""
SCORED = (X.PREDICTIONS, WORDS, F1)


@query(f"select qid, {NORM.format('prediction')} = {NORM.format('gold')} as em, round(f1, 6) as f1 from predictions join f1 using (qid)", *SCORED)
def answer_scores(spark, sf_dir):
    p, g = F.col("prediction"), F.col("gold")
    return X.predictions(spark, sf_dir).select("qid", T.exact_match(p, g).alias("em"), F.round(T.token_f1(p, g), 6).alias("f1"))


@query(rf"""select qid, round(case when shared = 0 then 0 else 2.0 * (shared / np) * (shared / ng) / (shared / np + shared / ng) end, 6) as char_f1 from (
select qid, sum(least(p, g))::double as shared, sum(p)::double as np, sum(g)::double as ng from (select qid, c, count(*) filter (side = 'p') as p, count(*) filter (side = 'g') as g from (
select qid, 'p' as side, unnest(string_split(replace({NORM.format('prediction')}, ' ', ''), '')) as c from predictions union all select qid, 'g', unnest(string_split(replace({NORM.format('gold')}, ' ', ''), '')) from predictions) where c <> '' group by 1, 2) group by 1)""", X.PREDICTIONS)
def character_f1(spark, sf_dir):
    return X.predictions(spark, sf_dir).select("qid", F.round(T.character_f1(F.col("prediction"), F.col("gold")), 6).alias("char_f1"))


PRICES = """prices as (select o_orderkey as id, case o_orderkey % 5 when 0 then '$' || printf('%.2f', o_totalprice) when 1 then '(' || printf('%.2f', o_totalprice) || ')' when 2 then 'about ' || printf('%.2f', o_totalprice) || '% of all' when 3 then 'no figure' else '1,' || lpad((o_orderkey % 1000)::varchar, 3, '0') || ' units' end as said, o_totalprice as price from orders)"""
NUM = r"regexp_extract(said, '-?\(?\$?\d[\d,]*(?:\.\d+)?%?\)?')"
PARSED = rf"parsed as (select id, price, said, (case when starts_with({NUM}, '(') and ends_with({NUM}, ')') then -1 else 1 end) * try_cast(rtrim(translate({NUM}, '$,()', ''), '%') as double) as number from prices)"


def prices(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    price, key = F.format_string("%.2f", "o_totalprice"), F.col("o_orderkey") % 5
    said = F.when(key == 0, F.concat(F.lit("$"), price)).when(key == 1, F.concat(F.lit("("), price, F.lit(")"))).when(key == 2, F.concat(F.lit("about "), price, F.lit("% of all"))).when(key == 3, "no figure").otherwise(F.concat(F.lit("1,"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(" units")))
    return o.select(F.col("o_orderkey").alias("id"), said.alias("said"), F.col("o_totalprice").alias("price"))


@query("select id, number from parsed", PRICES, PARSED)
def parse_number(spark, sf_dir):
    return prices(spark, sf_dir).select("id", T.parse_number(F.col("said")).alias("number"))


@query("select id, coalesce(abs(number - price) <= 0.001 * greatest(abs(price), 1), false) as numeric_match from parsed", PRICES, PARSED)
def numeric_match(spark, sf_dir):
    return prices(spark, sf_dir).select("id", T.numeric_match(F.col("said"), F.format_string("%.2f", "price")).alias("numeric_match"))


@query("select l_orderkey, l_linenumber, case when l_quantity = floor(l_quantity) then floor(l_quantity)::bigint::varchar else rtrim(rtrim(printf('%.4f', l_quantity), '0'), '.') end as quantity, case when l_discount = floor(l_discount) then floor(l_discount)::bigint::varchar else rtrim(rtrim(printf('%.4f', l_discount), '0'), '.') end as discount from lineitem")
def format_number(spark, sf_dir):
    rows = X.table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", T.format_number(F.col("l_quantity")).alias("quantity"), T.format_number(F.col("l_discount")).alias("discount"))


@query(f"select qid, round(case when {NORM.format('prediction')} = {NORM.format('gold')} then 1 else f1 end, 6) as reward, round(case when qid % 3 = 0 then 0.2 + 0.6 * (case when {NORM.format('prediction')} = {NORM.format('gold')} then 1 else f1 end) + 0.2 else 0.2 end, 6) as grounded, round(0.25 + 0.75 * (case when {NORM.format('prediction')} = {NORM.format('gold')} then 1 else f1 end), 6) as plain from predictions join f1 using (qid)", *SCORED)
def reward_answer(spark, sf_dir):
    rows = X.predictions(spark, sf_dir).withColumn("reward", S.answer_reward(F.col("prediction"), F.col("gold"), F.lit("extractive")))
    gold = F.struct(F.lit(1).alias("page"), F.lit("b1").alias("block_id"), F.lit(None).cast("string").alias("table_id"))
    said = F.struct(F.when(F.col("qid") % 3 == 0, 1).otherwise(2).alias("page"), F.lit("b2").alias("block_id"), F.lit(None).cast("string").alias("table_id"))
    rows = rows.withColumn("loc", S.location_reward(said, gold))
    one = F.lit(1.0)
    return rows.select("qid", F.round("reward", 6).alias("reward"), F.round(S.grounded_reward(one, F.col("reward"), F.col("loc")), 6).alias("grounded"), F.round(S.grounded_reward(one, F.col("reward"), None), 6).alias("plain"))


OUTPUTS = """outputs as (select qid, gold, case when qid % 7 = 6 then null else prediction end as answer, case qid % 5 when 0 then ['E1', ' E2 '] when 1 then ['E9'] when 2 then [] when 3 then ['E2', '', 'E2'] else ['E1', 'E9'] end as refs, case qid % 6 when 0 then 'insufficient' when 1 then 'maybe' else 'supported' end as status, repeat('x', (qid % 4 * 110)::int) as reason from predictions),
cleaned as (select *, list_filter([trim(r) for r in refs], lambda r: r <> '') as all_refs from outputs),
checked as (select *, case when answer is null then 'missing fields: answer' when length(reason) > 300 then 'reasoning_summary exceeds 300 characters' when status not in ('supported', 'insufficient') then 'support_status must be supported or insufficient'
 when status = 'supported' and len(all_refs) = 0 then 'supported output requires at least one supporting_ref' when status = 'insufficient' and len(all_refs) > 0 then 'insufficient output must not include supporting_refs'
 when list_contains(all_refs, 'E9') then 'invalid supporting_refs: E9' end as error from cleaned)"""


def outputs(spark, sf_dir):
    q = F.col("qid")
    refs = F.when(q % 5 == 0, F.array(F.lit("E1"), F.lit(" E2 "))).when(q % 5 == 1, F.array(F.lit("E9"))).when(q % 5 == 2, F.array().cast("array<string>")).when(q % 5 == 3, F.array(F.lit("E2"), F.lit(""), F.lit("E2"))).otherwise(F.array(F.lit("E1"), F.lit("E9")))
    status = F.when(q % 6 == 0, "insufficient").when(q % 6 == 1, "maybe").otherwise("supported")
    out = F.struct(F.when(q % 7 != 6, F.col("prediction")).alias("answer"), refs.alias("supporting_refs"), status.alias("support_status"), F.repeat(F.lit("x"), (q % 4 * 110).cast("int")).alias("reasoning_summary"))
    return X.predictions(spark, sf_dir).select("qid", "gold", out.alias("output"))


@query("select qid, error is null as ok, error from checked", X.PREDICTIONS, OUTPUTS)
def validate_contract(spark, sf_dir):
    rows = outputs(spark, sf_dir).select("qid", S.schema_error(F.col("output"), F.array(F.lit("E1"), F.lit("E2"))).alias("error"))
    return rows.select("qid", F.col("error").isNull().alias("ok"), "error")


@query(f"""select qid, round(case when error is not null and not starts_with(error, 'invalid') then 0 else greatest(0, 0.15 + 0.35 * r + 0.2 * (status = 'supported')::int + 0.3 * list_has_any(all_refs, ['E1', 'E2'])::int - (case when list_contains(all_refs, 'E9') then 0.15 else 0 end)) end, 6) as reward from checked join (
select qid, case when {NORM.format('prediction')} = {NORM.format('gold')} then 1 else f1 end as r from predictions join f1 using (qid)) using (qid)""", *SCORED, OUTPUTS)
def contract_reward(spark, sf_dir):
    allowed = F.array(F.lit("E1"), F.lit("E2"))
    return outputs(spark, sf_dir).select("qid", F.round(S.contract_reward(F.col("output"), F.col("gold"), allowed, F.lit("extractive"), F.lit(False)), 6).alias("reward"))


@query("select event_type, count(value) as n, round(avg(value), 6) as mean, round(median(value), 6) as median, round(quantile_disc(value, 0.95), 6) as p95 from events group by 1")
def latency_percentiles(spark, sf_dir):
    return S.latency(X.table(spark, sf_dir, "events"), "event_type", "value")


RUNS = """before_run as (select user_id, round(avg(value), 6) as score from events where event_id % 2 = 0 group by 1), after_run as (select user_id, round(avg(value), 6) as score from events where event_id % 2 = 1 group by 1)"""


def runs(spark, sf_dir):
    rows = X.table(spark, sf_dir, "events")
    return [rows.where(F.col("event_id") % 2 == half).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("score")) for half in (0, 1)]


@query("select user_id, b.score as before, a.score as after, case when a.score > b.score then 'improved' when a.score < b.score then 'regressed' else 'same' end as change from before_run b join after_run a using (user_id)", RUNS)
def compare_runs(spark, sf_dir):
    return S.compare_runs(*runs(spark, sf_dir), "user_id", "score")


@query("""select user_id, case when b.score is null then 'added' when a.score is null then 'removed' when b.score > 50 and a.score > 50 then 'kept' when b.score > 50 then 'lost' when a.score > 50 then 'gained' else 'missed' end as movement from before_run b full join after_run a using (user_id)""", RUNS)
def checkpoint_movement(spark, sf_dir):
    before, after = (r.withColumn("ok", F.col("score") > 50) for r in runs(spark, sf_dir))
    return S.movement(before, after, "user_id", "ok")


@query("""select event_type, base, new, round(new - base, 6) as delta, round((new - base) / nullif(base, 0), 6) as relative from (select event_type, round(avg(value) filter (event_id % 2 = 0), 6) as base, round(avg(value) filter (event_id % 2 = 1), 6) as new from events group by 1)""")
def metric_deltas(spark, sf_dir):
    rows = X.table(spark, sf_dir, "events")
    base, new = (rows.where(F.col("event_id") % 2 == half).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("value")) for half in (0, 1))
    return S.metric_deltas(base, new, "event_type", "value")


@query("""select event_id, case when s < 1e-6 then 0 else round((value - m) / (s + 1e-6), 6) end as advantage from (select event_id, value, avg(value) over w as m, stddev_pop(value) over w as s from events window w as (partition by user_id))""")
def group_advantages(spark, sf_dir):
    return S.group_advantages(X.table(spark, sf_dir, "events"), "user_id", "value").select("event_id", "advantage")


@query("""select case when grouping(event_type) = 1 then 'overall' when grouping(day) = 1 then 'type' else 'type_day' end as level, event_type, day, count(*) as n, round(avg(value), 6) as mean from (select event_type, cast(ts as date)::varchar as day, value from events) group by grouping sets ((), (event_type), (event_type, day))""")
def answer_summary_grouping_sets(spark, sf_dir):
    rows = X.table(spark, sf_dir, "events").select("event_type", F.to_date("ts").cast("string").alias("day"), "value")
    sets = rows.groupingSets([[], ["event_type"], ["event_type", "day"]], "event_type", "day").agg(F.grouping("event_type").alias("a"), F.grouping("day").alias("b"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return sets.select(F.when(F.col("a") == 1, "overall").when(F.col("b") == 1, "type").otherwise("type_day").alias("level"), "event_type", "day", "n", "mean")


@query(f"""select outcome, f1_bucket, count(*) as n from (select case when em and loc then 'both' when em then 'answer_only' when loc then 'location_only' else 'neither' end as outcome, case when f1 >= 0.999 then 'exact' when f1 >= 0.5 then 'half' when f1 > 0 then 'some' else 'none' end as f1_bucket from (
select qid, qid % 3 = 0 as loc, {NORM.format('prediction')} = {NORM.format('gold')} as em, f1 from predictions join f1 using (qid))) group by 1, 2""", *SCORED)
def reader_outcomes(spark, sf_dir):
    p, g = F.col("prediction"), F.col("gold")
    rows = X.predictions(spark, sf_dir).select((F.col("qid") % 3 == 0).alias("loc"), T.exact_match(p, g).alias("em"), T.token_f1(p, g).alias("f1"))
    outcome = F.when(F.col("em") & F.col("loc"), "both").when(F.col("em"), "answer_only").when(F.col("loc"), "location_only").otherwise("neither")
    bucket = F.when(F.col("f1") >= 0.999, "exact").when(F.col("f1") >= 0.5, "half").when(F.col("f1") > 0, "some").otherwise("none")
    return rows.groupBy(outcome.alias("outcome"), bucket.alias("f1_bucket")).agg(F.count("*").alias("n"))


@query(f"select qid, round(f1, 6) as f1, case when f1 < 0.85 then 'partial_answer' else 'near_miss' end as issue from predictions join f1 using (qid) where {NORM.format('prediction')} <> {NORM.format('gold')} and f1 <= 0.999", *SCORED)
def hard_cases(spark, sf_dir):
    p, g = F.col("prediction"), F.col("gold")
    rows = X.predictions(spark, sf_dir).withColumn("f1", T.token_f1(p, g)).where(~T.exact_match(p, g) & (F.col("f1") <= 0.999))
    return rows.select("qid", F.round("f1", 6).alias("f1"), F.when(F.col("f1") < 0.85, "partial_answer").otherwise("near_miss").alias("issue"))


BOARD = """board as (select user_id, event_id, value, row_number() over (partition by user_id order by value desc, event_id) as rank, count(*) over (partition by user_id) as n from events)"""


@query("select user_id, event_id, value, rank, n, value >= 95 as ready from board where rank = 1", BOARD)
def rejection_rank(spark, sf_dir):
    from pyspark.sql import Window

    own = Window.partitionBy("user_id")
    rows = X.table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.row_number().over(own.orderBy(F.desc("value"), "event_id")).alias("rank"), F.count("*").over(own).alias("n"))
    return rows.where("rank = 1").withColumn("ready", F.col("value") >= 95)


@query("""select user_id, max(event_id) filter (rank = 1) as chosen, max(event_id) filter (rank = n) as rejected, round(max(value) - min(value), 6) as margin from board group by 1 having max(value) - min(value) >= 20""", BOARD)
def preference_pairs(spark, sf_dir):
    best = F.struct(-F.col("value"), "event_id")
    rows = X.table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", best).alias("chosen"), F.max_by("event_id", best).alias("rejected"), (F.max("value") - F.min("value")).alias("gap"))
    return rows.where("gap >= 20").select("user_id", "chosen", "rejected", F.round("gap", 6).alias("margin"))
