"""Queries of the greedy cover."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cover as C
from . import fixtures as X
from .registry import query
from .training import KEY

SIZES = "case when n = 1 then 'page:single' when n <= 5 then 'page:short' else 'page:long' end"


def greedy(rows: str, n: int, seed: str) -> str:
    """SQL of the cover, one row a step; rows give id and features."""
    return f"""select id as {{key}}, gain, place::bigint as place from (select id, gain, row_number() over (order by gain desc, hash, id) as place from (
select r.id, r.hash, coalesce(s.gain, 0) as gain from (select id, {KEY.format(seed=seed, key='id')} as hash from {rows}) r left join (
with recursive given as (select list_sort(features) as features, min({{{{'hash': {KEY.format(seed=seed, key='id')}, 'id': id}}}}) as best from {rows} where len(features) > 0 group by 1),
steps as (select 0 as step, []::varchar[] as seen, null::bigint as id, 0 as gain union all
select step, seen, id, brings from (select s.step + 1 as step, list_distinct(list_concat(s.seen, g.features)) as seen, g.best.id as id, len([f for f in g.features if not list_contains(s.seen, f)])::int as brings, g.best as best
from steps s cross join given g qualify row_number() over (order by brings desc, best) = 1) where brings > 0)
select id, gain from steps where step > 0) s on r.id = s.id)) where place <= {n}"""


DOC_FEATURES = rf"""doc_features as (select doc_id as id, list_distinct([{SIZES}, 'lang:' || coalesce(lang, ''), 'source:' || coalesce(source, ''), 'both:' || coalesce(lang, '') || ' ' || coalesce(source, '')]) as features
from (select *, len(string_split(coalesce(text, ''), chr(10))) as n from documents))"""


@query(greedy("doc_features", 150, "cover").format(key="doc_id"), DOC_FEATURES)
def feature_cover(spark, sf_dir):
    """150 documents that cover page sizes, languages, sources and pairs of both, then fill up."""
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    size = F.when(n == 1, "page:single").when(n <= 5, "page:short").otherwise("page:long")
    features = F.array(size, F.concat(F.lit("lang:"), lang), F.concat(F.lit("source:"), source), F.concat(F.lit("both:"), lang, F.lit(" "), source))
    return C.greedy_cover(X.table(spark, sf_dir, "documents").select("doc_id", features.alias("features")), "doc_id", "features", "cover", 150)


CUSTOMER_FEATURES = "customer_features as (select o_custkey as id, list_distinct(list(p_brand)) as features from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey group by 1)"


@query(greedy("customer_features", 60, "brands").format(key="o_custkey"), CUSTOMER_FEATURES)
def brand_cover(spark, sf_dir):
    """60 customers whose orders cover all brands: sets of up to 25 features."""
    lines = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("feature"))
    orders = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    bought = lines.join(parts, "l_partkey").join(orders, "l_orderkey").groupBy("o_custkey").agg(F.collect_set("feature").alias("features"))
    return C.greedy_cover(bought, "o_custkey", "features", "brands", 60)
