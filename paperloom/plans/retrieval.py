"""Queries of retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..sources.scratch import written
from . import fixtures as X
from .registry import query

TOK = r"regexp_extract_all(lower({}), '[A-Za-z0-9_]+|[\x{{4e00}}-\x{{9fff}}]')"
TOKENS = f"tokens as (select doc_id, block_id, unnest({TOK.format('text')}) as term, len({TOK.format('text')}) as doc_len from blocks)"
POSTINGS = "postings as (select doc_id, block_id, term, any_value(doc_len) as doc_len, count(*) as tf from tokens group by 1, 2, 3)"
ASKED = f"asked as (select qid, term, count(*) as qtf from (select qid, unnest({TOK.format('question')}) as term from questions) group by 1, 2)"
BM25 = f"""stats as (select count(*) as n, avg(len({TOK.format('text')})) as avg_len from blocks),
freq as (select term, count(*) as df from postings group by 1),
scores as (select qid, doc_id, block_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / greatest(avg_len, 1)))), 6) as score
  from postings join freq using (term) join asked using (term), stats group by 1, 2, 3),
ranked as (select qid, block_id, score, row_number() over (partition by qid order by score desc, block_id) as rank from scores where score > 0)"""
ALL = (X.BLOCKS, X.QUESTIONS, TOKENS, POSTINGS, ASKED, BM25)
GOLD = "gold as (select qid, block_id from questions q join blocks b on contains(b.text, split_part(q.answer, chr(10), 1)))"


def searched(spark, sf_dir, k):
    """Written, as it is a few rows a question that cost a pass over all blocks, and others read them more than once."""
    return written(R.bm25_top(X.blocks(spark, sf_dir), X.questions(spark, sf_dir), k))


@query("select qid, block_id, score, rank from ranked where rank <= 5", *ALL)
def bm25_search(spark, sf_dir):
    return searched(spark, sf_dir, 5).select("qid", "block_id", "score", "rank")


def gold_blocks(spark, sf_dir):
    """Blocks that hold the first line of a passage."""
    asked = X.questions(spark, sf_dir).select("qid", F.substring_index("answer", "\n", 1).alias("first"))
    return R.holding(X.blocks(spark, sf_dir).select("block_id", "text"), asked, "block_id", "text", "qid", "first").select("qid", "block_id")


@query("""select count(*) as n, round(avg((first is not null)::int), 6) as recall, round(avg(coalesce(1.0 / first, 0)), 6) as mrr from (
select qid, min(rank) filter (block_id in (select block_id from gold g where g.qid = r.qid)) as first from (select distinct qid from gold) left join (select * from ranked where rank <= 5) r using (qid) group by qid)""", *ALL, GOLD)
def bm25_recall_mrr(spark, sf_dir):
    return R.recall_mrr(searched(spark, sf_dir, 5), gold_blocks(spark, sf_dir), X.questions(spark, sf_dir), 5)


@query("""select qid, coalesce(first, 0) as first_rank, case when first is null then 'gold_not_in_top_k' when first = 1 then 'top1' else 'lower' end as label from (
select qid, min(rank) filter (block_id in (select block_id from gold g where g.qid = r.qid)) as first from (select distinct qid from gold) left join (select * from ranked where rank <= 10) r using (qid) group by qid)
union all select qid, 0, 'gold_not_in_corpus' from questions where qid not in (select qid from gold)""", *ALL, GOLD)
def retrieval_failures(spark, sf_dir):
    gold = gold_blocks(spark, sf_dir)
    first = searched(spark, sf_dir, 10).join(gold, ["qid", "block_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("first"))
    known = X.questions(spark, sf_dir).select("qid").join(gold.select("qid", F.lit(True).alias("there")).distinct(), "qid", "left").join(first, "qid", "left")
    label = F.when(F.col("there").isNull(), "gold_not_in_corpus").when(F.col("first").isNull(), "gold_not_in_top_k").when(F.col("first") == 1, "top1").otherwise("lower")
    return known.select("qid", F.coalesce("first", F.lit(0)).cast("long").alias("first_rank"), label.alias("label"))


@query("""select case when grouping(shard) = 1 then 'overall' else 'shard' end as level, coalesce(shard, -1) as shard, count(*) as n, round(avg(hit), 6) as hit_rate from (
select qid, qid % 4 as shard, max((block_id in (select block_id from gold g where g.qid = r.qid))::int)::double as hit from (select distinct qid from gold) join (select * from ranked where rank <= 5) r using (qid) group by qid) group by grouping sets ((), (shard))""", *ALL, GOLD)
def retrieval_summary_grouping_sets(spark, sf_dir):
    gold = gold_blocks(spark, sf_dir).withColumn("gold", F.lit(1.0))
    hits = searched(spark, sf_dir, 5).join(gold.select("qid").distinct(), "qid", "left_semi").join(gold, ["qid", "block_id"], "left")
    rows = hits.groupBy("qid").agg(F.max(F.coalesce("gold", F.lit(0.0))).alias("hit")).withColumn("shard", F.col("qid") % 4)
    sets = rows.groupingSets([[], ["shard"]], "shard").agg(F.grouping("shard").alias("g"), F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("hit_rate"))
    return sets.select(F.when(F.col("g") == 1, "overall").otherwise("shard").alias("level"), F.coalesce("shard", F.lit(-1)).alias("shard"), "n", "hit_rate")


SCOPED = f"""stats as (select doc_id, count(*) as n, avg(len({TOK.format('text')})) as avg_len from blocks group by 1),
freq as (select doc_id, term, count(*) as df from postings group by 1, 2),
scores as (select qid, p.doc_id, block_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / greatest(avg_len, 1)))), 6) as score
  from postings p join freq using (doc_id, term) join stats using (doc_id) join asked using (term) group by 1, 2, 3)"""


@query("""select qid, doc_id, block_id, score, rank from (select *, row_number() over (partition by qid, doc_id order by score desc, block_id) as rank from scores) where rank <= 1""", X.BLOCKS, X.QUESTIONS, TOKENS, POSTINGS, ASKED, SCOPED)
def bm25_doc_scoped(spark, sf_dir):
    return R.bm25_top_scoped(X.blocks(spark, sf_dir), X.questions(spark, sf_dir), 1, "doc_id").select("qid", "doc_id", "block_id", "score", "rank")


@query("select term, df, round(ln(1 + ((select count(*) from blocks) - df + 0.5) / (df + 0.5)), 6) as idf from (select term, count(*) as df from postings group by 1)", X.BLOCKS, TOKENS, POSTINGS)
def tokenize_df_idf(spark, sf_dir):
    blocks = X.blocks(spark, sf_dir)
    n = blocks.agg(F.count("*").alias("n"))
    return R.postings(blocks).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", "df", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query("""select qid, vec_id, score, rank from (select q.vec_id as qid, v.vec_id, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 6) as score,
row_number() over (partition by q.vec_id order by round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 6) desc, v.vec_id) as rank
from embeddings v join embeddings q on q.vec_id % 50 = 0 and v.vec_id <> q.vec_id) where rank <= 10""")
def dense_cosine_topk(spark, sf_dir):
    vectors = X.table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    return R.dense_top(vectors, queries, 10).select("qid", "vec_id", "score", "rank")


@query(rf"""select doc_id, cell, round(n / sqrt(sum(n * n) over (partition by doc_id)), 6) as weight from (
select doc_id, ('0x' || substr(sha256(term), 15, 2))::int as cell, count(*)::double as n from (select doc_id, unnest({TOK.format('text')}) as term from documents) group by 1, 2)""")
def hash_encode_dense(spark, sf_dir):
    coded = R.hash_encode(X.table(spark, sf_dir, "documents"), "doc_id")
    return coded.select("doc_id", "cell", F.round("weight", 6).alias("weight"))


KEYWORD = f"""overlap as (select qid, block_id, count(distinct term) as score from asked a join postings p using (term) where term not in ({', '.join(f"'{w}'" for w in R.STOPWORDS)}) group by 1, 2),
by_keyword as (select qid, block_id, row_number() over (partition by qid order by score desc, block_id) as rank from overlap)"""
FUSED = """fused as (select qid, block_id, round(sum(1.0 / (60 + rank)), 9) as rrf, min(rank) as best from (select qid, block_id, rank from ranked where rank <= 20 union all select qid, block_id, rank from by_keyword where rank <= 20) group by 1, 2),
fused_ranked as (select qid, block_id, rrf, row_number() over (partition by qid order by rrf desc, best, block_id) as rank from fused)"""


def by_keyword(spark, sf_dir, k):
    """The keyword ranking for questions whose terms are too many to go to every task."""
    asked = X.questions(spark, sf_dir).select("qid", F.explode(F.array_distinct(T.tokens(F.col("question")))).alias("term")).where(~F.col("term").isin(*R.STOPWORDS))
    scores = R.postings(X.blocks(spark, sf_dir)).join(R.small(asked), "term").groupBy("qid", "block_id").agg(F.count("*").alias("score"))
    return R.top(scores, k)


def both_rankings(spark, sf_dir, k):
    held = R.cut(X.blocks(spark, sf_dir), X.questions(spark, sf_dir))
    lexical, keyword = (R.best_of(held, k), R.keyword_top(held, k)) if held else (searched(spark, sf_dir, k), by_keyword(spark, sf_dir, k))
    return lexical.select("qid", F.lit("bm25").alias("source"), "block_id", "rank").union(keyword.select("qid", F.lit("keyword"), "block_id", "rank"))


@query("select qid, block_id, rrf, rank from fused_ranked where rank <= 5", *ALL, KEYWORD, FUSED)
def rrf_fusion(spark, sf_dir):
    rankings = both_rankings(spark, sf_dir, 20)
    return R.fused_top(rankings, 5).select("qid", "block_id", "rrf", "rank")


@query("""select qid, block_id, score, row_number() over (partition by qid order by score desc, before, block_id) as rank from (
select qid, block_id, rank as before, coalesce(o.score, 0) as score from (select * from fused_ranked where rank <= 10) left join overlap o using (qid, block_id))""", *ALL, KEYWORD, FUSED)
def keyword_rerank(spark, sf_dir):
    rankings = both_rankings(spark, sf_dir, 20)
    pool = R.small(written(R.fused_top(rankings, 10).withColumnRenamed("rank", "before")))
    known = pool.join(X.blocks(spark, sf_dir).select("block_id", "text"), "block_id").join(R.small(X.questions(spark, sf_dir)), "qid")
    scored = known.select("qid", "block_id", "before", R.keyword_overlap(F.col("question"), F.col("text")).cast("long").alias("score"))
    return scored.select("qid", "block_id", "score", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "before", "block_id")).alias("rank"))
