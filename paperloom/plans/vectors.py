"""Queries of the vector index and of the four retrieval modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import review as P
from ..operators import vectors as V
from ..sources.scratch import written
from . import fixtures as X
from .registry import query
from .retrieval import TOK, TOKENS, POSTINGS
from .review import ASKING_VIEWS, PLANS, asking

NEAREST = """select qid, vec_id, score, rank from (select q.vec_id as qid, v.vec_id, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 6) as score,
row_number() over (partition by q.vec_id order by round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 6) desc, v.vec_id) as rank
from embeddings v join embeddings q on q.vec_id % 50 = 0 and v.vec_id <> q.vec_id) where rank <= 10"""


def embedded(spark, sf_dir):
    vectors = X.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))


@query(NEAREST)
def vector_index_topk(spark, sf_dir):
    vectors, queries = embedded(spark, sf_dir)
    return V.search(V.build(vectors), queries, 10, skip_self=True).select("qid", "vec_id", "score", "rank")


@query()
def vector_index_recall(spark, sf_dir):
    """n and recall against all pairs: of the first cells alone, and of the search with the cells that its bound leaves."""
    vectors, queries = embedded(spark, sf_dir)
    index, wanted = V.build(vectors), written(R.dense_top(vectors, queries, 10))
    near = written(V.search(index, queries, 10, exact=False, skip_self=True))
    whole = V.search(index, queries, 10, skip_self=True, near=near)
    parts = [V.recall(found, wanted).select(F.lit(step).alias("step"), "n", "recall") for step, found in (("first_cells", near), ("bounded", whole))]
    return parts[0].union(parts[1])


HASHED = """(select {key}, cell, n / sqrt(sum(n * n) over (partition by {key})) as weight from (select {key}, ('0x' || substr(sha256(term), 15, 2))::int as cell, count(*)::double as n from {terms} group by 1, 2))"""
ARMS = f"""each as (select qid::varchar || ':' || (nth - 1) as asked, qid, nth, question from (select qid, unnest(queries) as question, generate_subscripts(queries, 1) as nth from planned)),
words as (select asked, unnest({TOK.format('question')}) as term from each),
word_counts as (select asked, term, count(*) as qtf from words group by 1, 2),
freq as (select term, count(*) as df from postings group by 1),
lexical as (select asked, block_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / greatest(avg_len, 1)))), 6) as score
  from postings join freq using (term) join word_counts using (term), (select count(*) as n, avg(len({TOK.format('text')})) as avg_len from blocks) group by 1, 2),
block_cells as {HASHED.format(key='block_id', terms='tokens')}, query_cells as {HASHED.format(key='asked', terms='words')},
near as (select asked, block_id, round(sum(b.weight * q.weight), 6) as score from query_cells q join block_cells b using (cell) group by 1, 2),
blank as (select asked, block_id, 0.0 as score from (select distinct asked from query_cells) cross join (select distinct block_id from block_cells) anti join near using (asked, block_id)),
arms as (select family, asked, block_id, score, row_number() over (partition by family, asked order by score desc, block_id) as rank from (
  select 'bm25' as family, * from lexical where score > 0 union all select 'dense', * from near union all select 'dense', * from blank)),
fused as (select mode, qid, block_id, round(sum(1.0 / (60 + rank)), 9) as rrf, min(rank) as best, max(score) filter (family = 'bm25') as bm25, max(score) filter (family = 'dense') as dense
  from arms join each using (asked) join (values ('bm25', 'bm25'), ('dense', 'dense'), ('hybrid', 'bm25'), ('hybrid', 'dense'), ('hybrid_rerank', 'bm25'), ('hybrid_rerank', 'dense')) m(mode, family) using (family) where rank <= 20 group by 1, 2, 3),
placed as (select *, row_number() over (partition by mode, qid order by rrf desc, best, block_id) as rank from fused),
first_words as (select qid, case when len(told) > 0 then told else said end as said from (select qid, said, [w for w in said if w not in ({', '.join(f"'{w}'" for w in R.STOPWORDS)})] as told from (select qid, list_distinct({TOK.format('question')}) as said from each where nth = 1))),
reranked as (select mode, qid, block_id, rrf, bm25, dense, row_number() over (partition by qid order by len(list_intersect(said, {TOK.format('text')})) desc, rank, block_id) as rank
  from placed join blocks using (block_id) join first_words using (qid) where mode = 'hybrid_rerank' and rank <= 20)"""


@query("select * from reranked where rank <= 5 union all select mode, qid, block_id, rrf, bm25, dense, rank from placed where mode <> 'hybrid_rerank' and rank <= 5", X.BLOCKS, *ASKING_VIEWS, PLANS, TOKENS, POSTINGS, ARMS)
def retrieval_modes(spark, sf_dir):
    planned = asking(spark, sf_dir).select("qid", P.planned_queries(F.col("question"), F.col("task")).alias("queries"))
    return V.retrieve(X.blocks(spark, sf_dir).select("block_id", "text"), planned)
