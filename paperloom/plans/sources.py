"""Queries of sources: paged text, typed page items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as S
from . import fixtures as X
from .registry import query


@query(r"""select conv_id, page, trim(regexp_replace(text, '\s+', ' ', 'g')) as text from (select conv_id, unnest(string_split(whole, chr(12))) as text, generate_subscripts(string_split(whole, chr(12)), 1)::int as page from (select conv_id, string_agg(text, chr(12) order by turn) as whole from conversations group by 1)) where trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''""")
def text_pages(spark, sf_dir):
    rows = X.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]), "\f").alias("whole"))
    return S.split_pages(rows, "conv_id", "whole")


ITEMS = r"""items as (select page_id as doc_id, 0 as idx, 'title' as type, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as text from pages union all select page_id, 1, 'footer', left(regexp_extract(html, '<li><a href="[^"]*">([^<]*)</a>', 1), 200) from pages
 union all select page_id, 2, 'page_number', (page_id % 50)::varchar from pages union all select page_id, 3, 'header', case page_id % 3 when 0 then 'one two three four five six' when 1 then 'Total $5' else 'Short head' end from pages union all select page_id, 4, 'table', '' from pages)"""
TELLING = r"(regexp_matches(text, '[$€£¥%]|\d') or len(regexp_extract_all(text, '[A-Za-z0-9]+')) >= 6)"
NUMBERED = r"(trim(lower(text), ' -–—|·•') = '' or regexp_full_match(trim(lower(text), ' -–—|·•'), '(page\s*)?\d{1,4}(\s*(of|/)\s*\d{1,4})?') or regexp_full_match(trim(lower(text), ' -–—|·•'), '[ivxlcdm]{1,8}'))"


@query(rf"""select doc_id, printf('%s_p001_b%04d', doc_id::varchar, idx + 1) as block_id, case type when 'table' then 'table' else 'text' end as block_type, trim(regexp_replace(text, '\s+', ' ', 'g')) as text, type in ('header', 'footer', 'page_number') and ({NUMBERED} or not {TELLING}) as is_boilerplate from items
where trim(text) <> '' or (type in ('header', 'footer', 'page_number') and ({NUMBERED} or not {TELLING}))""", ITEMS)
def boilerplate_flags(spark, sf_dir):
    p = X.table(spark, sf_dir, "pages")
    head = F.when(F.col("page_id") % 3 == 0, "one two three four five six").when(F.col("page_id") % 3 == 1, "Total $5").otherwise("Short head")
    texts = (("title", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)), ("footer", F.substring(F.regexp_extract("html", '<li><a href="[^"]*">([^<]*)</a>', 1), 1, 200)), ("page_number", (F.col("page_id") % 50).cast("string")), ("header", head), ("table", F.lit("")))
    items = p.select(F.col("page_id").alias("doc_id"), F.posexplode(F.array(*[F.struct(F.lit(k).alias("type"), t.alias("text")) for k, t in texts])).alias("idx", "item"))
    rows = items.select("doc_id", "idx", "item.type", "item.text", F.lit(0).alias("page_idx"), F.array(F.lit(0.0)).alias("bbox"))
    return S.content_blocks(rows).select("doc_id", "block_id", "block_type", "text", "is_boilerplate")
