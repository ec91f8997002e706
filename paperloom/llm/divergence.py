"""Source divergence audit: how far the sources of a language differ in their terms, pair by pair, and which terms mark a source.

Probabilities and divergences are whole numbers, so sums don't depend on the order of addition. Most terms are absent from most
sources; an absent term has the source's baseline probability. The sum over all kept terms for two sources is therefore

    terms * f(base, base)                              as if no term occurred in either
    + per source: sum over its terms of f(p, base) - f(base, base)    a term counts by its number of occurrences alone, so a histogram of these does
    + sum over the terms that occur in both of f(p, p) - f(p, base) - f(base, p) + f(base, base)

and only the last part meets pairs of rows, one a term and pair of sources that both hold it.

The marking terms of each source are ranked by radix-select (radix.top).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, radix

MIN_DOCUMENTS = 10
TOP = 10
SALTS = 64
#: Entries that a task counts before it hands them on.
HELD = 1 << 18
#: A-Z become lower case; the other ASCII characters that are no letters become spaces; bytes from 128 on stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, df: partial counts of occurrences and documents; and a row with a null term for each group seen.

    docs: lang, source, text. A task holds at most about HELD entries and one document's words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                terms = [None, *n]
                columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(df[t] for t in n)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "df"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
                n, df = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                words = text.as_py().translate(LETTERS).split()
                size -= len(n)
                n.update(words)
                df.update(set(words))
                size += len(n) + 1
                if size > HELD:
                    yield from flushed()
                    size = 0
        yield from flushed()

    texts = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "lang string, source string, term binary, n long, df long").withColumn("term", F.col("term").cast("string"))


def chance(n: str, total: str) -> Column:
    return F.expr(f"1 + (cast({n} + 2 as decimal(19,0)) * cast(1000000000 as decimal(19,0))) div cast({total} as decimal(19,0))")


def apart(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)): p and q are at most 1,000,000,001, so the square is a long."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of docs (lang, source, text); null text, lang and source are empty.

    Part `pair`: item is each other source of the language, value their divergence, all ranks. Part `term`: item is a kept term that
    the source uses more than the language does, the `top` ones. Kept are the terms in at least min_documents documents of the language
    (repeated rows count as documents). A group without terms has the baseline for every term; a language without kept terms has
    pairs of value 0. An empty table gives an empty one.
    """
    texts = common.pick(docs, lang="string", source="string", text="string").fillna("")
    by_term = Window.partitionBy("lang", "term")
    summed = counted(texts).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    summed = summed.withColumns({"docs": F.sum("df").over(by_term), "all": F.sum("n").over(by_term), "leads": F.col("source") == F.min("source").over(by_term)})
    kept = common.materialise(summed.where(F.col("term").isNull() | (F.col("docs") >= min_documents)).select("lang", "source", "term", "n", "all", "leads"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count_if(F.col("leads") & F.col("term").isNotNull()).alias("led"))
    sizes = common.materialise(sizes)
    langs = sizes.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.sum("led").alias("terms"))
    groups = sizes.join(langs, "lang").select("lang", "source", (F.col("size") + 2 * F.col("terms")).alias("total"), (F.col("lang_size") + 2 * F.col("terms")).alias("lang_total"), "terms")
    groups = common.materialise(groups.withColumn("base", F.when(F.col("terms") > 0, chance("0", "total")).otherwise(1)))
    terms = kept.where("term is not null").join(groups.select("lang", "source", "total", "lang_total", "base"), ["lang", "source"])
    terms = common.materialise(terms.select("lang", "source", "term", "n", chance("n", "total").alias("p"), chance("`all`", "lang_total").alias("q"), "base"))
    common.release(kept)

    marking = common.materialise(terms.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(apart("p", "q")).alias("value")))
    best = radix.top(marking, ["lang", "source"], "value", "item", top)

    first, second = (groups.select("lang", "terms", *[F.col(c).alias(f"{c}_{end}") for c in ("source", "base")]) for end in "ab")
    pairs = first.join(second.drop("terms"), "lang").where("source_a < source_b").select("lang", "source_a", "source_b", F.expr(f"terms * {apart('base_a', 'base_b')}").alias("value"))

    alone = terms.groupBy("lang", "source", "n", "p", "base").agg(F.count("*").alias("times"))
    salt = F.pmod(F.xxhash64("source", "n"), F.lit(SALTS)).cast("int")
    others = groups.select("lang", F.col("source").alias("other"), F.col("base").alias("other_base"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = alone.withColumn("salt", salt).join(others, ["lang", "salt"]).where("source <> other")
    single = met.select("lang", F.least("source", "other").alias("source_a"), F.greatest("source", "other").alias("source_b"), F.expr(f"times * ({apart('p', 'other_base')} - {apart('base', 'other_base')})").alias("value"))

    one, two = (terms.select("lang", "term", *[F.col(c).alias(f"{c}_{end}") for c in ("source", "p", "base")]) for end in "ab")
    joint = F.expr(f"{apart('p_a', 'p_b')} - {apart('p_a', 'base_b')} - {apart('base_a', 'p_b')} + {apart('base_a', 'base_b')}")
    both = one.join(two, ["lang", "term"]).where("source_a < source_b").select("lang", "source_a", "source_b", joint.alias("value"))

    # The parts are summed on their own before they meet: a pair's rows are few then.
    sums = [part.groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value")) for part in (single, both)]
    value = common.materialise(pairs.unionByName(sums[0]).unionByName(sums[1]).groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value")))
    apart_ = value.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value").union(value.select("lang", "source_b", "source_a", "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    found = apart_.withColumn("rank", rank)
    return found.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").union(best.select("lang", "source", F.lit("term"), "item", "value", "rank"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))


def oracle() -> str:
    f = "(({0} - {1}) * ({0} - {1})) // ({0} + {1})".format
    return f"""
with plain as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x60\\x7B-\\x7F]+') as words from documents),
words as (select id, lang, source, unnest(words) as term from plain),
kept as (select lang, term from words group by all having count(distinct id) >= {MIN_DOCUMENTS}),
counts as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by all),
groups as (select distinct lang, source from plain),
vocabulary as (select lang, count(*) as v from kept group by lang),
sizes as (select g.lang, g.source, coalesce(sum(n), 0) as size, any_value(coalesce(v, 0)) as v from groups g left join counts c using (lang, source) left join vocabulary using (lang) group by all),
lang_terms as (select lang, term, sum(n) as n, any_value(total) as total from counts join (select lang, sum(size) + 2 * any_value(v) as total from sizes group by lang) using (lang) group by all),
p as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (s.size + 2 * s.v) as p
  from sizes s join kept k on k.lang = s.lang left join counts c on c.lang = s.lang and c.source = s.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source as item, sum({f('a.p', 'b.p')}) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (select a.lang, a.source, b.source as item, coalesce(value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
q as (select lang, term, 1 + 1000000000 * (n + 2) // total as q from lang_terms),
terms as (select lang, source, term as item, {f('p', 'q')} as value from p join q using (lang, term) where n > 0 and p > q),
found as (select lang, source, 'pair' as part, item, cast(value as bigint) as value, row_number() over (partition by lang, source order by value desc, item) as rank from every
  union all select lang, source, 'term', item, cast(value as bigint), row_number() over (partition by lang, source order by value desc, item) from terms)
select lang, source, part, item, value, cast(rank as integer) as rank from found where part = 'pair' or rank <= {TOP}"""
