"""URL filters: a Bloom filter cascade judges page addresses against block and allow rules.

Level 0 of the cascade encodes the listed keys; level 1 the keys of the corpus that level 0 lets
through wrongly; level 2 the listed keys that level 1 hits wrongly, and so on until nothing is wrong.
A key of the universe is listed if the first level that does not hold it is odd. Over the complete
key universe of the corpus this is exact, and judging a page is arithmetic on literals: no join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: verdict, host, path
DEFAULT_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    hashes: int
    seed: int

    @property
    def bits(self) -> int:
        return 64 * len(self.words)


def bit(key: Column, level_seed: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level_seed), F.lit(i)), F.lit(bits).cast("long"))


def has(key: Column, level: Level) -> Column:
    """True where the level's Bloom filter holds the key."""
    words = F.expr(f"cast(split('{','.join(map(str, level.words))}', ',') as array<bigint>)")  # folded to one literal
    found = F.lit(True)
    for i in range(level.hashes):
        at = bit(key, level.seed, i, level.bits)
        word = F.get(words, F.floor(at / 64).cast("int"))
        found &= F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return found


def encode(keys: DataFrame, n: int, share: float, seed: int, max_bytes: int) -> Level:
    """A Bloom filter of the n keys in column `key` with false positive share `share`."""
    import math

    hashes = max(1, round(math.log2(1 / share)))
    words = max(1, math.ceil(n * hashes / math.log(2) / 64))
    if words * 8 > max_bytes:
        raise ValueError(f"a level of {words * 8} bytes is over max_bytes={max_bytes}; split the list by a hash of the key")
    at = F.explode(F.array(*[bit(F.col("key"), seed, i, words * 64) for i in range(hashes)])).alias("at")
    rows = keys.select(at).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    found = {r["word"]: r["bits"] for r in rows.collect()}  # at most `words` rows
    return Level(tuple(found.get(i, 0) for i in range(words)), hashes, seed)


def cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = 8 << 20, max_levels: int = 40) -> list[Level]:
    """The levels for the keys `listed` (column key) against all keys of `universe` (column key).

    The first level's false positive share is |listed| / |universe|, so that every later level
    holds about as many keys as the list, however large the universe is. The filters grow with the
    list alone; `max_bytes` bounds each level that goes into the plan. Null keys are left out.
    """
    listed = common.materialise(listed.where("key is not null").select("key").distinct())
    n = listed.count()
    if not n:
        return []
    total = universe.agg(F.approx_count_distinct("key")).first()[0]
    levels = [encode(listed, n, min(0.5, n / max(1, total)), 0, max_bytes)]
    # The only pass over the universe; both sides below have about n keys.
    passed = universe.where(F.col("key").isNotNull() & has(F.col("key"), levels[0])).select("key").distinct()
    wrong, right = common.materialise(passed.join(listed, "key", "left_anti")), listed
    while (m := wrong.count()) and len(levels) < max_levels:
        levels.append(encode(wrong, m, 0.5, len(levels), max_bytes))
        wrong, right = common.materialise(right.where(has(F.col("key"), levels[-1]))), wrong
    if m:
        raise ValueError(f"{m} keys are still wrong after {max_levels} levels")
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """True where the key is listed; null keys aren't. Exact for keys of the cascade's universe."""
    found = F.lit(len(levels) % 2 == 1)
    for i, level in reversed(list(enumerate(levels))):
        found = F.when(~has(key, level), F.lit(i % 2 == 1)).otherwise(found)
    return F.coalesce(found & key.isNotNull(), F.lit(False))


def rules_table(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    """verdict, host, path of each rule, as a relation of literals."""
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1).select(F.inline(rows)) if rules else spark.range(0).selectExpr("'' verdict", "'' host", "'' path")


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.substring_index(F.expr("substr(url, locate('://', url) + 3)"), "#", 1))
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.substr(rest, F.length(host) + 1)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every host suffix (itself, its parent domains) joined to each path prefix of a rule's length."""
    labels = F.split(host, "[.]")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    paths = F.array_compact(F.array(*fitting)) if fitting else F.array().cast("array<string>")
    # A space can't be in a rule's host: it keeps host and path apart.
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, F.lit(" "), p))))


def judge(pages: DataFrame, rules: DataFrame | None = None, default: str = "allow", max_bytes: int = 8 << 20) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url).

    One cascade tells whether a key is any rule's, another whether it is a blocking rule's; the
    longest rule among a page's keys wins (of two equal rules that disagree, the blocking one). Where
    no rule fits, no cascade level holds any key and the verdict is `default`. Null urls and urls
    without :// have empty host and path; repeated rows are judged alike; an empty table gives none.
    Path prefixes are cut at the lengths that rules have, so the rules' lengths go to the driver:
    at most as many numbers as the longest path has characters.
    """
    spark = pages.sparkSession
    rules = common.pick(rules if rules is not None else rules_table(spark), verdict="string", host="string", path="string").where("host is not null and path is not null")
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    page = common.pick(pages, page_id="long", url="string")
    host, path = host_path(F.col("url"))
    parts = page.select("page_id", host.alias("host"), path.alias("path"))
    keyed = parts.select("*", candidate_keys(F.col("host"), F.col("path"), lengths).alias("keys"))
    universe = keyed.select(F.explode("keys").alias("key"))
    key = F.concat("host", F.lit(" "), "path").alias("key")
    ruled = cascade(rules.select(key), universe, max_bytes)
    blocking = cascade(rules.where("verdict = 'block'").select(key), universe, max_bytes)
    fits = F.filter("keys", lambda k: member(k, ruled)) if ruled else F.array().cast("array<string>")
    ranked = F.array_sort(F.transform(fits, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))
    best = keyed.select("page_id", "host", "path", F.try_element_at(ranked, F.lit(-1))["key"].alias("best"))
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(member(F.col("best"), blocking), "block").otherwise("allow")
    return best.select("page_id", "host", "path", F.regexp_replace("best", "^([^/]*) ", "$1").alias("rule"), verdict.alias("verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))


def oracle(rules=DEFAULT_RULES) -> str:
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
with rules(verdict, host, path) as (values {listed}),
rest as (select page_id, url, case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^#?]*') else '' end r from pages),
cut as (select page_id, coalesce(r, '') r, split_part(coalesce(r, ''), '/', 1) h from rest),
parts as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, substr(r, length(h) + 1) path, row_number() over () k from cut),
fits as (select k, rules.host || rules.path as rule, verdict, row_number() over (partition by k order by length(rules.host || rules.path) desc, verdict desc) n
  from parts join rules on (parts.host = rules.host or ends_with(parts.host, '.' || rules.host)) and starts_with(parts.path, rules.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join (select * from fits where n = 1) using (k)"""
