import random

import pytest
from paperloom.llm import urls

RULES = urls.DEFAULT_RULES


def slow(url, rules=RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    for mark in "#?":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = slash + path
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


HARD = [None, "", "example.com/en/1", "://", "http://", "http://example.com", "HTTP://WWW.Example.COM/en/7", "http://example.com/en/7198?x=/de/", "http://example.com?x=://net/de/", "http://a.example.net/de/80", "http://example.net/de/8", "http://example.net/de/9#f", "http://xcom/en/1", "http://com/en/", "http://com/en", "http://example.org./es/1", "ftp://É.Example.org/es/é", "http://u:p@example.com:80/en/1", "http://a..com/en/x", "a://b://com/en/", "http:///en/", "http://net/de/", "http://example.com/EN/1", "http://x.com/en/ y"]


def judged(spark, rows, rules=None):
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, key string, keys string, rule string, best string")
    return sorted((r.page_id if r.page_id is not None else -1, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules).collect())


def test_hard_urls(spark):
    rows = [(i, u, *["x"] * 6) for i, u in enumerate(HARD)]
    assert judged(spark, rows) == [(i, *slow(u)) for i, u in enumerate(HARD)]


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, HARD[6], *["x"] * 6)] * 2 + [(1, HARD[9], *["x"] * 6)] * 3
    assert judged(spark, rows) == [(-1, *slow(HARD[6]))] * 2 + [(1, *slow(HARD[9]))] * 3
    assert judged(spark, []) == []


def test_many_rules(spark):
    rng = random.Random(4)
    hosts, paths = ["com", "org", "a.com", "b.a.com", "c.org"], ["/", "/x", "/x/y", "/xy/", "/x/y/z"]
    rules = tuple({(h, p): (rng.choice(("allow", "block")), h, p) for h in hosts for p in paths if rng.random() < 0.7}.values())
    found = [f"http://{rng.choice(['', 'q.', 'b.', 'b.a.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'y', '/z'])}" for _ in range(200)]
    assert judged(spark, [(i, u, *["x"] * 6) for i, u in enumerate(found)], urls.rules_table(spark, rules)) == [(i, *slow(u, rules)) for i, u in enumerate(found)]
    assert {v for *_, v in judged(spark, [(1, found[0], *["x"] * 6)], urls.rules_table(spark, ()))} == {"allow"}


def test_rules_with_spaces(spark):
    rules = (("block", "com", "/x y/"), ("allow", "a b.com", "/x y/z "))
    found = ["http://q.com/x y/1", "http://a b.com/x y/z 1", "http://a b.com/x", "http://com/x%20y/"]
    assert judged(spark, [(i, u, *["x"] * 6) for i, u in enumerate(found)], urls.rules_table(spark, rules)) == [(i, *slow(u, rules)) for i, u in enumerate(found)]


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(30_000).selectExpr("concat('key ', id) as key")
    listed = spark.range(0, 30_000, 37).selectExpr("concat('key ', id) as key")
    levels = urls.cascade(listed, universe)
    found = universe.where(urls.member(universe["key"], levels))
    assert found.exceptAll(listed).count() == 0 and listed.exceptAll(found).count() == 0
    assert len(levels) > 1 and sum(len(x.words) for x in levels) * 8 < 30_000 / 8  # a sixth of a bit for each key would not do alone


def test_size_bound(spark):
    listed = spark.range(1000).selectExpr("cast(id as string) as key")
    with pytest.raises(ValueError):
        urls.cascade(listed, listed, max_bytes=8)
