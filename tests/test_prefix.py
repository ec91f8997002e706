"""Running totals by ranges, and the choice of windows, against plain Python."""

import hashlib
import random

from paperloom.operators import prefix, training
from pyspark.sql import functions as F


def test_running_against_a_loop(spark):
    rng = random.Random(1)
    for kind, keys in (("long", [rng.choice([None, 5, rng.randrange(10**9)]) for _ in range(500)]), ("string", [rng.choice([None, "", "a", "ä", f"k{rng.randrange(999)}"]) for _ in range(500)]), ("double", [])):
        rows = [(k, i, rng.choice([None, 0, 3, -2])) for i, k in enumerate(keys)]
        got = prefix.running(spark.createDataFrame(rows, f"k {kind}, i long, v long"), "k", ["i"], F.coalesce("v", F.lit(0)), "upto", ranges=16)
        got = prefix.running(got, "k", ["i"], name="rank", ranges=16).collect()
        rows.sort(key=lambda r: (r[0] is not None, (r[0].encode() if kind == "string" else r[0]) if r[0] is not None else 0, r[1]))
        total, want = 0, {}
        for n, (_, i, v) in enumerate(rows, 1):
            total += v or 0
            want[i] = (total, n)
        assert {r.i: (r.upto, r["rank"]) for r in got} == want


def slow_windows(rows, target, most, seed):
    chosen, total, counts = [], 0, {}
    for key, bucket, size, _, fixed in rows:
        if fixed:
            total, counts[bucket] = total + size, counts.get(bucket, 0) + 1
    waiting = [r for r in rows if not r[4]]
    while total < target:
        fitting = [r for r in waiting if total + r[2] <= most]
        if not fitting:
            break
        best = min(fitting, key=lambda r: (counts.get(r[1], 0), not r[3], hashlib.sha256(f"{seed}\0{r[0]}".encode()).hexdigest(), r[0]))
        waiting.remove(best)
        chosen.append(best[0])
        total, counts[best[1]] = total + best[2], counts.get(best[1], 0) + 1
    return chosen


def test_windows_against_one_at_a_time(spark):
    rng = random.Random(2)
    for target, most in ((60, 62), (200, 205), (0, 10), (10**6, 10**6), (40, 40)):
        rows = [(i, rng.choice("aab"), rng.randint(0, 9), rng.random() < 0.4, rng.random() < 0.05) for i in range(90)]
        given = spark.createDataFrame(rows, "k long, b string, n long, p boolean, f boolean")
        got = training.windows_to_target(given, "k", "b", "n", "p", "f", target, most, "s").collect()
        assert [r.k for r in sorted((r for r in got if r.place), key=lambda r: r.place)] == slow_windows(rows, target, most, "s")
        assert {r.k for r in got if r.place is None} == {r[0] for r in rows if r[4]}


def test_split_shares(spark):
    parts = spark.range(20_000).select(training.split_by_key(F.col("id"), "s").alias("p")).groupBy("p").count()
    assert {r.p: round(r["count"] / 20_000, 2) for r in parts.collect()} == {"train": 0.8, "dev": 0.1, "test": 0.1}


def test_holding_against_every_pair(spark):
    from paperloom.operators import retrieval

    rng = random.Random(3)
    words = ["a", "b", "ab", "ba", "c.", "ü", "b,"]
    texts = [(i, rng.choice([" ", "  ", "\n"]).join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(80)] + [(80, None), (81, "")]
    parts = [(i, " ".join(rng.choices(words, k=rng.randint(1, 7)))[rng.randint(0, 1) :]) for i in range(120)] + [(120, None), (121, " "), (122, "b a")]
    want = {(t, p) for t, text in texts for p, part in parts if part and part.strip(" ") and text is not None and part in text}
    for least in (0, 10**6):
        few, retrieval.few = retrieval.few, lambda df, rows=0, least=least: least > 0
        try:
            got = retrieval.holding(spark.createDataFrame(texts, "t long, text string"), spark.createDataFrame(parts, "p long, part string"), "t", "text", "p", "part")
            assert {(r.t, r.p) for r in got.collect()} == want
        finally:
            retrieval.few = few


def test_backfill_a_row_at_a_time():
    rng = random.Random(4)
    for _ in range(200):
        quotas, have, total = {k: rng.randint(0, 9) for k in "abcd"}, {k: rng.randint(0, 15) for k in "abc"}, rng.randint(0, 60)
        want = {k: min(q, have.get(k, 0)) for k, q in quotas.items()}
        while sum(want.values()) < total and any(have.get(k, 0) > want[k] for k in want):
            for k in sorted(want):
                if sum(want.values()) < total and have.get(k, 0) > want[k]:
                    want[k] += 1
        assert training.backfilled(quotas, have, total) == want
