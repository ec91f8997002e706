import random
import re
from collections import Counter

import pytest
from paperloom.llm import divergence, radix


def slow_audit(rows, least, top):
    """rows: lang, source, text."""
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(w for d in docs if d[0] == lang for w in set(d[2]))
        kept = [w for w in df if df[w] >= least]
        counts = {s: Counter(w for d in docs if d[:2] == (lang, s) for w in d[2]) for s in {d[1] for d in docs if d[0] == lang}}
        every = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(every)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(-sum(f(p[s][w], p[t][w]) for w in kept), t) for t in counts if t != s]
            terms = [(-f(p[s][w], q[w]), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())), 1):
                    out.append((lang, s, part, item, -value, rank))
    return sorted(out)


def check(docs, least=10, top=10):
    rows = [(r.lang, r.source, r.text) for r in docs.select("lang", "source", "text").collect()]
    assert sorted(map(tuple, divergence.audit(docs, least, top).collect())) == slow_audit(rows, least, top)


def test_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    rng = random.Random(1)
    words = ["the", "The", "and", "é", "É", "ünd", "x-y", "don't", "日本", "\U0001f600", *(f"w{chr(97 + i % 26)}{'q' * (i // 26)}" for i in range(120))]
    rows = []
    for _ in range(500):
        lang = rng.choice(["en", "en", "de", None, "fr"])
        text = rng.choice([None, "", "1 2 3", " ".join(rng.choices(words, k=rng.randint(1, 60)) + rng.choices(words[:5], k=5))])
        rows.append((lang, rng.choice(["a", "a", "a", "b", "c", None, "ö"]), "" if lang == "fr" else text))
    check(spark.createDataFrame(rows, "lang string, source string, text string"))


def test_hard_rows(spark, hard, clashing, empty):
    check(hard, least=1)
    check(clashing, least=2)
    assert not divergence.audit(empty).collect()


@pytest.mark.parametrize("enough", [1, 8, 4096])
def test_top_by_radix(spark, enough):
    rng = random.Random(2)
    rows = [("tied", 7, "p" * 40 + f"{i:03}") for i in range(300)] + [("few", i, str(i)) for i in range(3)] + [("one", 5, "")]
    rows += [("wide", rng.choice([0, 1, 1 << 29, rng.randrange(1 << 30), (1 << 30) - 1]), f"ä{i}\U0001f600" if i % 2 else f"z{i}") for i in range(600)]
    rows += [("low", i // 60, "ab"[i % 2] * (i % 60)) for i in range(0, 600)]
    rows = list({(g, v, t): None for g, v, t in rows})
    rows = [(g, v, f"{t}{i}" if g == "low" else t) for i, (g, v, t) in enumerate(rows)]
    got = radix.top(spark.createDataFrame(rows, "g string, v long, t string"), ["g"], "v", "t", 10, enough=enough, bits=3)
    want = []
    for g in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:10]
        want += [(*r, k) for k, r in enumerate(best, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
