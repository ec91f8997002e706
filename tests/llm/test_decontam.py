import random
from collections import Counter

from paperloom.llm import decontam


def slow(text, items):
    """Every window of every item's size, by the definition."""
    words, found = decontam.words_of(text), {}
    for item_id, item in items:
        own = decontam.words_of(item)
        if len(own) < decontam.SHINGLE:
            if own and own == words:
                found[item_id] = 1.0
            continue
        want, n = Counter(decontam.shingles(own)), len(own)
        windows = [words[i : i + n] for i in range(max(1, len(words) - n + 1))]
        best = max(decontam.similarity(Counter(decontam.shingles(w)), want) for w in windows)
        if best >= decontam.THRESHOLD:
            found[item_id] = best
    return found


def test_search_matches_all_windows():
    rng, words = random.Random(1), [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(60)] + [(60, "w1 " * 40), (61, None), (62, "...")]
    index = decontam.Index(items)
    hits = 0
    for _ in range(300):
        item = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randint(0, 2)):
            if item:
                at = rng.randrange(len(item))
                item[at : at + rng.randint(0, 1)] = rng.choices(words, k=rng.randint(0, 2))
        text = " ".join([*rng.choices(words, k=rng.randint(0, 40)), *item, *rng.choices(words, k=rng.choice((0, 0, 40)))]).upper()
        got, want = {f[0]: f[3] for f in index.search(text)}, slow(text, items)
        assert got == want
        hits += len(want)
    assert hits > 100


def test_blocks_find_all_within_the_radius():
    rng = random.Random(2)
    items = [(i, " ".join(f"v{rng.randint(0, 500)}" for _ in range(20))) for i in range(300)]
    index = decontam.Index(items)
    for _ in range(200):
        at = rng.choice(index.prints)
        for _ in range(rng.randint(0, 30)):
            at ^= 1 << rng.randrange(64)
        assert sorted(index.within(20, at)) == [n for n, p in enumerate(index.prints) if (p ^ at).bit_count() <= decontam.RADIUS]


def test_similar_windows_are_within_the_radius():
    rng, far = random.Random(3), 0
    for _ in range(500):
        words = [f"t{rng.randint(0, 10**6)}" for _ in range(rng.randint(40, 60))]
        other = list(words)
        other[rng.randrange(len(words))] = "new"
        index = decontam.Index([(0, " ".join(words))])
        own = decontam.shingles(other)
        if decontam.similarity(Counter(own), index.counts[0]) >= decontam.THRESHOLD:
            far += (index.fingerprint(own) ^ index.prints[0]).bit_count() > decontam.RADIUS
    assert far == 0


def test_hard_rows(spark, hard, clashing, empty):
    items = spark.createDataFrame([(1, "the cat SAT on the mat, and the dog lay by the door"), (2, None), (3, ""), (4, "a"), (4, "a"), (None, "word " * 20), (5, "schön und")], "item_id long, text string")
    listed = [(r.item_id, r.text) for r in items.collect()]
    for docs in (hard, clashing):
        rows = decontam.search(docs, items).collect()
        assert len(rows) == 12
        want = sorted((str(r.doc_id), sorted(map(str, slow(r.text, listed)))) for r in docs.collect())
        assert sorted((str(r.doc_id), sorted({str(f.item_id) for f in r.found})) for r in rows) == want
        kept = decontam.keep_uncontaminated(docs, items)
        assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(i for i, found in want if not found)
    assert decontam.search(empty, items).count() == 0
    assert not decontam.search(hard, items.limit(0)).where("contaminated").count()
    assert decontam.keep_uncontaminated(hard, items.limit(0)).count() == 12


def test_items_in_blocks(spark, monkeypatch, medium):
    docs, items = (spark.read.parquet(f"{medium}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {r.doc_id: sorted(f.item_id for f in r.found) for r in decontam.search(docs, items).collect()}
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 15)
    assert {r.doc_id: sorted(f.item_id for f in r.found) for r in decontam.search(docs, items).collect()} == whole


def test_verbatim_passages_of_the_tables(spark, medium):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    found = {r.doc_id: set(r.item_ids) for r in decontam.op9_benchmark_decontamination(spark, medium).collect()}
    assert found.keys() == texts.keys()
    for doc_id, text in texts.items():
        assert found[doc_id] >= {i for i, item in items if item in text}
