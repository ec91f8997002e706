import random

import corpus_pipeline
from paperloom.llm import shingles
from pyspark.sql import functions as F

from .test_simhash import slow_fingerprint


def own(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(rows):
    """The ids that stay, all pairs."""
    sets, boss = [own(t or "") for _, t in rows], list(range(len(rows)))

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) > 0:
                boss[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return set(least.values())


def test_stage_against_all_pairs(spark, hard):
    rng = random.Random(3)
    bases = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 9) for _ in range(rng.randint(3, 160))] for _ in range(25)]
    rows = [(-1, ""), (-2, None), (-3, " ")]
    for doc_id in range(220):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((doc_id, " ".join(words)))
    want = slow_kept(rows)
    assert 25 < len(want) < 200
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(want)


def test_fingerprints_link_without_the_join(spark, monkeypatch):
    """Near copies go by SimHash even where no shingle's list may compare them."""
    rng = random.Random(5)
    apart = 9
    while apart > 4:
        words = ["".join(rng.choices("abcdefghinorst", k=rng.randint(3, 8))) for _ in range(300)]
        near = [" ".join(words), " ".join([*words[:-1], "otherword"])]
        apart = (slow_fingerprint(near[0]) ^ slow_fingerprint(near[1])).bit_count()
    rows = [(1, near[0]), (2, near[1]), (3, "".join(rng.choices("klmu vwz", k=900)))]
    monkeypatch.setattr(shingles, "fits", lambda *_: F.lit(False))
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in got) == [1, 3]
