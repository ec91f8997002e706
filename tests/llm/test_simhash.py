import random

import numpy as np
import xxhash
from paperloom.llm import simhash
from pyspark.sql import functions as F


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    own = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if own and 2 * sum(h >> b & 1 for h in hashes) > len(own))


def slow_components(prints):
    """Smallest id reachable for each (id, fingerprint), all pairs."""
    boss = list(range(len(prints)))

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                boss[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(prints):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [least.get(find(i)) for i in range(len(prints))]


def test_fingerprint_matches_plain_definition():
    for text in (None, "", " \t", "One", "A b C", "Àé Big\x0bNEWS of the day\x0c, the news of the DAY " * 7, "x\xa0y z"):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_spark_hash_agrees(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("the news of the")).alias("h")).first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"the news of the", 42)


def links_of(spark, prints):
    signed = [(i, int(np.uint64(p).astype(np.int64))) for i, p in prints]
    classes = spark.createDataFrame(signed, "doc_id long, fp long").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    joined = simhash.components(simhash.near_links(classes)).withColumnsRenamed({"node": "fp", "component": "comp"})
    named = classes.join(joined, "fp", "left").select("fp", "rep", F.coalesce("comp", "fp").alias("comp"))
    least = named.join(named.groupBy("comp").agg(F.min("rep").alias("least")), "comp").select("fp", "least")
    found = {r.fp: r.least for r in least.collect()}
    return [found[fp] for _, fp in signed]


def test_components_match_all_pairs(spark):
    rng = random.Random(1)
    prints = []
    for _ in range(12):  # chains and clouds around twelve centres
        at = rng.getrandbits(64)
        for _ in range(25):
            near = at
            for _ in range(rng.randint(0, 6)):
                near ^= 1 << rng.randrange(64)
            prints.append((len(prints), near))
            if rng.random() < 0.3:
                at = near
    assert links_of(spark, prints) == slow_components(prints)


def test_long_chain(spark):
    at, prints = 0, []
    for i in range(16):
        prints.append((100 - i, at))
        at |= 0b1111 << 4 * i
    assert links_of(spark, prints) == [85] * 16


def test_hard_rows(hard, clashing):
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(hard).collect()]
    prints = [(r.doc_id, slow_fingerprint(r.text)) for r in hard.collect()]
    want = [(i, int(np.uint64(p).astype(np.int64)), c) for (i, p), c in zip(prints, slow_components(prints), strict=True)]
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x) for x in r))
    assert order(got) == order(want)
    assert order([tuple(r) for r in simhash.near_duplicates(clashing).collect()]) == order(want)


def test_keep_first_keeps_one_of_each_group(hard, clashing):
    for docs in (hard, clashing):
        kept = simhash.keep_first(docs)
        assert kept.columns == docs.columns
        ids = [r.doc_id for r in kept.collect()]
        assert ids.count(1) == 1 and 2 not in ids and ids.count(None) == 2


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0
