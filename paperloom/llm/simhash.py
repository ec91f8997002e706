"""SimHash near-duplicates: fingerprints, a byte-position inverted index with count filtering, components.

Fingerprints of 64 bits have eight bytes. Two within four bits differ in at most four bytes, so they
share at least four positional bytes (position, value). A list per positional byte would hold 1/256 of
the corpus, and tallying pairs from such lists grows with its square; the index therefore keys its lists
by four positional bytes at once (the 70 intersections of lists that a pair at the minimum can meet in).
Each pair that meets is tallied (its shared positional bytes counted), kept at four or more, and verified
bit by bit. A pair that meets in many lists counts in the first one only.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHINGLE = 4
RADIUS = 4
BYTES = 8
SHARED = BYTES - RADIUS
COMBOS = list(combinations(range(BYTES), SHARED))
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if set in over half of the shingles' XXH64 hashes (seed 42); no words: 0."""
    from xxhash import xxh64_intdigest as xxh64

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    starts = starts.tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):  # bounded memory for very long texts
        j = min(n, i + BLOCK)
        hashes = np.fromiter([xxh64(whole[a:b], 42) for a, b in zip(starts[i:j], last[i:j], strict=True)], np.uint64, j - i)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and signed 64-bit fingerprint of every row of docs (doc_id, text). Null and empty texts: 0."""

    def mark(batch) -> dict:
        return {"fp": np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)}

    return common.map_rows(common.pick(docs, doc_id="long", text="string"), "doc_id long, fp long", lambda: mark)


def byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255).cast("long"))


def mask_of(combo: tuple[int, ...]) -> int:
    """Signed 64-bit mask of the bytes at these positions."""
    return int.from_bytes(sum(255 << 8 * i for i in combo).to_bytes(8, "little"), "little", signed=True)


def longs(values: list[int]) -> Column:
    """A literal array."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def list_key(mask: Column, fp: Column) -> Column:
    return F.xxhash64(mask, fp.bitwiseAND(mask))


def list_keys(fp: Column) -> Column:
    """The keys of the 70 lists that a fingerprint stands in."""
    return F.transform(longs([mask_of(c) for c in COMBOS]), lambda mask: list_key(mask, fp))


def shared_bytes(x: Column) -> Column:
    """Tally of positional bytes that two fingerprints share; x: their XOR."""
    return reduce(lambda a, b: a + b, [F.when(byte(x, i) == 0, 1).otherwise(0) for i in range(BYTES)])


def first_list(a: Column, b: Column) -> Column:
    """The key of the first list that the pair shares: that of its first four shared positions."""
    x = a.bitwiseXOR(b)
    same = reduce(lambda p, q: p + q, [F.when(byte(x, i) == 0, 1 << i).otherwise(0) for i in range(BYTES)])
    firsts = [next((mask_of(c) for c in COMBOS if all(shared >> i & 1 for i in c)), 0) for shared in range(1 << BYTES)]
    return list_key(F.get(longs(firsts), same), a)


def linked(x: Column) -> Column:
    return (F.bit_count(x) <= RADIUS) & (shared_bytes(x) >= SHARED)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) of every node of edges (a, b), a <> b; no driver-side links.

    Alternates large-star and small-star rounds (every neighbour is moved to the smallest node around),
    each written to the shared folder, until only stars are left.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.union(e.select("b", "a"))  # small: a is the larger end
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", (F.col("m") if small else F.least("a", "m")).alias("m"))
        moved = both.join(least, "a")
        moved = (moved if small else moved.where("b > a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if small:
            moved = moved.union(least.select("a", F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    def settled(e: DataFrame) -> bool:
        """Every node either has one link, to a smaller node, or is linked to only."""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("b", F.lit(0), F.lit(1)))
        return not ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1").take(1)

    now = common.materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    rounds = 0
    while not settled(now):
        if rounds == max_rounds:
            raise RuntimeError(f"components have not settled after {max_rounds} rounds")
        after = common.materialise(star(star(now, small=False), small=True))
        common.release(now)
        now, rounds = after, rounds + 1
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def near_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that join the same fingerprints as all links within
    the radius do, without all pairs of a large group.

    In each list every fingerprint is compared with the smallest one and the one before it: as many
    links as entries. Their components come next; then, list by list, fingerprints outside the
    largest component present are compared with those of other components. Pairs inside a component are
    connected already and are never made.
    """
    lists = classes.select("fp", F.explode(list_keys(F.col("fp"))).alias("key"))
    ordered = Window.partitionBy("key").orderBy("fp")
    seen = lists.select("fp", F.first("fp").over(ordered).alias("low"), F.lag("fp").over(ordered).alias("before"))
    pairs = seen.select(F.col("fp").alias("a"), F.explode(F.array("low", "before")).alias("b")).where("b is not null and a <> b")
    chains = common.materialise(pairs.where(linked(F.col("a").bitwiseXOR(F.col("b")))).distinct())
    joined = common.materialise(components(chains).withColumnsRenamed({"node": "fp", "component": "comp"}))
    sizes = joined.groupBy("comp").agg(F.count("*").alias("size"))
    known = classes.select("fp").join(joined.join(sizes, "comp"), "fp", "left")
    known = known.select("fp", F.coalesce("comp", "fp").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"))
    placed = known.select("fp", "comp", "size", F.explode(list_keys(F.col("fp"))).alias("key"))
    largest = Window.partitionBy("key").orderBy(F.desc("size"), "comp")
    outside = placed.withColumn("top", F.first("comp").over(largest)).where("comp <> top").select("key", F.col("fp").alias("a"), F.col("comp").alias("ca"))
    others = placed.select("key", F.col("fp").alias("b"), F.col("comp").alias("cb"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    between = outside.join(others, "key").where((F.col("ca") != F.col("cb")) & linked(x)).where(first_list(F.col("a"), F.col("b")) == F.col("key"))
    return chains.unionByName(between.select("a", "b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id that links lead to. Rows with the same fingerprint are one class
    from the start (copies are never paired); null and empty texts share fingerprint 0 and link like any
    other. Null doc_ids keep their rows and count in no minimum. An empty table gives an empty one.
    """
    marked = common.materialise(fingerprints(docs))
    classes = common.materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    joined = components(near_links(classes)).withColumnsRenamed({"node": "fp", "component": "comp"})
    named = classes.join(joined, "fp", "left").select("fp", "rep", F.coalesce("comp", "fp").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    return marked.join(named.join(smallest, "comp").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is its component's smallest, one row of each group; all columns stay.

    Repeated rows (equal doc_id and text) are copies: one stays. Rows without a doc_id can't be told apart: they stay.
    """
    found = near_duplicates(docs)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    stay = docs.join(kept, F.col("doc_id") == F.col("__kept"), "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.unionByName(docs.where("doc_id is null"))


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
