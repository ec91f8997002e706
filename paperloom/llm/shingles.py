"""Near-duplicates by SimHash, held to an exact Jaccard similarity of word shingles; a join of shingles finds those that fingerprints miss.

Texts with equal shingle sets are one class. SimHash links come first (simhash.near_links); those whose sets are similar enough stay.
Shingles are ordered by rarity; two sets with a similarity of 0.8 or more share one among the first fifth of each. A pass over the
sorted lists of those drops the entries that meet none they fit. As in simhash.near_links, every class left in a list meets its first
class and the one before it; after that only classes of different components meet. Classes that SimHash has joined aren't compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays, common, lines, simhash

SHINGLE = 5


def shingles(texts: list[str | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle, repeats included: words as str.lower().split() has them; under `shingle` words: all of them."""
    words, row = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for portion in arrays.portions(texts):
        rows, _, pieces = zip(*portion, strict=True)
        found, line = arrays.hashed(list(pieces))
        upto = np.cumsum([piece.count("\n") + 1 for piece in pieces])
        words.append(found)
        row.append(np.array(rows)[np.searchsorted(upto, line, side="right")])
    words, row = np.concatenate(words), np.concatenate(row)

    def joined(first: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(first), n, np.uint64)
        for k in range(n):
            out = arrays.mixed(out ^ words[first + k], 5)
        return out

    starts = np.flatnonzero(np.diff(row, prepend=-1))
    lengths = np.diff(starts, append=len(row))
    whole = np.arange(max(0, len(row) - shingle + 1))
    whole = whole[row[whole] == row[whole + shingle - 1]]
    hashes, rows = [joined(whole, shingle)], [row[whole]]
    for n in range(1, shingle):
        short = starts[lengths == n]
        hashes.append(joined(short, n))
        rows.append(row[short])
    return np.concatenate(hashes), np.concatenate(rows)


def sets(texts: list[str | None], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles as numbers, by row, rarest first; the rows that have any; their starts and lengths."""
    keys, row = arrays.sets(*shingles(texts), bits)
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    return keys, row[starts], starts, np.diff(starts, append=len(keys))


def digests(docs: DataFrame, bits: Broadcast) -> DataFrame:
    """doc_id, mark (a hash of the text), node (a hash of the shingle set, 0: no words), n, fp (SimHash) and prefix of every row of docs (doc_id, mark, text)."""

    def digest(batch) -> dict:
        texts = batch.column("text").to_pylist()
        keys, rows, starts, n = sets(texts, bits.value)
        fp = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
        nodes, sizes, first = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        if len(rows):
            nodes[rows] = np.add.reduceat(arrays.mixed(keys, 6), starts).view(np.int64)
        sizes[rows], first[rows] = n, starts
        return {"node": nodes, "n": sizes.astype(np.int32), "fp": fp, "prefix": arrays.ragged(keys, first, np.where(sizes > 0, sizes - (4 * sizes + 4) // 5 + 1, 0))}

    return common.map_rows(docs, "doc_id long, mark long, node long, n int, fp long, prefix array<long>", lambda: digest, rows=256)


def fits(n: str, i: str, m: str, j: str):
    """Length and positional filter of the first shared shingle, at place i of n and place j of m."""
    return F.expr(f"5 * least({n}, {m}) >= 4 * greatest({n}, {m}) and least({n} - {i}, {m} - {j}) >= (4 * ({n} + {m}) + 8) div 9")


def words_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, bits: Broadcast) -> DataFrame:
    """node and its shingles, read from docs, of the nodes."""
    wanted = nodes.distinct().join(classes.select("node", "mark"), "node")
    texts = docs.select("mark", "text").join(wanted, "mark").dropDuplicates(["node"]).select("node", "text")

    def read(batch) -> dict:
        keys, rows, starts, n = sets(batch.column("text").to_pylist(), bits.value)
        first, sizes = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
        first[rows], sizes[rows] = starts, n
        return {"keys": arrays.ragged(keys, first, sizes)}

    return common.map_rows(texts, "node long, keys array<long>", lambda: read, rows=256)


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough."""
    both = pairs.join(words.toDF("a", "x"), "a").join(words.toDF("b", "y"), "b")
    return common.materialise(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"))


def alike(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that SimHash links: those of one fingerprint with its first, and the first ones of linked fingerprints."""
    groups = common.materialise(classes.groupBy("fp").agg(F.min("node").alias("a")))
    same = classes.select("fp", F.col("node").alias("b")).join(groups, "fp").where("a <> b").select("a", "b")
    pairs = simhash.near_links(groups).toDF("fa", "fb")
    named = pairs.join(groups.toDF("fa", "x"), "fa").join(groups.toDF("fb", "y"), "fb").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.union(named.distinct())


def links(classes: DataFrame, docs: DataFrame, bits: Broadcast) -> DataFrame:
    """Links (a, b) that join the same nodes as all pairs of similar sets do; classes: node, mark, n, fp, prefix."""
    every = classes.select("node", "n", F.posexplode("prefix").alias("i", "key"))
    entries = common.materialise(arrays.open_entries(every.select("key", "node", "n", "i", F.expr("0L").alias("p"), F.expr("0L").alias("q"))).drop("p", "q"))
    words = common.materialise(words_of(entries.select("node"), classes, docs, bits))
    near = verified(alike(classes), words)  # who isn't in entries is similar to none
    known = common.materialise(simhash.components(near).toDF("node", "comp"))

    ordered = Window.partitionBy("key", F.pmod(F.xxhash64("node"), F.lit(lines.SALTS))).orderBy("node")
    names = ("node", "n", "i", "comp")
    own = F.struct(*names)
    placed = entries.join(known, "node", "left").select("key", "node", "n", "i", F.coalesce("comp", "node").alias("comp"))
    met = placed.select(*names, F.array(F.first(own).over(ordered), F.lag(own).over(ordered)).alias("others"))
    met = met.select(*names, F.explode("others").alias("o")).select(*names, F.col("o.node").alias("a"), F.col("o.n").alias("m"), F.col("o.i").alias("j"), F.col("o.comp").alias("ca"))
    met = met.where((F.col("a") < F.col("node")) & (F.col("ca") != F.col("comp")) & fits("n", "i", "m", "j")).select("a", F.col("node").alias("b")).distinct()
    chains = near.union(verified(met, words))

    joined = common.materialise(simhash.components(chains).toDF("node", "comp"))
    sizes = joined.groupBy("comp").agg(F.count("*").alias("size"))
    placed = entries.join(joined.join(sizes, "comp"), "node", "left").select("key", "node", "n", "i", F.coalesce("comp", "node").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"))
    placed = common.materialise(placed)
    tops = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.struct("size", "comp"))["comp"].alias("top")).where("low <> high").select("key", "top")
    mixed = common.materialise(placed.join(tops, "key"))
    common.release(placed)
    outside = mixed.where("comp <> top").select("key", F.col("node").alias("a"), "n", "i", F.col("comp").alias("ca"))
    others = mixed.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("comp").alias("cb"))
    between = outside.join(others, "key").where((F.col("ca") != F.col("cb")) & fits("n", "i", "m", "j"))
    far = verified(between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), words)
    for table in (mixed, joined, known, entries, words):
        common.release(table)
    return chains.union(far)


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, linked by similarities of 0.8 or more; one row of each group.

    Texts without words are one group. Repeated rows (equal doc_id and text) are copies: one stays. Rows without a doc_id stay.
    """
    plain = common.pick(docs, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("mark"), "text")
    bits = docs.sparkSession.sparkContext.broadcast(arrays.rarity(plain, lambda texts: shingles(texts)[0]))
    marked = common.materialise(digests(plain, bits))
    classes = common.materialise(marked.groupBy("node", "n", "prefix").agg(F.min("mark").alias("mark"), F.min("doc_id").alias("rep"), F.min("fp").alias("fp")))
    marked = marked.select("doc_id", "node")
    joined = simhash.components(links(classes.where("n > 0"), plain, bits)).toDF("node", "comp")
    named = classes.select("node", "rep").join(joined, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("least"))
    found = marked.select("doc_id", "node").join(named.join(smallest, "comp").select("node", "least"), "node")
    kept = found.where("doc_id = least").select(F.col("doc_id").alias("__kept")).distinct()
    stay = docs.join(kept, F.col("doc_id") == F.col("__kept"), "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.unionByName(docs.where("doc_id is null"))
