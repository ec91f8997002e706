"""Benchmark decontamination: item-sized windows, SimHash with multi-index Hamming blocks, exact verification.

A document holds an item if some window of as many words as the item has a weighted Jaccard similarity
of 0.8 or more with it, over five-word shingles counted with their repeats. Such a window shares a
shingle with the item, so windows are taken around the places where any item's shingle occurs; nothing
else can match. Each window's SimHash is looked up among the fingerprints of items of that size: with
eight blocks of one byte, two fingerprints within RADIUS bits agree within RADIUS // 8 bits in some block,
and probing every byte value that near in every block finds all of them. Candidates are then verified.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
THRESHOLD = 0.8
#: At a similarity of 0.8, two fingerprints differ in about 10 of 64 bits, with a deviation of 3.
RADIUS = 24
BLOCKS = 8
#: Items that travel to the executors at once; more make further passes over the documents.
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 32 << 20
FIELDS = ("item_id", "first_word", "n_words", "similarity")
FOUND = "array<struct<item_id: long, first_word: int, n_words: int, similarity: double>>"


def words_of(text: str | None) -> list[str]:
    import regex

    return regex.findall(r"[\p{L}\p{N}\p{M}_]+", text.lower()) if text else []


def shingles(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)


def near_bytes(radius: int) -> list[frozenset[int]]:
    """For each byte value all values within so many bits."""
    apart = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
    return [frozenset(np.flatnonzero(row <= radius).tolist()) for row in apart]


class Index:
    """Items' shingles with hashes, and for each item size a multi-index of their fingerprints."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.vocabulary: set[str] = set()
        self.whole: dict[str, list[int]] = defaultdict(list)  # items under one shingle match a whole text only
        self.weights: dict[str, int] = {}
        self.starts: set[str] = set()
        self.item_ids: list[int] = []
        self.counts: list[Counter] = []
        self.prints: list[int] = []
        self.sizes: list[int] = []
        self.blocks: dict[int, list[dict[int, list[int]]]] = {}
        self.holders: dict[str, set[int]] = defaultdict(set)  # sizes of the items that hold a shingle
        self.near = near_bytes(RADIUS // BLOCKS)
        for item_id, text in items:
            words = words_of(text)
            if len(words) < SHINGLE:
                if words:
                    self.whole[" ".join(words)].append(item_id)
                continue
            n, own = len(self.item_ids), shingles(words)
            self.item_ids.append(item_id)
            self.counts.append(Counter(own))
            self.sizes.append(len(words))
            self.vocabulary.update(words)
            for s in own:
                self.holders[s].add(len(words))
            self.prints.append(self.fingerprint(own))
            tables = self.blocks.setdefault(len(words), [defaultdict(list) for _ in range(BLOCKS)])
            for i, table in enumerate(tables):
                table[self.prints[n] >> 8 * i & 255].append(n)

    def bits(self, shingle: str) -> np.ndarray:
        from xxhash import xxh64_digest

        return np.unpackbits(np.frombuffer(xxh64_digest(shingle.encode("utf-8", "surrogatepass")), np.uint8)).astype(np.int32)

    def fingerprint(self, own: list[str]) -> int:
        return self.pack(sum((self.bits(s) for s in own), np.zeros(64, np.int32)), len(own))

    def pack(self, ones: np.ndarray, n: int) -> int:
        return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "little")

    def within(self, size: int, print_: int) -> list[int]:
        """All items of that size whose fingerprint is within RADIUS bits."""
        found = set()
        for i, table in enumerate(self.blocks[size]):
            close = self.near[print_ >> 8 * i & 255]
            for value in table if len(table) < len(close) else close:
                if value in close and value in table:
                    found.update(table[value])
        return [n for n in found if (self.prints[n] ^ print_).bit_count() <= RADIUS]

    def search(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best window of each item that the text holds."""
        words = words_of(text)
        best: dict[int, tuple[int, int, int, float]] = {}
        if len(words) < SHINGLE:
            key = " ".join(words)
            return [(i, 0, len(words), 1.0) for i in sorted(self.whole.get(key, ()), key=lambda i: (i is None, i))] if words else []
        known = np.fromiter(map(self.vocabulary.__contains__, words), bool, len(words))
        if known.sum() < SHINGLE:
            return []
        runs = np.convolve(known, np.ones(SHINGLE, np.int64), "valid") == SHINGLE
        hits = [(int(p), s) for p in np.flatnonzero(runs) if (s := " ".join(words[p : p + SHINGLE])) in self.holders]
        places: dict[int, set[int]] = defaultdict(set)
        for p, s in hits:
            for size in self.holders[s]:
                places[size].update(range(max(0, p - size + SHINGLE), min(p, len(words) - size) + 1))
                if len(words) < size:  # the item doesn't fit: the whole text is the window
                    places[size].add(0)
        for size, firsts in places.items():
            self.windows(words, size, sorted(firsts), best)
        return sorted(best.values(), key=lambda x: (x[0] is None, x[0]))

    def windows(self, words: list[str], size: int, firsts: list[int], best: dict) -> None:
        """Fingerprints of the windows by running sums over each stretch of neighbouring places."""
        n = min(size, len(words)) - SHINGLE + 1
        i = 0
        while i < len(firsts):
            j = i
            while j + 1 < len(firsts) and firsts[j + 1] == firsts[j] + 1 and j - i < 1 << 14:
                j += 1
            first, last = firsts[i], firsts[j]
            own = [" ".join(words[p : p + SHINGLE]) for p in range(first, last + n)]
            sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum([self.bits(s) for s in own], axis=0)))
            prints = sums[n:] - sums[:-n]
            counts = None
            for k in range(last - first + 1):
                candidates = self.within(size, self.pack(prints[k], n))
                if candidates:
                    counts = Counter(own[k : k + n])
                    for c in candidates:
                        close = similarity(counts, self.counts[c])
                        if close >= THRESHOLD and close > best.get(c, (0, 0, 0, 0.0))[3]:
                            best[c] = (self.item_ids[c], first + k, min(size, len(words)), close)
            i = j + 1


def blocks_of(items: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items (item_id, text) in blocks of a bounded size."""
    held, chars = [], 0
    for r in common.pick(items, item_id="long", text="string").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        chars += len(r["text"] or "")
        if len(held) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, contaminated, and found (item, first word, words, similarity) of every row of docs (doc_id, text).

    Words are lower-case runs of letters, digits and marks. An item under five words matches only a text
    of just these words; an item or text without words matches nothing. Repeated items are found each;
    repeated and null doc_ids are judged row by row. Items travel in blocks of bounded size, each a pass.
    """
    out = common.pick(docs, doc_id="long", text="string").withColumn("found", F.array().cast(FOUND))
    for block in blocks_of(items):
        index = Index(block)
        out = common.map_rows(out, f"doc_id long, text string, found {FOUND}", searcher(index))
    return out.select("doc_id", (F.size("found") > 0).alias("contaminated"), "found")


def searcher(index: Index):
    def add(batch) -> dict:
        before, texts = batch.column("found").to_pylist(), batch.column("text").to_pylist()
        return {"found": [[*old, *(dict(zip(FIELDS, f, strict=True)) for f in index.search(t))] for old, t in zip(before, texts, strict=True)]}

    return lambda: add


def keep_uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that hold no item; all columns stay, no shuffle."""
    out = docs
    for block in blocks_of(items):
        index = Index(block)
        out = common.keep_rows(out, lambda index=index: lambda texts: [not index.search(t) for t in texts])
    return out


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.transform("found", lambda x: x["item_id"]).alias("item_ids"), "found")
