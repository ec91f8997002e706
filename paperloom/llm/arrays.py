"""Sets of words or shingles in arrays, for operators that cut texts in Arrow batches: hashes, rarity, distinct numbers, and sorted lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Counts are kept in two to so many hashed cells; they only order words, so cells shared by words cost time, not results.
CELL_BITS = 22
#: Cells whose counts travel as one row.
BLOCK = 1 << 12
#: A number of a word is its rarity class (bits of its cell's count) over this many bits of its hash.
HASH_BITS = 57
#: Characters of text that are cut into words at once (a longer line is cut alone): their numbers stay in a core's cache.
HELD = 1 << 17
#: Entries of longer lists all pass.
LONG_LIST = 1 << 14

#: White space above ASCII at which str.split() splits; it becomes a space first.
WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Which bytes end a line (255 is no byte of UTF-8: it ends a text), and which stand between words.
BREAKS = np.isin(np.arange(256), (10, 255))
GAPS = np.isin(np.arange(256), (*range(9, 14), *range(28, 33), 255))
#: Masks of the first bytes of eight, and the length from which words are hashed one by one.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_WORD = 1024


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Well-spread 64 bits of each key (splitmix64)."""
    x = keys.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def portions(texts: list[str | None]) -> Iterator[list[tuple[int, int, str]]]:
    """(row, number of its first line, whole lines) of all texts, in lists of about HELD characters."""
    held, size = [], 0
    for row, text in enumerate(texts):
        first = 0
        while text:
            cut = -1
            if len(text) > HELD and (cut := text.rfind("\n", 0, HELD)) < 0:
                cut = text.find("\n", HELD)
            piece, text = (text, None) if cut < 0 else (text[:cut], text[cut + 1 :])
            held.append((row, first, piece))
            size, first = size + len(piece), first + piece.count("\n") + 1
            if size >= HELD:
                yield held
                held, size = [], 0
    if held:
        yield held


def hashed(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and line of every word, lower-cased; lines are counted through all pieces."""
    from xxhash import xxh3_64_intdigest

    def encoded(piece: str) -> bytes:
        piece = piece.lower()
        if not piece.isascii():
            for space in WIDE_SPACES:
                piece = piece.replace(space, " ")
        return piece.encode("utf-8", "surrogatepass")

    blob = b"".join([x for piece in pieces for x in (encoded(piece), b"\xff")] + [bytes(8)])
    data = np.frombuffer(blob, np.uint8)[:-8]
    edges = np.flatnonzero(np.diff(GAPS[data].view(np.int8), prepend=1))  # words start and end in turn
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    eights = np.ndarray(len(data), "<u8", blob, strides=(1,))  # the eight bytes from every place on
    words = mixed(eights[starts] & FIRST[np.minimum(lengths, 8)] ^ lengths.astype(np.uint64) << np.uint64(56), 3)
    at, rest = np.flatnonzero(lengths > 8), 8
    while len(at):
        words[at] = mixed(words[at] ^ eights[starts[at] + rest] & FIRST[np.minimum(lengths[at] - rest, 8)], 4)
        rest += 8
        at = at[(lengths[at] > rest) & (rest < LONG_WORD)]
    for k in np.flatnonzero(lengths > LONG_WORD):
        words[k] = xxh3_64_intdigest(data[starts[k] : starts[k] + lengths[k]].tobytes())
    return words, np.searchsorted(np.flatnonzero(BREAKS[data]), starts)


def rarity(docs: DataFrame, hashes: Callable[[list[str | None]], np.ndarray]) -> np.ndarray:
    """For each cell the number of bits of its count over all texts: of the words or shingles that hashes() finds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.int64)
        held, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                held.append((hashes(batch.column("text").slice(start, 256).to_pylist()) >> np.uint64(64 - CELL_BITS)).astype(np.int64))
                size += len(held[-1])
                if size >= len(counts):
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        for block in np.flatnonzero(counts.reshape(-1, BLOCK).any(axis=1)):
            some = counts[block * BLOCK : (block + 1) * BLOCK]
            yield row(block, "counts", some.astype(np.min_scalar_type(int(some.max()))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # of all blocks 2 ** CELL_BITS numbers at most
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, f"u{len(counts) // BLOCK}").astype(np.int64)
        for block, total in sums.items():
            yield row(block, "bits", np.frexp(total)[1].astype(np.uint8))

    def row(block: int, name: str, values: np.ndarray) -> pa.RecordBatch:
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=["block", name])

    # A row a block of cells, not a cell: each task has nearly all cells, so rows of cells would be tasks times cells.
    counted = docs.select("text").mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, bits binary")
    with common.tidy(docs.sparkSession):
        rows = counted.toArrow()  # a byte a cell
    found = np.zeros(1 << CELL_BITS, np.uint8)
    for block, bits in zip(rows.column("block").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        found[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(bits, np.uint8)
    return found


def sets(words: np.ndarray, line: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words as numbers (rarity class over bits of the hash) and their lines: by line, then rarest first."""
    keys = bits[words >> np.uint64(64 - CELL_BITS)].astype(np.uint64) << np.uint64(HASH_BITS) | words >> np.uint64(64 - HASH_BITS)
    order = np.lexsort((keys, line))
    keys, line = keys[order].view(np.int64), line[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (line[1:] != line[:-1])
    return keys[new], line[new]


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The runs of values as an Arrow list array."""
    import pyarrow as pa

    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths) + np.arange(int(lengths.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values[at]))


def may_match(key: np.ndarray, n: np.ndarray, i: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which entries, sorted by key, fit() some other entry of their list."""
    found = np.zeros(len(key), bool)
    rows, step = np.arange(len(key)), 0
    while True:
        step += 1
        rows = rows[rows + step < len(key)]
        rows = rows[key[rows] == key[rows + step]]
        if not len(rows):
            return found
        a, b = rows, rows + step
        both = n[a] + n[b]
        needed = (4 * both + 8) // 9
        close = (5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])) & (np.minimum(n[a] - i[a], n[b] - i[b]) >= needed)
        a, b, apart = a[close], b[close], (both - 2 * needed)[close]
        close = np.bitwise_count(p[a] ^ p[b]) + np.bitwise_count(q[a] ^ q[b]) <= apart
        found[a[close]] = found[b[close]] = True


def open_entries(entries: DataFrame) -> DataFrame:
    """The entries that may match another one of their list; all of a list of more than LONG_LIST."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        def kept(rows: pa.RecordBatch) -> pa.RecordBatch:
            key, n, i, p, q = (rows.column(c).to_numpy() for c in ("key", "n", "i", "p", "q"))
            return rows.filter(pa.array(may_match(key, n.astype(np.int64), i.astype(np.int64), p.view(np.uint64), q.view(np.uint64))))

        held, whole = None, None  # the last list, which may go on; the key of a long list, whose entries all pass
        for batch in batches:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            held = None
            key = rows.column("key").to_numpy()
            if whole is not None:
                passed = int(np.searchsorted(key != whole, True)) if (key != whole).any() else len(key)
                yield rows.slice(0, passed)
                if passed == len(key):
                    continue
                rows, key, whole = rows.slice(passed), key[passed:], None
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield kept(rows.slice(0, last))
            held = rows.slice(last)
            if held.num_rows > LONG_LIST:
                yield held
                held, whole = None, key[-1]
        if held is not None:
            yield kept(held)

    # A number of its own for the sort: nulls can't occur, and equal keys stay together.
    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(choose, entries.schema)
