"""Best-fit packing: a configuration linear program over the length histogram.

Documents become pieces of at most CAPACITY tokens. The histogram of piece lengths has at most CAPACITY
entries however many documents there are, so the program is solved on the driver: a configuration is a
multiset of lengths that fits one sequence; multiplicative weights price the lengths (what is covered
less is worth more), and a knapsack dynamic programme finds the best configurations for those prices, whose amounts
grow by fractions. The prices also bound the number of sequences from below. The amounts are then rounded down to whole
sequences and the rest is packed best fit; plain best fit is kept where it is better. Pieces
then get their place by their rank among the pieces of their length; no text or token moves for it.
"""

from __future__ import annotations

import os
import re
import sys
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
SEPARATOR = 0
#: Pieces of one length are ranked in so many groups, so that no length lands in one task.
SALTS = 512
#: How fast the price of a covered length falls, how near to the best value a configuration has to come, and rounds.
RATE, NEAR, ROUNDS = 8.0, 0.995, 64

Configuration = tuple[tuple[int, int], ...]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """Encoder of a byte-level BPE vocabulary, one for each worker process.

    A .json file is read by `tokenizers`; a .tiktoken file with the same vocabulary gives the same ids
    (the tests hold one against the other) in a third of the time.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    held = sys.modules["tokenizers"].__dict__.setdefault("_encoders", {})
    if path not in held:
        if path.endswith(".json"):
            machine = tokenizers.Tokenizer.from_file(path)
            machine.encode_special_tokens = True
            held[path] = lambda text: machine.encode(text, add_special_tokens=False).ids
        else:
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            held[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return held[path]


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the tokens that the vocabulary's .json file adds to the byte pairs; a .tiktoken file has them beside it."""
    import json

    with open(path.removesuffix(".tiktoken") + ".json" if path.endswith(".tiktoken") else path, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    if odd := [t["content"] for t in found if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
        raise ValueError(f"added tokens with matching rules of their own: {odd}")
    return {t["content"]: t["id"] for t in found}


def whole_encoder(path: str):
    """Encoder with the ids of the vocabulary's tokenizer at its defaults: texts are split at added tokens, the parts encoded alone."""
    plain, added = encoder(path), added_tokens(path)
    if not added:
        return plain
    where = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def encode(text: str) -> list[int]:
        parts = where.split(text)
        if len(parts) == 1:
            return plain(text)
        return [i for k, part in enumerate(parts) for i in ([added[part]] if k % 2 else plain(part))]

    return encode


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(at, capacity) for at in range(first, n, capacity)]]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of all pieces of docs (doc_id, text).

    A document is its text's ids, those of added tokens among them, and a separator; null text counts as empty. Only documents over the capacity are cut.
    """
    path = vocabulary_path or vocabulary()

    def make():
        encode = whole_encoder(path)

        def cut(batch) -> dict:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), SEPARATOR], "<u4")
                rows += [(doc_id, i, at, n, ids[at : at + n].tobytes()) for i, (at, n) in enumerate(cuts(len(ids), capacity))]
            return dict(zip(("doc_id", "piece", "start", "length", "ids"), zip(*rows, strict=True), strict=True))

        return cut

    return common.map_rows(common.pick(docs, doc_id="long", text="string"), "doc_id long, piece int, start long, length long, ids binary", make, rows=256)


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of every room from 0 to capacity, and the length that the best filling takes first (0: none)."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        value = best[room - 1 :: -1][:room] + price[1 : room + 1]
        at = int(value.argmax())
        if value[at] > best[room - 1]:
            best[room], take[room] = value[at], at + 1
        else:
            best[room] = best[room - 1]
    return best, take


def filling(take: np.ndarray, room: int) -> Counter:
    """The lengths of the best filling of a room."""
    found: Counter = Counter()
    while room > 0:
        if n := int(take[room]):
            found[n] += 1
            room -= n
        else:
            room -= 1
    return found


def best_fit(left: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing of lengths with counts: each piece goes to the fullest sequence with room.

    Equal pieces and equal sequences are handled together, so the work follows the number of lengths.
    """
    rooms: list[int] = []  # ascending, each once
    held: dict[int, Counter] = {}

    def put(room: int, content: Configuration, n: int) -> None:
        if room not in held:
            insort(rooms, room)
            held[room] = Counter()
        held[room][content] += n

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                content, there = next(iter(held[room].items()))
            else:
                room, content, there = capacity, (), -(-n // (capacity // length))
            each = min(n, room // length)  # a sequence stays the fullest with room until no further piece fits
            taken = min(there, n // each)
            if at < len(rooms):
                held[room][content] -= taken
                if not held[room][content]:
                    del held[room][content]
                if not held[room]:
                    del held[room]
                    rooms.pop(at)
            put(room - each * length, (*content, (length, each)), taken)
            n -= taken * each
    return sum(held.values(), Counter())


def priced(price: np.ndarray, there: np.ndarray, capacity: int) -> tuple[float, list[tuple[float, Configuration]]]:
    """The best configuration's value at these prices, and for each length the best configuration that has it, with its value."""
    best, take = knapsack(price, capacity)
    found = {}
    for length in there.tolist():
        config = filling(take, capacity - length)
        config[length] += 1
        found[tuple(sorted(config.items(), reverse=True))] = price[length] + best[capacity - length]
    return float(best[capacity]), [(value, config) for config, value in found.items()]


def fractional(demand: np.ndarray, capacity: int) -> tuple[dict[Configuration, float], float]:
    """A solution of the program (amounts of configurations that cover the demand) and a lower bound of any.

    Multiplicative weights: a length's price falls by a factor with each share of its demand that is covered.
    Prices over the value of the best configuration are a solution of the dual program, so their
    worth of the demand bounds every packing from below. Each round adds one ROUNDS-th of the bound so far, dealt among
    the configurations that come near the best value by what they can still cover.
    """
    lengths = np.arange(capacity + 1)
    there = np.flatnonzero(demand)
    bound = float(np.ceil((demand * lengths).sum() / capacity - 1e-9))
    amounts: dict[Configuration, float] = {}
    covered = np.zeros(capacity + 1)
    share = np.zeros(capacity + 1)
    for done in range(ROUNDS):
        share[there] = covered[there] / demand[there]
        price = np.where(demand > 0, lengths / capacity * np.exp(np.minimum(RATE * (done / ROUNDS - share), 50)), -np.inf)
        top, configs = priced(price, there, capacity)
        bound = max(bound, float((price[there] * demand[there]).sum()) / top)
        near = [(min(demand[x] / n for x, n in config), config) for value, config in configs if value >= NEAR * top]
        whole = sum(most for most, _ in near)
        for most, config in near:
            amount = bound / ROUNDS * most / whole
            amounts[config] = amounts.get(config, 0.0) + amount
            for x, n in config:
                covered[x] += n * amount
    return amounts, bound


def rounded(amounts: dict[Configuration, float], demand: np.ndarray, capacity: int) -> Counter:
    """Whole sequences: amounts rounded down as far as the demand lasts, fullest configurations first; the rest is packed best fit."""
    left, found = demand.copy(), Counter()
    for config in sorted(amounts, key=lambda c: (-sum(x * n for x, n in c), -amounts[c], c)):
        n = min(int(amounts[config]), *(int(left[x]) // k for x, k in config))
        if n > 0:
            found[config] += n
            for x, k in config:
                left[x] -= k * n
    found.update(best_fit({int(x): int(left[x]) for x in np.flatnonzero(left)}, capacity))
    return found


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[Configuration, int]], float]:
    """Configurations with how many sequences take each, which hold the histogram exactly, and a lower bound of their number.

    The program's rounded solution, or plain best fit where that needs fewer sequences.
    """
    demand = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        demand[length] = n
    full = int(demand[capacity])
    demand[capacity] = 0
    plain = best_fit({int(x): int(demand[x]) for x in np.flatnonzero(demand)}, capacity)
    found, bound = plain, 0.0
    if demand.any():
        amounts, bound = fractional(demand, capacity)
        found = min(rounded(amounts, demand, capacity), plain, key=lambda f: sum(f.values()))
    if full:
        found = found + Counter({((capacity, 1),): full})
    return sorted(found.items()), bound + full


def slots(plan: list[tuple[Configuration, int]], capacity: int) -> np.ndarray:
    """Rows (length, first rank, copies in the configuration, first sequence, offset), by length and first rank."""
    rows, used, sequence = [], Counter(), 0
    for config, n in plan:
        offset = 0
        for length, copies in config:
            rows.append((length, used[length], copies, sequence, offset))
            used[length] += copies * n
            offset += copies * length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (doc_id, piece, start, length, ...) with sequence_id and offset: whole pieces, gapless from 0, at most capacity.

    The histogram (at most capacity rows) and the plan (bounded by it) are all that the driver holds.
    Rows with equal columns may swap places. An empty table gives an empty one.
    """
    cut = common.materialise(cut)
    salted = cut.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = common.materialise(counts.select("length", "__salt", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base")))
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    table = slots(solve(histogram, capacity)[0], capacity)
    own = Window.partitionBy("length", "__salt").orderBy(*[c for c in cut.columns if c != "length"])
    ranked = salted.withColumn("__rank", F.row_number().over(own) - 1).join(bases, ["length", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__base"))
    given = ranked.select(*cut.columns, "__rank")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in cut.schema)}, sequence_id long, offset long"

    stride = int(table[:, 1].max(initial=0)) + 1

    def place(batch) -> dict:
        wide = table[:, 0] * stride + table[:, 1]
        length, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
        row = table[np.searchsorted(wide, length * stride + np.minimum(rank, stride - 1), side="right") - 1]
        past = rank - row[:, 1]
        return {"sequence_id": row[:, 3] + past // row[:, 2], "offset": row[:, 4] + past % row[:, 2] * length}

    return common.map_rows(given, schema, lambda: place, rows=1 << 16)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text).

    Keeps a checksum of each piece's ids rather than the ids, which pieces() gives again.
    """
    cut = pieces(docs, capacity, vocabulary_path).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(cut, capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
