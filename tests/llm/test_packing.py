import random
import zlib

import numpy as np
import public_tokenizers
from paperloom.llm import packing
from tokenizers import Tokenizer


def slow_ids(text, machine=[]):  # noqa: B006
    if not machine:
        machine.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
        machine[0].encode_special_tokens = True
    return [*machine[0].encode(text or "", add_special_tokens=False).ids, 0]


def test_both_encoders_agree(spark, medium):
    texts = [r.text for r in spark.read.parquet(f"{medium}/documents.parquet").select("text").limit(200).collect()]
    texts += ["", " ", "\n\n  x\t\t y", "<|endoftext|>", "naïve ﬁ 漢字 🙂🙂 I'll we've 12345678901", "a" * 3000, "​\xa0\x00\x07 ́", "ÀÉ" * 500, "!?!?" * 400]
    encode = packing.encoder(packing.vocabulary())
    assert all([*encode(t), 0] == slow_ids(t) for t in texts)


def test_added_tokens_as_the_tokenizer_has_them(spark):
    texts = ["end of file <|endoftext|> next", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext|", "<|endoftext|>\n\n x", "plain"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    machine = Tokenizer.from_file(path)
    want = [machine.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in want[0] and len(want[0]) == 6
    for vocabulary in (packing.vocabulary(), path):
        encode = packing.whole_encoder(vocabulary)
        assert [list(encode(t)) for t in texts] == want
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == {i: [*ids, 0] for i, ids in enumerate(want)}


def check_plan(histogram, capacity):
    plan, bound = packing.solve(histogram, capacity)
    held = {}
    for config, n in plan:
        assert n > 0 and sum(x * k for x, k in config) <= capacity
        for x, k in config:
            held[x] = held.get(x, 0) + k * n
    assert held == {x: n for x, n in histogram.items() if n}
    n = sum(n for _, n in plan)
    assert bound - 1e-6 <= n <= sum(packing.best_fit(histogram, capacity).values())
    return n


def test_the_program_comes_near_its_bound():
    rng = random.Random(7)
    for histogram in ({x: rng.randint(20, 60) for x in range(600, 1401)}, {x: rng.randint(20, 60) for x in range(1, 2048)}, {700: 1000, 650: 900, 1040: 800, 333: 700, 90: 1000}):
        demand = np.zeros(2049, np.int64)
        for x, n in histogram.items():
            demand[x] = n
        amounts, bound = packing.fractional(demand, 2048)
        assert all(sum(x * k for x, k in config) <= 2048 for config in amounts)
        assert sum(packing.rounded(amounts, demand, 2048).values()) <= 1.03 * bound
        assert check_plan(histogram, 2048) <= 1.025 * bound


def test_plans_hold_the_histogram_exactly():
    rng = random.Random(5)
    for capacity in (1, 7, 64, 300):
        for _ in range(15):
            histogram = {rng.randint(1, capacity): rng.choice((1, 2, 5, 100, 10_000)) for _ in range(rng.randint(1, 40))}
            n = check_plan(histogram, capacity)
            assert n >= -(-sum(x * k for x, k in histogram.items()) // capacity)
    assert check_plan({}, 10) == 0


def test_dense_histograms_reach_the_volume_bound():
    rng = random.Random(6)
    for low, high, slack in ((1, 1200, 1.002), (1, 2047, 1.03)):  # pieces over half a sequence need partners of just the rest
        histogram = {x: rng.randint(20, 60) for x in range(low, high + 1)}
        n, bound = check_plan(histogram, 2048), -(-sum(x * k for x, k in histogram.items()) // 2048)
        fitted = sum(packing.best_fit(histogram, 2048).values())
        assert n <= bound * slack + 1 and n <= fitted


def test_work_follows_lengths_not_pieces():
    assert check_plan({1500: 10**12, 600: 10**11, 400: 7}, 2048) == 10**12 + -(-(10**11) // 3)


def test_knapsack_against_search():
    rng = np.random.default_rng(0)
    price = np.concatenate(([0], rng.random(12)))
    best, take = packing.knapsack(price, 12)

    def search(room):
        return max((price[x] + search(room - x) for x in range(1, room + 1)), default=0.0)

    for room in range(10):
        assert abs(best[room] - search(room)) < 1e-9
        assert abs(sum(price[x] * n for x, n in packing.filling(take, room).items()) - best[room]) < 1e-9


def check_packed(rows, texts, capacity):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, text in texts.items():
        ids = np.array(slow_ids(text), "<u4")
        pieces = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc_id]})
        at = 0
        for k, (piece, start, length, crc) in enumerate(pieces):
            assert (piece, start) == (k, at) and zlib.crc32(ids[at : at + length].tobytes()) == crc
            assert length == capacity or k == 0
            at += length
        assert at == len(ids) and (len(pieces) == 1 or at > capacity)


def test_hard_rows(hard, clashing, empty):
    rows = hard.collect()
    for docs in (hard, clashing):
        got = packing.pack_documents(docs).collect()
        check_packed(got, {r.doc_id: r.text for r in rows if r.doc_id is not None}, packing.CAPACITY)
        assert sum(r.length for r in got) == sum(len(slow_ids(r.text)) for r in rows)
    assert packing.pack_documents(empty).count() == 0


def test_whole_table(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = packing.op4_best_fit_packing(spark, small).collect()
    check_packed(got, texts, packing.CAPACITY)
    bound = -(-sum(r.length for r in got) // packing.CAPACITY)
    assert len({r.sequence_id for r in got}) <= bound * 1.03 + 1
