"""Queries that SQL holds on a part only, against plain Python on whole small tables."""

import math
import re
from collections import Counter

import pytest
from paperloom import catalog
from paperloom.operators import retrieval, training


def tokens(text):
    return re.findall("[A-Za-z0-9_]+|[\u4e00-\u9fff]", text.lower())


def write(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_scoped_search_asks_every_question(spark, tmp_path):
    words = [f"w{i}" for i in range(9)]
    items = [(i, f"{words[i % 9]} {words[i * 5 % 9]} {words[i % 4]}") for i in range(30)]
    docs = [(d, "\n".join(" ".join(words[(d * 7 + k * 3 + j * (k + 1)) % 9] for j in range(4 + k)) for k in range(3))) for d in range(6)]
    path = write(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    want = {}
    for d, text in docs:
        blocks = [(f"{d}_p001_b{k:04d}", tokens(line)) for k, line in enumerate(text.split("\n"), 1)]
        mean, df = sum(len(b) for _, b in blocks) / len(blocks), Counter(t for _, b in blocks for t in set(b))
        for qid, question in items:
            scored = []
            for block_id, block in blocks:
                tf = Counter(block)
                parts = [math.log(1 + (len(blocks) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(block) / max(mean, 1))) for t in tokens(question) if tf[t]]
                if parts:
                    scored.append((-round(sum(parts), 6), block_id))
            if scored:
                want[(qid, str(d))] = min(scored)
    got = {(r.qid, r.doc_id): (-r.score, r.block_id) for r in catalog.QUERIES["bm25_doc_scoped"](spark, path).collect()}
    assert {q for q, _ in want} == set(range(30)) and got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 2e-6 for k in want)


@pytest.mark.parametrize("block", [512, 2])
def test_dense_search_asks_every_fiftieth_row(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    vectors = {i: [math.sin(i * k + k) for k in range(1, 6)] for i in range(260)}
    path = write(spark, tmp_path, embeddings=(list(vectors.items()), "vec_id long, embedding array<double>"))

    def cosine(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))

    got = {}
    for r in catalog.QUERIES["dense_cosine_topk"](spark, path).collect():
        got.setdefault(r.qid, {})[r.rank] = r
    assert set(got) == set(range(0, 260, 50))
    for qid, ranks in got.items():
        best = sorted((round(cosine(v, vectors[qid]), 6) for i, v in vectors.items() if i != qid), reverse=True)[:10]
        assert sorted(ranks) == list(range(1, 11))
        assert all(abs(ranks[k].score - score) < 2e-6 and abs(cosine(vectors[ranks[k].vec_id], vectors[qid]) - score) < 2e-6 for k, score in enumerate(best, 1))


def test_decoys_search_the_whole_ring(spark):
    texts = {i: "the cat" for i in range(150)} | {7: "a dog", 90: "one the", 91: None}
    answers = {i: ("the", "cat", "dog", "t", "", None)[i % 6] for i in texts} | {100: "a"}
    boards = spark.createDataFrame([(i, answers[i], texts[i]) for i in texts], "k long, answer string, text string")
    want = {}
    for i, answer in answers.items():
        ring = [(i + s) % 150 for s in range(1, 150)]
        want[i] = None if answer is None else next((j for j in ring if texts[j] is not None and answer not in texts[j]), None)
    assert want[12] == 7 and want[100] == 90  # 145 and 140 places on
    got = training.decoys(boards, "k", "k", "answer", "text").collect()
    assert len(got) == 150 and {r.k: r.decoy for r in got} == want


def test_whole_pages_are_escaped(spark, tmp_path):
    html = "<p>x & y</p>" * 40
    path = write(spark, tmp_path, pages=([(1, html)], "page_id long, html string"))
    got = catalog.QUERIES["strip_html"](spark, path).first()
    assert got.escaped == html.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
