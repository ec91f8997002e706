import random

import corpus_pipeline
from paperloom.llm import decontam, packing

from .test_lines import slow as slow_lines
from .test_packing import check_packed
from .test_shingles import slow_kept
from .test_simhash import slow_fingerprint


def broken(words, first, size):
    """The words in lines of `size`, the first line shorter, so that two texts of the same words share no line."""
    return "\n".join(" ".join(words[max(0, i) : i + size]) for i in range(first - size, len(words), size))


def test_stages_against_brute_force(spark, small, tmp_path):
    rng = random.Random(7)
    near = ["", ""]
    while (slow_fingerprint(near[0]) ^ slow_fingerprint(near[1])).bit_count() <= 4:  # alike by their shingles (47 of 57), not by fingerprints
        words = ["".join(rng.choices("abcdefghinorst", k=rng.randint(3, 8))) for _ in range(56)]
        near = [broken(words, 7, 7), broken([*words[:28], "otherword", *words[29:]], 3, 7)]
    given = spark.read.parquet(f"{small}/documents.parquet")
    given.union(spark.createDataFrame([(10**6 + i, t, "en", "made", len(t)) for i, t in enumerate(near)], given.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in rows if any(map(str.isalpha, r.text or ""))}
    gone = slow_lines(list(texts.items()))
    texts = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[(i, t)]) for i, t in texts.items()}
    first = slow_kept(list(texts.items()))
    assert 10**6 in first and 10**6 + 1 in texts.keys() - first
    texts = {i: t for i, t in texts.items() if i in first}
    index = decontam.Index(items)
    texts = {i: t for i, t in texts.items() if not index.search(t)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(texts)
    check_packed(got, texts, packing.CAPACITY)


def test_hard_rows(spark, hard, clashing, empty, small):
    for docs in (hard, clashing, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, small)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()


def test_stage_list():
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and corpus_pipeline.ORACLE_SQL is None
