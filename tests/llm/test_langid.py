import random
import zlib

import numpy as np
from paperloom.llm import langid

WORDS = {"xx": "kalo mira tesu noru palo".split(), "yy": "brik strant gwolp fnerd".split(), "zz": "ééla çonu àvier ûmir".split()}


def prose(rng, lang, n):
    return " ".join(rng.choices(WORDS[lang], k=n))


def model(spark):
    rng = random.Random(2)
    rows = [(prose(rng, lang, 200), lang) for lang in WORDS for _ in range(5)] + [(None, "xx"), ("text", None), ("123", "yy"), ("", "zz")]
    return langid.train(spark.createDataFrame(rows, "text string, lang string"))


def test_mixtures_are_found(spark):
    m, rng = model(spark), random.Random(7)
    assert m.languages == ("xx", "yy", "zz")
    for shares in ({"xx": 1.0}, {"xx": 0.7, "zz": 0.3}, {"xx": 0.2, "yy": 0.5, "zz": 0.3}):
        text = "\n".join(prose(rng, lang, int(600 * share)) for lang, share in shares.items())
        (found,) = langid.infer([text], m)
        assert {lang for lang, _ in found} == set(shares)
        assert found[0][0] == max(shares, key=shares.get)
        assert abs(sum(share for _, share in found) - 1) < 1e-3
        assert all(abs(share - shares[lang]) < 0.12 for lang, share in found)


def test_batches_don_t_change_results(spark):
    m, rng = model(spark), random.Random(8)
    texts = [prose(rng, rng.choice(list(WORDS)), rng.randint(1, 40)) + " " + prose(rng, rng.choice(list(WORDS)), rng.randint(0, 40)) for _ in range(60)]
    texts[7], texts[20], texts[-1] = None, "?!", ""
    together = langid.infer(texts, m)
    for text, found in zip(texts, together, strict=True):
        (alone,) = langid.infer([text], m)
        assert [x for x, _ in alone] == [x for x, _ in found] and np.allclose([x for _, x in alone], [x for _, x in found], atol=1e-4)


def test_slope_bounds_every_mixture(spark):
    """No mixture of two languages that the slope rules out would have passed the penalty."""
    m, rng = model(spark), random.Random(9)
    for _ in range(20):
        text = prose(rng, rng.choice(list(WORDS)), rng.randint(3, 60))
        counts = np.bincount(langid.grams(text), minlength=langid.BUCKETS)
        at = np.flatnonzero(counts)
        p, c = m.probs[at].astype(float), counts[at]
        alone = (c[:, None] * np.log(p)).sum(axis=0)
        first = alone.argmax()
        (found,) = langid.infer([text], m)
        if len(found) == 1:
            for other in range(3):
                for share in np.linspace(0.01, 0.99, 50):
                    gain = (c * np.log((1 - share) * p[:, first] + share * p[:, other])).sum() - alone[first]
                    assert gain <= langid.PENALTY * np.log(max(2, c.sum())) + 0.05


def test_hard_rows(spark, hard, clashing, empty):
    m = model(spark)
    want = [(r.doc_id, r.text is None or not any(map(str.isalpha, r.text))) for r in hard.collect()]
    key = lambda x: tuple((v is None, v) for v in x)
    for docs in (hard, clashing):
        rows = langid.predict(docs, m).collect()
        assert sorted(((r.doc_id, r.lang_pred == "und") for r in rows), key=key) == sorted(want, key=key)
        assert all(0 <= r.score <= 1 and (r.score > 0) == (r.lang_pred != "und") for r in rows)
        kept = langid.keep_identified(docs, m)
        assert kept.columns == docs.columns
        assert sorted([(r.doc_id,) for r in kept.collect()], key=key) == sorted([(i,) for i, none in want if not none], key=key)
    assert {r.lang for r in langid.keep_identified(hard, m).collect()} <= set(m.languages)
    kept = langid.keep_identified(hard, langid.train_on_documents(empty)).collect()  # no language learned: only what has no letter goes
    assert sorted([(r.doc_id,) for r in kept], key=key) == sorted([(i,) for i, none in want if not none], key=key)
    assert langid.predict(empty, langid.train_on_documents(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(hard, langid.train_on_documents(empty)).collect()} == {"und"}


def test_held_out_accuracy(spark, medium):
    found = langid.op6_language_id(spark, medium).join(spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(held) / len(held) > 0.98


def test_languages_of_held_out_rows_aren_t_learnt(spark):
    rows = [(i, f"kalo mira {i}", "secret" if zlib.crc32(str(i).encode()) % 3 == 1 else "xx") for i in range(60)]
    assert langid.train_on_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ("xx",)
