"""Language identification as multilingual mixture inference.

Each language has a distribution over hashed byte trigrams of lower-cased text, counted over all
training rows. A document's trigrams are drawn from a mixture of languages; expectation-maximisation
estimates its proportions, and sets of one, two, three ... languages are compared by likelihood minus a
penalty per language. The language with the largest proportion in the chosen set is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 14
ROUNDS = 12
MAX_LANGUAGES = 512
#: Nats that each further language must gain for every log of the document's trigrams (BIC takes 0.5).
PENALTY = 2.0
PART = 1 << 21
UNKNOWN = "und"


def grams(text: str) -> np.ndarray:
    """Bucket of every byte trigram of the text: lower case, runs of anything but letters as one space."""
    import regex

    plain = regex.sub(r"[^\p{L}]+", " ", text.lower())
    b = np.frombuffer(f" {plain} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return (code * np.uint32(2654435761) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    """languages: sorted names; probs: bucket x language, each column sums to 1."""

    languages: tuple[str, ...]
    probs: np.ndarray


def train(rows: DataFrame) -> Model:
    """Fit on all rows (text, lang) with a language and at least one letter.

    The counts are summed in Spark; at most BUCKETS x MAX_LANGUAGES numbers reach the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                if has_letter(text):
                    found = np.bincount(grams(text), minlength=BUCKETS)
                    total[lang] = total[lang] + found if lang in total else found
        for lang, found in total.items():
            at = np.flatnonzero(found)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": found[at]})

    given = rows.where("lang is not null and text is not null").select("text", "lang")
    counted = given.mapInPandas(count, schema="lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = common.materialise(counted)
    names = sorted(r[0] for r in counted.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    column = {name: i for i, name in enumerate(names)}
    counts = np.zeros((BUCKETS, len(names)))
    for r in counted.toLocalIterator():
        counts[r["bucket"], column[r["lang"]]] = r["n"]
    common.release(counted)
    smooth = counts + 0.5
    return Model(tuple(names), (smooth / smooth.sum(axis=0)).astype(np.float32))


def fit(probs: np.ndarray, weight: np.ndarray, owner: np.ndarray, starts: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation from equal proportions, for all documents of a batch at once.

    probs, weight, owner: a row for each distinct trigram of each document; starts: where documents
    begin; total: how many trigrams they have. Returns the proportions and the log likelihoods.
    """
    mix = np.full((len(starts), probs.shape[1]), 1 / probs.shape[1], np.float32)
    for _ in range(ROUNDS):
        part = probs * mix[owner]
        part *= (weight / part.sum(axis=1))[:, None]
        mix = np.add.reduceat(part, starts, axis=0) / total[:, None]
    like = np.add.reduceat(weight * np.log((probs * mix[owner]).sum(axis=1)), starts)
    return mix, like


def infer(texts: list[str | None], model: Model) -> list[list[tuple[str, float]]]:
    """For each text the chosen languages with their proportions, largest first; [] without a letter."""
    out: list[list[tuple[str, float]]] = [[] for _ in texts]
    if not model.languages:
        return out
    group: list[tuple[int, np.ndarray, np.ndarray]] = []
    held = 0
    for i, text in enumerate(texts):
        if has_letter(text):
            found = np.bincount(grams(text), minlength=BUCKETS)
            at = np.flatnonzero(found)
            group.append((i, at, found[at]))
            held += len(at) * len(model.languages)
        if held > PART or i + 1 == len(texts) and group:
            infer_group(group, model, out)
            group, held = [], 0
    return out


def infer_group(group: list, model: Model, out: list) -> None:
    """Forward selection: the language whose share would raise the likelihood most joins the set, EM fits
    the set, and it stays if the penalised likelihood grows.

    The likelihood is concave in the proportions, so no mixture can gain more than the steepest slope;
    documents where that is under the penalty are done without EM.
    """
    probs = model.probs[np.concatenate([g[1] for g in group])]
    weight = np.concatenate([g[2] for g in group]).astype(np.float32)
    sizes = np.array([len(g[1]) for g in group])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    owner = np.repeat(np.arange(len(group)), sizes)
    total = np.add.reduceat(weight, starts)
    n = len(model.languages)
    docs = np.arange(len(group))
    single = np.add.reduceat(weight[:, None] * np.log(probs), starts, axis=0)
    picked = single.argmax(axis=1)[:, None]
    mix = np.ones((len(group), 1), np.float32)
    score = single.max(axis=1)
    chosen: list[list[tuple[int, float]]] = [[(int(p[0]), 1.0)] for p in picked]
    while len(docs) and picked.shape[1] < n:
        now = (np.take_along_axis(probs, picked[owner], axis=1) * mix[owner]).sum(axis=1)
        slope = np.add.reduceat(probs * (weight / now)[:, None], starts, axis=0) - total[:, None]
        np.put_along_axis(slope, picked, -np.inf, axis=1)
        penalty = PENALTY * np.log(np.maximum(total, 2))
        keep = slope.max(axis=1) > penalty
        picked = np.concatenate((picked, slope.argmax(axis=1)[:, None]), axis=1)
        rows = keep[owner]
        docs, picked, score, total, penalty, probs, weight, sizes = docs[keep], picked[keep], score[keep], total[keep], penalty[keep], probs[rows], weight[rows], sizes[keep]
        if not len(docs):
            break
        starts, owner = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.repeat(np.arange(len(docs)), sizes)
        mix, like = fit(np.take_along_axis(probs, picked[owner], axis=1), weight, owner, starts, total)
        keep = like - score > penalty
        for d, langs, shares in zip(docs[keep], picked[keep], mix[keep], strict=True):
            chosen[d] = sorted(zip(map(int, langs), map(float, shares), strict=True), key=lambda x: (-x[1], x[0]))
        rows = keep[owner]
        docs, picked, mix, score, total, probs, weight, sizes = docs[keep], picked[keep], mix[keep], like[keep], total[keep], probs[rows], weight[rows], sizes[keep]
        starts, owner = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64), np.repeat(np.arange(len(docs)), sizes)
    for (i, _, _), langs in zip(group, chosen, strict=True):
        out[i] = [(model.languages[x], share) for x, share in langs]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and mixture (languages with proportions) of every row of docs (doc_id, text).

    Only the text is an input. Null texts and texts without a letter (or an empty model) give und and 0;
    score is the prediction's proportion. Rows are independent: no shuffle.
    """

    def judge(batch) -> dict:
        mixed = infer(batch.column("text").to_pylist(), model)
        return {
            "lang_pred": [m[0][0] if m else UNKNOWN for m in mixed],
            "score": [min(1.0, m[0][1]) if m else 0.0 for m in mixed],
            "mixture": [[{"lang": x, "share": y} for x, y in m] for m in mixed],
        }

    return common.map_rows(common.pick(docs, doc_id="long", text="string"), "doc_id long, lang_pred string, score double, mixture array<struct<lang: string, share: double>>", lambda: judge)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def train_on_documents(docs: DataFrame) -> Model:
    """Learn from text and lang of the documents that aren't held out (crc32 of doc_id as text, modulo 3, is 1)."""
    given = common.pick(docs, doc_id="long", text="string", lang="string")
    return train(given.where(F.coalesce(~held_out(), F.lit(True))))


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs (doc_id, text, lang, ...) with a language, and that language as their lang; those predicted und go.

    A model that has learned no language rejects only what has no letter, and leaves lang as it is. All columns stay, repeated rows
    all stay or all go, an empty table stays empty; no shuffle: the prediction runs inside one pass over whole rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                texts = part.column("text").to_pylist()
                if not model.languages:
                    yield part.filter(pa.array([has_letter(t) for t in texts], pa.bool_()))
                    continue
                found = [m[0][0] if m else None for m in infer(texts, model)]
                if "lang" in part.schema.names:
                    at = part.schema.get_field_index("lang")
                    part = part.set_column(at, part.schema.field(at), pa.array(found, part.schema.field(at).type))
                yield part.filter(pa.array([x is not None for x in found], pa.bool_()))

    return docs.mapInArrow(run, schema=docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = predict(docs, train_on_documents(docs))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "mixture")
