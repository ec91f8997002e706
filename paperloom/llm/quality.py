"""Quality classifier by co-training.

Two views describe a document: its text content (telling words, byte trigrams, repetition) and its page metadata
(language, source, length, and how its lines are laid out and set). A logistic classifier for each view
learns from labelled documents. Over rounds both judge every other document of the corpus, and each hands
a draw of those it is confident of to the other as labels. Each view is then calibrated on labelled documents
that were kept apart, and the calibrated views are combined to score every document. The same is done for each target.

The views of all documents are computed once and written; rounds and scores read them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays, common

#: The classifiers are fitted on at most so many labelled documents, those with the smallest hash of their id.
MAX_LABELLED = 3000
ROUNDS = 3
#: Pseudo-labels that a view hands on in a round, classes as on the labelled rows: drawn by a hash from all documents it is confident of.
HANDED = 150
CONFIDENT = 0.9
#: Words are hashed to CELLS; those that tell a target's classes apart best on the labelled rows, so many a target, are features.
CELLS, TELLING, TRIGRAMS = 1 << 18, 256, 1 << 9
#: Numbers of the text view beside the words.
TEXT = TRIGRAMS + 2
SOURCES = 64
#: Every CALIBRATE-th labelled document, by another hash, calibrates.
CALIBRATE = 4


def word_cells(text: str) -> np.ndarray:
    """The distinct cells of the text's words: lower case, without marks around them."""
    words = set(text.encode("utf-8", "surrogatepass").lower().split())
    return np.unique(np.fromiter((zlib.crc32(w.strip(b".,;:!?()\"'")) for w in words), np.uint32, len(words)) % CELLS).astype(np.int32)


def text_view(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, then how far words repeat; as half-precision numbers have them."""
    out = np.zeros(TEXT, np.float16)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(b) >= 3:
        code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(33 - TRIGRAMS.bit_length())
        out[:TRIGRAMS] = np.sqrt(np.bincount(code, minlength=TRIGRAMS) / len(code))
    if words := text.split():
        repeated = 1 - len(set(words)) / len(words)
        out[TRIGRAMS:] = repeated, np.log1p(len(words)) * repeated / 5
    return out.astype(np.float32)


def telling(cells: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The cells whose presence differs most between the classes, by standard errors."""
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    held = [np.bincount(np.concatenate([np.zeros(0, np.int32), *(c for c, label in zip(cells, y, strict=True) if (label > 0.5) == wanted)]), minlength=CELLS) for wanted in (True, False)]
    p = (held[0] + held[1] + 1) / (n1 + n0 + 2)
    z = np.abs(held[0] / n1 - held[1] / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    best = np.argsort(-z, kind="stable")[:TELLING]
    return best[z[best] > 0]


def presence(cells: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """1 for each chosen cell (ascending) that is among the cells (ascending)."""
    return np.isin(chosen, cells, assume_unique=True).astype(np.float32)


def metadata_view(text: str, lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """Length, line layout, kinds of characters, and hashed language and source; no words, which are the other view's."""
    lines = text.split("\n")
    sizes = np.fromiter(map(len, lines), np.float64, len(lines))
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw))
    upper = np.count_nonzero((raw >= 65) & (raw <= 90)) / n
    marks = np.count_nonzero((raw > 32) & (raw < 48) | (raw > 57) & (raw < 65) | (raw > 90) & (raw < 97) | (raw > 122) & (raw < 127)) / n
    digits = np.count_nonzero((raw > 47) & (raw < 58)) / n
    spaces = np.count_nonzero(raw == 32) / n
    given = float(n_chars) if n_chars is not None and not pd.isna(n_chars) else float(len(text))
    plain = [np.log1p(max(0.0, given)) / 10, np.log1p(len(lines)) / 5, np.log1p(sizes.mean()) / 8, np.log1p(sizes.max()) / 10, np.count_nonzero(sizes < 20) / len(lines), 1 - len(set(lines)) / len(lines), 5 * upper, 5 * marks, 5 * digits, 2 * spaces]
    out = np.zeros(len(plain) + 2 * SOURCES, np.float32)
    out[: len(plain)] = plain
    for i, name in enumerate((lang, source)):
        if name is not None:
            out[len(plain) + i * SOURCES + zlib.crc32(name.encode()) % SOURCES] = 1
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class Linear:
    """Standardised logistic regression, folded into plain weights."""

    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 100) -> Linear:
    """Logistic regression by accelerated gradient descent, classes weighted alike."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-2
    z = ((x - mean) / spread).astype(np.float32)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) / len(y)
    v = np.full(z.shape[1], 1 / np.sqrt(z.shape[1]), np.float32)
    for _ in range(8):  # the largest curvature bounds the step
        v = z.T @ (weight * (z @ v))
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    rate = 1 / (0.25 * 1.1 * size + penalty + 0.25)
    w, b, w0, b0 = np.zeros(z.shape[1], np.float32), 0.0, np.zeros(z.shape[1], np.float32), 0.0
    for i in range(steps):
        fast = i / (i + 3)
        wy, by = w + fast * (w - w0), b + fast * (b - b0)
        error = weight * (sigmoid(z @ wy + by) - y)
        w0, b0 = w, b
        w, b = wy - rate * (z.T @ error + penalty * wy), by - rate * float(error.sum())
    plain = w / spread
    return Linear(plain.astype(np.float32), float(b - mean @ plain))


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make the logits probabilities (Newton's method on smoothed labels)."""
    pos, neg = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = sigmoid(a * logit + b)
        g = np.array([((p - goal) * logit).sum() + 1e-3 * (a - 1), (p - goal).sum()])
        d = p * (1 - p)
        h = np.array([[(d * logit * logit).sum() + 1e-3, (d * logit).sum()], [(d * logit).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -5, 5))
    return max(a, 0.0), b


@dataclass(frozen=True)
class CoTrained:
    """Both views' classifiers with their calibration and their weight in the combination."""

    parts: tuple[Linear, Linear]
    scale: tuple[tuple[float, float], tuple[float, float]]
    trust: tuple[float, float]
    prior: float

    def score(self, seen: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        if not self.parts:
            return np.full(len(seen[0]), self.prior)
        total = sum(t * (a * part.logit(x) + b) for part, x, (a, b), t in zip(self.parts, seen, self.scale, self.trust, strict=True))
        return sigmoid(total)


def draw(keys: np.ndarray, logit: np.ndarray, label: int, count: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and place of `count` of the rows that are confidently of the label, each key once; which: by a hash of the key."""
    least = np.log(CONFIDENT / (1 - CONFIDENT))
    sure = np.flatnonzero(logit >= least if label else logit <= -least)
    order, first = np.unique((arrays.mixed(keys[sure], step + 1) >> np.uint64(1)).view(np.int64), return_index=True)
    return order[:count], sure[first[:count]]


class Pool:
    """Draws pseudo-labels for one target from a table of views; what the labelled rows hold is left out."""

    def __init__(self, seen: DataFrame, known: np.ndarray) -> None:
        self.seen, self.taken = seen, [known, known]

    def __call__(self, models: list[Linear], counts: tuple[int, int], step: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each view what it hands on: the other view's features and labels. One pass over all documents judges them."""
        taken, names = self.taken, ["view", "label", "key", "place"]

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow as pa

            held = {(view, label): (np.zeros(0, np.int64), np.zeros(0, np.int64)) for view in (0, 1) for label in (0, 1)}
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys, x = batch.column("key").to_numpy(), unpacked(batch)
                for (view, label), (order, kept) in held.items():
                    free = np.flatnonzero(~np.isin(keys, taken[1 - view]))
                    more, at = draw(keys[free], models[view].logit(x[view][free]), label, counts[label], step)
                    order, first = np.unique(np.concatenate((order, more)), return_index=True)
                    held[view, label] = order[: counts[label]], np.concatenate((kept, keys[free[at]]))[first[: counts[label]]]
            for (view, label), (order, kept) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), view, np.int32)), pa.array(np.full(len(kept), label, np.int32)), pa.array(kept), pa.array(order)], names=names)

        best = Window.partitionBy("view", "label").orderBy("place", "key")
        offered = self.seen.select("key", "content", "metadata").mapInArrow(choose, "view int, label int, key long, place long").distinct()
        ranked = offered.withColumn("n", F.row_number().over(best)).where(F.col("n") <= max(counts)).where(F.col("n") <= F.when(F.col("label") == 1, counts[1]).otherwise(counts[0]))
        with common.tidy(self.seen.sparkSession):
            found = ranked.select("view", "label", "key").toPandas()  # at most 2 x HANDED rows
            wanted = self.seen.sparkSession.createDataFrame([(int(k),) for k in found["key"].unique()], "key long")
            views = self.seen.join(F.broadcast(wanted), "key").dropDuplicates(["key"]).select("key", "content", "metadata").toArrow().combine_chunks()
        x = unpacked(views) if views.num_rows else [np.zeros((0, len(m.weights)), np.float32) for m in models]
        row = {k: i for i, k in enumerate(views.column("key").to_pylist())}
        handed = []
        for view in (0, 1):
            own = found[found["view"] == view].sort_values(["label", "key"])
            self.taken[1 - view] = np.concatenate((self.taken[1 - view], own["key"].to_numpy(np.int64)))
            handed.append((x[1 - view][[row[k] for k in own["key"]]], own["label"].to_numpy(np.float64)))
        return handed


def co_train(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, calibrating: np.ndarray, pool: Callable) -> CoTrained:
    """Fit on labelled rows (two views) but for those marked as calibrating; pool: as Pool.

    Without both classes among the training rows there is nothing to learn: every score is the labels' mean.
    """
    learn = ~calibrating
    if len(y) == 0 or len(np.unique(y[learn])) < 2:
        return CoTrained((), (), (), float(y.mean()) if len(y) else 0.5)
    train = [([x[learn]], [y[learn]]) for x in labelled]
    share = float(y[learn].mean())
    counts = (max(1, round(HANDED * (1 - share))), max(1, round(HANDED * share)))
    models: list[Linear] = []
    for step in range(ROUNDS + 1):
        models = [fit(np.concatenate(xs), np.concatenate(ys)) for xs, ys in train]
        if step < ROUNDS:
            for view, (x, label) in enumerate(pool(models, counts, step)):
                train[1 - view][0].append(x)
                train[1 - view][1].append(label)
    check = calibrating if len(np.unique(y[calibrating])) == 2 else np.ones(len(y), bool)
    logits = [m.logit(x[check]) for m, x in zip(models, labelled, strict=True)]
    scale = tuple(platt(logit, y[check]) for logit in logits)
    loss = [-np.mean(np.log(np.where(y[check] > 0.5, p, 1 - p) + 1e-9)) for p in (sigmoid(a * logit + b) for (a, b), logit in zip(scale, logits, strict=True))]
    trust = np.array([1 / (x + 1e-3) for x in loss])
    trust /= trust.sum()
    return CoTrained(tuple(models), scale, (float(trust[0]), float(trust[1])), share)


COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
TARGETS = ("quality", "toxic")


@dataclass(frozen=True)
class Classifier:
    """The chosen word cells (ascending) and a co-trained model for each target."""

    chosen: np.ndarray
    models: dict[str, CoTrained]


def rows_of(batch) -> list[tuple]:
    return [(text or "", *rest) for text, *rest in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars")), strict=True)]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of what the views are made of."""
    return docs.withColumn("key", F.xxhash64("text", "lang", "source", "n_chars"))


def sample(docs: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """The views of at most MAX_LABELLED documents with a label, as bytes, with their labels."""
    order = F.xxhash64("doc_id", F.lit("sample"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.min(t).alias(t) for t in TARGETS]).where(" or ".join(f"{t} is not null" for t in TARGETS))
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    chosen = common.materialise(ids.join(marks, "doc_id").orderBy(order, "doc_id").limit(MAX_LABELLED))
    rows = keyed(docs).join(F.broadcast(chosen), "doc_id")  # at most MAX_LABELLED ids

    def view(batch) -> dict:
        rows = rows_of(batch)
        return {"cells": [word_cells(r[0]).tobytes() for r in rows], "plain": [text_view(r[0]).tobytes() for r in rows], "metadata": [metadata_view(*r).tobytes() for r in rows]}

    kept = ", ".join(f"{t} int" for t in TARGETS)
    packed = common.map_rows(rows, f"doc_id long, key long, {kept}, cells binary, plain binary, metadata binary", lambda: view, rows=256)
    # Of repeated ids with other texts the one with the smallest key.
    found = packed.toPandas().sort_values(["doc_id", "key"]).drop_duplicates("doc_id")
    common.release(chosen)
    return found


def views(docs: DataFrame, chosen: np.ndarray) -> DataFrame:
    """doc_id, key, content (the chosen words' bits, then the text view in half precision) and metadata of every row of docs."""

    def view(batch) -> dict:
        rows = rows_of(batch)
        content = [np.packbits(presence(word_cells(r[0]), chosen) > 0).tobytes() + text_view(r[0]).astype(np.float16).tobytes() for r in rows]
        return {"content": content, "metadata": [metadata_view(*r).astype(np.float32).tobytes() for r in rows]}

    return common.map_rows(keyed(common.pick(docs, **COLUMNS)), "doc_id long, key long, content binary, metadata binary", lambda: view, rows=256)


def unpacked(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Both views of rows of views(); bits beyond the chosen words are 0."""
    content = np.frombuffer(b"".join(batch.column("content").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    words = np.unpackbits(np.ascontiguousarray(content[:, : -2 * TEXT]), axis=1).astype(np.float32)
    plain = np.ascontiguousarray(content[:, -2 * TEXT :]).view(np.float16).astype(np.float32)
    metadata = np.frombuffer(b"".join(batch.column("metadata").to_pylist()), np.float32).reshape(batch.num_rows, WIDTH)
    return np.concatenate((words, plain), axis=1), metadata


#: Numbers of the metadata view.
WIDTH = len(metadata_view("", None, None, None))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Classifier, DataFrame]:
    """The classifier and the written views of all rows of docs."""
    labels = common.pick(labels, doc_id="long", quality="int", toxic="int")
    docs = common.pick(docs, **COLUMNS)
    rows = sample(docs, labels)
    calibrating = np.array([zlib.crc32(f"calibrate {i}".encode()) % CALIBRATE == 0 for i in rows["doc_id"]], bool)
    cells = [np.frombuffer(c, np.int32) for c in rows["cells"]]
    told = {t: rows[t].notna().to_numpy(bool) for t in TARGETS}
    fitted = [np.flatnonzero(told[t] & ~calibrating) for t in TARGETS]
    chosen = np.unique(np.concatenate([telling([cells[i] for i in at], rows[t].to_numpy(np.float64)[at]) for t, at in zip(TARGETS, fitted, strict=True)]))
    bits = -(-len(chosen) // 8) * 8
    words = np.zeros((len(rows), bits), np.float32)
    for i, c in enumerate(cells):
        words[i, : len(chosen)] = presence(c, chosen)
    plain = [np.array([np.frombuffer(b, np.float32) for b in rows[name]], np.float32).reshape(len(rows), width) for name, width in (("plain", TEXT), ("metadata", WIDTH))]
    known = (np.concatenate((words, plain[0]), axis=1), plain[1])
    seen = common.materialise(views(docs, chosen))
    keys = rows["key"].to_numpy(np.int64)
    models = {t: co_train(tuple(x[told[t]] for x in known), rows[t][told[t]].to_numpy(np.float64), calibrating[told[t]], Pool(seen, keys)) for t in TARGETS}
    return Classifier(chosen, models), seen


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """A co-trained classifier for each target, from docs (the columns of documents) and labels (doc_id, quality, toxic).

    Each target learns from every sampled label that it has. Copies (equal text and metadata) are drawn once a round;
    ties of the draw go by key. Without labels or documents every score is a constant.
    """
    classifier, seen = learn(docs, labels)
    common.release(seen)
    return classifier


def scored(seen: DataFrame, classifier: Classifier) -> DataFrame:
    """What score() returns, of written views."""

    def judge(batch) -> dict:
        x = unpacked(batch)
        return {f"{t}_score": classifier.models[t].score(x).astype(np.float64) for t in TARGETS}

    out = common.map_rows(seen, f"doc_id long, {', '.join(f'{t}_score double' for t in TARGETS)}", lambda: judge, rows=4096)
    return out.withColumn("keep", (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5))


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, quality_score, toxic_score and keep (quality at least and toxicity under one half) of every row of docs.

    Null texts count as empty, null metadata as absent; repeated rows score alike, an empty table gives an empty one.
    Rows are independent: no shuffle.
    """
    return scored(views(docs, classifier.chosen), classifier)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score() by train()'s classifier, with the views of docs computed once for both."""
    classifier, seen = learn(docs, labels)
    out = common.materialise(scored(seen, classifier))
    common.release(seen)
    return out


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
