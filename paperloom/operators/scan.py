"""The best rows for each of many questions in one pass over the rows, without a row for each pair of both.

Each task scores its rows in batches by arrays and keeps what may still be among the k best of a question, so what is shuffled grows with
tasks, questions and k. Questions are the small side and go to every task. Scores are rounded to six decimals before they are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..sources.scratch import written

#: Numbers of a batch's table of scores, and of the products summed for it, that are held at once.
HELD = 2_000_000
#: More than rounding to six decimals adds to a score; less than any score.
ROUNDED, LOWEST = 5.1e-7, -1e300
#: Questions of a product of matrices.
SIDE = 1024


class Best:
    """The k best keys of each question so far: scores first, ties by key. What may be among them is kept as arrays, which are cut to the k best when they grow."""

    def __init__(self, questions: int, k: int, least):
        self.k, self.bar = k, np.array(np.broadcast_to(least, questions), float)
        self.parts, self.size, self.most = [], 0, max(4 * k * questions, 1 << 18)

    def add(self, scores: np.ndarray, keys: pa.Array, questions: np.ndarray | None = None) -> None:
        """scores: a row a question (of those given, or of all), a column a key; those that are under the bar when rounded, NaN and -inf aren't kept."""
        of = np.arange(len(self.bar)) if questions is None else questions
        over = lambda: scores >= np.maximum(self.bar[of] - ROUNDED, LOWEST)[:, None]  # noqa: E731  NaN fits nowhere
        fits = over()
        if scores.shape[1] > self.k and np.count_nonzero(fits) > 4 * self.k * len(of):
            place = scores.shape[1] - self.k
            kth = np.partition(np.where(fits, scores, -np.inf), place, axis=1)[:, place]
            self.bar[of] = np.maximum(self.bar[of], np.round(kth, 6))  # k of these columns reach it
            fits = over()
        row, at = np.nonzero(fits)
        value, row = np.round(scores[row, at], 6) + 0.0, of[row]
        right = value >= self.bar[row]
        if not right.any():
            return
        self.parts.append((row[right], value[right], keys.take(pa.array(at[right]))))
        self.size += len(self.parts[-1][0])
        if self.size > self.most:
            self.cut()

    def cut(self) -> None:
        row, value = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        keys = pa.concat_arrays([p[2] for p in self.parts])
        order = pc.sort_indices(pa.table({"q": row, "s": value, "key": keys}), sort_keys=[("q", "ascending"), ("s", "descending"), ("key", "ascending")], null_placement="at_start").to_numpy()
        own = row[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        full = order[place == self.k - 1]
        self.bar[row[full]] = np.maximum(self.bar[row[full]], value[full])
        kept = order[place < self.k]
        self.parts, self.size = [(row[kept], value[kept], keys.take(pa.array(kept)))], len(kept)

    def batch(self, qids: list, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
        if not self.parts:
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in (*kinds, pa.float64())], names)
        self.cut()
        row, value, keys = self.parts[0]
        return pa.RecordBatch.from_arrays([pa.array(qids, kinds[0]).take(pa.array(row)), keys.cast(kinds[1]), pa.array(value)], names)


def fields(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def ranked(found: DataFrame, k: int, key: str) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cut_to(blocks: DataFrame, terms: DataFrame, key: str, text: str = "text", scope: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """scope, key, doc_len, terms (places in the list, ascending), tfs: a row a block with the terms (term) that it holds; and the list.

    It is written once, as statistics and scores both read it. Rows that share scope and key are made one, as their postings are.
    """
    names = sorted(r[0] for r in terms.select("term").distinct().collect())

    def cut(batches):
        known = pa.array(names, pa.string())
        for batch in batches:
            words = batch.column("words")
            length = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
            place = pc.index_in(words.flatten().cast(pa.string()), value_set=known)
            hit = place.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(length), dtype="int64"), length)[hit]
            code, tf = np.unique(row * max(len(names), 1) + place.drop_null().to_numpy(zero_copy_only=False), return_counts=True)
            row, term = np.divmod(code, max(len(names), 1))
            ends = np.searchsorted(row, np.arange(len(length) + 1)).astype("int32")
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype("int32"))) for v in (term, tf)]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pc.list_value_length(words).cast(pa.int32()), *lists], [*scope, key, "doc_len", "terms", "tfs"])

    asked = blocks.select(*scope, key, T.tokens(F.col(text)).alias("words"))
    rows = written(asked.mapInArrow(cut, f"{fields(asked, *scope, key)}, doc_len int, terms array<int>, tfs array<int>"))
    return rows, names


def merged(rows: DataFrame, key: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """cut_to()'s rows, those of one scope and key as one."""
    by = F.xxhash64(*scope, key)
    again = rows.groupBy(by.alias("__h")).agg(F.count("*").alias("__n")).where("__n > 1").select("__h")
    if again.isEmpty():
        return rows
    marked = rows.withColumn("__h", by)
    each = marked.join(again, "__h", "left_semi").select(*scope, key, "doc_len", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    sums = each.groupBy(*scope, key, F.col("p.terms").alias("term")).agg(F.sum("p.tfs").cast("int").alias("tf"), F.max("doc_len").alias("doc_len"))
    pairs = F.array_sort(F.collect_list(F.struct("term", "tf")))
    one = sums.groupBy(*scope, key).agg(F.max("doc_len").alias("doc_len"), pairs.alias("p"))
    own = one.select(*scope, key, "doc_len", F.col("p.term").alias("terms"), F.col("p.tf").alias("tfs"))
    return marked.join(again, "__h", "left_anti").drop("__h").union(own)


class Asked:
    """Questions as arrays: for each term the questions that ask it, and how often."""

    def __init__(self, asked: DataFrame, names: list[str]):
        drawn = asked.select("qid", "term", "qtf").toArrow().to_pydict()
        self.qids = sorted(set(drawn["qid"]), key=lambda q: (q is not None, q))
        row, place = {q: i for i, q in enumerate(self.qids)}, {t: i for i, t in enumerate(names)}
        term = np.array([place[t] for t in drawn["term"]], int)
        order = np.argsort(term, kind="stable")
        self.question = np.array([row[q] for q in drawn["qid"]], int)[order]
        self.times = np.array(drawn["qtf"], float)[order]
        self.start = np.searchsorted(term[order], np.arange(len(names) + 1))

    def sums(self, row: np.ndarray, term: np.ndarray, values: np.ndarray, ends: np.ndarray):
        """(first, last, sums): sums of values for each question (rows) and row (columns), in steps of bounded size that end where a run of rows does."""
        many = self.start[term + 1] - self.start[term]
        cost = np.append(0, np.cumsum(np.bincount(row, many, ends[-1]) + len(self.qids)))
        bounds = [*ends[np.unique((cost[ends[:-1]] / HELD).astype(int), return_index=True)[1]], ends[-1]]
        for first, last in zip(bounds, bounds[1:], strict=False):
            a, b = np.searchsorted(row, (first, last))
            m = many[a:b]
            at = np.repeat(self.start[term[a:b]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            cell = self.question[at] * (last - first) + np.repeat(row[a:b] - first, m)
            yield int(first), int(last), np.bincount(cell, np.repeat(values[a:b], m) * self.times[at], len(self.qids) * (last - first)).reshape(len(self.qids), last - first)


def postings_of(terms: pa.Array, tfs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, term and tf of lists."""
    row = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    return row, terms.flatten().to_numpy(zero_copy_only=False).astype(int), tfs.flatten().to_numpy(zero_copy_only=False).astype(float)


def top_sums(rows: DataFrame, asked: DataFrame, names: list[str], k: int, key: str, weigh) -> DataFrame:
    """qid, key, score, rank: the k best of the rows (cut_to) with a score over 0 by the sum of qtf * weigh(term, tf, doc_len)."""
    given = Asked(asked, names)
    kinds = [to_arrow_type(asked.schema["qid"].dataType), to_arrow_type(rows.schema[key].dataType)]

    def best(batches):
        top = Best(len(given.qids), k, 1e-6)  # the least score over 0, as scores have six decimals
        for batch in batches:
            row, term, tf = postings_of(batch.column("terms"), batch.column("tfs"))
            length = pc.fill_null(batch.column("doc_len"), 0).to_numpy(zero_copy_only=False)
            for first, last, sums in given.sums(row, term, weigh(term, tf, length[row]), np.arange(batch.num_rows + 1)):
                top.add(sums, batch.column(key).slice(first, last - first))
        yield top.batch(given.qids, kinds, ["qid", key, "score"])

    found = rows.where(F.size("terms") > 0).select(key, "doc_len", "terms", "tfs").mapInArrow(best, f"{fields(asked, 'qid')}, {fields(rows, key)}, score double")
    return ranked(found, k, key)


def top_scoped(rows: DataFrame, asked: DataFrame, names: list[str], k: int, key: str, scope: str, weigh) -> DataFrame:
    """qid, scope, key, score, rank: the k best rows (cut_to) of each question in each scope; weigh(term, tf, doc_len, df, n, mean) has the scope's own
    statistics. A scope's rows are one task's, so that it needs no more than one shuffle of what was cut."""
    given = Asked(asked, names)
    kind = to_arrow_type(asked.schema["qid"].dataType)

    def best(batches):
        qids = pa.array(given.qids, kind)
        for batch in batches:
            held = batch.column("held")
            n = pc.list_value_length(held).to_numpy(zero_copy_only=False)
            inner = held.flatten()
            keys, lens, terms, tfs = (inner.field(i) for i in range(4))
            own = np.repeat(np.arange(len(n)), n)
            length = lens.to_numpy(zero_copy_only=False).astype(float)  # null: nan
            real = ~np.isnan(length)
            mean = np.bincount(own, np.where(real, length, 0), len(n)) / np.maximum(np.bincount(own, real, len(n)), 1)
            # Rows of a scope come by key; those with one key are one.
            other = pc.fill_null(pc.not_equal(keys.slice(1), keys.slice(0, max(len(keys) - 1, 0))), True).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(np.append(True, other | (own[1:] != own[:-1])))[: len(own)]
            row, term, tf = postings_of(terms, tfs)
            row = (np.searchsorted(heads, np.arange(len(own)), "right") - 1)[row]
            code, of = np.unique(row * max(len(names), 1) + term, return_inverse=True)
            tf = np.bincount(of, tf, len(code))
            row, term = np.divmod(code, max(len(names), 1))
            own, length = own[heads], np.nan_to_num(length[heads])
            _, of, df = np.unique(own[row] * max(len(names), 1) + term, return_inverse=True, return_counts=True)
            values = weigh(term, tf, length[row], df[of], n[own[row]], mean[own[row]])
            kept = {name: [] for name in ("q", "scope", "row", "score", "rank")}
            for first, last, sums in given.sums(row, term, values, np.searchsorted(own, np.arange(len(n) + 1))):
                if first == last:
                    continue
                starts = np.flatnonzero(np.append(True, own[first + 1 : last] != own[first : last - 1]))
                size = np.diff(np.append(starts, last - first))
                scores = np.where(sums > 0, np.round(sums, 6), -1.0)
                for rank in range(1, min(k, int(size.max())) + 1):
                    high = np.maximum.reduceat(scores, starts, axis=1)
                    place = np.where(scores == np.repeat(high, size, axis=1), np.arange(last - first), last - first)
                    place = np.minimum.reduceat(place, starts, axis=1)
                    q, s = np.nonzero(high >= 0)
                    at = place[q, s]
                    for name, value in zip(kept, (q, own[first + at], heads[first + at], scores[q, at], np.full(len(q), rank)), strict=True):
                        kept[name].append(value)
                    scores[q, at] = -1.0
            got = {name: np.concatenate(v) if v else np.zeros(0, int) for name, v in kept.items()}
            for a in range(0, len(got["q"]), 100_000):
                part = {name: v[a : a + 100_000] for name, v in got.items()}
                columns = [qids.take(pa.array(part["q"])), batch.column(scope).take(pa.array(part["scope"])), keys.take(pa.array(part["row"])), pa.array(part["score"].astype(float)), pa.array(part["rank"].astype("int32"))]
                yield pa.RecordBatch.from_arrays(columns, ["qid", scope, key, "score", "rank"])

    held = F.array_sort(F.collect_list(F.struct(key, "doc_len", "terms", "tfs"))).alias("held")
    return rows.groupBy(scope).agg(held).mapInArrow(best, f"{fields(asked, 'qid')}, {fields(rows, scope, key)}, score double, rank int")


def unasked(scores: np.ndarray, side: np.ndarray, me: np.ndarray) -> None:
    """No score for a question and its own row; side: numbers of the questions, ascending; me: the question that a row is, or -1."""
    at = np.flatnonzero((me >= side[0]) & (me <= side[-1]))
    row = np.searchsorted(side, me[at])
    same = side[row] == me[at]
    scores[row[same], at[same]] = -np.inf


def top_products(rows: DataFrame, asked: DataFrame, k: int, key: str, units, skip_self: bool = False) -> DataFrame:
    """qid, key, score, rank: the k rows nearest to each of asked (qid, v: unit vectors or others with a direction); units(batch) gives a batch's
    unit vectors, NaN for rows without one."""
    drawn = asked.select("qid", "v").toArrow().to_pydict()
    qids, wanted = drawn["qid"], np.array(drawn["v"], float).reshape(len(drawn["qid"]), -1)
    wanted = wanted / np.linalg.norm(wanted, axis=1, keepdims=True)
    row_of = {q: i for i, q in enumerate(qids)}
    kinds = [to_arrow_type(asked.schema["qid"].dataType), to_arrow_type(rows.schema[key].dataType)]

    def best(batches):
        top = Best(len(qids), k, -np.inf)
        sides = [np.arange(at, min(at + SIDE, len(qids))) for at in range(0, len(qids), SIDE)]
        step = max(1, HELD // min(max(len(qids), 1), SIDE))
        for batch in batches if qids else ():
            own = units(batch)
            me = np.array([row_of.get(name, -1) for name in batch.column(key).to_pylist()], int) if skip_self else None
            for at in range(0, batch.num_rows, step):
                keys = batch.column(key).slice(at, step)
                for side in sides:
                    scores = wanted[side] @ own[at : at + step].T
                    if skip_self:
                        unasked(scores, side, me[at : at + step])
                    top.add(scores, keys, side)
        yield top.batch(qids, kinds, ["qid", key, "score"])

    return ranked(rows.mapInArrow(best, f"{fields(asked, 'qid')}, {fields(rows, key)}, score double"), k, key)


def hashed_units(words: pa.Array, size: int) -> np.ndarray:
    """Unit vectors of lists of tokens as R.hash_encode has them: counts by the last byte of the first eight of a SHA-256."""
    coded = words.flatten().dictionary_encode()
    cell_of = np.array([hashlib.sha256(w.encode()).digest()[7] % size for w in coded.dictionary.to_pylist()], int)
    row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    counts = np.bincount(row * size + cell_of[coded.indices.to_numpy(zero_copy_only=False)], minlength=len(words) * size).reshape(len(words), size).astype(float)
    with np.errstate(invalid="ignore"):
        return counts / np.linalg.norm(counts, axis=1, keepdims=True)  # no token: NaN


def runs_met(rows: DataFrame, words: str, runs: list[tuple[list[str], int]], name: str) -> DataFrame:
    """rows without their words (an array), once for each of the runs of words that they hold: `name` has the run's number.

    Runs go to every task as a trie: a word that starts none is left at once, so a row's cost is about its words, however many runs there are.
    """
    kept = rows.drop(words)
    names = kept.columns
    known = sorted({w for run, _ in runs for w in run})
    place, many = {w: i for i, w in enumerate(known)}, max(len(known), 1)
    levels, state, left = [], dict.fromkeys(range(len(runs)), 0), list(range(len(runs)))
    while left := [r for r in left if len(runs[r][0]) > len(levels)]:
        step = {r: state[r] * many + place[runs[r][0][len(levels)]] for r in left}
        codes = np.array(sorted(set(step.values())))
        state.update({r: int(at) for r, at in zip(left, np.searchsorted(codes, [step[r] for r in left]), strict=True)})
        ended = [r for r in left if len(runs[r][0]) == len(levels) + 1]
        last, number = np.zeros(len(codes), bool), np.zeros(len(codes), "int64")
        last[[state[r] for r in ended]], number[[state[r] for r in ended]] = True, [runs[r][1] for r in ended]
        levels.append((codes, last, number))

    def meet(batches):
        told = pa.array(known, pa.string())
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(int)
            code = pc.fill_null(pc.index_in(lists.flatten().cast(pa.string()), value_set=told), -1).to_numpy(zero_copy_only=False).astype(int)
            row, end = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size), size)
            start, at = np.arange(len(code)), np.zeros(len(code), int)
            found = [np.zeros((0, 2), "int64")]
            for depth, (codes, last, number) in enumerate(levels):
                inside = start + depth < end[start]
                start, at = start[inside], at[inside]
                word = code[start + depth]
                step = np.where(word >= 0, at * many + word, -1)
                at = np.minimum(np.searchsorted(codes, step), len(codes) - 1)
                hit = codes[at] == step
                start, at = start[hit], at[hit]
                done = last[at]
                found.append(np.stack([row[start[done]], number[at[done]]], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            of = pa.array(pairs[:, 0])
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(of) for i in range(batch.num_columns - 1)], pa.array(pairs[:, 1])], [*names, name])

    return rows.select(*names, words).mapInArrow(meet, f"{fields(kept, *names)}, {name} long")
