"""A partitioned vector index: cells around centroids, searched exactly by bounds on angles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..sources.scratch import written
from . import retrieval as R
from . import scan as S
from .retrieval import known, matrix

#: Rows that centroids are fitted on, by a hash of their id; every row is indexed.
SAMPLE = 20_000
MAX_CELLS = 4096
#: Cells are read in parts, so that one with many rows is no single task's.
SALTS = 8
#: Blocks of R.QUERY_BLOCK queries that go to every task at once, and how many times that is done; more queries meet the cells by a join.
MAX_PASSES = 32
#: Slack of comparisons, over what scores are rounded to.
SLACK = 2e-6


@dataclass
class Index:
    """rows: vec_id, unit, cell, angle (to the cell's centroid), salt; cells: cell, n, near, far (the least and the largest angle)."""

    centroids: np.ndarray
    rows: DataFrame
    cells: DataFrame


def fit(vectors: DataFrame, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Unit centroids of about the square root of the number of vectors: spherical k-means on a bounded sample."""
    usable = vectors.where(known("embedding"))
    n = usable.count()
    drawn = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select(F.col("embedding").cast("array<double>").alias("v")).toArrow()
    units = matrix(drawn.column("v").combine_chunks())
    if not len(units):
        return units
    k = max(1, min(MAX_CELLS, int(n**0.5), len(units)))
    centres = units[:k].copy()
    for _ in range(rounds):
        own = np.argmax(units @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def build(vectors: DataFrame, centroids: np.ndarray | None = None) -> Index:
    """Index of every vector (vec_id, embedding) that has a direction; vectors without one have no cosine and are left out."""
    centres = fit(vectors) if centroids is None else centroids
    usable = vectors.where(known("embedding")).repartition("vec_id").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))

    def place(batches):
        for batch in batches:
            units = matrix(batch.column("v"))
            near = units @ centres.T if len(units) else np.zeros((0, 1))
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list(units), pa.list_(pa.float64())), pa.array(cell, pa.int32()), pa.array(angle)], ["vec_id", "unit", "cell", "angle"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    placed = usable.mapInArrow(place, f"vec_id {kind}, unit array<double>, cell int, angle double").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    rows = written(placed.repartition("cell", "salt").sortWithinPartitions("cell"))
    return Index(centres, rows, rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far")))


def open_cells(index: Index, queries: DataFrame) -> DataFrame:
    """qid, query_unit, cell, toward (angle to the centroid), bound (no vector of the cell is nearer), n: a row a query and cell."""
    centres = index.centroids

    def aim(batches):
        for batch in batches:
            units = matrix(batch.column("v"))
            angles = np.arccos(np.clip(units @ centres.T, -1, 1)) if len(units) and len(centres) else np.zeros((len(units), 0))
            yield pa.RecordBatch.from_arrays([batch.column("qid"), pa.array(list(units), pa.list_(pa.float64())), pa.array(list(angles), pa.list_(pa.float64()))], ["qid", "query_unit", "angles"])

    kind = queries.schema["qid"].dataType.simpleString()
    aimed = queries.where(known("query")).select("qid", F.col("query").cast("array<double>").alias("v")).mapInArrow(aim, f"qid {kind}, query_unit array<double>, angles array<double>")
    each = aimed.select("qid", "query_unit", F.posexplode("angles").alias("cell", "toward"))
    # at most MAX_CELLS rows on the right
    both = each.join(F.broadcast(index.cells), "cell")
    return both.select("qid", "query_unit", "cell", "toward", F.greatest(F.lit(0.0), F.col("toward") - F.col("far"), F.col("near") - F.col("toward")).alias("bound"), "n")


@dataclass
class Asked:
    """Queries that go to every task: units, opened (bits of the cells that are read first)."""

    kind: DataType
    qids: list
    units: np.ndarray
    opened: np.ndarray


def aimed(index: Index, queries: DataFrame, wanted: int, reach: int) -> DataFrame:
    """qid, unit and opened (bits of the cells read first: the nearest by their bound, at least `reach` and as many as hold `wanted` vectors): a row a query."""
    centres, stats = index.centroids, index.cells.orderBy("cell").toArrow()  # at most MAX_CELLS rows
    cells, n, near, far = (stats.column(c).to_numpy() for c in ("cell", "n", "near", "far"))

    def aim(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, R.QUERY_BLOCK):
                some = batch.slice(at, R.QUERY_BLOCK)
                units = matrix(some.column("v"))
                toward = np.arccos(np.clip(units @ centres[cells].T, -1, 1)) if len(cells) else np.zeros((len(units), 0))
                order = np.lexsort((toward, np.maximum(0, np.maximum(toward - far, near - toward))), axis=1)
                before = np.cumsum(n[order], axis=1) - n[order]
                first = np.zeros((len(units), len(centres)), bool)
                np.put_along_axis(first, cells[order], (np.arange(len(cells)) < reach) | (before < wanted), axis=1)
                bits = pa.array([row.tobytes() for row in np.packbits(first, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("qid"), pa.array(list(units), pa.list_(pa.float64())), bits], ["qid", "unit", "opened"])

    usable = queries.where(known("query")).select("qid", F.col("query").cast("array<double>").alias("v")).dropDuplicates(["qid"])
    return usable.mapInArrow(aim, f"{S.fields(queries, 'qid')}, unit array<double>, opened binary")


def drawn(queries: DataFrame) -> Asked:
    """aimed() queries of a pass."""
    rows = queries.toArrow().to_pydict()
    n = len(rows["qid"])
    return Asked(queries.schema["qid"].dataType, rows["qid"], np.array(rows["unit"], float).reshape(n, -1), np.frombuffer(b"".join(rows["opened"]), np.uint8).reshape(n, -1))


def visited(index: Index, asked: Asked, k: int, skip_self: bool, kths: dict | None = None) -> DataFrame:
    """qid, vec_id, score: each query's k best of every task in the cells read first; or, with the k-th scores so far, those that reach them in other cells.

    A run of rows of one cell meets the queries that open it by a product of matrices. Nothing is made for a query and cell.
    """
    qids, units, opened, centres = asked.qids, asked.units, asked.opened, index.centroids
    stats = {r["cell"]: (r["near"], r["far"]) for r in index.cells.collect()} if kths is not None else {}  # at most MAX_CELLS rows
    least = np.array([-2.0 if kths is None else kths.get(q, -2.0) for q in qids])
    row_of = {q: row for row, q in enumerate(qids)}
    kinds = [to_arrow_type(t) for t in (asked.kind, index.rows.schema["vec_id"].dataType)]

    def opening(cell: int) -> np.ndarray:
        first = opened[:, cell >> 3] >> (7 - (cell & 7)) & 1 == 1
        if kths is None:
            return np.flatnonzero(first)
        near, far = stats[cell]
        toward = np.arccos(np.clip(units @ centres[cell], -1, 1))
        return np.flatnonzero(~first & (np.cos(np.maximum(0, np.maximum(toward - far, near - toward))) >= least - SLACK))

    def best(batches):
        top = S.Best(len(qids), k, least)
        for batch in batches if qids else ():
            cell = batch.column("cell").to_numpy()
            own = batch.column("unit").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            me = np.array([row_of.get(i, -1) for i in batch.column("vec_id").to_pylist()], int) if skip_self else None
            edges = [*np.flatnonzero(np.diff(cell, prepend=-1)).tolist(), batch.num_rows]
            for start, end in zip(edges, edges[1:], strict=False):
                open_ = opening(int(cell[start]))
                for side in np.split(open_, range(S.SIDE, len(open_), S.SIDE)) if len(open_) else ():
                    step = max(1, S.HELD // len(side))
                    for at in range(start, end, step):
                        to = min(at + step, end)
                        scores = units[side] @ own[at:to].T
                        if skip_self:
                            S.unasked(scores, side, me[at:to])
                        top.add(scores, batch.column("vec_id").slice(at, to - at), side)
        yield top.batch(qids, kinds, ["qid", "vec_id", "score"])

    return index.rows.mapInArrow(best, f"qid {asked.kind.simpleString()}, {S.fields(index.rows, 'vec_id')}, score double")


def joined(index: Index, probes: DataFrame, skip_self: bool, least: bool) -> DataFrame:
    """qid, vec_id, score of the vectors in the probed cells, for any number of queries: they meet the parts of the cells by a join."""
    pairs = index.rows.join(probes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["cell", "salt"])
    if skip_self:
        pairs = pairs.where(F.col("vec_id") != F.col("qid"))
    if least:
        pairs = pairs.where(F.cos(F.abs(F.col("toward") - F.col("angle"))) >= F.col("least") - SLACK)
    dot = F.aggregate(F.zip_with("unit", "query_unit", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return pairs.select("qid", "vec_id", F.round(dot, 6).alias("score"))


def search(index: Index, queries: DataFrame, k: int, exact: bool = True, probes: int = 0, skip_self: bool = False, near: DataFrame | None = None) -> DataFrame:
    """qid, vec_id, score, rank of the k nearest vectors by cosine to each of queries (qid, query); ties go by id.

    First the nearest cells are read, at least `probes` (an eighth of all, if 0) and as many as hold k vectors. Their k-th score is a
    bound: an angle differs from the query's by at least the difference of both to the centroid, so other cells that can't reach it are
    left out, and those that can are read. That makes the result exact. Without `exact` the first step is all; `near` is its result, if that is known.
    """
    reach = probes or max(1, -(-len(index.centroids) // 8))
    passes = R.passes_of(queries.count(), MAX_PASSES)
    if not passes:
        return searched(index, queries, k, exact, reach, skip_self)
    aim = written(aimed(index, queries, k + int(skip_self), reach))
    asked = [drawn(R.part(aim, passes, i)) for i in range(passes)]
    if near is None:
        near = R.top(reduce(DataFrame.union, [visited(index, part, k, skip_self) for part in asked]), k, "vec_id")
        if not exact:
            return near
        near = written(near)
    kths = dict(near.where(F.col("rank") == k).select("qid", "score").collect())  # at most a row a query, as the queries themselves
    more = [visited(index, part, k, skip_self, kths) for part in asked]
    return R.top(reduce(DataFrame.union, [near.select("qid", "vec_id", "score"), *more]), k, "vec_id")


def searched(index: Index, queries: DataFrame, k: int, exact: bool, reach: int, skip_self: bool) -> DataFrame:
    """search() for any number of queries, by a row a query and cell."""
    order = Window.partitionBy("qid").orderBy("bound", "toward", "cell")
    cells = written(open_cells(index, queries).withColumn("place", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    first = (F.col("place") <= reach) | (F.col("before") < k + int(skip_self))
    near = R.top(joined(index, cells.where(first), skip_self, False), k, "vec_id")
    if not exact:
        return near
    near = written(near)
    found = near.groupBy("qid").agg(F.count("*").alias("hits"), F.min("score").alias("kth"))
    least = F.when(F.col("hits") >= k, F.col("kth")).otherwise(F.lit(-2.0))
    rest = cells.where(~first).join(found, "qid", "left").withColumn("least", F.coalesce(least, F.lit(-2.0))).where(F.cos("bound") >= F.col("least") - SLACK)
    more = joined(index, written(rest.select("qid", "query_unit", "cell", "toward", "least")), skip_self, True)
    return R.top(near.select("qid", "vec_id", "score").union(more), k, "vec_id")


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """n (wanted hits) and recall of found ones, both qid and vec_id."""
    hits = found.select("qid", "vec_id", F.lit(1.0).alias("hit"))
    return wanted.select("qid", "vec_id").join(hits, ["qid", "vec_id"], "left").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))


def text_vectors(rows: DataFrame, key: str, text: str = "text", size: int = 256) -> DataFrame:
    """vec_id and embedding of texts by hashed token counts; texts without a token have none."""
    cells = R.hash_encode(rows, key, text, size).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("cell", "weight"))).alias("held"))
    return cells.select(F.col(key).alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0.0))).alias("embedding"))


MODES = ("bm25", "dense", "hybrid", "hybrid_rerank")


def retrieve(blocks: DataFrame, planned: DataFrame, modes: tuple[str, ...] = MODES, k: int = 5, pool: int = 20) -> DataFrame:
    """mode, qid, block_id, rrf, bm25, dense (the family's best score), rank of the k best blocks (block_id, text) in each mode.

    planned: qid and queries (an array). Each query is a source of its own in each arm, cut at `pool`; sources are fused by ranks,
    hybrids cut at `pool`, and hybrid_rerank orders those by the distinct words of the first query that they hold.
    """
    asked = planned.select("qid", F.posexplode("queries").alias("nth", "question")).withColumn("asked", F.concat_ws(":", F.col("qid").cast("string"), F.col("nth").cast("string")))
    each = asked.select(F.col("asked").alias("qid"), "question")
    arms = []
    if set(modes) - {"dense"}:
        arms.append(R.bm25_top(blocks, each, pool).select(F.lit("bm25").alias("family"), F.col("qid").alias("asked"), "block_id", "score", "rank"))
    if set(modes) - {"bm25"}:
        if R.few(each, R.MAX_PASSES * R.QUERY_BLOCK):
            near = R.hashed_top(blocks, each, pool)
        else:
            asking = text_vectors(each, "qid", "question").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
            near = search(build(text_vectors(blocks, "block_id")), asking, pool).withColumnRenamed("vec_id", "block_id")
        arms.append(near.select(F.lit("dense").alias("family"), F.col("qid").alias("asked"), "block_id", "score", "rank"))
    ranked = arms[0] if len(arms) == 1 else arms[0].union(arms[1])
    ranked = written(ranked.join(asked.select("asked", "qid"), "asked"))
    families = {"bm25": ["bm25"], "dense": ["dense"]}
    best = lambda family: F.max(F.when(F.col("family") == family, F.col("score"))).alias(family)
    out = []
    for mode in modes:
        used = ranked.where(F.col("family").isin(families.get(mode, ["bm25", "dense"])))
        fused = used.groupBy("qid", "block_id").agg(F.round(F.sum(1 / (R.RRF_K + F.col("rank"))), 9).alias("rrf"), F.min("rank").alias("best"), best("bm25"), best("dense"))
        placed = fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rrf"), "best", "block_id")))
        if mode == "hybrid_rerank":
            held = R.small(written(placed.where(F.col("rank") <= pool))).join(blocks.select("block_id", "text"), "block_id").join(asked.where("nth = 0").select("qid", "question"), "qid")
            words = held.withColumn("words", R.keyword_overlap(F.col("question"), F.col("text")))
            placed = words.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("words"), "rank", "block_id")))
        out.append(placed.where(F.col("rank") <= k).select(F.lit(mode).alias("mode"), "qid", "block_id", "rrf", "bm25", "dense", "rank"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.union(more)
    return rows
