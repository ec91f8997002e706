"""Small file compaction plan: next-fit groups of dirty and small files, a queue cut by a budget, waves.

Next fit is a fold over all files of a source, so the files are cut into segments by their places, and a segment is
summed up as a function: from the bytes of the group that is open on entry to those on exit, and the file that heads it. Such a
function is a few steps (where in the first group's bytes a new group starts), at most one for each byte of the limit. Functions
are composed up a tree of segments, 64 to a node; entries are handed down it; then every segment folds its own files.

The queue's cutoff is found by a radix drill-down over its order (files, bytes, key), and offsets of key ranges rank what
is chosen. Nothing but single numbers and 256 sums a step goes to the driver.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common, radix

LIMIT = 131072
FAN_BITS = 6
BLOCK = 2000
SLOTS = 8
FUNCTION = "part string, seg long, lows array<long>, sums array<long>, heads array<long>, add long"


class Steps:
    """What a run of files does to the open group: lows (ascending), the sum and head of the last group on exit from each low
    on (exclusive), and the bytes added where the run starts no group. A sum over the limit counts as limit + 1, as no group does."""

    def __init__(self, lows: list[int], sums: list[int], heads: list[int], add: int):
        self.lows, self.sums, self.heads, self.add = lows, sums, heads, add

    def on(self, total: int, head: int | None, limit: int) -> tuple[int, int | None]:
        k = bisect_left(self.lows, total) - 1
        return (self.sums[k], self.heads[k]) if k >= 0 else (min(total + self.add, limit + 1), head)

    def then(self, after: Steps, limit: int) -> Steps:
        """This run, then the next one."""
        first = self.lows[0] if self.lows else limit + 1
        steps = [(low - self.add, s, h) for low, s, h in zip(after.lows, after.sums, after.heads, strict=True) if low - self.add < first]
        steps = [(max(low, -1), s, h) for k, (low, s, h) in enumerate(steps) if low >= 0 or k + 1 == len(steps) or steps[k + 1][0] >= 0]
        for low, s, h in zip(self.lows, self.sums, self.heads, strict=True):
            steps.append((low, *after.on(s, h, limit)))
        kept: list[tuple[int, int, int]] = []
        for step in steps:
            if not kept or kept[-1][1:] != step[1:]:
                kept.append(step)
        return Steps(*([list(c) for c in zip(*kept, strict=True)] or [[], [], []]), self.add + after.add)


def steps_of(places: list[int], sizes: list[int], limit: int) -> Steps:
    """The function of some files in order."""
    upto = [0]
    for size in sizes:
        upto.append(upto[-1] + size)
    exits: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for j in reversed(range(len(sizes))):
        after = max(j + 2, bisect_right(upto, upto[j] + limit))
        exits[j] = exits[after - 1] if after < len(upto) else (min(upto[-1] - upto[j], limit + 1), places[j])
    lows, sums, heads = [], [], []
    for j, (total, head) in enumerate(exits):
        low = max(limit - upto[j + 1], -1)
        if lows and lows[-1] == low:
            continue  # an earlier file starts the group from the same sum on
        lows.append(low)
        sums.append(total)
        heads.append(head)
        if low < 0:
            break
    return Steps(lows[::-1], sums[::-1], heads[::-1], upto[-1])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of each (part, up), which come sorted; a run has at most 64."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if key != (row["part"], row["up"]):
                if rows:
                    yield key, rows
                key, rows = (row["part"], row["up"]), []
            rows.append(row)
    if rows:
        yield key, rows


def sorted_runs(rows: DataFrame, order: str) -> DataFrame:
    return rows.repartition("part", "up").sortWithinPartitions("part", "up", order)


def next_fit(files: DataFrame, limit: int = LIMIT) -> DataFrame:
    """files (part, place: unique within the part; size, chosen, ...) with head: the place of the first file of each one's group.

    Chosen files in the order of their places join the last group of their part, or start another where they would take it
    over the limit; the others head themselves. Every part is cut into segments; none goes through one task whole.
    """
    edges = files.agg(F.min("place").alias("low"), F.max("place").alias("high")).first()
    if edges["low"] is None:
        return common.materialise(files.withColumn("head", F.col("place")))
    def batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
        import pyarrow as pa

        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    def table(found: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in found:
            held.append(row)
            if len(held) == 1024:
                yield batch(held, names, types)
                held = []
        if held:
            yield batch(held, names, types)

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        def each() -> Iterator[tuple]:
            for (part, up), rows in runs(batches):
                if "size" in rows[0]:
                    f = steps_of([r["place"] for r in rows], [r["size"] for r in rows], limit)
                else:
                    f = Steps([], [], [], 0)
                    for k, r in enumerate(rows):
                        g = Steps(r["lows"], r["sums"], r["heads"], r["add"])
                        f = f.then(g, limit) if k else g
                yield part, up, f.lows, f.sums, f.heads, f.add

        longs = pa.list_(pa.int64())
        yield from table(each(), ["part", "seg", "lows", "sums", "heads", "add"], [pa.string(), pa.int64(), longs, longs, longs, pa.int64()])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        def each() -> Iterator[tuple]:
            for (part, _), rows in runs(batches):
                total, head = rows[0]["total"], rows[0]["open"]
                for r in rows:
                    yield part, r["seg"], total, head
                    total, head = Steps(r["lows"], r["sums"], r["heads"], r["add"]).on(total, head, limit)

        yield from table(each(), ["part", "seg", "total", "open"], [pa.string(), pa.int64(), pa.int64(), pa.int64()])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        key, total, head = None, 0, None
        for given in batches:
            heads = []
            names = ("part", "up", "place", "size", "chosen", "total", "open")
            for part, up, place, size, chosen, entry, opened in zip(*(given.column(c).to_pylist() for c in names), strict=True):
                if key != (part, up):
                    key, total, head = (part, up), limit + 1 if entry is None else entry, opened
                if not chosen:
                    heads.append(place)
                    continue
                total, head = (size, place) if total + size > limit else (total + size, head)
                heads.append(head)
            yield given.append_column("head", pa.array(heads, pa.int64()))

    def up(column: str, low: int = 0):
        return F.shiftright(F.col(column) - F.lit(low), FAN_BITS).alias("up")

    some = files.where("chosen").select("part", up("place", edges["low"]), "place", F.col("size").cast("long").alias("size"))
    levels = [common.materialise(sorted_runs(some, "place").mapInArrow(functions, FUNCTION))]
    span = (edges["high"] - edges["low"]) >> FAN_BITS
    while span := span >> FAN_BITS:  # the top needs no function of its own
        levels.append(common.materialise(sorted_runs(levels[-1].withColumn("up", up("seg")), "seg").mapInArrow(functions, FUNCTION)))
    tops = levels[-1].withColumn("up", up("seg")).withColumns({"total": F.lit(limit + 1).cast("long"), "open": F.lit(None).cast("long")})
    state = common.materialise(sorted_runs(tops, "seg").mapInArrow(entries, "part string, seg long, total long, open long"))
    for level in reversed(levels[:-1]):
        handed = level.withColumn("up", up("seg")).join(state.withColumnRenamed("seg", "up"), ["part", "up"])
        below = common.materialise(sorted_runs(handed, "seg").mapInArrow(entries, "part string, seg long, total long, open long"))
        common.release(state)
        state = below
    entered = files.withColumn("up", up("place", edges["low"])).join(state.withColumnRenamed("seg", "up"), ["part", "up"], "left")
    placed = StructType([*entered.schema.fields, StructField("head", LongType())])
    out = common.materialise(sorted_runs(entered, "place").mapInArrow(fold, placed).drop("up", "total", "open"))
    for table_ in (*levels, state):
        common.release(table_)
    return out


def plan(files: DataFrame, limit: int = LIMIT, dirty_percent: int = 50, small_percent: int = 75, budget_percent: int = 30, per_wave: int = 4) -> DataFrame:
    """part, place, rows, live_rows, bytes, live_bytes of every file with head (the first file of its rewritten group; its own place
    if untouched) and wave (null if untouched).

    files: part, place (long, unique within the part), rows, live_rows, bytes, live_bytes; nulls count as an empty part and zeros. A file
    is dirty if dirty_percent of its rows are deleted, small if its bytes are under small_percent of the limit. Groups of two files, or with a dirty
    one, queue by most files, fewest bytes, smallest part and place; the longest prefix with budget_percent of the queue's bytes
    is rewritten, per_wave groups a wave. An empty table gives an empty one.
    """
    numbers = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("rows", "live_rows", "bytes", "live_bytes")]
    given = files.select(F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.col("place").cast("long").alias("place"), *numbers)
    dirty = F.expr(f"100 * (rows - live_rows) >= {dirty_percent} * rows")
    small = F.expr(f"100 * bytes < {small_percent} * {limit}")
    given = common.materialise(given.withColumns({"dirty": dirty, "size": F.col("live_bytes"), "chosen": dirty | small}))
    headed = next_fit(given, limit)
    common.release(given)
    groups = headed.where("chosen").groupBy("part", "head").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("weight"), F.max("dirty").alias("dirty")).where("n_files > 1 or dirty")
    key = F.concat(radix.number_key(-F.col("n_files")), radix.number_key(F.col("weight")), radix.text_key(F.col("part")), radix.number_key(F.col("head")))
    queue = common.materialise(groups.select("part", "head", "weight", key.alias("key")))
    whole = queue.agg(F.sum("weight")).first()[0] or 0
    cut = radix.crossing(queue, budget_percent * whole // 100)
    chosen = radix.ranked(queue.select("part", "head", "key") if cut is None else queue.where(F.col("key") < F.lit(cut)).select("part", "head", "key"))
    waves = chosen.select("part", "head", F.floor(F.col("index") / per_wave).cast("long").alias("wave"))
    out = headed.join(waves, ["part", "head"], "left")
    return out.select("part", "place", "rows", "live_rows", "bytes", "live_bytes", F.when(F.col("wave").isNull(), F.col("place")).otherwise(F.col("head")).alias("head"), "wave")


def digests(rows: DataFrame) -> DataFrame:
    """part, head and SHA-256 (lowercase hex) of the payloads (binary) of each, by doc_id; rows: part, head, doc_id, payload.

    Rows stream through a hasher in order, so memory doesn't grow with a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        def made(done: list[tuple]) -> pa.RecordBatch:
            parts, heads, found = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(heads, pa.int64()), pa.array(found, pa.string())], names=["part", "head", "live_sha256"])

        key, hasher = None, None
        for batch in batches:
            done = []
            for part, head, payload in zip(batch.column("part").to_pylist(), batch.column("head").to_pylist(), batch.column("payload"), strict=True):
                if key != (part, head):
                    if key is not None:
                        done.append((*key, hasher.hexdigest()))
                    key, hasher = (part, head), hashlib.sha256()
                hasher.update(payload.as_buffer())
            if done:
                yield made(done)
        if key is not None:
            yield made([(*key, hasher.hexdigest())])

    placed = rows.repartition("part", "head").sortWithinPartitions("part", "head", "doc_id", "payload")
    return placed.select("part", "head", "payload").mapInArrow(run, "part string, head long, live_sha256 string")


def rows_of(docs: DataFrame) -> DataFrame:
    """part, place, doc_id, live, bytes and text of every row of docs (doc_id, text, source): the file that it lies in.

    Null source and text are empty. A row without a doc_id has an empty number: crc32 of no bytes, block 0, and comes first.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    block = F.floor(F.coalesce(F.col("doc_id"), F.lit(0)) / F.lit(BLOCK).cast("decimal(10,0)")).cast("long")
    plain = common.pick(docs, doc_id="long", text="string", source="string")
    plain = plain.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("part"), h.alias("h"), block.alias("block"))
    slot = F.least(F.col("h") % SLOTS, F.floor(F.col("h") / SLOTS) % SLOTS)
    live = F.floor(F.col("h") / 64) % 100 >= 9 * F.pmod(F.col("slot") + F.col("block"), F.lit(8))
    placed = plain.withColumn("slot", slot)
    return placed.select("part", (F.col("block") * SLOTS + F.col("slot")).alias("place"), "doc_id", live.alias("live"), F.octet_length("text").cast("long").alias("bytes"), "text")


def compact(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The plan for the files of docs (doc_id, text, source): part, place of the first file, n_files, live_rows, bytes, cost, wave, live_sha256
    of each rewritten group and each untouched file. Repeated rows are rows of their file each, by text where doc_ids are equal."""
    rows = rows_of(docs)
    live = F.when(F.col("live"), F.col("bytes")).otherwise(0)
    files = rows.groupBy("part", "place").agg(F.count("*").alias("rows"), F.count_if("live").alias("live_rows"), F.sum("bytes").alias("bytes"), F.sum(live).alias("live_bytes"))
    planned = common.materialise(plan(files, limit))
    payload = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text"), F.lit("\n")).cast("binary")
    texts = rows.where("live").select("part", "place", "doc_id", payload.alias("payload"))
    marks = digests(texts.join(planned.select("part", "place", "head").hint("shuffle_hash"), ["part", "place"]))
    out = planned.groupBy("part", "head", "wave").agg(F.count("*").alias("n_files"), *[F.sum(c).alias(c) for c in ("live_rows", "bytes", "live_bytes")])
    out = out.join(marks, ["part", "head"], "left")
    cost = F.when(F.col("wave").isNotNull(), F.expr("bytes + live_bytes + 4096 * n_files"))
    mark = F.coalesce("live_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return out.select("part", F.col("head").alias("place"), "n_files", "live_rows", "bytes", cost.alias("cost"), "wave", mark.alias("live_sha256"))


def op11_file_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compact(common.table(spark, sf_dir, "documents"))
    block = F.floor(F.col("place") / F.lit(SLOTS).cast("decimal(10,0)")).cast("long")
    return found.select(F.col("part").alias("source"), block.alias("block"), F.pmod("place", F.lit(SLOTS).cast("long")).alias("slot"), "n_files", "live_rows", "bytes", "cost", "wave", "live_sha256")


def oracle() -> str:
    return """
with recursive crcs as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)),
plain as (select doc_id, coalesce(text, '') as body, coalesce(source, '') as source, cast(floor(doc_id / 2000) as bigint) as block,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ord(x) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h from documents, crcs),
slots as (select *, least(h % 8, (h // 8) % 8) as slot from plain),
placed as (select *, (h // 64) % 100 >= 9 * ((slot + block) % 8) as live from slots),
files as (select source, block, slot, count(*) as n, count(*) filter (live) as live_rows, sum(strlen(body)) as bytes, coalesce(sum(strlen(body)) filter (live), 0) as live_bytes from placed group by all),
judged as (select *, 100 * (n - live_rows) >= 50 * n as dirty, 100 * (n - live_rows) >= 50 * n or 4 * bytes < 3 * 131072 as chosen from files),
ordered as (select *, row_number() over (partition by source order by block, slot) as r from judged where chosen),
fitted as (select source, r, r as head, live_bytes as total from ordered where r = 1
  union all select o.source, o.r, case when f.total + o.live_bytes > 131072 then o.r else f.head end, case when f.total + o.live_bytes > 131072 then o.live_bytes else f.total + o.live_bytes end
  from fitted f join ordered o on o.source = f.source and o.r = f.r + 1),
members as (select o.*, f.head from ordered o join fitted f using (source, r)),
groups as (select source, head, min_by(block, r) as block, min_by(slot, r) as slot, count(*) as n_files, sum(bytes) as bytes from members group by source, head having count(*) > 1 or bool_or(dirty)),
queue as (select *, row_number() over w - 1 as i, sum(bytes) over (w rows unbounded preceding) as upto, sum(bytes) over () as whole from groups window w as (order by n_files desc, bytes, source, block, slot)),
waves as (select source, head, i // 4 as wave, block, slot from queue where 100 * upto <= 30 * whole),
assigned as (select j.source, j.block, j.slot, coalesce(w.block, j.block) as b0, coalesce(w.slot, j.slot) as s0, w.wave, j.live_rows, j.bytes, j.live_bytes
  from judged j left join members m using (source, block, slot) left join waves w on w.source = m.source and w.head = m.head),
marks as (select a.source, b0, s0, sha256(string_agg(p.doc_id || ':' || p.body || chr(10), '' order by p.doc_id, p.body)) as mark from assigned a join placed p using (source, block, slot) where p.live group by all)
select source, b0 as block, s0 as slot, count(*) as n_files, cast(sum(live_rows) as bigint) as live_rows, cast(sum(bytes) as bigint) as bytes,
  cast(case when wave is not null then sum(bytes) + sum(live_bytes) + 4096 * count(*) end as bigint) as cost, wave, coalesce(any_value(mark), sha256('')) as live_sha256
from assigned left join marks using (source, b0, s0) group by source, b0, s0, wave"""
