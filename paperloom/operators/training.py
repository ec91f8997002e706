"""Training data: records, audits, splits, sampling, set operations, leakage checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prefix as P

# What a text may not carry into training data.
SECRETS = (("email", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}"), ("credential", r"(?i)(password|secret|token|api[_-]?key)\s*[:=]"), ("address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), ("path", r"[A-Za-z]:\\|/home/|/root/"))


def stable_key(key: Column, seed: str) -> Column:
    """A hash that orders rows the same way everywhere."""
    return F.sha2(F.concat(F.lit(seed), F.lit("\0"), key.cast("string")), 256)


def stable_subset(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The n rows with the smallest hash."""
    return rows.orderBy(stable_key(F.col(key), seed), key).limit(n)


def split_by_key(key: Column, seed: str) -> Column:
    """train, dev or test in parts of 80, 10 and 10 percent, by the hash's last eight bytes modulo ten."""
    part = F.conv(F.substring(stable_key(key, seed), 49, 16), 16, 10).cast("decimal(20,0)") % 10
    return F.when(part == 0, "test").when(part == 1, "dev").otherwise("train")


def interleave(rows: DataFrame, group: str, order: str, *ties: str) -> DataFrame:
    """Round robin over the groups: place is the row's position in the mix. A group's rows are ranked by ranges of their keys, so that
    no group is one task's."""
    names = [r[0] for r in rows.select(group).distinct().collect()]  # as many as there are groups
    parts = [P.running(rows.where(F.col(group).eqNullSafe(n)), order, list(ties), name="turn") for n in names]
    if not parts:
        return rows.withColumn("place", F.lit(0).cast("long"))
    ranked = reduce(DataFrame.unionByName, parts)
    per_turn = P.running(ranked.groupBy("turn").agg(F.count("*").alias("n")), "turn", [], F.col("n"), "base").select("turn", (F.col("base") - F.col("n")).alias("base"))
    within = ranked.withColumn("k", F.row_number().over(Window.partitionBy("turn").orderBy(group)))  # a row a group
    return within.join(per_turn, "turn").withColumn("place", F.col("base") + F.col("k")).drop("turn", "k", "base")


def windows_to_target(windows: DataFrame, key: str, bucket: str, size: str, preferred: str, baseline: str, target: int, most: int, seed: str) -> DataFrame:
    """The windows (all columns) that are chosen, with place (from 1; baseline windows have none) and upto (sizes so far).

    Baseline windows come first, whatever their sizes. Then, until the sizes sum to the target, the next one is of the bucket with the
    fewest so far; of equals a preferred one, then by a stable hash. One that would take the sum over `most` is left out. In
    distributed form: each bucket's rows are ranked, which gives their order in the mix, and running totals tell where the target lies. Where a
    window is too large, all that are at that point go, and the rest goes on from there: at most as many rounds as there are sizes.
    Keys are unique; null sizes count 0.
    """
    n = F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))
    given = windows.withColumns({"__n": n, "__rest": F.when(F.col(preferred), 0).otherwise(1), "__hash": stable_key(F.col(key), seed)}).withColumn("__hash", F.concat(F.col("__rest").cast("string"), "__hash"))
    fixed = given.where(F.coalesce(F.col(baseline), F.lit(False)))
    waiting = given.where(~F.coalesce(F.col(baseline), F.lit(False)))
    counts = dict(fixed.groupBy(bucket).count().collect())  # a row a bucket
    total = fixed.agg(F.sum("__n")).first()[0] or 0
    chosen, places = [fixed.withColumns({"place": F.lit(None).cast("long"), "upto": F.lit(None).cast("long")})], 0
    names = [r[0] for r in waiting.select(bucket).distinct().collect()]
    while total < target:
        waiting = waiting.where(F.col("__n") <= most - total)
        parts = [P.running(waiting.where(F.col(bucket).eqNullSafe(b)), "__hash", [key], name="__turn").withColumn("__turn", F.col("__turn") + counts.get(b, 0)) for b in names]
        if not parts:
            break
        mixed = reduce(DataFrame.unionByName, parts)
        turns = P.running(mixed.groupBy("__turn").agg(F.sum("__n").alias("__sum")), "__turn", [], F.col("__sum"), "__all").select("__turn", (F.col("__all") - F.col("__sum")).alias("__before"))
        own = Window.partitionBy("__turn").orderBy("__hash", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a bucket
        summed = mixed.withColumn("__in", F.sum("__n").over(own)).join(turns, "__turn").withColumn("upto", F.col("__before") + F.col("__in") + total)
        before = F.col("upto") - F.col("__n")
        # The first window that is too large where it stands ends this round; those before it are chosen up to the target.
        stop = summed.where((before < target) & (F.col("upto") > most)).agg(F.min(F.struct("__turn", "__hash", key)).alias("s")).first()["s"]
        took = summed.where(before < target)
        if stop is not None:
            at = [F.lit(v).cast(took.schema[c].dataType) for c, v in zip(("__turn", "__hash", key), stop, strict=True)]
            took = took.where(F.struct("__turn", "__hash", key) < F.struct(*[a.alias(c) for a, c in zip(at, ("__turn", "__hash", key), strict=True)]))
        took = took.persist()
        rows = took.groupBy(bucket).agg(F.count("*"), F.sum("__n")).collect()  # a row a bucket
        placed = P.running(took, "__turn", ["__hash", key], name="place").withColumn("place", F.col("place") + places)
        chosen.append(placed.select(*given.columns, "place", "upto"))
        places, total = places + sum(r[1] for r in rows), total + sum(r[2] for r in rows)
        for b, k, _ in rows:
            counts[b] = counts.get(b, 0) + k
        if stop is None:
            break
        waiting = waiting.join(took.select(key), key, "left_anti")
    return reduce(DataFrame.unionByName, chosen).drop("__n", "__rest", "__hash")


def quota(rows: DataFrame, group: str, quotas: dict[str, int], *order: Column) -> DataFrame:
    """At most a group's quota of rows, the first ones."""
    most = reduce(lambda c, x: c.when(F.col(group) == x[0], x[1]), quotas.items(), F.when(F.lit(False), 0)).otherwise(0)
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("__n") <= most).drop("__n")


def largest_remainder(shares: dict[str, float], total: int) -> dict[str, int]:
    """Whole quotas that sum to the total."""
    exact = {k: v * total for k, v in shares.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (-(exact[k] - out[k]), k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def backfilled(quotas: dict[str, int], have: dict[str, int], total: int) -> dict[str, int]:
    """Quotas cut to what each group has, and what is then missing of the total filled up a row at a time from the groups with rows left,
    in the order of their names, round by round; fewer than the total where all groups are used up."""
    out = {k: min(q, have.get(k, 0)) for k, q in quotas.items()}
    missing = total - sum(out.values())
    while missing > 0 and (open_ := sorted(k for k in out if have.get(k, 0) > out[k])):
        rounds = min(missing // len(open_), min(have[k] - out[k] for k in open_))
        for k in open_ if rounds else open_[:missing]:
            out[k] += rounds or 1
        missing = total - sum(out.values())
    return out


def audit(records: DataFrame, text: str) -> DataFrame:
    """records with issues: an array of what is wrong with each text."""
    t = F.col(text)
    found = [F.when(t.isNull() | (F.trim(t) == ""), "empty"), F.when(F.length(t) > 5000, "too_long"), F.when(~F.substring(F.trim(t), -1, 1).rlike("[.!?]"), "cut_off"), *[F.when(t.rlike(p), name) for name, p in SECRETS]]
    return records.withColumn("issues", F.array_compact(F.array(*found)))


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key and side (missing: in a alone, extra: in b alone, both) of all keys."""
    both = a.select(key, F.lit(1).alias("a")).distinct().join(b.select(key, F.lit(1).alias("b")).distinct(), key, "full_outer")
    return both.select(key, F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("both").alias("side"))


def first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """The union of the parts with one row for each key, that of the first part that has it."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)])
    own = Window.partitionBy(key).orderBy("__part")
    return rows.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n", "__part")


def messages(turns: DataFrame, key: str) -> DataFrame:
    """key and messages (role, content) in order of turn."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy(key).agg(F.transform(rows, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def decoys(boards: DataFrame, key: str, order: str, answer: str, text: str, reach: int = 16) -> DataFrame:
    """For each row the nearest later row on the ring whose text doesn't hold the row's answer; null if no row of the ring is one.

    Rows meet at equal places of the ring after shifts by 1 .. reach: an equi-join with that many rows each.
    Those still without a decoy go on alone, over twice as many shifts, until the ring is used up.
    """
    total = boards.count()
    placed = P.running(boards, order, [key], name="at").withColumn("at", F.col("at") - 1).persist()
    other = placed.select("at", F.col(key).alias("decoy"), F.col(text).alias("other"))
    # A null or empty answer is lacked by no text.
    waiting = placed.where(F.col(answer) != "").select(key, answer, "at")
    found, low = [], 1
    while low < total:
        high = min(low + reach, total) - 1
        asked = waiting.select(key, answer, F.explode(F.sequence(F.lit(low), F.lit(high))).alias("shift"), "at").withColumn("at", F.pmod(F.col("at") + F.col("shift"), F.lit(total)))
        fit = asked.join(other, "at").where((F.col("decoy") != F.col(key)) & ~F.contains(F.lower("other"), F.lower(answer)))
        found.append(fit.groupBy(key).agg(F.min_by("decoy", "shift").alias("decoy")).persist())
        waiting = waiting.join(found[-1], key, "left_anti").persist()
        if waiting.isEmpty():
            break
        low, reach = high + 1, 2 * reach
    if not found:
        return boards.select(key, F.lit(None).cast(boards.schema[key].dataType).alias("decoy"))
    return boards.select(key).join(reduce(DataFrame.union, found), key, "left")
