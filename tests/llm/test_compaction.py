import hashlib
import random
import zlib

from paperloom.llm import compaction, radix
from pyspark.sql import functions as F


def slow_heads(files, limit):
    """part, place -> head; files: part, place, size, chosen."""
    heads, state = {}, {}
    for part, place, size, chosen in sorted(files):
        if not chosen:
            heads[part, place] = place
            continue
        total, head = state.get(part, (limit + 1, None))
        total, head = (size, place) if total + size > limit else (total + size, head)
        state[part], heads[part, place] = (total, head), head
    return heads


def test_next_fit_against_a_fold(spark):
    rng = random.Random(1)
    files = []
    for part, n, spread, sizes in (("a", 700, 1, (0, 0, 1, 3, 7)), ("b", 300, 97, (0, 1, 2, 30, 99, 100, 101, 400)), ("c", 40, 5000, (0, 100, 100, 250)), ("d", 1, 1, (5,)), ("é", 500, 3, (0,))):
        places = rng.sample(range(-50, n * spread), n)
        files += [(part, p, rng.choice(sizes), rng.random() < 0.8) for p in places]
    got = compaction.next_fit(spark.createDataFrame(files, "part string, place long, size long, chosen boolean"), 100).collect()
    assert {(r.part, r.place): r.head for r in got} == slow_heads(files, 100)


def test_steps_follow_every_entry():
    rng = random.Random(2)
    for _ in range(300):
        limit = rng.randint(1, 12)
        cuts = [[rng.randint(0, limit + 2) for _ in range(rng.randint(1, 6))] for _ in range(3)]
        upto, f = 0, None
        for sizes in cuts:
            g = compaction.steps_of(list(range(upto, upto + len(sizes))), sizes, limit)
            f, upto = g if f is None else f.then(g, limit), upto + len(sizes)
        for entry in range(limit + 2):
            total, head = entry, None
            for place, size in enumerate(sum(cuts, [])):
                total, head = (size, place) if total + size > limit else (total + size, head)
            assert f.on(entry, None, limit) == (min(total, limit + 1), head)


def test_crossing_and_ranks(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 3), rng.randint(0, 4) * 1000, rng.choice(["", "a", "a\0", "a\0b", "ab", "ü", "\U0001f600", "x" * 300]), i - 20) for i in range(60)]
    rows = list({r[:3]: r for r in rows}.values())
    key = F.concat(radix.number_key(-F.col("n")), radix.number_key(F.col("weight")), radix.text_key(F.col("part")))
    table = spark.createDataFrame(rows, "n long, weight long, part string, place long").withColumn("key", key).cache()
    want = sorted(rows, key=lambda r: (-r[0], r[1], r[2].encode()))
    for allowed in (0, 999, 1000, 5000, 20_000, sum(r[1] for r in rows) - 1, sum(r[1] for r in rows)):
        cut, fits, total = radix.crossing(table, allowed), 0, 0
        for r in want:
            total += r[1]
            if total > allowed:
                break
            fits += 1
        assert (table.count() if cut is None else table.where(F.col("key") < F.lit(cut)).count()) == fits
    got = radix.ranked(table).orderBy("index").collect()
    assert [r["index"] for r in got] == list(range(len(want))) and [(r.n, r.weight, r.part) for r in got] == [r[:3] for r in want]
    assert radix.crossing(table.limit(0), 0) is None and not radix.ranked(table.limit(0)).collect()


def expected(rows, limit):
    """All result rows of compact, from plain Python."""
    files, info = {}, {}
    for doc_id, text, source in rows:
        number = "" if doc_id is None else str(doc_id)
        h, block = zlib.crc32(number.encode()), (doc_id or 0) // 2000
        slot = min(h % 8, h // 8 % 8)
        live = h // 64 % 100 >= 9 * ((slot + block) % 8)
        files.setdefault((source or "", block * 8 + slot), []).append((live, doc_id is not None, doc_id or 0, f"{number}:".encode() + (text or "").encode() + b"\n", len((text or "").encode())))
    for f, members in files.items():
        size, kept = sum(m[4] for m in members), sum(m[0] for m in members)
        dirty = 100 * (len(members) - kept) >= 50 * len(members)
        info[f] = (size, sum(m[4] for m in members if m[0]), dirty, dirty or 100 * size < 75 * limit)
    heads, groups = slow_heads([(*f, v[1], v[3]) for f, v in info.items()], limit), {}
    for f in sorted(f for f in info if info[f][3]):
        groups.setdefault((f[0], heads[f]), []).append(f)
    queue = sorted(((-len(g), sum(info[f][0] for f in g), k[0].encode(), k[1]), g) for k, g in groups.items() if len(g) > 1 or info[g[0]][2])
    whole, upto, chosen = sum(q[0][1] for q in queue), 0, {}
    for i, (key, g) in enumerate(queue):
        upto += key[1]
        if 100 * upto > 30 * whole:
            break
        chosen[tuple(g)] = i // 4
    touched = {f for g in chosen for f in g}
    out = []
    for g, wave in [*chosen.items(), *(((f,), None) for f in files if f not in touched)]:
        live = sorted((m for f in g for m in files[f] if m[0]), key=lambda m: m[1:4])
        size = sum(info[f][0] for f in g)
        cost = None if wave is None else size + sum(info[f][1] for f in g) + 4096 * len(g)
        out.append((*g[0], len(g), len(live), size, cost, wave, hashlib.sha256(b"".join(m[3] for m in live)).hexdigest()))
    return sorted(out, key=str)


def check(spark, docs, limit):
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    assert sorted(map(tuple, compaction.compact(docs, limit).collect()), key=str) == expected(rows, limit)


def test_against_plain_python(spark, hard, clashing):
    check(spark, hard, 131072)
    check(spark, clashing, 200)
    rng = random.Random(4)
    rows = [(rng.randint(-3000, 40_000), rng.choice([None, "", "ä" * rng.randint(1, 90), "x" * rng.randint(0, 900)]), rng.choice(["a", "a", "b", None, "", "a\0"])) for _ in range(3000)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), 3000)


def test_nothing_and_all_untouched(spark, empty):
    assert not compaction.compact(empty).collect()
    one = spark.createDataFrame([(1, "abc", "s")], "doc_id long, text string, source string")
    assert compaction.compact(one).count() == 1
