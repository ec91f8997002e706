"""The greedy cover against one row at a time, with plain Python."""

import hashlib
import random

import pytest
from paperloom.operators.cover import greedy_cover


def slow(rows, seed, n):
    key = lambda i: hashlib.sha256(f"{seed}\0{i}".encode()).hexdigest()
    left, seen, out = {i: set(f or ()) - {None} for i, f in rows}, set(), []
    while left and len(out) < n:
        gain, _, i = min((-len(f - seen), key(i), i) for i, f in left.items())
        if not gain:
            break
        out.append((i, -gain))
        seen |= left.pop(i)
    return out + [(i, 0) for i in sorted(left, key=key)][: n - len(out)]


@pytest.mark.parametrize("n", [3, 40, 500])
def test_same_rows_and_places(spark, n):
    random.seed(n)
    rows = [(i, [f"f{random.randrange(60)}" for _ in range(random.randrange(7))]) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(50)] + [(300, None), (301, []), (302, [None, "f1"])]
    got = greedy_cover(spark.createDataFrame(rows, "id long, extra array<string>"), "id", "extra", "s", n).orderBy("place").collect()
    assert [(r.id, r.gain) for r in got] == slow(rows, "s", n)
    assert [r.place for r in got] == list(range(1, min(n, len(rows)) + 1))


def test_empty(spark):
    assert greedy_cover(spark.createDataFrame([], "id long, f array<string>"), "id", "f", "s", 4).collect() == []
