"""Token windows: every learned token once, read back as the assistant's texts; held against plain Python."""

from collections import defaultdict

import pytest
from paperloom.operators import windows as W
from paperloom.plans.windows import vocabulary


def slow(turns, known, length, stride):
    ids, learned = [], []
    for role, text in turns:
        for part, target in ((f"{W.START}{role}\n", False), (text, role == "assistant"), (f"{W.END}\n", False)):
            new = known.encode(part, add_special_tokens=False).ids
            ids += new
            learned += [target] * len(new)
    out, seen = [], 0
    for w, start in enumerate(range(0, len(ids), stride)):
        stop = min(start + length, len(ids))
        labels = [ids[i] if learned[i] and i >= seen else W.IGNORED for i in range(start, stop)]
        seen = max(seen, stop)
        if set(labels) - {W.IGNORED}:
            out.append((w, start, ids[start:stop], labels))
    return out


@pytest.fixture(scope="module")
def known():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary())
    found.encode_special_tokens = True
    return found


@pytest.mark.parametrize("length, stride", [(64, 48), (40, 40), (7, 1)])
def test_windows_of_all_conversations(spark, small, known, length, stride):
    rows = spark.read.parquet(f"{small}/conversations.parquet")
    given = defaultdict(list)
    for r in rows.orderBy("conv_id", "turn").collect():
        given[r.conv_id].append((r.role, r.text))
    got = defaultdict(list)
    for r in W.loss_windows(rows, vocabulary(), length, stride).orderBy("conv_id", "window").collect():
        got[r.conv_id].append((r.window, r.start, r.ids, r.labels))
    for conv, turns in given.items():
        assert got[conv] == slow(turns, known, length, stride)
        back = known.decode([v for w in got[conv] for v in w[3] if v != W.IGNORED], skip_special_tokens=False)
        assert back == "".join(t for r, t in turns if r == "assistant")


def test_hard_rows(spark, known):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "é中😀 <|endoftext|> " * 50), (2, 0, "assistant", None), (3, 0, None, "x"), (None, 0, "assistant", "null key"), (4, None, "assistant", "same"), (4, None, "assistant", "same"), (5, 0, "assistant", "")]
    got = W.loss_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), vocabulary(), 50, 30).orderBy("conv_id", "window").collect()
    back = defaultdict(list)
    for r in got:
        back[r.conv_id] += [v for v in r.labels if v != W.IGNORED]
    assert {k: known.decode(v, skip_special_tokens=False) for k, v in back.items()} == {1: rows[1][3], None: "null key", 4: "samesame"}
    assert W.loss_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), vocabulary(), 50, 30).collect() == []
    with pytest.raises(ValueError):
        W.loss_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), vocabulary(), 5, 6)
