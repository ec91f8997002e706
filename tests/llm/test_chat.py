import hashlib
import random

from paperloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, path string, turns int, formatted string, node int"


def slow(rows):
    """The digests straight from the rows."""
    by = {}
    for conv_id, turn, role, text in rows:
        by.setdefault(conv_id, []).append((turn is not None, turn if turn is not None else 0, role or "", text or ""))
    out = {}
    for conv_id, turns in by.items():
        turns = sorted(turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv_id] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def found(spark, rows, **limits):
    trees = chat.format_trees(spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA), **limits)
    got = chat.digests(chat.read_back(trees)).collect()
    assert len(got) == len({r.conv_id for r in got})
    return trees.collect(), {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got}


HARD = [
    (1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nhi"),
    (1, 1, "assistant", "\\<|\\|<\\|im_end|>\\n \\"),
    (2, None, None, None),
    (2, 3, "assistant", ""),
    (2, 3, "assistant", ""),
    (2, 3, "assistant", "tie"),
    (None, 0, "we\nird|<|role", "x"),
    (None, 1, "assistant", "é🙂<"),
    (4, 0, "user", "word " * 30_000),
    (4, 1, "assistant", "ok<"),
    (5, 9, "assistant", "<|endoftext|> \n\n  a"),
    (9007199254740993, 0, "assistant", "big id"),
]


def test_hard_rows(spark):
    _, got = found(spark, HARD)
    assert got == slow(HARD)
    assert found(spark, []) == ([], {})


def tree_rows(rng, n):
    rows = []
    for conv_id in range(n):
        for turn in range(rng.randint(1, 4)):
            rows.append((conv_id, turn, ("user", "assistant")[turn % 2], "first" if turn == 0 and rng.random() < 0.7 else f"text {rng.randint(0, 3)}"))
    return rows


def test_round_trip_with_small_pieces(spark):
    rows = tree_rows(random.Random(1), 200)
    for limits in ({}, {"max_tokens": 60}, {"max_members": 3}):
        trees, got = found(spark, rows, **limits)
        assert got == slow(rows)
        for t in trees:
            assert len(t.members) <= limits.get("max_members", chat.MAX_MEMBERS)
            assert len(t.token_ids) <= limits.get("max_tokens", chat.MAX_TOKENS) or len(t.members) == 1


def test_trees_share_turns_and_attend_to_their_path_alone(spark):
    rows = tree_rows(random.Random(2), 300)
    trees, _ = found(spark, rows)
    total = sum(len(t.token_ids) for t in trees)
    machine = chat.tokenizer(chat.vocabulary())
    alone = sum(sum(len(machine.encode(x).ids) for x in (chat.head(r), chat.escape(t), f"{chat.END}\n")) for _, _, r, t in rows)
    assert total < alone / 3
    for t in trees:
        assert [n.start for n in t.nodes][0] == 0 and [n.stop for n in t.nodes][:-1] == [n.start for n in t.nodes][1:]
        for i, node in enumerate(t.nodes):
            line, at = [], i
            while at >= 0:
                line.append(at)
                at = t.nodes[at].parent
                assert at < line[-1]
            tokens = sorted(x for k in line for x in range(t.nodes[k].start, t.nodes[k].stop))
            assert [x for s in node.attends for x in range(s.start, s.stop)] == tokens
            assert [t.position_ids[x] for x in tokens] == list(range(len(tokens)))
        same = [(n.parent, tuple(t.token_ids[n.start : n.stop])) for n in t.nodes]
        assert len(same) == len(set(same))


def test_escape_leaves_no_control_string():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choices(["<", "|", "\\", "n", "\n", "im_end", ">", "<|", chat.START, chat.END], k=rng.randint(0, 8)))
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
        role = text[:5]
        assert chat.parse(f"{chat.head(role)}{chat.escape(text)}{chat.END}\n" * 2) == [(role, text)] * 2
