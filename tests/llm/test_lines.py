import random

from paperloom.llm import lines


def slow(rows):
    """{(doc_id, text): removed line numbers}, every line against every earlier one."""
    seen, gone = [], {}
    order = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0]))
    for doc_id, text in order:
        gone[(doc_id, text)] = set()
        for k, line in enumerate(text.split("\n")):
            words = {w for w in "".join(" " if c in "\t\r" else c for c in line.lower()).split(" ") if w}
            if not words:
                continue
            if any(5 * len(words & other) >= 4 * len(words | other) for other in seen):
                gone[(doc_id, text)].add(k)
            seen.append(words)
    return gone


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = slow(rows)
    key = lambda r: tuple((x is None, x) for x in r)
    full = []
    for doc_id, text in rows:
        cut = [] if text is None else text.split("\n")
        out = sorted(want.get((doc_id, text), ()))
        full.append((doc_id, len(cut), out, None if text is None else "\n".join(x for k, x in enumerate(cut) if k not in out)))
    got = [(r.doc_id, r.n_lines, list(r.removed), r.text) for r in lines.dedup(docs).collect()]
    assert sorted(got, key=key) == sorted(full, key=key)
    return sum(len(r[2]) for r in full)


def test_hard_rows(hard, clashing, empty):
    assert check(hard) == 2 + 1  # documents 2 (twice) and the German line
    check(clashing)
    assert lines.dedup(empty).count() == 0
    out = lines.dedup_documents(clashing)
    assert out.columns == clashing.columns and out.count() == 12


def test_random_lines_against_all_pairs(spark):
    rng = random.Random(1)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(3000)]
    bases = [[rng.choice(common if rng.random() < 0.5 else rare) for _ in range(rng.randint(1, 30))] for _ in range(60)]
    rows = []
    for doc_id in range(120):
        text = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(bases))
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(line) + 1)
                line[at : at + rng.randint(0, 1)] = rng.choices(common + rare, k=rng.randint(0, 1))
            text.append(rng.choice((" ", "  ", "\t")).join(line).upper() if rng.random() < 0.2 else " ".join(line))
        rows.append((rng.choice((doc_id, doc_id - 60)) * 7, "\n".join(text)))
    ids = {}
    rows = [r for r in rows if ids.setdefault(r[0], r[1]) == r[1]]
    assert check(spark.createDataFrame(rows, "doc_id long, text string")) > 100


def test_large_group_of_similar_lines(spark):
    base = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join([*base[: i % 30], f"x{i}", *base[i % 30 + 1 :]])) for i in range(400)]
    assert check(spark.createDataFrame(rows, "doc_id long, text string")) == 399


def test_words_listed_two_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_CLASS", 4)  # cells with eight words or more
    test_random_lines_against_all_pairs(spark)
    test_large_group_of_similar_lines(spark)


def test_equal_ids_with_other_texts(spark):
    a, b = "one two three four five six", "one two three four five six seven"
    got = lines.dedup(spark.createDataFrame([(1, a), (1, b)], "doc_id long, text string")).collect()
    assert sorted(len(r.removed) for r in got) == [0, 1]


def test_lines_of_one_to_four_words(spark):
    texts = ["Home", "a b c d e", "All rights reserved.\nhome\n\n \t", "ALL RIGHTS\x0breserved.\na b c d", "d\xa0c\u3000b\x0ca\na b x", "a b\nb  a\nx b a\na b y z"]
    got = lines.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    removed = {r.doc_id: list(r.removed) for r in got.collect()}
    assert removed == {0: [], 1: [], 2: [1], 3: [0, 1], 4: [0], 5: [1, 2]}


def test_long_lists_pass_whole(spark, monkeypatch):
    monkeypatch.setattr(lines, "LONG_LIST", 3)
    test_random_lines_against_all_pairs(spark)


def test_table(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"))


def test_similar_lines_are_compared_with_few_earlier_ones(spark, monkeypatch):
    common_words = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"{common_words} own{i}") for i in range(200)], "doc_id long, text string")
    compared, matched = [], lines.matched

    def counting(pairs, sets):
        compared.append(pairs.distinct().count())
        return matched(pairs, sets)

    monkeypatch.setattr(lines, "matched", counting)
    gone = {r.doc_id for r in lines.dedup(docs).collect() if r.removed}
    assert gone == set(range(1, 200))
    assert sum(compared) < 700  # all pairs of a line and an earlier one: 19,900


def test_no_python_on_the_executors(spark, hard, monkeypatch):
    from pyspark.sql import DataFrame

    def refused(*_, **__):
        raise AssertionError("DataFrame functions only are asked for")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(hard), name, refused)
    assert isinstance(out := lines.dedup(hard), DataFrame) and out.count() == hard.count()


def test_all_white_space_of_split_parts_words(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) != "\n"]
    rows = [(0, "a\xdf b c d e"), (1, "1 2 3 4 5"), *((k + 2, f"{x}A\xdf{x}b{x}{x}c {x}d{x}E{x}") for k, x in enumerate(spaces)), *((k + 90, f"5{x}4{x}3{x}2{x}1") for k, x in enumerate(spaces))]
    gone = {r.doc_id for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect() if list(r.removed) == [0]}
    assert gone == {r[0] for r in rows[2:]}
