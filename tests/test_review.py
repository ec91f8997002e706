"""The greedy choice of candidates against plain Python; hard rows of audits and triggers."""

from paperloom import catalog
from paperloom.operators import review as V
from paperloom.plans import review as P
from pyspark.sql import functions as F


def slow_top(board, target, k):
    quota = k if target in V.NUMERIC_TARGETS else min(6, k) if target == "unknown" else min(3, k)
    kept, numbers = [], 0
    for test in (lambda c: c["eligible"], lambda c: not any(r.startswith("drop:noisy") for r in c["reasons"])):
        for c in sorted(board, key=lambda c: (-c["score"], c["rank"])):
            numeric = c["kind"] in V.NUMERIC_KINDS
            if len(kept) < k and test(c) and not (numeric and numbers >= quota) and all(x["key"] != c["key"] for x in kept):
                kept.append(c)
                numbers += numeric
    return [c["rank"] for c in kept]


def test_type_aware_choice(spark, small):
    boards = {}
    for r in P.board(spark, small).collect():
        boards.setdefault((r.qid, r.target), []).append({**r.asDict(), "eligible": not r.reasons})
    got = {}
    for r in sorted(catalog.QUERIES["type_aware_topk"](spark, small).collect(), key=lambda r: r.topk_rank):
        got.setdefault(r.qid, []).append(r["rank"])
    assert got == {qid: kept for (qid, target), b in boards.items() if (kept := slow_top(b, target, 3))}


def test_numeric_quota(spark):
    rows = [(1.0 - i / 10, i, kind, str(key), ok, reasons) for i, (kind, key, ok, reasons) in enumerate([("numeric", 1, True, []), ("index", 2, True, []), ("numeric", 3, True, []), ("percentage", 4, True, []), ("text", 4, False, []), ("text", 5, False, ["drop:noisy_fragment"]), ("text", 1, True, []), ("text", 6, True, [])])]
    schema = "score double, rank int, kind string, key string, eligible boolean, reasons array<string>"
    board = [dict(zip(("score", "rank", "kind", "key", "eligible", "reasons"), r, strict=True)) for r in rows]
    df = spark.createDataFrame(rows, schema).groupBy().agg(F.collect_list(F.struct("*")).alias("b"))
    for target in ("text", "unknown", "numeric"):
        for k in (1, 5, 20):
            got = df.select(V.type_aware_top(F.col("b"), F.lit(target), k).alias("x")).first().x
            assert [c["rank"] for c in got] == slow_top(board, target, k)
    assert df.select(V.type_aware_top(F.slice("b", 1, 0), F.lit("text"), 5).alias("x")).first().x == []


def test_null_values(spark):
    target = F.expr("cast(null as struct<answer: string, evidence: string, location: struct<block_id: string, table_id: string, image_id: string, page_id: string>>)")
    row = spark.range(1).select(
        V.record_issues(F.lit(None).cast("string"), target, F.lit(True), F.lit("extractive")).alias("issues"),
        V.recovery_trigger(F.lit(None).cast("string"), F.lit("7"), F.lit(False), F.lit("What does the Figure say?"), F.lit(None).cast("string"), F.lit(0), F.lit(True)).alias("trigger"),
        V.rendered_sources(F.lit(None).cast("string"), F.expr("cast(null as array<struct<page: int, block_type: string, preview: string>>)")).alias("said"),
        V.adjacent_pages(F.lit(1), F.lit(None).cast("int")).alias("pages"),
    ).first()
    assert row.issues == ["location_not_object", "missing_user_prompt"] and row.trigger == "visual_evidence_missing" and row.said == "" and row.pages == [2]


def slow_spans(board, per_page, most, blocks, budget):
    spans, used, total = [], [], 0
    for b in sorted(board, key=lambda b: (-b.score, b["rank"], b.ord, b.block_id)):
        if len(spans) >= most or len(used) >= blocks:
            break
        if any(s[1] == b.block_id for s in spans) or sum(s[0] == b.page for s in spans) >= per_page or b.score <= 0 and spans:
            continue
        new = [w for w in b.window if w.block_id == b.block_id or w.block_id not in used][: blocks - len(used)]
        tokens = (sum(w.chars for w in new) + len(new) - 1 + 3) // 4
        if not new or budget and spans and total + tokens > budget:
            continue
        spans.append((b.page, b.block_id, [w.block_id for w in new]))
        used += [w.block_id for w in new if w.block_id not in used]
        total += tokens
    return spans


def test_span_selection(spark, medium):
    boards = P.span_boards(spark, medium).cache()
    rows = boards.collect()
    assert len(rows) == 40 and all(any(w.block_id == b.block_id for w in b.window) and len(b.window) <= 3 for r in rows for b in r.board)
    seen = set()
    for limits in ((3, 12, 32, None), (2, 6, 12, 400), (1, 30, 5, None), (5, 30, 64, 90)):
        got = {r.qid: [(s.page, s.primary, s.block_ids) for s in r.x] for r in boards.select("qid", V.select_spans(F.col("board"), *limits).alias("x")).collect()}
        assert got == {r.qid: slow_spans(r.board, *limits) for r in rows}
        seen.add(sum(map(len, got.values())))
    assert len(seen) == 4
    assert boards.limit(1).select(V.select_spans(F.slice("board", 1, 0)).alias("x")).first().x == []


def test_windows_around(spark):
    rows = [("p", i, f"b{i}", "x" * i) for i in range(1, 6)] + [("q", 1, "c", "")]
    got = {r.block_id: [(w.block_id, w.chars) for w in r.window] for r in V.windows_around(spark.createDataFrame(rows, "page string, ord int, block_id string, text string"), 1).collect()}
    assert got["b1"] == [("b1", 1), ("b2", 2)] and got["b3"] == [("b2", 2), ("b3", 3), ("b4", 4)] and got["c"] == [("c", 0)]
