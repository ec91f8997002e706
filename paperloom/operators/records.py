"""Records: JSON recovery, citations, repair, alignment, identities, carried context."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts of names and paths that mark held-out or gold data.
HELD_OUT = ("dev", "val", "validation", "test", "heldout")
LEAKS = r"(?i)\"(gold[a-z_]*|answer_key|label)\"\s*:"
#: Fields of model outputs of all three contracts, and the types they are read as.
FIELDS = {
    "answer": str, "evidence_location": dict, "evidence": str, "reason": str, "reasoning_summary": str, "citation_block_ids": list, "citations": list, "evidence_used": (list, str), "supporting_refs": list, "support_status": str,
}
OUTPUT = "answer string, support_status string, supporting_refs array<string>"


def read_output(text: str | None) -> tuple[str | None, str]:
    """The JSON object of a model's output, and how it was come by: the whole text, the first object in it with a known field (after
    thoughts), single fields of one that is cut off, or not at all. A brace or quote in the prose before it doesn't matter."""
    import json

    decoder, whole = json.JSONDecoder(), (text or "").strip()

    def value_at(body: str, at: int):
        try:
            return decoder.raw_decode(body, at)[0]
        except (json.JSONDecodeError, RecursionError):
            return None

    def known(value) -> bool:
        return isinstance(value, dict) and not FIELDS.keys().isdisjoint(value)

    try:
        if isinstance(value := json.loads(whole), dict):
            return json.dumps(value, ensure_ascii=False), "whole"
    except (json.JSONDecodeError, RecursionError):
        pass
    body = whole.rsplit("</think>", 1)[-1].strip()
    at = body.find("{")
    while at >= 0:
        if known(value := value_at(body, at)):
            return json.dumps(value, ensure_ascii=False), "object"
        at = body.find("{", at + 1)
    parts = {}
    for name, kinds in FIELDS.items():
        key = body.find(f'"{name}"')
        colon = body.find(":", key + len(name) + 2) if key >= 0 else -1
        if colon >= 0:
            start = len(body) - len(body[colon + 1 :].lstrip())
            if isinstance(value := value_at(body, start), kinds):
                parts[name] = value
    return (json.dumps(parts, ensure_ascii=False), "fields") if parts else (None, "none")


def recovered(text: Column) -> Column:
    """A struct of json (the object in a model's output as text, null without any) and how (whole, object, fields, none).

    Python reads the texts in Arrow batches: where a string ends depends on the brace that a reading starts from, which no regular
    expression and no single fold tells.
    """

    @F.pandas_udf("json string, how string")
    def read(texts: pd.Series) -> pd.DataFrame:
        import pandas as pd

        return pd.DataFrame([read_output(t) for t in texts], columns=["json", "how"])

    return read(text)


def recover_json(text: Column) -> Column:
    """The fields of the first object in a text; what stands before and after it is ignored, a cut-off object gives what it holds."""
    return F.from_json(recovered(text)["json"], OUTPUT)


def citation_ids(output: Column) -> Column:
    """Distinct ids of all citation fields, in order."""
    return F.array_distinct(F.filter(F.concat(*[F.coalesce(output[f], F.array().cast("array<string>")) for f in ("citation_block_ids", "citations", "evidence_used")]), lambda x: F.trim(x) != ""))


def leaks_gold(json: Column) -> Column:
    return json.rlike(LEAKS)


def held_out_path(path: Column) -> Column:
    return F.exists(F.split(F.lower(path), "[/._-]"), lambda p: p.isin(*HELD_OUT))


def repair(answer: Column, evidence: Column, page: Column, top_text: Column, top_page: Column, pages: Column) -> Column:
    """Missing fields from the best block; a page that wasn't retrieved gives way to the best block's."""
    return F.struct(F.coalesce(answer, F.lit("")).alias("answer"), F.coalesce(evidence, top_text).alias("evidence"), F.when(F.array_contains(pages, page), page).otherwise(top_page).alias("page"))


def signature(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """A hash of each group's texts in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, F.sha2(text, 256).alias("h")))), lambda x: x["h"])
    return rows.groupBy(by).agg(F.sha2(F.array_join(parts, "\n"), 256).alias("signature"))


def shift_alignment(gold: DataFrame, seen: DataFrame, reach: int = 2) -> DataFrame:
    """For each gold page (doc_id, page) the nearest shift within reach that leads to a page seen; null if none."""
    asked = gold.select("doc_id", "page", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("shift")).withColumn("at", F.col("page") + F.col("shift"))
    hit = asked.join(seen.select("doc_id", F.col("page").alias("at")).distinct(), ["doc_id", "at"])
    best = hit.groupBy("doc_id", "page").agg(F.min_by("shift", F.struct(F.abs("shift"), "shift")).alias("shift"))
    return gold.join(best, ["doc_id", "page"], "left")


def carry_forward(rows: DataFrame, by: str, order: str, value: Column) -> DataFrame:
    """Each row with the last value that isn't null up to it."""
    return rows.withColumn("context", F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def balanced(rows: DataFrame, bucket: str, key: Column, id_: str, n: int) -> DataFrame:
    """n rows by round robin over the buckets, each in order of the key."""
    turn = F.row_number().over(Window.partitionBy(bucket).orderBy(key, id_))
    return rows.withColumn("turn", turn).orderBy("turn", bucket).limit(n)


def html_cells(tables: DataFrame, by: str, html: str) -> DataFrame:
    """by, row_idx, col_idx, cell of the rows of HTML tables; rows without text go."""
    found = tables.select(by, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_idx", "tr"))
    cells = found.select(by, "row_idx", F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", " "))).alias("cells"))
    return cells.where(F.exists("cells", lambda c: c != "")).select(by, "row_idx", F.posexplode("cells").alias("col_idx", "cell"))
