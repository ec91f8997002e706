"""Tables in text: rows of cells, header scan, choice of table, row and column, operations.

A table is one row with an array of rows, each an array of cells; rows and columns are chosen by folds over these arrays, so no table
is exploded and none meets another document's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import checks as C

# Cells of a line, words of headers and questions, phrases of columns and operations.
CELL = r"[A-Za-z][A-Za-z0-9%/&().-]*|\(?-?\$?\d[\d,]*(?:\.\d+)?%?\)?"
YEAR = r"^(?:19|20)\d{2}$"
UNIT_CELL = r"(?i)^\([^)]*(?:millions|thousands|usd|dollars)[^)]*\)$"
HEADER_WORDS = ("period", "year", "years", "quarter", "quarters", "total", "reported", "balance", "balances", "obligations", "name", "age", "title")
QUESTION_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "between", "by", "calculate", "calculated", "change", "difference", "do", "end", "ended", "for", "from", "give", "how", "in", "is", "me", "number", "numbers", "of", "on",
    "respective", "respectively", "show", "table", "than", "the", "this", "to", "value", "was", "what", "year", "years",
)
CONTENT_WORD = r"[a-z0-9%]+"
ACTIVITIES = ("granted", "vested", "forfeited", "exercised")
PRIORITY = (("as reported",), ("less than 1 year", "less than one year"), ("2-5 years", "2 5 years", "between 2-5 years"), ("first quarter",), ("second quarter",), ("third quarter",), ("fourth quarter",), ("total",))
CHANGES = ("percent change", "percentage change", "percentage increase", "percentage decrease", "percent increase", "percent decrease", "growth rate", "% change")
NOT_TOTALS = ("difference", "change", "increase", "decrease", "percentage", "percent")

ROW = "array<string>"


def cells_of(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(CELL), F.lit(0))


def bound(value: Column, made) -> Column:
    """made(value), with the value computed once however often it is read there, also within lambdas."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def is_year(cell: Column) -> Column:
    return F.trim(cell).rlike(YEAR)


def is_number(cell: Column) -> Column:
    return C.cell_number(cell).isNotNull()


def words(text: Column) -> Column:
    """Distinct telling words of a question or cell."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(CONTENT_WORD), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(*QUESTION_WORDS)))


def rows_from_text(text: Column) -> Column:
    """The lines with two cells or more, if two are; else each year with the number after it under Year and Value; else one row of all
    cells, if it has two; else none."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\r\n]+"), T.collapse), lambda x: x != "")
    rows = F.filter(F.transform(lines, cells_of), lambda r: F.size(r) >= 2)
    cells = cells_of(T.collapse(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")))

    def dated(cell: Column, i: Column) -> Column:
        after = F.filter(F.slice(cells, i + 2, F.greatest(F.size(cells) - i - 1, F.lit(0))), lambda c: is_number(c) & (c != cell))
        return F.when(cell.rlike(YEAR) & (F.size(after) > 0), F.array(cell, F.get(after, F.lit(0))))

    inferred = F.array_compact(F.transform(cells, dated))
    titled = F.concat(F.array(F.array(F.lit("Year"), F.lit("Value"))), inferred)
    none = F.expr(f"cast(array() as array<{ROW}>)")
    return F.when(F.size(rows) >= 2, rows).when(F.size(inferred) > 0, titled).when(F.size(cells) >= 2, F.array(cells)).otherwise(none)


def rows_from_markdown(text: Column) -> Column:
    """Cells between bars; the line of dashes goes."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\r\n]+"), lambda x: x.rlike(r"^\s*\|.*\|\s*$") & ~x.rlike(r"^[\s|:-]+$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), T.collapse))


def rows_from_html(html: Column) -> Column:
    """Cells of tr, td and th; rows without any text go. Tables inside a cell are read as more rows of the table."""
    rows = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<tr\b[^>]*>(.*?)(?:</tr\s*>|(?=<tr\b)|$)"), F.lit(1))
    plain = lambda c: T.collapse(reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&#39;", "'"), ("&amp;", "&")), F.regexp_replace(c, "<[^>]+>", " ")))
    cut = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1)), plain))
    return F.filter(cut, lambda r: F.exists(r, lambda c: c != ""))


def only_years(row: Column) -> Column:
    """Whether a row has numbers and all are years."""
    return F.exists(row, is_number) & ~F.exists(row, lambda c: ~is_year(c) & is_number(c))


def opens_header(row: Column) -> Column:
    """Whether a row can start a header: empty, numbers only years, no first cell, or a unit in it."""
    first = F.coalesce(T.collapse(F.get(row, F.lit(0))), F.lit(""))
    full = F.filter(F.transform(row, T.collapse), lambda c: c != "")
    return (first == "") | first.rlike(UNIT_CELL) | bound(full, lambda full: (F.size(full) == 0) | only_years(full))


def continues_header(row: Column) -> Column:
    """Whether a row can follow a header row: two texts or more, none a number, with a word of headers."""
    full = F.filter(F.transform(row, T.collapse), lambda c: c != "")
    return bound(full, lambda full: (F.size(full) >= 2) & ~F.exists(full, is_number) & F.arrays_overlap(words(F.array_join(full, " ")), F.array(*map(F.lit, HEADER_WORDS))))


def split_header(rows: Column) -> Column:
    """A struct of header (array of cells) and body (rows): a scan with the states header and body.

    Header rows are merged column by column, each text once. Without header rows the first row is the header, if it holds a text.
    A table of header rows alone is its own body; no rows give none.
    """

    def step(acc: Column, row: Column) -> Column:
        goes_on = acc["open"] & (opens_header(row) | ((acc["n"] > 0) & continues_header(row)))
        return F.struct((acc["n"] + goes_on.cast("int")).alias("n"), goes_on.alias("open"))

    def merged(heads: Column) -> Column:
        width = F.array_max(F.transform(heads, lambda r: F.size(r)))
        column = lambda i: F.array_join(F.array_distinct(F.filter(F.transform(heads, lambda r: T.collapse(F.coalesce(F.get(r, i), F.lit("")))), lambda c: c != "")), " ")
        return F.when(F.coalesce(width, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), width - 1), column)).otherwise(F.expr(f"cast(array() as {ROW})"))

    first = F.get(rows, F.lit(0))
    textual = F.exists(first, lambda c: ~is_number(c))
    rest = lambda k: F.when(F.size(rows) > k, F.slice(rows, k + 1, F.size(rows) - k)).otherwise(rows)
    no_cells = F.expr(f"cast(array() as {ROW})")
    split = lambda n: (
        F.when(F.size(rows) == 0, F.struct(no_cells.alias("header"), rows.alias("body")))
        .when(n > 0, F.struct(bound(F.slice(rows, F.lit(1), n), merged).alias("header"), rest(n).alias("body")))
        .when(textual, F.struct(first.alias("header"), rest(F.lit(1)).alias("body")))
        .otherwise(F.struct(no_cells.alias("header"), rows.alias("body")))
    )
    return bound(F.aggregate(rows, F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")), step)["n"], split)


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def table_score(question: Column, rows: Column, caption: Column) -> Column:
    """How well a table fits a question: shared words, two for each year in it, half for a caption."""
    text = F.concat_ws(" ", F.flatten(rows), F.coalesce(caption, F.lit("")))
    fit = bound(text, lambda text: shared(words(question), words(text)) + 2.0 * F.size(F.filter(C.years(question), lambda y: F.contains(text, y))))
    return fit + F.when(F.coalesce(caption, F.lit("")) != "", 0.5).otherwise(0.0)


def best_tables(tables: DataFrame, question: str = "question", by: str = "qid", key: str = "table_id") -> DataFrame:
    """Of each question's tables (by, key, question, rows, caption) the one that fits best; ties by key. Tables without rows don't count."""
    scored = tables.where(F.size("rows") > 0).withColumn("table_score", table_score(F.col(question), F.col("rows"), F.col("caption")))
    order = Window.partitionBy(by).orderBy(F.desc("table_score"), key)
    return scored.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def first_best(items: Column, score) -> Column:
    """The first item with the highest score, as a struct of score, order (its place, negative) and item; null where there is none with a score."""
    scored = F.transform(items, lambda x, i: F.struct(score(x).cast("double").alias("score"), (-i).alias("order"), x.alias("item")))
    return F.array_max(F.filter(scored, lambda s: s["score"].isNotNull()))


def has_value(row: Column) -> Column:
    return F.exists(row, lambda c: ~is_year(c) & is_number(c))


def selectable(rows: Column) -> Column:
    """The rows that aren't headers within (numbers only years), if any."""
    kept = F.filter(rows, lambda r: ~((F.size(r) == 0) | only_years(r)))
    return bound(kept, lambda kept: F.when(F.size(kept) > 0, kept).otherwise(rows))


def with_context(rows: Column) -> Column:
    """Each row with the words of the section it stands in: a struct of row, context and section (a row that names one)."""

    def step(acc: Column, r: Column) -> Column:
        first = F.coalesce(T.collapse(F.get(r, F.lit(0))), F.lit(""))
        section = first.endswith(":") & ~F.exists(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), is_number)
        opens = section | F.lower(first).rlike(r"^\s*(?:nonvested|outstanding)\s+at\b")
        placed = F.array(F.struct(r.alias("row"), acc["context"].alias("context"), section.alias("section")))
        return F.struct(F.when(opens, words(first)).otherwise(acc["context"]).alias("context"), F.concat(acc["rows"], placed).alias("rows"))

    none = F.expr(f"cast(array() as array<struct<row:{ROW},context:{ROW},section:boolean>>)")
    return F.aggregate(rows, F.struct(F.expr(f"cast(array() as {ROW})").alias("context"), none.alias("rows")), step)["rows"]


def told(rows: Column) -> Column:
    """What best_row() asks of each row of with_context(), as a struct: row, section, label (words of its first cell), said (its words and its section's), text, valued."""

    def of(x: Column) -> Column:
        row = x["row"]
        text = F.array_join(row, " ")
        parts = {"row": row, "section": x["section"], "label": words(F.coalesce(F.get(row, F.lit(0)), F.lit(""))), "said": F.array_union(words(text), x["context"]), "text": text, "valued": has_value(row)}
        return F.struct(*[c.alias(name) for name, c in parts.items()])

    return F.transform(with_context(rows), of)


def best_row(known: Column, asked: Column, labels: Column | None = None) -> Column:
    """The row of told() that fits a question's words best: two for each word in its label, .75 for each in it or its section, three for
    each label in it, .1 a cell, two less without a value; the first of equals. With labels only rows that hold one."""

    def score(x: Column) -> Column:
        total = 2.0 * shared(asked, x["label"]) + 0.75 * shared(asked, x["said"]) + 0.1 * F.size(x["row"]) - F.when(x["valued"], 0.0).otherwise(2.0)
        if labels is None:
            return F.when(~x["section"], F.round(total, 6))
        held = F.size(F.filter(labels, lambda y: F.contains(x["text"], y)))
        return F.when(~x["section"] & (held > 0), F.round(total + 3.0 * held, 6))

    return first_best(known, score)["item"]["row"]


def matchable(text: Column) -> Column:
    plain = F.regexp_replace(F.replace(F.lower(text), F.lit("one"), F.lit("1")), "[–—-]", "-")
    return T.collapse(F.regexp_replace(plain, "[^a-z0-9%$.-]+", " "))


def priority_column(header: Column, question: Column) -> Column:
    """The place of the first column under a phrase that the question names, phrases in their order; null without any."""
    heads = F.transform(header, matchable)
    asked = matchable(question)
    places = []
    for phrases in PRIORITY:
        at = F.array_position(F.transform(heads, lambda h: T.any_in(h, phrases)), True) - 1  # noqa: B023  used at once
        places.append(F.when(T.any_in(asked, phrases) & (at >= 0), at.cast("int")))
    return F.coalesce(*places)


def overlap_column(header: Column, question: Column, with_years: bool = False) -> Column:
    """The place of the column whose head shares most words with the question (two for each of its years); null where none does."""
    asked, years = words(question), C.years(question)

    def score(head: Column) -> Column:
        total = shared(asked, words(head))
        if with_years:
            total = total + 2 * F.size(F.filter(years, lambda y: F.contains(head, y)))
        return F.when(total > 0, total)

    return (-first_best(header, score)["order"]).cast("int")


def label_column(header: Column, label: Column) -> Column:
    """The place of the first column whose head holds the label; null without any."""
    at = F.array_position(F.transform(header, lambda h: F.contains(h, label)), True)
    return F.when((label != "") & (at > 0), (at - 1).cast("int"))


def aligned(header: Column, row: Column, place: Column) -> Column:
    """One further where a row has a label cell that the header lacks."""
    wider = (F.size(row) == F.size(header) + 1) & (F.size(row) > 0) & ~is_number(F.get(row, F.lit(0)))
    return place + wider.cast("int")


def last_number(row: Column, but: Column) -> Column:
    """The place of the last cell that is a number and isn't one of `but`; null without any."""
    at = F.array_max(F.array_compact(F.transform(row, lambda c, i: F.when(is_number(c) & ~F.array_contains(but, F.trim(c)), i))))
    return at


def operation(question: Column) -> Column:
    """What a question asks to be computed; a difference if nothing else."""
    low = F.lower(question)
    across = ~T.any_in(low, NOT_TOTALS) & low.rlike(r"\btotal\b") & low.rlike(r"\b(?:and|across|combined|together)\b")
    return (
        F.when(T.any_in(low, ("average", "mean")), "average").when(low.rlike(r"\bas\s+a\s+percentage\s+of\b|\bwhat\s+percentage\s+of\b"), "percentage_of_total")
        .when(T.any_in(low, CHANGES), "percentage_change").when(T.any_in(low, ("sum", "total of", "add ")) | across, "sum").otherwise("difference")
    )


def labelled(rows: Column, label: str) -> Column:
    """The rows whose first cell is the label, with or without a full stop."""
    return F.filter(rows, lambda r: F.trim(F.lower(F.coalesce(F.get(r, F.lit(0)), F.lit("")))).rlike(rf"^{label}\.?$"))


def first_number(row: Column) -> Column:
    return C.cell_number(F.get(F.filter(row, lambda c: is_number(c) & ~is_year(c)), F.lit(0)))


def with_values(tables: DataFrame, question: str) -> DataFrame:
    """tables (question, header, body, operation) with `values`, the numbers that the question computes with, as doubles.

    Those of the rows Low and High if it asks for both; for shares the row of the part and that of the whole; for averages the first and
    last row of an activity that it names; else of the years it names, by columns under them in the best row, or by the best row of
    each; for averages of the best row's values; else the table's first two values. Each step is a column of its own, computed once.
    """
    q, header, rows, years, asked = F.col(question), F.col("header"), F.col("__rows"), F.col("__years"), F.col("operation")
    number = lambda row, place: C.cell_number(F.get(row, place))
    inside = lambda row, place: F.when(place < F.size(row), place)
    phrase = lambda pattern, other: F.coalesce(F.nullif(F.regexp_extract(q, pattern, 1), F.lit("")), other)
    named = F.coalesce(*[F.when(F.lower(q).rlike(rf"\b{a}\b"), F.lit(i)) for i, a in enumerate(ACTIVITIES)])
    known = tables.withColumns({"__rows": selectable(F.col("body")), "__years": C.calculation_years(q), "__metric": overlap_column(header, q), "__column": overlap_column(header, q, with_years=True), "__asked": words(q)})
    known = known.withColumns({"__told": told(rows), "__both": F.array_contains("__asked", "high") & F.array_contains("__asked", "low")})
    row, words_of = F.col("__told"), F.col("__asked")
    part = lambda pattern, other: bound(words(phrase(pattern, other)), lambda asked: best_row(row, asked))
    # What only some questions compute with is made for these alone.
    known = known.withColumns({
        "__top": best_row(row, words_of), "__heads": F.transform(years, lambda y: label_column(header, y)), "__each": F.transform(years, lambda y: best_row(row, words_of, F.array(y))),
        "__part": F.when(asked == "percentage_of_total", part(r"(?i)\bof\s+(.+?)\s+as\s+a\s+percentage\s+of\b", q)), "__whole": F.when(asked == "percentage_of_total", part(r"(?i)\bas\s+a\s+percentage\s+of\s+(.+?)(?:\?|$)", F.lit("total"))),
        "__low": F.when(F.col("__both"), F.get(labelled(rows, "low"), F.lit(0))), "__high": F.when(F.col("__both"), F.get(labelled(rows, "high"), F.lit(0))),
        "__acted": F.when(asked == "average", F.get(F.array(*[F.when(named == i, labelled(rows, a)) for i, a in enumerate(ACTIVITIES)]), named)),
    })
    top = F.col("__top")
    own = F.filter(top, lambda c: is_number(c) & ~is_year(c))

    def of_row(row: Column, place: Column, but: Column) -> Column:
        return number(row, F.coalesce(inside(row, aligned(header, row, place)), last_number(row, but)))

    share = lambda row: of_row(F.col(row), inside(F.col(row), F.col("__metric")), C.years(q))
    end = lambda row: of_row(F.col(row), F.col("__column"), C.years(q))
    known = known.withColumns({
        "__under": F.array_compact(F.transform("__heads", lambda h: number(top, aligned(header, top, h)))), "__by_heads": F.exists("__heads", lambda h: h.isNotNull()),
        "__rest": F.transform(F.when(F.size(years) > 0, F.slice(own, F.lit(1), F.size(years))).otherwise(own), C.cell_number),
        "__by_year": F.array_compact(F.zip_with("__each", years, lambda row, y: of_row(row, inside(row, F.col("__metric")), F.array(y)))),
        "__shares": F.array_compact(F.array(share("__part"), share("__whole"))),
        "__ends": F.when(F.col("__both"), F.array_compact(F.array(end("__low"), end("__high")))),
        "__active": F.when(F.size("__acted") >= 2, F.array_compact(F.array(first_number(F.get("__acted", F.lit(0))), first_number(F.element_at("__acted", -1))))),
        "__all": F.transform(F.filter(F.flatten(rows), lambda c: is_number(c) & ~(is_year(c) & F.array_contains(years, F.trim(c)))), C.cell_number),
    })
    two = lambda c: F.size(c) >= 2
    average = F.when(two("__active"), F.col("__active")).when(F.col("__by_heads"), F.col("__under")).otherwise(F.col("__rest"))
    values = (
        F.when(two("__ends"), F.col("__ends")).when((asked == "percentage_of_total") & two("__shares"), F.col("__shares")).when((asked == "average") & (F.size(average) >= 2), average)
        .when(F.col("__by_heads") & two("__under"), F.slice("__under", 1, 2)).when(two("__by_year"), F.slice("__by_year", 1, 2)).otherwise(F.slice("__all", 1, 2))
    )
    done = known.withColumn("values", values)
    return done.drop(*[c for c in done.columns if c.startswith("__")])


def computed(values: Column, asked: Column) -> Column:
    """The result of an operation over its values; null with fewer than two, or by zero."""
    a, b = F.get(values, F.lit(0)), F.get(values, F.lit(1))
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    found = (
        F.when(asked == "average", total / F.greatest(F.size(values), F.lit(1))).when(asked == "sum", a + b).when(asked == "percentage_of_total", F.try_divide(a, b) * 100)
        .when(asked == "percentage_change", F.try_divide(b - a, F.abs(a)) * 100).otherwise(b - a)
    )
    return F.when(F.size(values) >= 2, found)


def answer_table(tables: DataFrame, question: str = "question") -> DataFrame:
    """tables (question, rows) with operation, values, result and text: the answer from one table's header and body."""
    parts = tables.withColumn("__t", split_header(F.col("rows"))).select(*tables.columns, "__t.header", "__t.body", operation(F.col(question)).alias("operation"))
    found = with_values(parts, question)
    done = found.withColumn("result", F.round(computed(F.col("values"), F.col("operation")), 6))
    suffix = F.when(F.col("operation").startswith("percentage"), "%").otherwise("")
    told = F.concat(F.lit("The "), F.replace("operation", F.lit("_"), F.lit(" ")), F.lit(" is "), T.format_number(F.col("result")), suffix, F.lit("."))
    return done.withColumn("text", F.coalesce(told, F.lit("")))
