"""Candidate answers of evidence spans: what a question asks for, eight generators, twelve score parts, boards.

A span is one row; everything found in it stays in one array until it is scored, so no text is copied for each pattern. Patterns
read letters, digits and word borders in Unicode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import checks as C
from . import review as V

# Words of questions, patterns of candidates and the weights of their scores.
FIELD_TERMS = ("%", "amount", "column", "date", "field", "heading", "index", "page", "percent", "percentage", "rate", "row", "segment", "share", "signature", "source", "table", "total", "value")
BOARD_FIELDS = (
    ("index", ("index",)), ("source", ("source",)), ("heading", ("heading", "title", "subject")), ("city", ("city",)), ("state", ("state",)), ("located", ("located",)), ("address", ("address",)),
    ("quarter", ("quarter", "short form", "abbreviation")), ("organization", ("organization",)), ("company", ("company",)), ("board", ("board",)), ("agency", ("agency",)), ("logo", ("logo",)), ("name", ("name",)),
)
QUESTION_STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "etc", "for", "from", "given", "how", "in", "is", "of", "on", "or", "that", "the", "this", "to", "what", "when", "where", "which", "who", "with")
TABLE_TERMS = ("column", "field", "index", "percentage", "percent", "rate", "row", "segment", "share", "table", "value")
HINTS = (("date", ("date", "when", "year", "month", "day")), ("heading", ("heading", "title", "subject")), ("source", ("source", "cited", "bottom", "footer")), ("numeric", ("how many", "amount", "total", "number")), ("text", ("name", "company", "organization", "what is")))
WORD = r"[a-z0-9]+(?:[-_][a-z0-9]+)?"
ASKED_NUMBER = r"\b\d+\s*-\s*\d+\b|\(\s*\d+(?:\.\d+)?\s*\)|\b\d+(?:\.\d+)?\s*%?|\b\d+(?:\.\d+)?\b"
ASKED_ORDINAL = r"\b\d{2,4}\b|\b[1-4](?:st|nd|rd|th)?\b"
MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"
ASKED_DATE = rf"(?i)\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}[/-]\d{{1,2}}[/-]\d{{1,2}}|{MONTH}\s+\d{{1,2}},?\s+\d{{4}}|\d{{4}})\b"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]"
SOURCE_LINE = r"(?i)^\s*(?:source|footer|cited)\s*[:\-]\s*.+?\s*$"
URL = r"(?i)https?://[^\s<>)]+"
USMM = r"(?i)\bUSMM[^\s,;:)]*"
DATE = rf"(?i)\b(?:\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{2,4}}|\d{{4}}[./-]\d{{1,2}}[./-]\d{{1,2}}|{MONTH}\s+\d{{1,2}},?\s+\d{{2,4}}|\d{{1,2}}\s+{MONTH}\s+\d{{2,4}}|\d{{4}})\b"
PERCENT = r"(?i)\b-?\d+(?:,\d{3})*(?:\.\d+)?\s*%|\b-?\d+(?:,\d{3})*(?:\.\d+)?\s+percent(?:age)?\b"
PARENTHESIZED = r"\(\s*(-?\d+(?:,\d{3})*(?:\.\d+)?)\s*\)"
MONEY = r"\$-?\d[\d,]*(?:\.\d+)?"
NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?"
NUMBER_ALONE = rf"(?<![\w.]){NUMBER}(?![\w.])"
KEY_VALUE = r"^\s*([A-Za-z][A-Za-z0-9 /&().'-]{1,60}?)\s*(?::|-|--|–|—)\s*([^:\n]{2,100})\s*$"
COLON_VALUE = r":\s*([^:\n]{2,100})"
QUARTER = r"(?i)\b(?:Q[1-4](?:\s*FY?\s*\d{2,4})?|[1-4]Q(?:\s*\d{2,4})?|[1-4]Q\d{2}|Q[1-4]FY\d{2}|FY\d{2,4})\b"
SUFFIXED = r"\b([A-Z][A-Za-z&.'-]*(?:\s+[A-Z][A-Za-z&.'-]*){0,8}\s+(?:Board|Company|Corporation|Corp\.?|Inc\.?|Ltd\.?|Limited|Agency|Association|Authority|Committee|Commission|Department))\b"
CAPITALS = r"\b([A-Z][A-Z&.'-]{2,}(?:\s+[A-Z][A-Z&.'-]{2,}){1,6})\b"
STATES = (
    "Alabama|Alaska|Arizona|Arkansas|California|Colorado|Connecticut|Delaware|Florida|Georgia|Hawaii|Idaho|Illinois|Indiana|Iowa|Kansas|Kentucky|Louisiana|Maine|Maryland|Massachusetts|Michigan|Minnesota|Mississippi|Missouri|Montana|"
    "Nebraska|Nevada|New Hampshire|New Jersey|New Mexico|New York|North Carolina|North Dakota|Ohio|Oklahoma|Oregon|Pennsylvania|Rhode Island|South Carolina|South Dakota|Tennessee|Texas|Utah|Vermont|Virginia|Washington|West Virginia|Wisconsin|Wyoming"
)
CITY_STATE = rf"\b([A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+){{0,3}}),\s*([A-Z]{{2}}|{STATES})\b"
PLACE_LINE = r"(?i)\b(?:located in|located at|address|city|state|board located)\b[^:\n\-–—]*(?::|-|–|—)?\s*([^.\n;]{2,120})"
NUMERIC = ("numeric", "percentage", "index")
PLACES = ("city", "state", "location")
PLACE_FIELDS = ("city", "state", "located", "address")
NAME_FIELDS = ("organization", "company", "board", "agency", "logo")
SEQUENCE_WORDS = ("page", "table", "figure", "row", "item", "no.", "number")
VALUE_WORDS = ("total", "amount", "rate", "share", "index", "percent", "value")
INDEX_WORDS = ("share", "segment", "rate", "franchise", "loss", "index")

FOUND = "struct<rule:string,kind:string,value:string,worth:double>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(group))


def fits(text: Column, pattern: str) -> Column:
    return text.rlike("(?U)" + pattern)


def any_of(fields: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(fields, F.array(*map(F.lit, names)))


def asked(rows: DataFrame, question: str = "question") -> DataFrame:
    """rows with what the question asks for: keywords, fields, numbers (arrays), hint and target. A null question asks for nothing."""
    q = F.coalesce(F.col(question), F.lit(""))
    low = F.lower(q)
    words = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    keywords = F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*QUESTION_STOPWORDS)))
    named = [F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in FIELD_TERMS] + [F.when(T.any_in(low, terms), F.lit(name)) for name, terms in BOARD_FIELDS]
    fields = F.array_distinct(F.array_compact(F.array(*named)))
    numbers = F.array_distinct(F.concat(matches(q, ASKED_NUMBER), matches(low, ASKED_ORDINAL)))
    table = F.arrays_overlap(words, F.array(*map(F.lit, TABLE_TERMS))) | F.contains(low, F.lit("%"))
    kinds = {name: T.any_in(low, terms) for name, terms in HINTS}
    kinds["date"] |= fits(q, ASKED_DATE)
    kinds["numeric"] |= table
    hint = reduce(lambda found, kind: found.when(kinds[kind], kind), list(kinds)[1:], F.when(kinds["date"], "date")).otherwise("unknown")
    known = rows.withColumns({"keywords": keywords, "fields": fields, "numbers": numbers, "hint": hint})
    f = F.col("fields")
    target = (
        F.when(F.array_contains(f, "index"), "index").when(any_of(f, PLACE_FIELDS), "location").when(F.array_contains(f, "quarter"), "quarter").when(any_of(f, NAME_FIELDS), "organization")
        .when(any_of(f, ("percentage", "percent")), "percentage").otherwise(F.col("hint"))
    )
    return known.withColumn("target", target)


def strip(text: Column, marks: str = " .;\t") -> Column:
    return F.btrim(text, F.lit(marks))


def cleaned(value: Column) -> Column:
    """A field's value up to a gap or tag."""
    return strip(F.regexp_replace(strip(value), r"(?s)(\s{2,}|\t|<|>).*$", ""))


def covers(held: Column, part: Column) -> Column:
    """Whether a normalised answer holds another one, at word borders."""
    inside = F.contains(F.concat(F.lit(" "), held, F.lit(" ")), F.concat(F.lit(" "), part, F.lit(" ")))
    return (held == part) | ((held != "") & (part != "") & inside)


def found(values: Column, rule: str | Column, kind: str | Column, worth: float | Column) -> Column:
    """Candidates of an array of values."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.transform(values, lambda v: F.struct(as_column(rule).alias("rule"), as_column(kind).alias("kind"), v.alias("value"), as_column(worth).cast("double").alias("worth")))


def gated(gate: Column, candidates: Column) -> Column:
    return F.when(gate, candidates).otherwise(F.expr(f"cast(array() as array<{FOUND}>)"))


def first_short_line(text: Column, lines: Column, words: int, chars: int) -> Column:
    """The first line, else the first sentence, that is short and says something; null without any."""
    sentence = strip(F.regexp_extract(F.trim(text), r"^([^.;\n]*)", 1))
    line = F.get(F.filter(F.transform(lines, lambda x: strip(x)), lambda x: C.valid_short_text(x, words, chars)), F.lit(0))
    return F.coalesce(line, F.when(C.valid_short_text(sentence, words, chars), sentence))


def bound(value: Column, of) -> Column:
    """of(value) with the value computed once: inside a lambda each mention of a column would compute it again."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def headlines(lines: Column) -> Column:
    """Those of the texts that can be headings."""
    short = F.filter(lines, lambda x: (x != "") & (F.length(F.trim(x)) <= 110))
    known = F.transform(short, lambda x: F.struct(x.alias("text"), T.normalize(x).alias("plain")))
    telling = lambda x: F.contains(x["plain"], F.lit(" ")) | x["text"].rlike(r"\p{L}")
    kept = F.filter(known, lambda x: C.short_form(x["plain"], 14) & ~x["plain"].isin(*C.NO_HEADINGS) & ~x["text"].rlike(rf"^{NUMBER}$") & telling(x))
    return F.transform(kept, lambda x: x["text"])


def value_kind(field: Column, value: Column, fields: Column, target: Column) -> Column:
    """The kind of a field's value."""
    low = F.lower(field)
    return (
        F.when(F.contains(low, F.lit("quarter")) | fits(value, QUARTER), "quarter").when(fits(value, PERCENT), "percentage").when(fits(value, NUMBER_ALONE), "numeric")
        .when(target.isin("location", "quarter", "organization", "heading", "source"), target).when(F.contains(low, F.lit("city")), "city").when(F.contains(low, F.lit("state")), "state")
        .when(T.any_in(low, ("company", "board", "organization", "agency", "name")), "organization").when(T.any_in(low, ("date", "year")), "date")
        .when(any_of(fields, ("company", "board", "organization", "agency", "name")), "organization").otherwise("key_value")
    )


def key_values(lines: Column, keywords: Column, told: Column, fields: Column, target: Column) -> Column:
    """Values after a delimiter, else after a told keyword in the line. lines: structs of bare (a line trimmed) and low (that in lower case)."""
    named = (F.size(keywords) == 0) | any_of(fields, ("name", "company", "board", "city", "state", "quarter"))
    given = lambda rule, kind, value, worth: F.struct(F.lit(rule).alias("rule"), kind.alias("kind"), value.alias("value"), F.lit(worth).alias("worth"))

    def of(x: Column) -> Column:
        line, low = x["bare"], x["low"]
        meant = named | F.exists(keywords, lambda k: F.contains(low, k))
        values = F.filter(F.array(cleaned(x["second"])), lambda v: C.valid_short_text(v, 12, 100) & meant)
        name = F.trim(F.regexp_extract(line, KEY_VALUE, 1))
        delimited = F.transform(values, lambda v: given("key_value_delimited", value_kind(name, v, fields, target), v, 0.24))
        after = lambda k: cleaned(strip(F.substr(line, F.position(k, low) + F.length(k)), " \t:-–—"))
        tails = F.transform(F.filter(told, lambda k: F.contains(low, k)), lambda k: F.struct(k.alias("key"), after(k).alias("value")))
        short = F.filter(tails, lambda t: C.valid_short_text(t["value"], 10, 80))
        return F.when(x["second"] != "", delimited).otherwise(F.transform(short, lambda t: given("key_value_adjacent", value_kind(t["key"], t["value"], fields, target), t["value"], 0.18)))

    # The second group is never empty where the pattern fits.
    second = lambda line: F.when(T.any_in(line, (":", "-", "–", "—")), F.regexp_extract(line, KEY_VALUE, 2)).otherwise("")
    parted = F.transform(lines, lambda x: F.struct(x["bare"].alias("bare"), x["low"].alias("low"), second(x["bare"]).alias("second")))
    return F.flatten(F.transform(parted, of))


def answered(candidates_: Column) -> Column:
    """Candidates with their normalised answers."""
    return F.transform(candidates_, lambda c: F.struct(c["rule"].alias("rule"), c["kind"].alias("kind"), c["value"].alias("value"), c["worth"].alias("worth"), T.normalize_answer(c["value"]).alias("plain")))


def numbers_alone(text: Column, existing: Column, fields: Column) -> Column:
    """Numbers that no typed candidate (answered()) of the text holds, each answer once; as answered(). The numbers and the typed answers are
    made once a text: as one string, each answer between two spaces on its line, so that what is held stands in it between spaces."""

    def of(given: Column) -> Column:
        numbers, held = given["numbers"], given["held"]
        plains = F.transform(numbers, lambda v: v["plain"])
        text_ = F.concat(F.lit(" "), F.array_join(held, " \n "), F.lit(" "))

        def first(known: Column) -> Column:
            covered = lambda p: F.when(p == "", F.array_contains(held, "")).otherwise(F.contains(known["text"], F.concat(F.lit(" "), p, F.lit(" "))))
            return F.filter(numbers, lambda v, i: (F.array_position(known["plains"], v["plain"]) == i + 1) & ~covered(v["plain"]))

        return bound(F.struct(plains.alias("plains"), text_.alias("text")), first)

    all_ = F.transform(matches(text, NUMBER_ALONE), lambda v: F.struct(v.alias("value"), T.normalize_answer(v).alias("plain")))
    given = F.struct(all_.alias("numbers"), F.transform(existing, lambda c: c["plain"]).alias("held"))
    as_ = lambda rule, kind: lambda v: F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), v["value"].alias("value"), F.lit(0.16).alias("worth"), v["plain"].alias("plain"))
    indexed = F.array_contains(fields, "index") & T.any_in(F.lower(text), INDEX_WORDS)
    return bound(bound(given, of), lambda kept: F.when(indexed, F.transform(kept, as_("index_context_number", "index"))).otherwise(F.transform(kept, as_("numeric", "numeric"))))


def candidates(spans: DataFrame, text: str = "text") -> DataFrame:
    """spans (asked(), text, top: the upper edge of the block's box or null) with `lines` (structs of line, bare: trimmed, low: that in lower case),
    `told` (keywords that count in a line) and an array `found` of rule, kind, value, worth, plain (the normalised answer).

    In the order of the generators: sources, headings, places, quarters, organisations, key-values, numbers of all kinds, short
    texts. Those for special kinds run where the question asks for them. Null and empty texts give none.
    """
    body, f, target = F.coalesce(F.col(text), F.lit("")), F.col("fields"), F.col("target")
    asks = lambda kind, *names: (target == kind) | any_of(f, names or (kind,))
    plain_lines = F.transform("lines", lambda x: x["line"])

    def line_sources(line: Column) -> Column:
        whole = F.filter(F.array(F.substring(line, 1, 220)), lambda v: fits(line, SOURCE_LINE))
        coded = F.slice(matches(line, USMM), 1, 1)
        return F.concat(found(whole, "source_line", "source", 0.32), found(matches(line, URL), "source_url", "source", 0.3), found(coded, "source_usmm", "source", 0.24))

    sources = gated(asks("source"), F.flatten(F.transform("lines", lambda x: line_sources(x["bare"]))))
    high = F.when(F.coalesce(F.col("top") <= 160, F.lit(False)), 0.06).otherwise(0.0)
    titles = F.slice(headlines(F.transform(F.slice("lines", 1, 4), lambda x: strip(x["line"]))), 1, 2)
    opening = headlines(F.array_compact(F.array(first_short_line(body, plain_lines, 14, 110))))
    headings = gated(asks("heading"), bound(titles, lambda t: F.when(F.size(t) > 0, found(t, "heading_short_title", "heading", high + 0.34)).otherwise(found(opening, "heading_first_line", "heading", high + 0.26))))

    city, state = F.array_contains(f, "city"), F.array_contains(f, "state")
    names = F.arrays_zip(matches(body, CITY_STATE, 1).alias("city"), matches(body, CITY_STATE, 2).alias("state"))
    pair = lambda x: F.concat(gated(city | ~state, found(F.array(F.trim(x["city"])), "address_city", "city", 0.3)), gated(state | ~city, found(F.array(F.trim(x["state"])), "address_state", "state", 0.3)))
    told = F.filter(F.transform(matches(body, PLACE_LINE, 1), cleaned), lambda v: C.valid_short_text(v, 8, 80))
    places = gated(asks("location", *PLACE_FIELDS), F.concat(F.flatten(F.transform(names, pair)), found(told, "location_context_phrase", "location", 0.22)))

    close = lambda v: F.when(F.exists(F.col("numbers"), lambda n: (n != "") & F.contains(v, n)), 0.39).otherwise(0.31)
    quarters = gated(asks("quarter"), F.transform(matches(body, QUARTER), lambda v: F.struct(F.lit("quarter_short_form").alias("rule"), F.lit("quarter").alias("kind"), F.trim(v).alias("value"), close(F.trim(v)).alias("worth"))))

    suffixed = F.filter(F.transform(matches(body, SUFFIXED, 1), lambda v: F.trim(v)), lambda v: C.valid_short_text(v, 10, 100))
    capitals = F.filter(F.transform(matches(body, CAPITALS, 1), lambda v: F.trim(v)), lambda v: C.valid_short_text(v, 8, 90))
    names_ = gated(asks("organization", *NAME_FIELDS), F.concat(found(suffixed, "organization_suffix", "organization", 0.29), found(capitals, "uppercase_organization_phrase", "organization", 0.2)))

    typed = F.concat(
        found(matches(body, PARENTHESIZED, 1), "parenthesized_index", "index", 0.28), found(matches(body, PERCENT), "percentage", "percentage", 0.22),
        found(matches(body, DATE), "date", "date", 0.2), found(matches(body, MONEY), "money", "numeric", 0.19),
    )
    line = lambda x: F.struct(x.alias("line"), F.trim(x).alias("bare"), F.lower(F.trim(x)).alias("low"))
    known = spans.withColumn("lines", F.transform(F.split(body, LINE_ENDS), line)).withColumn("told", F.filter("keywords", lambda k: F.length(k) > 2)).withColumn("__typed", answered(typed))
    special = answered(F.concat(sources, headings, places, quarters, names_, key_values(F.col("lines"), F.col("keywords"), F.col("told"), f, target)))
    known = known.withColumn("__special", F.concat(special, F.col("__typed"), numbers_alone(body, F.col("__typed"), f)))
    short = F.concat(F.transform(matches(body, COLON_VALUE, 1), lambda v: strip(v)), F.array_compact(F.array(first_short_line(body, plain_lines, 10, 80))))
    plain = answered(found(F.slice(F.filter(short, lambda v: C.valid_short_text(v)), 1, 2), "generic_short_text", "text", 0.11))
    general = F.when(target.isin("text", "unknown") | (F.size("__special") == 0), plain).otherwise(F.slice("__special", 1, 0))
    return known.withColumn("found", F.concat("__special", general)).drop("__typed", "__special")


def told_lines(lines: Column) -> Column:
    """Each line with what a told keyword or a field of the question in it is worth, and whether it names a value; those with neither left out."""

    def of(x: Column) -> Column:
        low = x["low"]
        worth = F.when(F.exists("told", lambda k: F.contains(low, k)), 0.16).when(F.exists("fields", lambda k: F.contains(low, k)), 0.14).otherwise(0.0)
        return F.struct(x["line"].alias("line"), worth.alias("worth"), T.any_in(low, VALUE_WORDS).alias("valued"))

    return F.filter(F.transform(lines, of), lambda x: (x["worth"] > 0) | x["valued"])


def round6(value: Column) -> Column:
    return F.round(value, 6)


def span_parts(text: Column) -> dict[str, Column]:
    """What the scores need of a span (candidates()), made once for all candidates in it: three parts, `sequenced` and the tests of its fields."""
    f, keywords, rank = F.col("fields"), F.size("keywords"), F.coalesce(F.col("page_rank").cast("long"), F.lit(0))
    hits = lambda low: F.size(F.filter("keywords", lambda k: F.contains(low, k)))
    return {
        "source": round6(F.greatest(F.lit(0.0), F.least(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), F.lit(1.0))) * 0.35),
        "overlap": F.when(keywords > 0, round6(F.least(bound(F.lower(text), hits) / F.greatest(keywords, F.lit(1)), F.lit(1.0)) * 0.2)).otherwise(0.0),
        "bonus": F.when(rank > 0, round6(F.greatest(F.lit(0.0), 0.22 - 0.04 * (rank - 1)))).otherwise(0.0),
        "sequenced": T.any_in(F.lower(text), SEQUENCE_WORDS),
        "some": F.size(f) > 0,
        **{f"of_{name}": F.array_contains(f, name) for name in ("index", "source", "heading", "quarter", "date")},
        "of_percentage": any_of(f, ("percentage", "percent", "rate", "share")), "of_place": any_of(f, PLACE_FIELDS), "of_organization": any_of(f, (*NAME_FIELDS, "name")), "of_numeric": any_of(f, ("total", "amount", "rate", "value")),
    }


def score_parts() -> dict[str, Column]:
    """The parts of a candidate's score but the one for duplicates, to six places; columns: rule, kind, value, worth, plain, target, norm (the value
    normalised), around (the told lines with the value) and span_parts()'s. The filter of `around` also keeps them out of Spark's whole-stage
    code, where all of them would make one method too large for the JVM to compile."""
    kind, target, value, plain, rule = (F.col(c) for c in ("kind", "target", "value", "plain", "rule"))
    norm = F.col("norm")
    numeric, place = kind.isin(*NUMERIC), kind.isin(*PLACES)
    figure = plain.rlike(r"^-?\d+(\.\d+)?$")
    number = F.when(figure, plain.try_cast("double"))
    whole = number == F.floor(number)
    counted = whole & (number.between(1900, 2100) | (number.between(0, 300) & F.col("sequenced")))
    loose = F.when(F.coalesce(counted, F.lit(False)), 0.22).otherwise(0.0) + F.when(F.size("around") > 0, 0.0).otherwise(0.2)
    generic = (
        F.when(~numeric | rule.isin("parenthesized_index", "percentage", "money"), 0.0)
        .when(target.isin("numeric", "index", "percentage", "quarter"), round6(-F.least(loose + 0.04, F.lit(0.32)))).otherwise(round6(-F.least(loose + 0.25, F.lit(0.6))))
    )
    same = (target == "unknown") | (kind == target) | ((target == "location") & place) | ((target == "numeric") & numeric)
    mismatch = (
        F.when(same, 0.0).when(target == "percentage", F.when(numeric, -0.3).otherwise(-0.12)).when((target == "index") & numeric, F.when(figure, 0.0).otherwise(-0.16))
        .when(target.isin("heading", "source", "text", "location", "organization") & numeric, -0.34).otherwise(-0.1)
    )
    chars, words = F.length(value), F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1)
    shown = F.length(F.trim(value))
    telling = F.length(F.regexp_replace(value, r"[^\p{L}\p{N}]+", ""))
    noise = F.when(telling == 0, -0.3).when(telling / F.greatest(shown, F.lit(1)) < 0.45, -0.18).when(F.length(norm) <= 1, -0.2).when(norm.rlike(r"^([a-z]\d?|[ivx]+)$"), -0.14).otherwise(0.0)
    of = lambda name: F.col(f"of_{name}")
    field = (
        F.when((kind == "index") & of("index"), 0.3).when((kind == "percentage") & of("percentage"), 0.25).when((kind == "source") & of("source"), 0.3)
        .when((kind == "heading") & of("heading"), 0.3).when(place & of("place"), 0.3).when((kind == "quarter") & of("quarter"), 0.3)
        .when((kind == "organization") & of("organization"), 0.28).when((kind == "key_value") & F.col("some"), 0.12).when((kind == "date") & of("date"), 0.22)
        .when((kind == "numeric") & of("numeric"), 0.16).otherwise(0.0)
    )
    fit = F.when(kind == target, 0.3).when((target == "location") & place, 0.28).when((target == "numeric") & numeric, 0.16).when(target == "unknown", 0.04).otherwise(0.0)
    return {
        "source_candidate_score": F.col("source"),
        "question_keyword_overlap": F.col("overlap"),
        "answer_type_match": fit,
        "field_hint_match": field,
        "local_context_match": F.coalesce(F.get(F.filter("around", lambda x: x["worth"] > 0), F.lit(0))["worth"], F.lit(0.0)),
        "span_rank_bonus": F.col("bonus"),
        "extraction_rule_priority": F.when(rule.startswith("heading"), round6(F.col("worth"))).otherwise(F.col("worth")),
        "generic_numeric_penalty": generic,
        "type_mismatch_penalty": mismatch,
        "long_text_penalty": F.when((chars > 100) | (words > 14), -0.18).when((chars > 70) | (words > 10), -0.08).otherwise(0.0),
        "noisy_text_penalty": noise,
    }


def boards(spans: DataFrame, top: int | None = None, text: str = "text") -> DataFrame:
    """The candidate answers of each question: rank, candidate_rank (among those that may be chosen; null for others), value, kind, rule, plain,
    score, parts (struct), reasons; qid, target and the span's candidate_id. All ranks, or those to `top`.

    spans: qid, question (or what asked() makes of it), candidate_id (unique in the question), text, score (0 to 1), page_rank, top. Ties in score go by the
    span's id, kind, value and place. Spans of a question are bounded by what packed them; candidates are grouped by question and answer.
    """
    cut = candidates(spans if "target" in spans.columns else asked(spans), text)
    # Only what scores need goes on to the candidates, and those without an answer stay back.
    once = {"found": F.filter("found", lambda c: c["plain"] != ""), "lines": told_lines(F.col("lines")), **span_parts(F.coalesce(F.col(text), F.lit("")))}
    cut = cut.select("qid", "target", "candidate_id", *[column.alias(name) for name, column in once.items()])
    # The outer form: the other one adds a filter that computes the array once more.
    each = cut.select("*", F.posexplode_outer("found").alias("pos", "c")).where("pos is not null").select("*", "c.*").drop("found", "c")
    normal = F.when(T.any_in(F.col("value"), (",", "$")), T.normalize(F.col("value"))).otherwise(F.col("plain"))
    around = F.filter("lines", lambda x: F.contains(x["line"], F.col("value")))
    each = each.withColumns({"norm": normal, "around": around})
    scored = each.withColumn("parts", F.struct(*[column.alias(name) for name, column in score_parts().items()]))
    scored = scored.withColumn("raw", round6(reduce(lambda a, b: a + b, [F.col(f"parts.{name}") for name in score_parts()])))
    kept = scored.select("qid", "target", "candidate_id", "pos", "rule", "kind", F.trim("value").alias("value"), "plain", "parts", "raw")
    nth = F.row_number().over(Window.partitionBy("qid", "plain").orderBy(F.desc("raw"), "candidate_id", "pos")) - 1
    again = kept.withColumn("nth", nth).withColumn("duplicate_penalty", F.when(F.col("nth") == 0, 0.0).otherwise(-round6(F.least(0.08 + 0.07 * F.col("nth"), F.lit(0.35)))))
    again = again.withColumn("score", F.when(F.col("nth") == 0, F.col("raw")).otherwise(round6(F.col("raw") + F.col("duplicate_penalty")))).drop("nth")
    reasons = V.filter_reasons(F.col("kind"), F.col("rule"), F.col("score"), F.col("parts"), F.col("target"))
    judged = again.withColumn("reasons", reasons).withColumn("score", F.when(F.size("reasons") == 0, F.col("score")).otherwise(round6(F.col("score") - V.filter_penalty(F.col("reasons")))) + 0.0)
    judged = judged.withColumn("eligible", ~F.exists("reasons", lambda r: r.startswith("drop:")))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "candidate_id", "kind", "value", "pos")
    upto = F.count_if("eligible").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = judged.withColumns({"rank": F.row_number().over(order), "candidate_rank": F.when(F.col("eligible"), upto)})
    return (ranked.where(F.col("rank") <= top) if top else ranked).drop("pos", "raw")


def board_tops(boards_: DataFrame, k: int) -> DataFrame:
    """Each question's type-aware choice of k candidates: qid, topk_rank, rank, value."""
    key = F.regexp_replace("plain", "[^a-z0-9]+", "")
    row = F.struct("score", "rank", "kind", F.when(key != "", key).otherwise(F.col("plain")).alias("key"), "eligible", "reasons", "value")
    grouped = boards_.groupBy("qid", "target").agg(F.collect_list(row).alias("board"))
    chosen = grouped.select("qid", F.posexplode(V.type_aware_top(F.col("board"), F.col("target"), k)).alias("pos", "c"))
    return chosen.select("qid", (F.col("pos") + 1).alias("topk_rank"), "c.rank", "c.value")
