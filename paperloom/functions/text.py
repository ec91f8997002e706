"""Scalar text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]"
NUMBER = r"-?\(?\$?\d[\d,]*(?:\.\d+)?%?\)?"


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case search tokens: runs of ASCII letters, digits and underscores, or single CJK characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def normalize(text: Column) -> Column:
    """Answer text for comparison: lower case, only letters, digits, CJK and . % + -, one space between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9\x{4e00}-\x{9fff}.%+-]+", " "))


def normalize_answer(text: Column) -> Column:
    return normalize(F.replace(F.replace(text, F.lit(","), F.lit("")), F.lit("$"), F.lit("")))


def compact(text: Column) -> Column:
    return F.replace(normalize(text), F.lit(" "), F.lit(""))


def estimate_tokens(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4).cast("long")


def last_index(text: Column, mark: str) -> Column:
    """0-based place of the mark's last occurrence, -1 without any."""
    at = F.locate(mark, F.reverse(text))
    return F.when(at > 0, F.length(text) - at).otherwise(-1)


def smart_truncate(text: Column, limit: int) -> Column:
    """Collapsed text cut at the last space, semicolon or comma in its second half, without marks at the end."""
    plain = collapse(text)
    prefix = F.substring(plain, 1, limit)
    at = F.greatest(*[last_index(prefix, mark) for mark in " ;,"])
    cut = F.when(at >= limit // 2, F.substr(prefix, F.lit(1), at)).otherwise(prefix)
    return F.when(F.length(plain) <= limit, plain).otherwise(F.rtrim(cut, F.lit(" ,;:-")))


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("...")))


def preview(text: Column, limit: int = 160) -> Column:
    return F.substring(collapse(text), 1, limit)


def centered_window(text: Column, answer: Column, limit: int) -> Column:
    """The part of the collapsed text around the answer, as long as the limit; smart_truncate where it doesn't occur."""
    plain = collapse(text)
    start = F.position(F.lower(answer), F.lower(plain)) - 1
    size = F.length(answer)
    side = F.greatest(F.floor((F.lit(limit) - F.greatest(size, F.lit(1))) / 2), F.lit(0))
    left, right = F.greatest(start - side, F.lit(0)), F.least(start + size + side, F.length(plain))
    short = right - left < limit
    end = F.when(short & (left == 0), F.least(F.lit(limit), F.length(plain))).otherwise(right)
    begin = F.when(short & (left > 0) & (right == F.length(plain)), F.greatest(F.lit(0), F.length(plain) - limit)).otherwise(left)
    window = F.btrim(F.substr(plain, (begin + 1).cast("int"), (end - begin).cast("int")), F.lit(" ,;:-"))
    return F.when(F.length(plain) <= limit, plain).when(start < 0, smart_truncate(text, limit)).otherwise(window)


SPAN_TOKEN = r"[A-Za-z0-9\x{4e00}-\x{9fff}.%+-]"


def span_tokens(text: Column) -> Column:
    """The words of a text that spans are matched by, lower-cased, with the places (from 0) where each starts and ends: an index by position."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[^{SPAN_TOKEN[1:-1]}]*{SPAN_TOKEN}+"), F.lit(0))  # a word and what stands before it
    none = F.expr("cast(array() as array<struct<word:string,start:int,end:int>>)")

    def step(acc: Column, piece: Column) -> Column:
        word = F.regexp_substr(piece, F.lit(rf"{SPAN_TOKEN}+$"))
        end = acc["at"] + F.length(piece)
        return F.struct(end.alias("at"), F.concat(acc["words"], F.array(F.struct(F.lower(word).alias("word"), (end - F.length(word)).alias("start"), end.alias("end")))).alias("words"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("words")), step)["words"]


def answer_span(text: Column, answer: Column) -> Column:
    """Where a text first holds an answer, as a struct of start and end (from 0, end exclusive): as it is written, whatever its case, else
    word by word, whatever stands between the words. Null where it doesn't, and for blank answers."""
    plain = F.btrim(answer, F.lit(" \t\r\n"))
    at = F.position(F.lower(plain), F.lower(text))
    asked = F.regexp_extract_all(F.lower(plain), F.lit(rf"{SPAN_TOKEN}+"), F.lit(0))
    n = F.size(asked)

    def place(held: Column) -> Column:
        words, wanted = held["words"], held["asked"]
        return F.get(F.filter(F.transform(words, lambda _, i: i), lambda i: (F.get(words, i) == F.get(wanted, F.lit(0))) & (F.slice(words, i + 1, F.size(wanted)) == wanted)), F.lit(0))

    def by_words(index: Column) -> Column:
        # Both arrays are bound by a lambda: else each word of the text would make them again.
        held = F.struct(F.transform(index, lambda x: x["word"]).alias("words"), asked.alias("asked"))
        return F.get(F.transform(F.transform(F.array(held), place), lambda first: span(index, first)), F.lit(0))

    def span(index: Column, first: Column) -> Column:
        return F.when(first.isNotNull(), F.struct(F.get(index, first)["start"].alias("start"), F.get(index, first + n - 1)["end"].alias("end")))

    direct = F.struct((at - 1).alias("start"), (at - 1 + F.length(plain)).alias("end"))
    return F.when((plain != "") & (at > 0), direct).when((plain != "") & (n > 0), F.get(F.transform(F.array(span_tokens(text)), by_words), F.lit(0)))


def strip_html(html: Column) -> Column:
    return collapse(F.regexp_replace(html, "<[^>]+>", " "))


def escape_html(text: Column) -> Column:
    return reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), text)


def parse_number(text: Column) -> Column:
    """The first number in a text: parentheses negate, $ and , are dropped, a percentage keeps its figure."""
    raw = F.regexp_extract(text, NUMBER, 0)
    figure = F.rtrim(F.translate(raw, "$,()", ""), F.lit("%")).try_cast("double")
    return F.when(raw.startswith("(") & raw.endswith(")"), -figure).otherwise(figure)


def format_number(value: Column) -> Column:
    """Integers without a point, others with at most four decimals and no trailing zeros."""
    plain = F.format_string("%.4f", value)
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.rtrim(F.rtrim(plain, F.lit("0")), F.lit(".")))


def contains_words(text: Column, part: Column) -> Column:
    """Normalised containment at word boundaries."""
    return F.contains(F.concat(F.lit(" "), normalize_answer(text), F.lit(" ")), F.concat(F.lit(" "), normalize_answer(part), F.lit(" ")))


def any_in(text: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def unique_ignoring_case(items: Column) -> Column:
    """Items in order, without later ones that differ in case alone; blank ones go."""
    kept = F.filter(F.transform(items, lambda x: collapse(x)), lambda x: x != "")
    return F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))


def multiset_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of precision and recall of two arrays as multisets; 0 where nothing is shared."""
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    p, r = shared / F.size(a), shared / F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (shared == 0), F.lit(0.0)).otherwise(2 * p * r / (p + r))


def words(text: Column) -> Column:
    """Words of the normalised text."""
    return F.array_remove(F.split(normalize(text), " "), "")


def token_f1(prediction: Column, gold: Column) -> Column:
    return multiset_f1(words(prediction), words(gold))


def character_f1(prediction: Column, gold: Column) -> Column:
    letters = lambda t: F.array_remove(F.split(compact(t), ""), "")
    return multiset_f1(letters(prediction), letters(gold))


def exact_match(prediction: Column, gold: Column) -> Column:
    return normalize(prediction) == normalize(gold)


def numeric_match(prediction: Column, gold: Column, tolerance: float = 1e-3) -> Column:
    p, g = parse_number(prediction), parse_number(gold)
    return F.coalesce(F.abs(p - g) <= tolerance * F.greatest(F.abs(g), F.lit(1.0)), F.lit(False))
