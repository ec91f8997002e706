"""Line dedup: an exact set-similarity join over lines, in DataFrame functions only.

A line is the set of its lower-cased words. It goes if an earlier line (by doc_id, then place) has a
Jaccard similarity of 0.8 or more with it, whether or not that line stays itself. Lines with equal sets
become one class first, so copies are never paired.

Words are ordered by rarity. The first word that two similar classes share stands among the first fifth
of each (prefix filter), at places that leave enough words behind (positional filter), and their sizes
allow the similarity (length filter). So a class stands in the list of every word of its prefix; words so
frequent that their lists would be long are taken two at a time, as similar classes that share no rarer
word share two of them. Each class also carries 128 parities of its words: two sets differ in at least as
many words as parities, which settles nearly all meetings of unlike lines without their words.

A semi-join of the lists with themselves, which makes no pairs, drops the entries that meet no class they may match. Only the words of those left
are read again. Two rounds keep large groups of similar lines linear: first every class meets the
first class of its part of a list and the one before it; who matches has its earlier line and asks no
more. Then the others meet all earlier classes of their lists, but compare words with the closest by parities first, and with
further ones only as long as none matches: that too keeps groups linear where their lines match.

Texts are cut at single characters: other white space becomes a space first. A pattern of white space costs more than all the rest of the cutting.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Shorter lines reach 0.8 only where their sets are equal, which the classes tell; these are paired.
PAIRED_WORDS = 4
#: Word counts are kept in two to so many hashed cells; they only order words, so cells shared by words cost time, not results.
CELL_BITS = 18
WORDS_A_CELL = 256
#: A number of a word is its rarity class (bits of its cell's count) over this many bits of its hash.
HASH_BITS = 57
#: Words of cells with 2 ** 15 or more are listed two at a time: no list of a single word is longer than that.
HOT_CLASS = 16
BITS_LINE, BITS_TEXT = 31, 31
#: Parts of a list in the first round.
SALTS = 64
#: Not used here any more: the filter of sorted lists went to arrays with its own limit, and a test still sets this.
LONG_LIST = 1 << 14
#: Which of a line's earlier lines are compared with it at a time, the closest by their parities first: one match is enough.
CLOSEST = ((1, 1), (2, 8), (9, (1 << 31) - 1))
#: White space inside a line (what str.split() splits at, but for the line end): in ASCII, and above.
SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def spaced(table: DataFrame, name: str) -> DataFrame:
    """The table with this column in lower case and all white space in it but line ends as spaces."""
    text = F.col(name)
    narrow = reduce(Column.__or__, [F.contains(text, F.lit(space)) for space in SPACES])
    wide = reduce(Column.__or__, [F.contains(text.cast("binary"), F.lit(first)) for first in sorted({space.encode()[:2] for space in WIDE_SPACES})])
    other = narrow | ((F.octet_length(text) > F.length(text)) & wide)
    return table.withColumn(name, F.lower(name)).withColumn(name, F.when(other, F.translate(text, SPACES + WIDE_SPACES, " " * len(SPACES + WIDE_SPACES))).otherwise(text))


def rarity(docs: DataFrame) -> Callable[[Column], Column]:
    """A function from a word's hash to the number of bits of its cell's count over all texts. It holds a byte a cell, in a literal (an array
    of numbers takes seconds to plan); there are as many cells as give WORDS_A_CELL, at most 2 ** CELL_BITS."""
    words = spaced(docs.select("text"), "text").select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    counts = words.groupBy(F.shiftrightunsigned(F.xxhash64("word"), 64 - CELL_BITS).cast("int").alias("cell")).agg(F.count("*").alias("n"))
    with common.tidy(docs.sparkSession):
        rows = counts.toArrow()  # at most 2 ** CELL_BITS rows of twelve bytes
    found = np.zeros(1 << CELL_BITS, np.int64)
    found[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    used = min(CELL_BITS, max(1, (int(found.sum()) // WORDS_A_CELL).bit_length()))
    cells = F.lit(bytearray(int(n).bit_length() for n in found.reshape(1 << used, -1).sum(axis=1)))
    return lambda h: F.ascii(F.substring(cells, F.shiftrightunsigned(h, 64 - used).cast("int") + 1, 1).cast("string"))


def keys_of(line: Column, bits: Callable[[Column], Column]) -> Column:
    """The distinct words of a line (as spaced() has it) as numbers, rarest first."""
    hashes = F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    key = lambda h: F.shiftleft(bits(h).cast("long"), HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))
    return F.sort_array(F.transform(hashes, key))


def digests(docs: DataFrame, bits: Callable[[Column], Column]) -> DataFrame:
    """id, at, h1, h2 (128 bits that name the set), n, p, q (parities) and prefix of every line with a word; docs: id, mark, text.

    The prefix is one word longer than the first shared word needs, for the second word of two.
    """
    at = F.col("mark") * (1 << BITS_LINE) + F.col("line_no")
    lines = spaced(docs, "text").select("id", "mark", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # A generator in between: the keys are computed once for all that is derived from them.
    sets = lines.select("id", at.alias("at"), F.explode(F.array(keys_of(F.col("line"), bits))).alias("keys")).where(F.size("keys") > 0)
    # A word turns bit (its last six bits) of p if its seventh is set, else of q.
    turned = "aggregate(keys, 0L, (seen, k) -> seen ^ shiftleft({}, cast(k & 63 as int)))"
    p, both = F.expr(turned.format("shiftright(k, 6) & 1")), F.expr(turned.format("1L"))
    sets = sets.select("*", F.size("keys").alias("n"), F.explode(F.array(F.struct(p.alias("p"), both.alias("both")))).alias("s"))
    prefix = F.expr("slice(keys, 1, least(n, n - (4 * n + 4) div 5 + 2))")
    names = [F.xxhash64("keys").alias("h1"), F.xxhash64(F.lit(1), "keys").alias("h2")]
    return sets.select("id", "at", *names, "n", F.col("s.p").alias("p"), F.col("s.p").bitwiseXOR(F.col("s.both")).alias("q"), prefix.cast("array<long>").alias("prefix"))


def position(id_: str = "id", at: str = "at") -> Column:
    """One number that orders lines by id, mark and line number."""
    return F.expr(f"cast({id_} as decimal(19,0)) * cast({1 << BITS_LINE + BITS_TEXT} as decimal(19,0)) + cast({at} as decimal(19,0))").cast("decimal(38,0)")


def place(pos: str) -> list[Column]:
    """id and `at` (mark and line number) of a position."""
    rest = f"cast(pmod({pos}, cast({1 << BITS_LINE + BITS_TEXT} as decimal(38,0))) as bigint)"
    return [F.expr(f"cast(({pos} - {rest}) div cast({1 << BITS_LINE + BITS_TEXT} as decimal(38,0)) as bigint)").alias("id"), F.expr(rest).alias("at")]


def prepare(docs: DataFrame) -> DataFrame:
    """id (null: below all others), mark and text of docs (doc_id, text)."""
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(id_.alias("id"), F.shiftrightunsigned(F.xxhash64("text"), 33).alias("mark"), F.col("text").cast("string").alias("text"))


def fits() -> Column:
    """Length filter, positional filter of the first shared word (place i of n words, place j of m), and the parities."""
    needed = "((4 * (n + m) + 8) div 9)"
    return F.expr(f"5 * least(n, m) >= 4 * greatest(n, m) and least(n - i, m - j) >= {needed} and bit_count(p ^ r) + bit_count(q ^ s) <= n + m - 2 * {needed}")


def entries_of(classes: DataFrame) -> DataFrame:
    """The lists' entries: key, id, at, n, p, q and the place i of the key's (first) word; classes: pos, n, p, q, prefix."""
    own = ["id", "at", "n", "p", "q"]
    placed = classes.where(F.col("n") >= PAIRED_WORDS).select(*place("pos"), "n", "p", "q", "prefix")
    hot = F.lit(HOT_CLASS << HASH_BITS)
    single = placed.select(*own, F.posexplode(F.expr("slice(prefix, 1, size(prefix) - 1)")).alias("i", "key")).where(F.col("key") < hot)
    several = placed.where(F.element_at("prefix", -1) >= hot).select(*own, "prefix", F.posexplode("prefix").alias("i", "first")).where((F.col("first") >= hot) & (F.col("i") < F.size("prefix") - 1))
    double = several.select(*own, "i", "first", F.explode(F.expr("slice(prefix, i + 2, size(prefix))")).alias("second"))
    return single.select("key", *own, "i").union(double.select(F.xxhash64("first", "second").alias("key"), *own, "i"))


def others(entries: DataFrame) -> DataFrame:
    return entries.toDF("key", "id2", "at2", "m", "r", "s", "j")


def open_entries(entries: DataFrame) -> DataFrame:
    """The entries that may match another one of their list. Those go first that have none of a fitting length: what is left is written, and
    only that is shuffled for the semi-join (both sides once, as generated rows would not be)."""
    by_size = Window.partitionBy("key").orderBy("n")
    sized = entries.select("*", F.lag("n").over(by_size).alias("less"), F.lead("n").over(by_size).alias("more"))
    left = common.materialise(sized.where("5 * less >= 4 * n or 5 * n >= 4 * more").drop("less", "more"))
    own = left.toDF("key1", "id", "at", "n", "p", "q", "i")
    other = left.toDF("key2", "id2", "at2", "m", "r", "s", "j")
    apart = (F.col("id") != F.col("id2")) | (F.col("at") != F.col("at2"))
    found = common.materialise(own.join(other, (F.col("key1") == F.col("key2")) & apart & fits(), "left_semi").toDF(*entries.columns))
    common.release(left)
    return found


def sets_of(wanted: DataFrame, docs: DataFrame, bits: Callable[[Column], Column]) -> DataFrame:
    """id, at and keys of the wanted lines (id, at), read from docs."""
    mark, line_no = F.shiftright("at", BITS_LINE), F.col("at").bitwiseAND(F.lit((1 << BITS_LINE) - 1).cast("long")).cast("int")
    wanted = wanted.groupBy("id", mark.alias("mark")).agg(F.collect_set(line_no).alias("wanted"))
    # Repeated rows (equal id and text) give equal lines: one of each is enough.
    cut = docs.join(wanted, ["id", "mark"]).dropDuplicates(["id", "mark"]).select("id", "mark", F.split("text", "\n").alias("lines"), "wanted")
    picked = cut.select("id", "mark", F.explode(F.expr("transform(wanted, k -> struct(k as line_no, get(lines, k) as line))")).alias("w"))
    at = F.col("mark") * (1 << BITS_LINE) + F.col("w.line_no")
    return spaced(picked.select("id", at.alias("at"), F.col("w.line").alias("line")), "line").select("id", "at", keys_of(F.col("line"), bits).alias("keys"))


def matched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """id, at of the later lines of those pairs (id, at, id2, at2) whose words are similar enough."""
    both = pairs.distinct().join(sets.withColumnRenamed("keys", "x"), ["id", "at"]).join(sets.toDF("id2", "at2", "y"), ["id2", "at2"])
    shared = both.select("id", "at", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("shared"))
    return shared.where("9 * shared >= 4 * (n + m)").select("id", "at").distinct()


def later_matches(docs: DataFrame) -> DataFrame:
    """id, mark, line_no of all lines to remove; docs: id, mark, text."""
    bits = rarity(docs)
    lines = common.materialise(digests(docs, bits).select(position().alias("pos"), "h1", "h2", "n", "p", "q", "prefix"))
    # Written, so that neither the lines nor what was shuffled for their classes lie beside the lists' entries.
    classes = common.materialise(lines.groupBy("h1", "h2", "n", "p", "q", "prefix").agg(F.min("pos").alias("pos"), F.count("*").alias("copies")))
    repeated = classes.where("copies > 1").select("h1", "h2", F.col("pos").alias("first"))
    copies = common.materialise(lines.select("pos", "h1", "h2").join(repeated, ["h1", "h2"]).where("pos > first").select(*place("pos")))
    common.release(lines)

    left = open_entries(entries_of(classes))
    common.release(classes)
    words = common.materialise(sets_of(left.select("id", "at").distinct(), docs, bits))

    ordered = Window.partitionBy("key", F.pmod(F.xxhash64("id", "at"), F.lit(SALTS))).orderBy("id", "at", "i")
    names = ("id", "at", "n", "p", "q", "i")
    own = F.struct(*names)
    met = left.select(*names, F.array(F.first(own).over(ordered), F.lag(own).over(ordered)).alias("others"))
    met = met.select(*names, F.explode(F.array_distinct("others")).alias("o"))
    met = met.select(*names, *[F.col(f"o.{a}").alias(b) for a, b in zip(names, ("id2", "at2", "m", "r", "s", "j"), strict=True)])
    earlier = (F.col("id2") < F.col("id")) | ((F.col("id2") == F.col("id")) & (F.col("at2") < F.col("at")))
    near = common.materialise(matched(met.where(earlier & fits()).select("id", "at", "id2", "at2"), words))

    asking = left.join(near, ["id", "at"], "left_anti").select("key", *names)
    rest = asking.join(others(left), "key").where(earlier & fits()).select("id", "at", "id2", "at2", F.expr("bit_count(p ^ r) + bit_count(q ^ s)").alias("apart"))
    closest = Window.partitionBy("id", "at").orderBy("apart", "id2", "at2")
    rest = common.materialise(rest.distinct().withColumn("place", F.row_number().over(closest)))
    far = []
    for least, most in CLOSEST:
        some = rest.where(F.col("place").between(least, most))
        for table in far:
            some = some.join(table, ["id", "at"], "left_anti")
        far.append(common.materialise(matched(some.select("id", "at", "id2", "at2"), words)))
    common.release(rest)
    common.release(left)
    common.release(words)
    return reduce(DataFrame.union, [copies, near, *far]).select("id", F.shiftright("at", BITS_LINE).alias("mark"), F.col("at").bitwiseAND(F.lit((1 << BITS_LINE) - 1).cast("long")).cast("int").alias("line_no"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, removed (line numbers, ascending) and text without them, for every row of docs (doc_id, text).

    Lines end at \\n. Null text: null, no lines. A text that loses all its lines becomes empty; nothing
    else in a text changes. Rows with equal doc_id and text are one document (they keep the same lines);
    rows with equal doc_id and other text come in the order of a hash of the text. Null doc_ids come first.
    """
    given = common.pick(docs, doc_id="long", text="string")
    return rebuilt(given).select("doc_id", F.coalesce(F.size("__lines"), F.lit(0)).alias("n_lines"), F.coalesce(F.array_sort("__removed"), F.array().cast("array<int>")).alias("removed"), "text")


def rebuilt(docs: DataFrame) -> DataFrame:
    """docs with text cut, __lines and __removed."""
    plain = prepare(docs)
    gone = later_matches(plain).groupBy("id", "mark").agg(F.collect_set("line_no").alias("__removed")).withColumnsRenamed({"id": "__id", "mark": "__mark"})
    marked = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__mark": F.shiftrightunsigned(F.xxhash64("text"), 33), "__lines": F.split("text", "\n")}).drop("text")
    joined = marked.join(gone, ["__id", "__mark"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.coalesce("__removed", F.array().cast("array<int>")))
    text = F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n")
    return joined.withColumn("text", F.when(F.col("__lines").isNotNull(), text))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, n_chars, ...) with later lines removed and n_chars counted anew; all columns and rows stay."""
    out = rebuilt(docs)
    counted = out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
    return counted.select(*docs.columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents"))
