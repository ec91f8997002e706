"""Running totals and ranks over a whole table without a window over all rows: ranges of the first order key, their totals as offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def order_number(order: Column, kind: str) -> Column:
    """A number that rises with the key: itself, or the first six bytes of a text; null: below all others."""
    if kind in ("string", "binary"):
        head = F.rpad(F.hex(F.substring(order.cast("binary"), 1, 6)), 12, "0")
        return F.coalesce(F.conv(head, 16, 10).cast("double"), F.lit(-1.0))
    return F.coalesce(order.cast("double"), F.lit(float("-inf")))


def running(rows: DataFrame, order: str, ties: list[str], value: Column | None = None, name: str = "upto", ranges: int = RANGES) -> DataFrame:
    """rows with the sum of `value` (without one: the number of rows) up to and with each row, by `order`, then `ties`.

    Rows are dealt to ranges of the first key between its approximate quantiles. The ranges' bounds and totals, at most `ranges`
    numbers each, go to the driver; inside a range a window adds up. Equal first keys share a range, so the key should be nearly
    unique. The columns order and ties together tell rows apart; what is equal in all of them comes in any order.
    """
    first = order_number(F.col(order), dict(rows.dtypes)[order])
    shares = [k / ranges for k in range(1, ranges)]
    found = rows.agg(F.percentile_approx(first, shares, 10 * ranges)).first()[0]
    bounds = sorted({b for b in found or () if b == b and abs(b) != float("inf")})
    place = F.expr(f"size(filter(array({', '.join(f'{b!r}D' for b in bounds)}), b -> b < __first))") if bounds else F.lit(0)
    dealt = rows.withColumn("__first", first).withColumn("__range", place).withColumn("__value", F.lit(1) if value is None else value)
    totals = dict(dealt.groupBy("__range").agg(F.sum("__value")).collect())  # a row a range
    offset, offsets = 0, []
    for k in range(len(bounds) + 1):
        offsets.append(offset)
        offset += totals.get(k) or 0
    kind = "long" if all(isinstance(x, int) for x in offsets) else "double"
    before = F.get(F.array(*[F.lit(x).cast(kind) for x in offsets]), F.col("__range"))
    own = Window.partitionBy("__range").orderBy("__first", order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn(name, before + F.sum("__value").over(own)).drop("__first", "__range", "__value")
