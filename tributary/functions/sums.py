"""Exact sums of doubles, in any order.

A double is a whole number times a power of two. Numbers whose powers lie in one window of WINDOW powers are multiples of one unit and so add up as
whole numbers, without any loss; the windows of a group, at most some 270, are put together once, at the end, from the largest to the smallest. So a sum doesn't
depend on how rows were partitioned, and small numbers beside large ones keep their digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Powers of two that share a window.
WINDOW = 8
#: A window's unit is so many powers below its first one: numbers then have at most 63 bits.
BITS = 54
#: Where whole numbers of more bits than a double holds are cut.
HALF = 1 << 48


def _scaled(value: Column, power: Column) -> Column:
    """value * 2 ** power, in two steps so that neither step leaves the range of doubles."""
    first = F.shiftright(power, 1)
    return value * F.pow(F.lit(2.0), first) * F.pow(F.lit(2.0), power - first)


def window_of(value: Column) -> Column:
    """The window of a double; null for null, zero, NaN and infinities."""
    plain = (value != 0) & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(plain, F.floor(F.log2(F.abs(value)) / WINDOW).cast("int"))


def units_of(value: Column, window: Column) -> Column:
    """The double as a whole number of its window's units, as a decimal whose sums have room for 10 ** 19 of them."""
    return _scaled(value, BITS - window * WINDOW).cast("long").cast("decimal(28,0)")


def put_together(windows: Column) -> Column:
    """The double nearest to the sum of windows: an array of (window, units), units being sums of units_of. Windows are added from the largest to the smallest, with what each step rounds off kept apart."""

    def parts(w: Column) -> Column:
        high = F.call_function("div", w["units"], F.lit(HALF))
        low = (w["units"] - high.cast("decimal(20,0)") * F.lit(HALF).cast("decimal(15,0)")).cast("long")
        power = w["window"] * WINDOW - BITS
        return F.array(_scaled(high.cast("double"), power + 48), _scaled(low.cast("double"), power))

    terms = F.flatten(F.transform(F.reverse(F.array_sort(windows)), parts))

    def add(state: Column, term: Column) -> Column:
        total = state["total"] + term
        lost = F.when(F.abs(state["total"]) >= F.abs(term), (state["total"] - total) + term).otherwise((term - total) + state["total"])
        return F.struct(total.alias("total"), (state["lost"] + lost).alias("lost"))

    beyond = lambda s: F.abs(s["total"]) == float("inf")
    return F.aggregate(terms, F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("lost")), add, lambda s: F.when(beyond(s), s["total"]).otherwise(s["total"] + s["lost"]))
