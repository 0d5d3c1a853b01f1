"""Ratios, rounding and display forms of numbers, and shape guards of parameters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", re.I)


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where there is no whole."""
    return F.when(whole != 0, part.cast("double") / whole)


def exact_mean(x: Column) -> Column:
    """The mean of decimal numbers kept as doubles, from their exact sum, so that no order of rows moves it over a half; of
    numbers that the sum doesn't hold to the tenth place, the mean of doubles."""
    held = F.abs(x) < 1e15
    return F.when(F.bool_and(held), (F.sum(F.when(held, x).cast("decimal(26,10)")) / F.count(x)).cast("double")).otherwise(F.avg(x))


def near_half(x: Column) -> Column:
    """Whether the mean of doubles is nearer to a half than the rounding of a sum can go, so that the order of its additions may
    show in the rounded mean. The bound is that of a sum one after the other, twice, with a margin for the places of ``exact_mean``."""
    mean = F.abs(exact_mean(x))
    return F.abs(mean - F.floor(mean) - 0.5) <= (F.count(x) + 1) * 2.0**-52 * F.avg(F.abs(x)) + 1e-9


def means_in_order(rows: DataFrame, key: str, x: str, *order: str) -> DataFrame:
    """(key, mean): the doubles of a key added one after the other in the given order."""
    up_to = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select(key, x, F.struct(*order).alias("_at"), F.sum(x).over(up_to).alias("_sum"))
    return sums.groupBy(key).agg((F.max_by("_sum", "_at") / F.count(x)).alias("mean"))


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(f"(?i)^{UUID.pattern}$"), F.lit(False))


def pages(rows: Column, size: int) -> Column:
    """Pages of so many rows, one at least."""
    return F.greatest(F.lit(1), F.ceil(rows / size)).cast("long")


def percent(ratio: Column) -> Column:
    return F.format_string("%.1f%%", ratio * 100)


def size_label(n: Column) -> Column:
    """Bytes, or kilobytes with one decimal."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(F.replace(F.format_number(n / 1024, 1), F.lit(","), F.lit("")), F.lit(" KB")))
