"""Intervals and value sets as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text form of an interval, "lo-hi" or "v", either part may be negative.
INTERVAL = r"^-?\d+(?:--?\d+)?$"


def intervals_meet(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return (lo_a <= hi_b) & (hi_a >= lo_b)


def shared_length(lo: Column, hi: Column, low, high) -> Column:
    """How many whole numbers [lo, hi] and [low, high] have in common."""
    return F.greatest(F.lit(0), F.least(hi, F.lit(high)) - F.greatest(lo, F.lit(low)) + 1).cast("bigint")


def length(lo: Column, hi: Column) -> Column:
    return (hi - lo + 1).cast("bigint")


def parse_interval(text: Column) -> tuple[Column, Column]:
    """Both ends of an interval's text form; other text is an error."""
    fits = text.rlike(INTERVAL)
    wrong = F.raise_error(F.concat(F.lit("not an interval: "), text)).cast("bigint")
    dash = F.locate("-", text, 2)  # a sign may stand before it
    low = F.when(dash == 0, text).otherwise(F.substr(text, F.lit(1), dash - 1))
    high = F.when(dash == 0, text).otherwise(F.substr(text, dash + 1))
    return tuple(F.when(text.isNull(), F.lit(None).cast("bigint")).when(fits, x.cast("bigint")).otherwise(wrong) for x in (low, high))


def parse_set(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def render_interval(lo: Column, hi: Column) -> Column:
    return F.when(lo == hi, lo.cast("string")).otherwise(F.concat_ws("-", lo.cast("string"), hi.cast("string")))


def render_set(values: Column) -> Column:
    return F.array_join(F.array_sort(values), ",")


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two arrays of numbers."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def mismatches(a: Column, b: Column) -> Column:
    """In how many places two arrays differ."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x))
