"""Column roles, row identity and counting queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.plans.cut import cut

RID = "_rid"
GROUP = "group_id"

#: Gives a physical column of a record as a Column: of a table, or a literal.
Record = Callable[[str], Column]
#: column -> (low, high), both included, or a set of values
Query = Mapping[str, "tuple | set | frozenset | list"]


@dataclass(frozen=True)
class Roles:
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]
    unaltered: tuple[str, ...]


def is_categorical(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.StringType, T.BooleanType))


def column_roles(df: DataFrame, quasi_identifier: Sequence[str], categorical: Iterable[str] = ()) -> Roles:
    """Quasi-identifiers in their given order by kind; all other columns in the table's order.

    Strings and booleans are categorical; ``categorical`` names further ones.
    """
    if missing := [c for c in quasi_identifier if c not in df.columns]:
        raise ValueError(f"no such column: {', '.join(missing)}")
    more = set(categorical)
    as_set = [c for c in quasi_identifier if c in more or is_categorical(df, c)]
    hidden = {RID, GROUP, *quasi_identifier}
    return Roles(tuple(as_set), tuple(c for c in quasi_identifier if c not in as_set), tuple(c for c in df.columns if c not in hidden))


def number_rows(df: DataFrame, *order: str | Column, name: str = RID, first: int = 0) -> DataFrame:
    """Add ``name``: numbers from ``first`` without gaps, in the given order (of the input, if none).

    Rows are put in range partitions and numbered there, so no task orders the
    whole table.  They are written before the partitions are counted: a plan
    that ran again could cut them otherwise.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    placed = cut(placed.withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    sizes = placed.groupBy(part.alias("__p")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__p", before.alias("__before"))  # a row for each partition
    number = F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + first
    return placed.join(F.broadcast(starts), part == F.col("__p")).withColumn(name, number).drop("__m", "__p", "__before")


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: numbers from 0 within the rows of equal ``keys`` (not null), in the given order.

    No task holds all rows of a key: the whole table is numbered in range
    partitions, and each key's first number taken off.
    """
    numbered = number_rows(df, *keys, *order, name="__number")
    first = numbered.groupBy(*keys).agg(F.min("__number").alias("__first"))
    return numbered.join(first, list(keys)).withColumn(name, F.col("__number") - F.col("__first")).drop("__number", "__first")


def with_row_id(df: DataFrame, key: str | Sequence[str] | None = None) -> DataFrame:
    """Add ``_rid``: a unique key of the table, or a number in the order of ``key`` columns.

    Without a key the row's place in the input counts; the numbered table is
    written, so that ids stay what they are when it is read again.
    """
    if isinstance(key, str):
        return df.withColumn(RID, F.col(key).cast("bigint"))
    if key is None:
        return cut(df.withColumn(RID, F.monotonically_increasing_id()))
    return number_rows(df, *key)


def of(alias: str) -> Record:
    """The record in a table's alias."""
    return lambda c: F.col(f"{alias}.`{c}`")


def row() -> Record:
    return lambda c: F.col(f"`{c}`")


def literal(record: Mapping) -> Record:
    return lambda c: F.lit(record[c])


def is_range(restriction) -> bool:
    return isinstance(restriction, tuple)


def within(value: Column, restriction) -> Column:
    """Whether a raw value meets a restriction; a null does not."""
    if is_range(restriction):
        return F.coalesce(value.between(*restriction), F.lit(False))
    if not restriction:
        return F.lit(False)
    return F.coalesce(value.isin(*sorted(restriction, key=str)), F.lit(False))


def both(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def product(factors: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a * b, factors, F.lit(1).cast("bigint"))
