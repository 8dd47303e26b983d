"""Privacy models: conditions on equivalence classes as aggregates.

All are exact: approximate distinct counts would not be a guarantee.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.plans.cut import cut
from cloakframe.plans.roles import number_rows

TOLERANCE = 1e-12
MOST_VALUES = 100_000


class PrivacyModel(ABC):
    """A condition that every class must meet.

    A model tests the classes of a table, and a single class from the counts of
    its sensitive values; partitioning works with any model that has both.
    """

    sensitive: str | None = None

    @abstractmethod
    def holds(self, df: DataFrame, group: str) -> DataFrame:
        """(group, ok) for each class of ``df``."""

    @abstractmethod
    def holds_class(self, ranks: np.ndarray, counts: np.ndarray, shares: np.ndarray, whole: np.ndarray) -> bool:
        """Whether rows may be a class.

        ``ranks`` are the numbers of the sensitive values present, ``counts``
        their rows, ``shares`` their shares of the whole table.  ``whole`` has the
        shares of the table's values by number, the largest first.
        """

    def side(self) -> Column | None:
        """The same test as an aggregate over rows (s, n) of a class: values and counts."""
        return None


@dataclass(frozen=True)
class KAnonymity(PrivacyModel):
    k: int

    def holds(self, df, group):
        return df.groupBy(group).agg((F.count(F.lit(1)) >= self.k).alias("ok"))

    def holds_class(self, ranks, counts, shares, whole):
        return counts.sum() >= self.k

    def side(self):
        return F.sum("n") >= self.k


@dataclass(frozen=True)
class DistinctLDiversity(PrivacyModel):
    l: int  # noqa: E741
    sensitive: str | None

    def holds(self, df, group):
        if self.sensitive is None:
            return df.groupBy(group).agg(F.lit(False).alias("ok"))
        distinct = F.count_distinct(self.sensitive) + F.max(F.col(self.sensitive).isNull().cast("int"))
        return df.groupBy(group).agg((distinct >= self.l).alias("ok"))

    def holds_class(self, ranks, counts, shares, whole):
        return self.sensitive is not None and len(counts) >= self.l

    def side(self):
        return F.count(F.lit(1)) >= self.l if self.sensitive is not None else F.lit(False)


@dataclass(frozen=True)
class Distance:
    """A distance of two distributions, given as arrays over the same values.

    ``parts`` says how to compute it without the values that a class lacks: from
    the gaps of those present, the share these have in the whole table, and the
    largest share of one that is absent.  Without it the whole domain is needed.
    """

    name: str
    arrays: Callable[[np.ndarray, np.ndarray], float]
    gap: str = "max"  # or "sum"
    parts: Callable | None = None


MAX_DISTANCE = Distance("max distance", lambda p, q: float(np.abs(p - q).max(initial=0.0)), "max", lambda gap, mass, absent, largest: largest(gap, absent))
EARTH_MOVER = Distance("earth mover's distance", lambda p, q: 0.5 * float(np.abs(p - q).sum()), "sum", lambda gap, mass, absent, largest: 0.5 * (gap + 1.0 - mass))
DISTANCES = {d.name: d for d in (MAX_DISTANCE, EARTH_MOVER)}


def frequencies(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """(group, value, n, share) of a column; within each group if one is named."""
    keys = [group] if group else []
    counted = df.groupBy(*keys, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("total"))
    joined = counted.join(totals, group) if group else counted.crossJoin(F.broadcast(totals))
    return joined.select(*keys, "value", "n", (F.col("n") / F.col("total")).alias("share"))


def domain_of(df: DataFrame, column: str) -> DataFrame:
    """(value, q, rank): the values of a column, their shares, and their numbers by share."""
    return cut(number_rows(frequencies(df, column).select("value", F.col("share").alias("q")), F.desc("q"), "value", name="rank"))


def whole_domain(domain: DataFrame, most: int = MOST_VALUES) -> np.ndarray:
    """Shares by rank, of at most ``most`` values."""
    rows = domain.filter(F.col("rank") < most).select("rank", "q").toArrow()
    out = np.zeros(rows.num_rows)
    out[rows.column("rank").to_numpy()] = rows.column("q").to_numpy()
    return out


def counted_test(test: Callable[[np.ndarray, np.ndarray], object], kind: str) -> Column:
    """``test(ranks, counts)`` of a class, as an aggregate over rows (rank, n)."""

    @F.pandas_udf(kind)
    def run(held: pd.Series) -> pd.Series:
        pairs = (sorted(dict(x).items()) for x in held)
        return pd.Series([test(*map(np.array, zip(*p, strict=True))) for p in pairs])

    return run(F.map_from_entries(F.collect_list(F.struct("rank", "n"))))


@dataclass(frozen=True)
class TCloseness(PrivacyModel):
    """Distance to the whole table's distribution, over its whole domain."""

    t: float
    sensitive: str | None
    distance: Distance = MAX_DISTANCE

    def distances(self, df: DataFrame, group: str, whole: DataFrame | None = None) -> DataFrame:
        """(group, distance)."""
        sides = df.groupBy(group, F.col(self.sensitive).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        domain = domain_of(whole if whole is not None else df, self.sensitive).withColumnRenamed("value", "v")
        placed = sides.join(domain, F.col("value").eqNullSafe(F.col("v")), "left").select(group, "n", "rank", F.coalesce("q", F.lit(0.0)).alias("q"))
        return self.of_sides(placed, [group], domain)

    def of_sides(self, sides: DataFrame, keys: list[str], domain: DataFrame) -> DataFrame:
        """(keys, distance) from rows (keys, n, rank, q).

        Values absent from a class count with share 0.  Their part depends on the
        values present only through what is left of the whole distribution, so
        classes are never multiplied by the domain: the sum needs the present
        mass, the maximum the first rank that is missing.
        """
        if self.distance.parts is None:
            shares = whole_domain(domain, MOST_VALUES + 1)
            if len(shares) > MOST_VALUES:
                raise ValueError(f"{self.distance.name} needs all of at most {MOST_VALUES} sensitive values")
            return sides.groupBy(*keys).agg(counted_test(lambda ranks, counts: self._whole(ranks, counts, shares), "double").alias("distance"))
        of_class = Window.partitionBy(*keys)
        gap = F.abs(F.col("n") / F.sum("n").over(of_class) - F.col("q"))
        place = F.row_number().over(of_class.orderBy(F.asc_nulls_last("rank"))) - 1
        seen = sides.select(*keys, "q", gap.alias("gap"), (place == F.col("rank")).alias("next"))
        found = seen.groupBy(*keys).agg(getattr(F, self.distance.gap)("gap").alias("gap"), F.sum("q").alias("mass"), F.count_if("next").alias("missing"))
        absent = domain.select(F.col("rank").alias("missing"), F.col("q").alias("absent"))
        return found.join(absent, "missing", "left").select(*keys, self.distance.parts(F.col("gap"), F.col("mass"), F.coalesce("absent", F.lit(0.0)), F.greatest).alias("distance"))

    def _whole(self, ranks: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> float:
        p = np.zeros(len(shares))
        p[ranks] = counts / counts.sum()
        return float(self.distance.arrays(p, shares))

    def holds(self, df, group):
        if self.sensitive is None:
            return df.groupBy(group).agg(F.lit(False).alias("ok"))
        return self.distances(df, group).select(group, (F.col("distance") <= self.t + TOLERANCE).alias("ok"))

    def holds_class(self, ranks, counts, shares, whole):
        if self.sensitive is None or not len(counts):
            return False
        if self.distance.parts is None:
            return self._whole(ranks, counts, whole) <= self.t + TOLERANCE
        gaps = np.abs(counts / counts.sum() - shares)
        gap = getattr(gaps, self.distance.gap)()
        first = int((ranks == np.arange(len(ranks))).sum())  # ranks come in order
        absent = whole[first] if first < len(whole) else 0.0
        return self.distance.parts(gap, shares.sum(), absent, max) <= self.t + TOLERANCE


def check(df: DataFrame, group: str, models: list[PrivacyModel]) -> DataFrame:
    """(group, ok): whether each class meets all models."""
    out = models[0].holds(df, group)
    for m in models[1:]:
        out = out.join(m.holds(df, group).withColumnRenamed("ok", "more"), group).select(group, (F.col("ok") & F.col("more")).alias("ok"))
    return out
