"""Attacks on sequences of releases.

Prior knowledge is a generalised table with an ``ID``; several rows of one ID
are alternatives.  Knowledge is matched with a release's distinct regions first
and with its rows by an equality join on the region.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.operators.overlap import of_region, region_pairs, regions
from cloakframe.operators.schemas import GeneralisedSchema
from cloakframe.plans.cut import cut
from cloakframe.plans.roles import of

KEY = "ID"


def split_columns(known: Sequence[str], released: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    """(only known, in both, only released)."""
    return [c for c in known if c not in released], [c for c in released if c in known], [c for c in released if c not in known]


class BaseAttacker(ABC):
    @abstractmethod
    def observe(self, release: DataFrame, present_columns: Sequence[str], present_targets: DataFrame | Sequence[int]) -> None:
        """Take in the next release: its original columns, and the targets known to be in it."""

    @abstractmethod
    def predict_all(self, column: str) -> DataFrame:
        """(ID, value, weight) for all targets."""

    def predict(self, target_id: int, column: str) -> dict | None:
        """value -> weight of one target; None where nothing is known."""
        found = {r["value"]: r["weight"] for r in self.predict_all(column).filter(F.col(KEY) == target_id).collect()}
        return found or None

    def finalise(self) -> None:
        return None

    @staticmethod
    def _ids(like: DataFrame, targets: DataFrame | Sequence[int]) -> DataFrame:
        if isinstance(targets, DataFrame):
            return targets.select(KEY).distinct()
        return like.sparkSession.createDataFrame([(int(t),) for t in targets], f"{KEY} bigint").distinct()


class IntersectionAttacker(BaseAttacker):
    """Intersects, over the releases a target is in, the sensitive values of its possible records.

    Targets with the same knowledge are one class.  Values are kept for each
    class and each set of releases its targets were in (``seen``, one sign a
    release), and given to the targets only when they are asked for.
    """

    def __init__(self, knowledge: DataFrame, quasi_identifier: Sequence[str], sensitive: str, schema: GeneralisedSchema) -> None:
        self.knowledge, self.quasi_identifier, self.sensitive, self.schema = knowledge, list(quasi_identifier), sensitive, schema
        physical = self._physical(quasi_identifier)
        self.known = regions(knowledge, physical, "k")
        located = of_region(knowledge, self.known, physical, "k", F.col(KEY))
        sets = cut(located.groupBy(KEY).agg(F.array_sort(F.collect_set("k_id")).alias("held")))
        self.classes = cut(sets.groupBy("held").agg(F.min(KEY).alias("__class")))
        self.members = cut(sets.join(self.classes, "held").select(KEY, "__class", F.lit("").alias("__seen")))
        self.possible: DataFrame | None = None
        self.located: dict[tuple[str, ...], tuple[DataFrame, DataFrame]] = {}

    def _physical(self, columns: Sequence[str]) -> list[str]:
        return [p for c in columns for p in self.schema.physical(c)]

    def observe(self, release, present_columns=(), present_targets=()):
        here = self._ids(self.members, present_targets).withColumn("__here", F.lit("1"))
        self.members = cut(self.members.join(here, KEY, "left").select(KEY, "__class", F.concat("__seen", F.coalesce("__here", F.lit("0"))).alias("__seen")))
        groups = self.members.select("__class", "__seen").distinct().withColumn("__before", F.expr("left(__seen, length(__seen) - 1)"))
        groups = cut(groups.select("*", F.col("__seen").endswith("1").alias("__here"), F.col("__before").contains("1").alias("__again")))
        now = self._values(groups.filter("__here").select("__class").distinct(), release, [c for c in self.quasi_identifier if not present_columns or c in present_columns])
        # groups seen for the first time start with what they have now
        kept = groups.filter("__here and not __again").join(now, "__class")
        if self.possible is not None:
            had = groups.join(self.possible.withColumnRenamed("__seen", "__before"), ["__class", "__before"])
            kept = kept.unionByName(had.filter("not __here")).unionByName(had.filter("__here").join(now, ["__class", "value"], "left_semi"))
        self.possible = cut(kept.select("__class", "__seen", "value"))

    def _values(self, present: DataFrame, release: DataFrame, on: Sequence[str]) -> DataFrame:
        """(class, value): sensitive values of the records that overlap, for the classes of ``present``."""
        physical = self._physical(on)
        if not physical:
            return present.crossJoin(release.select(F.col(self.sensitive).alias("value")).distinct())
        k, held_by = self._known(physical)
        held_by = held_by.join(present, "__class", "left_semi")
        k = k.join(held_by, "k_id", "left_semi")
        rows = cut(release.select(*[f"`{c}`" for c in physical], F.col(self.sensitive).alias("__value")).distinct())
        g = regions(rows, physical, "g")
        pairs = region_pairs(k, g, self.schema, on).select("k_id", "g_id")
        met = pairs.join(of_region(rows, g, physical, "g", F.col("__value").alias("value")), "g_id").select("k_id", "value").distinct()
        return met.join(held_by, "k_id").select("__class", "value").distinct()

    def _known(self, physical: list[str]) -> tuple[DataFrame, DataFrame]:
        """The regions of all targets in some columns, and (class, k_id): found once for each choice of columns."""
        if tuple(physical) not in self.located:
            each = self.classes.select("__class", F.explode("held").alias("k_id"))
            k = self.known
            if set(physical) != set(self._physical(self.quasi_identifier)):
                whole = self.known.select(F.col("k_id").alias("__whole"), "k.*")
                k = regions(whole, physical, "k")
                narrow = of_region(whole, k, physical, "k", F.col("__whole"))
                each = each.withColumnRenamed("k_id", "__whole").join(narrow, "__whole").select("__class", "k_id").distinct()
            self.located[tuple(physical)] = k, cut(each)
        return self.located[tuple(physical)]

    def predict_all(self, column):
        if column == self.sensitive:
            if self.possible is None:
                return self.knowledge.select(KEY, F.lit(None).cast("string").alias("value"), F.lit(1.0).alias("weight")).limit(0)
            return self.possible.join(self.members, ["__class", "__seen"]).select(KEY, "value", F.lit(1.0).alias("weight"))
        values = self.schema.values_for(of("k"), column)
        return self.knowledge.alias("k").select(F.col(f"k.{KEY}").alias(KEY), F.explode(values).alias("value")).distinct().withColumn("weight", F.lit(1.0))
