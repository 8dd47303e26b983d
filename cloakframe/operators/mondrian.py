"""Top-down median partitioning (strict Mondrian), level by level.

State is one row per record with the path of its partition.  A level is a few
distributed aggregates over the partitions that may still split: bounds and
medians of every feature, the counts that the privacy models need for both sides
of every candidate split, and the first feasible candidate in the order of
normalised spans.  Partitions of at most ``local_rows`` records are finished in
one task each by the same rules, all of them in one job at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cloakframe.operators.models import MOST_VALUES, TOLERANCE, KAnonymity, PrivacyModel, TCloseness, counted_test, domain_of, whole_domain
from cloakframe.plans.cut import cut, written
from cloakframe.plans.roles import GROUP, RID, is_categorical, with_row_id

ROOT = "R"
MOST_BROADCAST = 100_000  # rows of a level's bounds, or of ends of a search; more are joined


def normalised_spans(df: DataFrame, features: Sequence[str], group: str, categorical: Sequence[str] = ()) -> DataFrame:
    """(group, one span a feature): the width of numbers or the count of categories, as a share of the whole table's."""
    width = {f: F.count_distinct(f).cast("double") if f in categorical or is_categorical(df, f) else (F.max(f) - F.min(f)).cast("double") for f in features}
    whole = df.agg(*[w.alias(f"__{f}") for f, w in width.items()])
    by = df.groupBy(group).agg(*[w.alias(f) for f, w in width.items()])
    return by.crossJoin(F.broadcast(whole)).select(group, *[F.coalesce(F.try_divide(f, f"__{f}"), F.lit(0.0)).alias(f) for f in features])


def _width(name: str) -> Column:
    """The width of a group's numbers: 0 where all are the same, infinite ones too."""
    return F.when(F.max(name) == F.min(name), 0.0).otherwise(F.max(name) - F.min(name))


def _middle(value: Column) -> Column:
    """Halfway between the one or two values of a group; halves are added, as sums of large numbers have no end."""
    return F.when(F.min(value) == F.max(value), F.min(value)).otherwise(F.min(value) * 0.5 + F.max(value) * 0.5)


def _median(x: np.ndarray) -> float:
    """The same of an array's middle."""
    a, b = np.partition(x, [(len(x) - 1) // 2, len(x) // 2])[[(len(x) - 1) // 2, len(x) // 2]]
    return float(a) if a == b else float(0.5 * a + 0.5 * b)


def searched_medians(rows: DataFrame, sizes: DataFrame, names: Sequence[str], buckets: int = 1024) -> DataFrame:
    """(pid, m_name...): exact medians of ``names`` in the partitions of ``sizes`` (pid, rows).

    The first pass counts the values by sign and power of two, which parts values of
    any size; in one such class each further pass counts in ``buckets`` of equal
    width between the smallest and the largest value, and goes on in the bucket
    that holds the middle, until that is one value: six passes at most for the 52
    bits of a number.  Passes move counts only; ``sizes`` is broadcast where it is
    small, so rows stay where they are.
    """
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(n).alias("v")) for i, n in enumerate(names)]))
    few = sizes.select("pid")
    few = F.broadcast(few) if few.count() <= MOST_BROADCAST else few
    long = rows.join(few, "pid", "left_semi").select("pid", values.alias("x")).select("pid", "x.f", "x.v")
    middle = F.explode(F.array_distinct(F.array(F.floor((F.col("rows") - 1) / 2), F.floor(F.col("rows") / 2))))
    size = F.abs("v")
    power = F.when(size == float("inf"), 5000).when(size == 0, 0).otherwise(F.floor(F.log2(size)) + 1100)
    counted = long.groupBy("pid", "f", (F.signum("v") * power).alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    until = F.sum("n").over(Window.partitionBy("pid", "f").orderBy("at"))
    ranks = sizes.select(F.col("pid").alias("p"), middle.alias("rank"))
    held = counted.withColumn("until", until).join(ranks, (F.col("pid") == F.col("p")) & (F.col("rank") < F.col("until")) & (F.col("rank") >= F.col("until") - F.col("n")))
    search = written(held.select("pid", "f", "lo", "hi", "rank", (F.col("until") - F.col("n")).alias("below")))
    while not search.filter("lo < hi").isEmpty():
        ahead = search.filter("lo < hi")
        ahead = F.broadcast(ahead) if ahead.count() <= MOST_BROADCAST else ahead
        inside = long.join(ahead, ["pid", "f"]).filter("v between lo and hi")
        at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))
        counted = inside.groupBy("pid", "f", "rank", "below", at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        until = F.sum("n").over(Window.partitionBy("pid", "f", "rank").orderBy("at"))
        found = counted.withColumn("until", F.col("below") + until).filter((F.col("until") > F.col("rank")) & (F.col("until") - F.col("n") <= F.col("rank")))
        search = written(search.filter("lo >= hi").unionByName(found.select("pid", "f", "lo", "hi", "rank", (F.col("until") - F.col("n")).alias("below"))))
    return search.groupBy("pid").agg(*[_middle(F.when(F.col("f") == i, F.col("lo"))).alias(f"m_{n}") for i, n in enumerate(names)])


@dataclass(frozen=True)
class Mondrian:
    models: tuple[PrivacyModel, ...]
    features: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    local_rows: int = 20_000
    median_rows: int = 1_000_000  # above it a partition's median is searched, not gathered; the value is the same

    @property
    def k(self) -> int:
        return max([1, *(m.k for m in self.models if isinstance(m, KAnonymity))])

    @property
    def sensitive(self) -> str | None:
        return next((m.sensitive for m in self.models if m.sensitive is not None), None)

    def partition(self, df: DataFrame) -> DataFrame:
        """(_rid, group_id): ``df`` needs a unique ``_rid``; group_id is the path of splits.

        Nulls and NaN in numeric features are rejected: neither side of a median
        holds them.  Infinite ones are values like others; a width is infinite
        then, and counts as the whole where the table's is.  The root is returned even where it violates the models.
        """
        categorical = [f for f in self.features if f in self.categorical or is_categorical(df, f)]
        numeric = [f for f in self.features if f not in categorical]
        cols = [F.col(f).cast("double").alias(f"n{i}") if f in numeric else F.coalesce(F.col(f).cast("string"), F.lit("\0null")).alias(f"c{i}") for i, f in enumerate(self.features)]
        names = [f"n{i}" if f in numeric else f"c{i}" for i, f in enumerate(self.features)]
        rows = df.select(RID, *cols, (F.col(self.sensitive) if self.sensitive else F.lit(None)).cast("string").alias("s"), F.lit(ROOT).alias("pid"))
        # sensitive values as numbers with their shares; the driver sees the shares of the most frequent only
        domain = domain_of(rows, "s") if self.sensitive else df.sparkSession.createDataFrame([(None, 1.0, 0)], "value string, q double, rank bigint")
        if self.sensitive:
            values = domain.withColumnRenamed("value", "v")
            rows = rows.join(values, F.col("s").eqNullSafe(F.col("v"))).drop("v", "s")
        else:
            rows = rows.drop("s").withColumns({"q": F.lit(1.0), "rank": F.lit(0).cast("bigint")})
        rows = written(rows)
        span = lambda n: _width(n) if n[0] == "n" else F.count_distinct(n).cast("double")
        scale = rows.agg(F.count(F.lit(1)).alias("rows"), *[span(n).alias(n) for n in names], *[F.count_if(F.col(n).isNull() | F.isnan(n)).alias(f"bad_{n}") for n in names if n[0] == "n"]).first()
        if any(scale[f"bad_{n}"] for n in names if n[0] == "n"):
            raise ValueError("numeric features hold nulls or NaN")
        if not scale["rows"]:
            return rows.select(RID, F.col("pid").alias(GROUP))
        scales = {n: float(scale[n] or 0) for n in names}
        own = [m for m in self.models if not (m.side() is not None or isinstance(m, TCloseness) and m.distance.parts is not None)]
        most = max(self.local_rows, 2 * self.k, MOST_VALUES if own else 0) + 1
        shares = whole_domain(domain, most)
        if own and len(shares) == most:
            raise ValueError(f"{type(own[0]).__name__} needs all of at most {most - 1} sensitive values")

        local: list[DataFrame] = []
        done: list[DataFrame] = []
        active, limit = rows, max(self.local_rows, 2 * self.k - 1)
        while True:
            largest = Observation()
            bounds = self._bounds(active, names, scale["rows"] > self.median_rows)
            bounds = written(bounds.observe(largest, F.max("rows").alias("rows")))
            if (largest.get.get("rows") or 0) <= limit:
                local.append(active)
                break
            split = written(self._split(active, bounds, names, scales, domain, shares, limit))
            state = F.coalesce("side", F.lit("done"))
            local.append(split.filter(state == "local").drop("side"))
            done.append(split.filter(state == "done").select(RID, F.col("pid").alias(GROUP)))
            active = split.filter(state.isin("L", "R")).withColumn("pid", F.concat("pid", "side")).drop("side")
        near = local[0]
        for d in local[1:]:
            near = near.unionByName(d)
        out = near.groupBy("pid").applyInPandas(self._finisher(names, scales, shares), f"{RID} bigint, {GROUP} string")
        for d in done:
            out = out.unionByName(d)
        return cut(out)

    @staticmethod
    def _small(df: DataFrame) -> DataFrame:
        """A table of a row for each partition (written already), broadcast if it has few."""
        return F.broadcast(df) if df.count() <= MOST_BROADCAST else df

    def _bounds(self, active: DataFrame, names: Sequence[str], large: bool) -> DataFrame:
        """(pid, rows, median and width of each number, width and cut of each set of categories).

        Categories count by first appearance: a partition's left half are those
        that first stand before the cut.
        """
        numeric = [n for n in names if n[0] == "n"]
        simple = [F.count(F.lit(1)).alias("rows"), *[_width(n).alias(f"w_{n}") for n in numeric]]
        gathered = [F.median(n).alias(f"m_{n}") for n in numeric]
        if not large or not numeric:
            bounds = active.groupBy("pid").agg(*simple, *gathered)
        else:
            sizes = written(active.groupBy("pid").agg(*simple))
            many = sizes.filter(F.col("rows") > self.median_rows)
            few = active.join(many, "pid", "left_anti").groupBy("pid").agg(*gathered)
            bounds = sizes.join(few.unionByName(searched_medians(active, many, numeric)), "pid")
        for c in (n for n in names if n[0] == "c"):
            seen = active.groupBy("pid", c).agg(F.min(RID).alias("first"))
            values = seen.groupBy("pid").agg(F.count(F.lit(1)).cast("double").alias(f"w_{c}"), F.array_sort(F.collect_list("first")).alias("firsts"))
            values = values.select("pid", f"w_{c}", F.get("firsts", F.floor(F.size("firsts") / 2).cast("int")).alias(f"m_{c}"))
            bounds = bounds.join(values, "pid")
        return bounds

    def _split(self, active: DataFrame, bounds: DataFrame, names: Sequence[str], scales: dict[str, float], domain: DataFrame, shares: np.ndarray, limit: int) -> DataFrame:
        """``active`` with ``side`` L or R, "local" where few rows are left, null where a partition is finished."""
        joined = active.join(self._small(bounds), "pid")
        for c in (n for n in names if n[0] == "c"):
            first = active.groupBy("pid", c).agg(F.min(RID).alias(f"f_{c}"))
            joined = joined.join(first, ["pid", c])
        normal = lambda n: (F.col(f"w_{n}") == scales[n]).cast("double") if np.isinf(scales[n]) else F.col(f"w_{n}") / scales[n] if scales[n] else F.lit(0.0)
        # no value is below a middle between the two infinities, which is no number
        left = lambda n: (F.col(n) < F.col(f"m_{n}")) & ~F.isnan(f"m_{n}") if n[0] == "n" else F.col(f"f_{n}") < F.col(f"m_{n}")
        options = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), normal(n).alias("span"), left(n).alias("left")) for i, n in enumerate(names)]))
        large = joined.filter(F.col("rows") > limit)
        sides = large.select("pid", "rank", "q", options.alias("o")).groupBy("pid", "o.f", "o.left", "rank").agg(F.count(F.lit(1)).alias("n"), F.first("o.span").alias("span"), F.first("q").alias("q"))
        keys, ok = ["pid", "f", "left"], F.lit(True)
        close = [m for m in self.models if isinstance(m, TCloseness) and m.distance.parts is not None]
        for m in self.models:
            if m.side() is not None:
                ok = ok & m.side()
            elif m not in close:
                ok = ok & counted_test(lambda ranks, counts, m=m: bool(m.holds_class(ranks, counts, shares[ranks], shares)), "boolean")
        sides = written(sides) if close else sides
        per_side = sides.groupBy(*keys).agg(ok.alias("ok"), F.first("span").alias("span"))
        for m in close:
            far = m.of_sides(sides.select(*keys, "n", "rank", "q"), keys, domain)
            per_side = per_side.join(far, keys).select(*keys, (F.col("ok") & (F.col("distance") <= m.t + TOLERANCE)).alias("ok"), "span")
        feasible = per_side.groupBy("pid", "f").agg((F.min("ok") & (F.count(F.lit(1)) == 2)).alias("ok"), F.first("span").alias("span")).filter("ok")
        chosen = feasible.groupBy("pid").agg(F.min_by("f", F.struct((-F.col("span")).alias("o"), F.col("f").alias("g"))).alias("f"))
        placed = joined.join(self._small(written(chosen)), "pid", "left")
        side = F.lit(None).cast("string")
        for i, n in enumerate(names):
            side = F.when(F.col("f") == i, F.when(left(n), "L").otherwise("R")).otherwise(side)
        return placed.select(RID, *names, "rank", "q", "pid", F.when(F.col("rows") <= limit, F.lit("local")).otherwise(side).alias("side"))

    def _finisher(self, names: Sequence[str], scales: dict[str, float], shares: np.ndarray):
        models, k = self.models, self.k

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(RID, kind="stable")
            ranks, q = pdf["rank"].to_numpy(), pdf["q"].to_numpy()
            data = {n: pdf[n].to_numpy(dtype=float) if n[0] == "n" else pd.factorize(pdf[n])[0] for n in names}
            out = np.empty(len(pdf), dtype=object)

            def holds(at: np.ndarray) -> bool:
                present, first, counts = np.unique(ranks[at], return_index=True, return_counts=True)
                return all(m.holds_class(present, counts, q[at][first], shares) for m in models)

            stack = [(np.arange(len(pdf)), str(pdf["pid"].iloc[0]))]
            np.seterr(over="ignore", invalid="ignore")  # widths and middles of infinite values
            while stack:
                at, path = stack.pop()
                cut_ = None
                if len(at) >= 2 * k:
                    spans = {}
                    for n in names:
                        x = data[n][at]
                        wide = (x.max() - x.min() if x.max() > x.min() else 0.0) if n[0] == "n" else len(np.unique(x))
                        spans[n] = float(wide == scales[n]) if np.isinf(scales[n]) else wide / scales[n] if scales[n] else 0.0
                    for n in sorted(names, key=lambda n: -spans[n]):
                        x = data[n][at]
                        if n[0] == "n":
                            left = x < _median(x)
                        else:
                            u, first = np.unique(x, return_index=True)
                            left = np.isin(x, u[np.argsort(first)][: len(u) // 2])
                        if left.any() and not left.all() and holds(at[left]) and holds(at[~left]):
                            cut_ = left
                            break
                if cut_ is None:
                    out[at] = path
                else:
                    stack += [(at[cut_], path + "L"), (at[~cut_], path + "R")]
            return pd.DataFrame({RID: pdf[RID].to_numpy(), GROUP: out})

        return run


def numbered(partition: DataFrame) -> DataFrame:
    """``group_id`` as a number in breadth-first order of the paths."""
    paths = partition.select(GROUP).distinct().withColumn("__depth", F.length(GROUP))
    number = with_row_id(paths, ["__depth", GROUP]).select(GROUP, F.col(RID).alias("__n"))
    return partition.join(number, GROUP).select(RID, F.col("__n").cast("bigint").alias(GROUP))
