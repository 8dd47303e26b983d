"""Utility and privacy of releases."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.operators.schemas import COUNT, GeneralisedSchema, RawData
from cloakframe.plans.cut import cut
from cloakframe.plans.roles import GROUP, Query, column_roles, number_rows, product, row

MOST_LISTED = 1_000  # drawn values that are part of a query's plan; more are a table


@dataclass(frozen=True)
class PreparedRelease:
    """A release with its schema and the original quasi-identifiers."""

    release: DataFrame
    schema: GeneralisedSchema
    quasi_identifier: tuple[str, ...]

    @classmethod
    def from_raw_data(cls, df: DataFrame, quasi_identifier: Sequence[str], key: str = "ID", categorical: Sequence[str] = ()) -> PreparedRelease:
        df = df.drop(key)
        schema = RawData.create_for_data(df, quasi_identifier, categorical)
        return cls(schema.generalise(df), schema, tuple(quasi_identifier))

    @property
    def classes(self) -> DataFrame:
        """(generalised columns, group_id, group_size): classes are equal generalised values, nulls included."""
        qi = self.schema.quasi_identifier()
        sized = self.release.groupBy(*qi).agg(F.sum(COUNT).alias("group_size"))
        return sized.withColumn(GROUP, F.xxhash64(*qi))

    def df(self) -> DataFrame:
        """The release with group_id and group_size."""
        qi = self.schema.quasi_identifier()
        whole = Window.partitionBy(*qi)
        return self.release.withColumn(GROUP, F.xxhash64(*qi)).withColumn("group_size", F.sum(COUNT).over(whole))

    def num_groups(self) -> int:
        return self.release.select(*self.schema.quasi_identifier()).distinct().count()

    def group_size(self, group_id: int) -> int:
        found = self.classes.filter(F.col(GROUP) == group_id).select("group_size").first()
        return found["group_size"] if found else 0


def discernibility_penalty(prepared: PreparedRelease) -> DataFrame:
    """One row: the sum of squared class sizes."""
    return prepared.classes.agg(F.coalesce(F.sum(F.col("group_size") * F.col("group_size")), F.lit(0)).alias("penalty"))


@dataclass(frozen=True)
class DrawnValues:
    """Many values of a predicate, as a table (value): rows meet it by a join, so the plan doesn't hold them."""

    table: DataFrame
    size: int

    def __len__(self) -> int:
        return self.size


def _joined(query: Query, prepared: PreparedRelease) -> tuple[Query, PreparedRelease]:
    """The query without its tables of values, and what meets these of the release."""
    rows, rest = prepared.release, {}
    for c, r in query.items():
        if not isinstance(r, DrawnValues):
            rest[c] = r
        elif prepared.schema.is_exact(c):
            rows = rows.join(r.table.select(F.col("value").alias("__drawn")), F.col(f"`{c}`") == F.col("__drawn"), "left_semi")
        else:  # regions hold several values: their shares need the values themselves
            rest[c] = {x["value"] for x in r.table.collect()}
    return rest, PreparedRelease(rows, prepared.schema, prepared.quasi_identifier)


def estimate(query: Query, prepared: PreparedRelease) -> Column:
    """What a row of the release adds to a counting query: its count times the share of its region inside the query."""
    schema, a = prepared.schema, row()
    inside = {c: r for c, r in query.items() if c in prepared.quasi_identifier}
    shares = [F.try_divide(schema.query_overlap(a, {c: r}).cast("double"), schema.set_cardinality(a, [c])) for c, r in inside.items()]
    return F.col(COUNT) * product(shares).cast("double")


def counting_query(query: Query, prepared: PreparedRelease) -> DataFrame:
    """One row: the estimated count of raw records that meet ``query``."""
    query, prepared = _joined(query, prepared)
    rows = prepared.schema.select(prepared.release, query)
    return rows.agg(F.coalesce(F.sum(estimate(query, prepared)), F.lit(0.0)).alias("estimate"))


def counting_query_error(query: Query, original: PreparedRelease, anonymised: PreparedRelease) -> DataFrame:
    """One row (truth, estimate, error): the relative error; a truth of 0 is an error."""
    both = counting_query(query, original).withColumnRenamed("estimate", "truth").crossJoin(F.broadcast(counting_query(query, anonymised)))
    error = F.when(F.col("truth") == 0, F.raise_error(F.lit("no record meets the query")).cast("double")).otherwise(F.abs(F.col("truth") - F.col("estimate")) / F.nullif(F.col("truth"), F.lit(0.0)))
    return both.select("truth", "estimate", error.alias("error"))


@dataclass(frozen=True)
class ValueDomain:
    """The distinct values of a column as a table (rank, value), numbered from 0 in their order; nulls are no values."""

    table: DataFrame
    size: int

    @classmethod
    def of(cls, df: DataFrame, column: str) -> ValueDomain:
        values = df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
        table = cut(number_rows(values, "value", name="rank").select("rank", "value"))
        return cls(table, table.count())

    def draw(self, n: int, source: random.Random) -> set:
        """``n`` values, drawn by rank: the driver gets these only."""
        ranks = self.table.sparkSession.createDataFrame(pd.DataFrame({"rank": np.array(source.sample(range(self.size), n), dtype=np.int64)}), "rank bigint")
        return {r["value"] for r in self.table.join(ranks, "rank").select("value").collect()}

    def draw_table(self, n: int, source: random.Random) -> DrawnValues:
        """The same as a table: those whose ranks have the ``n`` smallest hashes."""
        seed = source.getrandbits(62)
        hashed = self.table.withColumn("__h", F.xxhash64("rank", F.lit(seed)))
        # about n of them lie below the n-th; only a few more are put in order
        share = (n + 10 * n**0.5 + 100) / max(1, self.size)
        near = hashed.filter(F.col("__h") < F.lit(int(share * 2.0**64) - (1 << 63))) if share < 1 else hashed
        drawn = number_rows(near, "__h", "rank", name="__place")
        if share < 1 and near.count() < n:
            drawn = number_rows(hashed, "__h", "rank", name="__place")
        return DrawnValues(cut(drawn.filter(F.col("__place") < n).select("value")), n)


class CountingQueryGenerator:
    """Random counting queries over the domains of an original table, however many values they have."""

    def __init__(self, prepared: PreparedRelease, seed: int | None = None) -> None:
        schema, df = prepared.schema, prepared.release
        if not isinstance(schema, RawData):
            raise TypeError("queries are made from raw data")
        self.quasi_identifier, self.random = prepared.quasi_identifier, random.Random(seed)
        numeric = [c for c in schema.integer if c in df.columns]
        sets = [c for c in schema.categorical if c in df.columns]
        found = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in numeric]).first() if numeric else {}
        self.domains = {c: (found[c]["lo"], found[c]["hi"]) for c in numeric} | {c: ValueDomain.of(df, c) for c in sets}

    def generate(self, num_predicates: int, expected_selectivity: float, use_sensitive: bool = True) -> Query:
        """Predicates on random columns, each of the same weight; the weights multiply to the selectivity."""
        columns = [c for c in self.domains if use_sensitive or c in self.quasi_identifier]
        if not 0 <= expected_selectivity <= 1 or not 0 <= num_predicates <= len(columns):
            raise ValueError("selectivity is within [0, 1], and no column has two predicates")
        if not num_predicates:
            return {}
        weight = expected_selectivity ** (1 / num_predicates)
        return {c: self._predicate(self.domains[c], weight) for c in self.random.sample(columns, num_predicates)}

    def _predicate(self, domain, weight: float):
        if isinstance(domain, ValueDomain):
            n = round(weight * domain.size)
            return domain.draw(n, self.random) if n <= MOST_LISTED else domain.draw_table(n, self.random)
        low, high = domain
        width = round(weight * (high - low))
        start = self.random.randint(low, high - width)
        return (start, start + width)


def normalise_prediction(wide: DataFrame, key: str = "ID") -> DataFrame:
    """(ID, value, confidence) of a wide prediction table, each row's confidences summing to one (null where all are 0)."""
    values = [c for c in wide.columns if c != key]
    total = F.expr(" + ".join(f"coalesce(cast(`{v}` as double), 0D)" for v in values))
    scaled = wide.select(key, *[F.try_divide(F.coalesce(F.col(f"`{v}`").cast("double"), F.lit(0.0)), total).alias(v) for v in values])
    return scaled.unpivot(key, values, "value", "confidence")


def percentage_of_vulnerable_population(original: DataFrame, prediction: DataFrame, confidence: float, sensitive: str, key: str = "ID") -> DataFrame:
    """One row: the share of individuals whose true value is predicted with at least ``confidence``.

    ``prediction`` is long (ID, value, confidence); what it lacks counts as 0.
    """
    truth = original.select(F.col(key).alias("__id"), F.col(sensitive).cast("string").alias("__v"))
    joined = truth.join(prediction, (F.col("__id") == F.col(key)) & (F.col("__v") == F.col("value")), "left")
    return joined.agg(F.avg((F.coalesce("confidence", F.lit(0.0)) >= confidence - 1e-12).cast("double")).alias("pvp"))


def original_quasi_identifier(df: DataFrame, columns: Sequence[str]) -> tuple[str, ...]:
    roles = column_roles(df, columns)
    return (*roles.categorical, *roles.numeric)
