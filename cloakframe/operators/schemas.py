"""Generalised representations of equivalence classes.

A schema turns a partitioned table into a release: one row for each class and
each distinct tuple of unaltered columns, with its ``count``.  All operations on
releases are column expressions, so predicates and products of any number of
rows stay in one plan.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions.sets import intervals_meet, length, parse_interval, parse_set, render_interval, render_set, shared_length
from cloakframe.plans.roles import GROUP, RID, Query, Record, both, column_roles, literal, product, row, within

COUNT = "count"


class GeneralisedSchema(ABC):
    """Base of all schemas; subclasses give the expressions."""

    unaltered: tuple[str, ...]

    # -- construction -------------------------------------------------------
    @classmethod
    @abstractmethod
    def create_for_data(cls, df: DataFrame, quasi_identifier: Sequence[str], categorical: Iterable[str] = ()) -> GeneralisedSchema: ...

    @classmethod
    @abstractmethod
    def from_json_dict(cls, found: Mapping) -> GeneralisedSchema: ...

    @abstractmethod
    def to_json_dict(self) -> dict: ...

    @abstractmethod
    def quasi_identifier(self) -> list[str]:
        """Physical columns of the generalised quasi-identifiers."""

    def is_original_column(self, column: str) -> bool:
        return column in self.unaltered

    # -- generalisation -----------------------------------------------------
    @abstractmethod
    def _parts(self) -> dict[str, tuple[Column, object, object]]:
        """name -> (aggregate over rows, the same over such aggregates in a window, output expression)."""

    def generalise(self, df: DataFrame, partition: DataFrame | None = None, group: str = GROUP) -> DataFrame:
        """The release of ``df``, whose column ``group`` names each row's class.

        With ``partition`` (_rid, group) that column comes from a join on
        ``_rid``.  Rows are aggregated once by class and unaltered tuple; the
        class's own bounds are a window over that much smaller result.
        """
        if partition is not None:
            df = df.join(partition.select(RID, group), RID)
        parts = self._parts()
        by = df.groupBy(group, *self.unaltered).agg(F.count(F.lit(1)).alias(COUNT), *[a.alias(f"__{n}") for n, (a, _, _) in parts.items()])
        whole = Window.partitionBy(group)
        merged = by.select(*self.unaltered, COUNT, *[merge(F.col(f"__{n}")).over(whole).alias(f"__{n}") if callable(merge) else F.col(f"__{n}").alias(f"__{n}") for n, (_, merge, _) in parts.items()])
        return merged.select(*self._output(), *self.unaltered, COUNT)

    @abstractmethod
    def _output(self) -> list[Column]: ...

    # -- record algebra -----------------------------------------------------
    @abstractmethod
    def overlaps(self, a: Record, b: Record, on: Sequence[str]) -> Column:
        """Whether two records have a raw record in common on original columns ``on``."""

    def bounds(self, a: Record, column: str) -> tuple[Column, Column] | None:
        """Ends of a record's interval in a column; records overlap there where intervals meet."""
        return None

    def is_exact(self, column: str) -> bool:
        """Whether records overlap in a column only where they are equal, null with null."""
        return column in self.unaltered

    def keys(self, a: Record, column: str) -> tuple[Column, Column] | None:
        """Two arrays: records overlap in a column where the first of one shares a value with the second of the other."""
        return None

    @abstractmethod
    def meets(self, a: Record, query: Query) -> Column:
        """Whether a record has a raw record in common with a counting query."""

    def select(self, df: DataFrame, query: Query) -> DataFrame:
        return df.filter(self.meets(row(), query))

    def match(self, df: DataFrame, record: Mapping | Record, on: Sequence[str]) -> DataFrame:
        """Rows that overlap a record, always as rows."""
        other = literal(record) if isinstance(record, Mapping) else record
        return df.filter(self.overlaps(row(), other, on))

    @abstractmethod
    def shared(self, a: Record, b: Record, on: Sequence[str]) -> dict[str, Column]:
        """Physical columns of the intersection of two overlapping records."""

    def intersect(self, a: Record, b: Record, on: Sequence[str], take_left: Sequence[str] = (), take_right: Sequence[str] = ()) -> tuple[Column, list[Column]]:
        """(whether not empty, columns of the intersection and of what either side adds)."""
        taken = [x(c).alias(c) for x, names in ((a, take_left), (b, take_right)) for n in names for c in self.physical(n)]
        return self.overlaps(a, b, on), [v.alias(c) for c, v in self.shared(a, b, on).items()] + taken

    @abstractmethod
    def physical(self, column: str) -> list[str]:
        """Physical columns that an original column has."""

    @abstractmethod
    def values_for(self, a: Record, column: str) -> Column:
        """Array of the raw values that a record allows."""

    @abstractmethod
    def set_cardinality(self, a: Record, on: Sequence[str]) -> Column:
        """How many raw records a record stands for on ``on``."""

    @abstractmethod
    def query_overlap(self, a: Record, query: Query) -> Column:
        """How many of them meet the query."""


def _unaltered_equal(a: Record, b: Record, columns: Iterable[str]) -> Column:
    return both(a(c).eqNullSafe(b(c)) for c in columns)


def first_seen(df: DataFrame, column: str, most: int = 10_000) -> list[str]:
    """A column's values by first appearance (by value, where rows have no number)."""
    order = F.min(RID) if RID in df.columns else F.min(column)
    found = df.filter(F.col(column).isNotNull()).groupBy(column).agg(order.alias("__first")).orderBy("__first").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values; one column each would be too many")
    return [str(r[column]) for r in found]


@dataclass(frozen=True)
class MachineReadable(GeneralisedSchema):
    """Intervals as two columns, value sets as one boolean column a value."""

    one_hot: dict[str, tuple[str, ...]] = field(default_factory=dict)
    intervals: tuple[str, ...] = ()
    unaltered: tuple[str, ...] = ()

    @classmethod
    def create_for_data(cls, df, quasi_identifier, categorical=()):
        roles = column_roles(df, quasi_identifier, categorical)
        return cls({c: tuple(first_seen(df, c)) for c in roles.categorical}, roles.numeric, roles.unaltered)

    @classmethod
    def from_json_dict(cls, found):
        return cls({c: tuple(v) for c, v in found["one_hot_sets"].items()}, tuple(found["intervals"]), tuple(found["unaltered"]))

    def to_json_dict(self):
        return {"one_hot_sets": {c: list(v) for c, v in self.one_hot.items()}, "intervals": list(self.intervals), "unaltered": list(self.unaltered)}

    def physical(self, column):
        if column in self.one_hot:
            return [f"{column}_{v}" for v in self.one_hot[column]]
        return [f"{column}_min", f"{column}_max"] if column in self.intervals else [column]

    def quasi_identifier(self):
        return [p for c in (*self.intervals, *self.one_hot) for p in self.physical(c)]

    def _parts(self):
        out = {}
        for c in self.intervals:
            out[f"{c}_min"] = (F.min(c), F.min, None)
            out[f"{c}_max"] = (F.max(c), F.max, None)
        for c, values in self.one_hot.items():
            for v in values:
                out[f"{c}_{v}"] = (F.bool_or(F.coalesce(F.col(c).cast("string") == v, F.lit(False))), F.bool_or, None)
        return out

    def _output(self):
        return [F.col(f"`__{c}`").alias(c) for c in self.quasi_identifier()]

    def _flags(self, a: Record, column: str) -> list[tuple[str, Column]]:
        return [(v, a(f"{column}_{v}")) for v in self.one_hot[column]]

    def bounds(self, a, column):
        return (a(f"{column}_min"), a(f"{column}_max")) if column in self.intervals else None

    def keys(self, a, column):
        return (self.values_for(a, column),) * 2 if self.one_hot.get(column) else None

    def overlaps(self, a, b, on):
        tests = []
        for c in on:
            if c in self.one_hot:
                tests.append(F.array_contains(F.array(*[x & b(f"{c}_{v}") for v, x in self._flags(a, c)]), True) if self.one_hot[c] else F.lit(False))
            elif c in self.intervals:
                tests.append(intervals_meet(a(f"{c}_min"), a(f"{c}_max"), b(f"{c}_min"), b(f"{c}_max")))
            else:
                tests.append(a(c).eqNullSafe(b(c)))
        return both(tests)

    def meets(self, a, query):
        tests = []
        for c, r in query.items():
            if c in self.one_hot:
                flags = [x for v, x in self._flags(a, c) if v in {str(w) for w in r}]
                tests.append(F.array_contains(F.array(*flags), True) if flags else F.lit(False))
            elif c in self.intervals:
                tests.append(intervals_meet(a(f"{c}_min"), a(f"{c}_max"), F.lit(r[0]), F.lit(r[1])))
            else:
                tests.append(within(a(c), r))
        return both(tests)

    def shared(self, a, b, on):
        out = {}
        for c in on:
            if c in self.one_hot:
                out |= {f"{c}_{v}": x & b(f"{c}_{v}") for v, x in self._flags(a, c)}
            elif c in self.intervals:
                out |= {f"{c}_min": F.greatest(a(f"{c}_min"), b(f"{c}_min")), f"{c}_max": F.least(a(f"{c}_max"), b(f"{c}_max"))}
            else:
                out[c] = a(c)
        return out

    def values_for(self, a, column):
        if column in self.one_hot:
            pairs = [F.when(x, F.lit(v)) for v, x in self._flags(a, column)]
            return F.array_compact(F.array(*pairs))
        if column in self.intervals:
            return F.sequence(a(f"{column}_min").cast("bigint"), a(f"{column}_max").cast("bigint"))
        return F.array(a(column))

    def set_cardinality(self, a, on):
        sizes = []
        for c in on:
            if c in self.one_hot:
                sizes.append(sum((x.cast("bigint") for _, x in self._flags(a, c)), F.lit(0)))
            elif c in self.intervals:
                sizes.append(length(a(f"{c}_min"), a(f"{c}_max")))
        return product(sizes)

    def query_overlap(self, a, query):
        sizes = []
        for c, r in query.items():
            if c in self.one_hot:
                sizes.append(sum((x.cast("bigint") for v, x in self._flags(a, c) if v in {str(w) for w in r}), F.lit(0)))
            elif c in self.intervals:
                sizes.append(shared_length(a(f"{c}_min"), a(f"{c}_max"), *r))
            else:
                sizes.append(within(a(c), r).cast("bigint"))
        return product(sizes)


@dataclass(frozen=True)
class HumanReadable(GeneralisedSchema):
    """Intervals as "lo-hi", value sets as "a,b"; parsed where they are compared."""

    categorical: tuple[str, ...] = ()
    integer: tuple[str, ...] = ()
    unaltered: tuple[str, ...] = ()

    @classmethod
    def create_for_data(cls, df, quasi_identifier, categorical=()):
        roles = column_roles(df, quasi_identifier, categorical)
        return cls(roles.categorical, roles.numeric, roles.unaltered)

    @classmethod
    def from_json_dict(cls, found):
        return cls(*(tuple(found[k]) for k in ("categorical", "integer", "unaltered")))

    def to_json_dict(self):
        return {"categorical": list(self.categorical), "integer": list(self.integer), "unaltered": list(self.unaltered)}

    def physical(self, column):
        return [column]

    def quasi_identifier(self):
        return [*self.integer, *self.categorical]

    def _parts(self):
        out = {}
        for c in self.integer:
            out[f"{c}_min"] = (F.min(c), F.min, None)
            out[f"{c}_max"] = (F.max(c), F.max, None)
        for c in self.categorical:
            out[f"{c}_set"] = (F.collect_set(F.col(c).cast("string")), F.collect_list, None)
        return out

    def _output(self):
        intervals = [render_interval(F.col(f"`__{c}_min`"), F.col(f"`__{c}_max`")).alias(c) for c in self.integer]
        return intervals + [render_set(F.array_distinct(F.flatten(f"`__{c}_set`"))).alias(c) for c in self.categorical]

    def overlaps(self, a, b, on):
        tests = []
        for c in on:
            if c in self.integer:
                tests.append(intervals_meet(*parse_interval(a(c)), *parse_interval(b(c))))
            elif c in self.categorical:
                tests.append(F.arrays_overlap(parse_set(a(c)), parse_set(b(c))))
            else:
                tests.append(a(c).eqNullSafe(b(c)))
        return both(tests)

    def bounds(self, a, column):
        return parse_interval(a(column)) if column in self.integer else None

    def keys(self, a, column):
        return (parse_set(a(column)),) * 2 if column in self.categorical else None

    @staticmethod
    def _values(r) -> Column:
        return F.array(*[F.lit(str(v)) for v in sorted(r, key=str)]).cast("array<string>")

    def meets(self, a, query):
        tests = []
        for c, r in query.items():
            if c in self.integer:
                tests.append(intervals_meet(*parse_interval(a(c)), F.lit(r[0]), F.lit(r[1])))
            elif c in self.categorical:
                tests.append(F.arrays_overlap(parse_set(a(c)), self._values(r)))
            else:
                tests.append(within(a(c), r))
        return both(tests)

    def shared(self, a, b, on):
        out = {}
        for c in on:
            if c in self.integer:
                (la, ha), (lb, hb) = parse_interval(a(c)), parse_interval(b(c))
                out[c] = render_interval(F.greatest(la, lb), F.least(ha, hb))
            elif c in self.categorical:
                out[c] = render_set(F.array_intersect(parse_set(a(c)), parse_set(b(c))))
            else:
                out[c] = a(c)
        return out

    def values_for(self, a, column):
        if column in self.integer:
            return F.sequence(*parse_interval(a(column)))
        return parse_set(a(column)) if column in self.categorical else F.array(a(column))

    def set_cardinality(self, a, on):
        return product([length(*parse_interval(a(c))) if c in self.integer else F.size(parse_set(a(c))).cast("bigint") for c in on if c not in self.unaltered])

    def query_overlap(self, a, query):
        sizes = []
        for c, r in query.items():
            if c in self.integer:
                sizes.append(shared_length(*parse_interval(a(c)), *r))
            elif c in self.categorical:
                sizes.append(F.size(F.array_intersect(parse_set(a(c)), self._values(r))).cast("bigint"))
            else:
                sizes.append(within(a(c), r).cast("bigint"))
        return product(sizes)


@dataclass(frozen=True)
class RawData(GeneralisedSchema):
    """No generalisation: distinct rows with their counts."""

    categorical: tuple[str, ...] = ()
    integer: tuple[str, ...] = ()
    quasi: tuple[str, ...] = ()

    @classmethod
    def create_for_data(cls, df, quasi_identifier, categorical=()):
        every = [c for c in df.columns if c not in (RID, GROUP)]
        roles = column_roles(df, every, categorical)
        return cls(roles.categorical, roles.numeric, tuple(quasi_identifier))

    @classmethod
    def from_json_dict(cls, found):
        return cls(*(tuple(found[k]) for k in ("categorical", "integer", "quasi_identifier")))

    def to_json_dict(self):
        return {"categorical": list(self.categorical), "integer": list(self.integer), "quasi_identifier": list(self.quasi)}

    @property
    def unaltered(self):
        return tuple(c for c in (*self.categorical, *self.integer) if c not in self.quasi)

    def physical(self, column):
        return [column]

    def quasi_identifier(self):
        return list(self.quasi)

    def _parts(self):
        return {}

    def _output(self):
        return []

    def generalise(self, df, partition=None, group=GROUP):
        """Partitions say nothing here: the whole table is one."""
        return df.groupBy(*self.categorical, *self.integer).agg(F.count(F.lit(1)).alias(COUNT))

    def is_exact(self, column):
        return True

    def overlaps(self, a, b, on):
        return _unaltered_equal(a, b, on)

    def meets(self, a, query):
        return both(within(a(c), r) for c, r in query.items())

    def shared(self, a, b, on):
        return {c: a(c) for c in on}

    def values_for(self, a, column):
        return F.array(a(column))

    def set_cardinality(self, a, on):
        return F.lit(1).cast("bigint")

    def query_overlap(self, a, query):
        return self.meets(a, query).cast("bigint")


@dataclass(frozen=True)
class Microaggregation(GeneralisedSchema):
    """Means of numeric quasi-identifiers; records have no algebra."""

    integer: tuple[str, ...] = ()
    unaltered: tuple[str, ...] = ()

    @classmethod
    def create_for_data(cls, df, quasi_identifier, categorical=()):
        roles = column_roles(df, quasi_identifier, categorical)
        if roles.categorical:
            raise ValueError(f"means of categorical columns are not defined: {', '.join(roles.categorical)}")
        return cls(roles.numeric, roles.unaltered)

    @classmethod
    def from_json_dict(cls, found):
        return cls(tuple(found["integer"]), tuple(found["unaltered"]))

    def to_json_dict(self):
        return {"integer": list(self.integer), "unaltered": list(self.unaltered)}

    def physical(self, column):
        return [column]

    def quasi_identifier(self):
        return list(self.integer)

    def _parts(self):
        out = {}
        for c in self.integer:
            out[f"{c}_sum"] = (F.sum(F.col(c).cast("double")), F.sum, None)
            out[f"{c}_n"] = (F.count(c), F.sum, None)
        return out

    def _output(self):
        return [F.try_divide(F.col(f"`__{c}_sum`"), F.col(f"`__{c}_n`")).alias(c) for c in self.integer]

    def _none(self, *_):
        raise NotImplementedError("means do not tell which records a class holds")

    overlaps = meets = shared = values_for = set_cardinality = query_overlap = _none
