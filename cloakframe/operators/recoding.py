"""Global recoding along value taxonomies.

Every node has a path from the root; the lowest common ancestor of any number of
values is the common prefix of the smallest and the largest path, so a class
needs a minimum and a maximum only.  Afterwards values are lifted to the highest
node present on their path, which makes the recoding the same for all classes.
Raw values are nodes of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakframe.functions.sets import intervals_meet
from cloakframe.operators.schemas import COUNT, GeneralisedSchema
from cloakframe.plans.roles import GROUP, RID, both, product, within

#: Characters up to which a taxonomy's table is broadcast.
MOST_SENT = 1 << 25


class Taxonomy:
    """A tree of generalised values with raw values as its leaves."""

    def __init__(self, value: str) -> None:
        self.value, self.parent = value, None
        self.children: list[Taxonomy] = []
        self.raw: list = []

    def add_generalised(self, child: Taxonomy) -> Taxonomy:
        if self.raw:
            raise ValueError(f"{self.value} has raw values already")
        child.parent = self
        self.children.append(child)
        return self

    def add_raw_values(self, values: Iterable) -> Taxonomy:
        if self.children:
            raise ValueError(f"{self.value} has generalised values already")
        self.raw += list(values)
        return self

    @property
    def level(self) -> int:
        return 0 if self.parent is None else self.parent.level + 1

    def nodes(self) -> Iterable[Taxonomy]:
        yield self
        for child in self.children:
            yield from child.nodes()

    def raw_values(self) -> list:
        return [v for node in self.nodes() for v in node.raw]

    def cardinality(self, restriction: Iterable | None = None) -> int:
        wanted = None if restriction is None else {str(v) for v in restriction}
        return sum(wanted is None or str(v) in wanted for v in self.raw_values())

    def find_value(self, value) -> Taxonomy | None:
        return next((n for n in self.nodes() if n.value == value or value in n.raw), None)

    def paths(self) -> dict[str, tuple[str, ...]]:
        """Path of every node and raw value, as text."""
        out: dict[str, tuple[str, ...]] = {}

        def walk(node: Taxonomy, above: tuple[str, ...]) -> None:
            out[str(node.value)] = here = (*above, str(node.value))
            for v in node.raw:
                out[str(v)] = (*here, str(v))
            for child in node.children:
                walk(child, here)

        walk(self, ())
        return out

    def places(self) -> dict[str, tuple[int, int]]:
        """First and last number of every node and raw value in a walk from the root down."""
        out: dict[str, tuple[int, int]] = {}
        at = 0

        def walk(node: Taxonomy) -> None:
            nonlocal at
            first, at = at, at + 1
            for v in node.raw:
                out[str(v)] = (at, at)
                at += 1
            for child in node.children:
                walk(child)
            out[str(node.value)] = (first, at - 1)

        walk(self)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(value, path) of every node and raw value."""
        return spark.createDataFrame([(v, list(p)) for v, p in self.paths().items()], "value string, path array<string>")

    def text_size(self) -> int:
        """Characters of the table's values and paths."""
        return sum(len(v) + sum(map(len, p)) for v, p in self.paths().items())

    def leaves(self) -> dict[str, list[str]]:
        """Raw values below every node, and below each raw value itself."""
        out = {str(n.value): [str(v) for v in n.raw_values()] for n in self.nodes()}
        return out | {str(v): [str(v)] for v in self.raw_values()}


@dataclass(frozen=True)
class TaxonomyTable:
    """A taxonomy too large for the driver: a table (value string, path array<string>) of its nodes and raw values.

    Paths begin at the root and end with the value.  It serves ``generalise``;
    record functions hold a taxonomy in the plan, and so need a ``Taxonomy``.
    """

    nodes_with_paths: DataFrame

    def table(self, spark: SparkSession) -> DataFrame:
        return self.nodes_with_paths.select("value", "path")

    def text_size(self) -> int:
        return MOST_SENT + 1

    def leaves(self) -> dict[str, list[str]]:
        raise ValueError("record functions need a Taxonomy, not a table")

    def places(self) -> dict[str, tuple[int, int]]:
        raise ValueError("record functions need a Taxonomy, not a table")


def _lookup(values: Mapping[str, Column], at: Column) -> Column:
    flat = [x for k, v in values.items() for x in (F.lit(k), v)]
    return F.try_element_at(F.create_map(*flat), at.cast("string"))


def _strings(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def common_prefix(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.slice(a, F.lit(1), F.when(first == 0, F.size(a)).otherwise(first - 1).cast("int"))


@dataclass(frozen=True)
class GlobalRecoding(GeneralisedSchema):
    taxonomies: dict[str, Taxonomy | TaxonomyTable] = field(default_factory=dict)
    unaltered: tuple[str, ...] = ()

    @classmethod
    def create_for_data(cls, df, quasi_identifier, categorical=(), taxonomies: Mapping[str, Taxonomy] | None = None):
        if taxonomies is None or any(c not in taxonomies for c in quasi_identifier):
            raise ValueError("every quasi-identifier needs a taxonomy")
        return cls({c: taxonomies[c] for c in quasi_identifier}, tuple(c for c in df.columns if c not in (RID, GROUP, *quasi_identifier)))

    @classmethod
    def from_json_dict(cls, found):
        out = {}
        for column, tree in found["taxonomy"].items():
            generalised, definitions = set(tree["generalised"]), tree["definitions"]
            below = {c for kids in definitions.values() for c in kids if c in generalised}
            root = next(n for n in tree["generalised"] if n not in below)

            def build(name, generalised=generalised, definitions=definitions):
                node = Taxonomy(name)
                kids = definitions.get(name, [])
                if kids and all(k in generalised for k in kids):
                    for k in kids:
                        node.add_generalised(build(k))
                elif kids:
                    node.add_raw_values(kids)
                return node

            out[column] = build(root)
        return cls(out, tuple(found["unaltered"]))

    def to_json_dict(self):
        trees = {}
        for column, root in self.taxonomies.items():
            if isinstance(root, TaxonomyTable):
                raise ValueError(f"{column}: a taxonomy's table is not part of a schema file")
            nodes = list(root.nodes())
            trees[column] = {"generalised": [n.value for n in nodes], "definitions": {n.value: [c.value for c in n.children] or sorted(n.raw, key=str) for n in nodes}}
        return {"taxonomy": trees, "unaltered": list(self.unaltered)}

    def physical(self, column):
        return [column]

    def quasi_identifier(self):
        return list(self.taxonomies)

    def _leaves(self, column: str, value: Column) -> Column:
        return _lookup({v: _strings(x) for v, x in self.taxonomies[column].leaves().items()}, value)

    def _card(self, column: str, value: Column, restriction=None) -> Column:
        wanted = None if restriction is None else {str(v) for v in self._values(restriction)}
        return _lookup({v: F.lit(len(x) if wanted is None else sum(y in wanted for y in x)) for v, x in self.taxonomies[column].leaves().items()}, value).cast("bigint")

    @staticmethod
    def _values(restriction) -> Iterable:
        return range(restriction[0], restriction[1] + 1) if isinstance(restriction, tuple) else restriction

    def _parts(self):
        return {}

    def _output(self):
        return []

    def generalise(self, df: DataFrame, partition: DataFrame | None = None, group: str = GROUP) -> DataFrame:
        if partition is not None:
            df = df.join(partition.select(RID, group), RID)
        columns = list(self.taxonomies)
        small = {c: t.text_size() <= MOST_SENT for c, t in self.taxonomies.items()}
        hint = lambda df, c: F.broadcast(df) if small[c] else df
        paths = df.select(group, *self.unaltered, *[F.col(c).cast("string").alias(f"__{c}") for c in columns])
        for c in columns:
            nodes = self.taxonomies[c].table(df.sparkSession).select(F.col("value").alias("__value"), F.col("path").alias("__path"))
            paths = paths.join(hint(nodes, c), F.col(f"__{c}") == F.col("__value"), "left").drop("__value", f"__{c}").withColumnRenamed("__path", f"__{c}")
        by = paths.groupBy(group, *self.unaltered).agg(F.count(F.lit(1)).alias(COUNT), *[f(f"__{c}").alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
        whole = Window.partitionBy(group)
        lowest = by.select(*self.unaltered, COUNT, *[common_prefix(F.min(f"__lo_{c}").over(whole), F.max(f"__hi_{c}").over(whole)).alias(f"__{c}") for c in columns])
        lifted = lowest
        for c in columns:
            # a row for each node in use: the highest node in use on its path
            used = lowest.select(F.col(f"__{c}").alias("__node")).filter(F.col("__node").isNotNull()).distinct()
            above = used.select("__node", F.explode(F.transform(F.sequence(F.lit(1), F.size("__node")), lambda n: F.slice("__node", F.lit(1), n))).alias("__above"))
            tops = above.join(used.select(F.col("__node").alias("__above")), "__above").groupBy("__node").agg(F.min(F.struct(F.size("__above").alias("n"), F.element_at("__above", -1).alias("v")))["v"].alias(f"__top_{c}"))
            lifted = lifted.join(hint(tops, c), F.col(f"__{c}") == F.col("__node"), "left").drop("__node")
        return lifted.select(*[F.col(f"__top_{c}").alias(c) for c in columns], *self.unaltered, COUNT)

    def _place(self, column: str, value: Column) -> tuple[Column, Column]:
        """A node's first and last place in a walk over the tree; those of nodes below lie within."""
        places = self.taxonomies[column].places()
        return tuple(_lookup({v: F.lit(p[i]) for v, p in places.items()}, value) for i in (0, 1))

    def bounds(self, a, column):
        return self._place(column, a(column)) if column in self.taxonomies else None

    def overlaps(self, a, b, on):
        """One lies on the other's path where their places meet: places are within each other or apart."""
        meet = lambda c: F.coalesce(intervals_meet(*self._place(c, a(c)), *self._place(c, b(c))), F.lit(False))
        return both(meet(c) if c in self.taxonomies else a(c).eqNullSafe(b(c)) for c in on)

    def meets(self, a, query):
        return both(F.coalesce(self._card(c, a(c), r) > 0, F.lit(False)) if c in self.taxonomies else within(a(c), r) for c, r in query.items())

    def shared(self, a, b, on):
        deeper = lambda c: F.when(self._place(c, a(c))[0] >= self._place(c, b(c))[0], a(c)).otherwise(b(c))
        return {c: deeper(c) if c in self.taxonomies else a(c) for c in on}

    def values_for(self, a, column):
        return self._leaves(column, a(column)) if column in self.taxonomies else F.array(a(column))

    def set_cardinality(self, a, on: Sequence[str]):
        return product(self._card(c, a(c)) for c in on if c in self.taxonomies)

    def query_overlap(self, a, query):
        return product(self._card(c, a(c), r) if c in self.taxonomies else within(a(c), r).cast("bigint") for c, r in query.items())
