"""Trajectory attack: which records a target may have had in each of several releases.

Targets with the same knowledge and the same releases to be in are one class.
What a class may have come to after some releases is a layered graph: a node is
what is known then (the intersection of all that was met, and all columns
learnt), an arc a record that leads from one node to the next.  Paths that come
to know the same share a node, so the graph grows with its arcs, not with its
paths; numbers of paths and of their permutations are sums over arcs.

``finalise`` keeps what occurs in some exact cover, where every record is used
as often as its count says; that takes the targets for the whole population.
Each release by itself is a matching of classes and records, which settles it
for one release and prunes the graph for several, over and over until nothing
more goes; only classes that then still have a choice are searched path by path.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.operators.attackers import KEY, BaseAttacker, split_columns
from cloakframe.operators.cover import cover_rows
from cloakframe.operators.overlap import overlap_join
from cloakframe.operators.schemas import COUNT, GeneralisedSchema
from cloakframe.plans.cut import cut
from cloakframe.plans.roles import number_rows, of

MANY = "decimal(38,0)"
ARC = ("__class", "__seen", "__from", "__col", "__to")


def _same(a: str, b: str, columns: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`")) for c in columns], F.lit(True))


class TrajectoryAttacker(BaseAttacker):
    """Nodes, arcs and classes are tables; the session holds their names only.

    ``seen`` is the releases a class was in so far, one sign each.
    """

    def __init__(self, knowledge: DataFrame, present_columns: Sequence[str], schema: GeneralisedSchema) -> None:
        self.schema, self.known = schema, [list(present_columns)]
        self.spark = knowledge.sparkSession
        physical = self._physical(present_columns)
        quoted = [f"`{c}`" for c in physical]
        start = cut(knowledge.select(*quoted).distinct().withColumn("region", F.monotonically_increasing_id()))
        held = knowledge.alias("a").join(start.alias("b"), _same("a", "b", physical)).groupBy(F.col(f"a.{KEY}").alias(KEY), "b.region").agg(F.count(F.lit(1)).alias("times"))
        sets = held.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("region", "times"))).alias("held"))
        sets = cut(sets)
        classes = cut(sets.select("held").distinct().withColumn("__class", F.monotonically_increasing_id()))
        self.members = cut(sets.join(classes, "held").select(KEY, "__class", F.lit("").alias("__seen")))
        each = classes.select("__class", F.explode("held").alias("x"))
        times = F.col("x.times").cast(MANY)
        first = each.join(start, F.col("x.region") == F.col("region")).select("__class", F.lit("").alias("__seen"), F.lit(0).alias("__knows"), *quoted, times.alias("__paths"), times.alias("__ways"))
        self.nodes = cut(first.withColumn("__node", F.monotonically_increasing_id()))
        self.first = self.nodes.select("__node", "__paths")
        self.layers: list[tuple[DataFrame, DataFrame]] = []  # arcs, and the counts of their records
        self.next, self.absent = 0, []  # column ids: the next one, and those of being absent

    def _physical(self, columns: Sequence[str]) -> list[str]:
        return [p for c in columns for p in self.schema.physical(c)]

    def _knows(self, columns: Sequence[str]) -> int:
        found = next((i for i, k in enumerate(self.known) if set(k) == set(columns)), None)
        if found is None:
            self.known.append(list(columns))
            found = len(self.known) - 1
        return found

    def observe(self, release, present_columns=(), present_targets=()):
        ids, released = self._ids(self.members, present_targets), list(present_columns)
        here = ids.withColumn("here", F.lit(True))
        sign = F.when(F.coalesce("here", F.lit(False)), "1").otherwise("0")
        self.members = cut(self.members.join(here, KEY, "left").select(KEY, "__class", F.concat("__seen", sign).alias("__seen")))
        sizes = cut(self.members.groupBy("__class", "__seen").agg(F.count(F.lit(1)).alias("n")))
        absent = sizes.filter("__seen like '%0'").agg(F.sum("n")).first()[0] or 0
        indexed = cut(number_rows(release, name="__no", first=self.next + 1))
        records = indexed.select(F.col("__no").alias("__col"), F.col(COUNT).cast("bigint").alias("mult"))
        self.absent.append(self.next)
        if absent:
            records = records.union(self.spark.createDataFrame([(self.next, absent)], "col_id bigint, mult bigint"))
        before = self.nodes.alias("n").join(sizes.select(F.col("__class").alias("__c"), F.col("__seen").alias("__s")), (F.col("__class") == F.col("__c")) & (F.col("__seen") == F.expr("left(__s, length(__s) - 1)")))
        before = cut(before.withColumn("__seen", F.col("__s")).drop("__c", "__s"))
        stay = before.filter("__seen like '%0'").withColumns({"__from": F.col("__node"), "__col": F.lit(self.next).cast("bigint")}).drop("__node")
        arcs = [stay] if absent else []
        for knows in [r[0] for r in before.filter("__seen like '%1'").select("__knows").distinct().collect()]:
            left, both, right = split_columns(self.known[knows], released)
            mine = self._physical(self.known[knows])
            now = before.filter(F.col("__seen").like("%1") & (F.col("__knows") == knows)).select("__class", "__seen", "__node", "__paths", "__ways", *[f"`{c}`" for c in mine])
            k, r = (lambda c: F.col("k")[c]), (lambda c: F.col("r")[c])
            _, columns = self.schema.intersect(k, r, both, left, right)
            kept = [k(c).alias(c) for c in ("__class", "__seen", "__paths")]
            ways = (k("__ways") * r(COUNT)).cast(MANY).alias("__ways")
            pairs = overlap_join(now, indexed, self.schema, both)
            arcs.append(pairs.select(*kept, ways, F.lit(self._knows([*left, *both, *right])).alias("__knows"), k("__node").alias("__from"), r("__no").alias("__col"), *columns))
        self.next = (indexed.agg(F.max("__no")).first()[0] or self.next) + 1
        if not arcs:  # nobody is known to be anywhere: nothing is left of any class
            arcs = [stay.limit(0)]
        met = cut(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), arcs))
        state = [c for c in met.columns if c not in ("__from", "__col", "__paths", "__ways")]
        total = lambda c: F.sum(c).cast(MANY).alias(c)
        self.nodes = cut(met.groupBy(*[f"`{c}`" for c in state]).agg(total("__paths"), total("__ways")).withColumn("__node", F.monotonically_increasing_id()))
        to = met.alias("m").join(self.nodes.alias("n"), _same("m", "n", state))
        self.layers.append((to.select("m.__class", "m.__seen", "m.__from", "m.__col", F.col("n.__node").alias("__to")), records))

    def predict_all(self, column):
        knowing = [i for i, k in enumerate(self.known) if column in k]
        if not knowing or any(c not in self.nodes.columns for c in self.schema.physical(column)):
            return self.members.select(KEY, F.lit(None).cast("string").alias("value"), F.lit(1.0).alias("weight")).limit(0)
        values = F.explode(self.schema.values_for(of("k"), column)).alias("value")
        found = self.nodes.filter(F.col("__knows").isin(knowing)).alias("k").select("k.__class", "k.__seen", values).distinct()
        return found.join(self.members, ["__class", "__seen"]).select(KEY, "value", F.lit(1.0).alias("weight"))

    def trajectories(self) -> DataFrame:
        """(ID, paths, ways): in how many ways a target may have gone, records counted once, and as often as they occur."""
        total = lambda c: F.sum(c).cast(MANY).alias(c)
        return self.nodes.groupBy("__class", "__seen").agg(total("__paths"), total("__ways")).join(self.members, ["__class", "__seen"]).select(KEY, F.col("__paths").alias("paths"), F.col("__ways").alias("ways"))

    # -- exact cover ----------------------------------------------------------
    def graph(self) -> list[DataFrame]:
        """Arcs (class, seen, from, col_id, to) of each release, on some path to the end; ``seen`` as of now."""
        live, out = self.nodes.select("__node", "__class", "__seen"), []
        for arcs, _ in reversed(self.layers):
            joined = arcs.alias("a").join(live.alias("l"), (F.col("__to") == F.col("__node")) & (F.col("a.__class") == F.col("l.__class")) & F.col("l.__seen").startswith(F.col("a.__seen")))
            out.append(cut(joined.select("a.__class", "l.__seen", "__from", "__col", "__to")))
            live = out[-1].select(F.col("__from").alias("__node"), "__class", "__seen").distinct()
        return out[::-1]

    @staticmethod
    def _pruned(graph: list[DataFrame]) -> list[DataFrame]:
        """Arcs that are on a whole path."""
        graph = list(graph)
        for t in range(1, len(graph)):
            ends = graph[t - 1].select("__class", "__seen", F.col("__to").alias("__from")).distinct()
            graph[t] = cut(graph[t].join(ends, ["__class", "__seen", "__from"], "left_semi").select(*ARC))
        for t in range(len(graph) - 2, -1, -1):
            begins = graph[t + 1].select("__class", "__seen", F.col("__from").alias("__to")).distinct()
            graph[t] = cut(graph[t].join(begins, ["__class", "__seen", "__to"], "left_semi").select(*ARC))
        return graph

    def _counted(self, graph: list[DataFrame]) -> DataFrame:
        """(class, seen, node, paths, ways) at the end."""
        at = self.first.select("__node", F.col("__paths"), F.col("__paths").alias("__ways"))
        keys = ["__from"]
        for arcs, (_, records) in zip(graph, self.layers, strict=True):
            met = arcs.join(at.withColumnRenamed("__node", "__from"), keys).join(records, "__col")
            total = lambda c: F.sum(c).cast(MANY)
            # an absent target stands at one place, however many are absent
            times = F.when(F.col("__col").isin(self.absent), F.lit(1)).otherwise(F.col("mult"))
            at = cut(met.groupBy("__class", "__seen", F.col("__to").alias("__node")).agg(total("__paths").alias("__paths"), total((F.col("__ways") * times).cast(MANY)).alias("__ways")))
            keys = ["__class", "__seen", "__from"]
        return at

    def finalise(self, budget: int = 2_000_000) -> None:
        if not self.layers:
            return
        groups = cut(number_rows(self.members.groupBy("__class", "__seen").agg(F.count(F.lit(1)).alias("n")), "__class", "__seen", name="g"))
        every, graph = len(self.layers), self.graph()
        records = reduce(DataFrame.union, [r for _, r in self.layers])
        own = lambda g, t: -(F.col(g) * every + t + 1)  # noqa: E731  a class's column in a release
        target = cut(records.union(reduce(DataFrame.union, [groups.select(own("g", t), "n") for t in range(every)])).toDF("col_id", "mult"))

        def edges_of(graph: list[DataFrame]) -> DataFrame:
            met = [arcs.select("__class", "__seen", "__col").distinct().join(groups, ["__class", "__seen"]) for arcs in graph]
            found = [m.select(F.lit(t).alias("t"), "__class", "__seen", "__col", own("g", t).alias("own"), "n") for t, m in enumerate(met)]
            return cut(reduce(DataFrame.union, found).withColumn("row_id", F.monotonically_increasing_id()))

        edges = edges_of(graph)
        while True:
            rows = edges.select("row_id", F.col("__col").alias("col_id"), F.col("n").alias("copies")).union(edges.select("row_id", "own", "n"))
            live = cut(edges.join(cover_rows(rows, target, budget), "row_id", "left_semi"))
            left = live.count()
            if left == edges.count():
                break
            graph = [cut(arcs.join(live.filter(F.col("t") == t), ["__class", "__seen", "__col"], "left_semi").select(*ARC)) for t, arcs in enumerate(graph)]
            if every == 1:
                break
            graph = self._pruned(graph)
            edges = edges_of(graph)
            if edges.count() == left:  # every edge that is left is in some matching still
                break
        if every > 1:
            graph = self._searched(graph, groups, records, budget)
        ends = self._counted(graph)
        rest = [c for c in self.nodes.columns if c not in ("__paths", "__ways")]
        self.nodes = cut(self.nodes.select(*[f"`{c}`" for c in rest]).join(ends, ["__class", "__seen", "__node"]))
        self.layers = [(arcs, r) for arcs, (_, r) in zip(graph, self.layers, strict=True)]

    def _searched(self, graph: list[DataFrame], groups: DataFrame, records: DataFrame, budget: int) -> list[DataFrame]:
        """What is left of classes with more than one path, searched path by path; the others' records are taken off."""
        ends = self._counted(graph)
        open_ = cut(ends.groupBy("__class", "__seen").agg(F.sum("__paths").alias("__paths"), F.count(F.lit(1)).alias("ends")).filter("__paths > 1").join(groups, ["__class", "__seen"]).select("__class", "__seen", "g", "n"))
        if open_.isEmpty():
            return graph
        paths = None
        for t, arcs in enumerate(graph):
            mine = arcs.join(open_.select("__class", "__seen"), ["__class", "__seen"], "left_semi")
            step = F.array(F.struct(F.lit(t).alias("t"), "__from", "__col", "__to"))
            if paths is None:
                paths = mine.select("__class", "__seen", step.alias("path"), F.col("__to").alias("at"))
            else:
                paths = paths.join(mine, ["__class", "__seen"]).filter(F.col("at") == F.col("__from")).select("__class", "__seen", F.concat("path", step).alias("path"), F.col("__to").alias("at"))
        paths = cut(paths.join(open_, ["__class", "__seen"]).withColumn("row_id", F.monotonically_increasing_id()))
        fixed = reduce(DataFrame.union, [arcs.join(groups, ["__class", "__seen"]).join(open_.select("__class", "__seen"), ["__class", "__seen"], "left_anti").select("__col", "n") for arcs in graph])
        taken = fixed.groupBy("__col").agg(F.sum("n").alias("taken"))
        left = records.join(taken, "__col", "left").select("__col", (F.col("mult") - F.coalesce("taken", F.lit(0))).alias("mult")).filter("mult > 0")
        target = left.union(open_.select(-F.col("g") - 1, "n")).toDF("col_id", "mult")
        rows = paths.select("row_id", F.explode("path.__col").alias("col_id"), F.col("n").alias("copies")).union(paths.select("row_id", -F.col("g") - 1, "n"))
        live = cut(paths.join(cover_rows(rows, target, budget), "row_id", "left_semi").select("__class", "__seen", F.explode("path").alias("x")).select("__class", "__seen", "x.*").distinct())
        kept = []
        none = live.isEmpty()
        for t, arcs in enumerate(graph):
            settled = arcs.join(open_.select("__class", "__seen"), ["__class", "__seen"], "left_anti").select(*ARC)
            kept.append(cut(settled.limit(0) if none else settled.union(live.filter(F.col("t") == t).select(*ARC))))
        return kept
