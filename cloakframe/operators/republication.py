"""m-invariant republication (Xiao and Tao, 2007).

A row that stays keeps the signature of its class: the set of its sensitive
values.  Rows of one signature form a bucket; where a value has fewer rows than
the others, new rows with it fill the gap, and counterfeits what is then left.
New rows that remain form buckets of at least m values of their own.  The j-th
row of every value of a bucket, in the order of the quasi-identifiers, makes up
the bucket's j-th class.

Only the counts of sensitive values are worked on by the driver; rows are placed
by ranks within values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.plans.cut import cut
from cloakframe.plans.roles import GROUP, rank_within


def buckets_for(counts: dict[str, int], domain: Sequence[str], m: int) -> list[tuple[list[tuple[str, int]], int]]:
    """Buckets for new rows: ([(value, real rows)], rows of each value).

    Takes the most frequent values, as many rows as leave the rest eligible (no
    value above 1/m).  Where that is impossible from the start, the rarest other
    values are filled up with counterfeits.
    """
    left = {v: n for v, n in counts.items() if n}
    out = []
    while left:
        total, most = sum(left.values()), max(left.values())
        ordered = sorted(left, key=lambda v: (-left[v], v))
        if most * m > total or len(left) < m:
            extra = [v for v in sorted(domain, key=lambda v: (counts.get(v, 0), v)) if v not in left]
            values = (ordered + extra)[: max(m, len(ordered))] if len(ordered) < m else ordered
            if len(values) < m:
                raise ValueError(f"fewer than {m} sensitive values")
            rows = most
            out.append(([(v, left.get(v, 0)) for v in values], rows))
            return out
        for size in range(m, len(ordered) + 1):
            rows = left[ordered[size - 1]]
            if size < len(ordered):
                # what is left stays eligible: no value has more than 1/m of total - size * rows
                rows = min(rows, (total - left[ordered[size]] * m) // size)
                if size > m:
                    rows = min(rows, (total - most * m) // (size - m))
            elif (most - rows) * m > total - size * rows:
                rows = 0
            if rows > 0:
                break
        else:
            size, rows = len(ordered), most
        values = ordered[:size]
        out.append(([(v, min(rows, left[v])) for v in values], rows))
        for v in values:
            left[v] -= min(rows, left[v])
            if not left[v]:
                del left[v]
    return out


@dataclass(frozen=True)
class MInvariance:
    m: int
    quasi_identifier: tuple[str, ...]
    sensitive: str
    key: str = "ID"

    def partition(self, df: DataFrame, last: DataFrame | None = None, last_partition: DataFrame | None = None, last_counterfeits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """((key, group_id), (group_id, sensitive value, n) of counterfeits).

        ``last`` is the table of the last release, ``last_partition`` its
        (key, group_id), ``last_counterfeits`` its counterfeits.
        """
        spark = df.sparkSession
        rows = cut(df.select(F.col(self.key).alias("id"), F.col(self.sensitive).cast("string").alias("s"), F.struct(*self.quasi_identifier, self.key).alias("q")))
        if last is None:
            old = spark.createDataFrame([], "sig string, id bigint, s string, q struct<id:bigint>").select("sig", "id", "s")
        else:
            before = last.join(last_partition, self.key).select(F.col(self.key).alias("id"), F.col(self.sensitive).cast("string").alias("s"), GROUP)
            held = before.select(GROUP, "s")
            if last_counterfeits is not None:
                held = held.unionByName(last_counterfeits.select(GROUP, F.col(self.sensitive).cast("string").alias("s")))
            signature = held.groupBy(GROUP).agg(F.to_json(F.array_sort(F.collect_set("s"))).alias("sig"))
            old = before.join(signature, GROUP).select("sig", "id", "s")
        stay = cut(rows.join(old, ["id", "s"]).select("sig", "id", "s", "q"))
        new = rows.join(stay.select("id"), "id", "left_anti")

        values = F.from_json("sig", "array<string>")
        need = stay.groupBy("sig", "s").count().groupBy("sig").agg(F.max("count").alias("rows")).withColumn("s", F.explode(values))
        have = stay.groupBy("sig", "s").agg(F.count(F.lit(1)).alias("n"))
        gaps = cut(need.join(have, ["sig", "s"], "left").select("sig", "s", "rows", F.coalesce("n", F.lit(0)).alias("n")))
        # every row that is wanted is a place of its own: places and new rows meet by value and rank
        wanted = gaps.withColumn("gap", F.col("rows") - F.col("n")).filter("gap > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), "gap")))
        places = rank_within(wanted.select("sig", "s", "i"), ["s"], ["sig", "i"], "r")
        ranked = cut(rank_within(new, ["s"], ["q"], "r"))
        filled = cut(ranked.join(places.select("sig", "s", "r"), ["s", "r"]).select("sig", "id", "s", "q"))

        rest = cut(rank_within(ranked.join(filled.select("id"), "id", "left_anti").drop("r"), ["s"], ["q"], "r").select("id", "s", "q", "r"))
        counts = {r["s"]: r["count"] for r in rest.groupBy("s").count().collect()}
        known = [r["s"] for r in rows.select("s").union(old.select("s")).distinct().collect()]
        plan, used = [], dict.fromkeys(counts, 0)
        made = buckets_for(counts, known, self.m)
        for n, (parts, size) in enumerate(made):
            for v, real in parts:
                plan.append((f"new{n}", v, used.get(v, 0), used.get(v, 0) + real, size))
                used[v] = used.get(v, 0) + real
        table = spark.createDataFrame(plan, "sig string, s string, `from` bigint, `to` bigint, rows bigint")
        # a few buckets: each row takes the one whose ranks of its value hold it
        c, d = rest.alias("c"), F.broadcast(table).alias("d")
        placed = c.join(d, (F.col("c.s") == F.col("d.s")) & (F.col("c.r") >= F.col("d.from")) & (F.col("c.r") < F.col("d.to"))).select("d.sig", "c.id", "c.s", "c.q")

        together = stay.unionByName(filled).unionByName(placed).select("sig", "id", "s", "q")
        every = cut(rank_within(together, ["sig", "s"], ["q"], "j").select("sig", "id", "s", "j"))
        group = F.concat_ws("#", "sig", F.col("j").cast("string"))
        sizes = gaps.select("sig", "s", "rows").unionByName(table.select("sig", "s", "rows"))
        slots = sizes.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)))
        missing = slots.join(every.select("sig", "s", F.col("j").cast("bigint").alias("j")), ["sig", "s", "j"], "left_anti")
        counterfeits = missing.groupBy(group.alias(GROUP), F.col("s").alias(self.sensitive)).agg(F.count(F.lit(1)).alias("n"))
        return every.select(F.col("id").alias(self.key), group.alias(GROUP)), counterfeits
