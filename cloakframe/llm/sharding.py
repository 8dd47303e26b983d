"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard levels.  At each node every child draws
-ln(u) / weight with u decided by key and child; the smallest draw wins, so a
child gets keys in proportion to its weight, and when a child's weight grows,
keys move into that child only.  Movement stays inside subtrees whose weights
change.

Defined results: a null id is a key of its own; repeated ids share a shard; a
null text has size 1; slots number the rows of a shard from 0 without gaps, also
when whole rows repeat; an empty table gives an empty table.  Only the id and
text columns are read.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import unit

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]

EIGHT: Tree = {
    "r0": {"r0k0": {0: 1.0, 1: 1.0}, "r0k1": {2: 1.0, 3: 1.0}},
    "r1": {"r1k0": {4: 1.0, 5: 1.0}, "r1k1": {6: 1.0, 7: 1.0}},
}
#: The ninth shard stands in a region of its own: no older subtree's weight
#: changes, so rows move into the new shard only.
NINE: Tree = EIGHT | {"r2": {"r2k0": {8: 1.0}}}

BUCKETS = 4096
CHUNK = 10_000


def weight(node: dict | float) -> float:
    return float(node) if not isinstance(node, dict) else sum(map(weight, node.values()))


def place(key: Column, tree: dict, prefix: str = "") -> Column:
    """The shard (leaf) that ``key`` reaches."""
    children = [(str(name), child, weight(child)) for name, child in tree.items() if weight(child) > 0]
    leaf = lambda name, child: place(key, child, f"{prefix}/{name}") if isinstance(child, dict) else F.lit(int(name))
    if len(children) == 1:
        return leaf(*children[0][:2])
    draws = [F.struct((-F.ln(unit(key, f"{prefix}/{name}")) / w).alias("draw"), F.lit(n).alias("child")) for n, (name, _, w) in enumerate(children)]
    won = F.array_min(F.array(*draws))["child"]
    return F.element_at(F.transform(F.array(won), lambda c: _choose(c, [leaf(n, x) for n, x, _ in children])), 1)


def _choose(which: Column, options: list[Column]) -> Column:
    out = F.when(which == 0, options[0])
    for n, option in enumerate(options[1:], 1):
        out = out.when(which == n, option)
    return out


def number_rows(df: DataFrame, group: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Add ``slot``: a gapless number from 0 within each ``group``.

    Equal rows are counted before the shuffle.  Each group is cut into hash
    buckets, the buckets' totals give where each begins, and only the rows of
    one bucket are ordered together.  ``df`` has no columns but group and keys.
    """
    from pyspark.sql import Window

    counted = df.groupBy(group, *keys).agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    totals = counted.groupBy(group, "__b").agg(F.sum("__n").alias("__total"))
    before = F.coalesce(F.sum("__total").over(Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(F.col(group).alias("__g"), F.col("__b").alias("__c"), before.alias("__start"))
    within = F.coalesce(F.sum("__n").over(Window.partitionBy(group, "__b").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("__within", within).join(starts, (F.col(group) == F.col("__g")) & (F.col("__b") == F.col("__c")))
    first = F.col("__start") + F.col("__within")
    chunked = placed.withColumn("__first", first).withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(CHUNK).cast("long"))))
    last = F.least(F.col("__n"), F.col("__at") + CHUNK) - 1
    return chunked.withColumn("__i", F.explode(F.sequence(F.col("__at"), last))).select(group, *keys, (F.col("__first") + F.col("__i")).alias("slot"))


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree: Tree = EIGHT, grown: Tree | None = None) -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard): one row per input row."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        place(key, tree).alias("shard"),
        (place(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return number_rows(rows, "shard", ["id", "size", "text_crc32", "grown_shard"])
