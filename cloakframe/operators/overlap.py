"""Pairs of records that overlap, without comparing all with all.

Records are reduced to distinct regions first.  Two intervals meet either where
the first holds the other's beginning or where the second holds the first's,
never both ways.  For each way one side is cut into dyadic cells, at most two a
level, which are apart from each other; the other side's beginning lies in one
cell of each level.  So two regions come together in one cell at most, and only
if their intervals meet: there are no other candidates, however wide some
regions are.  No cell is larger than the widest interval, and no level above that
is looked at.  Cells are numbered by places, either whole numbers (where no
interval is very wide) or the ranks of all ends, so it doesn't matter how values
are spread.

Sets and taxonomies meet in a value they share.  Columns that must be equal are
part of every key.  Cells in which very many pairs come together are parted into
tiles by hashes of both sides, so no task gets more than ``MOST_PAIRS`` of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.operators.schemas import GeneralisedSchema
from cloakframe.plans.cut import cut
from cloakframe.plans.roles import Record, number_rows

MOST_PAIRS = 20_000_000
MOST_PLACES = 1 << 20  # ends of intervals are ranked where one is wider
FARTHEST = 1 << 60  # and where whole numbers lie further apart
FEW_PAIRS = 8  # candidates a region, up to which no other column is looked at
MOST_TILED = 100_000  # tiled cells that are broadcast; more are joined
WHOLE = ("tinyint", "smallint", "int", "bigint")


def regions(df: DataFrame, physical: Sequence[str], name: str) -> DataFrame:
    """(name struct, name_hash, name_id): the distinct values of columns, numbered."""
    quoted = [f"`{c}`" for c in physical]
    found = df.select(*quoted).distinct().select(F.struct(*quoted).alias(name), F.xxhash64(*quoted).alias(f"{name}_hash"))
    return cut(found.withColumn(f"{name}_id", F.monotonically_increasing_id()))


def _field(name: str) -> Record:
    return lambda c: F.col(name)[c]


def _tiles(sides: tuple[DataFrame, DataFrame], keys: list[str], sizes: tuple[int, int]) -> DataFrame:
    """The join of both sides (with k_id or g_id) on ``keys``, very large keys in tiles."""
    a, b = sides
    if sizes[0] * sizes[1] <= MOST_PAIRS:
        return a.join(b, keys)
    counts = [s.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for s, n in ((a, "__na"), (b, "__nb"))]
    parts = lambda n: F.ceil(F.col(n) / int(sqrt(MOST_PAIRS))).cast("int")
    hot = counts[0].join(counts[1], keys).filter(F.col("__na").cast("double") * F.col("__nb") > MOST_PAIRS)
    hot = cut(hot.select(*keys, parts("__na").alias("__pa"), parts("__nb").alias("__pb")))
    many = hot.count()
    if not many:
        return a.join(b, keys)
    if many <= MOST_TILED:
        hot = F.broadcast(hot)
    part = lambda key, n: F.pmod(F.hash(F.col(key)), F.coalesce(n, F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    own = [next(c for c in ("k_id", "g_id") if c in s.columns) for s in sides]
    a = a.join(hot, keys, "left").withColumn("__ta", part(own[0], F.col("__pa"))).withColumn("__tb", every(F.col("__pb"))).drop("__pa", "__pb")
    b = b.join(hot, keys, "left").withColumn("__tb", part(own[1], F.col("__pb"))).withColumn("__ta", every(F.col("__pa"))).drop("__pa", "__pb")
    return a.join(b, [*keys, "__ta", "__tb"])


def _cells(df: DataFrame, lo: Column, hi: Column, top: int) -> DataFrame:
    """A row for each dyadic cell (level, cell) of [lo, hi], as few as there can be."""
    at = df.withColumn("__from", lo).withColumn("__to", hi).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    at = at.withColumn("__l", F.expr("shiftright(__from + shiftleft(1L, level) - 1, level)")).withColumn("__r", F.expr("shiftright(__to + 1, level)")).filter("__l < __r")
    ends = F.array(F.when(F.col("__l") % 2 == 1, F.col("__l")), F.when(F.col("__r") % 2 == 1, F.col("__r") - 1))
    return at.withColumn("cell", F.explode(F.array_compact(ends))).drop("__from", "__to", "__l", "__r")


def _points(df: DataFrame, at: Column, top: int) -> DataFrame:
    """A row for each level's cell that holds a place."""
    return df.withColumn("__p", at).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("cell", F.expr("shiftright(__p, level)")).drop("__p")


def _ranked(sides: list[DataFrame]) -> list[DataFrame]:
    """``lo`` and ``hi`` as ranks among all ends of both sides."""
    ends = sides[0].select(F.col("lo").alias("v"))
    for x in (sides[0].select("hi"), sides[1].select("lo"), sides[1].select("hi")):
        ends = ends.union(x)
    rank = number_rows(ends.distinct(), "v", name="at")
    for end in ("lo", "hi"):
        sides = [s.join(rank.select(F.col("v").alias(end), F.col("at").alias("__at")), end).withColumn(end, F.col("__at")).drop("__at") for s in sides]
    return sides


def _by_interval(k: DataFrame, g: DataFrame, ends_k: tuple[Column, Column], ends_g: tuple[Column, Column], sizes: tuple[int, int], low, high, widest: tuple[float, float]) -> DataFrame:
    if low is None:
        return k.join(g, F.lit(False)).select("k", "k_id", "g", "g_id")
    sides = []
    for df, x in ((k, ends_k), (g, ends_g)):
        ends = df.withColumn("__a", x[0]).withColumn("__b", x[1]).filter("__a is not null and __b is not null")
        sides.append(ends.withColumn("lo", F.least("__a", "__b")).withColumn("hi", F.greatest("__a", "__b")).drop("__a", "__b"))
    if all(s.schema["lo"].dataType.simpleString() in WHOLE for s in sides) and max(widest) < MOST_PLACES and high - low < FARTHEST:
        sides = [s.withColumns({e: F.col(e).cast("bigint") - low for e in ("lo", "hi")}) for s in sides]
    else:
        sides = [cut(s) for s in _ranked(sides)]
        widest = [s.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0 for s in sides]
    out = None
    for n, m, first in ((0, 1, F.col("lo")), (1, 0, F.col("lo") + 1)):
        places = int(widest[n]) + 1 - n
        if not places:
            continue
        top = places.bit_length() - 1
        holding = _cells(sides[n].filter(first <= F.col("hi")), first, F.col("hi"), top).drop("lo", "hi")
        held = _points(sides[m], F.col("lo"), top).drop("lo", "hi")
        met = _tiles((holding, held), ["level", "cell", "__equal"], (sizes[n], sizes[m])).select("k", "k_id", "g", "g_id")
        out = met if out is None else out.unionByName(met)
    return out


def _by_value(k: DataFrame, g: DataFrame, wanted: Column, held: Column, sizes: tuple[int, int]) -> DataFrame:
    """Pairs where an array of one side shares a value with an array of the other, once each."""
    each = lambda df, values, name: df.withColumn(name, F.array_distinct(values)).withColumn("__v", F.explode(name))
    joined = _tiles((each(k, wanted, "__wanted"), each(g, held, "__held")), ["__v", "__equal"], sizes)
    return joined.filter(F.col("__v") == F.array_min(F.array_intersect("__wanted", "__held"))).select("k", "k_id", "g", "g_id")


def _measured(k: DataFrame, g: DataFrame, schema: GeneralisedSchema, intervals: Sequence[str]) -> tuple[tuple[int, int], dict[str, tuple]]:
    """Numbers of regions of both sides; for each interval column its lowest and highest end, the sum of both mean widths, and both largest ones."""
    both = None
    for side, (df, name) in enumerate(((k, "k"), (g, "g"))):
        ends = []
        for i, c in enumerate(intervals):
            a, b = schema.bounds(_field(name), c)
            ends += [F.least(a, b).alias(f"a{i}"), F.greatest(a, b).alias(f"b{i}")]
        mine = df.select(F.lit(side).alias("side"), *ends)
        both = mine if both is None else both.union(mine)
    found = [f(F.col(f"{x}{i}")).alias(f"{x}{i}") for i in range(len(intervals)) for f, x in ((F.min, "a"), (F.max, "b"))]
    width = lambda i: F.col(f"b{i}").cast("double") - F.col(f"a{i}").cast("double")
    widths = [f(width(i)).alias(f"{x}{i}") for i in range(len(intervals)) for f, x in ((F.avg, "w"), (F.max, "x"))]
    rows = {r["side"]: r for r in both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), *found, *widths).collect()}
    stats = {}
    for i, c in enumerate(intervals):
        known = [r for r in rows.values() if r[f"a{i}"] is not None]
        stats[c] = (min((r[f"a{i}"] for r in known), default=None), max((r[f"b{i}"] for r in known), default=None), sum(r[f"w{i}"] for r in known), tuple(rows[s][f"x{i}"] or 0.0 if s in rows else 0.0 for s in (0, 1)))
    return tuple(rows[s]["n"] if s in rows else 0 for s in (0, 1)), stats


def _share_met(k: DataFrame, g: DataFrame, schema: GeneralisedSchema, column: str, sizes: tuple[int, int], stats: dict[str, tuple]) -> float:
    """About what share of all pairs meet in a column: by mean widths, or by how often values occur."""
    if column in stats:
        low, high, widths, _ = stats[column]
        return 0.0 if low is None else min(1.0, (widths + 1.0) / (float(high) - float(low) + 1.0))
    values = lambda name, side: F.explode(F.array_distinct(schema.keys(_field(name), column)[side])).alias("v")
    both = k.select(values("k", 0), F.lit(1).alias("k"), F.lit(0).alias("g")).union(g.select(values("g", 1), F.lit(0), F.lit(1)))
    by = both.groupBy("v").agg(F.sum("k").cast("double").alias("k"), F.sum("g").cast("double").alias("g"))
    return (by.agg(F.sum(F.col("k") * F.col("g"))).first()[0] or 0.0) / max(1.0, float(sizes[0]) * sizes[1])


def _fewest_met(k: DataFrame, g: DataFrame, schema: GeneralisedSchema, inner: Sequence[str], sizes: tuple[int, int], stats: dict[str, tuple]) -> str:
    """The column in which the fewest pairs meet; values are counted only where no interval leaves a few a region."""
    if len(inner) == 1:
        return inner[0]
    share = {n: _share_met(k, g, schema, n, sizes, stats) for n in inner if n in stats}
    if min(share.values(), default=1.0) * sizes[0] * sizes[1] > FEW_PAIRS * (sizes[0] + sizes[1]):
        share |= {n: _share_met(k, g, schema, n, sizes, stats) for n in inner if n not in stats}
    return min(share, key=share.get)


def _as(value: Column, kind: str, other: str) -> Column:
    """A value in a type in which equal values of both types are hashed alike."""
    if kind in WHOLE and other in WHOLE:
        return value.cast("bigint")
    if kind in ("float", "double") or other in ("float", "double"):
        return value.cast("double") + F.lit(0.0)
    return value if kind == other else value.cast("string")


def candidate_regions(k: DataFrame, g: DataFrame, schema: GeneralisedSchema, on: Sequence[str]) -> DataFrame:
    """(k, k_id, g, g_id): pairs of regions that meet in one column and are equal where they must be, once each."""
    equal = [c for n in on if schema.is_exact(n) for c in schema.physical(n)]
    inner = [n for n in on if schema.bounds(_field("k"), n) or schema.keys(_field("k"), n)]
    kinds = [{x.name: x.dataType.simpleString() for x in df.schema[name].dataType} for df, name in ((k, "k"), (g, "g"))]
    alike = lambda name: [_as(F.col(name)[c], kinds[0][c], kinds[1][c]) for c in equal]
    keyed = [df.withColumn("__equal", F.xxhash64(*alike(name)) if equal else F.lit(0).cast("bigint")) for df, name in ((k, "k"), (g, "g"))]
    intervals = [n for n in inner if schema.bounds(_field("k"), n)]
    sizes, stats = _measured(k, g, schema, intervals)
    if not inner:
        if len(equal) < sum(len(schema.physical(n)) for n in on):  # a schema with tests of its own
            return k.join(g, schema.overlaps(_field("k"), _field("g"), on)).select("k", "k_id", "g", "g_id")
        return _tiles((keyed[0], keyed[1]), ["__equal"], sizes).select("k", "k_id", "g", "g_id")
    best = _fewest_met(k, g, schema, inner, sizes, stats)
    if best in stats:
        return _by_interval(*keyed, schema.bounds(_field("k"), best), schema.bounds(_field("g"), best), sizes, *stats[best][:2], stats[best][3])
    return _by_value(*keyed, schema.keys(_field("k"), best)[0], schema.keys(_field("g"), best)[1], sizes)


def region_pairs(k: DataFrame, g: DataFrame, schema: GeneralisedSchema, on: Sequence[str]) -> DataFrame:
    """(k, k_id, g, g_id) of the regions that overlap on ``on``."""
    return candidate_regions(k, g, schema, on).filter(schema.overlaps(_field("k"), _field("g"), on))


def of_region(df: DataFrame, found: DataFrame, physical: Sequence[str], name: str, *kept: Column) -> DataFrame:
    """(name_id, kept columns): the records of a table with the number that their region has in ``found``."""
    quoted = [f"`{c}`" for c in physical]
    hashed = df.select(*kept, F.xxhash64(*quoted).alias("__hash"), F.struct(*quoted).alias("__region"))
    same = (F.col("__hash") == F.col(f"{name}_hash")) & F.col("__region").eqNullSafe(F.col(name))
    return hashed.join(found, same).drop("__hash", "__region", name, f"{name}_hash")


def overlap_join(knowledge: DataFrame, release: DataFrame, schema: GeneralisedSchema, on: Sequence[str]) -> DataFrame:
    """Pairs (k struct, r struct) of records that overlap on ``on``; all pairs, if ``on`` is empty."""
    physical = [c for n in on for c in schema.physical(n)]
    whole = lambda df, name: F.struct(*[f"`{c}`" for c in df.columns]).alias(name)
    if not physical:
        return knowledge.select(whole(knowledge, "k")).crossJoin(release.select(whole(release, "r")))
    k, g = regions(knowledge, physical, "k"), regions(release, physical, "g")
    pairs = region_pairs(k, g, schema, on).select("k_id", "g_id")  # numbers only: regions may have hundreds of columns
    with_r = pairs.join(of_region(release, g, physical, "g", whole(release, "r")), "g_id")
    return with_r.join(of_region(knowledge, k, physical, "k", whole(knowledge, "k").alias("__row")), "k_id").select(F.col("__row").alias("k"), "r")


def overlap_shared(knowledge: DataFrame, release: DataFrame, schema: GeneralisedSchema, on: Sequence[str], left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """(``left`` columns of the knowledge, what both share on ``on``, ``right`` columns of the release) of records that overlap.

    What records share depends on their regions, so it is found once for a pair
    of regions, however many records have them.
    """
    physical = [c for n in on for c in schema.physical(n)]
    quoted = lambda names: [F.col(f"`{c}`") for c in names]
    k, g = regions(knowledge, physical, "k"), regions(release, physical, "g")
    shared = {c: v.alias(c) for c, v in schema.shared(_field("k"), _field("g"), on).items()}
    pairs = cut(region_pairs(k, g, schema, on).select("k_id", "g_id", *shared.values()))
    with_r = pairs.join(of_region(release, g, physical, "g", *quoted(right)), "g_id")
    rows = of_region(knowledge, k, physical, "k", *[c.alias(f"__left{n}") for n, c in enumerate(quoted(left))])
    return with_r.join(rows, "k_id").select(*[F.col(f"__left{n}").alias(c) for n, c in enumerate(left)], *quoted(shared), *quoted(right))
