"""Approximate nearest neighbours by inner product, with multiprobe p-stable hashing.

Vectors are parted into bands by length, each at most sqrt(2) wide, and lifted by
the band's longest, so that in a band the largest inner product is the smallest
Euclidean distance; they are hashed in ``tables`` tables by ``width``-quantised projections on
Gaussian (2-stable) directions.  A query visits its own bucket and perturbed
ones in the order of estimated success: the template of perturbation sets is
sorted by the expected squared distance to the bucket borders and applied to the
query's own border distances.  The ``Index.longest`` longest vectors are scored
for every query; what they give bounds the bands that a query needs, as no inner
product exceeds the lengths', and leaves no query without neighbours.  Candidates
of all tables and bands are merged and ranked by exact inner products in double
precision, summed component by component.

Equal vectors are one entry of the index, with the smallest ids that a result
can need, so a vector that a third of all rows share costs no more than another.
Buckets are gathered with the queries that visit them, table by table and in
blocks of queries; a bucket above ``most_in_bucket`` entries is cut into chunks
which the same queries visit.

How many projections, tables and probes there are and how wide a bucket is comes
from a sample of at most ``Index.sample`` rows and ``Index.sample_queries``
queries: the setting that finds ``Index.recall`` of the sample's nearest pairs
with the fewest scores.  Every row is indexed.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, neither do null ids; ties go to
the smaller id; a repeated (id, vector) row counts once; with no more candidates than asked for, all found are returned;
an empty table gives an empty table.  Only the id and vector columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import checkpointed


@dataclass(frozen=True)
class Setting:
    """What decides which buckets a query visits."""

    projections: int
    width: float
    tables: int
    probes: int


@dataclass(frozen=True)
class Index:
    """How the setting is chosen, and how much meets in one task.

    The sample bounds the estimate, not the index: every row is indexed.
    """

    recall: float = 0.97  # on the sample
    sample: int = 4096
    sample_queries: int = 96
    projections: tuple[int, ...] = (8, 12, 16)
    widths: tuple[float, ...] = (1.3, 1.9, 2.7)  # times the distance of the farthest neighbour asked for
    tables: int = 4  # at most
    probes: tuple[int, ...] = (32, 128, 256, 512)
    group: int = 16_384
    most_in_bucket: int = 16_384
    query_block: int = 16_384
    longest: int = 256  # vectors that every query is compared with
    spare: int = 4  # candidates beyond those asked for that are scored again
    seed: int = 11


def perturbations(k: int, count: int) -> list[tuple[int, ...]]:
    """Sets of border ranks (0 to 2k-1, nearest first) by expected squared distance.

    The j-th smallest of 2k border distances has a known expected square when
    the k offsets are uniform; a set that crosses both borders of one projection
    is not a bucket.
    """
    j = np.arange(1, 2 * k + 1)
    near = j * (j + 1) / (4.0 * (k + 1) * (k + 2))
    m = 2 * k + 1 - j
    far = 1 - m / (k + 1) + m * (m + 1) / (4.0 * (k + 1) * (k + 2))
    cost = np.where(j <= k, near, far)
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < count:
        total, chosen = heapq.heappop(heap)
        if all(2 * k - 1 - c not in chosen for c in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return out


class Hasher:
    """The tables of an index over ``n`` distinct vectors of ``d`` components."""

    def __init__(self, index: Index, setting: Setting, n: int, d: int, longest: float) -> None:
        draw = np.random.default_rng(index.seed)
        self.setting, self.k, self.longest = setting, setting.projections, longest
        self.template = perturbations(self.k, setting.probes)
        self.directions = draw.normal(size=(setting.tables, d + 1, self.k))
        self.shifts = draw.uniform(0, 1, (setting.tables, self.k))
        self.mix = draw.integers(1, 1 << 62, self.k, dtype=np.int64) | 1
        self.groups = max(1, -(-n // index.group))

    def bands(self, x: np.ndarray) -> np.ndarray:
        """Band 0 holds the longest vectors; each is sqrt(2) times as long as the next."""
        length = np.linalg.norm(x, axis=1)
        return np.maximum(0, np.floor(2 * np.log2(self.longest / length))).astype(np.int64)

    def upper(self, bands: np.ndarray) -> np.ndarray:
        """The greatest length in a band."""
        return self.longest * 2.0 ** (-bands / 2)

    def in_band(self, buckets: np.ndarray, band: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return buckets ^ (np.asarray(band, np.int64) * np.int64(0x2545F4914F6CDD1D))

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            return np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])
        x = x / self.upper(self.bands(x))[:, None]
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))])

    def cells(self, table: int, lifted: np.ndarray) -> np.ndarray:
        return lifted @ self.directions[table] / self.setting.width + self.shifts[table]

    def bucket(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (cells.astype(np.int64) * self.mix).sum(axis=-1)
            mixed ^= mixed >> 31
            return mixed * np.int64(0x5851F42D4C957F2D)

    def probes(self, table: int, lifted: np.ndarray) -> np.ndarray:
        """Buckets of each query, (queries, probes)."""
        cells = self.cells(table, lifted)
        base = np.floor(cells)
        offset = cells - base
        order = np.argsort(np.concatenate([offset, 1 - offset], axis=1), axis=1, kind="stable")
        out = []
        rows = np.arange(len(lifted))
        for chosen in self.template:
            moved = base.copy()
            for rank in chosen:
                border = order[:, rank]
                moved[rows, border % self.k] += np.where(border < self.k, -1, 1)
            out.append(self.bucket(moved))
        return np.stack(out, axis=1)


def choose(index: Index, entries: np.ndarray, asked: np.ndarray, nearest: int, n: int, longest: float) -> Setting:
    """The setting that finds ``index.recall`` of the sample's nearest pairs with the fewest scores.

    Neighbours in a table are as near as fewer are in a sample of it: as many as
    its share of the table, twice which are looked for.  Where none of the settings
    reaches the recall the one that finds most is taken.
    """
    if n <= nearest + 1 or len(entries) < 2:
        return Setting(1, 1e9, 1, 1)  # everything is a neighbour
    score = asked @ entries.T
    own = score >= (np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(entries, axis=1)) * (1 - 1e-12)
    score[own] = -np.inf
    found = min(nearest, max(3, math.ceil(2 * nearest * len(entries) / n)), len(entries) - 1)
    true = np.argpartition(-score, found - 1, axis=1)[:, :found]
    live = np.isfinite(np.take_along_axis(score, true, 1))
    lift = Hasher(index, Setting(1, 1.0, 1, 1), n, entries.shape[1], longest)
    x, q = lift.lifted(entries, False), lift.lifted(asked, True)
    far = np.sqrt(max(1e-12, np.mean(((q[:, None] - x[true[:, -1:]]) ** 2).sum(axis=2))))
    best: tuple[float, float, Setting] | None = None
    for k in index.projections:
        for width in index.widths:
            hasher = Hasher(index, Setting(k, far * width, index.tables, max(index.probes)), n, entries.shape[1], longest)
            first = np.full(score.shape, len(hasher.template))  # the earliest probe of any table so far
            work = dict.fromkeys(index.probes, 0.0)
            for t in range(index.tables):
                buckets, probes = hasher.bucket(np.floor(hasher.cells(t, x))), hasher.probes(t, q)
                order = np.argsort(probes, axis=1, kind="stable")
                for i in range(len(q)):
                    ranked = probes[i][order[i]]
                    at = np.minimum(np.searchsorted(ranked, buckets), len(ranked) - 1)
                    seen = np.where(ranked[at] == buckets, order[i][at], len(ranked))
                    np.minimum(first[i], seen, out=first[i])
                    for p in index.probes:
                        work[p] += (seen < p).mean() / len(q)
                for p in index.probes:
                    hit = (np.take_along_axis(first, true, 1) < p)[live].mean() if live.any() else 1.0
                    # scores, visits, and the copies of rows that a table takes
                    cost = work[p] * n + 2.0 * p * (t + 1) + 200.0 * (t + 1)
                    here = (min(hit, index.recall), -cost, Setting(k, far * width, t + 1, p))
                    if best is None or here[:2] > best[:2]:
                        best = here
                if (np.take_along_axis(first, true, 1) < min(index.probes))[live].mean() >= index.recall:
                    break
    return best[2]


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def _entries(hasher: Hasher):
    """One row per entry and table: (table, bucket, id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(1))
            lifted, packed, bands = hasher.lifted(x.astype(np.float64), False), _binary(x), hasher.bands(x.astype(np.float64))
            for t in range(hasher.setting.tables):
                buckets = hasher.in_band(hasher.bucket(np.floor(hasher.cells(t, lifted))), bands)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(buckets), batch.column(0), packed], names=["table", "bucket", "id", "vector"])

    return run


def _visits(hasher: Hasher, bands: np.ndarray, longest: np.ndarray, nearest: int):
    """One row per query, table and group that it visits: (table, part, id, vector, buckets).

    A query needs the bands that are longer than its ``nearest``-th best score
    among the ``longest`` vectors.
    """
    upper = hasher.upper(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, (1 << 17) // (len(hasher.template) * len(bands)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = _vectors(batch.column(1))
                lifted, ids, packed = hasher.lifted(x.astype(np.float64), True), batch.column(0), [row.tobytes() for row in x]
                least = np.full(len(x), -np.inf)
                if len(longest) >= nearest:
                    least = -np.partition(-(lifted[:, :-1] @ longest.T), nearest - 1, axis=1)[:, nearest - 1]
                needed = [bands[upper >= a - 1e-9 * abs(a)] for a in least]
                for t in range(hasher.setting.tables):
                    probes = hasher.probes(t, lifted)
                    of, part, vectors, buckets = [], [], [], []
                    for q in range(len(x)):
                        own = np.unique(hasher.in_band(probes[q][None, :], needed[q][:, None]))
                        parts = own % hasher.groups
                        for p in np.unique(parts):
                            of.append(q)
                            part.append(p)
                            vectors.append(packed[q])
                            buckets.append(own[parts == p])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(of), t, np.int32)), pa.array(part, pa.int64()), ids.take(pa.array(of, pa.int64())), pa.array(vectors, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                        names=["table", "part", "id", "vector", "buckets"],
                    )

    return run


def _longest(ids: np.ndarray, longest: np.ndarray, nearest: int):
    """(query, id, score): the nearest of the longest vectors for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = _vectors(batch.column(1)).astype(np.float64) @ longest.T
                top = np.argsort(-score, axis=1, kind="stable")[:, :nearest]
                of = np.repeat(np.arange(len(score)), top.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(ids[top.ravel()]), pa.array(np.take_along_axis(score, top, 1).ravel())], names=["query", "id", "score"])

    return run


def _search(nearest: int, kind: str):
    """Entries and visits of one group: the nearest entries of each query there."""
    dtype = np.dtype(kind)

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        values = column.to_pylist()
        return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1).astype(np.float64)

    def run(entries: pa.Table, visits: pa.Table) -> pa.Table:
        names = ["query", "id", "score"]
        if not entries.num_rows or not visits.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        buckets = entries.column("bucket").to_numpy()
        order = np.argsort(buckets, kind="stable")
        buckets, ids, x = buckets[order], entries.column("id").to_numpy()[order], matrix(entries.column("vector"))[order]
        lists = visits.column("buckets").combine_chunks()
        wanted = lists.flatten().to_numpy()
        rows = np.repeat(np.arange(visits.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        sort = np.argsort(wanted, kind="stable")
        wanted, rows = wanted[sort], rows[sort]
        q = matrix(visits.column("vector"))
        best = np.full((len(q), nearest), -np.inf)
        best_id = np.full((len(q), nearest), np.iinfo(np.int64).max)
        keys, start, count = np.unique(wanted, return_index=True, return_counts=True)
        low, high = np.searchsorted(buckets, keys, "left"), np.searchsorted(buckets, keys, "right")
        for n in np.flatnonzero(high > low):
            of_bucket = rows[start[n] : start[n] + count[n]]
            for at in range(low[n], high[n], 4096):
                found = slice(at, min(high[n], at + 4096))
                for first in range(0, len(of_bucket), 1024):
                    who = of_bucket[first : first + 1024]
                    score = np.concatenate([best[who], q[who] @ x[found].T], axis=1)
                    who_id = np.concatenate([best_id[who], np.broadcast_to(ids[found], (len(who), found.stop - found.start))], axis=1)
                    top = np.lexsort((who_id, -score), axis=1)[:, :nearest] if score.shape[1] < 128 else _top(score, who_id, nearest)
                    best[who], best_id[who] = np.take_along_axis(score, top, 1), np.take_along_axis(who_id, top, 1)
        query, place = np.nonzero(np.isfinite(best))
        return pa.table([visits.column("id").take(pa.array(query)), pa.array(best_id[query, place]), pa.array(best[query, place])], names=names)

    def _top(score: np.ndarray, who_id: np.ndarray, nearest: int) -> np.ndarray:
        """The first by score and id; a tie at the border is settled by sorting all of its row."""
        cut = -np.partition(-score, nearest - 1, axis=1)[:, nearest - 1 : nearest]
        out = np.empty((len(score), nearest), np.int64)
        for i in range(len(score)):
            some = np.flatnonzero(score[i] >= cut[i])
            out[i] = some[np.lexsort((who_id[i, some], -score[i, some]))[:nearest]]
        return out

    return run


def _sample(df: DataFrame, n: int, most: int, kind: str) -> np.ndarray:
    """Vectors of at most ``most`` rows by a hash of the id, in double precision."""
    place = F.xxhash64(F.col("id"), F.lit("sample"))
    some = df if n <= 2 * most else df.filter(F.pmod(place, F.lit(1 << 30)) < int((1 << 30) * 2.0 * most / n))
    got = some.select("id", "vector", place.alias("place")).orderBy("place", "id").limit(most).select("vector").toArrow()
    column = got.column("vector").combine_chunks()
    return _vectors(column).astype(np.dtype(kind)).astype(np.float64) if len(column) else np.empty((0, 1))


def _usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def nearest_neighbours(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = 20, index: Index = Index()) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row for which ``is_query`` holds (over the column ``id``)."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & F.coalesce(_usable(F.col("vector")), F.lit(False))).withColumn("d", F.size("vector"))
    lengths = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return empty
    double = df.schema[vector_col].dataType.elementType.simpleString() == "double"
    rows = rows.filter(F.col("d") == lengths["d"]).select("id", "vector", F.xxhash64("vector").alias("h1"), F.hash("vector").alias("h2"))

    # A class of equal vectors; a result needs its smallest ids only, and one more for a query's own.
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    members = checkpointed(rows.dropDuplicates(["id", "h1", "h2"]).withColumn("r", rank).filter(F.col("r") <= nearest + 1))
    entries = members.filter("r = 1").select("id", "vector", "h1", "h2")
    queries = rows.filter(is_query)
    asked = checkpointed(queries.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("vector").alias("vector")))

    square = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    stats = entries.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(square)).alias("longest")).first()
    bands = entries.select(F.floor(2 * F.log2(F.lit(stats["longest"]) / F.sqrt(square))).cast("long").alias("band")).distinct().collect()
    bands = np.array(sorted({max(0, r["band"] + n) for r in bands for n in (-1, 0, 1)}), np.int64)  # one more each way: its logarithm may round otherwise
    top = entries.select("id", "vector").orderBy(F.desc(square), "id").limit(max(index.longest, nearest + 1)).toArrow()
    top_ids, longest = top.column("id").to_numpy(), _vectors(top.column("vector").combine_chunks()).astype(np.float64)
    n_asked = asked.count()
    if not n_asked:
        return empty
    sampled = lambda df, n, most: _sample(df, n, most, "<f8" if double else "<f4")
    setting = choose(index, sampled(entries, stats["n"], index.sample), sampled(asked, n_asked, index.sample_queries), nearest, stats["n"], stats["longest"])
    hasher = Hasher(index, setting, stats["n"], lengths["d"], stats["longest"])
    stored = entries.select("id", "vector").mapInArrow(_entries(hasher), "table int, bucket bigint, id bigint, vector binary")
    stored = stored.withColumn("part", F.pmod("bucket", F.lit(hasher.groups)))
    visits = asked.select("id", "vector").mapInArrow(_visits(hasher, bands, longest, nearest + 1), "table int, part bigint, id bigint, vector binary, buckets array<bigint>")

    blocks = max(1, -(-n_asked // index.query_block))
    visits = visits.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))

    large = checkpointed(stored.groupBy("table", "bucket", "part").count().filter(F.col("count") > index.most_in_bucket))
    if large.isEmpty():
        stored, visits = stored.withColumn("chunk", F.lit(0)), visits.withColumn("chunk", F.lit(0))
    else:
        chunks = large.select("table", "bucket", F.ceil(F.col("count") / index.most_in_bucket).cast("int").alias("chunks"))
        stored = stored.join(chunks, ["table", "bucket"], "left").withColumn("chunk", F.pmod(F.xxhash64("id"), F.coalesce("chunks", F.lit(1))).cast("int")).drop("chunks")
        most = large.groupBy("table", "part").agg(F.ceil(F.max("count") / index.most_in_bucket).cast("int").alias("chunks"))
        visits = visits.join(most, ["table", "part"], "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))).drop("chunks")
    stored = stored.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["table", "part", "chunk", "block"]
    found = stored.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(_search(nearest + 1, "<f8" if double else "<f4"), "query bigint, id bigint, score double")

    found = found.unionByName(asked.select("id", "vector").mapInArrow(_longest(top_ids, longest, nearest + 1), "query bigint, id bigint, score double"))
    place = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    merged = found.groupBy("query", "id").agg(F.max("score").alias("score")).withColumn("r", place("query", F.desc("score"), "id")).filter(F.col("r") <= nearest + 1 + index.spare)
    both = merged.select("query", "id").join(asked.select(F.col("id").alias("query"), F.col("vector").alias("asked")), "query").join(entries.select("id", "vector"), "id")
    product = F.aggregate(F.zip_with("asked", "vector", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    merged = both.select("query", "id", product.alias("score")).withColumn("r", place("query", F.desc("score"), "id")).filter(F.col("r") <= nearest + 1)
    classes = members.filter("r = 1").select(F.col("id").alias("root"), "h1", "h2")
    of_root = members.join(classes, ["h1", "h2"]).select("root", F.col("id").alias("vec_id"))
    wide = merged.join(of_root, F.col("id") == F.col("root")).withColumn("r", place("query", F.desc("score"), "vec_id")).filter(F.col("r") <= nearest + 1)
    answers = checkpointed(wide.select("query", "vec_id", "score"))
    askers = queries.select(F.col("id").alias("query_id"), "h1", "h2").distinct().join(asked.select("h1", "h2", F.col("id").alias("query")), ["h1", "h2"]).select("query_id", "query")
    own = checkpointed(askers).join(answers, "query").filter(F.col("query_id") != F.col("vec_id"))
    ranked = own.withColumn("rank", place("query_id", F.desc("score"), "vec_id")).filter(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")
