"""Near-duplicate classes by a MinHash LSH forest.

1. Every text gives its set of word shingles (64-bit hashes), a digest of the
   set, and minima of ``trees * depth`` hash functions.  Texts with equal sets
   form one class, represented by the smallest id.
2. Each tree is a sorted order of the classes by ``depth`` minima.  Candidates
   are neighbours in that order whose common prefix is at least ``shallow``
   long; a 2-bit sketch of all minima discards pairs far below the threshold.
   The depth adapts to the region: where few classes share ``shallow`` minima all
   of them meet; where many do, a class first meets those that follow it within
   ``reach`` places, which share the longest prefixes, and of them offers the
   ``offers`` most alike in each tree.  Classes for which that left out anyone
   are marked as crowded.
3. The most alike candidates of each class are confirmed on full shingle sets
   and closed to components.
4. Crowded classes meet once more, whatever their number, by the shingles that
   two sets at the threshold cannot avoid to share: with all sets in one order,
   rarest shingles first, the first shingle that two of them share stands so
   early that what is left can still reach the threshold.  Classes of one
   component do not meet; pairs have to pass the sketch.
5. These pairs and all other candidates of different components are confirmed
   and closed to components.

A pair at the threshold of 0.8 shares a prefix of 4 in one tree with chance 0.41
and in none of 20 trees with chance 3e-5; a pair at 0.9 with 2e-9.

Orders are range-partitioned by (tree, minima, id), so a group of copies of any
size is cut like any other rows.  Sets are moved for candidate classes only.

Defined results: a null or blank text has an empty set, is linked with nothing
and is its own component; fewer words than a shingle form one shingle; repeated
rows get the same component; a row with a null id is returned with a null
component and kept; an empty table gives an empty table.  Only the id and text
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import arrow_rows, checkpointed, hashable, quoted, small
from cloakframe.llm.graph import components

FILTER_BUCKETS = 1 << 20
RARITY_BITS = 18


@dataclass(frozen=True)
class Forest:
    width: int = 5
    percent: int = 80
    trees: int = 20
    depth: int = 8
    shallow: int = 4
    reach: int = 48
    offers: int = 6
    least_alike: float = 0.72  # share of equal 2-bit pieces: 0.85 expected at 0.8, less 4.5 deviations
    seed: int = 20240229

    @property
    def hashes(self) -> int:
        return self.trees * self.depth

    def factors(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(0, 1 << 63, self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text (A-Z lower-cased)."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, n)
    size = min(n, width)
    mixed = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        mixed = (mixed ^ hashed[j : n - size + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def minima(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over a set, as 32 bits."""
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(out, np.multiply.outer(factors, shingles[at : at + 2048]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _path(low: np.ndarray) -> np.ndarray:
    """16 bits of each minimum, mixed: the leading bits of a large set's minima are all zero."""
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")


def _sketch(low: np.ndarray) -> bytes:
    bits = ((low[:, None] >> np.array([0, 1], np.uint32)) & np.uint32(1)).astype(np.uint8).ravel()
    return np.packbits(np.pad(bits, (0, -len(bits) % 64))).tobytes()


def _signatures(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = forest.factors()
        for batch in batches:
            sizes, first, second, orders, sketches = [], [], [], [], []
            for text in batch.column(1):
                got = shingle_set(text.as_py(), forest.width)
                digest = xxhash.xxh3_128_digest(got.tobytes())
                low = minima(got, factors)
                sizes.append(len(got))
                first.append(int.from_bytes(digest[:8], "big", signed=True))
                second.append(int.from_bytes(digest[8:], "big", signed=True))
                orders.append(_path(low).tobytes())
                sketches.append(_sketch(low))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(orders, pa.binary()), pa.array(sketches, pa.binary())],
                names=["id", "n", "h1", "h2", "orders", "sketch"],
            )

    return run


def _matrix(column: pa.Array, dtype: np.dtype) -> np.ndarray:
    """Rows of equally long binary values as a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)


def _alike(forest: Forest, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal 2-bit pieces of sketches."""
    x = x ^ y
    x = (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)
    return 1 - np.bitwise_count(x).sum(axis=1) / forest.hashes


def _close(forest: Forest, rows: list[np.ndarray], fresh: int, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(s, at, share): rows ``at`` and ``at + s`` are near in the order; ``at + s`` is at ``fresh`` or later.

    s = 0 gives rows that have neighbours in their region beyond ``reach``.
    """
    tree, path, _, sizes, sketch = rows
    n = len(tree)
    for s in range(1, min(reach, n - 1) + 1):
        a, b = slice(0, n - s), slice(s, n)
        same = (tree[a] == tree[b]) & (path[a, : forest.shallow] == path[b, : forest.shallow]).all(axis=1)
        same[: max(0, fresh - s)] = False
        if not same.any():
            return
        if s == reach:
            at = np.flatnonzero(same)
            yield 0, np.union1d(at, at + s), np.empty(0, np.float32)
        same &= 100 * np.minimum(sizes[a], sizes[b]) >= forest.percent * np.maximum(sizes[a], sizes[b])
        at = np.flatnonzero(same)
        share = _alike(forest, sketch[at], sketch[at + s])
        near = share >= forest.least_alike
        if near.any():
            yield s, at[near], share[near].astype(np.float32)


def _place(batch: pa.RecordBatch) -> list[np.ndarray]:
    column = lambda i: batch.column(i).to_numpy(zero_copy_only=False)
    return [column(0), _matrix(batch.column(1), np.dtype(">u2")), column(2), column(3), _matrix(batch.column(4), np.dtype("<u8"))]


def _ordered(a: np.ndarray, b: np.ndarray, alike: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()), pa.array(alike, pa.float32())], names=["a", "b", "alike"])


def _neighbours(forest: Forest):
    """Offers of near rows in sorted batches; rows whose pairs were cut come as pairs with themselves."""

    def offered(rows: list[np.ndarray], fresh: int) -> pa.RecordBatch:
        empty = np.empty(0, np.int64)
        first, second, alike, left_out = [empty], [empty], [np.empty(0, np.float32)], [empty]
        for s, at, share in _close(forest, rows, fresh, forest.reach):
            if s:
                first.append(at)
                second.append(at + s)
                alike.append(share)
            else:
                left_out.append(at)
        x, y, z = np.concatenate(first), np.concatenate(second), np.concatenate(alike)
        order = np.lexsort((y, -z, x))
        x, y, z = x[order], y[order], z[order]
        out = np.arange(len(x)) - np.searchsorted(x, x) >= forest.offers
        lone = rows[2][np.unique(np.concatenate([*left_out, x[out], y[out]]))]
        a, b, z = rows[2][x[~out]], rows[2][y[~out]], z[~out]
        keep = a != b
        return _ordered(np.concatenate([a[keep], lone]), np.concatenate([b[keep], lone]), np.concatenate([z[keep], np.full(len(lone), -1, np.float32)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now, fresh = _place(batch), 0
            if held is not None:
                fresh = len(held[0])
                now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
            held = [x[-forest.reach :] for x in now]
            yield offered(now, fresh)

    return run


def _rarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n): how many sets hold a shingle of each bucket of shingles."""
    counts = np.zeros(1 << RARITY_BITS, np.int64)
    for batch in batches:
        for held in batch.column(0):
            np.add.at(counts, (np.frombuffer(held.as_buffer(), np.uint64) >> np.uint64(64 - RARITY_BITS)).astype(np.int64), 1)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at])], names=["bucket", "n"])


def _leading(forest: Forest, counts: np.ndarray):
    """(shingle, n, most, id, label, sketch): the leading shingles of each set, rarest first.

    A set whose first shared shingle is this one reaches the threshold with sets
    of at most ``most`` shingles; rows that leave no possible size are omitted.
    """
    percent = forest.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found, most, of = [], [], []
            for i, held in enumerate(batch.column(4)):
                x = np.frombuffer(held.as_buffer(), np.uint64)
                limit = (len(x) - np.arange(len(x))) * (100 + percent) // percent - len(x)
                k = int((100 * limit >= percent * len(x)).sum())
                found.append(x[np.lexsort((x, counts[(x >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]))[:k]])
                most.append(limit[:k])
                of.append(np.full(k, i))
            if of:
                at = pa.array(np.concatenate(of))
                n, ids, label, sketch = (batch.column(i).take(at) for i in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), n, pa.array(np.concatenate(most), pa.int64()), ids, label, sketch], names=["shingle", "n", "most", "id", "label", "sketch"])

    return run


def _spans(low: np.ndarray, high: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of every j in low[i] to high[i] - 1, about ``most`` at a time."""
    length = np.maximum(high - low, 0)
    ends, at = np.cumsum(length), 0
    while at < len(low):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        n = length[at:to]
        yield np.repeat(np.arange(at, to), n), np.arange(n.sum()) + np.repeat(low[at:to] - (np.cumsum(n) - n), n)
        at = to


def _sharing(forest: Forest):
    """Pairs of different labels that may reach the threshold, of rows sorted by (shingle, n)."""
    percent = forest.percent

    def of_shingle(n: np.ndarray, most: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        names, rows = np.unique(label, return_counts=True)
        few = np.flatnonzero(label != names[rows.argmax()])  # every pair has one of these
        shorter = np.flatnonzero(most >= n)  # may be the shorter set of a pair
        x = few[most[few] >= n[few]]
        for i, j in _spans(np.searchsorted(n, n[x], "left"), np.searchsorted(n, np.minimum(100 * n[x] // percent, most[x]), "right")):
            yield x[i], j
        y = n[shorter]
        for i, j in _spans(np.searchsorted(y, -(-percent * n[few] // 100), "left"), np.searchsorted(y, np.minimum(n[few], most[few]), "right")):
            yield few[i], shorter[j]

    def pairs(shingle, n, most, ids, label, sketch) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        live = (np.minimum.reduceat(label, starts) < np.maximum.reduceat(label, starts)) & np.logical_or.reduceat(most >= n, starts)
        ends = np.append(starts[1:], len(shingle))
        made: list[np.ndarray] = []
        waiting = 0

        def batch() -> pa.RecordBatch:
            at = np.unique(np.concatenate(made), axis=0)
            alike = _alike(forest, sketch[at[:, 0]], sketch[at[:, 1]])
            return _ordered(ids[at[:, 0]], ids[at[:, 1]], alike)

        for lo, hi in zip(starts[live], ends[live], strict=True):
            for i, j in of_shingle(n[lo:hi], most[lo:hi], label[lo:hi]):
                i, j = i + lo, j + lo
                keep = (label[i] != label[j]) & (most[j] >= n[i]) & (most[i] >= n[j])
                i, j = i[keep], j[keep]
                near = _alike(forest, sketch[i], sketch[j]) >= forest.least_alike
                if near.any():
                    made.append(np.column_stack([i[near], j[near]]))
                    waiting += int(near.sum())
                    if waiting > 1 << 19:
                        yield batch()
                        made, waiting = [], 0
        if made:
            yield batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # pieces of the shingle that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)), _matrix(batch.column(5), np.dtype("<u8"))]
            last = int(np.searchsorted(now[0], now[0][-1], "left"))
            if last == 0 and (not held or held[0][0][0] == now[0][0]):
                held.append(now)
                continue
            yield from pairs(*(np.concatenate(x) for x in zip(*held, [x[:last] for x in now], strict=True)))
            held = [[x[last:] for x in now]]
        if held:
            yield from pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def across_labels(crowded: DataFrame, sets: DataFrame, forest: Forest) -> DataFrame:
    """(a, b): all pairs of different labels that can reach the threshold and pass the sketch; pairs may repeat.

    ``crowded`` has (n, id, label, sketch, shingles), ``sets`` the shingles of these
    and more classes; how common they are there only decides the order in which
    shingles lead.  No number of classes is too large to meet; shingles found under
    one label only are left where they are.
    """
    spark = crowded.sparkSession
    with arrow_rows(spark, 500):
        seen = sets.select("shingles").mapInArrow(_rarity, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(1 << RARITY_BITS, np.int64)
        counts[seen.column("bucket").to_numpy()] = seen.column("n").to_numpy()
        rows = crowded.select("n", "id", "label", "sketch", "shingles").mapInArrow(_leading(forest, counts), "shingle bigint, n bigint, most bigint, id bigint, label bigint, sketch binary")
        bucket = F.pmod("shingle", F.lit(FILTER_BUCKETS))
        mixed = rows.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max(F.col("most") >= F.col("n")).alias("meet")).filter("x < y and meet")
        kept = mixed.select(bucket.alias("bucket")).distinct()
        live = rows.withColumn("bucket", bucket).join(F.broadcast(kept), "bucket", "left_semi").drop("bucket")
        sorted_rows = live.repartition("shingle").sortWithinPartitions("shingle", "n", "id")
    with arrow_rows(spark, 10_000):
        return sorted_rows.mapInArrow(_sharing(forest), "a bigint, b bigint, alike float").select("a", "b")


def _rows(forest: Forest):
    """One row per class and tree: (tree, path, id, n, sketch)."""
    step = 2 * forest.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, orders = batch.num_rows, batch.column(2).to_pylist()
            for t in range(forest.trees):
                paths = pa.array([x[t * step : (t + 1) * step] for x in orders], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), paths, batch.column(0), batch.column(1), batch.column(3)], names=["tree", "path", "id", "n", "sketch"])

    return run


def _edge_rows(reach: int, starts: list[int]):
    """The ``reach`` rows on either side of each border, over as many partitions as they take, tagged with the border.

    ``starts`` has the number of the first row of every partition up to the last that has rows.
    """
    places = np.unique([x for x in starts if x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        at = starts[part] if part < len(starts) else 0  # no rows follow the last that has any
        for batch in batches:
            end = at + batch.num_rows
            for place in places[np.searchsorted(places, at - reach, "right") : np.searchsorted(places, end + reach, "left")].tolist():
                low, high = max(at, place - reach), min(end, place + reach)
                if low < high:
                    rows = batch.slice(low - at, high - low)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(rows.num_rows, place, np.int64))], names=[*rows.schema.names, "border"])
            at = end

    return run


def candidates(classes: DataFrame, forest: Forest) -> DataFrame:
    """(a, b, alike): near neighbours in the forest's sorted orders, once each, a < b; a = b for crowded classes."""
    pair = "a bigint, b bigint, alike float"
    row = "tree int, path binary, id bigint, n bigint, sketch binary"
    names = [x.split()[0] for x in row.split(", ")]
    meet = _neighbours(forest)
    with arrow_rows(classes.sparkSession, 10_000):
        rows = classes.select("id", "n", "orders", "sketch").mapInArrow(_rows(forest), row)
        ordered = checkpointed(rows.repartitionByRange("tree", "path", "id").sortWithinPartitions("tree", "path", "id"))
        inside = ordered.mapInArrow(meet, pair)
        sizes = {r["part"]: r["count"] for r in ordered.groupBy(F.spark_partition_id().alias("part")).count().collect()}
        starts = np.cumsum([0, *(sizes.get(i, 0) for i in range(max(sizes, default=0)))]).tolist()
        borders = ordered.mapInArrow(_edge_rows(forest.reach, starts), row + ", border bigint").repartition("border").sortWithinPartitions("border", "tree", "path", "id").select(*names)
        return checkpointed(inside.union(borders.mapInArrow(meet, pair)).groupBy("a", "b").agg(F.max("alike").alias("alike")))


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            made = [shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest = Forest()) -> DataFrame:
    """(id, n_shingles, component_id, kept): one row per input row."""
    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    spark = df.sparkSession
    with arrow_rows(spark, 2000):
        signed = checkpointed(source.mapInArrow(_signatures(forest), "id bigint, n bigint, h1 bigint, h2 bigint, orders binary, sketch binary"))
    known = signed.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = checkpointed(known.groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.first("orders").alias("orders"), F.first("sketch").alias("sketch")))
    near = candidates(classes, forest)
    pairs, crowd = near.filter("a < b"), near.filter("a = b").select(F.col("a").alias("id"))

    ends = near.select(F.col("a").alias("id")).union(near.select("b"))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BUCKETS))
    # At most FILTER_BUCKETS numbers whatever the input: they keep texts that are no candidates from being moved.
    kept = F.broadcast(ends.select(bucket("id").alias("bucket")).distinct())
    texts = source.filter(F.col("id").isNotNull()).withColumn("bucket", bucket("id")).join(kept, "bucket", "left_semi").select("id", "text")
    with arrow_rows(spark, 500):
        sets = checkpointed(texts.join(ends.distinct(), "id", "left_semi").mapInArrow(_sets(forest.width), "id bigint, shingles binary"))

    # The most alike pairs of each class, then all that could join different components.
    both = pairs.select("a", "b", "alike", F.col("a").alias("id")).union(pairs.select("a", "b", "alike", F.col("b").alias("id")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("alike"), "a", "b"))
    first = both.withColumn("rank", rank).filter("rank <= 3").select("a", "b").distinct()
    with arrow_rows(spark, 500):
        found = components(checkpointed(confirmed(first, sets, forest.percent)))
        of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        apart = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
        labelled = classes.join(crowd, "id").join(found, F.col("id") == F.col("node"), "left").withColumn("label", F.coalesce("component", "id"))
        crowded = checkpointed(labelled.join(sets, "id").select("n", "id", "label", "sketch", "shingles"))
    more = checkpointed(apart.union(across_labels(crowded, sets, forest)).distinct())
    joins = Observation()
    with arrow_rows(spark, 500):
        new = checkpointed(confirmed(more, sets, forest.percent).observe(joins, F.count(F.lit(1)).alias("rows")))
    if joins.get.get("rows"):
        found = components(new.union(found.select("component", "node")))

    roots = classes.select("h1", "h2", "n", "id").join(found, F.col("id") == F.col("node"), "left")
    roots = roots.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("n").alias("kn"), F.coalesce("component", "id").alias("root"))
    # texts without a set are spread by id, they meet no class
    spread = signed.select("id", "n", F.when(F.col("n") > 0, F.col("h1")).otherwise(F.xxhash64("id")).alias("h1"), "h2")
    joined = spread.join(roots, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("n") == F.col("kn")), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return joined.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest = Forest()) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each class the row with the smallest id stays.

    Rows that share an id are one document, of which the row that comes first by
    a hash of all its columns stays; rows with a null id are no document of any
    class and stay.
    """
    found = near_duplicates(df, id_col, text_col, forest)
    gone = checkpointed(found.filter("not kept").select(F.col("id").alias("gone")).distinct())
    parts = hashable(df)
    rows = df.select(F.struct(*quoted(df)).alias("row"), F.col(id_col).alias("id"), F.xxhash64(*parts).alias("p1"), F.hash(*parts).alias("p2"))
    named = rows.filter(F.col("id").isNotNull()).join(gone, F.col("id") == F.col("gone"), "left_anti")
    place = F.row_number().over(Window.partitionBy("id").orderBy("p1", "p2"))
    one = named.withColumn("place", place).filter("place = 1").select("row")
    return one.union(rows.filter(F.col("id").isNull()).select("row")).select("row.*")
