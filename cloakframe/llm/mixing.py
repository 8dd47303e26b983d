"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks.  In the ideal mix every source advances at
the rate of its weight, without whole blocks; when one is used up, the weights of
the others are scaled up.  Block j of a source may run from the slot in which the
ideal mix begins it and must have run by the end of the slot in which the ideal
mix ends it: floor(j / w) and ceil((j + 1) / w) while no source is used up.  Of
the released blocks the one with the earliest deadline runs.  The ideal mix fits
these windows, so no deadline is missed, every slot is used and every prefix of
the mix deviates from the ideal by less than one block a source, however long it
is.  Windows are computed from the given weights in whole numbers, not rounded.

One task deals all blocks, slot by slot, some 4 microseconds each; it holds a few
numbers a source and sees no documents.  ``Mix.block_rows`` sets how many
documents a block has, and with it how long that takes on a large table.  No
document is dropped or repeated.

Defined results: a null source is a source of its own; repeated rows are placed
one by one; sources of any number have windows of their own;
an empty table gives an empty table.  Only id and source are read.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import checkpointed, quoted
from cloakframe.llm.sharding import number_rows


@dataclass(frozen=True)
class Mix:
    block_rows: int = 16
    flatten: float = 0.5  # default targets: share of rows to this power


def deal(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of every block, slot by slot: release <= slot < deadline."""
    if any(not 0 < weights[s] < math.inf for s in blocks):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(weights[s]) for s in blocks}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    share = {s: int(w * scale) for s, w in exact.items()}
    # The ideal mix at time v has dealt min(blocks, v * share) of each source; the k-th end is that of order[k].
    order = sorted((s for s, n in blocks.items() if n), key=lambda s: (Fraction(blocks[s], share[s]), s))
    ends = [blocks[s] / share[s] for s in order]
    used, rate = [0], [sum(share[s] for s in order)]
    for s in order:
        used.append(used[-1] + blocks[s])
        rate.append(rate[-1] - share[s])

    def begun(s: str, j: int, up: bool) -> int:
        """The length of the ideal mix when it has dealt ``j`` blocks of ``s``, rounded down or up."""
        a = share[s]
        k = bisect_right(ends, j / a)
        while k and blocks[order[k - 1]] * a > j * share[order[k - 1]]:
            k -= 1
        while k < len(order) and blocks[order[k]] * a < j * share[order[k]]:
            k += 1
        return used[k] - (-j * rate[k] // a) if up else used[k] + j * rate[k] // a

    coming = [(0, s, 0) for s in sorted(order)]
    ready: list[tuple[int, str, int, int]] = []
    for slot in range(used[-1]):
        while coming and coming[0][0] <= slot:
            release, s, j = heapq.heappop(coming)
            heapq.heappush(ready, (begun(s, j + 1, True), s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        yield s, j, slot, release, deadline
        if j + 1 < blocks[s]:
            heapq.heappush(coming, (begun(s, j + 1, False), s, j + 1))


def _dealt(mix: Mix, weights: Mapping[str, float] | None):
    """(__name, block, slot, release, deadline) of all blocks, from the rows (name, number of rows) of all sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = {s: n for batch in batches for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)}
        targets = {s: float(n) ** mix.flatten for s, n in counted.items()}
        if weights is not None:
            least = min(weights.values())
            targets = {s: weights.get(s[1:] if s.startswith("=") else s, least) for s in counted}
        blocks = deal({s: -(-n // mix.block_rows) for s, n in counted.items()}, targets)
        while some := list(islice(blocks, 50_000)):
            name, *numbers = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], names=["__name", "block", "slot", "release", "deadline"])

    return run


def mix_sources(df: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", mix: Mix = Mix(), extra: dict[str, Column] | None = None) -> tuple[DataFrame, int]:
    """((id, source, block, slot, position, release, deadline, extra...), number of slots).

    Positions order the whole mix; block b of a source takes one slot, not before
    its release and before its deadline.
    ``weights`` maps source names to targets (names without one get the smallest).
    """
    extra = extra or {}
    named = F.when(F.col(source_col).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), named.alias("__name"), *[c.alias(k) for k, c in extra.items()])
    sources = checkpointed(rows.groupBy("__name").count())
    slots = sources.agg(F.sum(F.ceil(F.col("count") / mix.block_rows))).first()[0] or 0
    dealt = checkpointed(sources.repartition(1).mapInArrow(_dealt(mix, weights), "__name string, block bigint, slot bigint, release bigint, deadline bigint"))
    numbered = number_rows(rows, "__name", ["id", "source", *extra]).withColumn("block", F.floor(F.col("slot") / mix.block_rows).cast("bigint")).withColumnRenamed("slot", "__n")
    placed = numbered.join(dealt, ["__name", "block"])
    return placed.select("id", "source", "block", "slot", (F.col("slot") * mix.block_rows + F.col("__n") % mix.block_rows).alias("position"), "release", "deadline", *extra), slots


def in_mix_order(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", rows_per_file: int = 8192) -> DataFrame:
    """``docs`` itself, its partitions and their rows in the order of the mix.

    Equal (id, source, text) rows stand next to each other.
    """
    crc = F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))
    placed, slots = mix_sources(docs, None, id_col, source_col, mix, {"__crc": crc})
    first = checkpointed(placed.groupBy(F.col("id").alias("of_id"), F.col("source").alias("of_source"), F.col("__crc").alias("of_crc")).agg(F.min("position").alias("position")))
    rows = docs.select(F.struct(*quoted(docs)).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), crc.alias("crc"))
    joined = rows.join(first, F.col("id").eqNullSafe(F.col("of_id")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("crc") == F.col("of_crc")))
    files = max(1, -(-slots * mix.block_rows // rows_per_file))
    part = F.least(F.floor(F.col("position") * files / max(1, slots * mix.block_rows)), F.lit(files - 1)).cast("int")
    return joined.repartitionById(files, part).sortWithinPartitions("position").select("row.*")
