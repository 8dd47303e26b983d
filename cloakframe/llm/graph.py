"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cloakframe.llm.common import checkpointed

AT_ONCE = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the smallest node of each component to its other nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least, before = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(label, before[x], least)
        np.minimum.at(label, before[y], least)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars: as many links as nodes at most, and no long chains."""
    held = [np.empty(0, np.int64)] * 2
    waiting: list[list[np.ndarray]] = [[], []]

    def contracted() -> list[np.ndarray]:
        return list(stars(*(np.concatenate([h, *w]) for h, w in zip(held, waiting, strict=True))))

    for batch in batches:
        for w, column in zip(waiting, batch.columns, strict=True):
            w.append(column.to_numpy(zero_copy_only=False))
        if sum(map(len, waiting[0])) > AT_ONCE:
            held, waiting = contracted(), [[], []]
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in contracted()], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links`` (columns a, b); component is the smallest node.

    Links are first contracted in the partitions where they lie, then where
    those of one node meet.  Each round then takes the smallest label among the
    neighbours and after it the label of the label, so long chains shorten by
    halves.  Labels are written to the shared checkpoint folder between rounds.
    Links may repeat or be loops.
    """
    pair = "a bigint, b bigint"
    ends = links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    loops = ends.filter("a = b")
    near = ends.filter("a <> b").mapInArrow(_contract, pair).repartition("b").mapInArrow(_contract, pair)
    both = checkpointed(near.union(near.select("b", "a")).union(loops).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")))
    while True:
        least = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        seen = labels.join(least, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        changed = Observation()
        seen = checkpointed(seen.observe(changed, F.count_if(F.col("old") != F.col("component")).alias("rows")))
        if not changed.get.get("rows"):
            return labels
        # labels that are no roots: most rows meet none of them
        names = seen.select(F.col("component").alias("label")).distinct()
        moved = seen.filter("component <> node").select(F.col("node").alias("label"), F.col("component").alias("further")).join(names, "label", "left_semi")
        labels = checkpointed(seen.join(moved, F.col("component") == F.col("label"), "left").select("node", F.coalesce("further", "component").alias("component")))
