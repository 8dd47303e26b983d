"""k-Same: images replaced by the mean of a cluster of at least k.

Images are rows with an array of pixels.  Clusters are found in the space of
principal components; averaging the components and turning back equals averaging
pixels as long as no component is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.operators.clustering import Points, blocks_of, mdav, random_choice
from cloakframe.operators.components import PrincipalComponents, matrix_of
from cloakframe.plans.cut import cut
from cloakframe.plans.roles import RID

EMPTY = 1e-9


@dataclass(frozen=True)
class KSame:
    """``variant``: pixel or eigen; ``algorithm``: random or mdav."""

    k: int
    variant: str = "pixel"
    algorithm: str = "random"
    n_components: int | None = None
    seed: int = 0
    block_rows: int = 20_000

    def anonymise(self, images: DataFrame, block: str | None = None) -> DataFrame:
        """(image_id, cluster, pixels) of ``images`` (image_id, pixels array<double>).

        ``image_id`` is unique, images have one size and finite pixels.  Without a block
        column the components are those of all images, found, scaled and averaged over
        the whole table; up to ``block_rows`` images are clustered as one block, more
        are first cut by median splits of the leading components, an approximation of
        clustering them whole.  ``images`` is read several times.

        With a block column each block is decomposed and clustered by itself, in one
        task: its images have to fit there.
        """
        if self.variant not in ("pixel", "eigen") or self.algorithm not in ("random", "mdav"):
            raise ValueError("variant is pixel or eigen, algorithm random or mdav")
        if self.k < 1:
            raise ValueError("k is at least 1")
        return self._whole(images) if block is None else self._by_block(images, block)

    def _whole(self, images: DataFrame) -> DataFrame:
        images = images.select(F.col("image_id").cast("bigint").alias("image_id"), F.col("pixels").cast("array<double>").alias("pixels"))
        model = PrincipalComponents.fit(images, "pixels", self.n_components)
        scaled, held = self.algorithm == "mdav", len(model.variances)
        space = cut(model.project(images, "image_id", "pixels", scaled))
        if model.count > self.block_rows and held:
            leading = [f"c{n}" for n in range(min(held, 4))]
            found = blocks_of(space.select(F.col("image_id").alias(RID), *[F.get("components", F.lit(n)).alias(c) for n, c in enumerate(leading)]), leading, self.k, self.block_rows)
            blocked = space.join(found.withColumnRenamed(RID, "image_id"), "image_id")
        else:
            blocked = space.withColumn("block", F.lit("all"))
        me = self
        # sums come in any order, so last digits differ from run to run: they must not decide ties
        unit = 1.0 if scaled or not held else float(np.sqrt(model.variances[0]))

        def assign(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("image_id", kind="stable")
            inner = np.round(np.array(pdf["components"].tolist(), dtype=float).reshape(len(pdf), held) / unit, 9)
            points = Points(inner, np.empty((len(pdf), 0), int), False)
            cluster = mdav(points, me.k) if scaled else random_choice(points, me.k, me.seed)
            return pd.DataFrame({"image_id": pdf["image_id"].to_numpy(), "cluster": [f"{b}:{c}" for b, c in zip(pdf["block"], cluster, strict=True)]})

        def average(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = 0.0, 0
            for batch in batches:
                if batch.num_rows:
                    total, n = total + matrix_of(batch.column("v"), width).sum(axis=0), n + batch.num_rows
            mean = total / n
            if me.variant == "eigen":
                mean = model.restore(mean * np.sqrt(model.variances) if scaled else mean)
            yield pa.RecordBatch.from_pydict({"cluster": pa.array([key[0].as_py()]), "pixels": pa.array([mean], pa.list_(pa.float64()))})

        found = cut(blocked.groupBy("block").applyInPandas(assign, "image_id bigint, cluster string"))
        values = images.withColumnRenamed("pixels", "v") if self.variant == "pixel" else space.withColumnRenamed("components", "v")
        width = len(model.mean) if self.variant == "pixel" else held
        means = values.join(found, "image_id").select("cluster", "v").groupBy("cluster").applyInArrow(average, "cluster string, pixels array<double>")
        return found.join(means, "cluster").select("image_id", "cluster", "pixels")

    def _by_block(self, images: DataFrame, block: str) -> DataFrame:
        me = self

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("image_id", kind="stable")
            x = np.array(pdf["pixels"].tolist(), dtype=float)
            mean = x.mean(axis=0)
            _, s, axes = np.linalg.svd(x - mean, full_matrices=False)
            kept = s > EMPTY * max(1.0, s.max(initial=0.0))
            kept[me.n_components if me.n_components is not None else len(kept) :] = False
            axes = axes[kept]
            inner = (x - mean) @ axes.T
            points = Points(inner, np.empty((len(x), 0), int), me.algorithm == "mdav")
            cluster = mdav(points, me.k) if me.algorithm == "mdav" else random_choice(points, me.k, me.seed)
            out = np.empty_like(x)
            for c in np.unique(cluster):
                at = cluster == c
                out[at] = x[at].mean(axis=0) if me.variant == "pixel" else inner[at].mean(axis=0) @ axes + mean
            return pd.DataFrame({"image_id": pdf["image_id"].to_numpy(), "cluster": [f"{b}:{c}" for b, c in zip(pdf["block"], cluster, strict=True)], "pixels": list(out)})

        blocked = images.select(F.col("image_id").cast("bigint").alias("image_id"), F.col("pixels").cast("array<double>").alias("pixels"), F.col(block).cast("string").alias("block"))
        return blocked.groupBy("block").applyInPandas(run, "image_id bigint, cluster string, pixels array<double>")
