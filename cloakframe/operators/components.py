"""Principal components of arrays of numbers, over a whole table.

Tasks add up products of centred rows and send them as strips of the matrix, which
are added in parallel; the driver decomposes a matrix whose size depends on the width of
the arrays only.  Rows are projected where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shares of the largest variance below which a component counts as empty.
EMPTY = 1e-12
STRIP = 65_536


def matrix_of(arrays: pa.Array, width: int) -> np.ndarray:
    """A row for each array; all are ``width`` long."""
    return arrays.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(arrays), width)


def summed(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
    """The sum of the arrays in ``v``, one batch in memory at a time."""
    total = None
    for batch in batches:
        if batch.num_rows:
            part = matrix_of(batch.column("v"), len(batch.column("v")[0])).sum(axis=0)
            total = part if total is None else total + part
    return total


def total_of(df: DataFrame, column: str, shape: tuple[int, int], each: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of ``each(rows)``, a matrix of ``shape``, over batches of rows of ``df``."""
    size = shape[0] * shape[1]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += each(matrix_of(batch.column(0), width)).ravel()
        for at in range(0, size, STRIP):
            strip = total[at : at + STRIP]
            if strip.any():
                yield pa.RecordBatch.from_pydict({"strip": pa.array([at // STRIP], pa.int32()), "v": pa.array([strip], pa.list_(pa.float64()))})

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"strip": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([summed(batches)], pa.list_(pa.float64()))})

    form = "strip int, v array<double>"
    out = np.zeros(size)
    for r in df.select(column).mapInArrow(parts, form).groupBy("strip").applyInArrow(add, form).collect():  # a matrix of the given shape
        out[r["strip"] * STRIP :][: len(r["v"])] = r["v"]
    return out.reshape(shape)


@dataclass(frozen=True)
class PrincipalComponents:
    """``axes``: orthonormal rows by falling variance, the largest number of each positive."""

    count: int
    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, column: str, n_components: int | None = None, widest: int = 2048, passes: int = 6, most_numbers: int = 1 << 24, seed: int = 0) -> PrincipalComponents:
        """Components of ``column``, arrays of one length without nulls, NaN or infinite numbers.

        Up to ``widest`` numbers a row the covariance matrix is decomposed.  Beyond
        it a subspace of ``n_components`` and ten more directions is turned towards the
        largest variances by ``passes`` passes over the table, an approximation; it is
        exact where it holds all rows, which is the case without ``n_components`` (then
        for at most ``widest`` rows).  Components without variance are left out.
        An empty table has none.  ``most_numbers`` bounds what workers are sent.
        """
        x = F.col(column).cast("array<double>")
        bad = x.isNull() | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        seen = df.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(x)).alias("lo"), F.max(F.size(x)).alias("hi"), F.count_if(bad).alias("bad")).first()
        if seen["bad"] or seen["lo"] != seen["hi"]:
            raise ValueError("arrays have one length and hold finite numbers only")
        n, width = seen["n"], seen["hi"] or 0
        if not n or not width:
            return cls(n, np.zeros(width), np.zeros((0, width)), np.zeros(0))
        rows = df.select(x.alias("v"))
        mean = total_of(rows, "v", (1, width), lambda m: m.sum(axis=0, keepdims=True), width)[0] / n

        def spread(basis: np.ndarray | None) -> np.ndarray:
            """The covariance matrix, times ``basis`` if there is one."""

            def each(m: np.ndarray) -> np.ndarray:
                m = m - mean
                return m.T @ (m if basis is None else m @ basis)

            return total_of(rows, "v", (width, width if basis is None else basis.shape[1]), each, width) / max(n - 1, 1)

        if width <= widest:
            variances, axes = np.linalg.eigh(spread(None))
        else:
            whole = n_components is None
            if whole and n - 1 > widest:
                raise ValueError(f"name n_components: rows of {width} numbers have more components than {widest}")
            held = min(width, max(n - 1, 1) if whole else min(n_components + 10, max(n - 1, 1)))
            if held * width > most_numbers:
                raise ValueError(f"{held} axes of {width} numbers are more than most_numbers")
            basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, held)))[0]
            for _ in range(2 if held >= n - 1 else passes):
                basis = np.linalg.qr(spread(basis))[0]
            inner = basis.T @ spread(basis)
            variances, turn = np.linalg.eigh((inner + inner.T) / 2)
            axes = basis @ turn
        order = np.argsort(-variances, kind="stable")[:n_components]
        variances, axes = variances[order], axes.T[order]
        floor = max(EMPTY * variances.max(initial=0.0), (EMPTY * max(1.0, np.abs(mean).max())) ** 2)
        axes, variances = axes[variances > floor], variances[variances > floor]
        largest = axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)]
        return cls(n, mean, axes * np.where(largest < 0, -1.0, 1.0)[:, None], variances)

    def project(self, df: DataFrame, key: str, column: str, scaled: bool = False) -> DataFrame:
        """(key bigint, components array<double>); ``scaled`` to a variance of one."""
        mean, axes, width = self.mean, self.axes / (np.sqrt(self.variances)[:, None] if scaled else 1.0), len(self.mean)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found = (matrix_of(batch.column(1), width) - mean) @ axes.T
                    starts = pa.array(np.arange(len(found) + 1) * len(axes), pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(starts, pa.array(found.ravel(), pa.float64()))], ["key", "components"])

        plain = df.select(F.col(key).cast("bigint").alias("key"), F.col(column).cast("array<double>").alias("v"))
        return plain.mapInArrow(run, "key bigint, components array<double>").withColumnRenamed("key", key)

    def restore(self, components: np.ndarray) -> np.ndarray:
        """Numbers of components that are not scaled."""
        return components @ self.axes + self.mean
