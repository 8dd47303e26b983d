"""Language identification: sparse multinomial regression on character n-grams.

Features are hashed character n-grams weighted by TF-IDF.  Document frequencies
come from all training rows.  The weights are fitted by follow-the-regularised-
leader (proximal, per coordinate) with elastic-net penalties, on a sample of at
most ``Settings.most_rows`` training rows of whole texts, taken by a hash of the
id; a part of that sample is kept from the fit to set the temperature that
calibrates the scores.

Defined results: a null text or one without a letter is ``und`` with score 0, as
is every text when there is nothing to learn from; very long texts are read as a
whole; repeated rows are predicted alike; rows with a null id take part in
prediction and not in training; an empty table gives an empty table.  Only the
named columns are read; language and id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import small

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    most_rows: int = 3000
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.2
    held_for_temperature: int = 5  # one in so many sampled rows

    @property
    def size(self) -> int:
        return 1 << self.bits


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text)) if text else False


def counts(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of a whole text, and how often each occurs."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total = np.zeros(settings.size, np.int64)
    mixed = np.zeros(len(codes), np.uint64)
    for order in range(1, max(settings.orders) + 1):
        if order > len(codes):
            break
        mixed = (mixed[: len(codes) - order + 1] + codes[order - 1 :] + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        if order in settings.orders:
            total += np.bincount((mixed >> np.uint64(7)).astype(np.int64) & (settings.size - 1), minlength=settings.size)
    at = np.flatnonzero(total)
    return at, total[at]


def _frequencies(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(settings.size, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if has_letter(text := text.as_py()):
                    at, _ = counts(text, settings)
                    seen[at] += 1
                    rows += 1
        if rows:
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], rows), pa.int64())], names=["bucket", "n"])

    return run


def _hashed(settings: Settings):
    """(place, id, lang, buckets, counts) of texts with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small((whole,), 64):
                texts = batch.column(3).to_pylist()
                read = [i for i, t in enumerate(texts) if has_letter(t)]
                at, n = zip(*(counts(texts[i], settings) for i in read), strict=True) if read else ((), ())
                kept = batch.select([0, 1, 2]).take(pa.array(read, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], names=["place", "id", "lang", "at", "n"])

    return run


@dataclass
class Model:
    settings: Settings
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (size, languages)
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / (np.linalg.norm(x) or 1.0)

    def logits(self, text: str) -> np.ndarray:
        at, x = self.features(*counts(text, self.settings))
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, settings: Settings) -> Model:
    """FTRL-proximal on (buckets, counts, language) rows in the order given, then the temperature."""
    languages = sorted({lang for _, _, lang in rows})
    k = len(languages)
    model = Model(settings, languages, idf, np.zeros((settings.size, k)), np.zeros(k))
    if not rows:
        return model
    made = [(*model.features(at, n), languages.index(lang)) for at, n, lang in rows]
    kept = made[:: settings.held_for_temperature] if len(made) >= 10 * settings.held_for_temperature else []
    learnt = [m for i, m in enumerate(made) if not kept or i % settings.held_for_temperature]
    # one more coordinate, always 1, is the bias
    z, n = np.zeros((settings.size + 1, k)), np.zeros((settings.size + 1, k))

    def lazy(at: np.ndarray) -> np.ndarray:
        weight = -(z[at] - np.sign(z[at]) * settings.l1) / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2)
        return np.where(np.abs(z[at]) <= settings.l1, 0.0, weight)

    for _ in range(settings.epochs):
        for at, x, target in learnt:
            at, x = np.append(at, settings.size), np.append(x, 1.0)
            w = lazy(at)
            error = _softmax(x @ w)
            error[target] -= 1
            gradient = np.outer(x, error)
            step = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / settings.alpha
            z[at] += gradient - step * w
            n[at] += gradient**2
    every = lazy(np.arange(settings.size + 1))
    model.weights, model.bias = every[:-1], every[-1]
    if kept:
        logits = np.array([x @ model.weights[at] + model.bias for at, x, _ in kept])
        target = np.array([t for _, _, t in kept])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        loss = [-np.log(np.maximum(1e-12, _softmax(logits / t)[np.arange(len(target)), target])).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train(rows: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from ``rows`` (id, text, lang), none null.

    What the driver gets is bounded: ``2 ** bits`` document frequencies, and as
    many counts at most for each of ``most_rows`` sampled rows; texts stay where
    they are.
    """
    order = F.crc32(F.concat(F.lit("sample|"), F.col("id").cast("string")))
    seen = rows.select("text").mapInArrow(_frequencies(settings), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    table = {r["bucket"]: r["n"] for r in seen}
    total = table.pop(-1, 0)
    frequency = np.zeros(settings.size)
    frequency[list(table)] = list(table.values())
    idf = np.log((1 + total) / (1 + frequency)) + 1
    # a hash limit that leaves some more rows than wanted keeps the others out of the sort
    share = min(1.0, 2 * settings.most_rows / max(total, 1)) if total > 4 * settings.most_rows else 1.0
    hashed = rows.filter(order < int(share * 2**32) + 1).select(order.alias("place"), "id", "lang", "text").mapInArrow(_hashed(settings), f"place bigint, id {dict(rows.dtypes)['id']}, lang string, at array<int>, n array<int>")
    sampled = hashed.orderBy("place", "id", "lang").limit(settings.most_rows).select("at", "n", "lang").toArrow()
    made = zip(*(sampled.column(c).combine_chunks() for c in ("at", "n", "lang")), strict=True)
    return fit([(np.asarray(at.values), np.asarray(n.values), lang.as_py()) for at, n, lang in made], idf, settings)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    return run


def identify_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: Column | None = None, settings: Settings = Settings()) -> DataFrame:
    """(id, held_out, lang_pred, score): one row per input row.

    ``held_out`` (over the column ``id``) marks rows that are not learnt from;
    by default crc32 of the id as text, modulo 5, is 0.
    """
    held = F.crc32(F.col("id").cast("string")) % 5 == 0 if held_out is None else held_out
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).withColumn("held_out", F.coalesce(held, F.lit(False)))
    model = train(rows.filter(~F.col("held_out") & F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("id", "text", "lang"), settings)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()
    return rows.select("id", "text", "held_out").mapInArrow(_predict(shared), f"id {kind}, held_out boolean, lang_pred string, score double")
