"""A training corpus from raw documents: five stages, each on all that the one before kept.

1. quality: rejected documents go.
2. near duplicates: one document of each group stays (five words, 0.8).
3. secrets: every span found is replaced by a mark, ``n_chars`` follows.
4. mixing: no document goes; rows and files are put in the order of the mix.
5. packing: sequences and step groups, file by file in that order.

Nulls, empty and very long texts, repeated rows and empty tables are treated as
each operator says; further columns pass through the first four stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import mixing, near_dedup, packing, quality_rules, secret_scan
from cloakframe.llm.common import quoted, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs).select(*quoted(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = secret_scan.with_redaction(docs.select(F.struct(*quoted(docs)).alias("row"), F.col("text")), "clean")
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("clean") != F.col("text"), F.char_length("clean").cast(kind)).otherwise(F.col("row.n_chars"))
    return marked.select(*[changed.get(c, F.col(f"row.{name}")).alias(c) for c, name in zip(docs.columns, quoted(docs), strict=True)])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mix_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, packing.Plan(public_tokenizers.path("byte_bpe_50k.json")))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack)]

#: Expectation maximisation, mixing and packing can't be written in SQL; tests compare the stages with plain versions.
ORACLE_SQL: str | None = None


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written in the shared folder and read again.

    A stage's rows are removed when those of the next are written, and all of
    them where a stage fails; the rows that the result itself is read from stay.
    """
    place = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    try:
        for k, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                at = f"{place}/{k}"
                docs.write.parquet(at)
                docs = spark.read.parquet(at)
                if before is not None:
                    _remove(spark, before)
                before = at
    except BaseException:
        _remove(spark, place)
        raise
    return docs
