"""Schemas as JSON files, and tables from files."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from cloakframe.operators.recoding import GlobalRecoding
from cloakframe.operators.schemas import GeneralisedSchema, HumanReadable, MachineReadable, Microaggregation, RawData

KINDS: dict[str, type[GeneralisedSchema]] = {k.__name__: k for k in (MachineReadable, HumanReadable, Microaggregation, RawData, GlobalRecoding)}


def schema_to_json(schema: GeneralisedSchema) -> str:
    return json.dumps(schema.to_json_dict() | {"schema_type": type(schema).__name__}, ensure_ascii=False)


def schema_from_json(text: str) -> GeneralisedSchema:
    found = json.loads(text)
    kind = found.get("schema_type")
    if kind not in KINDS:
        raise ValueError(f"unknown schema type: {kind}")
    return KINDS[kind].from_json_dict(found)


def _file(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for any address that Spark can write to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def save_schema(schema: GeneralisedSchema, path: str, spark: SparkSession | None = None) -> None:
    """Write a schema to a file of the driver or, with ``spark``, to any storage that Spark reaches."""
    if spark is None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(schema_to_json(schema))
        return
    system, at = _file(spark, path)
    out = system.create(at, True)
    try:
        out.write(bytearray(schema_to_json(schema), "utf-8"))
    finally:
        out.close()


def load_schema(path: str, spark: SparkSession | None = None) -> GeneralisedSchema:
    if spark is None:
        with open(path, encoding="utf-8") as f:
            return schema_from_json(f.read())
    system, at = _file(spark, path)
    stream = system.open(at)
    try:
        return schema_from_json(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def read_table(spark: SparkSession, path: str, kind: str = "parquet", columns: Sequence[str] | None = None, schema: str | None = None, header: bool = False) -> DataFrame:
    """Any table that Spark reads; CSV without a header gets ``columns`` as names."""
    reader = spark.read.format(kind)
    if schema:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", header)
    df = reader.load(path)
    return df.toDF(*columns) if columns else df


def write_release(release: DataFrame, path: str, seed: int | None = None, kind: str = "parquet") -> None:
    """Write a release; with ``seed`` its rows are dealt anew, so that order tells nothing."""
    from pyspark.sql import functions as F

    if seed is not None:
        release = release.withColumn("__o", F.rand(seed)).repartitionByRange("__o").sortWithinPartitions("__o").drop("__o")
    release.write.format(kind).save(path)
