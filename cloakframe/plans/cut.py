"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    A local session (tests) gets a folder of its own where none is set; on a
    cluster that would be a folder which others do not see, so it is an error.
    """
    sc = spark.sparkContext
    set_by_hand = sc._jsc.sc().getCheckpointDir()
    where = spark.conf.get("spark.checkpoint.dir", None) or (set_by_hand.get() if set_by_hand.isDefined() else None)
    if where is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return where or tempfile.mkdtemp(prefix="cloakframe-")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read again.

    For loops: a checkpoint keeps the estimated size of its plan, which every
    join multiplies, so that after some rounds planning takes longer than the
    work; files have the size they have.  Rows may come in another order.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    at = f"{sc._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
