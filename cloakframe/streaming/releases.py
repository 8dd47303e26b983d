"""Releases from a stream: each micro-batch is one release for an attacker or a sink."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cloakframe.operators.attackers import BaseAttacker


def observe_stream(stream: DataFrame, attacker: BaseAttacker, present_columns: Sequence[str], present_targets: Callable[[int], DataFrame | Sequence[int]], checkpoint: str) -> StreamingQuery:
    """Feed every non-empty micro-batch to ``attacker.observe`` in order, each once.

    What the attacker knows lives in the session, so a checkpoint that has taken
    in releases already is an error: the attacker would miss them.  Start again
    with a new attacker and a new checkpoint.
    """
    spark = stream.sparkSession
    commits = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    if commits.getFileSystem(spark._jsc.hadoopConfiguration()).exists(commits):
        raise ValueError(f"{checkpoint} has releases that this attacker has not seen")
    seen: set[int] = set()

    def take(batch: DataFrame, number: int) -> None:
        if number not in seen and not batch.isEmpty():
            seen.add(number)
            attacker.observe(batch, present_columns, present_targets(number))

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
