"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_GAP = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it any number of times in ``body``.

    A column that a lambda refers to is evaluated again for every element; a
    lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(df: DataFrame) -> list[str]:
    """Column names as they can be selected, whatever signs they hold."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def hashable(df: DataFrame) -> list[Column]:
    """The columns of ``df`` as they can be hashed: maps have no hash, their JSON text has."""

    def has_map(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return has_map(kind.elementType)
        if isinstance(kind, T.StructType):
            return any(has_map(f.dataType) for f in kind.fields)
        return isinstance(kind, T.MapType)

    text = lambda c: F.to_json(F.struct(F.col(c).alias("c")))
    return [text(c) if has_map(f.dataType) else F.col(c) for c, f in zip(quoted(df), df.schema.fields, strict=True)]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session (tests) gets one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return where or tempfile.mkdtemp(prefix="shared-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, so that a worker makes little of them at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Wide rows go to Python in batches of at most ``rows`` while jobs run in here."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def running(values: Column, start: int, combine: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """For each number of an array, what those before it come to.

    A fold that appends copies its array at every step; blocks keep that linear.
    """
    empty = F.expr("cast(array() as array<int>)")
    number = lambda x: x.cast("int")

    def fold(part: Column, first: Column) -> Column:
        step = lambda s, x: F.struct(number(combine(s["v"], x)).alias("v"), F.concat(s["out"], F.array(s["v"])).alias("out"))
        return F.aggregate(part, F.struct(number(first).alias("v"), empty.alias("out")), step, lambda s: s["out"])

    def by_blocks(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda i: F.slice(x, i * block + 1, F.lit(block)))
        return let(parts, lambda p: F.flatten(F.zip_with(p, fold(F.transform(p, lambda one: F.aggregate(one, F.lit(start), lambda a, b: number(combine(a, b)))), F.lit(start)), fold)))

    return let(values, lambda x: F.when(F.size(x) <= block, fold(x, F.lit(start))).otherwise(by_blocks(x)))


def spliced(text: Column, spans: Column, new: Callable[[Column], Column]) -> Column:
    """``text`` with its spans (start, end; sorted, apart from each other) replaced.

    Where many are to be replaced the text is cut into characters once, because
    a substring is looked for from the beginning.
    """
    before = lambda s: F.transform(s, lambda x, i: F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1)["end"]))

    def pieces(s: Column, cut: Callable[[Column, Column], Column]) -> Column:
        ahead = F.zip_with(s, before(s), lambda x, at: F.concat(cut(at, x["start"] - at), new(x)))
        last = F.element_at(s, -1)["end"]
        return F.concat(F.array_join(ahead, ""), cut(last, F.char_length(text) - last))

    few = lambda s: pieces(s, lambda at, n: F.substr(text, at + 1, n))
    many = lambda s: let(F.split(text, ""), lambda c: pieces(s, lambda at, n: F.array_join(F.slice(c, at + 1, n), "")))
    return F.when(F.size(spans) == 0, text).otherwise(let(spans, lambda s: F.when(F.size(s) <= 64, few(s)).otherwise(many(s))))


def apart(known: Column, more: Column) -> Column:
    """Those of ``more`` that overlap none of ``known`` (arrays of structs with start and end), by one sweep over both."""

    def sweep(both: Column) -> Column:
        old = lambda f, other: F.transform(both, lambda x: F.when(x["old"], x["span"][f]).otherwise(other))
        reach = running(old("end", -1), -1, lambda a, b: F.greatest(a, b))
        coming = F.reverse(running(F.reverse(old("start", (1 << 31) - 1)), (1 << 31) - 1, lambda a, b: F.least(a, b)))
        begun = F.zip_with(both, reach, lambda x, r: F.struct(x["span"].alias("span"), (~x["old"] & (r <= x["span"]["start"])).alias("fits")))
        marked = F.zip_with(begun, coming, lambda x, c: F.struct(x["span"].alias("span"), (x["fits"] & (c >= x["span"]["end"])).alias("fits")))
        return F.transform(F.filter(marked, lambda x: x["fits"]), lambda x: x["span"])

    tagged = lambda spans, old: F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(old).alias("old"), s.alias("span")))
    both = F.array_sort(F.concat(tagged(known, True), tagged(more, False)))
    return F.when((F.size(known) == 0) | (F.size(more) == 0), more).otherwise(let(both, sweep))


def words(text: Column) -> Column:
    """Whitespace-separated words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1), "")


def unit(key: Column, salt: Column | str) -> Column:
    """A draw in (0, 1) decided by key and salt: 52 bits of an MD5 digest."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    digest = F.md5(F.concat(key, F.lit("|"), salt))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
