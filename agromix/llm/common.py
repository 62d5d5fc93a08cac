"""What the operators share: scratch tables, files in the shared folder, joins that stand hot keys."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["HOT_SHARE", "apart", "bounded_batches", "hidden", "local_uri", "mapped", "materialise", "open_input", "open_output", "release", "scratch", "skew_safe_lookup", "tasks_for", "text_of"]

#: A key counts as hot when it holds at least this share of the rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1024
#: Bytes of an Arrow batch, but for a single row that is longer.
BATCH = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; unset, one of this process's own in local mode (tests), an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="agromix-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/agromix-{uuid.uuid4().hex}"
    atexit.register(_remove, folder)
    return folder


def _remove(folder: str) -> None:
    """Scratch goes when the driver's process ends; nothing of it outlives the results that read it."""
    with suppress(Exception):
        system, path = local_uri(folder)
        system.delete_dir(path)


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: a lineage cut that survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Removes tables that materialise() made, once nothing reads them any more."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            _remove(path)


def mapped(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow(f, schema)`` in batches of BATCH bytes.

    Batches are bounded by 10,000 rows or 64 MB otherwise, and each is held several times over on its way. The setting is
    the session's; a smaller one stays.
    """
    bounded_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def bounded_batches(spark: SparkSession) -> None:
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)i?b?", spark.conf.get(BATCH_SETTING).strip().lower()).groups()
    if not 0 < int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit] <= BATCH:
        spark.conf.set(BATCH_SETTING, str(BATCH))


def tasks_for(total: float | None, each: int, most: int = 1 << 16) -> int:
    """How many tasks read ``total`` (bytes, rows), at ``each`` a task. Rows that only point at data are dealt by this, as Spark would merge them by their own few bytes."""
    return int(min(max(-(-(total or 0) // each), 1), most))


def hidden(df: DataFrame) -> list[Column]:
    """All columns under names of their places, so that none meets the names an operator uses; unused ones are pruned."""
    return [F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(df.columns)]


def apart(df: DataFrame, *made: str) -> list[Column]:
    """The columns that hidden() renamed, but for names that an operator makes itself, in any case."""
    return [F.col(f"_own_{i}").alias(c) for i, c in enumerate(df.columns) if c.lower() not in {m.lower() for m in made}]


def text_of(name: str = "text") -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def skew_safe_lookup(left: DataFrame, right: DataFrame, key: str, rows: str, spread: str) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on ``key``, where any key may hold a large share of ``left``.

    ``right`` is materialised, has each key once and in ``rows`` the number of left rows with it. Keys with at least
    HOT_SHARE of all those rows (so 1024 at most) are broadcast; left rows found there get a key of their own, made of
    column ``spread``, for the shuffled join of the rest, so that no partition gathers them.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    least = max(2, -(-total // int(1 / HOT_SHARE)))
    values = [c for c in right.columns if c != key]
    named = lambda df, tag: df.select(F.col(key).alias(f"_{tag}_{key}"), F.lit(True).alias(f"_{tag}"), *(F.col(c).alias(f"_{tag}_{c}") for c in values))
    hot, cold = named(right.filter(F.col(rows) >= least), "hot"), named(right.filter(F.col(rows) < least), "cold")
    out = left.join(F.broadcast(hot), F.col(key) == F.col(f"_hot_{key}"), "left")
    kind = right.schema[key].dataType.simpleString()
    # should such a key equal a true one, the row found there is not used, so no result depends on it
    own = F.xxhash64(spread) if kind == "bigint" else F.concat(F.lit("\u0001"), F.coalesce(F.col(spread).cast("string"), F.lit(""))).cast(kind)
    out = out.withColumn("_key", F.when(F.col("_hot"), own).otherwise(F.col(key)))
    out = out.join(cold.hint("shuffle_hash"), F.col("_key") == F.col(f"_cold_{key}"), "left")
    return out.select(*left.columns, *(F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in values))


def local_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, for files that Spark has no writer for."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def open_output(folder: str, stem: str, ending: str) -> Iterator[tuple[str, pa.NativeFile]]:
    """A new file of this task attempt: (its URI, the stream).

    The attempt's number is in the name. Rows that a task returns so always speak of the very bytes that the same
    attempt wrote, and what lost or repeated attempts leave is never read.
    """
    context = TaskContext.get()
    name = f"{stem}-{context.partitionId():06d}-{context.taskAttemptId()}{ending}"
    system, path = local_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        yield f"{folder}/{name}", out


def open_input(uri: str) -> pa.NativeFile:
    system, path = local_uri(uri)
    return system.open_input_file(path)
