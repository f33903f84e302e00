"""Session helpers that hold on one machine and on a cluster alike."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


#: Bytes that go to a Python worker at a time: whole texts are long, and two workers share an executor's memory.
BATCH = "2m"


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by ``BATCH``."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder; rows go to Python in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where that setting is unset and the master is local (tests on one machine) a folder under the
    warehouse is used and set as the checkpoint directory.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage (reliable checkpoint)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: as ``cut``, but compressed by column."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly: few small rows that each take long would share one task, as tasks are cut by bytes."""
    spark = df.sparkSession
    return df.repartition(max(partitions(spark), 2 * spark.sparkContext.defaultParallelism))


def release() -> None:
    """Hands memory that is free back to the system: Spark keeps its Python workers from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A generator of a Python stage that releases its memory at the end of each task."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def added(df: DataFrame, kinds: str, make: Callable[..., list[pa.Array]], reads: list[str], keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all, if not given) and new ones of the types ``kinds``, which ``make`` gives for each batch's columns ``reads``.

    A single Python stage whatever is done with the result: filters on the new
    columns can't make Spark evaluate them again. Kept columns of the new names go.
    """
    new = StructType.fromDDL(kinds)
    names = {f.name.lower() for f in new}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    more = [c for c in reads if c not in kept]
    rows = df.select(*[F.col(f"`{c}`") for c in [*kept, *more]])
    schema = StructType([*[StructField(f.name, f.dataType) for f in rows.schema[: len(kept)]], *new])
    places, n = [[*kept, *more].index(c) for c in reads], len(kept)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *make(*[b.column(i) for i in places])], schema.names)

    return rows.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
