"""What came before a row in the order of its group, without one task for the group.

Rows are dealt by ranges of (group, order), so that a hot group is spread over many
pieces; aggregates run within a piece, and over the totals of the pieces before it.
Few rows, by count, take one window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colinear.session import partitions, stored

#: Rows up to which one window does; totals of pieces up to which they are broadcast.
FEW, HEADS = 1_000_000, 200_000
MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def dealt(rows: DataFrame, keys: list[str], order: list[str], written: bool = False) -> DataFrame:
    """``rows`` in the shared folder; with ``_piece``, their range of (keys, order), unless there are few. ``written``: they are there already."""
    held = rows if written else stored(rows, "rows")
    if held.count() <= FEW:
        return held
    return stored(held.repartitionByRange(partitions(rows.sparkSession), *keys, *order).withColumn("_piece", F.spark_partition_id()), "pieces")


def before(rows: DataFrame, keys: list[str], order: list[str], **what: tuple[str, Column]) -> DataFrame:
    """Rows of ``dealt`` and, for each name, the ``sum``, ``max`` or ``min`` of a column over all rows before this one in its group; null for the first.

    The greatest struct that begins with the order is the row just before.
    """
    pieces = ["_piece"] if "_piece" in rows.columns else []
    within = Window.partitionBy(*keys, *pieces).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({name: MERGE[how](c).over(within) for name, (how, c) in what.items()})
    if not pieces:
        return own
    heads = rows.groupBy(*keys, "_piece").agg(*[MERGE[how](c).alias(name) for name, (how, c) in what.items()])
    # a row for each group and each piece that it has rows in
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_piece").alias("_at"), *[MERGE[how](name).over(earlier).alias(f"_{name}") for name, (how, _) in what.items()])
    heads = stored(heads.where(" or ".join(f"_{name} is not null" for name in what)), "heads")
    same = F.col("_piece") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    joined = own.join(F.broadcast(heads) if heads.count() <= HEADS else heads, same, "left")
    both = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "max": F.greatest, "min": F.least}
    return joined.withColumns({name: both[how](F.col(name), F.col(f"_{name}")) for name, (how, _) in what.items()}).select(*own.columns)


def numbered(rows: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Adds ``name``: how many rows of the group up to this one start an island."""
    flagged = rows.withColumn("_new", starts.cast("int"))
    return before(flagged, keys, order, **{name: ("sum", F.col("_new"))}).withColumn(name, F.coalesce(F.col(name), F.lit(0)) + F.col("_new")).drop("_new")


def folded(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[Iterator[tuple]], Iterator[tuple]], reads: list[str], schema: str) -> DataFrame:
    """``step`` over the rows (tuples of ``reads``, in order) of each island (``keys`` and ``island``), which are dealt by island: a task streams through its islands and holds none of them."""
    names = StructType.fromDDL(schema).names
    keyed = rows.select(F.xxhash64(*keys, "island").alias("_deal"), *keys, "island", *reads, *[c for c in order if c not in reads])
    sorted_ = keyed.repartition("_deal").sortWithinPartitions("_deal", *keys, "island", *order)
    n = len(keys) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def tuples() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*[b[c].tolist() for c in [*keys, "island", *reads]], strict=True)

        source, waiting = tuples(), []
        waiting += [next(source, None)]

        def island(key: tuple) -> Iterator[tuple]:
            while waiting[0] is not None and waiting[0][:n] == key:
                yield waiting[0][n:]
                waiting[0] = next(source, None)

        out: list[tuple] = []
        while waiting[0] is not None:
            key = waiting[0][:n]
            for found in step(island(key)):
                out.append((*key[:-1], *found))
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=[*keys, *names])
                    out = []
        yield pd.DataFrame(out, columns=[*keys, *names])

    kinds = dict(rows.dtypes)
    return sorted_.mapInPandas(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], schema]))
