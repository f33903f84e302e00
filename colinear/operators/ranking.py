"""Global ranks without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colinear.session import cut


def global_rank(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Adds ``_rank`` (from 0) in the given order and returns the number of rows too.

    Rows are dealt by ranges of the order, counted by range, and ranked within it.
    """
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect())
    first, at = [], 0
    for part, n in sizes:
        first += [F.lit(part), F.lit(at)]
        at += n
    if not first:
        return dealt.withColumn("_rank", F.lit(0).cast("long")).drop("_part"), 0
    offset = F.element_at(F.create_map(*first), F.col("_part"))
    rank = (F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + offset).cast("long")
    return dealt.withColumn("_rank", rank).drop("_part"), at


def block_order(summary: DataFrame) -> DataFrame:
    """Summary rows with ``place``, their number (from 0) in the order of a block file: target, strand, query, start on the target, then the rest."""
    ranked, _ = global_rank(summary, ["t_name", "ori", "q_name", "t_start", "t_end", "q_start", "q_end", "ident"])
    return ranked.withColumnRenamed("_rank", "place")


def paired(a: DataFrame, b: DataFrame, key: str, every: bool = False) -> DataFrame:
    """Rows of two tables side by side, the key as ``a_key`` and ``b_key``: those of equal keys, or each with ``every`` one.

    Every pair is what the caller then asks for, and its rows are the product of both;
    a pairing of large tables belongs behind a seed search.
    """
    left, right = a.toDF(*[f"a_{c}" for c in a.columns]), b.toDF(*[f"b_{c}" for c in b.columns])
    return left.crossJoin(right) if every else left.join(right, F.col(f"a_{key}") == F.col(f"b_{key}"))


def values_at(rows: DataFrame, column: str, ranks: list[int], few: int = 10_000, buckets: int = 4096) -> list[float | None]:
    """The values of a numeric column at ``ranks`` (from 0, nulls left out; None beyond the last), exactly.

    Histograms of ``buckets`` buckets narrow the range round each rank until few rows or one
    value are left in it: no task holds more than the buckets, and the driver gets these or ``few`` values.
    """
    v = F.col(column).cast("double")
    total = rows.agg(F.count(column).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    out: dict[int, float | None] = {}
    for rank in set(ranks):
        n, lo, hi, below = total["n"], total["lo"], total["hi"], 0
        if not 0 <= rank < n:
            out[rank] = None
            continue
        while lo < hi and n > few:
            inside = rows.where(v.between(lo, hi))
            bucket = F.least(F.floor((v - lo) / ((hi - lo) / buckets)), F.lit(buckets - 1))
            found = sorted((r["lo"], r["hi"], r["n"]) for r in inside.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect())
            for lo, hi, n in found:  # noqa: B007
                if rank < below + n:
                    break
                below += n
        out[rank] = lo if lo == hi else sorted(r[0] for r in rows.where(v.between(lo, hi)).select(v).collect())[rank - below]
    return [out[r] for r in ranks]


def medians(rows: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The exact median of each column (of an even number of values, the mean of the two in the middle); None without values."""
    counts = rows.agg(*[F.count(c).alias(c) for c in columns]).first()
    out = {}
    for c in columns:
        a, b = values_at(rows, c, [(counts[c] - 1) // 2, counts[c] // 2]) if counts[c] else (None, None)
        out[c] = None if a is None else (a + b) / 2
    return out
