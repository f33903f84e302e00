"""Match algebra: a match is an interval on a target and one on a query (reverse ones on the reversed query).

Columns: target_id, query_id, query_size, t_start, q_start, len, rc, prob, ident.
All operators are native DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colinear.operators.islands import before, dealt, numbered
from colinear.session import stored

#: The order of matches, with tie-breakers that make it total.
ORDER = ["target_id", "query_id", "rc", "t_start", "len", "q_start"]


def flipped(start: Column, length: Column, size: Column) -> Column:
    """A start on the other strand."""
    return size - length - start


def forward(matches: DataFrame) -> DataFrame:
    """Adds ``q_from, q_to``: the query interval on the forward strand, half-open."""
    at = F.when(F.col("rc"), flipped(F.col("q_start"), F.col("len"), F.col("query_size"))).otherwise(F.col("q_start"))
    return matches.withColumn("q_from", at).withColumn("q_to", F.col("q_from") + F.col("len"))


def ordered(matches: DataFrame) -> DataFrame:
    return matches.orderBy(*ORDER)


def collapse(matches: DataFrame, near: int = 4) -> DataFrame:
    """Joins neighbours that start within ``near`` on both axes (same target, query and strand) into one match.

    The joined match starts where the first does on the target; on the query at the
    least start. Its end is the end of the last member that didn't start before
    all members so far (the first's, if there is none), so it may shrink.
    """
    keys, order = ORDER[:3], ORDER[3:]
    rows = before(dealt(matches.select(*keys, *order), keys, order), keys, order, last=("max", F.struct(*order)))
    close = (F.abs(F.col("t_start") - F.col("last.t_start")) < near) & (F.abs(F.col("q_start") - F.col("last.q_start")) < near)
    rows = numbered(rows, keys, order, ~F.coalesce(close, F.lit(False)))
    inside = Window.partitionBy(*keys, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("least", F.min("q_start").over(inside))
    sets_end = F.col("least").isNull() | (F.col("q_start") >= F.col("least"))
    out = rows.groupBy(*keys, "island").agg(
        F.min("t_start").alias("t_start"),
        F.min("q_start").alias("q_start"),
        F.max_by(F.col("q_start") + F.col("len"), F.when(sets_end, F.struct(*order))).alias("q_end"),
        F.count("*").alias("members"),
    )
    return out.select("target_id", "query_id", "rc", "t_start", "q_start", (F.col("q_end") - F.col("q_start")).alias("len"), "members")


def at_least(matches: DataFrame, length: int = 0, prob: float | None = None) -> DataFrame:
    """Matches of a length at least, and above a probability."""
    out = matches.where(F.col("len") >= length)
    return out if prob is None else out.where(F.col("prob") > prob)


def within_bounds(matches: DataFrame, target_size: Column) -> DataFrame:
    """Matches that lie on both sequences."""
    return matches.where((F.col("t_start") >= 0) & (F.col("q_start") >= 0) & (F.col("t_start") + F.col("len") <= target_size) & (F.col("q_start") + F.col("len") <= F.col("query_size")))


def without_self(matches: DataFrame) -> DataFrame:
    """Leaves out forward matches of a sequence with itself at one place."""
    return matches.where(~((F.col("target_id") == F.col("query_id")) & ~F.col("rc") & (F.col("t_start") == F.col("q_start"))))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def append(a: DataFrame, b: DataFrame, targets: int, queries: int) -> DataFrame:
    """``b`` behind ``a``: its ids are shifted by the numbers of targets and queries of ``a``."""
    return a.unionByName(b.withColumns({"target_id": F.col("target_id") + targets, "query_id": F.col("query_id") + queries}))


def swapped(summary: DataFrame) -> DataFrame:
    """A summary (t_name, t_start, t_end, q_name, q_start, q_end, ident, ori) with query and target swapped."""
    return summary.select(F.col("q_name").alias("t_name"), F.col("q_start").alias("t_start"), F.col("q_end").alias("t_end"), F.col("t_name").alias("q_name"), F.col("t_start").alias("q_start"), F.col("t_end").alias("q_end"), "ident", "ori")


def summary(matches: DataFrame, t_name: str = "t", q_name: str = "q") -> DataFrame:
    """The eight columns of a summary; names are a prefix and the id."""
    f = forward(matches)
    return f.select(F.concat(F.lit(t_name), F.col("target_id")).alias("t_name"), "t_start", (F.col("t_start") + F.col("len")).alias("t_end"), F.concat(F.lit(q_name), F.col("query_id")).alias("q_name"), F.col("q_from").alias("q_start"), F.col("q_to").alias("q_end"), "ident", F.when(F.col("rc"), "-").otherwise("+").alias("ori"))


def statistics(matches: DataFrame) -> DataFrame:
    """Count, total length, and the medians of length and identity, found by narrowing histograms."""
    from colinear.operators.ranking import medians

    held = stored(matches.select("len", "ident"), "lengths")
    middle = medians(held, ["len", "ident"])
    return held.agg(F.count("*").alias("n"), F.sum("len").alias("total"), *[F.lit(middle[c]).cast("double").alias(f"median_{c}") for c in ("len", "ident")])


def best_query(matches: DataFrame) -> DataFrame:
    """For each target the query with most matches (the smallest id of equals), and the last start of matches over 20 long."""
    counts = matches.groupBy("target_id", "query_id").agg(F.count("*").alias("hits"), F.max(F.when(F.col("len") > 20, F.col("t_start"))).alias("last"))
    best = Window.partitionBy("target_id").orderBy(F.desc("hits"), "query_id")
    return counts.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("target_id", "query_id", "hits", "last")


def hit_histogram(matches: DataFrame, width: int = 500_000) -> DataFrame:
    """Matches by target, query and bucket of the target start."""
    return matches.groupBy("target_id", "query_id", F.floor(F.col("t_start") / width).alias("bucket")).agg(F.count("*").alias("hits"))


def split_into(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Adds ``file`` (1 to n): rows in order, in n parts whose sizes differ by one at most.

    Rows are ranked by ranges that are counted first, so no task holds them all.
    """
    from colinear.operators.ranking import global_rank

    ranked, total = global_rank(rows, order)
    big, rest = divmod(total, n)
    cut = rest * (big + 1)
    r = F.col("_rank")
    file = F.when(r < cut, F.floor(r / (big + 1))).otherwise(F.floor((r - cut) / max(big, 1)) + rest) + 1
    return ranked.withColumn("file", file.cast("int")).drop("_rank")


def synthetic_neighbours(matches: DataFrame, near: int = 50_000, least: int = 40, step: int = 100_000) -> DataFrame:
    """Interpolates synteny: behind and before every run of collinear matches, two synthetic ones along its slope.

    A run has one target, query and strand, rising queries and steps below ``near``
    on both axes; it counts if ``least`` of its steps don't overlap. The slope is the
    mean angle of the steps. The synthetic matches lie ``step`` and twice ``step`` off
    its ends on the target, 50 + count long, with probability and identity 0.999.
    """
    keys, order = ORDER[:3], ORDER[3:]
    rows = before(dealt(matches.select(*keys, *order), keys, order), keys, order, last=("max", F.struct(*order)))
    rows = rows.withColumns({"dt": F.col("t_start") - F.col("last.t_start"), "dq": F.col("q_start") - F.col("last.q_start"), "end": F.col("last.t_start") + F.col("last.len")})
    joins = F.coalesce((F.col("dt") < near) & (F.col("dq") < near) & (F.col("dq") > 0), F.lit(False))
    rows = numbered(rows.withColumn("joins", joins), keys, order, ~F.col("joins"), "run")
    counts = F.col("joins") & (F.col("t_start") >= F.col("end")) & (F.col("dt") > 0)
    at = F.struct(*order)
    runs = rows.groupBy(*keys, "run").agg(
        F.sum(F.when(counts, 1).otherwise(0)).alias("n"), F.avg(F.when(counts, F.atan(F.col("dq") / F.col("dt")))).alias("angle"),
        F.min_by("t_start", at).alias("t0"), F.min_by("q_start", at).alias("q0"), F.max_by("t_start", at).alias("t1"), F.max_by("q_start", at).alias("q1"),
    ).where(F.col("n") >= least)
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(j).alias("j")) for s in (-1, 1) for j in (1, 2)]))
    out = runs.withColumn("x", sides).withColumn("d", F.col("x.side") * F.col("x.j") * step)
    start = lambda a, b: F.when(F.col("x.side") < 0, F.col(a)).otherwise(F.col(b))
    return out.select("target_id", "query_id", "rc", (start("t0", "t1") + F.col("d")).alias("t_start"), (start("q0", "q1") + F.round(F.col("d") * F.tan("angle")).cast("long")).alias("q_start"), (F.col("n") + 50).alias("len"), F.lit(0.999).alias("prob"), F.lit(0.999).alias("ident"))
