"""Interval algebra by event sweeps: coverage, depth, features and points in intervals.

Intervals are half-open. An interval is two events, +1 at its start and -1 at its
end; events at one place are summed before the sweep, so repeated intervals cost
one row. Nothing is ever held per base.

Running sums are taken in two steps: within pieces of ``PIECE`` places, and over the
totals of the pieces. So a long sequence keeps as many tasks busy as it has pieces.
Intervals without a sequence take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colinear.operators.islands import before, dealt
from colinear.session import stored

#: Places of a sequence whose events meet in one group of a sweep.
PIECE = 1 << 16


def running(rows: DataFrame, sums: list[str], keys: list[str], order: list[str] | None = None, piece: int = PIECE) -> DataFrame:
    """Rows (keys, pos, ...) with the columns ``sums`` replaced by their running totals along ``pos``, and ``next``, the place of the row that follows.

    Rows at one place follow ``order``, if given; without it each place has one row, or the order doesn't matter.
    """
    within, along = Window.partitionBy(*keys, "_piece").orderBy(*(order or ["pos"])), Window.partitionBy(*keys).orderBy("_piece")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_piece", F.floor(F.col("pos") / piece)).repartition(*keys, "_piece")  # one exchange for both sides
    heads = rows.groupBy(*keys, "_piece").agg(F.min("pos").alias("_first"), *[F.sum(c).alias(f"_{c}") for c in sums])
    heads = heads.select(*keys, "_piece", F.lead("_first").over(along).alias("_after"), *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    own = rows.withColumns({c: F.sum(c).over(upto) for c in sums} | {"next": F.lead("pos").over(within)})
    joined = own.join(heads, [*keys, "_piece"])
    totals = {c: F.col(c) + F.col(f"_{c}") for c in sums}
    return joined.withColumns(totals | {"next": F.coalesce("next", "_after")}).drop("_piece", "_after", *[f"_{c}" for c in sums])


def events(intervals: DataFrame, key: str = "seq", start: str = "start", end: str = "end", weight: Column | None = None) -> DataFrame:
    """``key, pos, delta`` summed by place."""
    w = F.lit(1) if weight is None else weight
    ends = F.explode(F.array(F.struct(F.col(start).alias("pos"), w.alias("delta")), F.struct(F.col(end).alias("pos"), (-w).alias("delta"))))
    rows = intervals.where(F.col(end) > F.col(start)).select(F.col(key).alias("seq"), ends.alias("e")).select("seq", "e.*")
    return rows.groupBy("seq", "pos").agg(F.sum("delta").alias("delta"))


def _segments(e: DataFrame) -> DataFrame:
    rows = running(e, ["delta"], ["seq"])
    return rows.where("delta > 0").select("seq", F.col("pos").alias("start"), F.col("next").alias("end"), F.col("delta").alias("depth"))


def depth(intervals: DataFrame, **columns) -> DataFrame:
    """``seq, start, end, depth``: the maximal segments between events, of depth 1 at least."""
    return _segments(events(intervals, **columns))


def merged_depth(intervals: DataFrame, **columns) -> DataFrame:
    """As ``depth``, with neighbouring segments of one depth joined: places where as much begins as ends are no borders."""
    return _segments(events(intervals, **columns).where("delta <> 0")).select("seq", "start", "end", "depth")


def coverage(intervals: DataFrame, most: int = 100, **columns) -> DataFrame:
    """``seq, covered, depth_sum``: bases under any interval, and the sum of depths (each at most ``most``)."""
    d = depth(intervals, **columns)
    size = F.col("end") - F.col("start")
    return d.groupBy("seq").agg(F.sum(size).alias("covered"), F.sum(size * F.least(F.col("depth"), F.lit(most))).alias("depth_sum"))


def unique_regions(intervals: DataFrame, **columns) -> DataFrame:
    """Regions that exactly one interval covers."""
    return merged_depth(intervals, **columns).where("depth = 1").select("seq", "start", "end")


def coverage_delta(before: DataFrame, after: DataFrame, key: str = "seq", start: str = "start", end: str = "end") -> DataFrame:
    """``seq, gained, lost``: bases covered by only one of two sets of intervals."""
    tag = lambda df, a, b: df.where(F.col(end) > F.col(start)).select(F.col(key).alias("seq"), F.col(start).alias("s"), F.col(end).alias("e"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    rows = tag(before, 1, 0).unionByName(tag(after, 0, 1))
    ends = F.explode(F.array(F.struct(F.col("s").alias("pos"), F.col("a"), F.col("b")), F.struct(F.col("e").alias("pos"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))))
    e = rows.select("seq", ends.alias("x")).select("seq", "x.*").groupBy("seq", "pos").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    e = running(e, ["a", "b"], ["seq"])
    size = F.col("next") - F.col("pos")
    return e.groupBy("seq").agg(F.coalesce(F.sum(F.when((F.col("a") == 0) & (F.col("b") > 0), size)), F.lit(0)).alias("gained"), F.coalesce(F.sum(F.when((F.col("a") > 0) & (F.col("b") == 0), size)), F.lit(0)).alias("lost"))


def union(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, start, end``: the runs of places under any interval (keys, start, end), by keys. Their borders are written once between the two sweeps, each of which names its input twice."""
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d"))))
    e = intervals.where(F.col("end") > F.col("start")).select(*keys, ends.alias("x")).select(*keys, "x.*").groupBy(*keys, "pos").agg(F.sum("d").alias("d"))
    e = running(e.withColumn("by", F.col("d")), ["d"], keys).withColumn("before", F.col("d") - F.col("by"))
    # only the places where a run begins or ends are left, in turn
    e = stored(e.where((F.col("d") == 0) | (F.col("before") == 0)).where("by <> 0").select(*keys, "pos", F.col("d").alias("open")), "borders")
    return running(e, [], keys).where("open > 0").select(*keys, F.col("pos").alias("start"), F.col("next").alias("end"))


def bases_before(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds ``below`` to points (seq, pos, ...): how many places below ``pos`` lie in disjoint runs (seq, start, end). One sweep over both.

    A run's start at x adds pos - x, its end takes it away: two running sums give all.
    """
    others = [c for c in points.columns if c not in ("seq", "pos")]
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).cast("long").alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).cast("long").alias("d"))))
    e = runs.select("seq", ends.alias("x")).select("seq", "x.*", *[F.lit(None).cast(dict(points.dtypes)[c]).alias(c) for c in others], F.lit(False).alias("asked"))
    p = points.select("seq", "pos", F.lit(0).cast("long").alias("d"), *others, F.lit(True).alias("asked"))
    rows = running(e.unionByName(p).withColumn("at", F.col("d") * F.col("pos")), ["d", "at"], ["seq"])
    return rows.where("asked").withColumn("below", F.col("d") * F.col("pos") - F.col("at")).select(*points.columns, "below")


def feature_coverage(features: DataFrame, sizes: DataFrame, covered: DataFrame) -> DataFrame:
    """``type, bases, covered, share`` over all sequences; type ``None`` for bases without any feature.

    ``features``: seq, type, start, end; ``sizes``: seq, size; ``covered``: seq, start, end.
    Overlapping features of one type count once. Types are rows of the sweeps, so any
    number of them will do. Features are cut at the ends of their sequence.
    Each sweep begins at a written table, as plans of sweeps over sweeps double with each.
    """
    axis = sizes.select("seq", "size")
    within = stored(features.join(axis, "seq").select("seq", "type", F.greatest("start", F.lit(0)).alias("start"), F.least("end", "size").alias("end")), "features")
    every, hit = union(within, ["seq"]), union(covered, ["seq"])
    whole = axis.select("seq", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end"))
    tag = lambda df, kind, name, sign: df.select("seq", F.lit(kind).alias("kind"), name.alias("type"), "start", "end", F.lit(sign).alias("sign"))
    none = F.lit(None).cast("string")
    runs = stored(tag(union(within, ["seq", "type"]), 0, F.col("type"), 1).unionByName(tag(whole, 1, none, 1)).unionByName(tag(every, 1, none, -1)), "runs")
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), (-F.col("sign")).alias("by")), F.struct(F.col("end").alias("pos"), F.col("sign").alias("by"))))
    points = runs.select("seq", "kind", "type", ends.alias("x")).select("seq", "kind", "type", "x.*")
    found = bases_before(points, hit).groupBy("kind", "type").agg(F.sum(F.col("by") * F.col("pos")).alias("bases"), F.sum(F.col("by") * F.col("below")).alias("covered"))
    name = F.when(F.col("kind") == 1, F.lit("None")).otherwise(F.col("type"))
    return found.where("bases > 0").select(name.alias("type"), "bases", "covered", (F.col("covered") / F.col("bases")).alias("share"))


def depth_at(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adds ``depth`` to points (id, seq, pos): how many intervals (seq, start, end) hold each. One sweep over both."""
    e = events(intervals).select("seq", "pos", "delta", F.lit(0).alias("kind"), F.lit(None).cast(dict(points.dtypes)["id"]).alias("id"))
    p = points.select("seq", "pos", F.lit(0).cast("long").alias("delta"), F.lit(1).alias("kind"), "id")
    rows = running(e.unionByName(p), ["delta"], ["seq"], ["pos", "kind"])
    return rows.where("kind = 1").select("id", "seq", "pos", F.col("delta").alias("depth"))


def trimmed(matches: DataFrame, written: bool = False) -> DataFrame:
    """Target intervals ``seq, start, end`` of matches, each from where its predecessor (same query, rising) ends: tandem overlaps count once. ``written``: they are in the shared folder already."""
    keys, order = ["target_id", "query_id", "rc"], ["t_start", "len", "q_start"]
    rows = before(dealt(matches.select(*keys, *order), keys, order, written), keys, order, last=("max", F.struct(*order)))
    start = F.when(F.col("last.q_start") < F.col("q_start"), F.greatest(F.col("t_start"), F.col("last.t_start") + F.col("last.len"))).otherwise(F.col("t_start"))
    return rows.select(F.col("target_id").alias("seq"), start.alias("start"), (F.col("t_start") + F.col("len")).alias("end")).where(F.col("end") > F.col("start"))


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether closed interval a holds closed interval b."""
    return (a_start <= b_start) & (a_end >= b_end)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column, same_strand: Column | None = None) -> Column:
    """Bases that two closed intervals share; 0 if their strands differ."""
    n = F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start) + 1, F.lit(0))
    return n if same_strand is None else F.when(same_strand, n).otherwise(0)
