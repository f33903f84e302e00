"""Sharding by a k-d tree over document metadata.

Every document is a point whose coordinates are metadata (here: size, id, a hash
of the source, a hash of the text) and whose weight is its size in bytes. A node
that is due k leaves is split along its widest dimension, at the weighted
quantile that leaves floor(k/2) / k of the bytes below, until every leaf is due
one shard of the target bytes.

Medians are found on the cluster, by native aggregates: all nodes of a level at
once, by histograms that narrow the interval around each quantile. Coordinates are made distinct by
hash bits in their low end, so ties (repeated values, one source with a third of
the rows) split as finely as single rows do. The driver holds the tree and one
histogram row per node, in proportion to the shards and not to the documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colinear.session import cut, partitions, table

#: Bins of a histogram round, and the share of a shard's bytes within which a split may miss its quantile.
BINS, MISS = 1 << 15, 0.002
#: Rows of a slot block, about.
SLOT_ROWS = 20_000
SHARDS = 24
#: Numbers that one row of repeated ones spells out.
PART = 1 << 16
#: Coordinates are doubles below 2**52: a scaled value in the high bits, hash bits in the low ones.
HIGH, LOW = 2**26, 2**26


@dataclass
class Tree:
    """Levels of splits. Node i of a level has the children 2i and 2i + 1 of the next: below ``at`` in dimension ``dim``, and not.

    A node that is due one shard already passes all its points on to its first child.
    """

    leaves: int
    dim: list[list[int]] = field(default_factory=list)
    at: list[list[float]] = field(default_factory=list)

    def due(self) -> list[int]:
        """The shards that each node of the last level is due (0: no such node)."""
        nodes = [self.leaves]
        for _ in self.dim:
            nodes = [x for n in nodes for x in ((n // 2, n - n // 2) if n > 1 else (n, 0))]
        return nodes

    def node(self, dims: list[str]) -> Column:
        """The node of the last level that a point has come to."""
        if not self.dim:
            return F.lit(0)
        flat = lambda levels: F.array(*[F.lit(x) for level in levels for x in level])
        x, dim, at = F.array(*[F.col(c) for c in dims]), flat(self.dim), flat(self.at)

        def down(node: Column, first: Column) -> Column:
            i = first + node + 1
            return node * 2 + F.when(F.element_at(x, F.element_at(dim, i) + 1) < F.element_at(at, i), 0).otherwise(1)

        return F.aggregate(F.array(*[F.lit(2**k - 1) for k in range(len(self.dim))]), F.lit(0), down)

    def shard(self, dims: list[str]) -> Column:
        """The leaf that a point has come to, numbered from 0."""
        due, n = [], 0
        for x in self.due():
            due.append(n)
            n += x > 0
        return F.element_at(F.array(*[F.lit(x) for x in due]), self.node(dims) + 1)


def scaled(value: Column, lo: float, hi: float, *tie: Column) -> Column:
    """A coordinate in [0, 2**52): the value's place between lo and hi, then hash bits."""
    part = F.floor((value.cast("double") - F.lit(float(lo))) / F.lit(max(float(hi) - float(lo), 1e-300)) * F.lit(float(HIGH - 1)))
    return (F.coalesce(part, F.lit(0)) * F.lit(LOW) + F.pmod(F.xxhash64(*tie), F.lit(LOW))).cast("double")


def grow(points: DataFrame, dims: list[str], leaves: int, weight: str = "size") -> Tree:
    """The tree for ``leaves`` shards of equal weight over the coordinates ``dims``."""
    tree = Tree(leaves)
    total = points.agg(F.sum(weight)).first()[0] or 0
    slack = max(1.0, MISS * total / leaves)
    while max(due := tree.due()) > 1:
        here = points.withColumn("node", tree.node(dims))
        stats = {r["node"]: r for r in here.groupBy("node").agg(F.sum(weight).alias("w"), *[F.min(d).alias(f"lo{i}") for i, d in enumerate(dims)], *[F.max(d).alias(f"hi{i}") for i, d in enumerate(dims)]).collect()}
        goal = {}  # node -> [dimension, lo, hi, weight below lo, weight wanted below]
        for k, n in enumerate(due):
            if n > 1 and (r := stats.get(k)) is not None:
                d = max(range(len(dims)), key=lambda i: (r[f"hi{i}"] - r[f"lo{i}"], -i))
                goal[k] = [d, r[f"lo{d}"], r[f"hi{d}"] + 1.0, 0.0, r["w"] * (n // 2) / n]
        narrow = dict(goal)
        while narrow:
            for k, (bin_, below, inside, single) in crossing(here, dims, weight, narrow, len(due)).items():
                g = narrow[k]
                width = (g[2] - g[1]) / BINS
                g[1], g[2], g[3] = g[1] + bin_ * width, g[1] + (bin_ + 1) * width, g[3] + below
                if inside <= slack or single or width <= 1.0:
                    if g[3] + inside - g[4] < g[4] - g[3]:  # the upper end is nearer
                        g[1] = g[2]
                    del narrow[k]
        split = [goal.get(k, [0, float("inf")]) for k in range(len(due))]
        tree.dim.append([g[0] for g in split])
        tree.at.append([float(g[1]) for g in split])
    return tree


def crossing(here: DataFrame, dims: list[str], weight: str, narrow: dict[int, list], nodes: int) -> dict[int, tuple[int, float, float, bool]]:
    """For each node the bin in which the wanted weight is passed: (bin, weight in the bins below, weight inside, whether one row is all of it)."""
    none = [0, 0.0, 0.0, 0.0, 0.0]
    of = lambda i, kind: F.element_at(F.array(*[F.lit(kind(narrow.get(k, none)[i])) for k in range(nodes)]), F.col("node") + 1)
    x = F.element_at(F.array(*[F.col(c) for c in dims]), of(0, int) + 1)
    rows = here.select("node", F.col(weight).alias("w"), x.alias("x"), of(1, float).alias("lo"), of(2, float).alias("hi")).where("x >= lo and x < hi")
    bins = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
    hist = rows.groupBy("node", bins.alias("b")).agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    along = Window.partitionBy("node").orderBy("b")
    hist = hist.withColumns({"upto": F.sum("w").over(along), "last": F.max("b").over(Window.partitionBy("node"))})
    rest = of(4, float) - of(3, float)
    found = hist.where((F.col("upto") >= rest) | (F.col("b") == F.col("last"))).groupBy("node").agg(F.min(F.struct("b", "upto", "w", "n")).alias("x")).select("node", "x.*").collect()
    return {r["node"]: (r["b"], float(r["upto"] - r["w"]), float(r["w"]), r["n"] == 1) for r in found}


def points_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, list[str]]:
    """(id, size, text_crc32, coordinates) of every row and the names of the coordinates."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("th"), F.xxhash64(F.col(source)).alias("sh"))
    # rows that repeat everything get numbers, so that a split can fall among them
    units = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")))
    parts = units.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PART))))
    if (units.agg(F.max("n")).first()[0] or 0) > PART:
        parts = parts.repartition(partitions(docs.sparkSession))
    first = F.col("part") * PART
    rows = parts.withColumn("copy", F.explode(F.sequence(first, F.least(F.col("n"), first + PART) - 1))).drop("n", "part")
    r = rows.agg(F.min(F.log("size")).alias("a"), F.max(F.log("size")).alias("b"), F.min(F.col("id").cast("double")).alias("c"), F.max(F.col("id").cast("double")).alias("d")).first()
    end = float(2**63)
    # low bits by the text first: rows that share a dimension's high bits lie together if their texts are equal
    dims = {
        "x_size": scaled(F.log("size"), r["a"] or 0, r["b"] or 0, F.col("th"), F.col("id"), F.col("copy")),
        "x_id": scaled(F.col("id"), r["c"] or 0, r["d"] or 0, F.col("th"), F.col("id"), F.col("copy")),
        "x_source": scaled(F.col("sh"), -end, end, F.col("th"), F.col("id"), F.col("copy")),
        "x_text": scaled(F.col("th"), -end, end, F.col("id"), F.col("copy")),
    }
    return cut(rows.withColumns(dims)), list(dims)


def shard(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, **columns) -> DataFrame:
    """Puts every row of ``docs`` into a shard: ``id, size, text_crc32, shard, slot``.

    Size: UTF-8 bytes of the text (null: none) plus 8. Give the number of shards,
    or the bytes that a shard should reach. Shards differ in bytes by no more than
    a few splits' slack or a single large document. ``slot`` counts a shard's rows
    from 0 without gaps, in an order that depends on the rows alone. Equal texts are points of their own, parted
    where ids or sources part them: a group may hold more bytes than a shard. Null ids and
    sources are points like others; rows that repeat everything are numbered and part
    where a split falls among them. Empty tables give no rows; some shards are empty if there are few rows.
    """
    points, dims = points_of(docs, **columns)
    spark = docs.sparkSession
    total, n = points.agg(F.sum("size"), F.count("*")).first()
    leaves = shards or max(1, math.ceil((total or 0) / target_bytes))
    tree = grow(points, dims, leaves)
    placed = points.withColumn("shard", tree.shard(dims).cast("int"))
    blocks = max(1, -(-n // (leaves * SLOT_ROWS)), -(-partitions(spark) // leaves))
    placed = cut(placed.select("id", "size", "text_crc32", "th", "copy", "shard").withColumn("block", F.pmod(F.xxhash64("th", "id", "copy"), F.lit(blocks)).cast("int")))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("th", "id", "size", "copy")) - 1
    return placed.withColumn("place", place).join(offsets, ["shard", "block"]).select("id", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
