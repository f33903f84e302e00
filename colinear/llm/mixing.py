"""Mixing sources to target weights by the cube method.

Every document of a source has the same inclusion: target / size of the source,
its whole part for sure and its fraction as a probability. The flight phase of
the cube method turns the fractions into 0 or 1 while two totals of every source
stay as they are, the number of documents and of words: it takes three documents
at a time, moves their probabilities along the null space of the two constraints
until one becomes 0 or 1, and goes on with the next. Blocks of documents fly
apart; each leaves at most two that are open. These fly again, until a source has
only a few dozen open documents. That landing problem is rounded greedily, largest
document first, each way that brings the words nearer to their target.

Documents are units of (id, source, size); rows that repeat all three are one
unit and get the same decision. Nothing depends on partitions or row order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colinear.session import cut, fresh, table

#: Documents of a block, blocks of a source at least, and documents of a block at least.
BLOCK_ROWS, LEAST_BLOCKS, LEAST_ROWS = 4096, 16, 8
#: Open documents of a source that are left to the landing.
LANDING = 64
#: Fixed: what separates words.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
TINY = 1e-9


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def flight(pi: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after a flight: at most two are still strictly between 0 and 1; sums of pi and pi * size are kept."""
    p, s = pi.tolist(), size.tolist()
    draws = np.random.default_rng(seed).random(len(p)).tolist()
    open_: list[int] = []
    for i in range(len(p)):
        if TINY < p[i] < 1 - TINY:
            open_.append(i)
        while len(open_) == 3:
            a, b, c = open_
            u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])  # keeps the sums of p and of p * s
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)  # three of one size: any move that keeps the count keeps the words
            up = down = float("inf")
            for j, x in zip(open_, u, strict=True):
                if x > 0:
                    up, down = min(up, (1 - p[j]) / x), min(down, p[j] / x)
                elif x < 0:
                    up, down = min(up, p[j] / -x), min(down, (1 - p[j]) / -x)
            step = up if draws[i] * (up + down) < down else -down
            for j, x in zip(open_, u, strict=True):
                p[j] = min(1.0, max(0.0, p[j] + step * x))
                if p[j] <= TINY:
                    p[j] = 0.0
                elif p[j] >= 1 - TINY:
                    p[j] = 1.0
            open_ = [j for j in open_ if 0 < p[j] < 1]
            draws[i] = (draws[i] * 7919.13) % 1.0  # another draw, if a step closed none by rounding
    return np.array(p)


def landing(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rounds the open probabilities, largest size first, each the way that keeps the total of pi * size nearest."""
    out, error = pi.copy(), 0.0
    for i in np.lexsort((np.arange(len(pi)), -size)):
        if 0 < pi[i] < 1:
            up, down = error + (1 - pi[i]) * size[i], error - pi[i] * size[i]
            take = abs(up) < abs(down) or (abs(up) == abs(down) and pi[i] >= 0.5)
            out[i], error = (1.0, up) if take else (0.0, down)
    return out


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """Adds ``target`` to rows (source, source_size): weights by the rank of the source, ``share`` of all sizes.

    Sources rank by code point, null last, and take the weights in turn. A target
    stops at ``most`` times its source's size; what is above goes to the others by
    weight, again until none is above.
    """
    # ranks without gathering the sources in one task: ranges are counted first
    sources = cut(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["n"] for r in sources.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, at = {}, 0
    for k in sorted(sizes):
        before[k], at = at, at + sizes[k]
    if not sizes:
        return sources.withColumn("target", F.lit(0.0)).drop("part")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(place + offset, F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(sources.withColumn("w", w).drop("part"))
    cap = F.col("source_size") * F.lit(float(most))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words for a weight of 1; only grows
    while True:
        capped = F.col("w") * F.lit(level) >= cap
        held, weight = ranked.agg(F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("w")))).first()
        if not weight:
            break
        new = (share * total - (held or 0.0)) / weight
        if new <= level:
            break
        level = new
    return ranked.withColumn("target", F.least(F.col("w") * F.lit(level), cap)).drop("w")


def decide(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """One row per unit: ``id, source, size, rows, source_size, target, copies``; the mix takes each of its rows ``copies`` times.

    Null texts have size 0, documents of size 0 or of a source of size 0 are taken
    as their source's ratio says (0 for an empty source); null ids and sources are
    values like any other. An empty table gives no rows.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), words(F.col(text)).alias("size"))
    units = cut(sized.groupBy("id", "source", "size").agg(F.count("*").alias("rows")))
    by_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    aimed = targets(by_source, share, most, weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    blocks = F.greatest(F.least(F.lit(LEAST_BLOCKS), F.ceil(F.col("n") / LEAST_ROWS)), F.ceil(F.col("n") / BLOCK_ROWS))
    joined = units.join(F.broadcast(aimed) if aimed.count() <= 10_000 else aimed, units["source"].eqNullSafe(aimed["source"])).drop(aimed["source"])
    start = joined.withColumns({"h": F.xxhash64("id", "source", "size"), "base": F.floor(ratio + TINY), "blocks": blocks.cast("long")})
    start = start.withColumn("pi", F.greatest(F.lit(0.0), ratio - F.col("base"))).withColumn("block", F.pmod("h", "blocks"))
    kinds = dict(start.dtypes)
    columns = ["id", "source", "size", "rows", "source_size", "target", "h", "base", "pi"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)

    def of(method):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(batches).sort_by([("h", "ascending"), ("size", "ascending"), ("rows", "ascending"), ("id", "ascending")])
            pi = t.column("pi").to_numpy()
            weight = (t.column("size").to_numpy() * t.column("rows").to_numpy()).astype(float)
            done = flight(pi, weight, abs(int(t.column("h")[0].as_py())) % 2**32) if method == "flight" else landing(pi, weight)
            yield from t.set_column(t.schema.get_field_index("pi"), "pi", pa.array(done, pa.float64())).select(columns).to_batches()

        return run

    flown = cut(start.groupBy("source", "block").applyInArrow(of("flight"), schema))
    decided, open_ = [], flown
    while True:
        is_open = (F.col("pi") > 0) & (F.col("pi") < 1)
        decided.append(open_.where(~is_open))
        left = open_.where(is_open)
        counts = left.groupBy("source").agg(F.count("*").alias("n"))
        if (counts.agg(F.max("n")).first()[0] or 0) <= LANDING:
            break
        fewer = counts.select(F.col("source").alias("s"), F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("n") / BLOCK_ROWS)).cast("long").alias("blocks"))
        again = left.join(fewer, left["source"].eqNullSafe(fewer["s"])).withColumn("block", F.pmod(F.xxhash64("h"), "blocks"))
        open_ = cut(again.groupBy("source", "block").applyInArrow(of("flight"), schema))
    landed = left.groupBy("source").applyInArrow(of("landing"), schema)
    whole = landed
    for d in decided:
        whole = whole.unionByName(d)
    return whole.select("id", "source", "size", "rows", "source_size", "target", (F.col("base") + F.round("pi")).cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with the columns of ``docs``.

    Only ids, sources and sizes take part in the decision; the texts move once, to
    meet it. Options as for ``decide``.
    """
    id_col, text, source = options.get("id_col", "doc_id"), options.get("text", "text"), options.get("source", "source")
    names = fresh(docs, "unit_id", "unit_source", "unit_size", "copies", "words", "copy")
    unit_id, unit_source, unit_size, copies, size, copy = names
    taken = decide(docs, **options).where("copies > 0").select("id", "source", "size", "copies").toDF(*names[:4])
    sized = docs.withColumn(size, words(F.col(text)))
    both = sized.join(taken, sized[id_col].eqNullSafe(taken[unit_id]) & sized[source].eqNullSafe(taken[unit_source]) & (sized[size] == taken[unit_size]))
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = decide(table(spark, sf_dir, "documents"))
    rows = units.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
