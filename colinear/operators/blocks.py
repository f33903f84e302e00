"""Blocks, gaps and merges along a target.

Where a running state decides, rows are first cut into islands beyond which no
earlier row can reach; each island is folded by itself, so a hot (target, query, strand) is
spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colinear.operators.islands import before, dealt, folded, numbered

SUMMARY_KEYS = ["t_name", "q_name", "ori"]
MATCH_KEYS = ["target_id", "query_id", "rc"]


def merge_islands(matches: DataFrame) -> DataFrame:
    """Matches with ``island``: a new one where a match starts at or behind the end of all before it (of its target, query and strand)."""
    order = ["t_start", "len", "q_start"]
    rows = before(dealt(matches, MATCH_KEYS, order), MATCH_KEYS, order, reach=("max", F.col("t_start") + F.col("len")))
    return numbered(rows, MATCH_KEYS, order, F.coalesce(F.col("t_start") >= F.col("reach"), F.lit(True)))


def merge_overlaps(matches: DataFrame, members: bool = False) -> DataFrame:
    """Merges matches in order of the target start while each overlaps the newest one before it on both axes and doesn't start before that on either.

    The newest one counts as reaching as far on both axes as makes it end, on the
    target, where the merged interval ends. Returns the merged intervals with the number of their members; with
    ``members`` also which they are: ``list``, an array of (mt, mq, ml).
    """

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, new, parts = None, None, []
        for t, n, q in rows:
            if held and new[0] <= t < held[2] and new[1] <= q < new[1] + held[2] - new[0]:
                held[2], held[3], held[4] = max(held[2], t + n), max(held[3], q + n), held[4] + 1
            else:
                if held:
                    yield (*held, parts) if members else tuple(held)
                held, parts = [t, q, t + n, q + n, 1], []
            if members:
                parts.append({"mt": t, "mq": q, "ml": n})
            new = (t, q)
        if held:
            yield (*held, parts) if members else tuple(held)

    schema = "t_start long, q_start long, t_end long, q_end long, members int"
    return folded(merge_islands(matches), MATCH_KEYS, ["t_start", "len", "q_start"], step, ["t_start", "len", "q_start"], schema + (", list array<struct<mt: long, mq: long, ml: long>>" if members else ""))


def synteny_blocks(summary: DataFrame, least: int = 3, most_shift: int = 1_000_000) -> DataFrame:
    """Blocks of summary rows: each is compared with its block's first row.

    A row joins while its query lies beyond the first row's (before it, if reversed)
    and its shift against the first row's diagonal stays below ``most_shift``. Blocks of
    fewer than ``least`` rows are left out. Returns name, interval, rows and mean identity.
    An island ends where a row can join no block that any earlier row began.
    """
    order = ["t_start", "t_end", "q_start"]
    plus = F.col("ori") == "+"
    shift = F.when(plus, F.col("q_start") - F.col("t_start")).otherwise(F.col("q_start") + F.col("t_start"))
    rows = dealt(summary.withColumn("shift", shift), SUMMARY_KEYS, order)
    rows = before(rows, SUMMARY_KEYS, order, low_q=("min", F.col("q_start")), high_q=("max", F.col("q_start")), low=("min", F.col("shift")), high=("max", F.col("shift")))
    behind = F.when(plus, F.col("q_end") <= F.col("low_q")).otherwise(F.col("q_start") >= F.col("high_q"))
    far = (F.col("shift") - F.col("high") >= most_shift) | (F.col("low") - F.col("shift") >= most_shift)
    rows = numbered(rows, SUMMARY_KEYS, order, F.coalesce(behind | far, F.lit(True)))

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = None  # first row's query start, shift; extent, rows, sum of identities
        for t, z, q, e, d, ident, forward in rows:
            if held and (e > held[0] if forward else q < held[0]) and abs(d - held[1]) < most_shift:
                held[2:] = [min(held[2], t), max(held[3], z), min(held[4], q), max(held[5], e), held[6] + 1, held[7] + ident]
                continue
            if held and held[6] >= least:
                yield (*held[2:7], held[7] / held[6])
            held = [q, d, t, z, q, e, 1, ident]
        if held and held[6] >= least:
            yield (*held[2:7], held[7] / held[6])

    found = folded(rows.withColumn("forward", plus), SUMMARY_KEYS, order, step, ["t_start", "t_end", "q_start", "q_end", "shift", "ident", "forward"], "t_start long, t_end long, q_start long, q_end long, n int, ident double")
    return found.select("t_name", "t_start", "t_end", "q_name", "q_start", "q_end", "ori", "n", "ident")


def bounded_merge(summary: DataFrame, boundary: int = 5) -> DataFrame:
    """Merges summary rows whose starts lie within ``boundary`` of the running stops on both axes."""
    order = ["t_start", "t_end", "q_start"]
    rows = before(dealt(summary, SUMMARY_KEYS, order), SUMMARY_KEYS, order, reach=("max", F.col("t_end")))
    rows = numbered(rows, SUMMARY_KEYS, order, F.coalesce(F.col("t_start") > F.col("reach") + boundary, F.lit(True)))

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = None
        for t, z, q, e in rows:
            if held and abs(held[1] - t) <= boundary and abs(held[3] - q) <= boundary:
                held[1], held[3], held[4] = max(held[1], z), max(held[3], e), held[4] + 1
                continue
            if held:
                yield tuple(held)
            held = [t, z, q, e, 1]
        if held:
            yield tuple(held)

    found = folded(rows, SUMMARY_KEYS, order, step, ["t_start", "t_end", "q_start", "q_end"], "t_start long, t_end long, q_start long, q_end long, n int")
    return found.select("t_name", "t_start", "t_end", "q_name", "q_start", "q_end", "ori", "n")


def gap_regions(summary: DataFrame, least: int = 1, most: int = 15_000) -> DataFrame:
    """The regions between consecutive rows of one target, query and strand, if they are ``least`` to ``most`` long on both axes."""
    order = ["t_start", "t_end", "q_start", "q_end"]
    rows = before(dealt(summary.select(*SUMMARY_KEYS, *order), SUMMARY_KEYS, order), SUMMARY_KEYS, order, last=("max", F.struct(*order)))
    plus = F.col("ori") == "+"
    rows = rows.where("last is not null").select("t_name", F.col("last.t_end").alias("t_from"), F.col("t_start").alias("t_to"), "q_name", F.when(plus, F.col("last.q_end")).otherwise(F.col("q_end")).alias("q_from"), F.when(plus, F.col("q_start")).otherwise(F.col("last.q_start")).alias("q_to"), "ori")
    return rows.where((F.col("t_to") - F.col("t_from")).between(least, most) & (F.col("q_to") - F.col("q_from")).between(least, most))


def guide_chunks(matches: DataFrame, lap: int = 32, least: int = 20, most: int = 100_000, chunk: int = 4096) -> DataFrame:
    """Pieces to search between consecutive matches: gaps widened by ``lap``, cut into half-overlapping pieces of at most ``chunk``."""
    order = ["t_start", "len", "q_start"]
    rows = before(dealt(matches.select(*MATCH_KEYS, *order), MATCH_KEYS, order), MATCH_KEYS, order, last=("max", F.struct(*order))).where("last is not null")
    t_from, q_from = F.col("last.t_start") + F.col("last.len") - lap, F.col("last.q_start") + F.col("last.len") - lap
    gaps = rows.select(*MATCH_KEYS, F.greatest(t_from, F.lit(0)).alias("t_from"), (F.col("t_start") + lap).alias("t_to"), F.greatest(q_from, F.lit(0)).alias("q_from"), (F.col("q_start") + lap).alias("q_to"))
    size = F.col("t_to") - F.col("t_from")
    gaps = gaps.where(size.between(least + 2 * lap, most) & (F.col("q_to") - F.col("q_from")).between(least + 2 * lap, most))
    pieces = gaps.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil((size - chunk) / (chunk // 2)), F.lit(0)))))
    start = F.col("t_from") + F.col("piece") * (chunk // 2)
    return pieces.select("target_id", "query_id", "rc", "piece", start.alias("t_from"), F.least(F.col("t_to"), start + chunk).alias("t_to"), "q_from", "q_to")


def seed_groups(matches: DataFrame, most_gap: int = 1000) -> DataFrame:
    """Groups of successive matches whose gaps stay below ``most_gap`` on both axes."""
    order = ["t_start", "len", "q_start"]
    rows = before(dealt(matches.select(*MATCH_KEYS, *order), MATCH_KEYS, order), MATCH_KEYS, order, last=("max", F.struct(*order)))
    dt, dq = F.col("t_start") - F.col("last.t_start") - F.col("last.len"), F.col("q_start") - F.col("last.q_start") - F.col("last.len")
    rows = numbered(rows, MATCH_KEYS, order, ~F.coalesce((dt <= most_gap) & (F.abs(dq) <= most_gap), F.lit(False)), "g")
    return rows.groupBy(*MATCH_KEYS, "g").agg(F.min("t_start").alias("t_start"), F.max(F.col("t_start") + F.col("len")).alias("t_end"), F.min("q_start").alias("q_start"), F.max(F.col("q_start") + F.col("len")).alias("q_end"), F.count("*").alias("n")).drop("g")
