"""Ordering, orienting and joining scaffolds by synteny.

Anchors: scaffold, chr, pos, dir (+1, -1), one row for each match of a scaffold on a chromosome.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colinear.functions.sequence import revcomp
from colinear.operators.islands import HEADS, before, dealt, numbered
from colinear.session import stored

#: Letters between joined scaffolds; bounds of an estimated gap.
LINKER, LEAST_GAP, MOST_GAP = "n" * 100, 10, 1000


def anchors(hits: DataFrame, share: int = 5, run: int = 0) -> DataFrame:
    """``scaffold, lo_chr, lo_pos, hi_chr, hi_pos, dir``: a scaffold's ends, from hits (scaffold, s_pos, chr, pos, dir).

    Only chromosomes with at least 1/share of the scaffold's hits count; with ``run``,
    only hits that begin so many hits of one direction (a null direction ends a run). The ends are the first and last of them by
    scaffold position; the direction is that of the first. Repeated hits count each time; nulls are names and places of their own.
    A scaffold's hits are counted before they meet, and runs are found over ranges of them, so a scaffold may have any number.
    """
    order = ["s_pos", "chr", "pos", "dir"]
    key = F.struct(*order)
    held = hits.select("scaffold", *order)
    held = stored(held, "hits") if run else held
    # a row for each scaffold and chromosome
    on = held.groupBy("scaffold", "chr").agg(F.count("*").alias("on"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    on = on.withColumn("n", F.sum("on").over(Window.partitionBy("scaffold"))).where(F.col("on") >= F.floor(F.col("n") / share))
    if run:
        on = begun(same(held, on, ["scaffold", "chr"]), order, run)
    return on.groupBy("scaffold").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("scaffold", F.col("lo.chr").alias("lo_chr"), F.col("lo.pos").alias("lo_pos"), F.col("hi.chr").alias("hi_chr"), F.col("hi.pos").alias("hi_pos"), F.col("lo.dir").alias("dir"))


def same(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` are among those of ``groups``, nulls like values."""
    few = stored(groups.select(*[F.col(k).alias(f"_{k}") for k in keys]), "groups")
    alike = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rows.join(F.broadcast(few) if few.count() <= HEADS else few, alike, "left_semi")


def begun(hits: DataFrame, order: list[str], run: int) -> DataFrame:
    """``scaffold, lo, hi`` (each a struct of ``order``): the first and last hits that begin ``run`` hits of one direction, for each stretch of one direction that is so long."""
    key = F.struct(*order)
    rows = before(dealt(hits, ["scaffold"], order), ["scaffold"], order, last=("max", key))
    rows = numbered(rows, ["scaffold"], order, ~F.coalesce(F.col("last.dir") == F.col("dir"), F.lit(False)), "stretch").drop("last")
    rows = stored(before(rows, ["scaffold", "stretch"], order, place=("sum", F.lit(1))).withColumn("place", F.coalesce("place", F.lit(0))), "stretches")
    long_ = rows.where("dir is not null").groupBy("scaffold", "stretch").agg(F.count("*").alias("n"), F.min(key).alias("lo")).where(F.col("n") >= run)
    at = long_.select(F.col("scaffold").alias("_scaffold"), F.col("stretch").alias("_stretch"), (F.col("n") - run).alias("_place"), "lo")
    # one row of each stretch: equal keys on either side are few
    ends = F.col("scaffold").eqNullSafe(F.col("_scaffold")) & (F.col("stretch") == F.col("_stretch")) & (F.col("place") == F.col("_place"))
    return rows.join(at, ends).select("scaffold", "lo", key.alias("hi"))


def adjacency(ends: DataFrame) -> DataFrame:
    """``a, a_end, b, b_end``: neighbours on a chromosome, the end of each scaffold (lo or hi) that faces the other.

    Ends are dealt by ranges of (chromosome, position), so that a chromosome may hold any number.
    """
    points = F.explode(F.array(F.struct(F.lit("lo").alias("end"), F.col("lo_chr").alias("chr"), F.col("lo_pos").alias("pos")), F.struct(F.lit("hi").alias("end"), F.col("hi_chr").alias("chr"), F.col("hi_pos").alias("pos"))))
    order = ["pos", "scaffold", "end"]
    rows = ends.select("scaffold", points.alias("p")).select("scaffold", "p.*")
    rows = before(dealt(rows, ["chr"], order), ["chr"], order, last=("max", F.struct(*order)))
    return rows.where(F.col("last.scaffold") != F.col("scaffold")).select("chr", F.col("last.pos").alias("pos"), F.col("last.scaffold").alias("a"), F.col("last.end").alias("a_end"), F.col("scaffold").alias("b"), F.col("end").alias("b_end"))


def taken(links: DataFrame) -> DataFrame:
    """The links (a, a_end, b, b_end) that stand when, in order of chromosome and position, each takes its two ends if both are free.

    Links of ``adjacency`` form runs in which each begins at the end where the one before ends:
    of a run the first, third, ... are taken. If links share ends in any other way, those that are first at
    both their ends are taken, and what names a taken end goes, round by round.
    """
    order = ["chr", "pos", "a", "a_end", "b", "b_end"]
    rows = before(dealt(links.select(*order).withColumn("_one", F.lit(1)), ["_one"], order), ["_one"], order, last=("max", F.struct(*order)), n=("sum", F.lit(1)))
    rows = rows.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    goes_on = F.coalesce((F.col("last.b") == F.col("a")) & (F.col("last.b_end") == F.col("a_end")), F.lit(False))
    rows = stored(before(rows.withColumn("_on", goes_on), ["_one"], order, head=("max", F.when(~goes_on, F.col("n")))).withColumn("head", F.when(F.col("_on"), F.col("head")).otherwise(F.col("n"))), "links")
    sides = F.explode(F.array(F.struct(F.col("a").alias("name"), F.col("a_end").alias("end"), F.lit(True).alias("first")), F.struct(F.col("b").alias("name"), F.col("b_end").alias("end"), F.lit(False).alias("first"))))
    ends = rows.select("n", "head", "_on", sides.alias("e")).select("n", "head", "_on", "e.*")
    # an end as a run has it: one link leads to it and the next one, of the same run, away from it
    odd = ends.groupBy("name", "end").agg(F.count("*").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.countDistinct("head").alias("runs")).where("k > 2 or (k = 2 and (hi <> lo + 1 or runs <> 1))")
    if odd.isEmpty():
        return rows.where((F.col("n") - F.col("head")) % 2 == 0).select("a", "a_end", "b", "b_end")
    left, out = rows.select("n", "a", "a_end", "b", "b_end"), None
    while not left.isEmpty():
        ends = left.select("n", sides.alias("e")).select("n", "e.name", "e.end")
        firsts = ends.groupBy("name", "end").agg(F.min("n").alias("n"))
        now = stored(firsts.groupBy("n").agg(F.count("*").alias("k")).where("k = 2").select("n"), "first")
        won = stored(left.join(now, "n", "left_semi"), "won")
        out = won if out is None else out.unionByName(won)
        gone = ends.join(won.select(sides.alias("e")).select("e.name", "e.end"), ["name", "end"], "left_semi").select("n").distinct()
        left = stored(left.join(gone, "n", "left_anti"), "left")
    return (rows.select("n", "a", "a_end", "b", "b_end").limit(0) if out is None else out).drop("n")


def ranked_walks(steps: DataFrame) -> DataFrame:
    """``state, last, d, low, ring`` of steps (state, next; next null at the end of a walk): the last state of each walk, how far it is, the least name on the way, and whether the walk goes round.

    Pointers are doubled: after k rounds each spans 2^k steps. States are (name, dir).
    """
    held = stored(steps.select("state", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("d"), F.col("state").alias("last"), F.col("state.name").alias("low")), "walk")
    for _ in range(max(1, held.count()).bit_length() + 1):
        if held.where("next is not null").isEmpty():
            break
        on = held.select(F.col("state").alias("next"), F.col("next").alias("further"), F.col("d").alias("more"), F.col("last").alias("end"), F.col("low").alias("lower"))
        joined = held.join(on, "next", "left")
        gone = F.col("next").isNotNull()
        held = stored(joined.select("state", F.when(gone, F.col("further")).alias("next"), F.when(gone, F.col("d") + F.col("more")).otherwise(F.col("d")).alias("d"), F.when(gone, F.col("end")).otherwise(F.col("last")).alias("last"), F.when(gone, F.least("low", "lower")).otherwise(F.col("low")).alias("low")), "walk")
    return held.select("state", "last", "d", "low", F.col("next").isNotNull().alias("ring"))


def paths(links: DataFrame, scaffolds: DataFrame) -> DataFrame:
    """``path, place, scaffold, dir``: scaffolds walked along their links, each used once, each end linked once.

    Links come in order of chromosome and position; the first that names an end takes
    it (``taken``). A path is named by the least name on it. It is walked from the one of
    its two outer scaffolds with the lesser name; a ring from its least name on, entered at ``lo``. Scaffolds without a link are paths of
    their own. Places come from doubled pointers, so a path may be of any length.
    """
    state = lambda name, end, way: F.struct(name.alias("name"), F.when(end == way, 1).otherwise(-1).alias("dir"))
    both = stored(taken(links), "taken")
    ways = both.unionByName(both.select(F.col("b").alias("a"), F.col("b_end").alias("a_end"), F.col("a").alias("b"), F.col("a_end").alias("b_end")))
    # forward (1) a scaffold is left at hi and entered at lo
    hops = ways.select(state(F.col("a"), F.col("a_end"), "hi").alias("state"), state(F.col("b"), F.col("b_end"), "lo").alias("next"))
    every = hops.select(F.col("state.name").alias("name")).distinct().select(F.explode(F.array(*[F.struct("name", F.lit(x).alias("dir")) for x in (1, -1)])).alias("state"))
    steps = stored(every.join(hops, "state", "left"), "steps")
    found = ranked_walks(steps)
    rings = found.where("ring")
    if not rings.isEmpty():
        # the link into the least scaffold's lo is cut, in both directions
        least = F.col("state.name") == F.col("low")
        cut = rings.where(least & (F.col("state.dir") == -1)).select("state")
        around = steps.join(rings.select("state"), "state", "left_semi")
        back = cut.select(F.struct(F.col("state.name").alias("name"), F.lit(1).alias("dir")).alias("next"))
        opened = around.join(cut.withColumn("cut", F.lit(True)), "state", "left").join(back.withColumn("into", F.lit(True)), "next", "left")
        opened = opened.select("state", F.when(F.col("cut").isNull() & F.col("into").isNull(), F.col("next")).alias("next"))
        found = found.where("not ring").unionByName(ranked_walks(opened))
    found = stored(found, "walks")
    one, other = found.where("state.dir = 1"), found.where("state.dir = -1")
    pair = one.select(F.col("state.name").alias("scaffold"), F.col("last.name").alias("end"), F.col("d").alias("to_end"), F.col("low").alias("low")).join(other.select(F.col("state.name").alias("scaffold"), F.col("last.name").alias("start"), F.col("d").alias("to_start"), F.col("low").alias("low2")), "scaffold")
    ahead = F.col("start") < F.col("end")
    linked = pair.select(F.least("low", "low2").alias("path"), F.when(ahead, F.col("to_start")).otherwise(F.col("to_end")).alias("place"), "scaffold", F.when(ahead, 1).otherwise(-1).alias("dir"))
    alone = scaffolds.select("scaffold").join(linked.select("scaffold"), "scaffold", "left_anti").select(F.col("scaffold").alias("path"), F.lit(0).cast("long").alias("place"), "scaffold", F.lit(1).alias("dir"))
    return linked.unionByName(alone)


def superscaffolds(walked: DataFrame, sequences: DataFrame) -> DataFrame:
    """``path, n, seq``: the scaffolds of a path, turned as it says and joined by ``LINKER``."""
    rows = walked.join(sequences.select(F.col("name").alias("scaffold"), "seq"), "scaffold")
    piece = F.when(F.col("dir") < 0, revcomp(F.col("seq"))).otherwise(F.col("seq"))
    parts = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", piece.alias("seq")))).alias("p"))
    return parts.select("path", F.size("p").alias("n"), F.array_join(F.transform("p", lambda x: x["seq"]), LINKER).alias("seq"))


def placement(hits: DataFrame) -> DataFrame:
    """``chr, place, scaffold, dir, gap``: each scaffold once, where its first anchor lies, with the gap to the one before.

    ``hits``: scaffold, size, s_pos, chr, pos, dir. The gap is estimated from the anchors and kept within bounds.
    Of equal anchors the one of the least direction, then size, counts. Scaffolds are dealt by ranges of (chromosome, position).
    """
    first = F.min(F.struct("chr", "pos", "s_pos", "dir", "size"))
    begin = F.when(F.col("dir") > 0, F.col("pos") - F.col("s_pos")).otherwise(F.col("pos") - (F.col("size") - F.col("s_pos")))
    rows = hits.groupBy("scaffold").agg(first.alias("f")).select("scaffold", "f.*").withColumn("begin", begin)
    order = ["pos", "scaffold"]
    rows = before(dealt(rows, ["chr"], order), ["chr"], order, last=("max", F.struct(*order, "begin", "size")), place=("sum", F.lit(1)))
    place = F.coalesce("place", F.lit(0))
    gap = F.col("begin") - (F.col("last.begin") + F.col("last.size"))
    return rows.select(F.concat(F.lit("Pseudo"), F.col("chr").cast("string")).alias("chr"), place.cast("int").alias("place"), "scaffold", "dir", F.when(place == 0, F.lit(0)).otherwise(F.least(F.greatest(gap, F.lit(LEAST_GAP)), F.lit(MOST_GAP))).alias("gap"))


def orient(summary: DataFrame, ident: float = 0.7, length: int = 200) -> DataFrame:
    """``q_name, ori, bases``: the strand of each query's longest good match (``+`` of equals)."""
    size = F.col("q_end") - F.col("q_start")
    rows = summary.where((F.col("ident") >= ident) & (size >= length)).groupBy("q_name", "ori").agg(F.max(size).alias("bases"))
    best = Window.partitionBy("q_name").orderBy(F.desc("bases"), "ori")
    return rows.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("q_name", "ori", "bases")
