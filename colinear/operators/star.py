"""Stars: sequences aligned to one reference, counted column by column, with the columns that they insert, and the motifs that they keep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colinear.operators import islands, tiles

#: Columns that a task counts together before it hands them on.
HELD_COLUMNS = 1 << 20
GAP = ord("-")


def columns_of(t_off: int, target: str, query: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place on the reference, slot, query letter) of an alignment's columns. Slot 0 is the reference's letter, 1, 2, ... are letters put in behind it.

    Columns before the first and behind the last pair of letters are left out.
    """
    t, q = (np.frombuffer(s.upper().encode("ascii", "replace"), np.uint8) for s in (target, query))
    own = t != GAP
    both = np.flatnonzero(own & (q != GAP))
    if not len(both):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), q[:0]
    pos = t_off + np.cumsum(own) - 1
    at = np.arange(len(t))
    slot = at - np.maximum.accumulate(np.where(own, at, 0))
    part = slice(both[0], both[-1] + 1)
    return pos[part], slot[part], q[part]


def stacked(members: DataFrame) -> DataFrame:
    """``ref_id, pos, slot, letter, n``: letters of aligned sequences (ref_id, t_off, t_aligned, q_aligned) in each column. Letter ``$`` at slot 0 counts the sequences that end there.

    Columns are counted within a task first, so what is shuffled grows with the references' columns. The counts of one column may come in several rows.
    """
    rows = members.where("t_aligned is not null and q_aligned is not null and ref_id is not null and t_off is not null").select("ref_id", F.col("t_off").cast("long").alias("t_off"), "t_aligned", "q_aligned")
    kind = dict(rows.dtypes)["ref_id"]

    def counted(held: list[tuple]) -> pa.RecordBatch:
        refs = pa.array([h[0] for h in held]).dictionary_encode()
        codes = refs.indices.to_numpy()
        found = pd.DataFrame({"ref": np.repeat(codes, [len(h[1]) for h in held]), "pos": np.concatenate([h[1] for h in held]), "slot": np.concatenate([h[2] for h in held]), "letter": np.concatenate([h[3] for h in held])})
        n = found.groupby(["ref", "pos", "slot", "letter"]).size().reset_index(name="n")
        letters = pa.array([chr(c) for c in n["letter"]], pa.string())
        return pa.RecordBatch.from_arrays([refs.dictionary.take(pa.array(n["ref"])), pa.array(n["pos"], pa.int64()), pa.array(n["slot"], pa.int64()), letters, pa.array(n["n"], pa.int64())], ["ref_id", "pos", "slot", "letter", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for ref, off, t, q in zip(*[c.to_pylist() for c in b.columns], strict=True):
                pos, slot, letter = columns_of(off, t, q)
                if len(pos):
                    held.append((ref, np.append(pos, pos[-1]), np.append(slot, 0), np.append(letter, ord("$")).astype(np.uint8)))
                    size += len(pos)
                if size >= HELD_COLUMNS:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return rows.mapInArrow(run, f"ref_id {kind}, pos long, slot long, letter string, n long")


def reference_letters(references: DataFrame) -> DataFrame:
    """``ref_id, pos, ref``: a row for each letter of the references (ref_id, seq)."""
    letters = F.posexplode(F.filter(F.split("letters", ""), lambda c: c != "")).alias("i", "ref")
    return tiles.tiles(references, "ref_id").select(F.col("id").alias("ref_id"), "tile", letters).select("ref_id", (F.col("tile") * tiles.TILE + F.col("i")).alias("pos"), F.upper("ref").alias("ref"))


def star_profile(members: DataFrame, references: DataFrame) -> DataFrame:
    """``ref_id, pos, slot, ref, members, a, c, g, t, other, gap, same, consensus, likeliest``: the columns of all sequences that are aligned to a reference.

    ``members``: alignments (ref_id, t_off, t_aligned, q_aligned), the reference being the target; ``references``: ref_id, seq.
    Each letter of a reference is a column (slot 0). Where members put letters in behind it, as many columns follow (slots 1, 2,
    ...) as the longest of these inserts has letters; the others have gaps there. ``members`` counts the sequences whose alignment
    goes on over the column, ``same`` those that have the reference's letter (its gap, in slots beyond 0). ``consensus`` is that letter
    if all agree with the reference, ``?`` if any doesn't; ``likeliest`` is the most frequent letter, reference included (the
    first of equals in A, C, G, T, -). Gaps at an alignment's ends, null rows and members of unknown references don't count;
    a repeated row counts as often as it is there. A reference without members keeps its letters; no references give no rows.

    One exchange by column: letters meet the reference, are counted, and the inserts look up the members of their place.
    """
    rows = stacked(members).repartition("ref_id", "pos")
    met = reference_letters(references).join(rows, ["ref_id", "pos"], "left").withColumn("slot", F.coalesce("slot", F.lit(0)))
    n = lambda of: F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0))
    letter = F.col("letter")
    four = [n(letter == x).alias(x.lower()) for x in "ACGT"]
    counted = met.groupBy("ref_id", "pos", "slot", "ref").agg(*four, n(~letter.isin(*"ACGT-$")).alias("other"), n(letter == "-").alias("gap"), n(letter == F.col("ref")).alias("same"), n(letter == "$").alias("ends"), n(letter != "$").alias("own"))
    place = Window.partitionBy("ref_id", "pos")
    at = F.col("slot") == 0
    over = F.sum(F.when(at, F.col("own") - F.col("ends"))).over(place)
    put = counted.withColumn("members", F.when(at, F.col("own")).otherwise(over)).withColumn("gap", F.when(at, F.col("gap")).otherwise(F.col("members") - F.col("own")))
    put = put.withColumns({"same": F.when(at, F.col("same")).otherwise(F.col("gap")), "ref": F.when(at, F.col("ref")).otherwise(F.lit("-"))})
    votes = [F.col(c) + (F.col("ref") == x).cast("int") for c, x in zip(("a", "c", "g", "t", "gap"), "ACGT-", strict=True)]
    most = F.greatest(*votes)
    likeliest = F.coalesce(*[F.when(v == most, F.lit(x)) for v, x in zip(votes, "ACGT-", strict=True)])
    consensus = F.when(F.col("same") == F.col("members"), F.col("ref")).otherwise(F.lit("?"))
    return put.select("ref_id", "pos", "slot", "ref", "members", "a", "c", "g", "t", "other", "gap", "same", consensus.alias("consensus"), F.when(most > 0, likeliest).otherwise(F.col("ref")).alias("likeliest"))


def conserved_motifs(columns: DataFrame, references: DataFrame, by: tuple[str, ...] = ("ref_id",), least: int = 6, share: float = 0.9) -> DataFrame:
    """The columns ``by`` and ``first, last, motif``: runs of at least ``least`` neighbouring places of which each is kept by the given share of the sequences.

    ``columns``: by, pos, same, pairs, one row for each place (``guided.reference_columns``, or slot 0 of ``star_profile``);
    ``references``: ref_id, seq. ``by`` holds ``ref_id``, and what else tells stacks apart. Places that nothing was aligned to break a
    run. Runs are found over ranges of (by, pos), so a long reference is no task of its own.
    """
    keys = list(by)
    good = columns.where((F.col("pairs") > 0) & (F.col("same") * 10 >= share * 10 * F.col("pairs"))).select(*keys, F.col("pos").cast("long").alias("pos"))
    rows = islands.before(islands.dealt(good, keys, ["pos"]), keys, ["pos"], last_pos=("max", F.col("pos")))
    runs = islands.numbered(rows, keys, ["pos"], F.coalesce(F.col("last_pos") < F.col("pos") - 1, F.lit(True))).groupBy(*keys, "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    runs = runs.withColumn("size", F.col("last") - F.col("first") + 1).where(F.col("size") >= least)
    return tiles.sliced(runs, tiles.store(references, "ref_id"), "ref_id", "first", "size", "motif").select(*keys, "first", "last", "motif")
