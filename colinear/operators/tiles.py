"""Slices of long sequences: a store of fixed pieces, and a join that puts slices together from them.

A row that asks for a slice names the pieces it lies on; no row ever carries a whole sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colinear.functions.sequence import revcomp
from colinear.session import stored

#: Letters of a piece.
TILE = 1 << 14


def tiles(sequences: DataFrame, id_col: str = "seq_id", seq: str = "seq", size: int = TILE, step: int | None = None) -> DataFrame:
    """``id, tile, letters, total``: sequences cut into pieces of ``size`` letters, numbered from 0, with the sequence's length. An empty sequence has one empty piece, a null one none. Pieces begin every ``step`` letters, if given."""
    every = step or size
    rows = sequences.select(F.col(id_col).alias("id"), F.col(seq).alias("seq")).where("seq is not null")
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                s = b.column("seq")[i].as_py()
                for first in range(0, len(s) or 1, every * 256):
                    cut = [s[k : k + size] for k in range(first, min(len(s) or 1, first + every * 256), every)]
                    ids = b.column("id").take(pa.array([i] * len(cut)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(range(first // every, first // every + len(cut)), pa.int64()), pa.array(cut), pa.array([len(s)] * len(cut), pa.int64())], ["id", "tile", "letters", "total"])

    return rows.mapInArrow(run, f"id {kind}, tile long, letters string, total long")


#: Names of sequences up to which they are broadcast.
FEW = 200_000


def store(sequences: DataFrame, id_col: str = "seq_id", seq: str = "seq", size: int = TILE, only: DataFrame | None = None) -> DataFrame:
    """``tiles``, written to the shared folder: what several slices are taken from. ``only``, if given, has the names of the sequences that are asked for (one column, repeats do no harm); the others aren't written."""
    return stored(tiles(sequences if only is None else named(sequences, only, id_col), id_col, seq, size), "tiles")


def named(rows: DataFrame, only: DataFrame, id_col: str = "seq_id") -> DataFrame:
    """The rows whose name is in ``only`` (one column, repeats do no harm)."""
    names = stored(only.toDF("_name").distinct(), "names")
    return rows.join(F.broadcast(names) if names.count() <= FEW else names, F.col(id_col) == F.col("_name"), "left_semi")


def totals(held: DataFrame) -> DataFrame:
    """``id, total``: the length of every sequence of a store."""
    return held.where("tile = 0").select("id", "total")


def sliced(rows: DataFrame, held: DataFrame, seq_id: str, start: str, length: str, into: str, reverse: str | None = None, size: int = TILE) -> DataFrame:
    """``rows`` with ``into``: ``length`` letters from ``start`` (0-based) of the sequence that ``seq_id`` names, what lies outside left out.

    ``held``: ``tiles`` of that ``size``. Where the boolean column ``reverse`` is true,
    starts are on the reverse complement and so are the letters. Rows whose
    sequence isn't there are left out, as by a join; slices of nothing are empty. Repeated rows stay apart.
    ``rows`` needs columns other than those that begin with ``_``.
    """
    known = rows.join(totals(held).select(F.col("id").alias("_id"), F.col("total").alias("_total")), F.col(seq_id) == F.col("_id")).drop("_id")
    turned = F.coalesce(F.col(reverse), F.lit(False)) if reverse else F.lit(False)
    a, b = F.greatest(F.col(start), F.lit(0)).cast("long"), F.least(F.col(start) + F.col(length), F.col("_total")).cast("long")
    asked = known.withColumns({"_turned": turned, "_a": a, "_b": b})
    asked = asked.withColumns({"_a": F.when(F.col("_turned"), F.col("_total") - F.col("_b")).otherwise(F.col("_a")), "_b": F.when(F.col("_turned"), F.col("_total") - F.col("_a")).otherwise(F.col("_b")), "_row": F.monotonically_increasing_id()})
    asked = stored(asked.drop("_total"), "asked")
    on = F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor((F.col("_b") - 1) / size)))
    wants = asked.where("_b > _a").select("_row", "_a", "_b", F.col(seq_id).alias("id"), on.alias("tile"))
    first = F.col("tile") * size
    from_, to = F.greatest(F.col("_a") - first, F.lit(0)), F.least(F.col("_b") - first, F.lit(size))
    parts = wants.join(held.select("id", "tile", "letters"), ["id", "tile"]).select("_row", "tile", F.substring("letters", (from_ + 1).cast("int"), (to - from_).cast("int")).alias("part"))
    whole = parts.groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "part"))), lambda x: x["part"]), "").alias("_slice"))
    letters = F.coalesce("_slice", F.lit(""))
    out = asked.join(whole, "_row", "left").withColumn(into, F.when(F.col("_turned"), revcomp(letters)).otherwise(letters))
    return out.drop("_row", "_slice", "_turned", "_a", "_b")
