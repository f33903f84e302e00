"""Joining sequences whose ends overlap, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colinear.functions.sequence import ambiguity_code, base_bits
from colinear.operators.seeds import kmers_plain, wanted_only
from colinear.session import stored


def word_length(least: int, most: int, ident: float) -> int:
    """The longest words (31 at most) of which every overlap that is allowed has one without a difference: n letters with d differences hold n - d equal ones in d + 1 stretches."""
    allowed = ((n, int((1 - ident) * n + 0.5)) for n in range(least, most + 1))
    return max(1, min(31, *(-(-(n - d) // (d + 1)) for n, d in allowed)))


def letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def overlap_merges(a: DataFrame, b: DataFrame, least: int = 20, most: int = 1000, ident: float = 1.0, best: bool = False) -> DataFrame:
    """``a_id, b_id, overlap, differences, seq``: each pair (seq_id, seq) whose ``a`` ends as ``b`` begins, at the longest overlap of ``least`` to ``most`` letters.

    An overlap of n letters may have (1 - ident) n differences, rounded. ``seq`` is a
    with b's rest behind it; differing letters give their ambiguity code. With ``best``, each end of an ``a`` and each
    start of a ``b`` keeps its longest overlap only (then the fewest differences, then the smaller id).
    Sequences of one id are not joined to themselves. Letters other than A, C, G, T stand in no word
    that brings ends together, and otherwise differ or not as they are. Null and short sequences have no overlaps.

    The last letters of a and the first of b are cut into words, so short that every
    overlap that is allowed shares one; words that meet name a length, and only these lengths are compared.
    """
    k = word_length(least, most, ident)
    size = F.length("seq")
    tails = stored(a.where(size >= least).select(F.col("seq_id").alias("a_id"), F.col("seq").alias("a_seq"), F.substring("seq", -most, most).alias("tail")), "tails")
    heads = stored(b.where(size >= least).select(F.col("seq_id").alias("b_id"), F.col("seq").alias("b_seq"), F.substring("seq", 1, most).alias("head")), "heads")
    x, y = kmers_plain(tails, k, "a_id", "tail"), kmers_plain(heads, k, "b_id", "head")
    met = x.withColumnRenamed("id", "a_id").join(wanted_only(y, x, ["word"]).select("word", F.col("id").alias("b_id"), F.col("pos").alias("b_pos")), "word").where("a_id <> b_id")
    lengths = tails.select("a_id", F.length("tail").alias("size"))
    tried = met.select("a_id", "b_id", (F.col("b_pos") - F.col("pos")).alias("shift")).distinct().join(lengths, "a_id")
    tried = tried.select("a_id", "b_id", (F.col("size") + F.col("shift")).cast("int").alias("overlap")).where(F.col("overlap").between(least, most))
    pairs = tried.join(tails.select("a_id", "tail"), "a_id").join(heads.select("b_id", "head"), "b_id").where((F.col("overlap") <= F.length("tail")) & (F.col("overlap") <= F.length("head")))
    end, start = letters(F.substr("tail", F.length("tail") - F.col("overlap") + 1)), letters(F.substr("head", F.lit(1), F.col("overlap")))
    same = F.aggregate(F.zip_with(end, start, lambda p, q: F.when(p == q, 0).otherwise(1)), F.lit(0), lambda n, d: n + d)
    good = pairs.select("a_id", "b_id", "overlap", same.alias("differences")).where(F.col("differences") <= F.floor((1 - ident) * F.col("overlap") + 0.5))
    order = [F.desc("overlap"), "differences"]
    first = lambda df, by, then: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order, *then))).where("_n = 1").drop("_n")
    good = good.groupBy("a_id", "b_id").agg(F.max(F.struct("overlap", "differences")).alias("o")).select("a_id", "b_id", "o.*")
    if best:
        good = first(first(good, ["a_id"], ["b_id"]), ["b_id"], ["a_id"])
    rows = good.join(tails.select("a_id", "a_seq"), "a_id").join(heads.select("b_id", "b_seq"), "b_id")
    code = lambda p, q: F.when(p == q, p).otherwise(ambiguity_code(base_bits(p).bitwiseOR(base_bits(q))))
    cut = F.length("a_seq") - F.col("overlap")
    joint = F.zip_with(letters(F.substr("a_seq", cut + 1)), letters(F.substr("b_seq", F.lit(1), F.col("overlap"))), code)
    merged = F.concat(F.substr("a_seq", F.lit(1), cut), F.array_join(joint, ""), F.substr("b_seq", F.col("overlap") + 1))
    return rows.select("a_id", "b_id", "overlap", "differences", merged.alias("seq"))
