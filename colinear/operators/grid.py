"""Search planning on a grid of chunk pairs (pixels)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colinear.functions.sequence import revcomp


def chunks(sequences: DataFrame, size: int = 4096, overlap: int = 0, id_col: str = "seq_id", seq: str = "seq") -> DataFrame:
    """``seq_id, chunk, start, end, all_n, seq``: a sequence of length l in 1 + l div (size - overlap) pieces.

    Sequences below 6 letters are left out; a chunk of Ns only is emptied.
    """
    step = size - overlap
    rows = sequences.select(F.col(id_col).alias("seq_id"), F.col(seq).alias("s"), F.length(seq).cast("long").alias("l")).where("l >= 6")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("l") / step))))
    rows = rows.withColumn("start", F.col("chunk") * step).withColumn("end", F.least(F.col("l"), (F.col("chunk") + 1) * step + overlap)).where(F.col("end") > F.col("start"))
    piece = F.substring("s", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    rows = rows.withColumn("piece", piece).withColumn("all_n", F.translate("piece", "NX", "") == "")
    return rows.select("seq_id", "chunk", "start", "end", "all_n", F.when(F.col("all_n"), "").otherwise(F.col("piece")).alias("seq"))


def pixel(t_start: Column, q_start: Column, t_chunk: int, q_chunk: int, pixel_size: int = 1) -> tuple[Column, Column]:
    """(x, y) of a match: target chunks step by three quarters of their size and overlap by one."""
    step = t_chunk * 3 // 4
    x = F.floor(t_start / step)
    x = F.when((x > 0) & (F.pmod(t_start, F.lit(step)) < t_chunk - step), x - 1).otherwise(x)
    y = F.floor(q_start / q_chunk)
    return F.floor(x / pixel_size), F.floor(y / pixel_size)


def pixels(matches: DataFrame, t_chunk: int = 4096, q_chunk: int = 4096) -> DataFrame:
    """Matches with their pixel and weight: the whole number below 100 * identity * length."""
    x, y = pixel(F.col("t_start"), F.col("q_start"), t_chunk, q_chunk)
    return matches.withColumns({"x": x, "y": y, "weight": F.floor(F.lit(100) * F.col("ident") * F.col("len"))})


def weights(found: DataFrame, searched: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, x, y, weight``: the greatest weight on each pixel; pixels already searched (keys, x, y) pass theirs on to the 8 neighbours. ``keys`` tell grids apart."""
    at = [*keys, "x", "y"]
    own = found.groupBy(*at).agg(F.max("weight").alias("weight"))
    done = own.join(searched.select(*at).distinct(), at, "left_semi")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]))
    near = done.withColumn("d", around).select(*keys, (F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y"), "weight").where("x >= 0 and y >= 0")
    return own.unionByName(near).groupBy(*at).agg(F.max("weight").alias("weight"))


def occupancy(found: DataFrame) -> DataFrame:
    """Sum of match lengths by axis and chunk."""
    axes = F.explode(F.array(F.struct(F.lit("target").alias("axis"), F.col("x").alias("chunk")), F.struct(F.lit("query").alias("axis"), F.col("y").alias("chunk"))))
    return found.select(axes.alias("a"), "len").groupBy("a.axis", "a.chunk").agg(F.sum("len").alias("bases"))


def top_pixels(weighed: DataFrame, searched: DataFrame, n: int) -> DataFrame:
    """The n heaviest pixels that were not searched, by weight, x, y."""
    return weighed.where("weight > 0").join(searched.select("x", "y"), ["x", "y"], "left_anti").orderBy(F.desc("weight"), "x", "y").limit(n)


def stretches(axis: DataFrame, least: int) -> DataFrame:
    """Runs ``first, last`` of chunks (chunk, bases) that no match covers, ``least`` chunks long at least, by sequence."""
    along = Window.partitionBy("seq").orderBy("chunk")
    rows = axis.withColumn("free", (F.col("bases") == 0).cast("int")).withColumn("new", F.when(F.lag("free").over(along) == F.col("free"), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(along)).where("free = 1")
    runs = rows.groupBy("seq", "run").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    return runs.where(F.col("last") - F.col("first") + 1 >= least).select("seq", "first", "last")


def seed_lines(targets: DataFrame, queries: DataFrame, n: int, least: int = 4) -> DataFrame:
    """The n longest uncovered target stretches, and those as long as the last of them, each paired with the uncovered query stretch of its rank.

    Runs as two ranked lists joined by rank, so no stretch meets every other.
    """
    from colinear.operators.ranking import global_rank

    def rank(rows: DataFrame) -> DataFrame:
        sized = rows.withColumn("size", F.col("first") - F.col("last") - 1)  # longest first
        last = sized.orderBy("size").limit(n).agg(F.max("size")).first()[0]
        ranked, _ = global_rank(sized.where(F.col("size") <= F.lit(last)), ["size", "seq", "first"])
        return ranked.withColumn("line", (F.col("_rank") + 1).cast("int"))

    t, q = rank(stretches(targets, least)), rank(stretches(queries, 1))
    return t.select("line", F.col("seq").alias("target_id"), F.col("first").alias("t_first"), F.col("last").alias("t_last")).join(q.select("line", F.col("seq").alias("query_id"), F.col("first").alias("q_first"), F.col("last").alias("q_last")), "line")


def chunk_pairs(tasks: DataFrame) -> DataFrame:
    """Every (t_chunk, q_chunk) of tasks given by chunk ranges t_first..t_last, q_first..q_last."""
    return tasks.withColumn("t_chunk", F.explode(F.sequence("t_first", "t_last"))).withColumn("q_chunk", F.explode(F.sequence("q_first", "q_last")))


def banded_pairs(a: DataFrame, b: DataFrame, band: int = 3) -> DataFrame:
    """Pairs of rows (name, i) whose numbers differ by ``band`` at most, of one name: an equi-join on shifted numbers."""
    shifted = a.withColumn("j", F.explode(F.sequence(F.col("i") - band, F.col("i") + band)))
    return shifted.join(b.select("name", F.col("i").alias("j")), ["name", "j"]).select("name", "i", "j")


def chunk_range(pieces: DataFrame) -> DataFrame:
    """First and last chunk of every sequence."""
    return pieces.groupBy("seq_id").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"))


def parse_pairs(text: Column) -> Column:
    """Array of (t1, t2, q1, q2) from ``[t1-t2,q1-q2]`` repeated."""
    parts = F.regexp_extract_all(text, F.lit(r"\[(\d+-\d+,\d+-\d+)\]"), F.lit(1))
    number = lambda x, k: F.element_at(F.split(x, "[-,]"), k).cast("long")
    return F.transform(parts, lambda x: F.struct(number(x, 1).alias("t1"), number(x, 2).alias("t2"), number(x, 3).alias("q1"), number(x, 4).alias("q2")))


def allowed(pairs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pairs (t, q) that lie in one of the ranges (t1, t2, q1, q2): ranges are spelt out by target chunk, then a semi-join."""
    spelt = ranges.withColumn("t", F.explode(F.sequence("t1", "t2")))
    return pairs.join(spelt.select("t", "q1", "q2"), (pairs["t"] == spelt["t"]) & pairs["q"].between(spelt["q1"], spelt["q2"]), "left_semi")


def assign_blocks(pieces: DataFrame, n: int, block: int | None = None) -> DataFrame:
    """Adds ``block`` (0 to n - 1): chunks dealt evenly in order; with ``block``, only that one's."""
    from colinear.operators.ranking import global_rank

    ranked, total = global_rank(pieces, ["seq_id", "chunk"])
    out = ranked.withColumn("block", F.floor(F.col("_rank") * n / max(total, 1)).cast("int")).drop("_rank")
    return out if block is None else out.where(F.col("block") == block)


def shared_words(query: DataFrame, target: DataFrame, k: int = 12, least: int = 2) -> DataFrame:
    """Query chunks (seq_id, seq) of which a run of ``least`` words in a row stands in some target chunk or its reverse complement."""
    from colinear.operators.seeds import spans, wanted_only

    # the query's own reverse complement stands for the target's, which needs to be read once only
    strands = query.select("seq_id", F.explode(F.array("seq", revcomp(F.col("seq")))).alias("seq"))
    (q, key), (t, _) = spans(strands, k, least), spans(target, k, least)
    found = q.join(wanted_only(t, q, key).select(*key).distinct(), key, "left_semi")
    return query.join(found.select(F.col("id").alias("seq_id")).distinct(), "seq_id", "left_semi")
