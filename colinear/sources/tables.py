"""Match, summary, feature and block files, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUMMARY = "t_name string, t_start long, t_end long, q_name string, q_start long, q_end long, ident double, ori string"
MATCHES = "target_id long, query_id long, query_size long, t_start long, q_start long, len long, rc boolean, prob double, ident double, matches double"


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """A match store; columns that an older store lacks are null."""
    rows = spark.read.parquet(path)
    return rows.select(*[F.col(n).cast(k) if n in rows.columns else F.lit(None).cast(k).alias(n) for n, k in (c.split() for c in MATCHES.split(", "))])


def write_matches(matches: DataFrame, path: str) -> None:
    matches.write.mode("overwrite").parquet(path)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seeds on the forward query, turned to the reversed query where they are reverse."""
    rows = spark.read.parquet(path)
    return rows.withColumn("q_start", F.when(F.col("rc"), F.col("query_size") - F.col("len") - F.col("q_start")).otherwise(F.col("q_start")))


def read_summary(spark: SparkSession, path: str, cut_long: bool = False) -> DataFrame:
    """A summary file; orientation ``1`` and ``-1`` are read as signs. ``cut_long`` keeps 100 bases of blocks above 10 kb."""
    rows = spark.read.schema(SUMMARY).option("sep", "\t").csv(path)
    rows = rows.withColumn("ori", F.when(F.col("ori").isin("-", "-1"), "-").otherwise("+"))
    if cut_long:
        long = F.col("t_end") - F.col("t_start") > 10_000
        rows = rows.withColumns({"t_end": F.when(long, F.col("t_start") + 100).otherwise(F.col("t_end")), "q_end": F.when(long, F.col("q_start") + 100).otherwise(F.col("q_end"))})
    return rows


def summary_lines(summary: DataFrame) -> DataFrame:
    return summary.select(F.format_string("%s\t%d\t%d\t%s\t%d\t%d\t%f\t%s", "t_name", "t_start", "t_end", "q_name", "q_start", "q_end", "ident", "ori").alias("value"))


def write_summary(summary: DataFrame, path: str) -> None:
    summary_lines(summary).write.text(path)


def parse_gff(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(axes: seq, size) and (features: seq, type, start, end; 0-based, half-open) of the lines (``value``) of GFF3 files.

    Rows of type ``chromosome`` with a name below 4 letters are axes; features on other sequences are left out. So are comments and lines without numbers.
    """
    p = F.split("value", "\t")
    at = lambda k: F.try_element_at(p, F.lit(k))
    rows = lines.where(~F.col("value").startswith("#")).select(at(1).alias("seq"), at(3).alias("type"), at(4).try_cast("long").alias("start"), at(5).try_cast("long").alias("end"))
    rows = rows.where("start is not null and end is not null")
    axes = rows.where((F.col("type") == "chromosome") & (F.length("seq") < 4)).groupBy("seq").agg(F.min(F.col("start") - 1).alias("first"), F.max("end").alias("last"))
    features = rows.where(F.col("type") != "chromosome").join(axes, "seq").select("seq", "type", (F.col("start") - 1 - F.col("first")).alias("start"), (F.col("end") - F.col("first")).alias("end"))
    return axes.select("seq", (F.col("last") - F.col("first")).alias("size")), features


def read_gff(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``parse_gff`` of a GFF3 file, or a folder of them."""
    return parse_gff(spark.read.text(path))


def gff(summary: DataFrame, on_target: bool = True, order: list[str] | None = None) -> DataFrame:
    """A summary as GFF3 rows (1-based, closed), numbered in the order of the target."""
    from colinear.operators.ranking import global_rank

    ranked, _ = global_rank(summary, order or ["t_name", "t_start", "t_end", "q_name", "q_start", "q_end", "ori", "ident"])
    a, b = ("t", "q") if on_target else ("q", "t")
    other = F.format_string("ID=sblock_%d;Name=%s:%d-%d", F.col("_rank"), F.col(f"{b}_name"), F.col(f"{b}_start") + 1, F.col(f"{b}_end"))
    return ranked.select(F.concat_ws("\t", F.col(f"{a}_name"), F.lit("colinear"), F.lit("block"), (F.col(f"{a}_start") + 1).cast("string"), F.col(f"{a}_end").cast("string"), F.lit(""), "ori", F.lit("."), other).alias("value"))


def qlt(summary: DataFrame) -> DataFrame:
    """One QUERY line per match."""
    return summary.select(F.format_string("QUERY %s %d %d %s %s %d %d %f", "q_name", "q_start", "q_end", "ori", "t_name", "t_start", "t_end", "ident").alias("value"))


def extracted(summary: DataFrame, sequences: DataFrame, flank: int = 0) -> DataFrame:
    """``name, seq``: the query interval of every row, with ``flank`` on both sides, reversed for ``-``."""
    from colinear.functions.sequence import revcomp
    from colinear.operators import tiles

    asked = summary.withColumns({"from": F.col("q_start") - flank, "size": F.col("q_end") - F.col("q_start") + 2 * flank})
    rows = tiles.sliced(asked, tiles.store(sequences, "name"), "q_name", "from", "size", "piece")
    return rows.select(F.concat("q_name", F.lit(":"), F.greatest("from", F.lit(0)), F.lit("-"), F.col("q_end") + flank).alias("name"), F.when(F.col("ori") == "-", revcomp(F.col("piece"))).otherwise(F.col("piece")).alias("seq"))


def block_rows(summary: DataFrame, blocks: DataFrame) -> DataFrame:
    """The summary rows of each block (``blocks.synteny_blocks``), with the block's start: rows of its target, query and strand inside it on both axes."""
    b = blocks.select("t_name", "q_name", "ori", F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end"), F.col("q_start").alias("bq_start"), F.col("q_end").alias("bq_end"))
    rows = summary.join(b, ["t_name", "q_name", "ori"])
    inside = (F.col("t_start") >= F.col("b_start")) & (F.col("t_end") <= F.col("b_end")) & (F.col("q_start") >= F.col("bq_start")) & (F.col("q_end") <= F.col("bq_end"))
    return rows.where(inside).drop("b_end", "bq_start", "bq_end")


def block_lines(blocks: DataFrame, t_sizes: DataFrame, q_sizes: DataFrame, least_size: int = 100_000, scale: int = 10, rows: DataFrame | None = None) -> DataFrame:
    """A block file: ``section, key, line, value``; in this order ``value`` is the file.

    Both genomes' names, numbers and sizes of sequences (name, size; of ``least_size`` and more), divided by ``scale``;
    then the blocks on such sequences, each followed by its ``rows`` (``block_rows``), if given, and an empty line. Query names end in Q.
    """
    long = lambda sizes: sizes.where(F.col("size") >= least_size)
    text = lambda section, key, line, value: (F.lit(section).alias("section"), key.cast("string").alias("key"), F.lit(line).cast("long").alias("line"), value.alias("value"))
    out = None
    for section, sizes, title, mark in ((0, t_sizes, "Genome1", ""), (2, q_sizes, "Genome2", "Q")):
        head = long(sizes).agg(F.count("*").alias("n")).select(*text(section, F.lit(""), 0, F.concat(F.lit(f"genome\t{title}\nchromosomes\t"), F.col("n").cast("string"))))
        names = long(sizes).select(*text(section + 1, F.col("name"), 0, F.concat(F.col("name"), F.lit(f"{mark}\t"), F.floor(F.col("size") / scale).cast("string"))))
        head = head.unionByName(names)
        out = head if out is None else out.unionByName(head)
    on = lambda df: df.join(long(t_sizes).select(F.col("name").alias("t_name")), "t_name", "left_semi").join(long(q_sizes).select(F.col("name").alias("q_name")), "q_name", "left_semi")
    sign = F.when(F.col("ori") == "-", "-1").otherwise("+1")
    key = lambda start: F.concat_ws("\t", "t_name", F.format_string("%020d", F.col(start)), "q_name", "ori")
    ident = F.format_string("%f", "ident")
    whole = on(blocks).select(*text(4, key("t_start"), -1, F.concat_ws("\t", "t_name", "t_start", "t_end", F.lit("+1"), F.concat("q_name", F.lit("Q")), "q_start", "q_end", sign, ident, F.col("n").cast("string"))))
    out = out.unionByName(whole)
    if rows is not None:
        detail = on(rows).select(F.lit(4).alias("section"), key("b_start").alias("key"), F.col("t_start").cast("long").alias("line"), F.concat_ws("\t", "t_start", "t_end", F.lit("+1"), F.lit(""), "q_start", "q_end", sign, ident).alias("value"))
        out = out.unionByName(detail)
    return out


def write_blocks(lines: DataFrame, path: str) -> None:
    """The lines of a block file in their order, over as many part files as there are ranges; a block and its rows stay in one."""
    lines.repartitionByRange("section", "key").sortWithinPartitions("section", "key", "line", "value").select("value").write.text(path)


def read_blocks(spark: SparkSession, path: str, scale: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(axes: file, name, size), (blocks), (rows, with the names and the start of their block) of block files.

    Ten columns make a block, two an axis; other rows belong to the block above them in their file.
    """
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(p.alias("p"), F.monotonically_increasing_id().alias("n"), F.col("_metadata.file_path").alias("file"))
    text, number = lambda k: F.element_at("p", k), lambda k: F.element_at("p", k).cast("long")
    ori = lambda k: F.when(text(k) == "-1", "-").otherwise("+").alias("ori")
    axes = lines.where((F.size("p") == 2) & ~text(1).isin("genome", "chromosomes")).select("file", text(1).alias("name"), (number(2) * scale).alias("size"))
    query = lambda c: F.regexp_replace(c, "Q$", "")
    blocks = lines.where(F.size("p") >= 10).select(text(1).alias("t_name"), number(2).alias("t_start"), number(3).alias("t_end"), query(text(5)).alias("q_name"), number(6).alias("q_start"), number(7).alias("q_end"), ori(8), text(9).cast("double").alias("ident"), text(10).cast("int").alias("n"))
    head = F.when(F.size("p") >= 10, F.struct(text(1).alias("t_name"), query(text(5)).alias("q_name"), number(2).alias("b_start")))
    along = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.where(F.size("p") >= 7).withColumn("head", F.last(head, ignorenulls=True).over(along)).where(F.size("p") < 10)
    rows = rows.select("head.*", number(1).alias("t_start"), number(2).alias("t_end"), number(4).alias("q_start"), number(5).alias("q_end"), ori(6), text(7).cast("double").alias("ident"))
    return axes, blocks, rows


def write_round(found: DataFrame, path: str, done: int) -> None:
    """The matches that a round of a search found; a round that is written again is replaced."""
    found.write.mode("overwrite").parquet(f"{path.rstrip('/')}/round={done}")


def read_rounds(spark: SparkSession, path: str) -> DataFrame:
    """All matches that the rounds of a search found, to go on from."""
    return spark.read.parquet(path).drop("round").distinct()


ALIGNMENTS = "id long, t_off long, q_off long, score double, identity double, edits long, p_value double, t_aligned string, q_aligned string"


def write_alignments(alignments: DataFrame, path: str) -> None:
    """A store of alignments (``align.align_pairs``)."""
    alignments.select(*[c.split()[0] for c in ALIGNMENTS.split(", ")]).write.mode("overwrite").parquet(path)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALIGNMENTS).parquet(path)


def read_scores(spark: SparkSession, path: str) -> dict[tuple[str, str], float]:
    """A substitution table in the usual text form: a line of letters, then a letter and its scores in each line; ``#`` begins a comment.

    The table has a row per letter, so it is held as it is.
    """
    lines = [x["value"].split() for x in spark.read.option("wholetext", True).text(path).select(F.explode(F.split("value", r"\r?\n")).alias("value")).collect() if x["value"].strip() and not x["value"].startswith("#")]
    return {(row[0], c): float(v) for row in lines[1:] for c, v in zip(lines[0], row[1:], strict=True)} if lines else {}


def read_selection(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``axis, chunk``: the chunks that any of the selection files (axis, chunk, flag) marks."""
    rows = spark.read.schema("axis string, chunk long, flag int").option("sep", "\t").csv(paths)
    return rows.groupBy("axis", "chunk").agg(F.sum("flag").alias("flag")).where("flag > 0").select("axis", "chunk")


def write_selection(selection: DataFrame, path: str) -> None:
    selection.select("axis", "chunk", F.lit(1)).write.option("sep", "\t").csv(path)


def readable(alignments: DataFrame, width: int = 80) -> DataFrame:
    """Alignments (t_aligned, q_aligned, identity) as text in blocks of ``width`` columns with a line of bars between."""
    same = F.array_join(F.zip_with(F.split("t_aligned", ""), F.split("q_aligned", ""), lambda a, b: F.when(a == b, "|").otherwise(" ")), "")
    cut = lambda c: F.regexp_extract_all(c, F.lit(f"(.{{1,{width}}})"), F.lit(1))
    blocks = F.zip_with(F.zip_with(cut(F.col("t_aligned")), cut(same), lambda a, b: F.concat(a, F.lit("\n"), b)), cut(F.col("q_aligned")), lambda a, b: F.concat(a, F.lit("\n"), b))
    return alignments.select(F.concat(F.format_string("Identity (w/ indel count): %.4f %%\n\n", F.col("identity") * 100), F.array_join(blocks, "\n\n")).alias("value"))


def axis_paint(blocks: DataFrame, order: DataFrame) -> DataFrame:
    """Rectangles ``axis, name, start, end, colour``: one for each block and axis, coloured by the partner's number (name, i)."""
    t = blocks.join(order.select(F.col("name").alias("q_name"), F.col("i").alias("colour")), "q_name").select(F.lit("target").alias("axis"), F.col("t_name").alias("name"), F.col("t_start").alias("start"), F.col("t_end").alias("end"), "colour")
    q = blocks.join(order.select(F.col("name").alias("t_name"), F.col("i").alias("colour")), "t_name").select(F.lit("query").alias("axis"), F.col("q_name").alias("name"), F.col("q_start").alias("start"), F.col("q_end").alias("end"), "colour")
    return t.unionByName(q)


def density_cells(matches: DataFrame, width: int) -> DataFrame:
    """``target_id, bin, bases, grey``: summed lengths by rounded start, and the grey of the cell."""
    rows = matches.groupBy("target_id", F.floor(F.col("t_start") / width + 0.5).alias("bin")).agg(F.sum("len").alias("bases"))
    return rows.withColumn("grey", F.greatest(F.lit(0.0), F.lit(0.999) - F.col("bases") / width))


def dot_plot(matches: DataFrame) -> DataFrame:
    """Line segments of a dot plot; reverse matches fall. Colour: (query + target) mod 10."""
    from colinear.operators.matches import forward

    f = forward(matches)
    return f.select("target_id", "query_id", F.col("t_start").alias("x1"), (F.col("t_start") + F.col("len")).alias("x2"), F.when(F.col("rc"), F.col("q_to")).otherwise(F.col("q_from")).alias("y1"), F.when(F.col("rc"), F.col("q_from")).otherwise(F.col("q_to")).alias("y2"), ((F.col("query_id") + F.col("target_id")) % 10).alias("colour"))


def axis_extent(matches: DataFrame) -> DataFrame:
    return matches.agg(F.max(F.col("t_start") + F.col("len")).alias("t_max"), F.max(F.col("q_start") + F.col("len")).alias("q_max"))


def ticks(extent: int, step: int) -> list[int]:
    """Tick positions of an axis."""
    return list(range(0, extent + 1, step))
