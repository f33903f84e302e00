"""Sequence files: FASTA, FASTQ and quality files in, FASTA out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colinear.functions.sequence import characters, clean_name, flat
from colinear.session import stored

#: Runs that are handed on at a time.
GAPS = 1 << 16


def records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``value, file``: what stands between the ``>`` that begin a line; text before the first is left out, and so are empty records."""
    files = paths.split(",") if isinstance(paths, str) else list(paths)
    rows = spark.read.option("lineSep", "\n>").text(files).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    # only what stands first in a file still has its own ">", or comes before the first
    first = rows.where("block = 0").groupBy("file").agg(F.min("n").alias("n")).withColumn("first", F.lit(True))
    value = F.when(F.col("first").isNull(), F.col("value")).when(F.col("value").startswith(">"), F.expr("substring(value, 2)"))
    return rows.join(first, ["file", "n"], "left").select(value.alias("value"), "file").where("value is not null and trim(value) <> ''")


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``name, seq, file``: records of FASTA files (a list or a comma list), names without ``>`` and with ``_`` for blanks, letters in upper case.

    Of each sequence line the first word counts. Files are split where a line begins with ``>``, so a file is read by many
    tasks. Nucleotides and proteins are read alike, ``*`` too.
    """
    lines = F.split(F.col("value"), r"\r?\n")
    body = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.regexp_extract(x, r"^\s*(\S*)", 1))
    return records(spark, paths).select(clean_name(F.element_at(lines, 1)).alias("name"), F.upper(F.array_join(body, "")).alias("seq"), "file")


def with_ids(sequences: DataFrame) -> DataFrame:
    """Adds ``seq_id`` in the order of file and name, and ``len``."""
    from colinear.operators.ranking import global_rank

    ranked, _ = global_rank(sequences, [c for c in ("file", "name", "seq") if c in sequences.columns])
    return ranked.withColumnRenamed("_rank", "seq_id").withColumn("len", F.length("seq").cast("long"))


def partial(sequences: DataFrame, first: int, count: int) -> DataFrame:
    """``count`` sequences from ``first`` on, by seq_id."""
    return sequences.where(F.col("seq_id").between(first, first + count - 1))


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``name, seq, qual`` of four-line records.

    Lines are read by the splits of the files; a line's number in its file is its place in the split and the lines of the
    splits before, which are counted. No task needs more than its split.
    """
    files = paths.split(",") if isinstance(paths, str) else list(paths)
    lines = spark.read.text(files).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", r"\r$", "").alias("line"))
    lines = stored(lines, "lines")
    blocks = lines.groupBy("file", "block").agg(F.min("n").alias("first"), F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.join(blocks.withColumn("before", before), ["file", "block"]).withColumn("at", F.col("n") - F.col("first") + F.col("before"))
    rows = numbered.withColumns({"record": F.floor(F.col("at") / 4), "part": F.col("at") % 4}).groupBy("file", "record")
    wide = rows.agg(*[F.max(F.when(F.col("part") == k, F.col("line"))).alias(c) for k, c in ((0, "header"), (1, "seq"), (3, "qual"))])
    return wide.where("header like '@%' and seq is not null").select(clean_name(F.expr("substring(header, 2)")).alias("name"), F.upper("seq").alias("seq"), "qual")


def read_qualities(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``name, qual`` (array of int) of a quality file in FASTA form."""
    lines = F.split(F.col("value"), r"\r?\n")
    numbers = F.filter(F.split(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), " "), r"\s+"), lambda x: x != "")
    return records(spark, paths).select(clean_name(F.element_at(lines, 1)).alias("name"), F.transform(numbers, lambda x: x.cast("int")).alias("qual"))


def with_qualities(sequences: DataFrame, qualities: DataFrame) -> DataFrame:
    """Sequences with their qualities by name; null where there are none."""
    return sequences.join(qualities, "name", "left")


def fasta_lines(sequences: DataFrame, skip_empty: bool = False, width: int = 80) -> DataFrame:
    """``value``: each record as text, its sequence in lines of ``width``; a record without a name is ``Sequence_i``."""
    rows = sequences.where("seq <> ''") if skip_empty else sequences
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("Sequence_"), F.col("seq_id").cast("string"))) if "seq_id" in sequences.columns else F.col("name")
    return rows.select(F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(F.coalesce("seq", F.lit("")), f"(.{{{width}}})(?=.)", "$1\n")).alias("value"))


def write_fasta(sequences: DataFrame, path: str, skip_empty: bool = False) -> None:
    fasta_lines(sequences, skip_empty).write.text(path)


def quality_lines(sequences: DataFrame) -> DataFrame:
    return sequences.select(F.concat(F.lit(">"), "name", F.lit("\n"), F.array_join(F.col("qual").cast("array<string>"), " ")).alias("value"))


def unique_sorted(sequences: DataFrame) -> DataFrame:
    """Distinct (name, seq), by seq and name."""
    return sequences.select("name", "seq").distinct().orderBy("seq", "name")


def erase(sequences: DataFrame, names: DataFrame) -> DataFrame:
    """Sequences whose name is not in ``names``."""
    return sequences.join(names.select("name").distinct(), "name", "left_anti")


def name_ids(names: DataFrame) -> DataFrame:
    """``name, id``: the distinct names, numbered from 0 in their order."""
    from colinear.operators.ranking import global_rank

    ranked, _ = global_rank(names.select("name").distinct(), ["name"])
    return ranked.withColumnRenamed("_rank", "id")


def n_gaps(sequences: DataFrame, letter: str = "N") -> DataFrame:
    """``name, start, end`` of the runs of N, or of another ASCII letter. The sequences of a batch are read in a row, and runs end where a sequence does."""
    if len(letter) != 1 or not letter.isascii():
        raise ValueError("one ASCII letter")
    rows = sequences.select("name", "seq").where("seq is not null")
    kind = dict(rows.dtypes)["name"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, ends = flat(characters(b.column("seq")))
            ends = ends.astype(np.int64)
            own = held == ord(letter)
            edge = np.zeros(len(own) + 1, bool)
            edge[ends] = True  # a sequence begins or ends here
            first = np.flatnonzero(own & (edge[:-1] | ~np.concatenate([[False], own[:-1]])))
            last = np.flatnonzero(own & (edge[1:] | ~np.concatenate([own[1:], [False]])))
            row = np.searchsorted(ends, first, "right") - 1
            for k in range(0, len(first), GAPS):
                x = slice(k, k + GAPS)
                yield pa.RecordBatch.from_arrays([b.column("name").take(pa.array(row[x])), pa.array(first[x] - ends[row[x]]), pa.array(last[x] + 1 - ends[row[x]])], ["name", "start", "end"])

    return rows.mapInArrow(run, f"name {kind}, start long, end long")


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
