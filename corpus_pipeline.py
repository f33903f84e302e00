"""A corpus pipeline of five of the operators, each stage on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.llm import bpe, langid, linededup, mixing, neardup
from colinear.session import fresh, small_batches, stored, table

#: Least score (0 to 1) of the language that a document is taken for.
LEAST_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letter, or a score that no language that was learned explains.

    The scores of one text sum to about 1 over the languages, so with four of them the
    nearest one reaches ``LEAST_SCORE`` anyway: it rejects next to nothing but texts
    without a letter, and clean documents stay.
    """
    small_batches(spark)
    model = langid.train(docs)
    lang, score = fresh(docs, "lang_pred", "score")
    found = langid.predict(docs, model, into=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies.

    Exact copies and repeated rows are of one class; a text of fewer than five words is one shingle; null and empty texts are handled as
    ``neardup.classes`` says. All columns stay. An empty table stays empty.
    """
    return neardup.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that an earlier document has; documents that hold nothing else go, and so do null and blank texts.

    Of repeated rows (id and text) none loses a passage to the other. ``n_chars`` is set to the length of the text that is left. An empty table stays empty.
    """
    (away,) = fresh(docs, "removed_spans")
    found = linededup.remove(docs, into=away).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes).get("n_chars", "long")))
    return found.where("text is not null and text rlike '\\\\S'").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents, some of them twice, up to its target.

    A null source is one of its own; null and empty texts have no words and are taken or not without changing any total.
    Repeated rows are drawn each for itself. An empty table stays empty.
    """
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document of the mix: count, digest of the ids and of the text they decode to.

    A null text counts as empty: no tokens. Repeated rows have equal results. An empty table gives no rows.
    """
    return bpe.digests(docs, bpe.default_path())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("bpe", tokenise),
]

#: Classifier, sketches and sampling are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
