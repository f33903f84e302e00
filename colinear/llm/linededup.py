"""Substring dedup by hashing lines, paragraphs or sentences (lines cut once more, the default).

Texts are cut into units; a unit is normalised (lower case, runs of anything but
letters and digits as one blank) and digested, a short one together with the
units behind it, until there are ``LEAST_WORDS`` words: short lines recur by
chance in documents that have nothing else in common. Digests are grouped over the
whole corpus. The occurrence that ranks first, by document id and then by place,
stays; the units of all others are removed. What was removed is kept as offsets into
the original text, so the original can be put together again.

Only digests and places move between machines until the spans are known; then
each text meets its own spans once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.session import added, fresh, stored, table, tidy

#: Shorter units recur by chance in clean documents: they only go together with what stands next to them.
LEAST_WORDS = 16
#: What ends a unit: a line, a blank line, or a sentence or line.
ENDS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[^\S\n]*\n\s*"), "sentence": re.compile(r"\n|(?<=[.!?])[^\S\n]+")}
OTHER = re.compile(r"[\W_]+")


def units(text: str, kind: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, end with what ends the unit) of every unit of a text, in characters."""
    at = 0
    for m in ENDS[kind].finditer(text):
        yield at, m.start(), m.end()
        at = m.end()
    if at < len(text):
        yield at, len(text), len(text)


def normal(unit: str) -> str:
    return OTHER.sub(" ", unit.lower()).strip()


def windows(text: str, kind: str, least: int) -> Iterator[tuple[int, int, str]]:
    """(first unit, unit behind the last, normalised words) of what is digested: every unit, with as many behind it as ``least`` words need.

    Units without a word begin no window; those at the end of a text that can't reach ``least`` words have none.
    """
    plain = [normal(text[a:b]) for a, b, _ in units(text, kind)]
    counts = [x.count(" ") + 1 if x else 0 for x in plain]
    j, n = 0, 0  # units k to j hold n words
    for k, own in enumerate(counts):
        if j <= k:
            j, n = k, 0
        while j < len(plain) and (n < least or j == k):
            n, j = n + counts[j], j + 1
        if n < least:
            return
        if own:
            yield k, j, plain[k] if j == k + 1 else "\n".join(x for x in plain[k:j] if x)
        n -= own


def spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", unit: str = "sentence", least_words: int = LEAST_WORDS) -> DataFrame:
    """``id, th, places``: the units of a document that begin a repeated window, by place (from 0), ascending.

    ``th`` is the text's xxhash64. Rows that repeat both id and text are one
    document here. Documents rank by id, null ids last, then by ``th``. Documents
    that lose nothing, and null or empty texts, have no row. Windows are told apart
    by 128-bit digests.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th")).where("text <> ''")
    id_kind = dict(rows.dtypes)["id"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, place, found = [], [], []
            for i, t in enumerate(b.column("text")):
                for k, _, w in windows(t.as_py(), unit, least_words):
                    at.append(i)
                    place.append(k)
                    found.append(hashlib.blake2b(w.encode(), digest_size=16).digest())
            index, halves = pa.array(np.array(at, np.int64)), np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), b.column("id").take(index), b.column("th").take(index), pa.array(place, pa.int32())], ["digest", "more", "id", "th", "place"])

    found = stored(rows.mapInArrow(run, f"digest long, more long, id {id_kind}, th long, place int"), "units")
    # Most units occur once: the digests that recur are found first, from the digests alone.
    # (Stored, so that both sides of the joins are plain shuffles, of which Spark splits a digest with very many places.)
    key = ["digest", "more"]
    again = stored(found.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "again")
    recur = stored(found.join(again, key, "left_semi"), "recurring")
    rank = F.struct(F.col("id").isNull().alias("null_id"), F.col("id"), F.col("th"), F.col("place"))
    first = stored(recur.groupBy(*key).agg(F.min(rank).alias("first")), "first")
    gone = recur.join(first, key).where(rank != F.col("first"))
    return gone.groupBy("id", "th").agg(F.array_sort(F.collect_set("place")).alias("places"))


def without(text: str, places: set[int], kind: str, least: int) -> tuple[str, list[dict[str, int]]]:
    """The text without the units of the windows that begin at ``places``, and their (start, end)."""
    lost: set[int] = set()
    for k, j, _ in windows(text, kind, least):
        if k in places:
            lost.update(range(k, j))
    keep, away, at = [], [], 0
    for k, (start, _, stop) in enumerate(units(text, kind)):
        if k in lost:
            keep.append(text[at:start])
            away.append({"start": start, "end": stop})
            at = stop
    return "".join([*keep, text[at:]]), away


def remove(docs: DataFrame, id_col: str = "doc_id", text: str = "text", unit: str = "sentence", least_words: int = LEAST_WORDS, into: str = "removed") -> DataFrame:
    """All rows and columns of ``docs``; ``text`` without its repeated units, and ``into``: array of (start, end) of what was removed.

    Offsets are in characters of the original text and take in what ends the unit
    (its newline, or the blanks behind a sentence). Kept text is not changed. Null
    texts stay null. Any column named as ``into`` is replaced.
    """
    th, gone_id, gone_th, places, left, away = fresh(docs, "th", "gone_id", "gone_th", "places", "left", "away")
    gone = spans(docs, id_col, text, unit, least_words).toDF(gone_id, gone_th, places)
    keyed = docs.withColumn(th, F.xxhash64(F.col(text)))
    both = keyed.join(gone, keyed[id_col].eqNullSafe(gone[gone_id]) & (keyed[th] == gone[gone_th]), "left")
    kept = [c for c in docs.columns if c != into]

    def make(texts: pa.Array, lists: pa.Array) -> list[pa.Array]:
        out = [(t.as_py(), []) if not p.is_valid or not t.is_valid else without(t.as_py(), set(p.as_py()), unit, least_words) for t, p in zip(texts, lists, strict=True)]
        return [pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]

    done = added(both, f"{left} string, {away} array<struct<start: int, end: int>>", make, [text, places], [c for c in kept if c != text])
    return done.select(*[F.col(left).alias(c) if c == text else F.col(f"`{c}`") for c in kept], F.col(away).alias(into))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = remove(docs)
    return found.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), F.transform("removed", lambda x: x["start"].cast("long")).alias("starts"), F.transform("removed", lambda x: x["end"].cast("long")).alias("ends"))
