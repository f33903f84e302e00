"""Periodic runs of words: stretches that repeat with one period.

A harmonic grid: for each period p the places 0, p, 2p, ... are taken; a run of at least
``FOLD`` periods holds so many of them in a row, with equal words. At each such place
j p, the longest common extensions of j p and (j + 1) p, forward and backward, give the
maximal stretch of period p. Extensions come from the suffix array of the
words and that of the reversed words, with range minima over their common prefixes. They
are built for texts with a candidate only. Whole texts are worked off each by itself, in numpy.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.session import added, table

#: A run's words at least, and its length in periods at least.
LEAST, FOLD = 6, 4
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Places of a block of the range minima; grid places and candidates that are worked off at a time.
BLOCK, AT_A_TIME = 16, 1 << 19


class Extensions:
    """Longest common prefixes of suffixes of one sequence (ids from 0): suffix array by doubling, common prefixes of neighbours, range minima by blocks."""

    def __init__(self, ids: np.ndarray):
        n = self.n = len(ids)
        levels, rank, width = [], np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
        while True:
            levels.append(rank.astype(np.int32))
            if width >= n or int(rank.max(initial=0)) == n - 1:
                break
            behind = np.zeros(n, np.int64)
            behind[: n - width] = rank[width:] + 1
            key = rank * (n + 1) + behind
            order = np.argsort(key)
            new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            width *= 2
        self.rank = levels[-1].astype(np.int64)
        suffixes = np.argsort(self.rank)
        # a level compares 2^level words, where both suffixes have them: what is shared is added from the longest level down
        a, b, shared = suffixes[:-1].copy(), suffixes[1:].copy(), np.zeros(max(n - 1, 0), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            size, ranks = 1 << level, levels[level]
            fits = np.flatnonzero((a + size <= n) & (b + size <= n))
            fits = fits[ranks[a[fits]] == ranks[b[fits]]]
            for x in (a, b, shared):
                x[fits] += size
        self.shared = shared
        blocks = -(-max(n - 1, 1) // BLOCK)
        padded = np.full(blocks * BLOCK, n, np.int64)
        padded[: n - 1] = shared
        square = padded.reshape(blocks, BLOCK)
        self.flat, self.ahead, self.behind = padded, np.minimum.accumulate(square, axis=1).ravel(), np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [square.min(axis=1)]
        while (1 << len(self.table)) <= blocks:
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima over lo..hi (both included) of the common prefixes."""
        a, z = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.behind[lo], self.ahead[hi])
        inside = a == z
        if inside.any():
            x, y = lo[inside], hi[inside]
            got = self.flat[x]
            for k in range(1, BLOCK):
                got = np.minimum(got, self.flat[np.minimum(x + k, y)])
            out[inside] = got
        far = np.flatnonzero(z - a > 1)
        if len(far):
            span = z[far] - a[far] - 1
            level = np.frexp(span.astype(float))[1] - 1
            for k in np.unique(level):
                at = far[level == k]
                out[at] = np.minimum(out[at], np.minimum(self.table[k][a[at] + 1], self.table[k][z[at] - (1 << int(k))]))
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``a`` and ``b`` (different; n: the empty one) have in common at their start."""
        out = np.zeros(len(a), np.int64)
        real = np.flatnonzero((a < self.n) & (b < self.n))
        x, y = self.rank[a[real]], self.rank[b[real]]
        out[real] = self.least(np.minimum(x, y), np.maximum(x, y) - 1)
        return out


@dataclass
class Found:
    """Runs by start, then period."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def grid(ids: np.ndarray, fold: int = FOLD) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places j p, periods p) where ``fold`` grid places in a row, from j p on, have equal words; a run of period p has such a place."""
    n, out = len(ids), []
    each = np.arange(1, n // fold + 1)
    counts = (n - 1 - (fold - 1) * each) // each + 1  # places with fold - 1 more behind them
    ends = np.searchsorted(total := np.cumsum(counts), np.arange(AT_A_TIME, total[-1] + AT_A_TIME, AT_A_TIME)) if len(each) else []
    first = 0
    for end in np.unique(ends):
        p, c = each[first : end + 1], counts[first : end + 1]
        first = end + 1
        periods = np.repeat(p, c)
        places = (np.arange(len(periods)) - np.repeat(np.cumsum(c) - c, c)) * periods
        word = ids[places]
        for k in range(1, fold):
            same = np.flatnonzero(ids[places + k * periods] == word)
            places, periods, word = places[same], periods[same], word[same]
        if len(places):
            out.append((places, periods))
    return out


def runs(ids: np.ndarray, least: int = LEAST, fold: int = FOLD) -> Found:
    """The maximal runs of a sequence of ids: smallest period q, at least max(least, fold q) long, not to be extended with period q. ``fold`` is 2 or more."""
    n, parts = len(ids), []
    pieces = grid(ids, fold)
    if pieces:
        ahead, back = Extensions(ids), Extensions(ids[::-1])
        for places, periods in pieces:
            for k in range(0, len(places), AT_A_TIME):
                a, p = places[k : k + AT_A_TIME], periods[k : k + AT_A_TIME]
                start = a - back.common(n - a, n - a - p)
                length = a + p + ahead.common(a, a + p) - start
                good = length >= np.maximum(least, fold * p)
                rows = np.stack([start[good], length[good], p[good]], axis=1)
                parts.append(rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))[: len(rows)]])  # places of one run follow each other
    rows = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]  # an interval's smallest period comes first
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return Found(rows[:, 0], rows[:, 1], rows[:, 2])


def best(found: Found) -> tuple[int, int, int] | None:
    """(start, length, period) of the run with the most periods, exactly; of equals the first, then the shortest period."""
    if not len(found.start):
        return None
    share = found.length / found.period
    near = np.flatnonzero(share >= share.max() * (1 - 1e-12))  # floats may not tell these apart
    _, start, q, length = max((Fraction(int(found.length[k]), int(found.period[k])), -int(found.start[k]), -int(found.period[k]), int(found.length[k])) for k in near)
    return -start, length, -q


def kept(n: int, found: Found) -> np.ndarray:
    """Which words stay: those in no run, or in the first period of every run that holds them."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, found.start + found.period, 1)
    np.add.at(marks, found.start + found.length, -1)
    return np.cumsum(marks)[:n] == 0


def planted(n: int, doc_id: object) -> np.ndarray | None:
    """The words that stand at each place once a tail is made periodic, for one id of ten; None for the others. A null id counts as an empty one."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def detect(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, fold: int = FOLD, plant: bool = False) -> DataFrame:
    """All columns of ``docs`` and what runs of words their texts have; columns of the new names are replaced.

    ``n_words``, ``n_runs``; of the run with the most periods ``start, length, period``
    (null without a run); ``runs``: array of (start, length, period), by start, then period;
    ``collapsed``: the words that are left when each run keeps its first period, joined
    by one space. Words are what stands between blanks (space, tab to carriage return);
    places count words from 0. Null and empty texts have no words and collapse to an empty string. Repeated rows
    have equal results. ``plant`` makes the tails of one document of ten periodic first (``planted``). An empty table stays empty.
    """

    def one(doc_id: object, t: str | None) -> tuple:
        words = WORD.findall(t or "")
        number: dict[str, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        at = planted(len(words), doc_id) if plant else None
        if at is not None:
            ids = ids[at]
        found = runs(ids, least, fold)
        top = best(found) or (None, None, None)
        if len(found.start):
            stay = np.flatnonzero(kept(len(words), found))
            words = [words[i] for i in (stay if at is None else at[stay])]
        elif at is not None:
            words = [words[i] for i in at]
        return len(ids), found, top, " ".join(words)

    def make(id_array: pa.Array, texts: pa.Array) -> list[pa.Array]:
        rows = [one(i, t.as_py()) for i, t in zip(id_array.to_pylist(), texts, strict=True)]
        sizes = [len(f.start) for _, f, _, _ in rows]
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *[getattr(f, k) for _, f, _, _ in rows]])) for k in ("start", "length", "period")], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
        tops = [pa.array([top[k] for _, _, top, _ in rows], pa.int64()) for k in range(3)]
        return [pa.array([n for n, *_ in rows], pa.int64()), pa.array(sizes, pa.int64()), *tops, lists, pa.array([c for *_, c in rows], pa.string())]

    return added(docs, "n_words long, n_runs long, start long, length long, period long, runs array<struct<start: long, length: long, period: long>>, collapsed string", make, [id_col, text])


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"), plant=True)
    line = lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))
    return found.select("doc_id", "n_runs", "start", "length", "period", F.floor(1000 * F.col("length") / F.col("period")).cast("long").alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
