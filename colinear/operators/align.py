"""Pairwise alignment by dynamic programming, as pandas functions on pairs of sequences.

Aligners: ``SW`` and ``SWGA`` (linear, affine gaps; +1 / -1), ``NS`` and ``NSGA``
(a run of k equal letters scores k cubed, in place of k single letters).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from colinear.functions.scoring import GUMBEL
from colinear.session import spread

#: Fixed values: (gap open, gap extension, mismatch, whether runs score by their cube) of each aligner.
ALIGNERS = {"SW": (-1.0, -1.0, -1.0, False), "SWGA": (-6.0, -1.0, -1.0, False), "NS": (-100.0, -100.0, -8.0, True), "NSGA": (-200.0, -20.0, -8.0, True)}
#: Cells of pairs that are worked off side by side. A pair of more cells goes alone, with rows kept now and then; what lies between is worked off again.
HELD_CELLS = 1 << 22
#: States of a cell: after a mismatch (or at the start), in a run of equal letters, in a gap of the query, in a gap of the target.
OTHER, RUN, UP, LEFT = range(4)


@dataclass
class Alignment:
    t_start: int
    q_start: int
    target: str
    query: str
    score: float

    @property
    def middle(self) -> str:
        return "".join("|" if a == b else " " for a, b in zip(self.target, self.query, strict=True))

    @property
    def identity(self) -> float:
        return self.middle.count("|") / len(self.target) if self.target else 0.0

    @property
    def mismatches(self) -> int:
        return sum(a != b and a != "-" and b != "-" for a, b in zip(self.target, self.query, strict=True))

    @property
    def edits(self) -> int:
        """Mismatches, and one for each run of gaps."""
        last, runs = "", 0
        for a, b in zip(self.target, self.query, strict=True):
            side = "t" if a == "-" else "q" if b == "-" else ""
            runs += bool(side) and side != last
            last = side
        return self.mismatches + runs

    @property
    def plain_score(self) -> int:
        """Equal letters less mismatches less up to 10 for each run of gaps that a column of letters follows."""
        kinds = "".join("g" if "-" in (a, b) else "m" if a == b else "x" for a, b in zip(self.target, self.query, strict=True)).rstrip("g")
        return kinds.count("m") - kinds.count("x") - sum(min(len(g), 10) for g in re.findall("g+", kinds))

    @property
    def contiguity(self) -> float:
        """Mean length of the runs of equal letters."""
        runs = [len(x) for x in self.middle.split() if x]
        return sum(runs) / len(runs) if runs else 0.0


def first_best(*values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest of several arrays, cell by cell, and which one has it (the first of equals)."""
    best, which = values[0], np.zeros(values[0].shape, np.int8)
    for k, v in enumerate(values[1:], 1):
        which[v > best] = k
        best = np.maximum(best, v)
    return best, which


@dataclass
class Row:
    """A row of every pair's table: the value of each state; the greatest of them and its state; open runs (value and row before their first letter), as many as some cell has."""

    states: list[np.ndarray]
    best: np.ndarray
    which: np.ndarray
    bases: list[np.ndarray]
    begins: list[np.ndarray]


class Table:
    """The dynamic program of pairs of sequences side by side, row by row (see ``align_many``)."""

    def __init__(self, pairs: list[tuple[str, str]], aligner: str, band: int, end_to_end: bool):
        self.gap, self.extend, self.miss, self.cube = ALIGNERS[aligner]
        self.kind = np.float64 if self.cube else np.float32  # both hold whole numbers of the sizes that occur
        self.band, self.local = band, not end_to_end
        self.n, self.m = max(len(t) for t, _ in pairs), max(len(q) for _, q in pairs)
        fill = lambda strings, width, pad: np.stack([np.frombuffer(x.encode("ascii", "replace").ljust(width, pad), np.uint8) for x in strings])
        self.t, self.q = fill([t for t, _ in pairs], self.n, b"\1"), fill([q for _, q in pairs], self.m, b"\2")
        self.columns = np.arange(self.m + 1)
        self.slope = (self.columns * self.extend).astype(self.kind)

    def first(self) -> tuple[Row, list[np.ndarray]]:
        shape = (len(self.t), self.m + 1)
        new = [np.full(shape, -np.inf, self.kind) for _ in range(4)]
        new[OTHER][:, 0] = 0.0
        return self.finish(new, [np.full(shape, -1, np.int8) for _ in range(4)], 0, [], [])

    def step(self, row: Row, i: int) -> tuple[Row, list[np.ndarray]]:
        """Row i from row i - 1, and where its cells come from: for each state the state before (for runs of the cubic aligners how long the run is), and the best state that a run can begin behind."""
        shape = (len(self.t), self.m + 1)
        new = [np.full(shape, -np.inf, self.kind) for _ in range(4)]
        back = [np.full(shape, -1, np.int8) for _ in range(4)]
        equal = self.q == self.t[:, i - 1, None]
        before, which = row.best[:, :-1], row.which[:, :-1]
        new[OTHER][:, 1:] = np.where(equal, -np.inf, before + self.miss)
        back[OTHER][:, 1:] = which
        bases, begins = [], []
        if self.cube:
            new[RUN], back[RUN], bases, begins = self.runs(row, i, equal)
        else:
            new[RUN][:, 1:] = np.where(equal, before + 1, -np.inf)
            back[RUN][:, 1:] = which
        new[UP], back[UP] = first_best(row.states[OTHER] + self.gap, row.states[RUN] + self.gap, row.states[UP] + self.extend, row.states[LEFT] + self.gap)
        return self.finish(new, back, i, bases, begins)

    def runs(self, row: Row, i: int, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Values of runs and their lengths. A run that begins at row s is worth what comes before plus (i - s) cubed.

        Of two open runs on a diagonal the older grows faster. So a younger one that
        is not worth more is never needed again; all others stay open, however long they are.
        """
        shape = (len(self.t), self.m + 1)

        def moved(x: np.ndarray, keep: np.ndarray, rest: float) -> np.ndarray:
            out = np.full(shape, rest, x.dtype)
            out[:, 1:] = np.where(keep, x[:, :-1], rest)
            return out

        bases = [moved(x, equal, -np.inf) for x in row.bases]
        begins = [moved(x, equal, 0) for x in row.begins]
        value, begin = np.full(shape, -np.inf), np.zeros(shape, np.int32)
        for base, at in zip(bases, begins, strict=True):
            v = base + (i - at).astype(float) ** 3
            better = v > value
            value, begin = np.where(better, v, value), np.where(better, at, begin)
        ends, _ = first_best(row.states[OTHER], row.states[UP], row.states[LEFT])
        fresh = moved(ends, equal, -np.inf)
        wins = fresh + 1 > value
        value, begin = np.where(wins, fresh + 1, value), np.where(wins, i - 1, begin)
        for base, at in zip(bases, begins, strict=True):
            base[at > begin] = -np.inf  # younger than the best
            free = wins & (base == -np.inf)
            base[free], at[free] = fresh[free], i - 1
            wins &= ~free
        if wins.any():
            bases.append(np.where(wins, fresh, -np.inf))
            begins.append(np.where(wins, i - 1, 0).astype(np.int32))
        return value, np.where(np.isfinite(value), i - begin, -1).astype(np.int32), bases, begins

    def finish(self, new: list[np.ndarray], back: list[np.ndarray], i: int, bases: list[np.ndarray], begins: list[np.ndarray]) -> tuple[Row, list[np.ndarray]]:
        if self.local:
            start = new[OTHER] <= 0
            new[OTHER][start], back[OTHER][start] = 0.0, -1
        outside = np.abs(self.columns - i) > self.band if self.band >= 0 else None
        if outside is not None:
            for x in [*new, *bases]:
                x[:, outside] = -np.inf
        base, which = first_best(new[OTHER], new[RUN], new[UP])
        reach = np.maximum.accumulate(base - self.slope, axis=1)
        new[LEFT][:, 1:] = reach[:, :-1] + self.gap + self.slope[:-1]
        opens = new[LEFT][:, 1:] <= base[:, :-1] + self.gap
        back[LEFT][:, 1:] = np.where(opens, which[:, :-1], LEFT)
        if outside is not None:
            new[LEFT][:, outside] = -np.inf
        for k in (OTHER, UP, LEFT):
            back[k][new[k] == -np.inf] = -1
        left = new[LEFT] > base
        ends = first_best(new[OTHER], new[UP], new[LEFT])[1] if self.cube else which
        return Row(new, np.where(left, new[LEFT], base), np.where(left, np.int8(LEFT), which), bases, begins), [*back, ends]


def like_sizes(pairs: list[tuple[str, str]]) -> Iterator[list[int]]:
    """Places of the pairs of two strings that aren't empty, in groups that share a table of at most ``HELD_CELLS`` cells without much of it being void."""
    order = sorted((k for k, (t, q) in enumerate(pairs) if t and q), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    held: list[int] = []
    cells = lambda n, t, q: n * (t + 1) * (q + 1)
    own, t_most, q_most = 0, 0, 0
    for k in order:
        t, q = len(pairs[k][0]), len(pairs[k][1])
        if held and cells(len(held) + 1, max(t, t_most), max(q, q_most)) > min(HELD_CELLS, 1.5 * (own + cells(1, t, q))):
            yield held
            held, own, t_most, q_most = [], 0, 0, 0
        held.append(k)
        own, t_most, q_most = own + cells(1, t, q), max(t, t_most), max(q, q_most)
    if held:
        yield held


def align_many(pairs: list[tuple[str, str]], aligner: str = "SWGA", band: int = -1, end_to_end: bool = False) -> list[Alignment | None]:
    """The best local alignment of each pair (target, query), or the one of both whole sequences (``end_to_end``); None if nothing scores above 0.

    Pairs of like sizes share their rows: all columns of all of them are one step,
    and only the gap in the target looks along the row, which a running maximum
    gives. Letters of a run of any length score by the cube with ``NS`` and ``NSGA``. A band limits how far
    rows and columns differ. Long pairs go alone; every so many rows is kept, about the
    square root of their number, and on the way back the rows between two of them are
    worked off again: the result is the same, and memory grows with the query times that square root.
    """
    out: list[Alignment | None] = [None] * len(pairs)
    for ks in like_sizes(pairs):
        for k, found in zip(ks, _aligned([pairs[k] for k in ks], aligner, band, end_to_end), strict=True):
            out[k] = found
    return out


def _aligned(pairs: list[tuple[str, str]], aligner: str, band: int, end_to_end: bool) -> list[Alignment | None]:
    table = Table(pairs, aligner, band, end_to_end)
    n, m, size = table.n, table.m, len(pairs)
    every = n + 1 if size * (n + 1) * (m + 1) <= HELD_CELLS else math.isqrt(n) + 1
    best, at = np.zeros(size), np.full((size, 3), -1)
    lengths, widths = np.array([len(t) for t, _ in pairs]), np.array([len(q) for _, q in pairs])
    if end_to_end:
        best[:] = -np.inf
    row, kept, backs = None, {}, {}
    for i in range(n + 1):
        if i % every == 0:
            kept[i] = row  # what row i is made from
            if every <= n:
                backs.clear()
        row, backs[i] = table.first() if row is None else table.step(row, i)
        if end_to_end:
            own = np.flatnonzero(lengths == i)
            best[own] = row.best[own, widths[own]]
            at[own] = np.stack([lengths[own], widths[own], row.which[own, widths[own]]], axis=1)
        else:
            j = row.best.argmax(axis=1)
            v = row.best[np.arange(size), j]
            own = np.flatnonzero(v > best)
            best[own] = v[own]
            at[own] = np.stack([np.full(len(own), i), j[own], row.which[own, j[own]]], axis=1)

    def of(i: int) -> list[np.ndarray]:
        nonlocal backs
        if i not in backs:
            first = i - i % every
            again, backs = kept[first], {}
            for x in range(first, min(first + every, n + 1)):
                again, backs[x] = table.first() if again is None else table.step(again, x)
        return backs[i]

    return [_traced(p, *pairs[p], float(best[p]), *map(int, at[p]), of, table.cube) if at[p, 0] >= 0 and math.isfinite(best[p]) else None for p in range(size)]


def _traced(p: int, t: str, q: str, score: float, i: int, j: int, state: int, of: Callable[[int], list[np.ndarray]], cube: bool) -> Alignment:
    """The way back from a cell of pair ``p``."""
    a, b = [], []
    while state >= 0:
        before = int(of(i)[state][p, j])
        if before < 0:
            break
        if state == RUN and cube:  # the whole run at once
            a.append(t[i - before : i][::-1])
            b.append(q[j - before : j][::-1])
            i, j = i - before, j - before
            state = (OTHER, UP, LEFT)[int(of(i)[4][p, j])]
            continue
        if state != LEFT:
            i -= 1
        if state != UP:
            j -= 1
        a.append("-" if state == LEFT else t[i])
        b.append("-" if state == UP else q[j])
        state = before
    return Alignment(i, j, "".join(a)[::-1], "".join(b)[::-1], score)


def align(t: str, q: str, aligner: str = "SWGA", band: int = -1, end_to_end: bool = False) -> Alignment | None:
    """The best alignment of one pair, see ``align_many``."""
    return align_many([(t, q)], aligner, band, end_to_end)[0]


def p_value(score: float, aligner: str) -> float:
    """Extreme-value tail of a score."""
    rate, location = GUMBEL[aligner]
    return -math.expm1(-math.exp(min(700.0, -rate * (score - location))))


def non_overlapping_many(pairs: list[tuple[str, str]], aligner: str = "NSGA", most_p: float = 0.1, least: int = 5) -> list[list[Alignment]]:
    """For each pair the best alignment, and those left and right of it, again while they are significant and long enough: by target start. What is left of all pairs is aligned side by side."""
    out: list[list[Alignment]] = [[] for _ in pairs]
    open_ = [(k, 0, 0, t, q) for k, (t, q) in enumerate(pairs)]
    while open_ := [x for x in open_ if len(x[3]) > least and len(x[4]) > least]:
        left = []
        for (k, t_at, q_at, t, q), a in zip(open_, align_many([(t, q) for *_, t, q in open_], aligner), strict=True):
            if a is None or p_value(a.score, aligner) > most_p:
                continue
            t_end, q_end = a.t_start + len(a.target.replace("-", "")), a.q_start + len(a.query.replace("-", ""))
            left += [(k, t_at, q_at, t[: a.t_start], q[: a.q_start]), (k, t_at + t_end, q_at + q_end, t[t_end:], q[q_end:])]
            a.t_start, a.q_start = a.t_start + t_at, a.q_start + q_at
            out[k].append(a)
        open_ = left
    return [sorted(x, key=lambda a: (a.t_start, a.q_start)) for x in out]


def non_overlapping(t: str, q: str, aligner: str = "NSGA", most_p: float = 0.1, least: int = 5) -> list[Alignment]:
    """See ``non_overlapping_many``."""
    return non_overlapping_many([(t, q)], aligner, most_p, least)[0]


def skip_align(t: str, q: str, skip: float = 0.5) -> tuple[float, list[tuple[int, int]]]:
    """See ``skip_align_many``."""
    return skip_align_many([(t, q)], skip)[0]


def skip_align_many(pairs: list[tuple[str, str]], skip: float = 0.5) -> list[tuple[float, list[tuple[int, int]]]]:
    """For each pair the least-cost alignment of all of ``t``: a wrong column costs 1, leaving ``q`` by d letters costs skip + d (0.01 a letter past 500).

    The price of a step is the lesser of two straight lines on either side, so the
    cheapest step to every column, however long, comes from four running minima. Pairs of like sizes
    are worked off side by side. Returns the cost and the (target, query) columns that are used.
    """
    out: list[tuple[float, list[tuple[int, int]]]] = [(0.0, []) for _ in pairs]
    for ks in like_sizes(pairs):
        for k, found in zip(ks, _skip_aligned([pairs[k] for k in ks], skip), strict=True):
            out[k] = found
    return out


def _skip_aligned(pairs: list[tuple[str, str]], skip: float) -> list[tuple[float, list[tuple[int, int]]]]:
    lengths, widths = np.array([len(t) for t, _ in pairs]), np.array([len(q) for _, q in pairs])
    n, m, own = lengths.max(), widths.max(), np.arange(len(pairs))
    fill = lambda strings, width: np.array([x.ljust(width) for x in strings]).view("U1").reshape(len(pairs), width)
    targets, letters = fill([t for t, _ in pairs], n), fill([q for _, q in pairs], m)
    columns, outside = np.arange(m), np.arange(m) >= widths[:, None]
    cost = np.where(outside, np.inf, letters != targets[:, :1])
    back = np.zeros((n, len(pairs), m), np.int32)
    ends = {0: cost}

    def least(v: np.ndarray) -> np.ndarray:
        """Place of the running minimum."""
        return np.maximum.accumulate(np.where(v == np.minimum.accumulate(v, axis=1), columns, 0), axis=1)

    for i in range(1, n):
        new, at = np.full(cost.shape, np.inf), np.zeros(cost.shape, np.int64)
        new[:, 1:], at[:, 1:] = cost[:, :-1], columns[:-1]  # the next column
        for slope, price in ((1.0, skip), (0.01, skip + 495.0)):
            x = least(cost - slope * columns)[:, :-1]  # from before
            y = m - 1 - least((cost + slope * columns)[:, ::-1])[:, ::-1]  # from here or behind
            for to, source in ((slice(1, None), x), (slice(None), y)):
                v = np.take_along_axis(cost, source, 1) + slope * np.abs(columns[to] - 1 - source) + price
                better = v < new[:, to]
                new[:, to][better], at[:, to][better] = v[better], source[better]
        back[i], cost = at, np.where(outside, np.inf, new + (letters != targets[:, i : i + 1]))
        if (lengths == i + 1).any():
            ends[i] = cost
    out = []
    for p in own:
        last = ends[lengths[p] - 1][p]
        j = int(last.argmin())
        total, path = float(last[j]), []
        for i in range(lengths[p] - 1, -1, -1):
            path.append((i, j))
            j = int(back[i, p, j])
        out.append((total, path[::-1]))
    return out


def align_pairs(pairs: DataFrame, aligner: str = "SWGA", band: int = -1) -> DataFrame:
    """Aligns pairs (id, t_seq, q_seq). One row each: offsets, score, identity, edits, the strings. A ``band``, if given, limits how far rows and columns differ."""
    schema = "id long, t_off long, q_off long, score double, identity double, edits long, p_value double, t_aligned string, q_aligned string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = list(zip(b["t_seq"], b["q_seq"], strict=True))
            out = [(i, a.t_start, a.q_start, a.score, a.identity, a.edits, p_value(a.score, aligner), a.target, a.query) for i, a in zip(b["id"], align_many(pairs, aligner, band), strict=True) if a]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return spread(pairs.select("id", "t_seq", "q_seq")).mapInPandas(run, schema)


def merged_identity(t: str, q: str, members: list[tuple[int, int, int]]) -> tuple[float, str, str]:
    """Identity of a merged block: the cheapest path through its members' diagonals (t, q, len), one query column per target column at most.

    A column costs its mismatch, a change of diagonal by d costs (d != 0) + |d| / 2.
    """
    by_t: dict[int, set[int]] = {}
    for a, b, n in members:
        for k in range(n):
            if 0 <= a + k < len(t) and 0 <= b + k < len(q):
                by_t.setdefault(a + k, set()).add(b + k)
    live: dict[int, tuple[float, tuple]] = {}
    for a in sorted(by_t):
        new = {}
        for b in by_t[a]:
            miss = float(t[a] != q[b])
            options = [(c + abs(b - x - 1) / 2 + (b != x + 1), p) for x, (c, p) in live.items() if x < b] or [(0.0, ())]
            c, p = min(options, key=lambda v: v[0])
            new[b] = (c + miss, (p, a, b))
        live = new or live
    if not live:
        return 0.0, "", ""
    _, p = min(live.values(), key=lambda v: v[0])
    path = []
    while p:
        p, a, b = p
        path.append((a, b))
    path.reverse()
    ta, qa = "".join(t[a] for a, _ in path), "".join(q[b] for _, b in path)
    return sum(x == y for x, y in zip(ta, qa, strict=True)) / len(path), ta, qa


def fit_gumbel(scores: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """(rate, location) of the extreme-value law by maximum likelihood, of scores that count as often as ``weights`` say: Newton steps, then bisection if they fail."""
    x = np.asarray(scores, float)
    w = np.ones(len(x)) if weights is None else np.asarray(weights, float)
    w = w / w.sum()
    low = x.min()
    y = x - low
    mean = float((w * y).sum())

    def f(rate: float) -> tuple[float, float]:
        e = w * np.exp(-rate * y)
        s0, s1, s2 = e.sum(), (y * e).sum(), (y * y * e).sum()
        return 1 / rate - mean + s1 / s0, -1 / rate**2 + (s1 / s0) ** 2 - s2 / s0

    rate = math.pi / math.sqrt(6 * max(float((w * (y - mean) ** 2).sum()), 1e-12))
    for _ in range(100):
        v, d = f(rate)
        if abs(v) < 1e-9:
            break
        rate -= v / d
        if rate <= 0 or not math.isfinite(rate):
            a, b = 1e-6, 1e3
            for _ in range(200):
                rate = (a + b) / 2
                a, b = (rate, b) if f(rate)[0] > 0 else (a, rate)
            break
    return rate, low - math.log((w * np.exp(-rate * y)).sum()) / rate


def homopolymer_identity(a: str, b: str) -> float:
    """Identity that allows runs of one letter to differ in length: runs are compared in turn."""
    from itertools import groupby

    ra, rb = ([(c, len(list(g))) for c, g in groupby(s)] for s in (a, b))
    n = min(len(ra), len(rb))
    same = sum(min(x[1], y[1]) for x, y in zip(ra[:n], rb[:n], strict=True) if x[0] == y[0])
    return same / max(1, min(len(a), len(b)))


def homopolymer_identities(pairs: DataFrame) -> DataFrame:
    """``id, identity`` of pairs (id, t_seq, q_seq), see ``homopolymer_identity``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "identity": [homopolymer_identity(t, q) for t, q in zip(b["t_seq"], b["q_seq"], strict=True)]})

    return spread(pairs.select("id", "t_seq", "q_seq")).mapInPandas(run, "id long, identity double")


def join_overlap(a: str, b: str, least: int, most: int, ident: float) -> str | None:
    """``a`` and ``b`` joined at the longest suffix of a that b begins with, by identity; differing letters give their code."""
    from colinear.functions.sequence import BY_BITS, IUPAC

    bits = lambda c: sum(1 << "ACGT".index(x) for x in IUPAC[c])
    for n in range(min(most, len(a), len(b)), least - 1, -1):
        x, y = a[-n:], b[:n]
        if sum(p == q for p, q in zip(x, y, strict=True)) >= ident * n:
            return a[:-n] + "".join(p if p == q else BY_BITS[bits(p) | bits(q)] for p, q in zip(x, y, strict=True)) + b[n:]
    return None
