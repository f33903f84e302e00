"""Aligners against full search, runs of any length, pairs side by side."""

import random
import time

import pytest

from colinear.operators import align


def full_search(t, q, name):
    """Best local score by trying, at every cell, every length of run that ends there."""
    gap, extend, miss, cube = align.ALIGNERS[name]
    n, m, low = len(t), len(q), float("-inf")
    other, up, left, run = ([[low] * (m + 1) for _ in range(n + 1)] for _ in range(4))
    best = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            four = lambda a, b: max(other[a][b], up[a][b], left[a][b], run[a][b])
            if i and j and t[i - 1] != q[j - 1]:
                other[i][j] = four(i - 1, j - 1) + miss
            other[i][j] = max(other[i][j], 0.0)
            k = 1
            while k <= min(i, j) and t[i - k] == q[j - k]:
                come = max(other[i - k][j - k], up[i - k][j - k], left[i - k][j - k])
                run[i][j] = max(run[i][j], come + k**3 if cube else max(come, run[i - k][j - k]) + k)
                k += 1
            if i:
                up[i][j] = max(up[i - 1][j] + extend, four(i - 1, j) + gap)
            if j:
                left[i][j] = max(left[i][j - 1] + extend, max(other[i][j - 1], up[i][j - 1], run[i][j - 1]) + gap)
            best = max(best, four(i, j))
    return best


def score_of(a, name):
    """The score that an alignment's own columns have."""
    gap, extend, miss, cube = align.ALIGNERS[name]
    total, run, side = 0.0, 0, ""
    for x, y in zip(a.target, a.query, strict=True):
        now = "t" if x == "-" else "q" if y == "-" else ""
        if not now and x == y:
            total += (run + 1) ** 3 - run**3 if cube else 1
            run += 1
        else:
            run = 0
            total += (extend if now == side else gap) if now else miss
        side = now
    return total


def pairs_with_long_runs(r, n):
    out = []
    for _ in range(n):
        parts = [("".join(r.choice("AC") for _ in range(r.randint(1, 40))), r.random()) for _ in range(3)]
        t = "".join(p for p, _ in parts)
        q = "".join(p[: r.randint(0, len(p))] + r.choice(["", "G", "GG"]) + p if x < 0.3 else p for p, x in parts)
        out.append((t, q))
    return out


@pytest.mark.parametrize("name", list(align.ALIGNERS))
def test_scores_equal_full_search(name):
    r = random.Random(name)
    short = [tuple("".join(r.choice("ACG") for _ in range(r.randint(1, 14))) for _ in range(2)) for _ in range(150)]
    pairs = short + pairs_with_long_runs(r, 60)
    for (t, q), a in zip(pairs, align.align_many(pairs, name), strict=True):
        want = full_search(t, q, name)
        assert (a.score if a else 0.0) == want, (t, q)
        if a:
            assert score_of(a, name) == want
            assert t[a.t_start :].startswith(a.target.replace("-", "")) and q[a.q_start :].startswith(a.query.replace("-", ""))


@pytest.mark.parametrize("name", ["NS", "NSGA"])
def test_runs_of_any_length_score_by_the_cube(name):
    r = random.Random(9)
    for n in (1, 11, 12, 13, 20, 40, 700, 5000):
        s = "".join(r.choice("ACGT") for _ in range(n))
        assert align.align(s, s, name, band=40).score == n**3
    # gaps at several places leave several runs open on one diagonal
    s = "".join(r.choice("ACGT") for _ in range(300))
    a = align.align(s[:100] + s[130:], s, name)
    assert score_of(a, name) == a.score == full_search(s[:100] + s[130:], s, name)


def test_pairs_side_by_side_align_as_alone(monkeypatch):
    r = random.Random(11)
    pairs = [("".join(r.choice("ACGT") for _ in range(r.randint(0, 120))), "".join(r.choice("ACGT") for _ in range(r.randint(0, 90)))) for _ in range(60)] + [("ACGTACGT", "ACGTACGT")] * 5
    for name in align.ALIGNERS:
        for whole in (False, True):
            together = align.align_many(pairs, name, end_to_end=whole)
            assert together == [align.align(t, q, name, end_to_end=whole) for t, q in pairs]
            assert all(score_of(a, name) == a.score for a in together if a)
    assert align.non_overlapping_many(pairs, "SWGA", 0.9) == [align.non_overlapping(t, q, "SWGA", 0.9) for t, q in pairs]


def test_many_short_pairs_take_little_time():
    r = random.Random(12)
    pairs = [("".join(r.choice("ACGT") for _ in range(90)), "".join(r.choice("ACGT") for _ in range(90))) for _ in range(300)]
    began = time.perf_counter()
    align.align_many(pairs, "SWGA")
    assert time.perf_counter() - began < 20
