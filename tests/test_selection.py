"""Probabilities as columns, exact medians by narrowing, walks over links: brute force."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from colinear.functions import scoring
from colinear.operators import ranking, scaffold


def test_native_erfc_and_quantile(spark):
    from statistics import NormalDist

    xs = [k / 50 for k in range(-300, 1300)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scoring.erfc(F.col("x")).alias("c"), scoring.erf(F.col("x")).alias("e"), scoring.normal_tail(F.col("x")).alias("t")).collect()
    for r in got:
        assert r["c"] == pytest.approx(math.erfc(r["x"]), rel=1.3e-7) and r["e"] == pytest.approx(math.erf(r["x"]), abs=3e-7)
        assert r["t"] == pytest.approx(0.5 * math.erfc(r["x"] / math.sqrt(2)), rel=1.3e-7)
    ps = [10.0**-k for k in range(1, 16)] + [k / 997 for k in range(1, 997)]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", scoring.normal_quantile(F.col("p")).alias("z")).collect():
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=4e-9, abs=1e-12)
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (None,), (-1.0,)], "p double").select(scoring.normal_quantile(F.col("p"))).collect()] == [None] * 4
    rows = [(z / 10, b) for z in range(-30, 90) for b in (1.0, 1e6)]
    for z, b, p in spark.createDataFrame(rows, "z double, b double").select("z", "b", scoring.match_probabilities(F.col("z"), F.col("b"))).collect():
        assert p == pytest.approx(scoring.match_probability(z, b), rel=1e-4, abs=1e-9) or scoring.match_probability(z, b) < 1e-30
    raw = spark.createDataFrame([(0.8, 100.0, 0.5, 0.5), (0.9, 200.0, 0.41, 0.39)], "i double, n double, q double, t double")
    for i, n, q, t, p in raw.select("i", "n", "q", "t", scoring.raw_scores(F.col("i"), F.col("n"), 1e6, F.col("q"), F.col("t"))).collect():
        assert p == pytest.approx(scoring.raw_score(i, int(n), 1e6, q, t), rel=1e-6)


def test_medians_by_narrowing(spark):
    r = random.Random(1)
    for values in ([r.gauss(0, 1e6) for _ in range(1500)], [7.0] * 900 + [8.0] * 901, [r.choice([1e-9, 2e-9, 5.0]) for _ in range(1000)], [3.0], [1.0, 2.0], [r.lognormvariate(0, 9) for _ in range(999)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
        ranks = [0, len(values) // 3, len(values) - 1, len(values), -1]
        want = [sorted(values)[k] if 0 <= k < len(values) else None for k in ranks]
        assert ranking.values_at(df, "v", ranks, few=5, buckets=7) == want
        assert ranking.medians(df, ["v"])["v"] == statistics.median(values)
    assert ranking.medians(df.limit(0), ["v"]) == {"v": None}


def walked(links, names):
    """The same by hand: links in order, then each walk step by step."""
    free = {}
    for _, _, a, a_end, b, b_end in sorted(links):
        if (a, a_end) not in free and (b, b_end) not in free:
            free[a, a_end], free[b, b_end] = (b, b_end), (a, a_end)
    turn, out, used = {"lo": "hi", "hi": "lo"}, [], set()

    def walk(start, into):
        at, row = start, []
        while at not in {x for x, _ in row}:
            row.append((at, 1 if into == "lo" else -1))
            step = free.get((at, turn[into]))
            if step is None:
                break
            at, into = step
        return row

    for start in sorted(names):
        if start in used or ((start, "lo") in free and (start, "hi") in free):
            continue
        row = walk(start, "lo" if (start, "lo") not in free else "hi")
        if len(row) > 1 and row[-1][0] < start:
            continue  # walked from its other end
        used |= {x for x, _ in row}
        out += [(min(x for x, _ in row), k, x, d) for k, (x, d) in enumerate(row)]
    for start in sorted(names):
        if start not in used:
            row = walk(start, "lo")
            used |= {x for x, _ in row}
            out += [(start, k, x, d) for k, (x, d) in enumerate(row)]
    return sorted(out)


LINK = "chr long, pos long, a string, a_end string, b string, b_end string"


def check_paths(spark, links, names):
    got = scaffold.paths(spark.createDataFrame(links, LINK), spark.createDataFrame([(n,) for n in names], "scaffold string"))
    assert sorted(tuple(x) for x in got.collect()) == walked(links, names)


def test_paths_by_doubling(spark):
    r = random.Random(2)
    for size in (6, 40):
        names = [f"s{k:03}" for k in range(size)]
        ends = [(n, e) for n in names for e in ("lo", "hi")]
        # neighbours along chromosomes, as adjacency gives them
        r.shuffle(ends)
        links = [(k * 3 // len(ends), k, *ends[k], *ends[k + 1]) for k in range(len(ends) - 1) if ends[k][0] != ends[k + 1][0] and r.random() < 0.9]
        check_paths(spark, links, names)
    # links that share ends in any way
    wild = [(0, k, *x, *y) for k, (x, y) in enumerate((r.choice(ends), r.choice(ends)) for _ in range(90)) if x[0] != y[0]]
    check_paths(spark, wild, names)


def test_rings_and_long_paths(spark):
    ring = ["c", "a", "d", "b"]
    links = [(0, k, x, "hi", ring[(k + 1) % 4], "lo") for k, x in enumerate(ring)] + [(1, 0, "p", "lo", "q", "lo"), (2, 0, "p", "hi", "q", "hi")]
    check_paths(spark, links, [*ring, "p", "q", "alone"])
    line = [f"n{k:04}" for k in range(300)]
    random.Random(3).shuffle(line)
    check_paths(spark, [(0, 2 * k, x, "hi", y, "lo") for k, (x, y) in enumerate(zip(line, line[1:], strict=False))], line)
    check_paths(spark, [], ["x", "y"])
