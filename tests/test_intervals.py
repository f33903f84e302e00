"""Sweeps in pieces against sets of places."""

import random

from colinear.operators import intervals

NAMES = "seq string, start long, end long"


def some(r, n):
    return [(r.choice("ab"), x, x + r.randrange(0, 40)) for x in (r.randrange(0, 300) for _ in range(n))]


def test_sweeps_do_not_depend_on_the_pieces(spark, monkeypatch):
    r = random.Random(3)
    rows, others = some(r, 60) + [("c", 0, 0), (None, 1, 5)], some(r, 30)
    a, b = spark.createDataFrame(rows, NAMES), spark.createDataFrame(others, NAMES)
    held = lambda rows, s, x: sum(n == s and p <= x < q for n, p, q in rows)
    for piece in (7, 1 << 16):
        monkeypatch.setattr(intervals.running, "__defaults__", (None, piece))
        merged = sorted(map(tuple, intervals.merged_depth(a).collect()))
        assert {(s, x): d for s, p, q, d in merged for x in range(p, q)} == {(s, x): d for s in "ab" for x in range(400) if (d := held(rows, s, x))}
        assert all(x[2] < y[1] or x[3] != y[3] for x, y in zip(merged, merged[1:]) if x[0] == y[0])
        cuts = {(x["seq"], x["start"]) for x in intervals.depth(a).collect()}
        assert cuts == {(s, e) for s, p, q in rows if q > p and s for e in (p, q) if held(rows, s, e)}
        runs = sorted(map(tuple, intervals.union(a, ["seq"]).collect()))
        assert {(s, x) for s, p, q in runs for x in range(p, q)} == {(s, x) for s in "ab" for x in range(400) if held(rows, s, x)}
        assert all(x[0] != y[0] or x[2] < y[1] for x, y in zip(runs, runs[1:]))
        delta = {x["seq"]: (x["gained"], x["lost"]) for x in intervals.coverage_delta(a, b).collect()}
        for s in "ab":
            m, n = ({x for x in range(400) if held(v, s, x)} for v in (rows, others))
            assert delta[s] == (len(n - m), len(m - n))
        points = spark.createDataFrame([(i, r.choice("ab"), i % 350) for i in range(700)], "id long, seq string, pos long")
        for x in intervals.depth_at(points, a).collect():
            assert x["depth"] == held(rows, x["seq"], x["pos"])
        found = intervals.bases_before(points, intervals.union(a, ["seq"])).collect()
        assert len(found) == 700
        for x in found:
            assert x["below"] == sum(held(rows, x["seq"], y) > 0 for y in range(x["pos"]))
