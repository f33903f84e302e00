"""Anchors, neighbours and places of scaffolds against brute force, as one window and over ranges, with a hot scaffold and chromosome."""

import random

import pytest

from colinear.operators import islands, scaffold

HITS = "scaffold string, size long, s_pos long, chr long, pos long, dir int"


def some_hits(n=400):
    r = random.Random(5)
    out = []
    for k in range(n):
        name = "s0" if r.random() < 0.4 else r.choice([None, *[f"s{x}" for x in range(12)]])
        out.append((name, 70, r.randrange(60), r.choice([None, 1, 1, 1, 2, 3]), r.randrange(300), 1 if (k // 25) % 2 or r.random() < 0.2 else -1))
    return out + out[:20]


def null_first(x):
    return tuple((v is not None, v if v is not None else 0) for v in x)


def anchored(hits, share, run):
    out = {}
    for name in {h[0] for h in hits}:
        own = sorted(((h[2], h[3], h[4], h[5]) for h in hits if h[0] == name), key=null_first)
        own = [x for x in own if sum(y[1] == x[1] for y in own) >= len(own) // share]
        if run:
            own = [x for k, x in enumerate(own) if len(own[k : k + run]) == run and len({y[3] for y in own[k : k + run]}) == 1]
        if own:
            out[name] = (own[0][1], own[0][2], own[-1][1], own[-1][2], own[0][3])
    return out


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_anchors_neighbours_and_places(spark, monkeypatch, few):
    monkeypatch.setattr(islands, "FEW", few)
    hits = some_hits()
    rows = spark.createDataFrame(hits, HITS)
    for share, run in ((5, 0), (5, 3), (2, 5), (5, 1)):
        got = scaffold.anchors(rows, share, run).collect()
        assert len(got) == len({x["scaffold"] for x in got})
        assert {x["scaffold"]: tuple(x)[1:] for x in got} == anchored(hits, share, run)
    ends = anchored(hits, 5, 0)
    points = sorted([(v[0], v[1], k, "lo") for k, v in ends.items()] + [(v[2], v[3], k, "hi") for k, v in ends.items()], key=null_first)
    want = [(a[0], a[1], a[2], a[3], b[2], b[3]) for a, b in zip(points, points[1:], strict=False) if a[0] == b[0] and None not in (a[2], b[2]) and a[2] != b[2]]
    assert sorted(map(str, (tuple(x) for x in scaffold.adjacency(scaffold.anchors(rows)).collect()))) == sorted(map(str, want))
    firsts = {}
    for name, size, s_pos, c, pos, d in hits:
        firsts[name] = min(firsts.get(name, (c, pos, s_pos, d, size)), (c, pos, s_pos, d, size), key=null_first)
    placed, want = sorted(((c, pos, name, s, d, size) for name, (c, pos, s, d, size) in firsts.items()), key=lambda x: null_first(x[:3])), []
    for k, (c, pos, name, s, d, size) in enumerate(placed):
        begin = pos - s if d > 0 else pos - (size - s)
        new = not k or placed[k - 1][0] != c
        n, gap = (0, 0) if new else (n + 1, min(max(begin - end, 10), 1000))  # noqa: F821
        end = begin + size
        want.append((None if c is None else f"Pseudo{c}", n, name, d, gap))
    assert sorted(map(str, (tuple(x) for x in scaffold.placement(rows).collect()))) == sorted(map(str, want))


def test_no_hits(spark):
    rows = spark.createDataFrame([], HITS)
    assert scaffold.anchors(rows).count() == scaffold.anchors(rows, run=3).count() == 0
    assert scaffold.adjacency(scaffold.anchors(rows)).count() == scaffold.placement(rows).count() == 0
