"""Chains in segments equal chains in one piece, for any size of segment."""

import random

import pytest

from colinear.operators import chain

COLUMNS = "target_id long, query_id long, query_size long, t_start long, q_start long, len long, rc boolean, prob double, ident double"


def matches_of(r, n):
    rows, at = [], 0
    for _ in range(n):
        at += r.choice([0, 10, 2000, 2000, 300_000])
        query = r.choice([1, 1, 1, 2])
        rows.append((r.choice([1, 1, 1, 2]), query, 10**7, at, max(0, at + r.choice([0, 0, 1, 50, -3000, 10**6])), r.randint(20, 90), r.random() < 0.1, r.choice([0.9, 0.99, 1.0]), 0.9))
    return list(dict.fromkeys(rows))


@pytest.mark.parametrize("ahead", [5, 40, chain.AHEAD_ROWS])
def test_segments_give_the_same_chain(spark, ahead):
    r = random.Random(ahead)
    rows = matches_of(r, 420)
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    whole = sorted(map(tuple, chain.chain(df, ahead=ahead).collect()))
    assert len(whole) > 20
    for segment in (3, 37, 200) if ahead == 40 else (60,):
        assert sorted(map(tuple, chain.chain(df, segment=segment, ahead=ahead).collect())) == whole


def test_stops_are_those_of_the_look_ahead():
    import numpy as np

    r = random.Random(8)
    for _ in range(50):
        t = np.sort(np.array([r.randrange(2_000_000) for _ in range(r.randint(1, 60))], float))
        want = []
        for i in range(len(t)):
            stop = min(len(t), i + 1 + chain.AHEAD_ROWS)
            far = np.flatnonzero(t[i + 1 : stop] - t[i] > chain.AHEAD_BASES)
            want.append(min(stop, max(i + 1 + far[0], i + 1 + chain.FED)) if len(far) else stop)
        assert chain.stops(t).tolist() == want and want == sorted(want)
