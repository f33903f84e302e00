import random

import numpy as np

from colinear.operators import guided, seeds


def test_word_codes():
    assert seeds.word_codes("ACGTN", 2).tolist() == [1, 6, 11, -1]
    assert seeds.word_codes("ACGTA", 2, "comb").tolist() == [0 * 4 + 2, 1 * 4 + 3, 2 * 4 + 0]
    assert seeds.word_codes("ARx", 2, "protein").tolist() == [1, -1]
    assert seeds.word_codes("", 3).tolist() == []


def test_best_words_follow_the_diagonal():
    q = np.array([0, 12, 24, 36, 36, 48])
    t = np.array([100, 112, 124, 136, 900, 148])
    path = guided.best_words(q, t, np.zeros(6, int), 12)
    assert path == [0, 1, 2, 3, 5]
    assert guided.best_words(q[:0], t[:0], t[:0], 12) == []


def test_guided_alignment_crosses_a_gap():
    r = random.Random(4)
    s = "".join(r.choice("ACGT") for _ in range(240))
    path, identity, p = guided.guided(s, s[:120] + s[126:])
    assert len(path) > 200 and identity > 0.95 and p < 1e-9
    assert {a - b for a, b in path} == {0, 6}
    assert guided.guided("", "A") is None


def test_super_matches(spark):
    r = random.Random(5)
    genome = "".join(r.choice("ACGT") for _ in range(600))
    target = spark.createDataFrame([(0, genome), (1, "".join(r.choice("ACGT") for _ in range(400)))], "seq_id long, seq string")
    query = spark.createDataFrame([(7, genome[100:200] + genome[210:300])], "seq_id long, seq string")
    got = sorted((x["q_start"], x["t_start"], x["len"]) for x in guided.super_matches(query, target).collect())
    assert got == [(0, 100, 100), (100, 210, 90)]


def test_super_matches_on_the_reverse_strand_and_of_frequent_words(spark):
    r = random.Random(6)
    genome = "".join(r.choice("ACGT") for _ in range(600))
    turned = genome[100:300][::-1].translate(str.maketrans("ACGT", "TGCA"))
    target = spark.createDataFrame([(k, genome) for k in range(1100)], "seq_id long, seq string")
    query = spark.createDataFrame([(1, turned), (2, genome[100:300])], "seq_id long, seq string")
    got = {x["query_id"]: (x["q_start"], x["t_start"], x["len"], x["rc"]) for x in guided.super_matches(query, target).collect()}
    assert got == {1: (0, 100, 200, True), 2: (0, 100, 200, False)}


def test_best_words_equal_all_pairs():
    r = np.random.default_rng(8)
    for _ in range(30):
        n, span = 60, 12
        q, target, rc = r.integers(0, 40, n), r.integers(0, 3, n), r.random(n) < 0.4
        t = np.where(rc, 90 - q, q) + r.integers(0, 8, n) + r.choice([0, 60_000], n)
        frames, gain = np.unique(q), {}
        for i in np.argsort(q, kind="stable"):
            f = int(np.searchsorted(frames, q[i]))
            off = lambda j: 50_000 if target[j] != target[i] or rc[j] != rc[i] else min(50_000, abs((t[i] - t[j]) * (-1 if rc[i] else 1) - (q[i] - q[j])))
            gain[i] = span + max([0, *(gain[j] - off(j) - 20 * (q[i] - q[j] > span) for j in gain if q[j] < q[i] and q[j] >= frames[max(0, f - 16)])])
        path = guided.best_words(q, t, target, span, rc)
        price = sum(min(50_000, abs((t[b] - t[a]) * (-1 if rc[b] else 1) - (q[b] - q[a]))) if (target[a], rc[a]) == (target[b], rc[b]) else 50_000 for a, b in zip(path, path[1:]))
        assert span * len(path) - price - 20 * sum(q[b] - q[a] > span for a, b in zip(path, path[1:])) == max(gain.values())
