"""Tiled sequences, what came before a row, and folds of islands: brute force, hot groups, no size that changes a result."""

import random
import re

import pytest
from pyspark.sql import functions as F

from colinear.operators import blocks, islands, matches, tiles
from colinear.plans import programs


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_slices_come_from_pieces(spark):
    r = random.Random(1)
    seqs = {k: "".join(r.choice("ACGT") for _ in range(n)) for k, n in ((1, 1000), (2, 7), (3, 8), (4, 9), (5, 0), (6, 8 * 256 + 3))}
    asked = [(k, r.randint(-20, 1020), r.choice([0, 1, 5, 8, 30, 3000, -4]), r.random() < 0.5 or None) for k in [*seqs, 9, None] for _ in range(60)]
    rows = spark.createDataFrame(asked + asked[:3], "seq long, start long, n long, rc boolean")
    held = tiles.store(spark.createDataFrame([*seqs.items(), (8, None)], "seq_id long, seq string"), size=8)
    got = sorted(map(str, (tuple(x) for x in tiles.sliced(rows, held, "seq", "start", "n", "cut", "rc", 8).collect())))
    want = []
    for k, a, n, rc in asked + asked[:3]:
        if k in seqs:
            s = turned(seqs[k]) if rc else seqs[k]
            want.append(str((k, a, n, rc, s[max(a, 0) : max(a + n, 0)] if n > 0 else "")))
    assert got == sorted(want)
    assert tiles.sliced(rows.limit(0), held, "seq", "start", "n", "cut").count() == 0


def test_no_whole_sequence_rides_on_a_match(spark):
    r = random.Random(2)
    base = "".join(r.choice("ACGT") for _ in range(60_000))
    t, q = spark.createDataFrame([(1, base)], "seq_id long, seq string"), spark.createDataFrame([(2, base[100:40_000])], "seq_id long, seq string")
    rows = spark.createDataFrame([(k * 15, 50) for k in range(2000)], "start long, n long").withColumn("seq", F.lit(1).cast("long"))
    held = tiles.store(t)
    found = tiles.sliced(rows, held, "seq", "start", "n", "cut")
    assert found.where(F.col("cut") != F.substring(F.lit(base), (F.col("start") + 1).cast("int"), 50)).count() == 0
    one = spark.createDataFrame([(1, 2, 39_900, 100, 0, 500, False, 1.0, 1.0)], "target_id long, query_id long, query_size long, t_start long, q_start long, len long, rc boolean, prob double, ident double")
    summary = programs.merged_summary(one, t, q)
    assert not re.search(r"\bseq#", summary._jdf.queryExecution().optimizedPlan().toString())
    assert [tuple(x) for x in summary.collect()] == [("t1", 100, 600, "q2", 0, 500, 1.0, "+")]


def some_matches(r, n, hot=0.6):
    out, at = [], 0
    for _ in range(n):
        at += r.choice([0, 1, 3, 40])
        key = (1, 1, False) if r.random() < hot else (r.randrange(3), r.randrange(2), r.random() < 0.5)
        out.append((*key, at, at + r.choice([0, 2, 5, 300]), r.randint(1, 60)))
    return list(dict.fromkeys(out))


def merged(rows):
    out, held, new, last = [], None, None, None
    for *key, t, q, n in sorted(rows, key=lambda x: (x[:3], x[3], x[5], x[4])):
        if key == last and new[0] <= t < held[5] and new[1] <= q < new[1] + held[5] - new[0]:
            held[5], held[6], held[7] = max(held[5], t + n), max(held[6], q + n), held[7] + 1
        else:
            if held:
                out.append(tuple(held))
            held = [*key, t, q, t + n, q + n, 1]
        new, last = (t, q), key
    return sorted([*out, tuple(held)])


@pytest.mark.parametrize("few", [islands.FEW, 0])
def test_merges_in_pieces_equal_one_fold(spark, monkeypatch, few):
    monkeypatch.setattr(islands, "FEW", few)
    r = random.Random(3)
    rows = some_matches(r, 900)
    df = spark.createDataFrame(rows, "target_id long, query_id long, rc boolean, t_start long, q_start long, len long").repartition(6)
    got = blocks.merge_overlaps(df, members=True).collect()
    assert sorted(tuple(x)[:8] for x in got) == merged(rows)
    assert all(len(x["list"]) == x["members"] for x in got) and sum(x["members"] for x in got) == len(rows)
    # windows over the row before, in pieces and in one
    order = ["t_start", "len", "q_start"]
    last = islands.before(islands.dealt(df, blocks.MATCH_KEYS, order), blocks.MATCH_KEYS, order, last=("max", F.struct(*order)), n=("sum", F.lit(1)), low=("min", F.col("q_start"))).collect()
    groups = {}
    for x in sorted(rows, key=lambda x: (x[:3], x[3], x[5], x[4])):
        groups.setdefault(x[:3], []).append((x[3], x[5], x[4]))
    for x in last:
        own = groups[(x["target_id"], x["query_id"], x["rc"])]
        k = own.index((x["t_start"], x["len"], x["q_start"]))
        assert (tuple(x["last"]) if x["last"] else None, x["n"], x["low"]) == ((own[k - 1], k, min(q for *_, q in own[:k])) if k else (None, None, None))


def test_a_hot_group_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(islands, "FEW", 0)
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("target_id"), F.lit(1).cast("long").alias("query_id"), F.lit(False).alias("rc"), (F.col("id") * 50).alias("t_start"), (F.col("id") * 50).alias("q_start"), F.lit(60).cast("long").alias("len"))
    apart = rows.where("t_start % 500 < 450")  # every tenth is missing: an island each
    order = ["t_start", "len", "q_start"]
    pieces = islands.dealt(apart, blocks.MATCH_KEYS, order)
    spread = [x["n"] for x in pieces.groupBy("_piece").agg(F.count("*").alias("n")).collect()]
    assert len(spread) >= 4 and max(spread) < 9000
    found = blocks.merge_islands(apart)
    assert found.select("island").distinct().count() == 2000
    counts = [x["n"] for x in found.repartition(4, "island").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(counts) == 4 and max(counts) < 9000
    assert blocks.merge_overlaps(apart).agg(F.count("*"), F.sum("members")).first()[:] == (2000, 18_000)
    assert blocks.merge_overlaps(rows.limit(0)).count() == 0


def test_summary_folds_in_pieces_equal_those_in_one(spark, monkeypatch):
    r = random.Random(5)
    rows, at = [], 0
    for _ in range(600):
        at += r.randint(0, 3000)
        q = max(0, at + r.choice([0, 0, 0, 5, -400, 2_000_000]))
        rows.append(("t1", at, at + r.randint(1, 900), f"q{r.randrange(2)}", q, q + r.randint(1, 900), 0.5, r.choice("++-")))
    df = spark.createDataFrame(rows, "t_name string, t_start long, t_end long, q_name string, q_start long, q_end long, ident double, ori string").repartition(5)
    results = {}
    for few in (islands.FEW, 0):
        monkeypatch.setattr(islands, "FEW", few)
        found = df.select(F.lit(1).alias("target_id"), F.when(F.col("q_name") == "q1", 1).otherwise(2).alias("query_id"), (F.col("ori") == "-").alias("rc"), "t_start", "q_start", (F.col("t_end") - F.col("t_start")).alias("len"))
        more = [matches.collapse(found, 900), matches.synthetic_neighbours(found, 5000, 2)]
        results[few] = [sorted(map(str, (tuple(x) for x in f.collect()))) for f in (blocks.synteny_blocks(df, 1), blocks.bounded_merge(df, 800), blocks.gap_regions(df), *more)]
    one, two = results.values()
    assert one == two and all(one)
