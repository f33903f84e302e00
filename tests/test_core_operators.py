"""Match, interval, grid, block, chain and scaffold operators against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from colinear.operators import blocks, chain, grid, intervals, matches, scaffold
from colinear.operators.ranking import global_rank
from colinear.plans import programs
from colinear.sources import sequences as fasta
from colinear.sources import tables

MATCH = "target_id long, query_id long, query_size long, t_start long, q_start long, len long, rc boolean, prob double, ident double"


def match_rows(n, seed, targets=2, queries=2, span=400):
    r = random.Random(seed)
    return sorted({(r.randrange(targets), r.randrange(queries), 1000, t := r.randrange(span), t + r.randrange(-4, 5) + 10, r.randint(5, 40), r.random() < 0.3, 0.99, 0.8) for _ in range(n)})


def test_collapse_equals_the_fold(spark):
    rows = match_rows(600, 1)
    got = sorted(tuple(x) for x in matches.collapse(spark.createDataFrame(rows, MATCH)).collect())
    want, groups = [], {}
    for x in rows:
        groups.setdefault((x[0], x[1], x[6]), []).append((x[3], x[5], x[4]))
    for key, g in groups.items():
        g.sort()
        held = None
        for k, (t, n, q) in enumerate(g):
            if held and abs(t - g[k - 1][0]) < 4 and abs(q - g[k - 1][2]) < 4:
                if q < held[1]:
                    held[1] = q
                else:
                    held[2] = q + n
                held[3] += 1
                continue
            if held:
                want.append((*key, held[0], held[1], held[2] - held[1], held[3]))
            held = [t, q, q + n, 1]
        want.append((*key, held[0], held[1], held[2] - held[1], held[3]))
    assert got == sorted(want)
    assert matches.collapse(spark.createDataFrame([], MATCH)).count() == 0


def test_intervals_equal_per_base_counts(spark):
    r = random.Random(2)
    rows = [(r.choice("xy"), a, a + r.randrange(0, 30)) for a in (r.randrange(200) for _ in range(80))]
    df = spark.createDataFrame(rows, "seq string, start long, end long")
    base = {}
    for s, a, b in rows:
        for k in range(a, b):
            base[s, k] = base.get((s, k), 0) + 1
    got = {(x["seq"], k): x["depth"] for x in intervals.depth(df).collect() for k in range(x["start"], x["end"])}
    assert got == base
    cover = {x["seq"]: (x["covered"], x["depth_sum"]) for x in intervals.coverage(df).collect()}
    assert cover == {s: (sum(k[0] == s for k in base), sum(v for k, v in base.items() if k[0] == s)) for s in "xy"}
    only = {(x["seq"], k) for x in intervals.unique_regions(df).collect() for k in range(x["start"], x["end"])}
    assert only == {k for k, v in base.items() if v == 1}
    points = spark.createDataFrame([(k, s, k) for k in range(0, 230, 7) for s in "xy"], "id long, seq string, pos long")
    assert all(x["depth"] == base.get((x["seq"], x["pos"]), 0) for x in intervals.depth_at(points, df).collect())
    other = spark.createDataFrame([(s, a + 5, b + 9) for s, a, b in rows[:40]], "seq string, start long, end long")
    b2 = {(s, k) for s, a, b in rows[:40] for k in range(a + 5, b + 9)}
    delta = {x["seq"]: (x["gained"], x["lost"]) for x in intervals.coverage_delta(df, other).collect()}
    assert delta == {s: (sum(k[0] == s for k in b2 - set(base)), sum(k[0] == s for k in set(base) - b2)) for s in "xy"}


def test_chain_equals_quadratic_search(spark):
    import numpy as np

    r = random.Random(4)
    for _ in range(20):
        n = r.randint(1, 40)
        t = np.sort(np.array([r.randrange(3000) for _ in range(n)], float))
        q = t + np.array([r.randrange(-400, 400) for _ in range(n)])
        query, rc = np.array([r.randrange(2) for _ in range(n)]), np.array([r.random() < 0.3 for _ in range(n)])
        prob, skip = np.full(n, 0.999), np.full(n, 2.5)
        cost, back = [0.0] + [float("inf")] * (n - 1), [-1] * n
        for j in range(n):
            for i in range(j):
                dt, dq = t[j] - t[i], q[j] - q[i]
                if rc[i] and rc[j]:
                    dq = -dq
                step = 150.0 if query[i] != query[j] else 20.0 if rc[i] != rc[j] else 0.0 if abs(dq - dt) == 1 else min(40.0, abs(dq - dt) / max(abs(dt), 300) + 0.01)
                c = cost[i] - 200 * np.log(prob[i]) + step + skip[i + 1 : j].sum()
                if c < cost[j] - 1e-9:
                    cost[j], back[j] = c, i
        path = chain.best_path(t, q, query, rc, prob, skip)
        total = sum(-200 * np.log(prob[i]) + float(chain.steps(t[j : j + 1] - t[i], (-1 if rc[i] and rc[j] else 1) * (q[j : j + 1] - q[i]), query[j : j + 1] != query[i], rc[j : j + 1] != rc[i])[0]) + skip[i + 1 : j].sum() for i, j in zip(path, path[1:], strict=False))
        assert path[0] == 0 and path[-1] == n - 1 and total == pytest.approx(cost[-1])
    df = spark.createDataFrame(match_rows(60, 5), MATCH)
    assert chain.chain(df).count() > 0 and chain.chain(df.limit(0)).count() == 0
    assert chain.chain_duplicates(df).count() >= chain.chain(df).where("false").count()


def test_global_rank_and_split(spark):
    rows = [(k % 7, k) for k in range(100)]
    ranked, n = global_rank(spark.createDataFrame(rows, "a long, b long").repartition(5), ["a", "b"])
    assert n == 100 and [(x["a"], x["b"]) for x in ranked.orderBy("_rank").collect()] == sorted(rows)
    sizes = [x["count"] for x in matches.split_into(spark.createDataFrame(rows, "a long, b long"), 7, ["a", "b"]).groupBy("file").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1


def test_grid(spark):
    seqs = spark.createDataFrame([(k, "A" * n) for k, n in enumerate((0, 5, 6, 100, 128, 129))] + [(9, "N" * 130)], "seq_id long, seq string")
    got = {}
    for x in grid.chunks(seqs, 128, 32).collect():
        got.setdefault(x["seq_id"], []).append((x["start"], x["end"], x["all_n"]))
    assert sorted(got) == [2, 3, 4, 5, 9] and sorted(got[5]) == [(0, 128, False), (96, 129, False)] and all(x[2] for x in got[9])
    parsed = spark.createDataFrame([("[1-2,3-4][5-6,7-8]x",)], "s string").select(grid.parse_pairs(F.col("s")).alias("p")).first()["p"]
    assert [tuple(x) for x in parsed] == [(1, 2, 3, 4), (5, 6, 7, 8)]
    pairs = spark.createDataFrame([(1, 3), (2, 9), (5, 8)], "t long, q long")
    ranges = spark.createDataFrame([(1, 2, 3, 4), (5, 6, 7, 8)], "t1 long, t2 long, q1 long, q2 long")
    assert sorted(tuple(x) for x in grid.allowed(pairs, ranges).collect()) == [(1, 3), (5, 8)]


def test_blocks(spark):
    rows = [("t", 100 * k, 100 * k + 50, "q", 100 * k, 100 * k + 50, 0.9, "+") for k in range(4)] + [("t", 5_000_000, 5_000_050, "q", 400, 450, 0.9, "+")]
    df = spark.createDataFrame(rows, tables.SUMMARY)
    got = blocks.synteny_blocks(df).collect()
    assert [(x["t_start"], x["t_end"], x["n"]) for x in got] == [(0, 350, 4)]
    assert blocks.bounded_merge(df, 60).orderBy("t_start").first()["n"] == 4
    assert blocks.gap_regions(df).count() == 3
    m = spark.createDataFrame([(0, 0, 100, 0, 0, 20, False, 1.0, 1.0), (0, 0, 100, 10, 12, 20, False, 1.0, 1.0), (0, 0, 100, 31, 50, 5, False, 1.0, 1.0)], MATCH)
    assert sorted((x["t_start"], x["t_end"], x["q_end"], x["members"]) for x in blocks.merge_overlaps(m).collect()) == [(0, 30, 32, 2), (31, 36, 55, 1)]


def test_scaffolds(spark):
    hits = [("a", 0, "1", 100, 1), ("a", 50, "1", 200, 1), ("b", 0, "1", 400, -1), ("b", 50, "1", 300, -1), ("c", 0, "1", 500, 1), ("c", 9, "1", 600, 1), ("d", 0, "2", 5, 1)]
    ends = scaffold.anchors(spark.createDataFrame(hits, "scaffold string, s_pos long, chr string, pos long, dir int"))
    names = spark.createDataFrame([(x, s) for x, s in zip("abcde", ("AC", "GG", "TT", "CA", "GA"), strict=True)], "name string, seq string")
    walked = scaffold.paths(scaffold.adjacency(ends), names.select(F.col("name").alias("scaffold")))
    paths = {}
    for x in walked.orderBy("path", "place").collect():
        paths.setdefault(x["path"], []).append((x["scaffold"], x["dir"]))
    assert [("a", 1), ("b", -1), ("c", 1)] in [p if p[0][0] == "a" else [(s, -d) for s, d in reversed(p)] for p in paths.values() if len(p) == 3]
    joined = sorted(x["seq"] for x in scaffold.superscaffolds(walked, names).collect())
    assert sum(len(s.replace(scaffold.LINKER, "")) for s in joined) == 10 and len(joined) == 3


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s one\nACGT\nacgn x\n>two\nGGGG\n")
    got = {x["name"]: x["seq"] for x in fasta.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"s_one": "ACGTACGN", "two": "GGGG"}
    fasta.write_fasta(fasta.with_ids(fasta.read_fasta(spark, str(tmp_path / "a.fa"))), str(tmp_path / "out"))
    assert {x["name"]: x["seq"] for x in fasta.read_fasta(spark, str(tmp_path / "out")).collect()} == got
    (tmp_path / "r.fq").write_text("@r 1\nACG\n+\nIII\n@r2\nTT\n+\n##\n")
    assert sorted(tuple(x) for x in fasta.read_fastq(spark, str(tmp_path / "r.fq")).collect()) == [("r2", "TT", "##"), ("r_1", "ACG", "III")]
    (tmp_path / "q").write_text(">two\n1 2 3\n4\n")
    assert fasta.read_qualities(spark, str(tmp_path / "q")).first()["qual"] == [1, 2, 3, 4]
    (tmp_path / "f.gff").write_text("#x\nX\ts\tchromosome\t11\t100\t.\t.\t.\t.\nX\ts\tgene\t21\t30\t.\t+\t.\ta\nlong\ts\tgene\t1\t2\t.\t.\t.\t.\n")
    axes, features = tables.read_gff(spark, str(tmp_path / "f.gff"))
    assert [tuple(x) for x in axes.collect()] == [("X", 90)] and [tuple(x) for x in features.collect()] == [("X", "gene", 10, 20)]
    s = spark.createDataFrame([("t", 0, 10, "q", 5, 15, 0.5, "-")], tables.SUMMARY)
    tables.write_summary(s, str(tmp_path / "s"))
    assert tables.read_summary(spark, str(tmp_path / "s")).collect() == s.collect()
    m = spark.createDataFrame(match_rows(20, 3), MATCH)
    tables.write_matches(m, str(tmp_path / "m"))
    assert tables.read_matches(spark, str(tmp_path / "m")).where("matches is null").count() == m.count()


def test_search_finds_planted_homology(spark):
    r = random.Random(13)
    genome = "".join(r.choice("ACGT") for _ in range(3000))
    part = list(genome[500:1500])
    for _ in range(60):
        part[r.randrange(1000)] = r.choice("ACGT")
    turned = genome[2000:2600][::-1].translate(str.maketrans("ACGT", "TGCA"))
    target = spark.createDataFrame([(0, genome)], "seq_id long, seq string")
    query = spark.createDataFrame([(0, "".join(part)), (1, turned)], "seq_id long, seq string")
    found = programs.synteny_search(query, target, (15,), rounds=2)
    summary = programs.merged_summary(found, target, query)
    rows = summary.collect()
    inside = lambda x: 500 <= x["t_start"] and x["t_end"] <= 1500 if x["q_name"] == "q0" else 1990 <= x["t_start"] and x["t_end"] <= 2610
    assert rows and all(inside(x) and x["ident"] > 0.5 for x in rows)
    covered = {k for x in rows if x["q_name"] == "q0" for k in range(x["t_start"], x["t_end"])}
    assert len(covered) > 600
    assert {x["ori"] for x in rows if x["q_name"] == "q1"} <= {"-"}
