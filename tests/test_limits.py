"""What used to be bounded: many feature types, long pairs, long jumps, ties, files of any size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colinear.functions import sequence as S
from colinear.operators import align, blocks, grid, intervals
from colinear.sources import sequences, tables


def test_feature_coverage_of_many_types(spark):
    r = random.Random(1)
    features = [(r.choice("ab"), f"t{r.randrange(80)}", s, s + r.randint(0, 30)) for s in (r.randrange(-5, 900) for _ in range(600))]
    features += [("z", "t1", 0, 10), ("a", "t0", 950, 2000)]
    sizes, covered = [("a", 1000), ("b", 800), ("c", 40)], [("a", 10, 300), ("a", 250, 420), ("b", 5, 6), ("c", 30, 60), ("z", 0, 5)]
    want = {}
    for seq, size in sizes:
        hit = {x for s, a, b in covered if s == seq for x in range(a, b)}
        for x in range(size):
            for kind in {t for s, t, a, b in features if s == seq and a <= x < b} or {"None"}:
                bases, under = want.get(kind, (0, 0))
                want[kind] = (bases + 1, under + (x in hit))
    got = intervals.feature_coverage(*(spark.createDataFrame(rows, kinds) for rows, kinds in ((features, "seq string, type string, start long, end long"), (sizes, "seq string, size long"), (covered, "seq string, start long, end long"))))
    rows = {x["type"]: x for x in got.collect()}
    assert len(rows) == 81 and {k: (x["bases"], x["covered"]) for k, x in rows.items()} == want
    assert all(x["share"] == x["covered"] / x["bases"] for x in rows.values())


@pytest.mark.parametrize("aligner", list(align.ALIGNERS))
def test_long_pairs_align_as_short_ones(aligner, monkeypatch):
    r = random.Random(2)
    t = "".join(r.choice("ACGT") for _ in range(160))
    q = t[20:60] + "".join(r.choice("ACGT") for _ in range(25)) + t[66:140]
    for end_to_end in (False, True):
        whole = align.align(t, q, aligner, end_to_end=end_to_end)
        monkeypatch.setattr(align, "HELD_CELLS", 0)
        assert align.align(t, q, aligner, end_to_end=end_to_end) == whole
        monkeypatch.undo()


def test_a_pair_of_10_kb_needs_little_memory():
    import tracemalloc

    r = random.Random(3)
    t = "".join(r.choice("ACGT") for _ in range(10_000))
    q = t[:3000] + t[3200:9000]
    tracemalloc.start()
    found = align.align(t, q, "SWGA")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.target.replace("-", "") == t[found.t_start : found.t_start + 9000] and found.query.replace("-", "") == q  # the whole matrix would take 350 MB, and its rows of scores more
    assert found.score == 8800 - 6 - 199 and peak < 120e6


def test_skip_alignment_jumps_any_distance():
    def brute(t, q, skip):
        price = lambda s: 0.0 if s == 0 else skip + min(abs(s), 500) + 0.01 * max(0, abs(s) - 500)
        cost = [float(t[0] != c) for c in q]
        for x in t[1:]:
            cost = [min(c + price(j - i - 1) for i, c in enumerate(cost)) + (x != q[j]) for j in range(len(q))]
        return min(cost)

    r = random.Random(4)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    cases = [(word(r.randint(1, 12)), word(r.randint(1, 20))) for _ in range(60)]
    a, b = word(300), word(300)
    for t, q in [*cases, (a[:8] + b[:8], a[:8] + word(40) + b[:8])]:
        cost, path = align.skip_align(t, q)
        assert cost == pytest.approx(brute(t, q, 0.5)) and [i for i, _ in path] == list(range(len(t)))
    a, b = word(700), word(700)
    far = align.skip_align(a + b, a + "N" * 900 + b)
    assert far[0] == pytest.approx(0.5 + 500 + 0.01 * 400)  # beyond 500 letters a letter costs a hundredth; 700 mismatches are dearer
    assert align.skip_align("", "A") == (0.0, [])


def test_seed_lines_keep_ties(spark):
    axis = spark.createDataFrame([(s, c, 0 if c % 6 else 1) for s in "abc" for c in range(1, 31)], "seq string, chunk long, bases long")
    got = grid.seed_lines(axis, axis, 2).collect()
    assert len(got) == 15 and sorted(x["line"] for x in got) == list(range(1, 16))  # all are 5 chunks long
    assert grid.seed_lines(axis.limit(0), axis, 2).count() == 0


def test_merge_overlaps_against_the_newest(spark):
    r = random.Random(5)
    rows = sorted({(1, 1, 100000, r.randrange(0, 400), r.randrange(0, 60), r.randint(5, 40), False) for _ in range(150)}, key=lambda x: (x[3], x[5], x[4]))
    want, held = [], None
    for _, _, _, t, q, n, _ in rows:
        if held and held["t"] <= t < held["t"] + held["n"] and held["q"] <= q < held["q"] + held["n"]:
            end = held["t"] + held["n"]
            want[-1] = (want[-1][0], want[-1][1], max(want[-1][2], t + n), max(want[-1][3], q + n), want[-1][4] + 1)
            held = {"t": t, "q": q, "n": max(n, end - t)}
        else:
            held = {"t": t, "q": q, "n": n}
            want.append((t, q, t + n, q + n, 1))
    m = spark.createDataFrame(rows, "target_id long, query_id long, query_size long, t_start long, q_start long, len long, rc boolean")
    assert sorted((x["t_start"], x["q_start"], x["t_end"], x["q_end"], x["members"]) for x in blocks.merge_overlaps(m).collect()) == sorted(want)
    assert any(x[4] > 2 for x in want)


def test_sequence_files_in_many_splits(spark, tmp_path):
    r = random.Random(6)
    reads = [(f"r{i}", "".join(r.choice("ACGT") for _ in range(r.randint(1, 60))), i) for i in range(400)]
    (tmp_path / "a.fq").write_text("".join(f"@{n} x\n{s}\n+\n{chr(33 + i % 60) * len(s)}\n" for n, s, i in reads))
    (tmp_path / "b.fq").write_text("@only\r\nACGT\r\n+\r\n@@@@\r\n")
    (tmp_path / "a.fa").write_text("no record\n" + "".join(f">{n} to >here\n{s[:30]}\n{s[30:]}\n" for n, s, _ in reads))
    (tmp_path / "b.fa").write_text(">p one\r\nmk*\r\n>empty\r\n")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = sorted(tuple(x) for x in sequences.read_fastq(spark, f"{tmp_path}/a.fq,{tmp_path}/b.fq").collect())
        assert got == sorted([(f"{n}_x", s, chr(33 + i % 60) * len(s)) for n, s, i in reads] + [("only", "ACGT", "@@@@")])
        got = sorted((x["name"], x["seq"]) for x in sequences.read_fasta(spark, [f"{tmp_path}/a.fa", f"{tmp_path}/b.fa"]).collect())
        assert [x for x in got if x[0][0] == "r"] == sorted((f"{n}_to_>here", s) for n, s, _ in reads)
        assert ("p_one", "MK*") in got and not any("record" in x[0] for x in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_block_file(spark, tmp_path):
    names = "t_name string, t_start long, t_end long, q_name string, q_start long, q_end long, ident double, ori string"
    summary = spark.createDataFrame([("a", 10 * k, 10 * k + 5, "x", 20 * k, 20 * k + 5, 0.5, "+") for k in range(4)] + [("b", 0, 100, "x", 0, 100, 0.9, "-")], names)
    found = blocks.synteny_blocks(summary)
    small = spark.createDataFrame([("b", 0, 100, "x", 0, 100, "-", 1, 0.9)], found.schema)
    size = lambda pairs: spark.createDataFrame(pairs, "name string, size long")
    t_sizes, q_sizes = size([("a", 200_000), ("b", 5)]), size([("x", 100_000)])
    lines = tables.block_lines(found.unionByName(small), t_sizes, q_sizes, rows=tables.block_rows(summary, found))
    text = [x["value"] for x in lines.orderBy("section", "key", "line", "value").collect()]
    assert text == ["genome\tGenome1\nchromosomes\t1", "a\t20000", "genome\tGenome2\nchromosomes\t1", "xQ\t10000", "a\t0\t35\t+1\txQ\t0\t65\t+1\t0.500000\t4"] + [f"{10 * k}\t{10 * k + 5}\t+1\t\t{20 * k}\t{20 * k + 5}\t+1\t0.500000" for k in range(4)]
    tables.write_blocks(lines, f"{tmp_path}/blocks")
    axes, whole, rows = tables.read_blocks(spark, f"{tmp_path}/blocks")
    assert sorted((x["name"], x["size"]) for x in axes.collect()) == [("a", 200_000), ("xQ", 100_000)]
    assert [tuple(x) for x in whole.collect()] == [("a", 0, 35, "x", 0, 65, "+", 0.5, 4)]
    assert sorted(tuple(x) for x in rows.collect()) == [("a", "x", 0, 10 * k, 10 * k + 5, 20 * k, 20 * k + 5, "+", 0.5) for k in range(4)]


def test_stores_and_substitution_tables(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "ACGTACGTAC", "ACGTTCGTAC")], "id long, t_seq string, q_seq string")
    found = align.align_pairs(pairs)
    tables.write_alignments(found, f"{tmp_path}/alignments")
    assert [tuple(x) for x in tables.read_alignments(spark, f"{tmp_path}/alignments").collect()] == [tuple(x) for x in found.collect()]
    (tmp_path / "scores").write_text("# made for this test\n  A  R\nA 4 -1\nR -1 5\n")
    scores = tables.read_scores(spark, f"{tmp_path}/scores")
    assert scores == {("A", "A"): 4, ("A", "R"): -1, ("R", "A"): -1, ("R", "R"): 5}
    rows = spark.createDataFrame([("a", "R"), ("R", "R"), ("A", "?"), (None, "A")], "a string, b string")
    assert [x[0] for x in rows.select(S.substitution(F.col("a"), F.col("b"), scores)).collect()] == [-1, 5, -100, -100]


def test_gumbel_fit_by_weights():
    r = np.random.default_rng(7)
    x = np.floor(r.gumbel(20, 3, 3000))
    v, n = np.unique(x, return_counts=True)
    assert align.fit_gumbel(v, n) == pytest.approx(align.fit_gumbel(x))


def test_raw_score_from_a_summary():
    from colinear.functions import scoring

    z = (0.8 - 0.25 * 1.0) * 100 / np.sqrt(0.25 * 0.75 * 100)
    assert scoring.raw_score(0.8, 100, 1e6, 0.5, 0.5) == pytest.approx(scoring.match_probability(z, 1e6))
    assert scoring.raw_score(0.3, 50, 1e6, 0.41, 0.39) < 1e-6 < 0.99 < scoring.raw_score(0.9, 200, 1e6, 0.41, 0.39)
