import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from colinear.functions import scoring
from colinear.operators import align, islands, star, xcorr
from colinear.plans import programs
from colinear.sources import plots, sequences, tables

MEMBERS = "ref_id long, t_off long, t_aligned string, q_aligned string"


def by_hand(members, references):
    """Every member is laid out against its reference, with gaps up to the longest insert of all behind each letter."""
    out = {}
    for ref, seq in references:
        inserts, letters = defaultdict(list), defaultdict(list)
        for r, off, t, q in members:
            pairs = list(zip(t, q))
            while pairs and "-" in pairs[0]:
                off += pairs[0][0] != "-"
                pairs = pairs[1:]
            while pairs and "-" in pairs[-1]:
                pairs = pairs[:-1]
            if r != ref or not pairs:
                continue
            at, own = off - 1, defaultdict(str)
            for a, b in pairs:
                if a != "-":
                    at += 1
                    letters[at].append(b)
                else:
                    own[at] += b
            for p in range(off, at):
                inserts[p].append(own[p])
        for p, c in enumerate(seq):
            columns = [letters[p]] + ([[s[k : k + 1] or "-" for s in inserts[p]] for k in range(max(map(len, inserts[p])))] if inserts[p] else [])
            for slot, col in enumerate(columns):
                n, own = Counter(col), c if slot == 0 else "-"
                votes = {x: n[x] + (own == x) for x in "ACGT-"}
                out[ref, p, slot] = (own, len(col), *[n[x] for x in "ACGT"], sum(n[x] for x in n if x not in "ACGT-"), n["-"], n[own], own if n[own] == len(col) else "?", max(votes, key=lambda x: votes[x]))
    return out


def profiles(spark, members, references):
    rows = star.star_profile(spark.createDataFrame(members, MEMBERS), spark.createDataFrame(references, "ref_id long, seq string")).collect()
    assert len({tuple(r[:3]) for r in rows}) == len(rows)
    return {tuple(r[:3]): tuple(r[3:]) for r in rows}


def test_profile_reconciles_the_inserts_of_all_members(spark):
    members = [(1, 0, "AC--GT", "ACTTGT"), (1, 1, "C-GT", "CAGA"), (1, 0, "ACGT", "A-GT"), (1, 0, "ACGT", "ACGN"), (9, 0, "AC", "AC")]
    got = profiles(spark, members, [(1, "ACGT"), (2, "GG")])
    assert got == by_hand(members, [(1, "ACGT"), (2, "GG")])
    # behind C: TT, A, none, none
    assert got[1, 1, 1] == ("-", 4, 1, 0, 0, 1, 0, 2, 2, "?", "-") and got[1, 1, 2][1:8] == (4, 0, 0, 0, 1, 0, 3)
    assert got[2, 0, 0] == ("G", 0, 0, 0, 0, 0, 0, 0, 0, "G", "G")


def test_profile_equals_rows_by_hand(spark):
    r = random.Random(11)
    references = [(k, "".join(r.choice("ACGT") for _ in range(80))) for k in range(4)]
    members = []
    for _ in range(60):
        k, off = r.randrange(4), r.randrange(40)
        t, q = "", ""
        for c in references[k][1][off : off + r.randrange(1, 40)]:
            x = r.random()
            t, q = t + c, q + (c if x < 0.7 else r.choice("ACGTN-"))
            if r.random() < 0.1:
                n = r.randrange(1, 4)
                t, q = t + "-" * n, q + "".join(r.choice("ACGT") for _ in range(n))
        members.append((k, off, t, q))
    members += members[:5] + [(0, 3, None, "A"), (None, 0, "A", "A"), (1, 0, "", ""), (1, 2, "--", "AC")]
    held, star.HELD_COLUMNS = star.HELD_COLUMNS, 50
    try:
        assert profiles(spark, members, references) == by_hand([m for m in members if None not in m], references)
    finally:
        star.HELD_COLUMNS = held
    assert profiles(spark, [], references[:1]) == by_hand([], references[:1])
    assert profiles(spark, members, []) == {}


@pytest.mark.parametrize("few", [islands.FEW, 0])
def test_motifs_of_each_stack(spark, few, monkeypatch):
    monkeypatch.setattr(islands, "FEW", few)
    seq = "ACGTTGCAACGTTGCATTTTACGT"
    same = {("a", p): 10 if p in range(2, 9) or p in range(12, 17) else 8 for p in range(len(seq))} | {("b", p): 9 for p in range(15, len(seq))}
    columns = spark.createDataFrame([(7, k, p, n, 10) for (k, p), n in same.items()], "ref_id long, aligner string, pos long, same long, pairs long")
    got = star.conserved_motifs(columns, spark.createDataFrame([(7, seq)], "ref_id long, seq string"), ("ref_id", "aligner")).collect()
    assert sorted(map(tuple, got)) == [(7, "a", 2, 8, seq[2:9]), (7, "b", 15, 23, seq[15:])]
    none = star.conserved_motifs(columns.limit(0), spark.createDataFrame([(7, seq)], "ref_id long, seq string"), ("ref_id", "aligner"))
    assert none.collect() == []


def test_windowed_runs_equal_runs_at_every_shift(monkeypatch):
    r = random.Random(3)
    for size in (46, 60, 200):
        monkeypatch.setattr(xcorr, "HELD_SHIFTS", size * r.choice((1, 3, 1000)))
        t = "".join(r.choice("ACGTRYN") for _ in range(size + r.randrange(60)))
        q = "".join(c if r.random() < 0.8 else r.choice("ACGT") for c in t[: size - 10]) + "ACGTACGTAC"
        wt, wq = xcorr.weights_of(t), xcorr.weights_of(q)
        wanted = sorted(m for shift in range(-len(q), len(t) + 1) for m in xcorr.runs_at(wt, wq, shift))
        got = xcorr.windowed_runs(t, q)
        assert [m[:3] for m in got] == [m[:3] for m in wanted] and len(got)
        assert np.allclose([m[3] for m in got], [m[3] for m in wanted])
    assert xcorr.windowed_runs("", "ACGT") == [] == xcorr.windowed_runs("A" * 45, "A" * 45)


def test_windowed_matches_of_nulls_repeats_and_other_columns(spark):
    s = "ACGTTGCA" * 8
    rows = spark.createDataFrame([(1, s, s, "x"), (1, s, s, "x"), (2, None, s, "y"), (3, s, "", "z")], "id long, t_seq string, q_seq string, len2 string")
    got = xcorr.windowed_matches(rows, least=63).collect()
    assert [tuple(g) for g in got] == [(1, "x", 0, 0, 64, 1.0)] * 2


def test_scores_of_alignments(spark):
    rows = [("ACGT--ACGTAC", "ACTTACACG--C"), ("A" + "-" * 30 + "A", "A" * 32), ("ACGT---", "ACGTACG"), ("", ""), ("AC", "GT"), ("ACGT", "AC")]
    s = spark.createDataFrame(rows, "t string, q string").select("t", "q", scoring.alignment_scores(F.col("t"), F.col("q")).alias("s")).select("t", "q", "s.*").collect()
    got = {(x["t"], x["q"]): tuple(x)[2:] for x in s}
    assert got[rows[0]] == (12, 7, 1, 3, 7 - 1 - 4, 7 / 4)
    assert got[rows[1]] == (32, 2, 0, 1, 2 - 10, 1.0)
    assert got[rows[2]] == (7, 4, 0, 0, 4, 4.0) and got[rows[3]] == (0, 0, 0, 0, 0, 0.0)
    assert got[rows[4]] == (2, 0, 2, 2, -2, 0.0) and got[rows[5]][:2] == (2, 2)
    assert all(align.Alignment(0, 0, t, q, 0.0).plain_score == got[t, q][4] for t, q in rows[:5])
    null = spark.range(1).select(scoring.alignment_scores(F.lit(None).cast("string"), F.lit("A")).alias("s")).first()["s"]
    assert null["matches"] is None and null["score"] is None


def test_batches_follow_the_yield():
    assert programs.next_batch(200, 0.5, None) == 400
    assert programs.next_batch(400, 0.4, 0.5) == 800 == programs.next_batch(400, 0.5, 0.5)
    assert programs.next_batch(800, 0.6, 0.5) == 800
    assert programs.next_batch(100, 0.0, 0.0) == 200


def test_search_tells_its_rounds(spark):
    r = random.Random(2)
    genome = "".join(r.choice("ACGT") for _ in range(4000))
    changed = "".join(c if r.random() < 0.85 else r.choice("ACGT") for c in genome[500:3500])
    target, query = (spark.createDataFrame([(0, s)], "seq_id long, seq string") for s in (genome, changed[:1500] + genome[2000:2060] + changed[1560:]))
    told = []
    got = programs.synteny_search(query, target, k=(15,), per_round=2, rounds=2, told=told).collect()
    assert got and [x["round"] for x in told] == list(range(1, len(told) + 1))
    assert all(x["ratio"] == x["matches"] / x["pixels"] for x in told) and told[0]["pixels"] <= 2
    stopped = []
    programs.synteny_search(query, target, k=(15,), per_round=2, patience=1, least_ratio=1e9, told=stopped)
    assert len(stopped) == 1


def test_lines_of_a_genome_file(spark):
    lines = ["##gff", "c1\tx\tchromosome\t51\t150\t.", "c1\tx\tgene\t61\t70\t.", "c2\tx\tgene\t1\t5", "long\tx\tchromosome\t1\t9", "short", "c1\tx\tgene\tno\tno", ""]
    axes, features = tables.parse_gff(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [tuple(x) for x in axes.collect()] == [("c1", 100)] and [tuple(x) for x in features.collect()] == [("c1", "gene", 10, 20)]
    summary = spark.createDataFrame([("c1", 15, 40)], "t_name string, t_start long, t_end long")
    got = {x["type"]: tuple(x)[1:] for x in programs.matches_by_feature(features, axes, summary).collect()}
    assert got == {"gene": (10, 5, 0.5), "None": (90, 20, 20 / 90)}


def test_small_files(spark, tmp_path):
    chosen = spark.createDataFrame([("t", 3), ("q", 4)], "axis string, chunk long")
    tables.write_selection(chosen, str(tmp_path / "a"))
    tables.write_selection(chosen.where("axis = 't'"), str(tmp_path / "b"))
    (tmp_path / "c").write_text("q\t9\t0\n")
    assert sorted(map(tuple, tables.read_selection(spark, [str(tmp_path / x) for x in "abc"]).collect())) == [("q", 4), ("t", 3)]
    seeds = spark.createDataFrame([(100, 10, 20, True), (100, 10, 20, False)], "query_size long, q_start long, len long, rc boolean")
    seeds.write.parquet(str(tmp_path / "s"))
    assert {x["rc"]: x["q_start"] for x in tables.read_seeds(spark, str(tmp_path / "s")).collect()} == {True: 70, False: 10}
    shown = tables.readable(spark.createDataFrame([("ACGTA", "ACTTA", 0.8)], "t_aligned string, q_aligned string, identity double"), 3).first()["value"]
    assert shown == "Identity (w/ indel count): 80.0000 %\n\nACG\n|| \nACT\n\nTA\n||\nTA"
    assert tables.ticks(10, 4) == [0, 4, 8]


def test_qualities_and_pages(spark, tmp_path):
    named = spark.createDataFrame([("a", "ACG"), ("b", "T")], "name string, seq string")
    both = sequences.with_qualities(named, spark.createDataFrame([("a", [3, 40, 2])], "name string, qual array<int>"))
    assert {x["name"]: x["qual"] for x in both.collect()} == {"a": [3, 40, 2], "b": None}
    assert sequences.quality_lines(both.where("name = 'a'")).first()["value"] == ">a\n3 40 2"
    paint = spark.createDataFrame([("target", "c", 1000, 3000, 12)], "axis string, name string, start long, end long, colour long")
    assert plots.rectangles(paint).first()["value"].split()[0] == "0.200" and plots.rectangles(paint).first()["value"].endswith("rectfill")
    dots = spark.createDataFrame([(1000, 2000, 0, 1000, 4)], "x1 long, x2 long, y1 long, y2 long, colour long")
    assert plots.segments(dots).first()["value"] == "0.20 setgray newpath 1.00 0.00 moveto 2.00 1.00 lineto stroke"
    plots.write_page(plots.segments(dots), str(tmp_path / "page"))
    assert spark.read.text(str(tmp_path / "page")).count() == 1
