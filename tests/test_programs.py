"""The guided programs, comparisons of aligners and searches that go on, against planted sequences and plain versions."""

import random

import numpy as np
import pytest

from colinear.operators import align, guided, scaffold, xcorr
from colinear.plans import programs
from colinear.sources import tables

SEQ = "seq_id long, seq string"
PAIRS = "id long, t_seq string, q_seq string"


def letters(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_seeded_alignments_on_both_strands(spark):
    r = random.Random(21)
    genome = letters(r, 900)
    target = spark.createDataFrame([(0, genome)], SEQ)
    part = genome[100:180] + genome[184:300]
    query = spark.createDataFrame([(1, part), (2, turned(part)), (3, letters(r, 100)), (4, ""), (5, None)], SEQ)
    found = {x["query_id"]: x for x in programs.seeded_alignments(query, target, aligner="SWGA").collect()}
    assert set(found) == {1, 2}
    for k, x in found.items():
        assert x["rc"] == (k == 2) and (x["t_start"], x["q_start"]) == (100, 0)
        assert x["t_aligned"].replace("-", "") == genome[100:300] and x["q_aligned"].replace("-", "") == part
        assert x["edits"] == 1


def test_refined_finds_what_lies_between(spark):
    r = random.Random(22)
    genome = letters(r, 1200)
    middle = "".join(c if j % 4 else "ACGT"[("ACGT".index(c) + 1) % 4] for j, c in enumerate(genome[400:700]))
    part = genome[300:400] + middle + genome[700:800]
    for rc in (False, True):
        target = spark.createDataFrame([(0, genome)], SEQ)
        query = spark.createDataFrame([(9, turned(part) if rc else part)], SEQ)
        held = spark.createDataFrame([(0, 9, 500, 300, 0, 100, rc, 1.0, 1.0), (0, 9, 500, 700, 400, 100, rc, 1.0, 1.0)], "target_id long, query_id long, query_size long, t_start long, q_start long, len long, rc boolean, prob double, ident double")
        found = programs.refined(held, query, target).collect()
        new = [x for x in found if x["len"] > 150]
        assert len(found) > 2 and new and all(x["rc"] == rc and x["t_start"] - x["q_start"] == 300 and x["query_size"] == 500 for x in new)


def test_search_goes_on_from_its_rounds(spark, tmp_path):
    r = random.Random(23)
    genome = letters(r, 1500)
    part = "".join(c if j < 60 or j % 10 else "ACGT"[("ACGT".index(c) + 1) % 4] for j, c in enumerate(genome[200:1200]))
    target, query = spark.createDataFrame([(0, genome)], SEQ), spark.createDataFrame([(0, part)], SEQ)
    search = lambda **more: programs.synteny_search(query, target, (15,), t_chunk=256, q_chunk=256, **more)
    whole = {tuple(x) for x in search().collect()}
    search(rounds=1, dump=f"{tmp_path}/rounds").count()
    old = tables.read_rounds(spark, f"{tmp_path}/rounds")
    assert old.count() and {tuple(x) for x in search(old=old).collect()} == whole


def test_reference_columns(spark):
    r = random.Random(24)
    ref = letters(r, 120)
    changed = ref[:60] + "ACGT"[("ACGT".index(ref[60]) + 1) % 4] + ref[61:]
    rows = [(1, ref, ref), (1, ref, ref), (1, ref, changed), (1, ref, ""), (2, ref, ref), (1, ref, letters(r, 10))]
    found = guided.reference_columns(spark.createDataFrame(rows, "ref_id long, t_seq string, q_seq string"), least=100, least_pairs=2).collect()
    assert len(found) == 120 * len(align.ALIGNERS) and {x["ref_id"] for x in found} == {1}
    assert all((x["same"], x["pairs"], x["decile"]) == ((2, 3, 6) if x["pos"] == 60 else (3, 3, 10)) for x in found)


def test_comparison_records_and_hairpins(spark):
    r = random.Random(25)
    s = letters(r, 60)
    pairs = spark.createDataFrame([(1, s, s), (2, s, s[:30] + s[33:])], PAIRS)
    got = {(x["aligner"], x["decile"]): (x["pairs"], x["matches"], x["edits"]) for x in guided.compare_aligners(pairs).collect()}
    want = {}
    for name in align.ALIGNERS:
        for t, q in ((s, s), (s, s[:30] + s[33:])):
            a = align.align(t, q, name)
            old = want.get((name, int(a.identity * 10)), (0, 0, 0))
            want[name, int(a.identity * 10)] = (old[0] + 1, old[1] + a.middle.count("|"), old[2] + a.edits)
    assert got == want
    text = [x[0] for x in guided.alignment_text(align.align_pairs(pairs.where("id = 1")), "mfa").collect()]
    assert len(text) == 1 and text[0].count(s) == 2
    stem = letters(r, 80)
    rows = spark.createDataFrame([(1, stem + letters(r, 6) + turned(stem)), (2, letters(r, 166)), (3, "")], SEQ)
    found = {x["id"]: x for x in guided.hairpins(rows).collect()}
    assert found[1]["columns"] >= 160 and found[1]["identity"] > 0.95 and 3 not in found


def test_non_overlapping_finds_both_parts():
    r = random.Random(26)
    a, b = letters(r, 60), letters(r, 50)
    t, q = a + letters(r, 40) + b, a + letters(r, 35) + b
    found = align.non_overlapping(t, q, "SWGA", 0.1)
    spans = [(x.t_start, x.t_start + len(x.target.replace("-", ""))) for x in found]
    assert spans == sorted(spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert sum(x.middle.count("|") for x in found) >= 110
    assert align.non_overlapping("", "ACGT") == []


def test_protein_matches_and_homopolymers():
    r = random.Random(27)
    s = letters(r, 300)
    # third letters that don't change the amino acid of a codon that ends in T or C
    other = "".join(c if j % 3 < 2 or c not in "CT" else "CT"["TC".index(c)] for j, c in enumerate(s))
    found = xcorr.protein_matches(s, other, 1.2)
    assert (0, 0, 100, 1.0) in found
    assert align.homopolymer_identity("AACCGT", "ACCCGT") == pytest.approx(5 / 6)


def test_float_signals(spark):
    r = np.random.default_rng(28)
    a = r.normal(size=40)
    b = a[7:30]
    plain = [sum(a[j + s] * b[j] for j in range(len(b)) if 0 <= j + s < len(a)) for s in range(1 - len(b), len(a))]
    assert xcorr.correlate_direct(a, b) == pytest.approx(plain)
    two = xcorr.correlate_direct(np.stack([a, a], axis=1), np.stack([b, b], axis=1))
    assert two == pytest.approx(2 * np.array(plain))
    rows = spark.createDataFrame([(1, a.tolist(), b.tolist()), (2, [], [1.0]), (3, None, [1.0]), (4, [1.0, 1.0], [1.0])], "id long, t array<double>, q array<double>")
    assert {x["id"]: x["shift"] for x in xcorr.signal_shifts(rows).collect()} == {1: 7, 4: 0}
    x = xcorr.smooth(xcorr.smooth(np.asarray(a, np.float32)))
    xc = xcorr.autocorrelate(np.pad(x - x.mean(), (0, len(x)))[None, :])
    y = x - x.mean()
    assert xc[len(xc) // 2 :][:40] == pytest.approx([float((y[: 40 - s] * y[s:]).sum()) for s in range(40)], abs=1e-4)


def test_realigned_blocks_and_gaps(spark):
    r = random.Random(29)
    genome = letters(r, 400)
    part = genome[50:120] + letters(r, 30) + genome[150:250]
    names = "t_name string, t_start long, t_end long, q_name string, q_start long, q_end long, ident double, ori string"
    for ori in "+-":
        q = part if ori == "+" else turned(part)
        spans = [(0, 70), (100, 200)] if ori == "+" else [(130, 200), (0, 100)]
        summary = spark.createDataFrame([("t0", 50, 120, "q0", *spans[0], 1.0, ori), ("t0", 150, 250, "q0", *spans[1], 1.0, ori)], names)
        found = programs.realign(summary, spark.createDataFrame([(0, genome)], SEQ), spark.createDataFrame([(0, q)], SEQ)).collect()
        assert sorted(x["score"] for x in found if x["kind"] == "block") == [70, 100]
        assert all(x["identity"] == 1 for x in found if x["kind"] == "block")


def test_scaffold_assembly_orders_and_turns(spark):
    r = random.Random(30)
    chromosome = letters(r, 900)
    cuts = [chromosome[:280], turned(chromosome[300:580]), chromosome[600:]]
    found = programs.scaffold_assembly(spark.createDataFrame(list(enumerate(cuts)), SEQ), spark.createDataFrame([(0, chromosome)], SEQ)).collect()
    joined = scaffold.LINKER.join([cuts[0], turned(cuts[1]), cuts[2]])
    back = scaffold.LINKER.join([turned(cuts[2]), cuts[1], turned(cuts[0])])
    assert len(found) == 1 and found[0]["n"] == 3 and found[0]["seq"] in (joined, back)


def test_pieces_cover_the_sequence(spark):
    s = letters(random.Random(31), 100)
    got = [(x["x"], x["target_seq"], x["target_length"]) for x in programs.pieces(spark.createDataFrame([(0, s), (1, ""), (2, None)], SEQ), "target", "x", 30, 40).orderBy("x").collect()]
    assert got == [(k, s[30 * k : 30 * k + 40], 100) for k in range(4)]
