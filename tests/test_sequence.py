"""Sequence functions on IUPAC letters, edges and nulls, against plain Python."""

import random

from pyspark.sql import functions as F

from colinear.functions import scoring
from colinear.functions import sequence as S
from colinear.operators import align, seeds, xcorr


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_strands_and_codes(spark):
    s = "ACGTKMRYSWBVHDNX-acgt"
    assert one(spark, S.revcomp(F.col("s")), s=s) == "tgca-XNHDBVWSRYKMACGT"
    assert one(spark, S.revcomp(F.col("s")), s=None) is None
    assert one(spark, S.remove_gaps(F.col("s")), s="A-C.G") == "ACG"
    assert one(spark, S.slice_clamped(F.col("s"), F.lit(-2), F.lit(4)), s="ACGT") == "AC"
    assert one(spark, S.slice_clamped(F.col("s"), F.lit(3), F.lit(9)), s="ACGT") == "T"
    assert one(spark, S.slice_clamped(F.col("s"), F.lit(9), F.lit(9)), s="ACGT") == ""
    assert one(spark, S.equal(F.lit("K"), F.lit("G")), s="x") == 0.5
    assert one(spark, S.equal(F.lit("N"), F.lit("N")), s="x") == 0.25
    assert one(spark, S.equal_ambiguous(F.lit("K"), F.lit("K")), s="x") == 1.0
    assert one(spark, S.ambiguity_code(F.lit(1 | 4)), s="x") == "R"
    assert one(spark, S.resolve(F.lit("N"), F.lit("C")), s="x") == "C"
    assert [one(spark, S.nucleotide_index(F.col("s")), s=c) for c in "ACGTN"] == [0, 1, 2, 3, -1]
    assert one(spark, S.clean_name(F.col("s")), s=">chr 1  x") == "chr_1_x"


def test_translation_and_frames(spark):
    assert one(spark, S.translate_codons(F.col("s")), s="ATGTTTTAANNNGG") == "MF*Q"
    f = one(spark, S.frames(F.col("s")), s="ATGCCGT")
    assert [(x["frame"], x["seq"]) for x in f] == [(1, "ATGCCG"), (2, "TGCCGT"), (3, "GCC"), (-1, "ACGGCA"), (-2, "CGGCAT"), (-3, "GGC")]
    assert [x["seq"] for x in one(spark, S.frames(F.col("s")), s="")] == [""] * 6


def test_complexity_and_runs(spark):
    assert one(spark, S.homopolymer(F.col("s"), 0.5), s="AAAC") and not one(spark, S.homopolymer(F.col("s"), 0.9), s="AAAC")
    assert one(spark, S.low_complexity(F.col("s")), s="CCCC") and not one(spark, S.low_complexity(F.col("s")), s="CCCA")
    assert [(x["start"], x["end"]) for x in one(spark, S.gap_runs(F.col("s")), s="NNACNGGNNN")] == [(0, 2), (4, 5), (7, 10)]
    assert one(spark, S.identity(F.col("a"), F.col("b")), a="ACGT", b="ACCTTT") == 0.75
    assert one(spark, S.soft_masked(F.col("s")), s="aCGTaCGTACGT") and not one(spark, S.soft_masked(F.col("s")), s="ACGT")
    assert one(spark, S.gc_content(F.col("s")), s="") is None


def test_kmers_reset_at_other_letters(spark):
    r = random.Random(1)
    for n, k in ((0, 3), (2, 3), (3, 3), (60, 5), (200, 31)):
        s = "".join(r.choice("ACGTN" if n == 60 else "ACGT") for _ in range(n))
        want = []
        for i in range(n - k + 1):
            w = s[i : i + k]
            if "N" not in w:
                rc = w[::-1].translate(str.maketrans("ACGT", "TGCA"))
                want.append((min(w, rc), i, rc < w))
        codes, at, neg = seeds.kmers_of(s, k)
        text = ["".join("ACGT"[(int(c) >> 2 * (k - 1 - j)) & 3] for j in range(k)) for c in codes]
        assert list(zip(text, at.tolist(), neg.tolist(), strict=True)) == want


def test_probability_threshold_is_a_z_score():
    z = scoring.z_for(0.99999, 1e6)
    assert abs(scoring.match_probability(z, 1e6) - 0.99999) < 1e-9


def test_alignments_agree_with_full_search():
    from functools import lru_cache

    r = random.Random(3)
    for name in ("SW", "SWGA"):
        gap, extend, miss, _ = align.ALIGNERS[name]
        for _ in range(60):
            t, q = ("".join(r.choice("ACG") for _ in range(r.randint(1, 9))) for _ in range(2))

            @lru_cache(None)
            def best(i, j, state, t=t, q=q, gap=gap, extend=extend, miss=miss):
                if state == "m":
                    if not (i and j):
                        return 0.0
                    step = 1.0 if t[i - 1] == q[j - 1] else miss
                    return max(0.0, max(best(i - 1, j - 1, s) for s in "mud") + step)
                a, b = (i - 1, j) if state == "u" else (i, j - 1)
                if a < 0 or b < 0:
                    return float("-inf")
                return max(best(a, b, state) + extend, max(best(a, b, s) for s in "mud" if s != state) + gap)

            want = max(best(i, j, "m") for i in range(len(t) + 1) for j in range(len(q) + 1))
            got = align.align(t, q, name)
            assert (got.score if got else 0) == want


def test_alignment_of_known_pair():
    a = align.align("ACGTACGTTTACG", "ACGTACGTTACG", "SWGA")
    assert a.identity >= 12 / 13 and a.mismatches == 0 or a.edits <= 2
    whole = align.align("ACGT", "AGT", "SW", end_to_end=True)
    assert whole.target == "ACGT" and whole.query.replace("-", "") == "AGT"
    assert align.align("", "A") is None
    assert align.homopolymer_identity("AACG", "ACG") == 1.0
    assert align.join_overlap("AAACGT", "CGTTT", 2, 5, 1.0) == "AAACGTTT"
    rate, location = align.fit_gumbel([4.0 + x * 0.1 for x in range(50)])
    assert rate > 0 and 4 < location < 9


def test_correlation_finds_a_planted_shift():
    import numpy as np

    r = random.Random(7)
    s = "".join(r.choice("ACGT") for _ in range(400))
    t = "".join(r.choice("ACGT") for _ in range(150)) + s[100:300] + "".join(r.choice("ACGT") for _ in range(100))
    found = xcorr.matches_of(t, s)
    assert any(abs(m[0] - m[1] - 50) == 0 and m[2] >= 150 and m[3] > 0.8 for m in found)
    a, b = np.random.default_rng(1).normal(size=(2, 4, 64))
    xc = xcorr.correlate(np.pad(a, ((0, 0), (0, 64))), np.pad(b, ((0, 0), (0, 64))))
    want = [sum((a[c, max(0, k) : 64 + min(0, k)] * b[c, max(0, -k) : 64 - max(0, k)]).sum() for c in range(4)) for k in range(-63, 64)]
    assert np.allclose(xc[1:], want, atol=1e-6)
