"""Scores and probabilities of matches as native columns, and the exact forms for tests."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (rate, location) of the extreme-value law of each aligner's scores.
GUMBEL = {"NSGA": (0.11, 5.5), "NS": (0.13, 6.4), "SWGA": (0.72, 9.25), "SW": (0.06, 44.6), "": (0.51, 15.0), "expect": (0.28, 8.5)}


def expected_share(gc_q: Column, gc_t: Column, length: Column) -> Column:
    """Share of columns that match by chance, given the GC counts of two sequences of one length: half of the agreeing halves."""
    p, q = gc_q / length, gc_t / length
    return (p * q + (1 - p) * (1 - q)) / 2


def z_score(matches: Column, length: Column, share: Column) -> Column:
    """Matches above expectation in standard deviations."""
    return (matches - share * length) / F.sqrt(share * (1 - share) * length)


def z_for(probability: float, target_bases: float) -> float:
    """The z-score at which a match reaches ``probability`` in a target of so many bases.

    exp(-tail * bases) is monotone in z, so filtering by probability is a comparison with this literal.
    """
    tail = -math.log(probability) / target_bases
    return NormalDist().inv_cdf(1 - tail) if tail > 1e-15 else -NormalDist().inv_cdf(tail)


#: Coefficients of a Chebyshev fit of ln(erfc) + x^2 over 1 / (1 + x / 2), by rising power; its relative error is below 1.2e-7 everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: A rational fit of the normal quantile, relative error below 4e-9: numerator and denominator (by falling power, the last one 1) in the middle and in the tails, and where they meet.
QUANTILE_MIDDLE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00), (-5.447609879822406e01, 1.615858368598409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
QUANTILE_TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425


def _polynomial(x: Column, falling: tuple[float, ...]) -> Column:
    out = F.lit(falling[0])
    for c in falling[1:]:
        out = out * x + c
    return out


def erfc(x: Column) -> Column:
    """The complementary error function as a native column; relative error below 1.2e-7, also far out."""
    t = 1 / (1 + F.abs(x) / 2)
    upper = t * F.exp(_polynomial(t, ERFC[::-1]) - x * x)
    return F.when(x >= 0, upper).otherwise(2 - upper)


def erf(x: Column) -> Column:
    return 1 - erfc(x)


def normal_tail(z: Column) -> Column:
    """The upper tail of the normal law."""
    return erfc(z / math.sqrt(2)) / 2


def normal_quantile(p: Column) -> Column:
    """The z below which a share ``p`` of the normal law lies; null outside 0 to 1. Relative error below 4e-9."""
    q, r = p - 0.5, F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    middle = q * _polynomial(q * q, QUANTILE_MIDDLE[0]) / _polynomial(q * q, QUANTILE_MIDDLE[1])
    low = _polynomial(r, QUANTILE_TAIL[0]) / _polynomial(r, QUANTILE_TAIL[1])
    return F.when((p <= 0) | (p >= 1), None).when(p < TAIL, low).when(p > 1 - TAIL, -low).otherwise(middle)


def match_probabilities(z: Column, target_bases: float | Column) -> Column:
    """exp(-upper normal tail * target bases): how likely a match isn't one by chance, from its z-score."""
    return F.exp(-normal_tail(z) * target_bases)


def raw_scores(identity: Column, length: Column, target_bases: float | Column, gc_query: Column, gc_target: Column) -> Column:
    """``raw_score`` as a native column."""
    p, q = (F.floor(0.5 + length * x) for x in (gc_query, gc_target))
    return match_probabilities(z_score(identity * length, length, expected_share(p, q, length)), target_bases)


def match_probability(z: float, target_bases: float) -> float:
    """exp(-upper normal tail * target bases)."""
    return math.exp(-0.5 * math.erfc(z / math.sqrt(2)) * target_bases)


def raw_score(identity: float, length: int, target_bases: float, gc_query: float, gc_target: float) -> float:
    """The probability of a match from its summary alone: identity, length and the GC shares of both sides, rounded to whole bases."""
    p, q = (math.floor(0.5 + length * x) / length for x in (gc_query, gc_target))
    share = (p * q + (1 - p) * (1 - q)) / 2
    return match_probability((identity - share) * length / math.sqrt(share * (1 - share) * length), target_bases)


def match_penalty(prob: Column) -> Column:
    return -200.0 * F.log(prob)


def repeat_score(depth: Column) -> Column:
    """What skipping a match costs, by its repeat depth. One step for each depth up to 6."""
    return F.when(depth <= 1, 10.0).when(depth == 2, 5.0).when(depth == 3, 2.5).when(depth == 4, 1.2).when(depth == 5, 0.5).when(depth == 6, 0.001).otherwise(0.000001)


def gumbel_p(score: Column, aligner: str = "") -> Column:
    rate, location = GUMBEL[aligner]
    return 1 - F.exp(-F.exp(-F.lit(rate) * (score - F.lit(location))))


def poisson_p(expected: Column) -> Column:
    return -F.expm1(-expected)


def transition(dt: Column, dq: Column, other_query: Column, other_strand: Column, most: float = 40.0) -> Column:
    """The cost of going from one match of a chain to the next, by the steps in target and query."""
    off = F.abs(dq - dt)
    jump = F.when(F.abs(dt) > 1_000_000, F.sqrt(F.abs(dt)) / 10 - 100).otherwise(0.0)
    near = F.when(off == 1, F.lit(0.0)).otherwise(F.least(F.lit(most), off / F.greatest(F.abs(dt), F.lit(300)) + jump + 0.01))
    return F.when(other_query, F.lit(150.0)).when(other_strand, F.lit(20.0)).otherwise(near)


def alignment_scores(target: Column, query: Column) -> Column:
    """(columns, matches, mismatches, edits, score, contiguity) of two aligned strings with gaps ``-``.

    Gap columns that follow each other are one run. ``edits`` counts mismatches and runs, ``score`` is matches less mismatches less a
    run's length, 10 at most; a run at the end enters neither. ``contiguity`` is the mean length of the runs of equal
    letters, 0 if there are none. The longer string is cut to the shorter one's length; nulls give null.
    """
    n = F.least(F.length(target), F.length(query))
    letters = lambda s: F.filter(F.split(F.substr(s, F.lit(1), n), ""), lambda c: c != "")
    kind = lambda a, b: F.when((a == "-") | (b == "-"), F.lit("g")).when(a == b, F.lit("m")).otherwise(F.lit("x"))
    kinds = F.array_join(F.zip_with(letters(target), letters(query), kind), "")
    count = lambda c: (F.length(kinds) - F.length(F.replace(kinds, F.lit(c), F.lit("")))).cast("long")
    gaps = F.regexp_extract_all(F.regexp_replace(kinds, "g+$", ""), F.lit("(g+)"), F.lit(1))
    runs = F.size(F.regexp_extract_all(kinds, F.lit("(m+)"), F.lit(1)))
    price = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + F.least(F.length(g), F.lit(10)))
    return F.struct(
        n.cast("long").alias("columns"), count("m").alias("matches"), count("x").alias("mismatches"), (count("x") + F.size(gaps)).alias("edits"),
        (count("m") - count("x") - price).alias("score"), (count("m") / F.greatest(runs, F.lit(1))).alias("contiguity"),
    )
