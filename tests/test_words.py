"""Word lookups: frequent words whose pair is rare, both strands, words of any number, brute force."""

import random

import pytest

from colinear.operators import grid, overlaps, seeds

SEQ = "seq_id long, seq string"


def word(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def brute(queries, targets, k, words, ahead=0):
    out = []
    for qi, q in queries:
        for p in range(len(q or "") - k * words + 1):
            span = q[p : p + k * words]
            if set(span) <= set("ACGT"):
                out += [(qi, p, ti, t - o, o) for ti, s in targets for t in range(len(s or "") - k * words + 1) if s[t : t + k * words] == span for o in range(ahead + 1) if t >= o]
    return sorted(out)


@pytest.mark.parametrize(("k", "words"), [(4, 1), (3, 3), (5, 8), (12, 2)])
def test_lookup_equals_brute_force(spark, k, words):
    r = random.Random(k)
    base = word(r, 120)
    targets = [(1, base), (2, base[30:90] + "N" + base[:60]), (3, None), (4, ""), (5, "ACG" * 20)]
    queries = [(7, base[10:80] + "NN" + base[20:100]), (8, None), (9, "ACGA"), (10, "ACG" * 9 + base[:50])]
    q, t = spark.createDataFrame(queries, SEQ), spark.createDataFrame(targets, SEQ)
    for ahead in (0, 2):
        assert sorted(tuple(x) for x in seeds.word_lookup(q, t, k, words, ahead=ahead).collect()) == brute(queries, targets, k, words, ahead)
    # words with more than so many places find nothing
    count = {}
    for _, s in targets:
        for p in range(len(s or "") - k + 1):
            count[s[p : p + k]] = count.get(s[p : p + k], 0) + 1
    kept = [x for x in brute(queries, targets, k, words) if all(count[dict(queries)[x[0]][x[1] + i * k : x[1] + (i + 1) * k]] <= 2 for i in range(words))]
    assert sorted(tuple(x) for x in seeds.word_lookup(q, t, k, words, most=2).collect()) == kept


def test_frequent_words_whose_pair_stands_once(spark, monkeypatch):
    r = random.Random(3)
    a, b = word(r, 12), word(r, 12)
    targets = [(1, "".join(f"{a}{word(r, 9)}N{b}{word(r, 7)}N" for _ in range(1100)) + a + b)]
    queries = [(9, a + b)]
    q, t = spark.createDataFrame(queries, SEQ), spark.createDataFrame(targets, SEQ)
    want = [(9, 1, 0, len(targets[0][1]) - 24, 24)]
    for small in (seeds.SMALL, 0):
        monkeypatch.setattr(seeds, "SMALL", small)
        assert [tuple(x) for x in seeds.unique_seeds(q, t).collect()] == want
    assert seeds.unique_seeds(q, spark.createDataFrame([(1, a + b), (2, a + b)], SEQ)).count() == 0


def test_shared_words_on_both_strands(spark):
    r = random.Random(4)
    base = word(r, 200)
    turned = base[::-1].translate(str.maketrans("ACGT", "TGCA"))
    t = spark.createDataFrame([(1, base), (2, None), (3, "")], SEQ)
    q = spark.createDataFrame([(1, base[5:60]), (2, turned[90:120]), (3, word(r, 90)), (4, None), (5, turned[:24]), (6, turned[:23]), (7, base[:12] + "T" + base[13:30])], SEQ)
    assert sorted(x["seq_id"] for x in grid.shared_words(q, t).collect()) == [1, 2, 5]


def letters_of(r, n, table="ACGT"):
    return "".join(r.choice(table) for _ in range(n))


@pytest.mark.parametrize(("kind", "k"), [("exact", 5), ("comb", 4), ("protein", 3)])
def test_coded_words_meet_as_by_hand(spark, kind, k):
    r = random.Random(kind)
    table = "ARNDCQEGHILKMFPSTWYV" if kind == "protein" else "ACGT"
    base = letters_of(r, 80, table)
    queries, targets = [(1, base[:50]), (2, None), (3, "")], [(5, base[10:60] + "?" + base[:20]), (6, letters_of(r, 60, table))]
    offsets = [2 * i for i in range(k)] if kind == "comb" else list(range(k))
    words = lambda s: {p: tuple(s[p + o] for o in offsets) for p in range(len(s or "") - offsets[-1])}
    want = sorted((qi, p, ti, t) for qi, q in queries for ti, s in targets for p, w in words(q).items() for t, v in words(s).items() if w == v and "?" not in w)
    q, t = spark.createDataFrame(queries, SEQ), spark.createDataFrame(targets, SEQ)
    assert sorted(tuple(x) for x in seeds.word_hits(q, t, k, kind).collect()) == want
    blocks = seeds.spaced_seeds(q, t, k, kind).collect()
    assert sum(x["len"] - seeds.word_width(k, kind) + 1 for x in blocks) == len(want)


def test_lookahead_forgives_a_letter(spark):
    r = random.Random(6)
    base = word(r, 60)
    changed = base[:21] + {"A": "C", "C": "A", "G": "T", "T": "G"}[base[21]] + base[22:]
    q, t = spark.createDataFrame([(1, changed)], SEQ), spark.createDataFrame([(2, base)], SEQ)
    got = {(x["q_pos"], x["t_pos"]): x["penalty"] for x in seeds.lookahead_words(q, t, 6, 3, 4).collect()}
    want = {}
    for p in range(60 - 18 + 1):
        for d in range(-p, 60 - 18 - p + 1):
            late = [next((l for l in range(4) if p + i * 6 + l + 6 <= 60 and p + d + i * 6 + l + 6 <= 60 and changed[p + i * 6 + l : p + i * 6 + l + 6] == base[p + d + i * 6 + l : p + d + i * 6 + l + 6]), None) for i in range(3)]
            if None not in late:
                want[p, p + d] = sum(x > 0 for x in late)
    assert got == want and any(want.values()) and len(seeds.word_lookup(q, t, 6, 3).collect()) < len(want)


def test_overlaps_equal_all_pairs(spark):
    r = random.Random(7)
    bits = lambda c: {"A": 1, "C": 2, "G": 4, "T": 8}[c]
    base = word(r, 400)
    pieces = [(k, base[at : at + 60]) for k, at in enumerate(range(0, 340, 35))]
    pieces += [(50 + k, "".join(c if r.random() > 0.06 else r.choice("ACGT") for c in s)) for k, s in pieces[:6]] + [(90, "ACGT" * 8), (91, "ACGT" * 8), (92, None), (93, ""), (94, "ACG")]
    df = spark.createDataFrame(pieces, SEQ)
    for least, most, ident in ((12, 40, 1.0), (15, 30, 0.9)):
        want = []
        for i, a in pieces:
            for j, b in pieces:
                for n in range(min(most, len(a or ""), len(b or "")), least - 1, -1) if i != j else ():
                    differ = sum(x != y for x, y in zip(a[-n:], b[:n], strict=True))
                    if differ <= int((1 - ident) * n + 0.5):
                        joint = "".join(x if x == y else "-ACMGRSVTWYHKDBN"[bits(x) | bits(y)] for x, y in zip(a[-n:], b[:n], strict=True))
                        want.append((i, j, n, differ, a[:-n] + joint + b[n:]))
                        break
        got = overlaps.overlap_merges(df, df, least, most, ident)
        assert sorted(tuple(x) for x in got.collect()) == sorted(want) and want
        top = overlaps.overlap_merges(df, df, least, most, ident, best=True).collect()
        assert len({x["a_id"] for x in top}) == len(top) == len({x["b_id"] for x in top}) and {tuple(x) for x in top} <= set(want)
