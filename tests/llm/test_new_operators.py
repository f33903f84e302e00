"""Fill-in-the-middle, periodic runs and decontamination against brute-force versions, and on nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from colinear.llm import decontaminate, infill, periods
from colinear.llm import registry as llm

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name, tables, sf=SF):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = llm.queries()[name](spark, sf)
    want = con.execute(llm.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


# Fill-in-the-middle


def tokens(text, unit):
    return re.findall({"token": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "char": r"(?s).", "line": r"[^\n]*\n|[^\n]+"}[unit], text)


def brute_infill(text, i, unit="token"):
    w = tokens(text := text or "", unit)
    x = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(w)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:z]), "".join(w[z:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = [None, "", " ", "a", " a", "a ", "\n\n", "a\nb\n", "ß \t語 x\x0b\x1c\x85y z", "<", "<P", "P><S", "a <P> b", "<<S>>", "😀😀 😀\n", "x" * 50_000, "é " * 20_000, "\x00 \x00", "S>a<"]


@pytest.mark.parametrize("unit", ["token", "char", "line"])
def test_cuts_of_runs_are_those_of_the_units(unit):
    r = random.Random(unit)
    texts = [t for t in TEXTS if t is not None] + ["".join(r.choice("ab é語😀  \n\t<") for _ in range(r.randint(0, 40))) for _ in range(300)]
    for t in texts:
        w, found = tokens(t, unit), infill.runs(t.encode(), unit)
        assert found.n == len(w)
        for k in {0, 1, len(w) // 2, len(w) - 1, len(w)} if len(w) > 60 else range(len(w) + 1):
            if 0 <= k <= len(w):
                head = "".join(w[:k])
                assert found.cut(k) == (len(head.encode()), len(head)), (t, k)


def test_infill_equals_the_plain_way_and_is_restored(spark):
    r = random.Random(2)
    texts = TEXTS * 8 + ["".join(r.choice("ab é語😀  \n<PSM>") for _ in range(r.randint(0, 60))) for _ in range(400)]
    rows = [(None if k % 97 == 5 else k, t, "clash") for k, t in enumerate(texts)] + [(3, "twice here", "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, form string")
    for unit in ("token", "char"):
        got = infill.infill(df, unit=unit).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
        assert sorted(str((x["doc_id"], x["text"], x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"])) for x in got) == sorted(str((i, t, *brute_infill(t, i, unit))) for i, t, _ in rows)
        assert all(x["back"] == (x["text"] or "") for x in got)
        assert {x["form"] for x in got} == {"plain", "psm", "spm"}
    assert infill.infill(df.limit(0)).count() == 0
    assert {x["form"] for x in infill.infill(df, rate=100, spm_rate=0).where("length(text) > 0 and not text rlike '<[PSM]>'").collect()} == {"psm"}


def test_infill_sql(spark):
    same_as_sql(spark, "op11_infill", ["documents"])


# Periodic runs


def brute_runs(w, least=6, fold=4):
    n, out, seen = len(w), [], set()
    for p in range(1, n // fold + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, fold * p) and (i, j + p) not in seen:
                seen.add((i, j + p))
                out.append((i, j + p - i, p))
            i = j
    return sorted(out, key=lambda x: (x[0], x[2]))


def brute_row(i, t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    h = zlib.crc32(("" if i is None else str(i)).encode())
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = brute_runs(w)
    top = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    gone = {k for s, length, p in found for k in range(s + p, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(found), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{length},{p}\n" for s, length, p in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def some_words(r):
    kind = r.randrange(4)
    if kind == 0:
        return [r.choice("ab") for _ in range(r.randint(0, 90))]
    if kind == 1:
        return [r.choice("abc") for _ in range(r.randint(1, 9))] * r.randint(1, 12) + [r.choice("abc") for _ in range(r.randint(0, 9))]
    if kind == 2:
        inner = ["x"] * r.randint(4, 9) + ["y"]
        return ["q", *inner * r.randint(3, 7), "z", *"abab" * r.randint(1, 6)]
    return [str(r.randrange(50)) for _ in range(r.randint(0, 60))]


def test_extensions_are_the_longest_common_ones():
    r = random.Random(4)
    for size in (1, 2, 3, 17, 40, 200, 333):
        for letters in (1, 2, 5):
            ids = np.array([r.randrange(letters) for _ in range(size)])
            e = periods.Extensions(ids)
            pairs = [(a, b) for a in range(size + 1) for b in range(size + 1) if a != b]
            pairs = r.sample(pairs, min(len(pairs), 400))
            want = [next((k for k in range(size) if max(a, b) + k >= size or ids[a + k] != ids[b + k]), 0) for a, b in pairs]
            assert e.common(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])).tolist() == want


def test_runs_equal_brute_force(monkeypatch):
    r = random.Random(5)
    for at_a_time in (1 << 19, 7):
        monkeypatch.setattr(periods, "AT_A_TIME", at_a_time)
        for _ in range(400):
            w = some_words(r)
            ids = np.array([hash(x) for x in w], np.int64)
            for least, fold in ((6, 4), (2, 2), (10, 3)):
                found = periods.runs(ids, least, fold)
                assert list(zip(found.start.tolist(), found.length.tolist(), found.period.tolist(), strict=True)) == brute_runs(w, least, fold)


def test_periodic_runs_query(spark, tmp_path):
    r = random.Random(6)
    rows = [(k if k % 50 else None, " ".join(some_words(r)), "clash") for k in range(300)]
    rows += [(900, None, "x"), (901, "", "x"), (902, " \n\t ", "x"), (903, "a b a b a b a b a b a b a b", "x"), (904, "a " * 3000, "x"), (905, "a b " * 2000 + "c " * 5, "x"), (905, "a b " * 2000 + "c " * 5, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, n_runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = periods.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(str(tuple(x)) for x in got) == sorted(str(brute_row(i, t)) for i, t, _ in rows)
    assert sum(x["n_runs"] > 0 for x in got) > 50
    assert periods.detect(spark.createDataFrame(rows[:3], "doc_id long, text string, n_runs string").limit(0)).count() == 0


# Decontamination


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(t):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(docs, items, window=10):
    found = []
    for i, t in docs:
        w, hit, ids = plain_words(t), set(), set()
        for j, x in items:
            x = plain_words(x)
            m = min(len(x), window)
            for k in range(len(x) - m + 1 if m else 0):
                for at in range(len(w) - m + 1):
                    if w[at : at + m] == x[k : k + m]:
                        hit.update(range(at, at + m))
                        ids.add("" if j is None else str(j))
        found.append((i, len(w), len(hit), sorted(ids)))
    return found


def check_hits(spark, docs, items, **more):
    left = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, item_id string, g long")
    right = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, th long")
    got = [tuple(x) for x in decontaminate.decontaminate(left, right, **more).collect()]
    assert sorted(map(str, (x[:4] for x in got))) == sorted(map(str, brute_hits(docs, items, more.get("window", 10))))
    for _, _, n_hit, _, spans in got:
        assert len({k for s in spans for k in range(s["at"], s["at"] + s["m"])}) == n_hit
    return got


def test_decontaminate_equals_brute_force(spark, monkeypatch):
    r = random.Random(7)
    vocabulary = ["The", "of", "Äpfel", "éa", "x1", "ÉA", "to", "語", "42", "b"]
    prose = lambda n, few=10: " ".join(r.choice(vocabulary[:few]) + r.choice(["", "", ",", "."]) for _ in range(n))
    items = [(k, prose(r.randint(10, 40))) for k in range(12)] + [(20, None), (21, ""), (22, " ,.- "), (23, "only FOUR words here"), (24, "xyzzy"), (25, prose(9)), (25, prose(14)), (26, items_text := prose(16)), (27, items_text), (None, "null item of six words"), (28, "of " * 13)]
    docs = [(None, None), (None, "a of b"), (100, ""), (101, "...")]
    for k in range(60):
        parts = [prose(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            w = plain_words(r.choice(items)[1])
            a = r.randint(0, max(0, len(w) - 5))
            parts += [" ".join(w[a : a + r.randint(4, 30)]).upper().replace("É", "é"), prose(r.randint(0, 6))]
        docs.append((k % 50, " - ".join(parts)))
    docs += [(200, items[0][1]), (200, items[0][1]), (201, "of " * 400), (202, "xyzzy " * 3 + "ONLY four, words here " * 2), (203, " ".join(x[1] or "" for x in items))]
    got = check_hits(spark, docs, items)
    assert sum(x[2] > 0 for x in got) > 20
    check_hits(spark, docs[:30], items, window=6)
    monkeypatch.setattr(decontaminate, "SMALL", 0)  # nothing is broadcast
    check_hits(spark, docs, items)


def test_decontaminate_empty_tables(spark):
    check_hits(spark, [(1, "a b c")], [(1, None)])
    left, right = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.decontaminate(left, right).count() == 0
    assert decontaminate.decontaminate(right.select(F.col("item_id").alias("doc_id"), "text"), right.limit(0)).select("n_words", "n_hit").collect() == [(2, 0)]


def test_decontaminate_is_native_and_equals_sql(spark):
    plan = llm.queries()["op13_decontaminate"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    same_as_sql(spark, "op13_decontaminate", ["documents", "benchmark"], "/root/testdata/sf0.01")


def test_a_group_of_equal_texts_is_parted_where_shards_need_it(spark):
    from colinear.llm import sharding

    rows = [(i, "one text that many share" if i % 3 == 0 else f"text of its own, number {i:04}", f"s{i % 5}") for i in range(600)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=4).collect()
    assert sorted(r["id"] for r in got) == list(range(600))
    size = [sum(r["size"] for r in got if r["shard"] == k) for k in range(4)]
    assert max(size) - min(size) <= 0.05 * sum(size) / 4
    assert len({r["shard"] for r in got if r["id"] % 3 == 0}) > 1
