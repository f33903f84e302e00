"""Every stage of the pipeline against a version written by hand, on a small table with all kinds of rows."""

import hashlib
import random

import pytest
from test_operators import brute_classes, brute_dedup

import corpus_pipeline
from colinear.llm import bpe

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside, and what a caller may have.
EXTRA = ["th", "places", "words", "copies", "copy", "found", "_th", "key_id", "unit_size", "left", "away", "removed", "lang_pred", "score"]


def corpus(spark):
    r = random.Random(21)
    words = {"en": ["the", "and", "house", "river", "with", "that"], "de": ["der", "und", "Straße", "über", "nicht", "auch"]}
    sentence = lambda k: (" ".join(r.choice(words[k]) + r.choice("abcdefgh") + r.choice("mnopq") for _ in range(r.randint(6, 14)))).capitalize() + "."
    passage = {k: " ".join(sentence(k) for _ in range(6)) for k in words}
    rows = []
    for i in range(90):
        k = r.choice(list(words))
        text = " ".join(sentence(k) for _ in range(r.randint(3, 9))) + "\n" + " ".join(sentence(k) for _ in range(4))
        rows.append((i, text + ("\n" + passage[k] if i % 6 == 0 else ""), k, r.choice(["a", "b", "b", "c", None])))
    for i in range(12):  # near copies, and one in other letters
        parts = rows[i][1].split(" ")
        parts[5] = "changed"
        rows.append((200 + i, " ".join(parts) if i % 3 else rows[i][1].upper(), rows[i][2], "b"))
    rows += [rows[3], rows[3], (300, rows[4][1], None, "a"), (301, None, "en", "a"), (302, "", "de", None), (303, "12 ?!", "en", "c"), (304, " \n ", None, "c"), (305, "a", "en", "c")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(i, t, k, s, len(t or ""), *EXTRA) for i, t, k, s in rows], schema)


def plain(df):
    return [(x["doc_id"], x["text"], x["source"]) for x in df.collect()]


def unchanged(df, names):
    assert df.columns == names
    assert all(tuple(x[c] for c in EXTRA) == tuple(EXTRA) for x in df.collect())


def test_stages_by_hand(spark):
    docs = corpus(spark)
    names = docs.columns
    stage = dict(corpus_pipeline.STAGES)

    a = stage["language_id"](spark, docs, SF).cache()
    unchanged(a, names)
    assert sorted(map(str, plain(a))) == sorted(str(x) for x in plain(docs) if any(c.isalpha() for c in x[1] or ""))

    b = stage["near_duplicates"](spark, a, SF).cache()
    unchanged(b, names)
    heads = [min(map(int, g)) for g in brute_classes([(i, t) for i, t, _ in plain(a)])]
    assert sorted(x[0] for x in plain(b)) == sorted(heads) and len(heads) < a.count() - 10

    c = stage["substring_dedup"](spark, b, SF).cache()
    unchanged(c, names)
    want = {i: t for i, t in brute_dedup([(i, t) for i, t, _ in plain(b)]).items() if t.strip()}
    assert {i: t for i, t, _ in plain(c)} == want and sum(map(len, want.values())) < sum(len(t) for _, t, _ in plain(b)) - 500
    assert all(x["n_chars"] == len(x["text"]) for x in c.collect())

    d = stage["mix_sources"](spark, c, SF).cache()
    unchanged(d, names)
    size, source = {i: len(t.split()) for i, t, _ in plain(c)}, {i: s for i, _, s in plain(c)}
    taken = {}
    for i, t, s in plain(d):
        assert (t, s) == (want[i], source[i])
        taken[i] = taken.get(i, 0) + 1
    assert max(taken.values()) <= 2
    total, share = sum(size.values()), dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True))
    held = {s: sum(n for i, n in size.items() if source[i] == s) for s in share}
    target, open_, left = {}, set(share), 1.5 * total
    while over := [s for s in open_ if left * share[s] / sum(share[x] for x in open_) > 2 * held[s]]:
        for s in over:
            target[s] = 2 * held[s]
            open_.discard(s)
            left -= target[s]
    target |= {s: left * share[s] / sum(share[x] for x in open_) for s in open_}
    for s in share:
        assert abs(sum(n * size[i] for i, n in taken.items() if source[i] == s) - target[s]) <= max(size.values())

    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file(bpe.default_path())
    got = stage["bpe"](spark, d, SF).collect()
    assert sorted(x["doc_id"] for x in got) == sorted(i for i, n in taken.items() for _ in range(n))
    for x in got:
        ids = ref.encode(want[x["doc_id"]], add_special_tokens=False).ids
        assert (x["n_tokens"], x["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_run_chains_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and {x["doc_id"] for x in got} <= {x["doc_id"] for x in docs.select("doc_id").collect()}


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
