"""What must not grow: how often a step reads its input, what it writes, and how its work is dealt out."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colinear.functions import sequence as S
from colinear.operators import align, chain, seeds, tiles
from colinear.plans import heavy, programs, queries, registry
from colinear.sources import sequences as fasta


def letters(n: int, seed: int, of: str = "ACGT") -> str:
    return "".join(random.Random(seed).choices(of, k=n))


def test_seed_blocks_reads_the_target_once_and_keeps_the_query_words(spark):
    rows = [(i, letters(300, i, "ACGTN" if i % 2 else "ACGT")) for i in range(40)] + [(98, ""), (99, None)]
    query = spark.createDataFrame([(i, s[20:120]) for i, s in rows[:8]], "seq_id long, seq string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    target = spark.createDataFrame(rows, "seq_id long, seq string").mapInArrow(counted, "seq_id long, seq string")
    found = {tuple(r) for r in seeds.seed_blocks(query, target, 15, most=4).collect()}
    assert read.value == len(rows)  # was read to count and to join
    q, t = seeds.rare(seeds.kmers(query, 15), 4), seeds.rare(seeds.kmers(target, 15), 4)
    assert found == {tuple(r) for r in seeds.extend(seeds.hits(q, t), 15, 14, 15).collect()}
    assert found


def test_sought_words_are_those_of_the_encoder(spark):
    rows = [(0, letters(66_000, 1)), (1, ""), (2, letters(2_000, 2, "ACGTN")), (3, "é" * 30 + letters(90, 3)), (4, "acgt" * 20), (5, "A" * 9)]
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    for k in (1, 15, 31):
        every = {tuple(r) for r in seeds.kmers(df, k).collect()}
        words = np.unique([r[1] for r in every])[::3]
        wanted = set(words.tolist())
        assert {tuple(r) for r in seeds.sought(df, words, k).collect()} == {r for r in every if r[1] in wanted}


def test_runs_of_a_letter_are_the_native_ones_and_end_with_their_sequence(spark):
    texts = ["NNacN", "N", "", None, "NN", "éN中NN😀N", "acgt", "NNN"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "name long, seq string").coalesce(1)
    native = df.select("name", F.explode(S.gap_runs(F.col("seq"))).alias("g")).select("name", "g.*")
    found = fasta.n_gaps(df)
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in native.collect())
    assert "regexp" not in found._jdf.queryExecution().toString().lower()  # a list of all runs and others was kept for each text, and copied for each run
    assert found.schema == native.schema or found.dtypes == native.dtypes


def test_folding_in_arrow_is_the_native_one(spark):
    texts = ["Hello, World 12", "", None, "İK éß中 z", "ZzYy", "\U0001f600ab"]
    native = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(S.fold(F.col("t"))).collect()]
    assert S.folded(pa.array(texts)).to_pylist() == native
    assert S.folded(pa.array(texts).slice(1, 4)).to_pylist() == native[1:5]
    assert S.folded(pa.array(texts, pa.large_string())).to_pylist() == native


def test_only_sequences_that_are_asked_for_are_written(spark):
    df = spark.createDataFrame([(i, letters(50, i)) for i in range(30)], "seq_id long, seq string")
    held = tiles.store(df, only=spark.createDataFrame([(3,), (3,), (7,), (99,)], "target_id long"))
    assert sorted(r["id"] for r in held.collect()) == [3, 7]


def test_few_pairs_are_many_tasks(spark):
    pairs = spark.createDataFrame([(i, letters(40, i), letters(40, i)) for i in range(64)], "id long, t_seq string, q_seq string").coalesce(1)
    for found in (align.align_pairs(pairs), align.homopolymer_identities(pairs)):
        assert found.select(F.spark_partition_id()).distinct().count() > 1
        assert found.count() == 64


def test_skip_alignments_side_by_side_are_those_of_one_pair():
    r = random.Random(5)
    pairs = [(letters(r.randrange(0, 60), i), letters(r.randrange(0, 90), i + 1)) for i in range(60)]
    pairs += [(t[:10] + t[20:], t) for t, _ in pairs if len(t) > 30]
    assert align.skip_align_many(pairs) == [align.skip_align(t, q) for t, q in pairs]


def test_chains_read_their_matches_once(spark):
    columns = "target_id long, query_id long, query_size long, t_start long, q_start long, len long, rc boolean, prob double, ident double"
    r = random.Random(3)
    rows = [(i % 3, i % 2, 10_000, 10 * i, max(0, 10 * i + r.choice([-40, 0, 7])), r.randint(20, 60), r.random() < 0.2, 0.95, 0.9) for i in range(90)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    plain = spark.createDataFrame(rows, columns)
    df = plain.mapInArrow(counted, columns)
    one = sorted(map(tuple, chain.chain(df).collect()))
    assert read.value == len(rows)  # was three times
    both = sorted(map(tuple, chain.chain_duplicates(df).collect()))
    assert read.value == 2 * len(rows)  # was seven times
    assert one == sorted(map(tuple, chain.chain(plain).collect())) and set(one) <= set(rows)
    assert both == sorted(map(tuple, chain.chain_duplicates(plain).collect())) and len(both) > len(one)


@pytest.fixture(scope="module")
def few_with_seeds(spark, tmp_path_factory):
    """A folder of 40 documents, 3 of which hold a passage of an item; and the letters of all of them."""
    d = str(tmp_path_factory.mktemp("few"))
    held = [letters(120, i, "abcdefghijklmnopqrstuvwxyz") for i in range(4)]
    docs = [(i, letters(300, 50 + i, "abcdefghijklmnopqrstuvwxyz") + (held[i][20:100] + " - " + letters(90, i, "acgt") if i < 3 else "")) for i in range(38)] + [(38, ""), (39, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(held)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, sum(c.isalpha() for _, t in docs for c in t or "")


def folded_rows(monkeypatch, spark):
    """Counts the documents that go to Python, by what comes back."""
    plain, read = queries.added, {}

    def counting(df, kinds, *args):
        n = read.setdefault(kinds, spark.sparkContext.accumulator(0))

        def counted(batches):
            for b in batches:
                n.add(b.num_rows)
                yield b

        return plain(df.mapInArrow(counted, df.schema), kinds, *args)

    monkeypatch.setattr(queries, "added", counting)
    return read


@pytest.mark.parametrize("name", ["alignment_records", "star_counts"])
def test_documents_without_seeds_are_folded_once(spark, monkeypatch, few_with_seeds, name):
    read = folded_rows(monkeypatch, spark)
    assert registry.queries()[name](spark, few_with_seeds[0]).count() > 0
    assert read["seq string"].value == 40 + 3  # was 80


def test_letters_searched_are_counted_in_place(spark, monkeypatch, few_with_seeds):
    d, size = few_with_seeds
    assert queries.docs_size(spark, d) == size == queries.docs(spark, d).agg(F.sum(F.length("seq"))).first()[0]
    m = heavy._seeds(spark, d)
    whole = sorted(map(tuple, programs.refined(m, queries.items(spark, d), queries.docs(spark, d)).collect()))
    read = folded_rows(monkeypatch, spark)
    assert sorted(map(tuple, registry.queries()["refined_matches"](spark, d).collect())) == whole
    assert read["seq string"].value == 40 + 3  # was 120
    assert read["size int"].value == 40


def test_blocks_are_realigned_on_the_documents_of_their_summary(spark, monkeypatch, few_with_seeds):
    d, _ = few_with_seeds
    docs, items = queries.docs(spark, d), queries.items(spark, d)
    whole = sorted(map(tuple, programs.realign(programs.merged_summary(heavy._seeds(spark, d), docs, items), docs, items).collect()))
    read = folded_rows(monkeypatch, spark)
    assert sorted(map(tuple, registry.queries()["realigned"](spark, d).collect())) == whole
    assert read["seq string"].value == 40 + 3  # was 120
