"""Whole programs as compositions of the operators.

Each takes and returns DataFrames: sequences are (seq_id, seq), matches and
summaries as in ``operators.matches``. Rounds of a loop are written to the shared
folder, so their plans don't grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colinear.functions import scoring
from colinear.functions.sequence import revcomp
from colinear.operators import align, blocks, chain, grid, guided, matches, scaffold, seeds, tiles, xcorr
from colinear.session import spread, stored
from colinear.sources import tables as files


def sizes(sequences: DataFrame, name: str) -> DataFrame:
    return sequences.select(F.col("seq_id").alias(f"{name}_id"), F.length("seq").cast("long").alias(f"{name}_size"))


def scored(found: DataFrame, target_bases: float, least_prob: float) -> DataFrame:
    """Correlation matches whose z-score reaches the least probability, with the columns of matches; ``prob`` is each match's own."""
    n = F.col("len").cast("double")
    z = scoring.z_score(F.col("ident") * n, n, scoring.expected_share(F.col("gc_q"), F.col("gc_t"), n))
    good = found.where(z >= scoring.z_for(least_prob, target_bases))
    return good.select("target_id", "query_id", "query_size", "t_start", "q_start", "len", "rc", scoring.match_probabilities(z, target_bases).alias("prob"), "ident")


def pieces(sequences: DataFrame, name: str, at: str, step: int, size: int) -> DataFrame:
    """``<name>_id, <at>, <name>_seq, <name>_length``: sequences cut every ``step`` letters into pieces of ``size``, numbered by ``at``."""
    return tiles.tiles(sequences.where("seq <> ''"), size=size, step=step).toDF(f"{name}_id", at, f"{name}_seq", f"{name}_length")


def search_pixels(tasks: DataFrame, query: DataFrame, target: DataFrame, t_chunk: int, q_chunk: int, cutoff: float = xcorr.CUTOFF) -> DataFrame:
    """Correlates the chunks that tasks (target_id, query_id, x, y) name. Sequences are cut first, so that a task meets its two chunks and no whole sequence."""
    step = t_chunk * 3 // 4
    rows = tasks.join(pieces(target, "target", "x", step, t_chunk), ["target_id", "x"]).join(pieces(query, "query", "y", q_chunk, q_chunk), ["query_id", "y"])
    pairs = rows.select("target_id", "query_id", (F.col("x") * step).alias("t_off"), (F.col("y") * q_chunk).alias("q_off"), F.col("query_length").alias("q_size"), F.col("target_seq").alias("t_seq"), F.col("query_seq").alias("q_seq"))
    return xcorr.xcorr_matches(pairs, cutoff)


def refined(held: DataFrame, query: DataFrame, target: DataFrame, cutoff: float = 1.2, least_prob: float = 0.99999, total: int | None = None) -> DataFrame:
    """Matches and what a more lenient correlation finds in the gaps between consecutive ones (``blocks.guide_chunks``), with the columns of matches.

    ``total``, if given, is the number of letters that were searched; ``target`` needs no more than the sequences with matches then.
    """
    columns = ["target_id", "query_id", "query_size", "t_start", "q_start", "len", "rc", "prob", "ident"]
    total = float((target.agg(F.sum(F.length("seq"))).first()[0] if total is None else total) or 1)
    held = stored(held.select(*columns), "guide")
    ts, qs = tiles.store(target, only=held.select("target_id")), tiles.store(query)
    rows = blocks.guide_chunks(held).withColumns({"t_len": F.col("t_to") - F.col("t_from"), "q_len": F.col("q_to") - F.col("q_from")})
    rows = tiles.sliced(tiles.sliced(rows, ts, "target_id", "t_from", "t_len", "t_seq"), qs, "query_id", "q_from", "q_len", "q_seq", "rc")
    pairs = stored(rows.join(tiles.totals(qs).toDF("query_id", "q_size"), "query_id").select("target_id", "query_id", "rc", F.col("t_from").alias("t_off"), F.col("q_from").alias("q_off"), "q_size", "t_seq", "q_seq"), "pairs")
    found = None
    for rc in (False, True):
        # the pieces are turned already, so only their own strand is asked for
        one = xcorr.xcorr_matches(pairs.where(F.col("rc") == rc).drop("rc").where("t_seq <> '' and q_seq <> ''"), cutoff, both=False).withColumn("rc", F.lit(rc))
        found = one if found is None else found.unionByName(one)
    return held.unionByName(scored(found, total, least_prob).select(*columns)).distinct()


def next_batch(batch: int, found: float, before: float | None) -> int:
    """How many pixels the next round searches: twice as many, or as many again where a pixel yields more than in the round before, as what
    it found moves the weights. ``found``, ``before``: new matches for each pixel of the last two rounds. A round is never smaller than the last, so a search has few of them."""
    return batch if before is not None and found > before else 2 * batch


def synteny_search(query: DataFrame, target: DataFrame, k: tuple[int, ...] = tuple(range(11, 32, 2)), least_seed: int = 24, most: int = 1, t_chunk: int = 1024, q_chunk: int = 1024, rounds: int | None = None, per_round: int = 200, least_prob: float = 0.99999, least_yield: int = 1, patience: int = 10, old: DataFrame | None = None, dump: str | None = None, least_ratio: float = 0.0, told: list[dict] | None = None) -> DataFrame:
    """Seeds, chains, and searches around the chains by correlation, until rounds find little.

    Each round weighs the pixels that hold the middle of a chained match, and the neighbours
    of those that were searched, searches the heaviest that are new, and adds what
    it finds. The first round searches ``per_round`` pixels, the next ones as many as ``next_batch``
    makes of what a pixel yields. It ends when no new pixel is left, or when ``patience`` rounds in
    a row found fewer than ``least_yield`` new matches, or fewer than ``least_ratio`` for each pixel; ``rounds``, if given, bounds
    the rounds. Each round's number, pixels, new matches and ratio are added to ``told``, if given. Matches of an earlier search (``old``, see ``tables.read_matches``) take the
    place of seeds, so a search that stopped goes on from what it had found; with ``dump``
    each round's new matches are written there, by round (``tables.read_rounds`` gives them
    back). Returns the chained matches.
    """
    q_sizes = sizes(query, "query")
    total = float(target.agg(F.sum(F.length("seq"))).first()[0] or 1)
    if old is None:
        found = seeds.seed_blocks_multi(query, target, k, least_seed, most).drop("k").distinct()
        first = seeds.as_matches(found, q_sizes).drop("matches")
    else:
        first = old.select("target_id", "query_id", "query_size", "t_start", "q_start", "len", "rc", "prob", "ident").distinct()
    held = stored(first, "seeds")
    if dump:
        files.write_round(held, dump, 0)
    pixel_keys = ["target_id", "query_id", "x", "y"]
    searched, low, done, batch, ratio = None, 0, 0, per_round, None
    while rounds is None or done < rounds:
        f = matches.forward(stored(chain.chain(held), "chain"))
        x, y = grid.pixel(F.col("t_start") + F.floor(F.col("len") / 2), F.col("q_from") + F.floor(F.col("len") / 2), t_chunk, q_chunk)
        own = f.withColumns({"x": x, "y": y, "weight": F.floor(100 * F.col("ident") * F.col("len"))}).select(*pixel_keys, "weight")
        weighed = grid.weights(own, own.limit(0) if searched is None else searched, ("target_id", "query_id")).where("weight > 0")
        inside = weighed.join(sizes(target, "target"), "target_id").join(q_sizes, "query_id").where((F.col("x") * (t_chunk * 3 // 4) < F.col("target_size")) & (F.col("y") * q_chunk < F.col("query_size"))).select(*pixel_keys, "weight")
        fresh = stored(inside if searched is None else inside.join(searched, pixel_keys, "left_anti"), "fresh")
        left = fresh.count()
        if not left:
            break
        tasks = fresh if left <= batch else stored(fresh.orderBy(F.desc("weight"), *pixel_keys).limit(batch), "tasks")
        new = scored(search_pixels(tasks, query, target, t_chunk, q_chunk), total, least_prob)
        new = stored(new.select(*held.columns).subtract(held), "found")
        if dump:
            files.write_round(new, dump, done + 1)
        tried = tasks.select(*pixel_keys)
        searched = stored(tried if searched is None else searched.unionByName(tried), "searched")
        n, was = new.count(), ratio
        ratio = n / min(left, batch)
        if told is not None:
            told.append({"round": done + 1, "pixels": min(left, batch), "matches": n, "ratio": ratio})
        low = low + 1 if n < least_yield or ratio < least_ratio else 0
        held = stored(held.unionByName(new).distinct(), "held")
        if low >= patience:
            break
        done, batch = done + 1, next_batch(batch, ratio, was)
    return chain.chain(held)


def merged_summary(found: DataFrame, target: DataFrame, query: DataFrame, least_prob: float = 0.6) -> DataFrame:
    """Merges overlapping matches and computes each block's identity on the sequences. Returns summary columns."""
    keys = ["target_id", "query_id", "rc"]
    found = stored(found, "found")
    ts, qs = tiles.store(target, only=found.select("target_id")), tiles.store(query)
    merged = blocks.merge_overlaps(matches.at_least(found, 0, least_prob).select(*keys, "t_start", "q_start", "len"), members=True)
    merged = merged.select(*keys, "t_start", "t_end", "q_start", "q_end", F.col("list").alias("members"), (F.col("t_end") - F.col("t_start")).alias("t_len"), (F.col("q_end") - F.col("q_start")).alias("q_len"))
    rows = tiles.sliced(tiles.sliced(merged, ts, "target_id", "t_start", "t_len", "ts"), qs, "query_id", "q_start", "q_len", "qs", "rc")
    rows = rows.join(tiles.totals(qs).toDF("query_id", "q_size"), "query_id").select(*keys, "t_start", "t_end", "q_start", "q_end", "q_size", "members", "ts", "qs")
    schema = "t_name string, t_start long, t_end long, q_name string, q_start long, q_end long, ident double, ori string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                ident, _, _ = align.merged_identity(r.ts, r.qs, [(m["mt"] - r.t_start, m["mq"] - r.q_start, m["ml"]) for m in r.members])
                a, z = (r.q_size - r.q_end, r.q_size - r.q_start) if r.rc else (r.q_start, r.q_end)
                out.append((f"t{r.target_id}", r.t_start, r.t_end, f"q{r.query_id}", a, z, round(ident, 6), "-" if r.rc else "+"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return spread(rows).mapInPandas(run, schema)


def realign(summary: DataFrame, target: DataFrame, query: DataFrame, aligner: str = "SWGA", boundary: int = 5) -> DataFrame:
    """Joins neighbouring blocks, aligns them, and aligns the gaps between. ``kind`` tells blocks from gaps."""
    merged = stored(blocks.bounded_merge(summary, boundary), "merged")
    gaps = blocks.gap_regions(merged).select("t_name", F.col("t_from").alias("t_start"), F.col("t_to").alias("t_end"), "q_name", F.col("q_from").alias("q_start"), F.col("q_to").alias("q_end"), "ori", F.lit("gap").alias("kind"))
    rows = merged.drop("n").withColumn("kind", F.lit("block")).unionByName(gaps)
    rows = rows.withColumn("id", F.xxhash64(*rows.columns)).withColumns({"t_len": F.col("t_end") - F.col("t_start"), "q_len": F.col("q_end") - F.col("q_start")})
    named = lambda df, x, only=None: tiles.store(df.select(F.concat(F.lit(x), "seq_id").alias("name"), "seq"), "name", only=only)
    rows = tiles.sliced(tiles.sliced(rows, named(target, "t", merged.select("t_name")), "t_name", "t_start", "t_len", "t_seq"), named(query, "q"), "q_name", "q_start", "q_len", "q_seq")
    # a summary's intervals are on the forward strand
    pairs = stored(rows.select("id", "kind", "t_seq", F.when(F.col("ori") == "-", revcomp(F.col("q_seq"))).otherwise(F.col("q_seq")).alias("q_seq")), "pairs")
    return align.align_pairs(pairs.select("id", "t_seq", "q_seq"), aligner).join(pairs.select("id", "kind").distinct(), "id").select("id", "kind", "t_off", "q_off", "score", "identity", "edits")


def seeded_alignments(query: DataFrame, target: DataFrame, k: int = 12, words: int = 1, aligner: str = "NSGA", most_gap: int = 1000, flank: int = 10, most: int | None = None) -> DataFrame:
    """``target_id, query_id, rc, t_start, q_start, score, identity, edits, t_aligned, q_aligned``: from words to alignments.

    Super matches, their groups along target and query, and one alignment of each
    group's surroundings. Starts are those of the alignment; ``q_start`` is on the reversed query for reverse groups.
    """
    q_sizes = sizes(query, "query")
    found = guided.super_matches(query, target, k, words, most).join(q_sizes, "query_id")
    turned = F.when(F.col("rc"), F.col("query_size") - F.col("q_start") - F.col("len")).otherwise(F.col("q_start"))
    groups = blocks.seed_groups(found.withColumn("q_start", turned), most_gap)
    groups = stored(groups.withColumn("id", F.monotonically_increasing_id()), "groups")
    around = groups.withColumns({f"{x}_{part}": y for x in "tq" for part, y in (("from", F.col(f"{x}_start") - flank), ("len", F.col(f"{x}_end") - F.col(f"{x}_start") + 2 * flank))})
    rows = tiles.sliced(tiles.sliced(around, tiles.store(target), "target_id", "t_from", "t_len", "t_seq"), tiles.store(query), "query_id", "q_from", "q_len", "q_seq", "rc")
    aligned = align.align_pairs(rows.select("id", "t_seq", "q_seq"), aligner)
    at = lambda start, off: (F.greatest(F.col(start) - flank, F.lit(0)) + F.col(off)).alias(start)
    return aligned.join(groups, "id").select("target_id", "query_id", "rc", at("t_start", "t_off"), at("q_start", "q_off"), "score", "identity", "edits", "t_aligned", "q_aligned")


def scaffold_assembly(scaffolds: DataFrame, reference: DataFrame, k: int = 15, least: int = 24, most: int = 1) -> DataFrame:
    """Orders, orients and joins scaffolds along a reference: seeds, anchors, links, walks, superscaffolds."""
    found = seeds.seed_blocks(scaffolds, reference, k, None, least, most)
    # both ends of a seed are hits, so that one seed tells which way a scaffold lies
    first, last = F.when(F.col("rc"), F.col("t_start") + F.col("len")).otherwise(F.col("t_start")), F.when(F.col("rc"), F.col("t_start")).otherwise(F.col("t_start") + F.col("len"))
    ends = F.explode(F.array(F.struct(F.col("q_start").alias("s_pos"), first.alias("pos")), F.struct((F.col("q_start") + F.col("len")).alias("s_pos"), last.alias("pos"))))
    hits = found.select(F.concat(F.lit("q"), "query_id").alias("scaffold"), F.col("target_id").alias("chr"), F.when(F.col("rc"), -1).otherwise(1).alias("dir"), ends.alias("e")).select("scaffold", "e.s_pos", "chr", "e.pos", "dir")
    ends = stored(scaffold.anchors(hits), "anchors")
    named = scaffolds.select(F.concat(F.lit("q"), "seq_id").alias("name"), "seq")
    walked = scaffold.paths(scaffold.adjacency(ends), named.select(F.col("name").alias("scaffold")))
    return scaffold.superscaffolds(walked, named)


def matches_by_feature(features: DataFrame, axes: DataFrame, summary: DataFrame) -> DataFrame:
    """Feature totals and the share that matches cover."""
    from colinear.operators.intervals import feature_coverage

    return feature_coverage(features, axes, summary.select(F.col("t_name").alias("seq"), F.col("t_start").alias("start"), F.col("t_end").alias("end")))
