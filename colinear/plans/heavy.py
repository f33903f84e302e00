"""Queries of the operators that SQL doesn't express: dynamic programming, correlation, alignment and walks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colinear.operators import align, blocks, chain, guided, scaffold, tiles, xcorr
from colinear.operators.seeds import as_matches, seed_blocks
from colinear.plans import programs
from colinear.plans.queries import HITS, SUM, M, docs, items, lineitem_matches, scaffold_hits, summary_of
from colinear.session import spread, stored, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def with_sql(sql: str):
    def keep(f):
        SQL[f.__name__] = sql
        return query(f)

    return keep


# A fold over the rows of a group in turn: one step of the recursion for each row, a block's last state is the block.
_MERGE = f"""WITH RECURSIVE {M}, o AS (SELECT *, row_number() OVER (PARTITION BY target_id, query_id, rc ORDER BY t_start, len, q_start) AS i FROM m),
w AS (SELECT target_id, query_id, rc, i, 1 AS b, t_start, q_start, t_start + len AS t_end, q_start + len AS q_end, 1 AS members, t_start AS nt, q_start AS nq FROM o WHERE i = 1
UNION ALL SELECT o.target_id, o.query_id, o.rc, o.i, CASE WHEN j THEN b ELSE b + 1 END, CASE WHEN j THEN w.t_start ELSE o.t_start END, CASE WHEN j THEN w.q_start ELSE o.q_start END,
CASE WHEN j THEN greatest(w.t_end, o.t_start + len) ELSE o.t_start + len END, CASE WHEN j THEN greatest(w.q_end, o.q_start + len) ELSE o.q_start + len END, CASE WHEN j THEN members + 1 ELSE 1 END, o.t_start, o.q_start
FROM w JOIN o ON w.target_id = o.target_id AND w.query_id = o.query_id AND w.rc = o.rc AND o.i = w.i + 1, LATERAL (SELECT nt <= o.t_start AND o.t_start < w.t_end AND nq <= o.q_start AND o.q_start < nq + w.t_end - nt AS j))
SELECT target_id, query_id, rc, t_start, q_start, t_end, q_end, members FROM w QUALIFY row_number() OVER (PARTITION BY target_id, query_id, rc, b ORDER BY i DESC) = 1"""
_TURN = "o AS (SELECT *, row_number() OVER (PARTITION BY t_name, q_name, ori ORDER BY t_start, t_end, q_start) AS i FROM s)"
_ON = "w.t_name = o.t_name AND w.q_name = o.q_name AND w.ori = o.ori AND o.i = w.i + 1"
_BOUNDED = f"""WITH RECURSIVE {SUM}, {_TURN},
w AS (SELECT t_name, q_name, ori, i, 1 AS b, t_start, t_end, q_start, q_end, 1 AS n FROM o WHERE i = 1
UNION ALL SELECT o.t_name, o.q_name, o.ori, o.i, CASE WHEN j THEN b ELSE b + 1 END, CASE WHEN j THEN w.t_start ELSE o.t_start END, CASE WHEN j THEN greatest(w.t_end, o.t_end) ELSE o.t_end END,
CASE WHEN j THEN w.q_start ELSE o.q_start END, CASE WHEN j THEN greatest(w.q_end, o.q_end) ELSE o.q_end END, CASE WHEN j THEN n + 1 ELSE 1 END
FROM w JOIN o ON {_ON}, LATERAL (SELECT abs(w.t_end - o.t_start) <= 2000 AND abs(w.q_end - o.q_start) <= 2000 AS j))
SELECT t_name, t_start, t_end, q_name, q_start, q_end, ori, n FROM w QUALIFY row_number() OVER (PARTITION BY t_name, q_name, ori, b ORDER BY i DESC) = 1"""
_SYNTENY = f"""WITH RECURSIVE {SUM}, {_TURN},
w AS (SELECT t_name, q_name, ori, i, 1 AS b, t_start AS ft, q_start AS fq, t_start, t_end, q_start, q_end, ident FROM o WHERE i = 1
UNION ALL SELECT o.t_name, o.q_name, o.ori, o.i, CASE WHEN j THEN b ELSE b + 1 END, CASE WHEN j THEN ft ELSE o.t_start END, CASE WHEN j THEN fq ELSE o.q_start END, o.t_start, o.t_end, o.q_start, o.q_end, o.ident
FROM w JOIN o ON {_ON}, LATERAL (SELECT CASE WHEN o.ori = '+' THEN o.q_end > fq AND abs(o.q_start - fq - (o.t_start - ft)) < 1000000 ELSE o.q_start < fq AND abs(o.q_start - fq + (o.t_start - ft)) < 1000000 END AS j))
SELECT t_name, min(t_start) AS t_start, max(t_end) AS t_end, q_name, min(q_start) AS q_start, max(q_end) AS q_end, ori, count(*)::INTEGER AS n, round(avg(ident), 9) AS ident FROM w GROUP BY t_name, q_name, ori, b HAVING count(*) >= 3"""
_RUNS = f"""WITH {HITS}, k AS (SELECT *, count(*) OVER (PARTITION BY scaffold) AS n, count(*) OVER (PARTITION BY scaffold, chr) AS o FROM h),
r AS (SELECT *, abs(sum(dir) OVER w) AS total, count(*) OVER w AS len FROM k WHERE o >= n // 5 WINDOW w AS (PARTITION BY scaffold ORDER BY s_pos, chr, pos, dir ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
g AS (SELECT *, row_number() OVER (PARTITION BY scaffold ORDER BY s_pos, chr, pos, dir) AS lo, row_number() OVER (PARTITION BY scaffold ORDER BY s_pos DESC, chr DESC, pos DESC, dir DESC) AS hi FROM r WHERE total = 5 AND len = 5)
SELECT a.scaffold, a.chr AS lo_chr, a.pos AS lo_pos, b.chr AS hi_chr, b.pos AS hi_pos, a.dir FROM g AS a JOIN g AS b ON a.scaffold = b.scaffold AND a.lo = 1 AND b.hi = 1"""


def _seeds(spark, d) -> DataFrame:
    """Seeds of the benchmark items on the documents, as matches, written once."""
    q = items(spark, d)
    return stored(as_matches(seed_blocks(q, docs(spark, d), 15, most=4), q.select(F.col("seq_id").alias("query_id"), F.length("seq").cast("long").alias("query_size"))), "seeds")


def _regions(spark, d) -> DataFrame:
    """(id, t_seq, q_seq) of every seed with 30 letters around it."""
    m = _seeds(spark, d).withColumns({"t_from": F.col("t_start") - 30, "q_from": F.col("q_start") - 30, "size": F.col("len") + 60})
    rows = tiles.sliced(tiles.sliced(m, tiles.store(docs(spark, d, m.select("target_id"))), "target_id", "t_from", "size", "t_seq"), tiles.store(items(spark, d)), "query_id", "q_from", "size", "q_seq", "rc")
    return rows.select(F.xxhash64("target_id", "query_id", "rc", "t_start", "q_start").alias("id"), "t_seq", "q_seq", "target_id", "query_id", "t_start", "q_start", "len", "rc")


@query
def chain_best(spark, d):
    return chain.chain(lineitem_matches(spark, d))


@query
def chain_dups(spark, d):
    return chain.chain_duplicates(lineitem_matches(spark, d))


@with_sql(_MERGE)
def merge_overlaps(spark, d):
    return blocks.merge_overlaps(lineitem_matches(spark, d))


@with_sql(_SYNTENY)
def synteny_blocks(spark, d):
    return blocks.synteny_blocks(summary_of(spark, d)).withColumn("ident", F.round("ident", 9))


@with_sql(_BOUNDED)
def bounded_merge(spark, d):
    return blocks.bounded_merge(summary_of(spark, d), 2000)


@query
def superscaffolds(spark, d):
    ends = scaffold.anchors(scaffold_hits(spark, d))
    names = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.translate(F.upper("s_name"), "0123456789", "ACGTACGTAC").alias("seq"))
    return scaffold.superscaffolds(scaffold.paths(scaffold.adjacency(ends), ends), names)


@with_sql(_RUNS)
def scaffold_run_anchors(spark, d):
    return scaffold.anchors(scaffold_hits(spark, d), run=5)


@query
def xcorr_matches(spark, d):
    """Correlation of every seed's surroundings, widened to 512 letters."""
    off = F.greatest(F.col("t_start") - 256, F.lit(0))
    rows = _seeds(spark, d).select("target_id", "query_id", (F.floor(off / 256) * 256).alias("t_off"), F.lit(1024).alias("size")).distinct()
    # items are read as they are: one query sequence of a pair, of some hundred letters
    pairs = tiles.sliced(rows, tiles.store(docs(spark, d, rows.select("target_id"))), "target_id", "t_off", "size", "t_seq").join(items(spark, d).select(F.col("seq_id").alias("query_id"), F.col("seq").alias("q_seq")), "query_id")
    pairs = pairs.select("target_id", "query_id", "t_off", F.lit(0).cast("long").alias("q_off"), F.length("q_seq").cast("long").alias("q_size"), "t_seq", "q_seq")
    return xcorr.xcorr_matches(pairs).distinct()


@query
def autocorrelation(spark, d):
    """The strongest shift of every embedding, read as a signal, against itself beyond 0."""

    def run(batches):
        for b in batches:
            out = []
            for i, v in zip(b["vec_id"], b["embedding"], strict=True):
                x = xcorr.smooth(xcorr.smooth(np.asarray(v, np.float32)))
                xc = xcorr.autocorrelate(np.pad(x - x.mean(), (0, len(x)))[None, :])
                half = len(xc) // 2
                at = half + 1 + int(xc[half + 1 :].argmax())
                out.append((int(i), at - half, round(float(xc[at] / xc[half]), 4)))
            yield pd.DataFrame(out, columns=["vec_id", "shift", "strength"])

    return table(spark, d, "embeddings").where("embedding is not null").select("vec_id", "embedding").mapInPandas(run, "vec_id long, shift int, strength double")


@query
def protein_xcorr(spark, d):
    """Matches in codon space between neighbouring items."""
    a = items(spark, d)
    pairs = a.join(a.select((F.col("seq_id") - 1).alias("seq_id"), F.col("seq").alias("other")), "seq_id")

    def run(batches):
        for b in batches:
            out = [(int(i), *m) for i, x, y in zip(b["seq_id"], b["seq"], b["other"], strict=True) for m in xcorr.protein_matches(x, y, 1.2)]
            yield pd.DataFrame(out, columns=["seq_id", "t_start", "q_start", "len", "ident"])

    return pairs.mapInPandas(run, "seq_id long, t_start long, q_start long, len long, ident double")


def _aligned(name: str):
    def run(spark, d):
        return align.align_pairs(_regions(spark, d).select("id", "t_seq", "q_seq"), name)

    run.__name__ = f"align_{name.lower()}"
    return run


for _name in align.ALIGNERS:
    query(_aligned(_name))


@query
def align_non_overlapping(spark, d):
    def run(batches):
        for b in batches:
            out = [(int(i), a.t_start, a.q_start, len(a.target), a.score) for i, found in zip(b["id"], align.non_overlapping_many(list(zip(b["t_seq"], b["q_seq"], strict=True)), "SWGA", 0.5), strict=True) for a in found]
            yield pd.DataFrame(out, columns=["id", "t_start", "q_start", "len", "score"])

    return spread(_regions(spark, d).select("id", "t_seq", "q_seq")).mapInPandas(run, "id long, t_start long, q_start long, len long, score double")


@query
def align_skip(spark, d):
    def run(batches):
        for b in batches:
            found = align.skip_align_many(list(zip(b["t_seq"], b["q_seq"], strict=True)))
            out = [(int(i), cost, len(path)) for i, (cost, path) in zip(b["id"], found, strict=True)]
            yield pd.DataFrame(out, columns=["id", "cost", "columns"])

    return spread(_regions(spark, d).select("id", "t_seq", "q_seq")).mapInPandas(run, "id long, cost double, columns long")


@query
def gumbel_fit(spark, d):
    """Rate and location of the extreme-value law of order prices, by priority. Groups are pre-aggregated to counts by whole thousands."""
    prices = table(spark, d, "orders").select("o_orderpriority", F.floor(F.col("o_totalprice") / 1000).alias("v")).groupBy("o_orderpriority", "v").agg(F.count("*").alias("n"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("v")
        rate, at = align.fit_gumbel(g["v"].to_numpy(float), g["n"].to_numpy())
        return pd.DataFrame([(g["o_orderpriority"].iloc[0], round(rate, 6), round(at, 3))], columns=["priority", "rate", "location"])

    return prices.groupBy("o_orderpriority").applyInPandas(run, "priority string, rate double, location double")


@query
def synteny_search(spark, d):
    return programs.synteny_search(items(spark, d), docs(spark, d), k=(15, 19), most=4)


@query
def merged_summary(spark, d):
    m = _seeds(spark, d)
    return programs.merged_summary(m, docs(spark, d, m.select("target_id")), items(spark, d))


@query
def scaffold_assembly(spark, d):
    return programs.scaffold_assembly(items(spark, d), docs(spark, d), k=15, most=4)


@query
def realigned(spark, d):
    m = _seeds(spark, d)
    found = stored(docs(spark, d, m.select("target_id")), "targets")  # sliced for the summary and again for its blocks
    return programs.realign(programs.merged_summary(m, found, items(spark, d)), found, items(spark, d))


@query
def super_matches(spark, d):
    a = items(spark, d)
    return guided.super_matches(a, docs(spark, d), 12, 2)


@query
def guided_matches(spark, d):
    return guided.guided_matches(_regions(spark, d).select("id", "t_seq", "q_seq"))


@query
def hairpins(spark, d):
    return guided.hairpins(items(spark, d))


@query
def compare_aligners(spark, d):
    return guided.compare_aligners(_regions(spark, d).select("id", "t_seq", "q_seq"))


@query
def alignment_records(spark, d):
    return guided.alignment_text(align.align_pairs(_regions(spark, d).select("id", "t_seq", "q_seq")), "mfa")
