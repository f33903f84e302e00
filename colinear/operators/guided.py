"""Super matches by k-mer dynamic programming, and alignments guided by the best shifts of a correlation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colinear.functions.sequence import revcomp
from colinear.operators import align, xcorr
from colinear.operators.seeds import word_lookup
from colinear.session import spread, stored

#: Bounds of the super matches: cost of a step, frames looked back, cost of leaving a word out.
MOST_STEP, LOOK_BACK, NULL_STEP = 50_000, 16, 20.0
#: Reports of guided alignments: columns and p-value.
LEAST_COLUMNS, MOST_P = 30, 1e-5


def best_words(q: np.ndarray, t: np.ndarray, target: np.ndarray, span: int, rc: np.ndarray | None = None) -> list[int]:
    """Hits (query, target position, target, strand), by query position, on the cheapest chain: each costs how far its step leaves the diagonal.

    A chain gains ``span`` a hit and may look back over ``LOOK_BACK`` query positions. The chain ends at the best hit.
    On the reverse strand target positions fall along the query. Frames of any number of hits take part.
    """
    rc = np.zeros(len(q), bool) if rc is None else np.asarray(rc, bool)
    order = np.lexsort((t, rc, target, q))
    q, t, target, rc = q[order], t[order], target[order], rc[order]
    frames, first = np.unique(q, return_index=True)
    last = np.append(first[1:], len(q))
    gain, back = np.full(len(q), float(span)), np.full(len(q), -1)
    if not len(q):
        return []
    # diagonals of one target and strand lie together, others a greatest step away at least: a step costs min(distance, MOST_STEP)
    diagonal = np.where(rc, t + q, t - q).astype(np.int64)
    line = 2 * np.unique(target, return_inverse=True)[1] + rc
    at = line * (int(diagonal.max() - diagonal.min()) + MOST_STEP) + diagonal - diagonal.min()
    for f in range(1, len(frames)):
        own = slice(first[f], last[f])
        j = np.arange(first[max(0, f - LOOK_BACK)], first[f])
        j = j[np.argsort(at[j], kind="stable")]
        place, g = at[j], gain[j] - NULL_STEP * ((frames[f] - q[j]) > span)
        n = np.arange(len(j))
        below, above = g + place, (g - place)[::-1]
        low = np.maximum.accumulate(np.where(below == np.maximum.accumulate(below), n, 0))
        high = (len(j) - 1 - np.maximum.accumulate(np.where(above == np.maximum.accumulate(above), n, 0)))[::-1]
        x = np.searchsorted(place, at[own], "right")
        tries = np.stack([low[np.maximum(x - 1, 0)], high[np.minimum(x, len(j) - 1)], np.full(len(x), int(g.argmax()))])
        price = np.minimum(np.abs(place[tries] - at[own]), MOST_STEP)
        value = g[tries] - price
        k = value.argmax(axis=0)
        won, here = value[k, np.arange(len(x))], j[tries[k, np.arange(len(x))]]
        gain[own] += np.maximum(won, 0)
        back[own] = np.where(won > 0, here, -1)
    end, path = int(gain.argmax()), []
    while end >= 0:
        path.append(int(order[end]))
        end = int(back[end])
    return path[::-1]


def super_matches(query: DataFrame, target: DataFrame, k: int = 12, words: int = 1, most: int | None = None) -> DataFrame:
    """``query_id, target_id, rc, q_start, t_start, len``: each query's best chain of words, steps of +1 (on the reverse strand -1) joined.

    Words are looked up forward and reverse-complemented; starts are on the forward
    strands of both. Words that the target has more than ``most`` times are left out
    if it is given. Hits are found by joins; a query's hits are one group.
    """
    span = k * words
    # both strands of the queries are looked up at once, so that the target's words are made once
    strand = lambda seq, rc: F.struct(F.struct("seq_id", F.lit(rc).alias("rc"), F.length("seq").alias("size")).alias("seq_id"), seq.alias("seq"))
    strands = query.select(F.explode(F.array(strand(F.col("seq"), False), strand(revcomp(F.col("seq")), True))).alias("s")).select("s.*")
    q_pos = F.when(F.col("query_id.rc"), F.col("query_id.size") - span - F.col("q_pos")).otherwise(F.col("q_pos"))
    hits = word_lookup(strands, target, k, words, most).select(F.col("query_id.seq_id").alias("query_id"), "target_id", q_pos.alias("q_pos"), "t_pos", F.col("query_id.rc").alias("rc"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        path = best_words(g["q_pos"].to_numpy(), g["t_pos"].to_numpy(), g["target_id"].to_numpy(), span, g["rc"].to_numpy())
        out: list[list] = []
        for i in path:
            q, t, tid, rc = int(g["q_pos"].iloc[i]), int(g["t_pos"].iloc[i]), g["target_id"].iloc[i], bool(g["rc"].iloc[i])
            same = bool(out) and out[-1][1] == tid and out[-1][2] == rc and q <= out[-1][3] + out[-1][5]
            if same and not rc and t - out[-1][4] == q - out[-1][3]:
                out[-1][5] = q + span - out[-1][3]
            elif same and rc and t + q + span == out[-1][4] + out[-1][3] + out[-1][5]:
                out[-1][4:] = [t, q + span - out[-1][3]]
            else:
                out.append([g["query_id"].iloc[0], tid, rc, q, t, span])
        return pd.DataFrame(out, columns=["query_id", "target_id", "rc", "q_start", "t_start", "len"])

    kinds = dict(hits.dtypes)
    return hits.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, target_id {kinds['target_id']}, rc boolean, q_start long, t_start long, len long")


def shift_path(t: np.ndarray, q: np.ndarray, shifts: np.ndarray, jump: float = 1.0) -> tuple[list[tuple[int, int]], float]:
    """Columns (target, query) of the best path that stays on one of the shifts of the query or jumps between them.

    A column gains its similarity less the mean similarity of all; a jump costs ``jump`` for each letter of difference. Local.
    """
    lines = np.unique(shifts)
    n = len(t)
    score = np.zeros((n, len(lines)))
    mean = float((t.mean(axis=0) * q.mean(axis=0)).sum())
    for x, s in enumerate(lines):
        a, b = max(0, s), min(n, len(q) + s)
        if a < b:
            score[a:b, x] = (t[a:b] * q[a - s : b - s]).sum(axis=1) - mean
    price = jump * np.abs(lines[:, None] - lines[None, :])
    total, back = np.zeros((n, len(lines))), np.full((n, len(lines)), -1)
    for i in range(n):
        before = (total[i - 1][None, :] - price) if i else np.zeros((len(lines), 1))
        k = before.argmax(axis=1)
        v = before[np.arange(len(lines)), k]
        total[i] = np.maximum(0, v) + score[i]
        back[i] = np.where((v > 0) & (i > 0), k, -1)
    i, x = np.unravel_index(int(total.argmax()), total.shape)
    best, path = float(total[i, x]), []
    while x >= 0:
        if 0 <= i - lines[x] < len(q):
            path.append((int(i), int(i - lines[x])))
        i, x = i - 1, back[i, x]
    return path[::-1], best


def guided(target: str, query: str, proteins: bool = False, n: int = 15, places: float = 1.0) -> tuple[list[tuple[int, int]], float, float] | None:
    """(columns, identity, p-value) of the alignment along the n best shifts; None if it is short or likely by chance.

    The p-value is that of the best of ``places`` independent places, 1 - exp(-upper normal tail * places).
    """
    t, q = (xcorr.amino_channels(target), xcorr.amino_channels(query)) if proteins else (xcorr.weights_of(target), xcorr.weights_of(query))
    if not len(t) or not len(q):
        return None
    size = 2 * 1 << (max(len(t), len(q)) - 1).bit_length()
    xc = xcorr.correlate(xcorr.signal(t, size, False), xcorr.signal(q, size, False))
    path, _ = shift_path(t, q, xcorr.best_shifts(xc, n))
    if len(path) < LEAST_COLUMNS:
        return None
    same = sum(float((t[a] * q[b]).sum()) for a, b in path)
    mean = float((t.mean(axis=0) * q.mean(axis=0)).sum())
    z = (same - mean * len(path)) / math.sqrt(max(mean * (1 - mean) * len(path), 1e-9))
    p = -math.expm1(-0.5 * math.erfc(z / math.sqrt(2)) * places)
    return (path, same / len(path), p) if p <= MOST_P else None


def guided_matches(pairs: DataFrame, proteins: bool = False) -> DataFrame:
    """``id, t_start, q_start, columns, identity`` of pairs (id, t_seq, q_seq)."""
    schema = "id long, t_start long, q_start long, columns long, identity double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(int(i), guided(t, q, proteins)) for i, t, q in zip(b["id"], b["t_seq"], b["q_seq"], strict=True)]
            yield pd.DataFrame([(i, g[0][0][0], g[0][0][1], len(g[0]), round(g[1], 6)) for i, g in found if g], columns=[c.split()[0] for c in schema.split(", ")])

    return spread(pairs.select("id", "t_seq", "q_seq")).mapInPandas(run, schema)


def hairpins(sequences: DataFrame, id_col: str = "seq_id", seq: str = "seq") -> DataFrame:
    """Sequences that match their own reverse complement: a guided alignment of each with it."""
    return guided_matches(sequences.select(F.col(id_col).cast("long").alias("id"), F.col(seq).alias("t_seq"), revcomp(F.col(seq)).alias("q_seq")))


def compare_aligners(pairs: DataFrame) -> DataFrame:
    """``aligner, decile, pairs, matches, edits``: alignments of the same pairs by every aligner, counted by identity decile."""
    out = None
    for name in align.ALIGNERS:
        one = align.align_pairs(pairs, name).withColumn("aligner", F.lit(name))
        out = one if out is None else out.unionByName(one)
    matches = F.round(F.col("identity") * F.length("t_aligned")).cast("long")
    return out.groupBy("aligner", F.floor(F.col("identity") * 10).alias("decile")).agg(F.count("*").alias("pairs"), F.sum(matches).alias("matches"), F.sum("edits").alias("edits"))


def alignment_text(alignments: DataFrame, form: str = "csv") -> DataFrame:
    """``value``: alignments (id, t_off, q_off, score, identity, t_aligned, q_aligned) as ``csv``, ``mfa`` or ``xml`` records."""
    if form == "csv":
        return alignments.select(F.to_csv(F.struct("id", "t_off", "q_off", "score", "identity", "t_aligned", "q_aligned")).alias("value"))
    if form == "mfa":
        return alignments.select(F.format_string(">target_%d_%d\n%s\n>query_%d_%d\n%s", "id", "t_off", "t_aligned", "id", "q_off", "q_aligned").alias("value"))
    if form == "xml":
        return alignments.select(F.format_string('<alignment id="%d" target="%d" query="%d" score="%f" identity="%f"><t>%s</t><q>%s</q></alignment>', "id", "t_off", "q_off", "score", "identity", "t_aligned", "q_aligned").alias("value"))
    raise ValueError(f"no such form: {form}")


def reference_columns(pairs: DataFrame, least: int = 150, least_pairs: int = 20) -> DataFrame:
    """``ref_id, aligner, pos, same, pairs, decile``: how many of the sequences that were aligned to a reference keep each of its columns.

    ``pairs``: ref_id, t_seq (the reference), q_seq. Every aligner aligns every pair; only the window that all of them
    align counts, pairs whose window is shorter than ``least`` and references with fewer than ``least_pairs`` pairs left take no part. Equal pairs are aligned once.
    """
    kind = dict(pairs.dtypes)["ref_id"]
    schema = f"ref_id {kind}, size long, n long, aligner string, kept array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            aligned = {name: align.align_many(list(zip(b["t_seq"], b["q_seq"], strict=True)), name) for name in align.ALIGNERS}
            for k, r in enumerate(b.itertuples(index=False)):
                found = {name: aligned[name][k] for name in align.ALIGNERS}
                if not all(found.values()):
                    continue
                start = max(a.t_start for a in found.values())
                stop = min(a.t_start + len(a.target.replace("-", "")) for a in found.values())
                if stop - start < least:
                    continue
                for name, a in found.items():
                    place = a.t_start + np.cumsum([c != "-" for c in a.target]) - 1
                    same = np.array([x == y for x, y in zip(a.target, a.query, strict=True)])
                    out.append((r.ref_id, len(r.t_seq), r.n, name, place[same & (place >= start) & (place < stop)].tolist()))
            yield pd.DataFrame(out, columns=["ref_id", "size", "n", "aligner", "kept"])

    rows = spread(pairs.where("t_seq <> '' and q_seq <> ''").groupBy("ref_id", "t_seq", "q_seq").agg(F.count("*").alias("n"))).mapInPandas(run, schema)
    rows = stored(rows, "kept")
    counts = rows.groupBy("ref_id", "aligner").agg(F.sum("n").alias("pairs"), F.max("size").alias("size")).where(F.col("pairs") >= least_pairs)
    every = counts.select("ref_id", "aligner", "pairs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("pos"))
    kept = rows.select("ref_id", "aligner", "n", F.explode(F.col("kept").cast("array<bigint>")).alias("pos")).groupBy("ref_id", "aligner", "pos").agg(F.sum("n").alias("same"))
    same = F.coalesce("same", F.lit(0))
    return every.join(kept, ["ref_id", "aligner", "pos"], "left").select("ref_id", "aligner", "pos", same.alias("same"), "pairs", F.floor(10 * same / F.col("pairs")).alias("decile"))
