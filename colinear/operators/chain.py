"""Chaining of matches by dynamic programming, target by target; long ones in segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colinear.functions.scoring import repeat_score
from colinear.operators.intervals import depth_at, trimmed
from colinear.operators.islands import HEADS, before, dealt
from colinear.operators.matches import best_query
from colinear.session import stored

#: How far a chain looks ahead: bases (once ``FED`` matches were tried) and matches.
AHEAD_BASES, FED, AHEAD_ROWS = 250_000, 10, 2000
#: Matches of a target that are worked off by one task.
SEGMENT = 20_000
#: What costs are counted in, and a cost beyond all that occur.
UNIT, FAR = 1e-6, np.int64(1) << 61
#: The order of a target's matches.
ALONG = ["t_start", "q_start", "len", "query_id", "rc"]
#: Matches whose repeat score is lower don't take part.
LEAST_REPEAT_SCORE = 1e-4


def steps(dt: np.ndarray, dq: np.ndarray, other_query: np.ndarray, other_strand: np.ndarray, most: float = 40.0) -> np.ndarray:
    """Transition costs, see ``scoring.transition``."""
    off = np.abs(dq - dt)
    jump = np.where(np.abs(dt) > 1_000_000, np.sqrt(np.abs(dt)) / 10 - 100, 0.0)
    near = np.where(off == 1, 0.0, np.minimum(most, off / np.maximum(np.abs(dt), 300) + jump + 0.01))
    return np.where(other_query, 150.0, np.where(other_strand, 20.0, near))


def stops(t: np.ndarray, ahead: int = AHEAD_ROWS) -> np.ndarray:
    """For each match, by target start, the first one that its chain doesn't try next; never falling."""
    n, i = len(t), np.arange(len(t))
    stop = np.minimum(n, i + 1 + ahead)
    far = np.searchsorted(t, t + AHEAD_BASES, "right")
    return np.where(far < stop, np.minimum(stop, np.maximum(far, i + 1 + FED)), stop)


def costs(t: np.ndarray, q: np.ndarray, query: np.ndarray, rc: np.ndarray, prob: np.ndarray, skip: np.ndarray, cost: np.ndarray, known: int, negate_rc: bool = True, most: float = 40.0, ahead: int = AHEAD_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(cost, the match before) of the cheapest chain to each match, from those of the first ``known`` matches (``FAR``: not to start from).

    Costs are whole numbers of ``UNIT``, so that they are the same in whatever parts a chain is worked off.
    """
    n, stop = len(t), stops(t, ahead)
    cost = np.concatenate([cost, np.full(n - known, FAR)])
    before = np.full(n, -1)
    leave = np.rint(-200 * np.log(np.maximum(prob, 1e-300)) / UNIT).astype(np.int64)
    skipped = np.concatenate([[0], np.cumsum(np.rint(skip / UNIT).astype(np.int64))])
    for i in range(n - 1):
        if cost[i] >= FAR or stop[i] <= known:
            continue
        j = np.arange(max(i + 1, known), stop[i])
        dt, dq = t[j] - t[i], q[j] - q[i]
        if negate_rc and rc[i]:
            dq = np.where(rc[j], -dq, dq)
        step = np.rint(steps(dt, dq, query[j] != query[i], rc[j] != rc[i], most) / UNIT).astype(np.int64)
        new = cost[i] + leave[i] + step + skipped[j] - skipped[i + 1]
        better = new < cost[j]
        cost[j[better]] = new[better]
        before[j[better]] = i
    return cost, before


def best_path(t: np.ndarray, q: np.ndarray, query: np.ndarray, rc: np.ndarray, prob: np.ndarray, skip: np.ndarray, negate_rc: bool = True, most: float = 40.0, ahead: int = AHEAD_ROWS) -> list[int]:
    """Rows of the cheapest chain from the first to the last row, by target start.

    A chain pays -200 ln(prob) for each match that it leaves, the transition to the
    next, and the repeat scores of the matches between that it skips.
    """
    if not len(t):
        return []
    _, before = costs(t, q, query, rc, prob, skip, np.zeros(1, np.int64), 1, negate_rc, most, ahead)
    path, at = [], len(t) - 1
    while at >= 0:
        path.append(at)
        at = before[at]
    return path[::-1]


def with_repeat_scores(matches: DataFrame, least: float = 0.0) -> DataFrame:
    """Adds ``rep``: the lower of the repeat scores at the match's middle on both axes. Rows whose score isn't above ``least`` are left out, those of the target axis before the query's is found.

    ``matches`` should be written already, as they are read several times. A match goes through the sweeps whole, so it meets its depths without a join.
    """
    match = F.struct(*matches.columns)
    middle = lambda start: F.col(start) + F.floor(F.col("len") / 2)
    t = depth_at(matches.select(match.alias("id"), F.col("target_id").alias("seq"), middle("t_start").alias("pos")), trimmed(matches, True))
    own = t.withColumn("_rt", repeat_score(F.col("depth"))).where(F.col("_rt") > least).select("id.*", "_rt")
    q_spans = matches.select(F.col("query_id").alias("seq"), F.col("q_start").alias("start"), (F.col("q_start") + F.col("len")).alias("end"))
    q = depth_at(own.select(F.struct(*own.columns).alias("id"), F.col("query_id").alias("seq"), middle("q_start").alias("pos")), q_spans)
    both = q.select("id.*", repeat_score(F.col("depth")).alias("_rq")).withColumn("rep", F.least("_rt", "_rq")).drop("_rt", "_rq")
    return both.where(F.col("rep") > least)


def chain(matches: DataFrame, negate_rc: bool = True, segment: int = SEGMENT, ahead: int = AHEAD_ROWS) -> DataFrame:
    """The matches on each target's best chain. Highly repeated ones are left out before. Repeated rows count once.

    A target of up to ``segment`` matches is one task; longer ones are worked off in segments of so many (``by_segments``), with the same result.
    """
    scored = stored(with_repeat_scores(stored(matches.distinct(), "matches"), LEAST_REPEAT_SCORE), "scored")
    long_ = scored.groupBy("target_id").agg(F.count("*").alias("n")).where(F.col("n") > segment).select("target_id")
    if not long_.isEmpty():
        long_ = stored(long_, "long")
        few = F.broadcast(long_) if long_.count() <= HEADS else long_
        short = chain_whole(scored.join(few, "target_id", "left_anti"), matches.columns, negate_rc, ahead)
        return short.unionByName(by_segments(scored.join(few, "target_id", "left_semi"), matches.columns, negate_rc, segment, ahead))
    return chain_whole(scored, matches.columns, negate_rc, ahead)


def chain_whole(scored: DataFrame, columns: list[str], negate_rc: bool, ahead: int) -> DataFrame:
    """The chain of each target (rows with ``rep``), a task each."""
    schema = ", ".join(f"{c} {k}" for c, k in scored.select(*columns).dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(ALONG, kind="stable").reset_index(drop=True)
        path = best_path(g["t_start"].to_numpy(float), g["q_start"].to_numpy(float), g["query_id"].to_numpy(), g["rc"].to_numpy(bool), g["prob"].to_numpy(float), g["rep"].to_numpy(float), negate_rc, ahead=ahead)
        return g.loc[path, columns]

    return scored.groupBy("target_id").applyInPandas(run, schema)


def by_segments(scored: DataFrame, columns: list[str], negate_rc: bool, segment: int, ahead: int) -> DataFrame:
    """The chains of long targets, segment by segment at once.

    A segment sees the matches before it whose look-ahead reaches it (its halo), and needs
    their costs, up to a common summand. At first each segment works them off
    by itself, from the first match of the halo. Then every segment whose halo's costs differ from
    what the segment before ended with is worked off again from those, until none does. As cheapest chains soon run
    together, that takes a round or two; in the worst case as many as there are segments.
    What is left is the way back: each segment tells for its last matches where their chain
    enters it, and from the last match on these are put together (up to ``ahead`` numbers a segment).
    """
    ranked = before(dealt(scored, ["target_id"], ALONG), ["target_id"], ALONG, r=("sum", F.lit(1))).withColumn("r", F.coalesce("r", F.lit(0)).cast("long")).drop("_piece")
    ranked = stored(ranked, "ranked")
    last = ranked.groupBy("target_id").agg(F.max("r").alias("last"))
    seg = F.explode(F.sequence(F.floor(F.col("r") / segment), F.least(F.floor((F.col("r") + ahead) / segment), F.floor(F.col("last") / segment))))
    shared = ranked.join(F.broadcast(last) if last.count() <= HEADS else last, "target_id").select("target_id", seg.alias("seg"), "r", "t_start", "q_start", "query_id", "rc", "prob", "rep")
    t_kind, q_kind = dict(scored.dtypes)["target_id"], dict(scored.dtypes)["query_id"]

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("r")
        first = int(g["r"].iloc[0])
        known = int(g["seg"].iloc[0]) * segment - first
        need = int((stops(g["t_start"].to_numpy(float), ahead)[:known] > known).sum())
        one = lambda c, kind: [g[c].to_numpy(kind).tolist()]
        return pd.DataFrame({"target_id": g["target_id"].iloc[:1], "seg": g["seg"].iloc[:1], "first": [first], "known": [known], "need": [need], "t": one("t_start", float), "q": one("q_start", float), "query": [g["query_id"].tolist()], "rc": one("rc", bool), "prob": one("prob", float), "rep": one("rep", float)})

    packed = stored(shared.groupBy("target_id", "seg").applyInPandas(pack, f"target_id {t_kind}, seg long, first long, known long, need long, t array<double>, q array<double>, query array<{q_kind}>, rc array<boolean>, prob array<double>, rep array<double>"), "segments")
    schema = f"target_id {t_kind}, seg long, used array<long>, ends array<long>, enters array<long>, back array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b.itertuples(index=False):
                t, known, need = np.asarray(x.t), x.known, x.need
                rest = (np.asarray(x.q), np.asarray(x.query, dtype=object if isinstance(x.query[0], str) else None), np.asarray(x.rc, bool), np.asarray(x.prob), np.asarray(x.rep))
                if not known:
                    halo, cost = np.zeros(0, np.int64), np.zeros(1, np.int64)
                elif x.given is None:
                    halo = cost = costs(t[:known], *[v[:known] for v in rest], np.zeros(1, np.int64), 1, negate_rc, ahead=ahead)[0]
                else:
                    halo = cost = np.concatenate([np.full(known - need, FAR), np.asarray(x.given, np.int64)])
                cost, came = costs(t, *rest, cost, len(cost), negate_rc, ahead=ahead)
                enters = np.arange(len(t))
                for i in range(known, len(t)):
                    if came[i] >= 0:
                        enters[i] = enters[came[i]]
                tail = max(0, len(t) - ahead)
                used = halo[known - need :]
                out.append((x.target_id, x.seg, (used - used.min(initial=FAR)).tolist() if need else [], cost[tail:].tolist(), (enters[tail:] + x.first).tolist(), came.tolist()))
            yield pd.DataFrame(out, columns=["target_id", "seg", "used", "ends", "enters", "back"])

    done = stored(packed.withColumn("given", F.lit(None).cast("array<long>")).mapInPandas(run, schema), "solved")
    while True:
        given = done.select("target_id", (F.col("seg") + 1).alias("seg"), "ends")
        sides = done.select("target_id", "seg", "used").join(packed.select("target_id", "seg", "need"), ["target_id", "seg"]).where("need > 0").join(given, ["target_id", "seg"])
        sides = sides.select("target_id", "seg", "used", F.slice("ends", -F.col("need").cast("int"), F.col("need").cast("int")).alias("given"))
        level = F.transform("given", lambda v: v - F.array_min("given"))
        wrong = stored(sides.where(F.col("used") != level).select("target_id", "seg", "given"), "wrong")
        if wrong.isEmpty():
            break
        again = packed.join(wrong, ["target_id", "seg"]).mapInPandas(run, schema)
        done = stored(done.join(wrong.select("target_id", "seg"), ["target_id", "seg"], "left_anti").unionByName(again), "solved")

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seg", ascending=False)
        at, out = int(g["end"].iloc[0]), []
        for target, seg, end, enters in zip(g["target_id"], g["seg"], g["end"], g["enters"], strict=True):
            out.append((target, seg, at))
            at = int(enters[at - (end - len(enters) + 1)])
        return pd.DataFrame(out, columns=["target_id", "seg", "at"])

    size = packed.select("target_id", "seg", "first", "known", (F.col("first") + F.size("t") - 1).alias("end"))
    exits = done.select("target_id", "seg", "enters").join(size, ["target_id", "seg"]).groupBy("target_id").applyInPandas(walk, f"target_id {t_kind}, seg long, at long")

    def path(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b.itertuples(index=False):
                i = x.at - x.first
                while i >= x.known:
                    out.append((x.target_id, i + x.first))
                    i = int(x.back[i])
                    if i < 0:
                        break
            yield pd.DataFrame(out, columns=["target_id", "r"])

    rows = done.select("target_id", "seg", "back").join(size, ["target_id", "seg"]).join(exits, ["target_id", "seg"]).mapInPandas(path, f"target_id {t_kind}, r long")
    return ranked.join(rows, ["target_id", "r"], "left_semi").select(*columns)


def chain_duplicates(matches: DataFrame) -> DataFrame:
    """Chains each target twice: its best query's matches, and all the others'; the union of both."""
    matches = stored(matches, "matches")
    best = stored(best_query(matches).select("target_id", "query_id"), "best")
    best = F.broadcast(best) if best.count() <= HEADS else best
    own = matches.join(best, ["target_id", "query_id"], "left_semi")
    other = matches.join(best, ["target_id", "query_id"], "left_anti")
    return chain(own.select(*matches.columns)).unionByName(chain(other.select(*matches.columns)))
