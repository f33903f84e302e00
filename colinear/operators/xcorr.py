"""Cross-correlation of sequences as four-channel signals, by FFT over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colinear.functions.sequence import AMINO, IUPAC, PROTEIN
from colinear.session import added, spread

#: Envelope block; peaks above envelope * cutoff + 1; least run, share of equal columns in a run's windows.
ENVELOPE, CUTOFF, CUTOFF_FAST, LEAST, SHARE = 256, 1.8, 2.9, 45, 0.42
WEIGHTS = np.zeros((256, 4), np.float32)
for _c, _bases in IUPAC.items():
    for _b in _bases:
        WEIGHTS[ord(_c), "ACGT".index(_b)] = 1 / len(_bases)


def weights_of(seq: str) -> np.ndarray:
    """Letters x 4 base weights."""
    return WEIGHTS[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]


def entropy(w: np.ndarray, window: int) -> np.ndarray:
    """Shannon entropy (bits) of each window of columns, spread over its letters."""
    n = len(w)
    starts = np.arange(0, n, window)
    p = np.add.reduceat(w, starts, axis=0) / np.minimum(window, n - starts)[:, None]
    h = -np.where(p < 0.001, 0, p * np.log2(np.maximum(p, 1e-9))).sum(axis=1)
    return np.repeat(np.maximum(h, 0), window)[:n].astype(np.float32)


def smooth(x: np.ndarray) -> np.ndarray:
    """1/4, 1/2, 1/4 over three neighbours; the ends are 0."""
    out = np.zeros_like(x)
    out[1:-1] = x[1:-1] / 2 + (x[:-2] + x[2:]) / 4
    return out


def signal(w: np.ndarray, size: int, by_entropy: bool = True) -> np.ndarray:
    """Channels x size: weights less their means, times the entropy (sequences of 1024 and more), padded with zeros."""
    out = np.zeros((w.shape[1], size), np.float32)
    if len(w):
        e = entropy(w, max(1, size // 512)) if by_entropy and len(w) >= 1024 else np.float32(1)
        out[:, : len(w)] = ((w - w.mean(axis=0)).T) * e
    return out


def correlate(t: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum over the channels of the cross-correlation; index i is the shift i - size / 2 of the query along the target."""
    n = t.shape[1]
    product = (np.fft.rfft(t, axis=1) * np.conj(np.fft.rfft(q, axis=1))).sum(axis=0)
    return np.roll(np.fft.irfft(product, n), n // 2)


def autocorrelate(x: np.ndarray) -> np.ndarray:
    return correlate(x, x)


def peaks(xc: np.ndarray, cutoff: float = CUTOFF) -> np.ndarray:
    """Indices above the local envelope (root mean square of blocks, if there are more than 8) times the cutoff, plus 1."""
    blocks = max(1, len(xc) // ENVELOPE)
    if blocks > 8:
        envelope = np.sqrt((xc[: blocks * ENVELOPE].reshape(blocks, ENVELOPE) ** 2).mean(axis=1))
        level = np.repeat(envelope, ENVELOPE)
        level = np.concatenate([level, np.full(len(xc) - len(level), level[-1])])
    else:
        level = np.zeros(len(xc))
    return np.flatnonzero(xc > level * cutoff + 1.0)


def best_shifts(xc: np.ndarray, n: int = 15) -> np.ndarray:
    """The n greatest shifts, greatest first."""
    top = np.argpartition(-xc, min(n, len(xc) - 1))[:n]
    return top[np.argsort(-xc[top], kind="stable")] - len(xc) // 2


def runs_at(t: np.ndarray, q: np.ndarray, shift: int, least: int = LEAST, share: float = SHARE) -> list[tuple[int, int, int, float]]:
    """(target start, query start, length, identity) of the maximal runs of good windows at one shift of the query."""
    a, b = max(0, shift), max(0, -shift)
    n = min(len(t) - a, len(q) - b)
    window = least + 1
    if n < window:
        return []
    same = (t[a : a + n] * q[b : b + n]).sum(axis=1)
    whole = np.concatenate([[0], np.cumsum((100 * same).astype(np.int64))])
    good = whole[window:] - whole[:-window] > int(least * share * 100)
    step = np.diff(np.concatenate([[0], good.astype(np.int8), [0]]))
    out = []
    for i, j in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
        end = j - 1 + window
        out.append((a + int(i), b + int(i), int(end - i), float(same[i:end].mean())))
    return out


#: Columns of all shifts that are worked off at a time.
HELD_SHIFTS = 1 << 20
#: A column of two letters, in hundredths; the last letter stands for what lies outside a sequence.
_LETTERS = "".join(IUPAC)
_CODES = np.full(256, len(_LETTERS), np.uint8)
_CODES[np.frombuffer(_LETTERS.encode(), np.uint8)] = np.arange(len(_LETTERS))
_SAME = WEIGHTS[np.frombuffer(_LETTERS.encode(), np.uint8)] @ WEIGHTS[np.frombuffer(_LETTERS.encode(), np.uint8)].T
_SAME = np.pad(_SAME, (0, 2)).astype(np.float64)


def windowed_runs(target: str, query: str, least: int = LEAST, share: float = SHARE) -> list[tuple[int, int, int, float]]:
    """What ``runs_at`` gives at every shift of the query, sorted, without a transform: no shift is left out for the lack of a peak.

    Running sums along the query give all windows of a block of shifts at once. The work is the product of both lengths,
    the memory that of ``HELD_SHIFTS`` columns, or of one shift of a longer query.
    """
    t, q = (_CODES[np.frombuffer(s.encode("ascii", "replace"), np.uint8)] for s in (target, query))
    window, n = least + 1, len(q)
    if min(len(t), n) < window:
        return []
    outside = len(_LETTERS) + 1
    view = np.lib.stride_tricks.sliding_window_view(np.pad(t, n - window, constant_values=outside), n)  # row k: shift k - n + window
    hundredths = (100 * _SAME.astype(np.float32)).astype(np.int64)
    hundredths[outside] = -100 * window  # a window that reaches beyond the target is never good
    bound, rows, out = int(least * share * 100), max(1, HELD_SHIFTS // n), []
    for first in range(0, len(view), rows):
        part = view[first : first + rows]
        sums = np.cumsum(np.pad(hundredths[part, q], ((0, 0), (1, 0))), axis=1)
        good = np.pad((sums[:, window:] - sums[:, :-window] > bound).astype(np.int8), ((0, 0), (1, 1)))
        step = np.diff(good, axis=1)
        for (k, i), j in zip(np.argwhere(step == 1), np.nonzero(step == -1)[1], strict=True):
            end = int(j) - 1 + window
            out.append((int(i) + first + int(k) - n + window, int(i), end - int(i), float(_SAME[part[k, i:end], q[i:end]].mean())))
    return sorted(out)


def windowed_matches(pairs: DataFrame, least: int = LEAST, share: float = SHARE, t: str = "t_seq", q: str = "q_seq") -> DataFrame:
    """The columns of ``pairs`` but the two sequences, and ``t_start, q_start, len, ident`` of every run of good windows at any shift (``windowed_runs``).

    For pairs of bounded size (chunks, surroundings of seeds). Nulls and sequences shorter than a window give no row; repeated pairs give their rows each.
    """
    def make(a: pa.Array, b: pa.Array) -> list[pa.Array]:
        kind = pa.list_(pa.struct([("t_start", pa.int64()), ("q_start", pa.int64()), ("len", pa.int64()), ("ident", pa.float64())]))
        names = ("t_start", "q_start", "len", "ident")
        return [pa.array([[dict(zip(names, m, strict=True)) for m in windowed_runs(x or "", y or "", least, share)] for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)]

    others = [c for c in pairs.columns if c not in (t, q)]
    found = added(pairs, "found_runs array<struct<t_start:bigint,q_start:bigint,len:bigint,ident:double>>", make, [t, q], others)
    return found.select(*others, F.inline("found_runs"))


def matches_of(target: str, query: str, cutoff: float = CUTOFF) -> list[tuple[int, int, int, float]]:
    """Matches of two chunks on one strand."""
    t, q = weights_of(target), weights_of(query)
    if not len(t) or not len(q):
        return []
    size = 2 * 1 << (max(len(t), len(q)) - 1).bit_length()
    xc = correlate(signal(t, size), signal(q, size))
    found = [m for at in peaks(xc, cutoff) for m in runs_at(t, q, int(at) - size // 2)]
    return sorted(set(found))


def xcorr_matches(pairs: DataFrame, cutoff: float = CUTOFF, both: bool = True) -> DataFrame:
    """Matches of chunk pairs (target_id, query_id, t_off, q_off, q_size, t_seq, q_seq) on both strands, or on the given one only.

    ``q_start`` is on the reversed query for reverse matches. With each match come
    the counts that its score needs: length, GC of both sides, equal columns.
    """
    schema = "target_id long, query_id long, query_size long, t_start long, q_start long, len long, rc boolean, ident double, gc_t long, gc_q long"
    turn = str.maketrans("ACGTKMRYSWBVHDNX", "TGCAMKYRSWVBDHNX")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                for rc in (False, True) if both else (False,):
                    q = r.q_seq.translate(turn)[::-1] if rc else r.q_seq
                    off = r.q_size - r.q_off - len(r.q_seq) if rc else r.q_off
                    for ts, qs, n, ident in matches_of(r.t_seq, q, cutoff):
                        gc = [sum(map(s[x : x + n].count, "GC")) for s, x in ((r.t_seq, ts), (q, qs))]
                        out.append((r.target_id, r.query_id, r.q_size, r.t_off + ts, off + qs, n, rc, ident, *gc))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return spread(pairs).mapInPandas(run, schema)


def amino_channels(seq: str) -> np.ndarray:
    """Codons x 21 channels of the amino acids in frame 0."""
    codon = ["TCAG".find(c) for c in seq.upper()]
    out = np.zeros((len(seq) // 3, len(PROTEIN)), np.float32)
    for k in range(len(out)):
        a, b, c = codon[3 * k : 3 * k + 3]
        letter = "Q" if min(a, b, c) < 0 else AMINO[16 * a + 4 * b + c]
        out[k, PROTEIN.index(letter)] = 1
    return out


def protein_matches(target: str, query: str, cutoff: float = CUTOFF, least: int = 15, share: float = SHARE) -> list[tuple[int, int, int, float]]:
    """Matches of two sequences in codon space (positions in codons)."""
    t, q = amino_channels(target), amino_channels(query)
    if not len(t) or not len(q):
        return []
    size = 2 * 1 << (max(len(t), len(q)) - 1).bit_length()
    xc = correlate(signal(t, size, False), signal(q, size, False))
    return sorted({m for at in peaks(xc, cutoff) for m in runs_at(t, q, int(at) - size // 2, least, share)})


def correlate_direct(t: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Correlation of two float signals (values, or values x channels) by plain sums: entry ``len(q) - 1 + s`` is that of the query moved by s."""
    t, q = (np.asarray(v, float).reshape(len(v), -1) for v in (t, q))
    return sum(np.correlate(t[:, k], q[:, k], "full") for k in range(t.shape[1]))


def signal_shifts(pairs: DataFrame, id_col: str = "id") -> DataFrame:
    """``id, shift, strength``: where the second of two float signals (id, t, q) fits the first best, the least shift of equals; nulls and empty signals give no row."""
    schema = f"{id_col} {dict(pairs.dtypes)[id_col]}, shift long, strength double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t, q in zip(b[id_col], b["t"], b["q"], strict=True):
                xc = correlate_direct(t, q)
                at = int(xc.argmax())
                out.append((i, at - len(q) + 1, float(xc[at])))
            yield pd.DataFrame(out, columns=[id_col, "shift", "strength"])

    return pairs.where("size(t) > 0 and size(q) > 0").select(id_col, "t", "q").mapInPandas(run, schema)


def full_overlap(t_size: Column, q_size: Column, shift: Column) -> Column:
    """(t_start, q_start, len) of all columns in which two sequences meet when the query is moved by ``shift``; length 0 if they don't."""
    t, q = F.greatest(shift, F.lit(0)), F.greatest(-shift, F.lit(0))
    return F.struct(t.cast("long").alias("t_start"), q.cast("long").alias("q_start"), F.greatest(F.least(t_size - t, q_size - q), F.lit(0)).cast("long").alias("len"))
