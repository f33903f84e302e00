"""k-mer seeds: encoding, frequency filter, equi-join and extension into blocks.

Only the encoder is Python (numpy over Arrow batches); where the other side has few k-mers, it
keeps theirs only. Filter, join and extension
are native: a block is a run of hits on one diagonal with small gaps, found by
``lag`` and a running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colinear.functions.sequence import PROTEIN, characters, flat
from colinear.session import stored, tidy

#: 2-bit codes by byte; 255 for letters that break a k-mer.
CODE = np.full(256, 255, np.uint8)
for _i, _c in enumerate("ACGT"):
    CODE[ord(_c)] = CODE[ord(_c.lower())] = _i
#: Letters of a sequence that are encoded at a time.
RUN = 1 << 20
#: Query k-mers up to which they are broadcast to filter the target's before any shuffle (16 bytes each).
SMALL = 1_000_000
#: Letters that are looked up at a time: their words stay in a core's cache.
LOOK = 1 << 16


def kmers_of(seq: str, k: int, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(canonical k-mers, 0-based positions, whether the reverse strand is the canonical one); k is at most 31. ``plain``: those of the forward strand."""
    codes = CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    n = len(codes) - k + 1
    if n < 1:
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty(0, bool)
    good = np.convolve(codes == 255, np.ones(k, np.int64), "valid") == 0 if (codes == 255).any() else np.ones(n, bool)
    two = np.where(codes == 255, 0, codes).astype(np.int64)
    forward, backward = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(k):
        forward = (forward << 2) | two[j : j + n]
        if not plain:
            backward = (backward << 2) | (3 - two[k - 1 - j : k - 1 - j + n])
    at = np.flatnonzero(good)
    if plain:
        return forward[at], at, np.zeros(len(at), bool)
    f, b = forward[at], backward[at]
    return np.minimum(f, b), at, b < f


def kmers(sequences: DataFrame, k: int, id_col: str = "seq_id", seq: str = "seq", plain: bool = False) -> DataFrame:
    """``id, kmer, pos, neg`` of every k-mer of plain bases; others break the window. Null and short sequences give none. ``plain``: see ``kmers_of``."""
    if not 0 < k < 32:
        raise ValueError("k must be from 1 to 31")
    rows = sequences.select(F.col(id_col).alias("id"), F.col(seq).alias("seq")).where("seq is not null")
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                s = b.column("seq")[i].as_py()
                for a in range(0, max(1, len(s) - k + 1), RUN):
                    codes, at, neg = kmers_of(s[a : a + RUN + k - 1], k, plain)
                    if len(codes):
                        ids = b.column("id").take(pa.array(np.full(len(codes), i, np.int64)))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(codes), pa.array(at + a), pa.array(neg)], ["id", "kmer", "pos", "neg"])

    return rows.mapInArrow(run, f"id {kind}, kmer long, pos long, neg boolean")


def turned(words: np.ndarray, k: int) -> np.ndarray:
    """The reverse complements of k-mers."""
    left, out = words.copy(), np.zeros_like(words)
    for _ in range(k):
        out = (out << 2) | (3 - (left & 3))
        left >>= 2
    return out


def forward_words(two: np.ndarray, k: int) -> np.ndarray:
    """The forward k-mers of letters (2 bits each), put together from shorter ones of twice the length each time."""
    words, width = two.astype(np.int64), 1
    for bit in bin(k)[3:]:
        words = (words[:-width] << (2 * width)) | words[width:]
        width *= 2
        if bit == "1":
            words = (words[:-1] << 2) | two[width : width + len(words) - 1]
            width += 1
    return words


class Sieve:
    """Looks up words in a set of canonical k-mers and their reverse complements: a table of bits by hash leaves few of the others."""

    def __init__(self, wanted: np.ndarray, k: int):
        self.words = np.unique(np.concatenate([wanted, turned(wanted, k)]))
        self.shift = np.uint64(64 - min(24, max(12, len(self.words).bit_length() + 4)))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[self.slot(self.words)] = True

    def slot(self, words: np.ndarray) -> np.ndarray:
        return ((words.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def held(self, words: np.ndarray) -> np.ndarray:
        """Places of the words that are in the set."""
        at = np.flatnonzero(self.table[self.slot(words)])
        if not len(at):
            return at
        place = np.minimum(np.searchsorted(self.words, words[at]), len(self.words) - 1)
        return at[self.words[place] == words[at]]


def sought(sequences: DataFrame, wanted: np.ndarray, k: int, id_col: str = "seq_id", seq: str = "seq") -> DataFrame:
    """The rows of ``kmers`` whose k-mer is in ``wanted`` (canonical ones, at most ``SMALL``): all sequences of a batch are read in a row, and no other k-mer leaves the task."""
    rows = sequences.select(F.col(id_col).alias("id"), F.col(seq).alias("seq")).where("seq is not null")
    kind, held = dict(rows.dtypes)["id"], rows.sparkSession.sparkContext.broadcast(np.asarray(wanted, np.int64))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(held.value):
            return
        sieve = Sieve(held.value, k)
        for b in batches:
            letters, ends = flat(characters(b.column("seq")))
            for first in range(0, max(0, len(letters) - k + 1), LOOK):
                codes = CODE[letters[first : first + LOOK + k - 1]]
                words = forward_words(codes & 3, k)
                at = sieve.held(words)
                row = np.searchsorted(ends, first + at, "right") - 1
                own = first + at + k <= ends[row + 1]
                if codes.max() == 255:  # letters that break a k-mer
                    breaks = np.concatenate([[0], np.cumsum(codes == 255)])
                    own &= breaks[at + k] == breaks[at]
                at, row = at[own], row[own]
                if len(at):
                    forward = words[at]
                    backward = turned(forward, k)
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), pa.array(np.minimum(forward, backward)), pa.array(first + at - ends[row].astype(np.int64)), pa.array(backward < forward)], ["id", "kmer", "pos", "neg"])

    return rows.mapInArrow(run, f"id {kind}, kmer long, pos long, neg boolean")


def rare(found: DataFrame, most: int) -> DataFrame:
    """The k-mers that occur at most ``most`` times; counts are aggregated before they meet the positions."""
    often = found.groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("kmer")
    return found.join(often, "kmer", "left_semi")


def hits(query: DataFrame, target: DataFrame) -> DataFrame:
    """``query_id, target_id, q_pos, t_pos, rc`` of every pair of equal canonical k-mers."""
    q = query.select("kmer", F.col("id").alias("query_id"), F.col("pos").alias("q_pos"), F.col("neg").alias("q_neg"))
    t = target.select("kmer", F.col("id").alias("target_id"), F.col("pos").alias("t_pos"), F.col("neg").alias("t_neg"))
    return q.join(t, "kmer").select("query_id", "target_id", "q_pos", "t_pos", (F.col("q_neg") != F.col("t_neg")).alias("rc"))


def extend(found: DataFrame, k: int, jump: int, least: int) -> DataFrame:
    """Blocks: hits on one diagonal, each at most ``jump`` query bases behind the one before; ``least`` bases long at least.

    Returns ``query_id, target_id, rc, q_start, t_start, len`` on the forward query strand.
    """
    diagonal = F.when(F.col("rc"), F.col("t_pos") + F.col("q_pos")).otherwise(F.col("t_pos") - F.col("q_pos"))
    keys = ["query_id", "target_id", "rc", "diagonal"]
    along = Window.partitionBy(*keys).orderBy("q_pos")
    gap = F.col("q_pos") - F.lag("q_pos").over(along)
    rows = found.withColumn("diagonal", diagonal).withColumn("new", F.when(gap <= jump, 0).otherwise(1))
    rows = rows.withColumn("block", F.sum("new").over(along))
    out = rows.groupBy(*keys, "block").agg(F.min("q_pos").alias("q_start"), F.min("t_pos").alias("t_start"), (F.max("q_pos") - F.min("q_pos") + k).alias("len"))
    return out.where(F.col("len") >= least).select("query_id", "target_id", "rc", "q_start", "t_start", "len")


def seed_blocks(query: DataFrame, target: DataFrame, k: int = 15, jump: int | None = None, least: int | None = None, most: int = 1) -> DataFrame:
    """Seeds of one k between two sets of sequences (seq_id, seq): k-mers that are rare on both sides, joined and extended."""
    q = stored(rare(kmers(query, k), most), "kmers")
    if q.count() <= SMALL:  # the target's other k-mers needn't leave their tasks, nor be counted
        t = stored(sought(target, q.select("kmer").toArrow()["kmer"].to_numpy(), k), "sought")
    else:
        t = stored(kmers(target, k), "kmers")  # read twice, encoded once
    t = rare(t, most)
    return extend(hits(q, t), k, k - 1 if jump is None else jump, k if least is None else least)


def seed_blocks_multi(query: DataFrame, target: DataFrame, ks: tuple[int, ...] = tuple(range(11, 32, 2)), least: int = 24, most: int = 1) -> DataFrame:
    """The union of the seeds of several k, with k as a column."""
    out = None
    for k in ks:
        one = seed_blocks(query, target, k, least=max(least, k), most=most).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def as_matches(blocks: DataFrame, query_sizes: DataFrame) -> DataFrame:
    """Blocks as matches: reverse ones on the reversed query, with the query's size (query_id, query_size)."""
    flipped = F.when(F.col("rc"), F.col("query_size") - F.col("len") - F.col("q_start")).otherwise(F.col("q_start"))
    return blocks.join(query_sizes, "query_id").select("target_id", "query_id", "query_size", "t_start", flipped.alias("q_start"), "len", "rc", F.lit(1.0).alias("prob"), F.lit(1.0).alias("ident"), F.col("len").cast("double").alias("matches"))


def spans(sequences: DataFrame, k: int, words: int, id_col: str = "seq_id", seq: str = "seq") -> tuple[DataFrame, list[str]]:
    """``id, pos`` and the code of the ``words`` words of ``k`` letters each that stand in a row there, forward strand; and the code's columns, with as many words each as a long holds."""
    if not 0 < k < 32:
        raise ValueError("k must be from 1 to 31")
    each = min(words, 31 // k)
    starts = list(range(0, words, each))
    names = [f"code{x}" for x in range(len(starts))]
    rows = sequences.select(F.col(id_col).alias("id"), F.col(seq).alias("seq")).where("seq is not null")
    kind, span = dict(rows.dtypes)["id"], k * words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                s = b.column("seq")[i].as_py()
                for a in range(0, max(1, len(s) - span + 1), RUN):
                    piece = s[a : a + RUN + span - 1]
                    found, valid = [], None
                    for first in starts:
                        n = k * min(each, words - first)
                        codes, at, _ = kmers_of(piece[first * k : len(piece) - span + first * k + n], n, True)
                        found.append((codes, at))
                        valid = at if valid is None else np.intersect1d(valid, at, assume_unique=True)
                    if valid is not None and len(valid):
                        ids = b.column("id").take(pa.array(np.full(len(valid), i, np.int64)))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(valid + a), *[pa.array(codes[np.searchsorted(at, valid)]) for codes, at in found]], ["id", "pos", *names])

    return rows.mapInArrow(run, f"id {kind}, pos long, " + ", ".join(f"{n} long" for n in names)), names


def word_lookup(query: DataFrame, target: DataFrame, k: int = 12, words: int = 2, most: int | None = None, ahead: int = 0) -> DataFrame:
    """Positions where ``words`` consecutive words of the query (each k letters) stand in a row in the target.

    ``query_id, q_pos, target_id, t_pos, offset``: a word may stand up to ``ahead``
    letters later in the target, by the same offset for all. The words of a place are looked up together,
    by one equal join: a frequent word costs nothing unless its neighbours stand with it. Words that the target has more than
    ``most`` times find nothing, if it is given. Forward strand.
    """
    (q, key), (t, _) = spans(query, k, words), spans(target, k, words)
    if most is not None:
        single = kmers_plain(target, k)
        often = stored(single.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > most).select("word"), "often")
        places = single.join(F.broadcast(often) if often.count() <= SMALL else often, "word", "left_semi")
        barred = places.select("id", F.explode(F.array(*[F.col("pos") - i * k for i in range(words)])).alias("pos")).distinct()
        t = t.join(barred, ["id", "pos"], "left_anti")
    t = wanted_only(t, q, key)
    starts = q.select(F.col("id").alias("query_id"), F.col("pos").alias("q_pos"), *key)
    both = starts.join(t.select(*key, F.col("id").alias("target_id"), F.col("pos").alias("t")), key)
    both = both.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(ahead)))) if ahead else both.withColumn("offset", F.lit(0))
    return both.select("query_id", "q_pos", "target_id", (F.col("t") - F.col("offset")).alias("t_pos"), "offset").where("t_pos >= 0")


def wanted_only(t: DataFrame, q: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``t`` whose key ``q`` has, if ``q`` has few enough to be broadcast: the others needn't be shuffled. All of them else."""
    wanted = stored(q.select(*key).distinct(), "wanted")
    return t.join(F.broadcast(wanted), key, "left_semi") if wanted.count() <= SMALL else t


def word_width(k: int, kind: str) -> int:
    """Letters that a word of ``word_codes`` spans."""
    return 2 * k - 1 if kind == "comb" else k


def word_codes(seq: str, k: int, kind: str = "exact") -> np.ndarray:
    """A number for every word of k letters, -1 where a letter has no code.

    ``exact``: base 4 on nucleotides; ``protein``: base 21 on amino acids; ``comb``:
    every second letter of 2k; the letters between may differ.
    """
    if kind == "protein":
        table = np.full(256, -1, np.int64)
        for i, c in enumerate(PROTEIN):
            table[ord(c)] = i
        base, offsets = 21, np.arange(k)
    else:
        table = np.where(CODE == 255, -1, CODE.astype(np.int64))
        base, offsets = 4, np.arange(k) * (2 if kind == "comb" else 1)
    codes = table[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    n = len(codes) - int(offsets[-1]) if len(codes) else 0
    if n < 1:
        return np.empty(0, np.int64)
    out, bad = np.zeros(n, np.int64), np.zeros(n, bool)
    for o in offsets:
        c = codes[o : o + n]
        out, bad = out * base + np.maximum(c, 0), bad | (c < 0)
    return np.where(bad, -1, out)


def coded_words(sequences: DataFrame, k: int, kind: str = "exact", id_col: str = "seq_id", seq: str = "seq") -> DataFrame:
    """``id, word, pos`` of every word of ``word_codes``, forward strand. Codes fit a long: k is at most 31 for nucleotides and combs, 14 for proteins."""
    if not 0 < k <= (14 if kind == "protein" else 31):
        raise ValueError("k is too large or too small")
    rows = sequences.select(F.col(id_col).alias("id"), F.col(seq).alias("seq")).where("seq is not null")
    kind_of_id, over = dict(rows.dtypes)["id"], word_width(k, kind) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                s = b.column("seq")[i].as_py()
                for a in range(0, max(1, len(s) - over), RUN):
                    codes = word_codes(s[a : a + RUN + over], k, kind)
                    at = np.flatnonzero(codes >= 0)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(np.full(len(at), i, np.int64))), pa.array(codes[at]), pa.array(at + a)], ["id", "word", "pos"])

    return rows.mapInArrow(run, f"id {kind_of_id}, word long, pos long")


def word_hits(query: DataFrame, target: DataFrame, k: int, kind: str = "exact", most: int | None = None) -> DataFrame:
    """``query_id, q_pos, target_id, t_pos`` of every pair of equal words; with ``most``, of those that stand at most so often on both sides."""
    q, t = coded_words(query, k, kind), coded_words(target, k, kind)
    if most is not None:
        few = lambda df: df.join(df.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("word"), "word", "left_semi")
        q = few(q)
    t = wanted_only(t, q, ["word"])
    t = t if most is None else few(t)
    return q.select("word", F.col("id").alias("query_id"), F.col("pos").alias("q_pos")).join(t.select("word", F.col("id").alias("target_id"), F.col("pos").alias("t_pos")), "word").drop("word")


def spaced_seeds(query: DataFrame, target: DataFrame, k: int = 12, kind: str = "comb", jump: int = 1, least: int = 0, most: int | None = None) -> DataFrame:
    """Blocks ``query_id, target_id, q_start, t_start, len`` of equal words of any kind, forward strand, each at most ``jump`` letters behind the one before on its diagonal. Letters between those of a comb may differ."""
    found = word_hits(query, target, k, kind, most).withColumn("rc", F.lit(False))
    return extend(found, word_width(k, kind), jump, least).select("query_id", "target_id", "q_start", "t_start", "len")


def lookahead_words(query: DataFrame, target: DataFrame, k: int = 12, words: int = 2, ahead: int = 3, kind: str = "exact") -> DataFrame:
    """``query_id, q_pos, target_id, t_pos, penalty``: places where each of ``words`` words in a row is met, itself or by a word up to ``ahead`` - 1 letters further on, on the same diagonal.

    So a differing letter in a word doesn't hide the place. ``penalty`` counts the words that are met
    by a later one only. Every word's place counts, however frequent.
    """
    width = word_width(k, kind)
    hits = word_hits(query, target, k, kind).withColumn("diagonal", F.col("t_pos") - F.col("q_pos"))
    keys = ["query_id", "target_id", "diagonal"]
    slots = hits.withColumn("late", F.explode(F.sequence(F.lit(0), F.lit(ahead - 1)))).withColumn("slot", F.col("q_pos") - F.col("late"))
    slots = slots.groupBy(*keys, "slot").agg(F.min("late").alias("late"))
    starts = slots.withColumn("q_pos", F.explode(F.array(*[F.col("slot") - i * width for i in range(words)])))
    sizes = query.select(F.col("seq_id").alias("query_id"), F.length("seq").alias("size"))
    met = starts.where("q_pos >= 0 and q_pos + diagonal >= 0").groupBy(*keys, "q_pos").agg(F.count("*").alias("n"), F.sum(F.when(F.col("late") > 0, 1).otherwise(0)).alias("penalty")).where(F.col("n") == words)
    return met.join(sizes, "query_id").where(F.col("q_pos") + words * width <= F.col("size")).select("query_id", "q_pos", "target_id", (F.col("q_pos") + F.col("diagonal")).alias("t_pos"), F.col("penalty").cast("long").alias("penalty"))


def kmers_plain(sequences: DataFrame, k: int, id_col: str = "seq_id", seq: str = "seq") -> DataFrame:
    """``id, word, pos`` on the forward strand only (the k-mer code, not made canonical)."""
    return kmers(sequences, k, id_col, seq, plain=True).select("id", F.col("kmer").alias("word"), "pos")


def unique_seeds(query: DataFrame, target: DataFrame, k: int = 12, words: int = 2, distance: int = 1) -> DataFrame:
    """Query positions (every ``distance``) whose words have exactly one place in the target, runs of +1 steps joined.

    Returns ``query_id, target_id, q_start, t_start, len``. The target's words are counted before
    they meet the query's, so that repeats of any number are never paired.
    """
    (q, key), (t, _) = spans(query, k, words), spans(target, k, words)
    place = F.struct(F.col("id").alias("target_id"), F.col("pos").alias("t_pos"))
    once = wanted_only(t, q, key).groupBy(*key).agg(F.count("*").alias("n"), F.min(place).alias("at")).where("n = 1").select(*key, "at.*")
    only = q.where(F.col("pos") % distance == 0).select(F.col("id").alias("query_id"), F.col("pos").alias("q_pos"), *key).join(once, key)
    blocks = extend(only.withColumn("rc", F.lit(False)).select("query_id", "target_id", "q_pos", "t_pos", "rc"), k * words, distance, 0)
    return blocks.select("query_id", "target_id", "q_start", "t_start", "len")
