"""Near-duplicates by ProbMinHash, banding and verification.

A document is the weighted set of its shingles of five words, each weighing as
often as it occurs. The similarity of two is the probability Jaccard similarity,
the sum over common shingles i of 1 / sum_j max(x_j / x_i, y_j / y_i); for
documents without repeated shingles it is the Jaccard similarity.

ProbMinHash: every shingle is a Poisson process of its weight's rate. Each
arrival picks one of ``BANDS * ROWS`` registers, which keeps the shingle of its
earliest arrival. A shingle's process ends once it is later than all registers
hold. Two documents agree in a register with the probability of their
similarity.

Texts with the same words are one node from then on. Nodes that agree in a band
share a bucket; each is compared with the bucket's centre, exactly, on the texts.
The centre is the member that meets most others in its buckets, so a base that
many copies derive from comes before the copies. A bucket whose members are not
of one component yet goes on: with further centres while they pay, then by the
pairs of different components that share a rare shingle (see ``meeting``). So
each pair of a bucket is compared, or connected, or too far apart by a bound on
its similarity. Classes are the components of the links that hold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colinear.llm.components import components
from colinear.session import fresh, stored, table, tidy

#: Words of a shingle, least similarity; bands and rows: 0.9995 of the pairs at 0.8 meet in a bucket.
SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 7
REGISTERS = BANDS * ROWS
#: Arrivals drawn at a time, at least.
DRAW = 1536
#: Pairs left for each row of a bucket up to which all are compared without a further centre.
FEW = 4
#: Rows up to which a table of keys is broadcast instead of shuffled against the texts.
SMALL = 500_000

PUNCTUATION = re.compile(r"[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f]+")
U = np.uint64
WORD_BYTE = np.array([chr(b).isalnum() or b >= 128 or chr(b) == "_" for b in range(256)])
BYTE_CODE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
BASE = U(0x9E3779B97F4A7C15)
#: Bytes of a text that are worked off at a time.
STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word, in order: runs of ASCII letters, digits and ``_`` and other characters but punctuation, in lower case."""
    t = text.lower()
    if not t.isascii():
        t = PUNCTUATION.sub(" ", t)
    b = np.frombuffer(t.encode(), np.uint8)
    out, at = [np.empty(0, np.uint64)], 0
    while at < len(b):
        to = min(len(b), at + STEP)
        while to < len(b) and WORD_BYTE[b[to]]:  # a word that is cut is read to its end
            more = np.flatnonzero(~WORD_BYTE[b[to : to + STEP]])
            to = to + int(more[0]) if len(more) else min(len(b), to + STEP)
        out.append(_hashes(b[at:to]))
        at = to
    return np.concatenate(out)


def _hashes(b: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = WORD_BYTE[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    size = end - start
    power = np.full(int(size.max()), BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    first = np.cumsum(size) - size
    letters = BYTE_CODE[b[inside[1:-1]]] * power[np.arange(int(size.sum())) - np.repeat(first, size)]
    return mix(np.add.reduceat(letters, first))


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their counts; fewer than five words are one shingle."""
    n = min(SHINGLE, len(words))
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * BASE + words[k : len(words) - n + 1 + k]
    return np.unique(mix(h), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard similarity of two weighted sets."""
    (ha, x), (hb, y) = a, b
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    only_a, only_b, cx, cy = x.sum() - x[ia].sum(), y.sum() - y[ib].sum(), x[ia].astype(float), y[ib].astype(float)
    out = 0.0
    ratio = cx / cy
    for t in np.unique(ratio):
        out += cx[ratio == t].sum() / (np.maximum(cx, t * cy).sum() + only_a + t * only_b)
    return float(out)


def signature(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The registers: the shingle of the earliest arrival of each."""
    first, owner = np.full(REGISTERS, np.inf), np.zeros(REGISTERS, np.uint64)
    live, rate, now, count = elements, 1.0 / weights, np.zeros(len(elements)), 0
    while len(live):
        step = max(1, DRAW // len(live))
        draws = mix(live[:, None] + (np.arange(count + 1, count + step + 1, dtype=np.uint64) * BASE)[None, :])
        count += step
        gaps = -np.log(((draws >> U(16)) + U(1)).astype(np.float64) * 2.0**-48)
        at = np.cumsum(gaps, axis=1) * rate[:, None] + now[:, None]
        register = (((draws & U(0xFFFF)) * U(REGISTERS)) >> U(16)).astype(np.int64)
        keep = at <= first.max()
        t, r = at[keep], register[keep]
        e = np.broadcast_to(live[:, None], at.shape)[keep]
        np.minimum.at(first, r, t)
        won = t == first[r]
        owner[r[won]] = e[won]
        now = at[:, -1]
        going = now < first.max()
        live, rate, now = live[going], rate[going], now[going]
    return owner


def band_hashes(owner: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in owner.reshape(BANDS, ROWS).T:
        h = mix(h * BASE + column)
    return h.view(np.int64)


def describe(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, th, node, bands``: the text's xxhash64, a 64-bit digest of its words, its band hashes. Without words: null node and bands."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th"))
    kind = dict(rows.dtypes)["id"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, bands, known = [], [], {}
            for t in b.column("text"):
                words = word_hashes(t.as_py()) if t.is_valid else np.empty(0, np.uint64)
                if not len(words):
                    nodes.append(None)
                    bands.append(None)
                    continue
                node = int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)
                if node not in known:
                    known[node] = band_hashes(signature(*shingles(words)))
                nodes.append(node)
                bands.append(known[node])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["id", "th", "node", "bands"])

    return rows.mapInArrow(run, f"id {kind}, th long, node long, bands array<long>")


def rank(id_: str = "id"):
    return F.struct(F.col(id_).isNull().alias("null_id"), F.col(id_).alias("id"), F.col("th"))


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """``df`` (stored, so counted cheaply), to be broadcast if it has few rows; a shuffle join else."""
    return F.broadcast(df) if df.count() <= SMALL else df


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, sim`` of pairs (a, b) of nodes: the similarity of their texts."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, other = None, None
        for batch in batches:
            out = []
            for b, ta, tb in zip(batch.column("b").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True):
                if b != held:
                    held, other = b, shingles(word_hashes(tb.as_py()))
                out.append(similarity(shingles(word_hashes(ta.as_py())), other))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "sim"])

    return both.mapInArrow(run, "a long, b long, sim double")


def left_open(members: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of ``members`` whose bucket holds several components of ``links``, with their ``root`` and the bucket's most frequent one, ``major``."""
    roots = stored(components(links), "roots")
    rooted = stored(members.drop("root", "major").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    counts = rooted.groupBy("band", "root").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("band").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    return stored(rooted.join(mixed.select("band", F.col("most.root").alias("major")), "band"), "open")


def pairs_left(rows: DataFrame) -> int:
    """Bound of the pairs that open buckets have yet: those of a node outside the major component with any other."""
    sizes = rows.groupBy("band").agg(F.count("*").alias("n"), F.count_if(F.col("root") != F.col("major")).alias("strays"))
    return int(sizes.agg(F.sum(F.col("n") * F.col("strays"))).first()[0] or 0)


def uncompared(pairs: DataFrame, checked: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that were not compared either way."""
    known = checked.select("a", "b").unionByName(checked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.select("a", "b").distinct().join(known, ["a", "b"], "left_anti")


def grams_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, gram, weight, size``: the shingles of the nodes' texts; size is the sum of a node's weights."""
    both = texts.join(nodes.select("node"), "node", "left_semi").select("node", "text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, t in zip(b.column("node").to_pylist(), b.column("text"), strict=True):
                gram, weight = shingles(word_hashes(t.as_py()))
                n = len(gram)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, node, np.int64)), pa.array(gram.view(np.int64)), pa.array(weight.astype(np.int32)), pa.array(np.full(n, weight.sum(), np.int32))], ["node", "gram", "weight", "size"])

    return both.mapInArrow(run, "node long, gram long, weight int, size int")


def meeting(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of nodes of different components that may be similar, for the rows of open buckets. No similar pair is left out.

    Every node's shingles are put in one global order, rare ones first. Where the
    first common shingle of two nodes comes after the weights p of P in one and q of
    Q in the other, at most 1 - p/P and 1 - q/Q of their weights are common. Common
    weights differ by no more than what repeated shingles add (``spare``). With
    shares c and d in common the similarity is at most c * d / (c + d - c * d). So
    nodes meet on a shingle near the head of both lists, and many nodes that each
    differ from a base by shingles of their own don't meet at all.
    """
    nodes = stored(rows.groupBy("node").agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("major")).alias("stray")), "nodes")
    grams = stored(grams_of(nodes, texts.dropDuplicates(["node"])), "grams")
    often = grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", F.col("n").cast("int").alias("n"))
    of = Window.partitionBy("node")
    upto = of.orderBy("n", "gram").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("size") - F.sum("weight").over(of) + F.sum("weight").over(upto) - F.col("weight")
    near = grams.join(often, "gram").withColumn("before", before).where(F.col("before") <= (1 - SIMILAR) * F.col("size") + 1e-6).select("node", "gram", "size", "before")
    spare = grams.groupBy("node").agg((F.first("size") - F.count("*")).alias("spare"))
    heads = stored(near.join(nodes.join(spare, "node"), "node"), "heads")
    one = heads.where("stray").select("gram", *[F.col(c).alias(f"a_{c}") for c in ("node", "root", "size", "spare", "before")])
    two = heads.select("gram", *[F.col(c).alias(f"b_{c}") for c in ("node", "root", "size", "spare", "before")])
    left = lambda x, y: F.least(F.col(f"{x}_size") - F.col(f"{x}_before"), F.col(f"{y}_size") - F.col(f"{y}_before") + F.col(f"{x}_spare")) / F.col(f"{x}_size")
    c, d = left("a", "b"), left("b", "a")
    met = one.join(two, (one["gram"] == two["gram"]) & (F.col("a_root") != F.col("b_root")) & (c * d >= (SIMILAR - 1e-9) * (c + d - c * d)))
    return met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def links_of(docs: DataFrame, nodes: DataFrame, id_col: str, text: str) -> DataFrame:
    """``a, b`` of the pairs of nodes that are similar: enough of them to connect each class. ``nodes``: node, head, bands."""
    rows = nodes.select("node", F.explode("bands").alias("band"))
    buckets = stored(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = stored(rows.join(buckets, "band"), "members")  # nodes in buckets with others only
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    members = stored(members.drop("n").join(weights, "node"), "weighed")
    heaviest = F.max(F.struct("weight", "node")).getField("node")
    pivots = stored(members.groupBy("band").agg(heaviest.alias("pivot")), "pivots")
    pairs = members.join(pivots, "band").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    wanted = stored(members.select("node").distinct().join(nodes.select("node", "head"), "node").select("node", "head.id", "head.th"), "wanted")
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("_th"))
    few = maybe_broadcast(wanted)
    texts = keyed.join(few, keyed["_id"].eqNullSafe(wanted["id"]) & (keyed["_th"] == wanted["th"])).select("node", "text")
    texts = stored(texts, "texts")
    # rows that repeat id and text give a node's text more than once; links are made distinct at the end
    checked = stored(verified(pairs, texts), "checked")
    similar = F.col("sim") >= SIMILAR - 1e-12
    rows = left_open(members, checked.where(similar))
    first, used, before = checked, pivots.select("band", F.col("pivot").alias("node")), None
    while (n := pairs_left(rows)) > FEW * rows.count() and (before is None or 2 * n <= before):
        before = n
        fresh = rows.where("root <> major").join(used, ["band", "node"], "left_anti")
        centres = stored(fresh.groupBy("band").agg(F.max(F.struct("weight", "node", "root")).alias("c")).select("band", F.col("c.node").alias("b"), F.col("c.root").alias("b_root")), "centres")
        met = rows.join(centres, "band").where("root <> b_root").select(F.col("node").alias("a"), "b")
        checked = stored(checked.unionByName(verified(stored(uncompared(met, checked), "more"), texts)), "checked")
        used = stored(used.unionByName(centres.select("band", F.col("b").alias("node"))), "used")
        rows = left_open(rows, checked.where(similar))
    if n:
        rest = stored(uncompared(meeting(rows, texts), checked), "rest")
        checked = checked.unionByName(verified(rest, texts))
    return checked.where(similar).select("a", "b").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id, th, node, head``; documents with one ``head`` are one class.

    ``th`` is the text's xxhash64, ``head`` a struct (null_id, id, th) of the class's
    document with the least id (null ids last, then by ``th``). Documents whose words
    are the same, whatever their case and punctuation, are one node and so one class.
    Null, empty and wordless texts are classes of their own, by id and text. Rows
    that repeat id and text are in one class. Nodes are 64-bit digests: of n different
    texts, about n**2 / 2**65 pairs would be taken for copies by chance.
    """
    described = stored(describe(docs, id_col, text), "described")
    worded = described.where("node is not null")
    nodes = stored(worded.groupBy("node").agg(F.min(rank()).alias("head"), F.first("bands").alias("bands")), "nodes")
    roots = stored(components(links_of(docs, nodes, id_col, text)), "roots")
    rooted = nodes.select("node", F.col("head").alias("own")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = rooted.groupBy("root").agg(F.min("own").alias("head"))
    by_node = rooted.select("node", "root").join(heads, "root").select("node", "head")
    found = worded.select("id", "th", "node").join(by_node, "node").select("id", "th", "node", "head")
    alone = described.where("node is null").select("id", "th", "node", rank().alias("head"))
    return found.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that head their class: one document of each class; of rows that repeat id and text, one."""
    found = stored(classes(docs, id_col, text), "classes")
    th, key_id, key_th = fresh(docs, "th", "key_id", "key_th")
    keys = found.select(F.col("id").alias(key_id), F.col("th").alias(key_th), F.col("head"))
    away = stored(keys.where(~F.struct("head.id", "head.th").eqNullSafe(F.struct(key_id, key_th))).select(key_id, key_th).distinct(), "away")
    twice = stored(keys.groupBy(key_id, key_th).agg(F.count("*").alias("n")).where("n > 1").select(key_id, key_th), "twice")
    keyed = docs.withColumn(th, F.xxhash64(F.col(text)))

    def against(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
        return rows.join(maybe_broadcast(other), rows[id_col].eqNullSafe(other[key_id]) & (rows[th] == other[key_th]), how)

    kept = against(keyed, away, "left_anti")
    if not twice.isEmpty():
        kept = against(kept, twice, "left_anti").unionByName(against(kept, twice, "left_semi").dropDuplicates([id_col, th]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("head.id").alias("class_id"), "node")
