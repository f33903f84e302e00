"""Exact top-k inner-product search by ball trees, one for each shard.

Vectors are dealt into shards by hash. Each shard becomes one row: its vectors
and a ball tree over them (centre and radius of every node). Shards grow with the
number of vectors, up to a bound of bytes, so that queries meet few trees. Queries are dealt
in blocks, which are packed once a round, and blocks have a home shard. The blocks that go to a shard follow its tree in one stream, so a tree
travels once, however many they are. A block descends the tree level by level: a
node with centre c and radius r holds no inner product above q.c + |q| r, and is
left out once that is below the query's kth score. Leaves are visited in order of
their bounds. The kth score is shared in rounds: every block first searches its
home shard, then 1, 2, 4, ... further ones, each round from the kth score of all
that were searched before.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colinear.session import cut, partitions, table

#: Vectors of a shard (more where a core would have several shards), queries of a block and vectors of a leaf.
SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 16384, 1024, 64
#: Bytes of a shard's vectors.
SHARD_BYTES = 32 << 20
#: Inner products below this are exact in double precision.
EXACT = float(2**53)


def pack(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for a in arrays:
        np.save(out, a, allow_pickle=False)
    return out.getvalue()


def unpack(blob: bytes, n: int) -> list[np.ndarray]:
    f = io.BytesIO(blob)
    return [np.load(f, allow_pickle=False) for _ in range(n)]


def as_matrix(rows: list[list[int]]) -> np.ndarray:
    """Rows of integers as a matrix; shorter ones end in zeros."""
    d = max(map(len, rows), default=0)
    m = np.zeros((len(rows), d), np.int64)
    for i, r in enumerate(rows):
        m[i, : len(r)] = r
    return m


def build(vectors: np.ndarray) -> tuple[np.ndarray, ...]:
    """(order of rows, centres, radii, first row, last row, left child, right child) of a ball tree over integer rows."""
    x = vectors.astype(np.float64)
    order = np.arange(len(x))
    centres, radii, lo, hi, left, right = [], [], [], [], [], []

    def node(a: int, b: int) -> int:
        k, part = len(centres), x[order[a:b]]
        c = part.mean(axis=0)
        d = np.sqrt(((part - c) ** 2).sum(axis=1))
        centres.append(c)
        radii.append(float(d.max()) * (1 + 1e-9) + 1e-6)
        lo.append(a)
        hi.append(b)
        left.append(-1)
        right.append(-1)
        return k

    todo = [node(0, len(x))] if len(x) else []
    while todo:
        k = todo.pop()
        a, b = lo[k], hi[k]
        if b - a <= LEAF_ROWS:
            continue
        part = x[order[a:b]]
        far = part[((part - centres[k]) ** 2).sum(axis=1).argmax()]
        other = part[((part - far) ** 2).sum(axis=1).argmax()]
        order[a:b] = order[a:b][np.argsort(part @ (other - far), kind="stable")]
        mid = (a + b) // 2
        left[k], right[k] = node(a, mid), node(mid, b)
        todo += [left[k], right[k]]
    as_int = lambda v: np.array(v, np.int64)
    return order, np.array(centres).reshape(len(centres), x.shape[1]), np.array(radii), as_int(lo), as_int(hi), as_int(left), as_int(right)


def widen(a: np.ndarray, d: int) -> np.ndarray:
    return a if a.shape[1] == d else np.pad(a, ((0, 0), (0, d - a.shape[1])))


def below(score: float) -> float:
    """At most the integer that was rounded to ``score``, and above the next smaller one where doubles can tell."""
    return score - abs(score) * 1e-15


class Best:
    """The k best (score, id) of each query of a block, ties to the smaller id."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floor = k, floors.astype(np.float64).copy()
        self.scores: list[np.ndarray] = [np.empty(0, np.int64) for _ in floors]
        self.ids: list[np.ndarray] = [np.empty(0, np.int64) for _ in floors]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.floor[q]
        if not keep.any():
            return
        s, i = np.concatenate([self.scores[q], scores[keep]]), np.concatenate([self.ids[q], ids[keep]])
        if len(s) > self.k:
            first = np.lexsort((i, -s))[: self.k]
            s, i = s[first], i[first]
        self.scores[q], self.ids[q] = s, i
        if len(s) == self.k:
            self.floor[q] = max(self.floor[q], below(float(s.min())))


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and b; beyond 63 bits they stop at the type's ends."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**62:
        return a @ b.T
    wide = a.astype(object) @ b.astype(object).T
    return np.vectorize(lambda v: max(-(2**63), min(2**63 - 1, int(v))), otypes=[np.int64])(wide)


def search(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, shard: tuple[np.ndarray, ...], k: int) -> Best:
    """The k best rows of a shard for each query, none of them below the query's floor or the query's own."""
    ids, vectors, order, centres, radii, lo, hi, left, right = shard
    d = max(q.shape[1], vectors.shape[1])
    q, vectors, centres = widen(q, d), widen(vectors, d), widen(centres, d)
    best = Best(floors, k)
    if not len(ids) or not len(q_ids):
        return best
    qf = q.astype(np.float64)
    norms = np.sqrt((qf**2).sum(axis=1))
    # Descend level by level: bounds are products of blocks, queries by the nodes that the floors leave.
    nodes, live = np.zeros(1, np.int64), np.ones((len(q_ids), 1), bool)
    leaf_q, leaf_n, leaf_b = [], [], []
    while len(nodes):
        bound = qf @ centres[nodes].T + norms[:, None] * radii[nodes][None, :]
        bound += 1e-6 + 1e-9 * np.abs(bound)
        live &= bound >= best.floor[:, None]
        leaf = left[nodes] < 0
        at_q, at_n = np.nonzero(live & leaf[None, :])
        leaf_q.append(at_q)
        leaf_n.append(nodes[at_n])
        leaf_b.append(bound[at_q, at_n])
        go = ~leaf & live.any(axis=0)
        nodes, live = np.stack([left[nodes[go]], right[nodes[go]]], axis=1).ravel(), np.repeat(live[:, go], 2, axis=1)
    lq, ln, lb = np.concatenate(leaf_q), np.concatenate(leaf_n), np.concatenate(leaf_b)
    by = np.lexsort((ln, -lb, lq))
    lq, ln, lb = lq[by], ln[by], lb[by]
    starts = np.searchsorted(lq, np.arange(len(q_ids)))
    turn = np.arange(len(lq)) - starts[lq]  # a query's leaves, best bound first
    done, width = 0, 1
    while len(lq):
        wave = (turn >= done) & (turn < done + width) & (lb >= best.floor[lq])
        wq, wn = lq[wave], ln[wave]
        for n in np.unique(wn):
            at = wq[wn == n]
            rows = order[lo[n] : hi[n]]
            scores = exact_products(q[at], vectors[rows])
            for j, i in enumerate(at):
                own = ids[rows] != q_ids[i]
                best.add(i, scores[j][own], ids[rows][own])
        done, width = done + width, width * 2
        if not (turn >= done).any():
            break
    return best


def shard_rows(rows: int, dims: int, cores: int) -> int:
    """Vectors of a shard: ``SHARD_ROWS``, or what makes a shard for each core, if that is more; at most ``SHARD_BYTES``."""
    return max(1, min(max(SHARD_ROWS, -(-rows // cores)), SHARD_BYTES // (8 * max(dims, 1))))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "vector") -> DataFrame:
    """The k highest integer inner products of each query with all rows but its own.

    ``vectors`` and ``queries`` have an id and an array of long. Returns
    ``query_id, rank, vec_id, score``; ties go to the smaller id; fewer than k
    where there are fewer rows. Products beyond 63 bits count as the type's ends. Rows with a null id, a null or empty vector or a
    null component take no part. A shorter vector counts as if it ended in zeros.
    Rows with the query's id are its own; a query that comes repeatedly counts
    once (the least vector, if they differ); repeated candidates count each time.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<long>").alias("v")).where("id is not null and size(v) > 0 and not exists(v, x -> x is null)")
    rows, asked = cut(clean(vectors)), clean(queries).groupBy("id").agg(F.min("v").alias("v"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    cores = max(partitions(spark), spark.sparkContext.defaultParallelism)
    shards = max(1, -(-size["n"] // shard_rows(size["n"], size["d"], cores)))

    def pack_shard(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        m = as_matrix(t.column("v").to_pylist())
        ids = t.column("id").to_numpy()
        by = np.lexsort((*m.T[::-1], ids)) if m.shape[1] < 32 else np.argsort(ids, kind="stable")
        ids, m = ids[by], m[by]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([pack(ids, m, *build(m))], pa.binary())], ["shard", "tree"])

    # Shards hold a bounded number of rows: ids by hash, and the rows of a repeated id by their place in the partition.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    trees = cut(dealt.groupBy("shard").applyInArrow(pack_shard, "shard int, tree binary"))

    def pack_block(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).sort_by("id")
        blob = pack(t.column("id").to_numpy(), as_matrix(t.column("v").to_pylist()), t.column("floor").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([blob], pa.binary())], ["group", "queries"])

    def hunt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: tuple = ()
        for b in batches:
            for tree, blob in zip(b.column("tree"), b.column("queries"), strict=True):
                if tree.is_valid:  # comes before the blocks of its shard
                    shard = tuple(unpack(tree.as_py(), 9))
                    continue
                q_ids, q, floors = unpack(blob.as_py(), 3)
                best = search(q_ids, q, floors, shard, k)
                size = [len(x) for x in best.ids]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, size)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], ["query_id", "vec_id", "score"])

    def round_of(asked: DataFrame, offsets: range) -> DataFrame:
        """Each block against the shards that lie ``offsets`` behind its home shard."""
        group = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n_asked // BLOCK_ROWS))))
        packed = asked.withColumn("group", group).groupBy("group").applyInArrow(pack_block, "group long, queries binary")
        lane, home = F.pmod("group", F.lit(lanes)).cast("int"), F.pmod(F.xxhash64("group", F.lit(1)), F.lit(shards))
        places = F.transform(F.sequence(F.lit(offsets.start), F.lit(offsets.stop - 1)), lambda o: F.pmod(home + o, F.lit(shards)).cast("int"))
        asking = packed.select(F.explode(places).alias("shard"), lane.alias("lane"), F.lit(None).cast("binary").alias("tree"), "queries")
        told = trees.select("shard", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), "tree", F.lit(None).cast("binary").alias("queries"))
        dealt = told.unionByName(asking).repartition(min(shards * lanes, 20 * cores), "shard", "lane")
        return dealt.sortWithinPartitions("shard", "lane", F.col("tree").isNull()).select("tree", "queries").mapInArrow(hunt, "query_id long, vec_id long, score long")

    asked = cut(asked)
    n_asked = asked.count()
    lanes = max(1, min(-(-n_asked // BLOCK_ROWS), cores // shards))  # copies of a shard's tree, where shards are fewer than cores
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    asked, done, found = asked.withColumn("floor", F.lit(float("-inf"))), 0, None
    while done < shards:
        stop = min(shards, max(1, 2 * done))
        fresh = round_of(asked, range(done, stop))
        fresh = fresh if found is None else found.drop("rank").unionByName(fresh)
        found = cut(fresh.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth"))
        asked, done = asked.drop("floor").join(kth, "id", "left").withColumn("floor", F.coalesce(F.col("kth") - F.abs("kth") * 1e-15, F.lit(float("-inf")))).drop("kth"), stop
        asked = cut(asked) if done < shards else asked
    return found


def quantised(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """``id_col, vector``: floor(scale * x) of every component as long. Rows with a null or non-finite component have a null vector."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).alias("vec_id"), F.when(~bad, F.transform(v, lambda x: F.floor(x * scale))).alias("vector"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where("vec_id % 100 = 0"), k=10)


ORACLE = {
    "op10_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
}
