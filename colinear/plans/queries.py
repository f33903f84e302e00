"""Queries over the driver's tables, one or more for each operator, with their SQL.

Sequences are texts read as nucleotides (letters a-z in turn ACGT): ``documents``
are the targets, ``benchmark`` the queries. Matches are rows of ``lineitem`` read as
intervals. Every query runs over whole tables.
"""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.functions import scoring
from colinear.functions import sequence as S
from colinear.operators import blocks, grid, intervals, matches, overlaps, ranking, scaffold, seeds, tiles
from colinear.session import added, table
from colinear.sources import sequences as fasta
from colinear.sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


FOLD = "regexp_replace(translate(lower({t}), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', '', 'g')"
DOCS = f"docs AS (SELECT doc_id AS seq_id, {FOLD.format(t='text')} AS seq FROM documents)"
ITEMS = f"items AS (SELECT item_id AS seq_id, {FOLD.format(t='text')} AS seq FROM benchmark)"
RC = "reverse(translate({s}, 'ACGT', 'TGCA'))"
M = """m AS (
  SELECT target_id, query_id, 200000::BIGINT AS query_size, t_start, q_start, len, rc, max(prob) AS prob, max(ident) AS ident FROM (
    SELECT l_suppkey % 20 AS target_id, l_partkey % 25 AS query_id, (l_orderkey * 37 + l_linenumber * 11) % 150000 AS t_start,
           ((l_orderkey * 37 + l_linenumber * 11) % 150000 + (l_partkey % 25) * 40 + l_quantity::BIGINT % 3) % 180000 AS q_start,
           30 + l_quantity::BIGINT AS len, l_returnflag = 'R' AS rc, 1 - l_tax AS prob, 0.5::DOUBLE + l_discount * 5 AS ident
    FROM lineitem) GROUP BY ALL)"""
SUM = M + """, f AS (SELECT *, CASE WHEN rc THEN query_size - len - q_start ELSE q_start END AS q_from FROM m),
s AS (SELECT 't' || target_id AS t_name, t_start, t_start + len AS t_end, 'q' || query_id AS q_name, q_from AS q_start, q_from + len AS q_end, ident, CASE WHEN rc THEN '-' ELSE '+' END AS ori FROM f)"""


def docs(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """The documents as sequences. ``only``, if given, names the ones that are asked for (one column): the others don't go to Python."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), "text")
    return added(rows if only is None else tiles.named(rows, only), "seq string", lambda t: [S.folded(t)], ["text"], ["seq_id"])


def docs_size(spark: SparkSession, d: str) -> int:
    """The letters of all documents: counted where they are folded, so that no letters come back from Python."""
    sizes = added(table(spark, d, "documents").select("text"), "size int", lambda t: [pc.binary_length(S.folded(t))], ["text"], [])
    return sizes.agg(F.sum("size")).first()[0] or 0


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("seq_id"), S.fold(F.col("text")).alias("seq"))


def lineitem_matches(spark: SparkSession, d: str) -> DataFrame:
    place = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 150000
    rows = table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("target_id"), (F.col("l_partkey") % 25).alias("query_id"), F.lit(200000).cast("long").alias("query_size"), place.alias("t_start"),
        ((place + (F.col("l_partkey") % 25) * 40 + F.col("l_quantity").cast("long") % 3) % 180000).alias("q_start"),
        (F.col("l_quantity").cast("long") + 30).alias("len"), (F.col("l_returnflag") == "R").alias("rc"), (1 - F.col("l_tax")).alias("prob"), (F.lit(0.5) + F.col("l_discount") * 5).alias("ident"),
    )
    return rows.groupBy("target_id", "query_id", "query_size", "t_start", "q_start", "len", "rc").agg(F.max("prob").alias("prob"), F.max("ident").alias("ident"))


def summary_of(spark: SparkSession, d: str) -> DataFrame:
    return matches.summary(lineitem_matches(spark, d))


# Sequences


@query(f"WITH {DOCS} SELECT seq_id, seq, {RC.format(s='seq')} AS rc FROM docs")
def revcomp(spark, d):
    return docs(spark, d).select("seq_id", "seq", S.revcomp(F.col("seq")).alias("rc"))


_count = lambda b: f"(length(seq) - length(replace(seq, '{b}', '')))::BIGINT"


@query(f"WITH {DOCS} SELECT seq_id, " + ", ".join(f"{_count(b)} AS n_{b.lower()}" for b in "ACGT") + ", CASE WHEN length(seq) > 0 THEN (length(seq) - length(translate(seq, 'GC', '')))::DOUBLE / length(seq) END AS gc FROM docs")
def base_composition(spark, d):
    return docs(spark, d).select("seq_id", *[S.count_of(F.col("seq"), b).alias(f"n_{b.lower()}") for b in "ACGT"], S.gc_content(F.col("seq")).alias("gc"))


@query("SELECT doc_id AS seq_id, (length(upper(text)) - length(translate(upper(text), 'NX', '')))::BIGINT AS n, translate(text, '-.', '') AS ungapped, length(translate(upper(text), 'NX', '')) = 0 AS all_n FROM documents")
def n_count(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), S.n_count(F.upper(t)).alias("n"), S.remove_gaps(t).alias("ungapped"), (S.n_count(F.upper(t)) == F.length(t)).alias("all_n"))


@query(
    f"""WITH {DOCS}, t AS (SELECT seq_id, seq AS s, 1 AS sign FROM docs UNION ALL SELECT seq_id, {RC.format(s="seq")}, -1 FROM docs), f AS (SELECT unnest([0, 1, 2]) AS f)
SELECT seq_id, sign * (f + 1) AS frame, substr(s, f + 1, greatest(((length(s) - f) // 3) * 3, 0)) AS seq FROM t, f"""
)
def six_frames(spark, d):
    return docs(spark, d).select("seq_id", F.explode(S.frames(F.col("seq"))).alias("f")).select("seq_id", "f.frame", "f.seq")


@query(
    f"""WITH {ITEMS}, c AS (SELECT seq_id, i, substr(seq, 3 * i + 1, 3) AS c FROM items, unnest(range(length(seq) // 3)) AS r(i)),
a AS (SELECT seq_id, i, substr('{S.AMINO}', (strpos('TCAG', substr(c, 1, 1)) - 1) * 16 + (strpos('TCAG', substr(c, 2, 1)) - 1) * 4 + strpos('TCAG', substr(c, 3, 1)), 1) AS a FROM c)
SELECT seq_id, string_agg(a, '' ORDER BY i) AS protein FROM a GROUP BY seq_id"""
)
def translate_codons(spark, d):
    return items(spark, d).select("seq_id", S.translate_codons(F.col("seq")).alias("protein"))


@query(
    f"""WITH {ITEMS}, p AS (SELECT i, bit_or(1 << (strpos('ACGT', substr(seq, i + 1, 1)) - 1)) AS bits, count(*) AS n FROM items, unnest(range(length(seq))) AS r(i) GROUP BY i)
SELECT i::INTEGER AS pos, n, substr('-ACMGRSVTWYHKDBN', bits::INTEGER + 1, 1) AS code FROM p"""
)
def ambiguity_code(spark, d):
    rows = items(spark, d).select(F.posexplode(F.filter(F.split("seq", ""), lambda x: x != "")).alias("pos", "c"))
    return rows.groupBy("pos").agg(F.count("*").alias("n"), F.bit_or(S.base_bits(F.col("c"))).alias("bits")).select("pos", "n", S.ambiguity_code(F.col("bits")).alias("code"))


_codes = "(VALUES " + ", ".join(f"('{c}', " + ", ".join(str(1 / len(b) if x in b else 0.0) + "::DOUBLE" for x in "ACGT") + ")" for c, b in S.IUPAC.items()) + ") AS codes(c, a, g1, g2, g3)"


_code_of = "upper(regexp_replace({t}, '[^ACGTRYKMSWBDHVNXacgtrykmswbdhvnx]', '', 'g'))"


@query(
    f"""WITH k AS (SELECT * FROM {_codes}), e AS (SELECT x.c AS c1, y.c AS c2, x.a*y.a + x.g1*y.g1 + x.g2*y.g2 + x.g3*y.g3 AS e FROM k x, k y),
t AS (SELECT {_code_of.format(t="d.text")} AS a, {_code_of.format(t="b.text")} AS b FROM documents AS d JOIN benchmark AS b ON d.doc_id % 40 = b.item_id % 40),
p AS (SELECT substr(a, i, 1) AS c1, substr(b, i, 1) AS c2, count(*) AS n FROM t, LATERAL (SELECT unnest(range(1, least(length(a), length(b)) + 1)) AS i) GROUP BY ALL)
SELECT c1, c2, n, e AS same, CASE WHEN c1 = c2 AND c1 NOT IN ('N', 'X') THEN 1.0 ELSE e END::DOUBLE AS same_amb, CASE WHEN e > 0.26 THEN least(e + 0.2, 1.0) ELSE e END::DOUBLE AS same_emph, 1 - e AS diff,
 CASE WHEN c1 IN ('A','C','G','T') THEN c1 WHEN c2 IN ('A','C','G','T') THEN c2 ELSE c1 END AS resolved FROM p JOIN e USING (c1, c2)"""
)
def code_similarity(spark, d):
    """Letters of documents and items at the same places, read as codes: how often each pair meets, and its scores."""
    code = lambda t: F.upper(F.regexp_replace(t, "[^ACGTRYKMSWBDHVNXacgtrykmswbdhvnx]", ""))
    x = table(spark, d, "documents").select((F.col("doc_id") % 40).alias("g"), code("text").alias("a"))
    y = table(spark, d, "benchmark").select((F.col("item_id") % 40).alias("g"), code("text").alias("b"))
    letters = lambda c: F.split(c, "")
    both = x.join(F.broadcast(y) if y.count() <= 10_000 else y, "g").withColumn("n", F.least(F.length("a"), F.length("b"))).where("n > 0")
    pairs = both.select(F.explode(F.arrays_zip(letters(F.substr("a", F.lit(1), F.col("n"))).alias("c1"), letters(F.substr("b", F.lit(1), F.col("n"))).alias("c2"))).alias("p")).groupBy("p.c1", "p.c2").agg(F.count("*").alias("n")).where("c1 <> ''")
    a, b = F.col("c1"), F.col("c2")
    return pairs.select("c1", "c2", "n", S.equal(a, b).alias("same"), S.equal_ambiguous(a, b).alias("same_amb"), S.equal_emphasised(a, b).alias("same_emph"), S.differ(a, b).alias("diff"), S.resolve(a, b).alias("resolved"))


@query(
    f"""WITH {DOCS}, n AS (SELECT *, greatest({", ".join(_count(b) for b in "ACGT")}) AS most FROM docs)
SELECT seq_id, length(seq) > 0 AND most >= length(seq) * 0.4 AS homopolymer, length(seq) > 0 AND length(replace(seq, seq[1], '')) = 0 AS simple FROM n"""
)
def complexity(spark, d):
    return docs(spark, d).select("seq_id", S.homopolymer(F.col("seq"), 0.4).alias("homopolymer"), S.low_complexity(F.col("seq")).alias("simple"))


@query(
    f"""WITH {ITEMS}, p AS (SELECT a.seq_id, a.seq AS x, b.seq AS y, least(length(a.seq), length(b.seq)) AS n FROM items a JOIN items b ON b.seq_id = a.seq_id + 1)
SELECT seq_id, len(list_filter(range(n), lambda i: x[i + 1] = y[i + 1]))::DOUBLE / n AS ident FROM p WHERE n > 0"""
)
def pair_identity(spark, d):
    a = items(spark, d)
    b = a.select((F.col("seq_id") - 1).alias("seq_id"), F.col("seq").alias("other"))
    return a.join(b, "seq_id").select("seq_id", S.identity(F.col("seq"), F.col("other")).alias("ident")).where("ident is not null")


@query(
    f"""WITH {DOCS}, c AS (SELECT seq_id, unnest(range(0, length(seq) // 384 + 1)) AS chunk, seq, length(seq) AS l FROM docs WHERE length(seq) >= 6)
SELECT seq_id, chunk, chunk * 384 AS start, least(l, (chunk + 1) * 384 + 128) AS "end", false AS all_n, substr(seq, chunk * 384 + 1, least(l, (chunk + 1) * 384 + 128) - chunk * 384) AS seq FROM c WHERE least(l, (chunk + 1) * 384 + 128) > chunk * 384"""
)
def chunks(spark, d):
    return grid.chunks(docs(spark, d), 512, 128)


@query(
    """WITH l AS (SELECT doc_id, regexp_extract_all(translate(lower(text), 'n', 'N'), '(N+|[^N]+)', 1) AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM l),
e AS (SELECT doc_id, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM u)
SELECT doc_id AS seq_id, e - length(x) AS start, e AS "end" FROM e WHERE x LIKE 'N%'"""
)
def n_runs(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.lower("text").alias("seq"))
    return fasta.n_gaps(rows, "n").withColumnRenamed("name", "seq_id")


# Seeds


def _kmers(src: str, k: int) -> str:
    f = f"substr(seq, p + 1, {k})"
    return f"(SELECT seq_id, p, least({f}, {RC.format(s=f)}) AS kmer, {RC.format(s=f)} < {f} AS neg FROM {src}, LATERAL (SELECT unnest(range(greatest(length(seq) - {k - 1}, 0))) AS p))"


def _blocks(q: str, t: str, k: int, most: int, least: int, extra: str = "") -> str:
    return f"""q AS {_kmers(q, k)}, t AS {_kmers(t, k)},
qr AS (SELECT kmer FROM q GROUP BY kmer HAVING count(*) <= {most}), tr AS (SELECT kmer FROM t GROUP BY kmer HAVING count(*) <= {most}),
h AS (SELECT q.seq_id AS query_id, t.seq_id AS target_id, q.p AS q_pos, t.p AS t_pos, q.neg <> t.neg AS rc FROM q JOIN t USING (kmer) WHERE kmer IN (SELECT kmer FROM qr) AND kmer IN (SELECT kmer FROM tr)),
g AS (SELECT *, CASE WHEN rc THEN t_pos + q_pos ELSE t_pos - q_pos END AS diag FROM h),
b AS (SELECT *, CASE WHEN q_pos - lag(q_pos) OVER w <= {k - 1} THEN 0 ELSE 1 END AS new FROM g WINDOW w AS (PARTITION BY query_id, target_id, rc, diag ORDER BY q_pos)),
i AS (SELECT *, sum(new) OVER (PARTITION BY query_id, target_id, rc, diag ORDER BY q_pos) AS blk FROM b)
SELECT query_id, target_id, rc, min(q_pos) AS q_start, min(t_pos) AS t_start, (max(q_pos) - min(q_pos) + {k})::BIGINT AS len{extra} FROM i GROUP BY query_id, target_id, rc, diag, blk HAVING max(q_pos) - min(q_pos) + {k} >= {least}"""


@query(f"WITH {DOCS}, {ITEMS}, " + _blocks("items", "docs", 15, 4, 15))
def seed_blocks(spark, d):
    return seeds.seed_blocks(items(spark, d), docs(spark, d), 15, most=4)


@query(f"WITH {ITEMS}, q AS {_kmers('items', 11)}, c AS (SELECT kmer, count(*) AS n FROM q GROUP BY kmer) SELECT n, count(*) AS kmers FROM c GROUP BY n")
def kmer_counts(spark, d):
    return seeds.kmers(items(spark, d), 11).groupBy("kmer").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("kmers"))


@query(f"WITH {ITEMS}, q AS {_kmers('items', 13)} SELECT seq_id AS id, p AS pos, neg FROM q WHERE kmer IN (SELECT kmer FROM q GROUP BY kmer HAVING count(*) <= 1)")
def kmer_rare(spark, d):
    return seeds.rare(seeds.kmers(items(spark, d), 13), 1).select("id", "pos", "neg")


@query(f"WITH {ITEMS}, q AS {_kmers('items', 15)} SELECT a.seq_id AS query_id, b.seq_id AS target_id, a.p AS q_pos, b.p AS t_pos, a.neg <> b.neg AS rc FROM q a JOIN q b USING (kmer)")
def seed_hits_self(spark, d):
    k = seeds.kmers(items(spark, d), 15)
    return seeds.hits(k, k)


_multi = " UNION ALL ".join(f"SELECT * FROM (WITH {_blocks('items', 'items', k, 4, 24, f', {k} AS k')})" for k in (15, 19, 23))


@query(f"WITH {ITEMS} {_multi}")
def seed_blocks_multi(spark, d):
    a = items(spark, d)
    return seeds.seed_blocks_multi(a, a, (15, 19, 23), most=4)


def _words(src: str, k: int) -> str:
    return f"(SELECT seq_id, p, substr(seq, p + 1, {k}) AS word FROM {src}, LATERAL (SELECT unnest(range(greatest(length(seq) - {k - 1}, 0))) AS p))"


_lookup = f"""w AS {_words("items", 12)}, s AS (SELECT seq_id, p - 12 * i AS q_pos, i, word FROM w, unnest([0, 1]) AS r(i) WHERE p - 12 * i >= 0),
h AS (SELECT s.seq_id AS query_id, s.q_pos, w.seq_id AS target_id, w.p - 12 * s.i AS t_pos FROM s JOIN w USING (word) WHERE w.p - 12 * s.i >= 0),
l AS (SELECT query_id, q_pos, target_id, t_pos FROM h GROUP BY ALL HAVING count(*) = 2)"""


@query(f"WITH {ITEMS}, {_lookup} SELECT *, 0 AS \"offset\" FROM l")
def word_lookup(spark, d):
    a = items(spark, d)
    return seeds.word_lookup(a, a, 12, 2)


@query(
    f"""WITH {ITEMS}, {_lookup}, u AS (SELECT query_id, q_pos, min(target_id) AS target_id, min(t_pos) AS t_pos FROM l GROUP BY query_id, q_pos HAVING count(*) = 1),
b AS (SELECT *, CASE WHEN q_pos - lag(q_pos) OVER (PARTITION BY query_id, target_id, t_pos - q_pos ORDER BY q_pos) <= 1 THEN 0 ELSE 1 END AS new FROM u),
i AS (SELECT *, sum(new) OVER (PARTITION BY query_id, target_id, t_pos - q_pos ORDER BY q_pos) AS blk FROM b)
SELECT query_id, target_id, min(q_pos) AS q_start, min(t_pos) AS t_start, (max(q_pos) - min(q_pos) + 24)::BIGINT AS len FROM i GROUP BY query_id, target_id, t_pos - q_pos, blk"""
)
def unique_seeds(spark, d):
    a = items(spark, d)
    return seeds.unique_seeds(a, a, 12, 2)


_comb = """w AS (SELECT seq_id, p, list_aggregate([substr(seq, p + 1 + 2 * i, 1) for i in range(12)], 'string_agg', '') AS word FROM items, LATERAL (SELECT unnest(range(greatest(length(seq) - 22, 0))) AS p)),
h AS (SELECT a.seq_id AS query_id, b.seq_id AS target_id, a.p AS q_pos, b.p AS t_pos FROM w a JOIN w b USING (word)),
b AS (SELECT *, CASE WHEN q_pos - lag(q_pos) OVER (PARTITION BY query_id, target_id, t_pos - q_pos ORDER BY q_pos) <= 1 THEN 0 ELSE 1 END AS new FROM h),
i AS (SELECT *, sum(new) OVER (PARTITION BY query_id, target_id, t_pos - q_pos ORDER BY q_pos) AS blk FROM b)"""


@query(f"WITH {ITEMS}, {_comb} SELECT query_id, target_id, min(q_pos) AS q_start, min(t_pos) AS t_start, (max(q_pos) - min(q_pos) + 23)::BIGINT AS len FROM i GROUP BY query_id, target_id, t_pos - q_pos, blk")
def comb_seeds(spark, d):
    a = items(spark, d)
    return seeds.spaced_seeds(a, a, 12, "comb")


@query(
    f"""WITH {ITEMS}, w AS {_words("items", 8)}, h AS (SELECT a.seq_id AS query_id, b.seq_id AS target_id, a.p AS q, b.p - a.p AS diagonal FROM w a JOIN w b USING (word)),
s AS (SELECT query_id, target_id, diagonal, q - l AS slot, min(l) AS late FROM h, unnest([0, 1, 2]) AS r(l) GROUP BY ALL),
m AS (SELECT query_id, target_id, diagonal, slot - 8 * i AS q_pos, count(*) AS n, sum(CASE WHEN late > 0 THEN 1 ELSE 0 END) AS penalty FROM s, unnest([0, 1, 2]) AS r(i) GROUP BY ALL)
SELECT query_id, q_pos, target_id, q_pos + diagonal AS t_pos, penalty::BIGINT AS penalty FROM m JOIN items ON seq_id = query_id WHERE n = 3 AND q_pos >= 0 AND q_pos + diagonal >= 0 AND q_pos + 24 <= length(seq)"""
)
def lookahead_words(spark, d):
    a = items(spark, d)
    return seeds.lookahead_words(a, a, 8, 3, 3)


_bit = "(1 << (strpos('ACGT', {c}) - 1))"


@query(
    f"""WITH {ITEMS}, p AS (SELECT seq_id * 1000 + i AS id, substr(seq, i * 40 + 1, 64) AS seq FROM items, LATERAL (SELECT unnest(range(length(seq) // 40 + 1)) AS i)),
x AS (SELECT id, CASE WHEN id % 3 = 0 AND length(seq) > 50 THEN substr(seq, 1, 49) || translate(substr(seq, 50, 1), 'ACGT', 'CATG') || substr(seq, 51) ELSE seq END AS seq FROM p WHERE length(seq) >= 16),
c AS (SELECT a.id AS a_id, b.id AS b_id, n AS overlap, hamming(right(a.seq, n), left(b.seq, n)) AS differences, a.seq AS a_seq, b.seq AS b_seq FROM x a JOIN x b ON a.id <> b.id, LATERAL (SELECT unnest(range(16, least(length(a.seq), length(b.seq), 40) + 1)) AS n)),
g AS (SELECT * FROM c WHERE differences <= floor((1 - 0.95::DOUBLE) * overlap + 0.5) QUALIFY row_number() OVER (PARTITION BY a_id, b_id ORDER BY overlap DESC) = 1),
u AS (SELECT *, right(a_seq, overlap) AS s, left(b_seq, overlap) AS t FROM g)
SELECT a_id, b_id, overlap::INTEGER AS overlap, differences::INTEGER AS differences, left(a_seq, length(a_seq) - overlap) || list_aggregate([CASE WHEN s[i] = t[i] THEN s[i] ELSE substr('-ACMGRSVTWYHKDBN', ({_bit.format(c="s[i]")} | {_bit.format(c="t[i]")})::INTEGER + 1, 1) END for i in range(1, overlap + 1)], 'string_agg', '') || substr(b_seq, overlap + 1) AS seq FROM u"""
)
def overlap_merges(spark, d):
    """Items cut into overlapping pieces, a letter of every third one changed, and joined again."""
    cut = items(spark, d).select((F.col("seq_id") * 1000).alias("base"), "seq", F.explode(F.sequence(F.lit(0), F.floor(F.length("seq") / 40).cast("int"))).alias("i"))
    pieces = cut.select((F.col("base") + F.col("i")).alias("seq_id"), S.slice_clamped(F.col("seq"), F.col("i") * 40, F.lit(64)).alias("seq")).where("length(seq) >= 16")
    changed = F.concat(F.substring("seq", 1, 49), F.translate(F.substring("seq", 50, 1), "ACGT", "CATG"), F.substr("seq", F.lit(51)))
    pieces = pieces.withColumn("seq", F.when((F.col("seq_id") % 3 == 0) & (F.length("seq") > 50), changed).otherwise(F.col("seq")))
    return overlaps.overlap_merges(pieces, pieces, 16, 40, 0.95)


# Matches


@query(
    f"""WITH {M}, a AS (SELECT *, row_number() OVER w AS rn, CASE WHEN abs(t_start - lag(t_start) OVER w) < 4 AND abs(q_start - lag(q_start) OVER w) < 4 THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY target_id, query_id, rc ORDER BY t_start, len, q_start)),
b AS (SELECT *, sum(new) OVER (PARTITION BY target_id, query_id, rc ORDER BY rn) AS island FROM a),
c AS (SELECT *, min(q_start) OVER (PARTITION BY target_id, query_id, rc, island ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM b)
SELECT target_id, query_id, rc, arg_min(t_start, rn) AS t_start, min(q_start) AS q_start, arg_max(q_start + len, CASE WHEN least IS NULL OR q_start >= least THEN rn END) - min(q_start) AS len, count(*) AS members FROM c GROUP BY target_id, query_id, rc, island"""
)
def collapse(spark, d):
    return matches.collapse(lineitem_matches(spark, d))


@query(f"WITH {M} SELECT * FROM m WHERE len >= 60 AND prob > 0.95")
def length_filter(spark, d):
    return matches.at_least(lineitem_matches(spark, d), 60, 0.95)


@query(f"WITH {M} SELECT *, row_number() OVER (ORDER BY target_id, query_id, rc, t_start, len, q_start) - 1 AS place FROM m")
def match_order(spark, d):
    from colinear.operators.ranking import global_rank

    return global_rank(lineitem_matches(spark, d), matches.ORDER)[0].withColumnRenamed("_rank", "place")


@query(f"WITH {SUM} SELECT * FROM s")
def summary(spark, d):
    return summary_of(spark, d)


@query(f"WITH {SUM} SELECT q_name AS t_name, q_start AS t_start, q_end AS t_end, t_name AS q_name, t_start AS q_start, t_end AS q_end, ident, ori FROM s")
def reverse_summary(spark, d):
    return matches.swapped(summary_of(spark, d))


@query(f"WITH {M} SELECT * FROM m WHERE NOT (target_id = query_id AND NOT rc AND t_start = q_start) AND t_start + len <= 140000 AND q_start + len <= query_size")
def bounds_and_self(spark, d):
    return matches.without_self(matches.within_bounds(lineitem_matches(spark, d), F.lit(140000)))


@query(f"WITH {M} SELECT target_id, query_id, count(*) AS n, sum(len)::BIGINT AS bases FROM (SELECT target_id, query_id, len FROM m UNION ALL SELECT target_id + 20, query_id + 25, len FROM m) GROUP BY ALL")
def append_sets(spark, d):
    a = lineitem_matches(spark, d)
    return matches.append(a, a, 20, 25).groupBy("target_id", "query_id").agg(F.count("*").alias("n"), F.sum("len").alias("bases"))


@query(f"WITH {M} SELECT count(*) AS n, sum(len)::BIGINT AS total, median(len)::DOUBLE AS median_len, median(ident) AS median_ident FROM m")
def summary_stats(spark, d):
    return matches.statistics(lineitem_matches(spark, d))


@query(f"WITH {M}, c AS (SELECT target_id, query_id, count(*) AS hits, max(CASE WHEN len > 20 THEN t_start END) AS last FROM m GROUP BY ALL) SELECT target_id, query_id, hits, last FROM c QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY hits DESC, query_id) = 1")
def best_query(spark, d):
    return matches.best_query(lineitem_matches(spark, d))


@query(f"WITH {M} SELECT target_id, query_id, t_start // 20000 AS bucket, count(*) AS hits FROM m GROUP BY ALL")
def hit_histogram(spark, d):
    return matches.hit_histogram(lineitem_matches(spark, d), 20_000)


@query(f"WITH {M} SELECT target_id, query_id, rc, t_start, len, q_start, ntile(7) OVER (ORDER BY target_id, query_id, rc, t_start, len, q_start)::INTEGER AS file FROM m")
def split_files(spark, d):
    return matches.split_into(lineitem_matches(spark, d), 7, matches.ORDER).select(*matches.ORDER, "file")


@query(
    f"""WITH {M}, a AS (SELECT *, t_start - lag(t_start) OVER w AS dt, q_start - lag(q_start) OVER w AS dq, lag(t_start + len) OVER w AS bef, row_number() OVER w AS rn FROM m WINDOW w AS (PARTITION BY target_id, query_id, rc ORDER BY t_start, len, q_start)),
b AS (SELECT *, sum(CASE WHEN dt < 50000 AND dq < 50000 AND dq > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY target_id, query_id, rc ORDER BY rn) AS run, coalesce(dt < 50000 AND dq < 50000 AND dq > 0 AND t_start >= bef AND dt > 0, false) AS c FROM a),
r AS (SELECT target_id, query_id, rc, sum(c::INTEGER)::BIGINT AS n, avg(CASE WHEN c THEN atan(dq / dt) END) AS angle, arg_min(t_start, rn) AS t0, arg_min(q_start, rn) AS q0, arg_max(t_start, rn) AS t1, arg_max(q_start, rn) AS q1 FROM b GROUP BY target_id, query_id, rc, run HAVING sum(c::INTEGER) >= 40)
SELECT target_id, query_id, rc, CASE WHEN s < 0 THEN t0 ELSE t1 END + s * j * 100000 AS t_start, CASE WHEN s < 0 THEN q0 ELSE q1 END + round(s * j * 100000 * tan(angle))::BIGINT AS q_start, n + 50 AS len, 0.999::DOUBLE AS prob, 0.999::DOUBLE AS ident
FROM r, unnest([-1, 1]) AS x(s), unnest([1, 2]) AS y(j)"""
)
def interpolate(spark, d):
    return matches.synthetic_neighbours(lineitem_matches(spark, d))


@query(f"WITH {SUM}, n AS (SELECT *, row_number() OVER (ORDER BY t_name, t_start, t_end, q_name, q_start, q_end, ori, ident) - 1 AS i FROM s) SELECT concat_ws(chr(9), t_name, 'colinear', 'block', t_start + 1, t_end, '', ori, '.', 'ID=sblock_' || i || ';Name=' || q_name || ':' || (q_start + 1) || '-' || q_end) AS value FROM n")
def gff_export(spark, d):
    return tables.gff(summary_of(spark, d))


@query(f"WITH {SUM} SELECT printf('%s\t%d\t%d\t%s\t%d\t%d\t%f\t%s', t_name, t_start, t_end, q_name, q_start, q_end, ident, ori) AS value FROM s")
def summary_export(spark, d):
    return tables.summary_lines(summary_of(spark, d))


@query(f"WITH {SUM} SELECT printf('QUERY %s %d %d %s %s %d %d %f', q_name, q_start, q_end, ori, t_name, t_start, t_end, ident) AS value FROM s")
def qlt_export(spark, d):
    return tables.qlt(summary_of(spark, d))


# Intervals

_EV = "e AS (SELECT seq, pos, sum(dl)::BIGINT AS dl FROM (SELECT seq, s AS pos, 1 AS dl FROM iv WHERE e > s UNION ALL SELECT seq, e, -1 FROM iv WHERE e > s) GROUP BY ALL), sg AS (SELECT seq, pos AS s, lead(pos) OVER w AS e, sum(dl) OVER w AS d FROM e WINDOW w AS (PARTITION BY seq ORDER BY pos))"
_IV = M + ", iv AS (SELECT target_id AS seq, t_start AS s, t_start + len AS e FROM m), " + _EV


def _spans(spark, d) -> DataFrame:
    return lineitem_matches(spark, d).select(F.col("target_id").alias("seq"), F.col("t_start").alias("start"), (F.col("t_start") + F.col("len")).alias("end"))


@query(f'WITH {_IV} SELECT seq, s AS start, e AS "end", d::BIGINT AS depth FROM sg WHERE d > 0')
def depth_segments(spark, d):
    return intervals.depth(_spans(spark, d))


@query(f"WITH {_IV} SELECT seq, sum(e - s)::BIGINT AS covered, sum((e - s) * least(d, 100))::BIGINT AS depth_sum FROM sg WHERE d > 0 GROUP BY seq")
def coverage_stats(spark, d):
    return intervals.coverage(_spans(spark, d))


_MERGED = "mg AS (SELECT *, sum(CASE WHEN pe = s AND pd = d THEN 0 ELSE 1 END) OVER (PARTITION BY seq ORDER BY s) AS run FROM (SELECT *, lag(e) OVER w AS pe, lag(d) OVER w AS pd FROM sg WHERE d > 0 WINDOW w AS (PARTITION BY seq ORDER BY s)))"


@query(f'WITH {_IV}, {_MERGED} SELECT seq, min(s) AS start, max(e) AS "end" FROM mg GROUP BY seq, run HAVING min(d) = 1')
def unique_regions(spark, d):
    return intervals.unique_regions(_spans(spark, d))


@query(
    f"""WITH {M}, x AS (SELECT target_id AS seq, t_start AS s, t_start + len AS e, (NOT rc)::INTEGER AS a, rc::INTEGER AS b FROM m),
v AS (SELECT seq, pos, sum(a) AS a, sum(b) AS b FROM (SELECT seq, s AS pos, a, b FROM x UNION ALL SELECT seq, e, -a, -b FROM x) GROUP BY ALL),
w AS (SELECT seq, sum(a) OVER o AS da, sum(b) OVER o AS db, lead(pos) OVER o - pos AS size FROM v WINDOW o AS (PARTITION BY seq ORDER BY pos))
SELECT seq, coalesce(sum(CASE WHEN da = 0 AND db > 0 THEN size END), 0)::BIGINT AS gained, coalesce(sum(CASE WHEN da > 0 AND db = 0 THEN size END), 0)::BIGINT AS lost FROM w GROUP BY seq"""
)
def coverage_delta(spark, d):
    m = lineitem_matches(spark, d).select("rc", F.col("target_id").alias("seq"), F.col("t_start").alias("start"), (F.col("t_start") + F.col("len")).alias("end"))
    return intervals.coverage_delta(m.where("not rc"), m.where("rc"))


@query(f"WITH {M}, iv AS (SELECT target_id AS seq, t_start AS s, t_start + len AS e FROM m WHERE ident >= 0.8), {_EV} SELECT seq, sum(e - s)::BIGINT AS covered FROM sg WHERE d > 0 GROUP BY seq")
def coverage_at_identity(spark, d):
    m = lineitem_matches(spark, d).where("ident >= 0.8").select(F.col("target_id").alias("seq"), F.col("t_start").alias("start"), (F.col("t_start") + F.col("len")).alias("end"))
    return intervals.coverage(m).select("seq", "covered")


@query(
    """WITH f AS (SELECT d.source AS seq, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS type, d.doc_id * 100 AS s, d.doc_id * 100 + least(d.n_chars, 5000) AS e FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT source AS seq, doc_id * 100 + 50 AS s, doc_id * 100 + 50 + n_chars // 10 AS e FROM documents),
z AS (SELECT source AS seq, 0::BIGINT AS s, max(doc_id) * 100 + 6000 AS e FROM documents GROUP BY source),
u AS (SELECT seq, type, s, e FROM f UNION ALL SELECT seq, '', s, e FROM c UNION ALL SELECT seq, '*', s, e FROM z),
v AS (SELECT seq, type, s AS pos, 1 AS dl FROM u WHERE e > s UNION ALL SELECT seq, type, e, -1 FROM u WHERE e > s),
w AS (SELECT seq, pos, sum(CASE WHEN type = '' THEN dl ELSE 0 END) AS c, sum(CASE WHEN type = '*' THEN dl ELSE 0 END) AS z, sum(CASE WHEN type = 'good' THEN dl ELSE 0 END) AS g, sum(CASE WHEN type = 'poor' THEN dl ELSE 0 END) AS p, sum(CASE WHEN type = 'toxic' THEN dl ELSE 0 END) AS t FROM v GROUP BY ALL),
x AS (SELECT lead(pos) OVER o - pos AS size, sum(c) OVER o > 0 AS c, sum(z) OVER o > 0 AS z, sum(g) OVER o > 0 AS g, sum(p) OVER o > 0 AS p, sum(t) OVER o > 0 AS t FROM w WINDOW o AS (PARTITION BY seq ORDER BY pos)),
y AS (SELECT 'good' AS type, size, c FROM x WHERE z AND g UNION ALL SELECT 'poor', size, c FROM x WHERE z AND p UNION ALL SELECT 'toxic', size, c FROM x WHERE z AND t UNION ALL SELECT 'None', size, c FROM x WHERE z AND NOT g AND NOT p AND NOT t)
SELECT type, sum(size)::BIGINT AS bases, coalesce(sum(CASE WHEN c THEN size END), 0)::BIGINT AS covered, coalesce(sum(CASE WHEN c THEN size END), 0)::DOUBLE / sum(size) AS share FROM y GROUP BY type"""
)
def feature_coverage(spark, d):
    documents = table(spark, d, "documents")
    both = table(spark, d, "labels").join(documents, "doc_id")
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    at = F.col("doc_id") * 100
    features = both.select(F.col("source").alias("seq"), kind.alias("type"), at.alias("start"), (at + F.least(F.col("n_chars"), F.lit(5000))).alias("end"))
    covered = documents.select(F.col("source").alias("seq"), (at + 50).alias("start"), (at + 50 + F.floor(F.col("n_chars") / 10)).alias("end"))
    sizes = documents.groupBy(F.col("source").alias("seq")).agg((F.max("doc_id") * 100 + 6000).alias("size"))
    return intervals.feature_coverage(features, sizes, covered)


@query(
    f"""WITH {_IV}, p AS (SELECT target_id, query_id, rc, t_start, q_start, len, t_start + len // 2 AS pos FROM m), x AS (SELECT p.*, coalesce(sg.d, 0)::BIGINT AS depth FROM p ASOF LEFT JOIN sg ON p.target_id = sg.seq AND p.pos >= sg.s)
SELECT target_id, query_id, rc, t_start, q_start, len, depth, CASE WHEN depth <= 1 THEN 10 WHEN depth = 2 THEN 5 WHEN depth = 3 THEN 2.5 WHEN depth = 4 THEN 1.2 WHEN depth = 5 THEN 0.5 WHEN depth = 6 THEN 0.001 ELSE 0.000001 END::DOUBLE AS rep FROM x"""
)
def midpoint_depth(spark, d):
    m = lineitem_matches(spark, d)
    key = F.struct("query_id", "rc", "t_start", "q_start", "len")
    points = m.select(key.alias("id"), F.col("target_id").alias("seq"), (F.col("t_start") + F.floor(F.col("len") / 2)).alias("pos"))
    found = intervals.depth_at(points, _spans(spark, d))
    return found.select(F.col("seq").alias("target_id"), "id.query_id", "id.rc", "id.t_start", "id.q_start", "id.len", "depth", scoring.repeat_score(F.col("depth")).alias("rep"))


@query(
    f"""WITH {M}, a AS (SELECT *, lag(t_start + len) OVER w AS pe, lag(q_start) OVER w < q_start AS up FROM m WINDOW w AS (PARTITION BY target_id, query_id, rc ORDER BY t_start, len, q_start)),
iv AS (SELECT target_id AS seq, CASE WHEN up THEN greatest(t_start, pe) ELSE t_start END AS s, t_start + len AS e FROM a) SELECT seq, s AS start, e AS "end" FROM iv WHERE e > s"""
)
def trimmed_intervals(spark, d):
    return intervals.trimmed(lineitem_matches(spark, d))


@query("SELECT user_id, count(*) AS runs, max(n) AS longest FROM (SELECT user_id, run, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM (SELECT user_id, event_id, epoch(ts)::BIGINT AS t, CASE WHEN epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT, event_id) <= 86400 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL) GROUP BY user_id")
def event_islands(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("t", F.round(F.col("us") / 1e6).cast("long"))
    e = e.withColumn("new", F.when(F.col("t") - F.lag("t").over(w) <= 86400, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return e.groupBy("user_id", "run").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


# Grid

_PX = M + """, px AS (SELECT *, CASE WHEN t_start // 3072 > 0 AND t_start % 3072 < 1024 THEN t_start // 3072 - 1 ELSE t_start // 3072 END AS x, q_start // 4096 AS y, floor(100 * ident * len)::BIGINT AS weight FROM m),
done AS (SELECT DISTINCT x, y FROM px WHERE len >= 79),
own AS (SELECT x, y, max(weight) AS weight FROM px GROUP BY ALL),
wt AS (SELECT x, y, max(weight) AS weight FROM (SELECT * FROM own UNION ALL SELECT x + i, y + j, weight FROM own SEMI JOIN done USING (x, y), unnest([-1, 0, 1]) AS a(i), unnest([-1, 0, 1]) AS b(j) WHERE (i <> 0 OR j <> 0) AND x + i >= 0 AND y + j >= 0) GROUP BY ALL)"""


def _px(spark, d):
    px = grid.pixels(lineitem_matches(spark, d))
    return px, px.where("len >= 79").select("x", "y").distinct()


@query(f"WITH {_PX} SELECT * FROM wt")
def grid_weights(spark, d):
    return grid.weights(*_px(spark, d))


@query(f"WITH {_PX} SELECT * FROM wt ANTI JOIN done USING (x, y) WHERE weight > 0 ORDER BY weight DESC, x, y LIMIT 50")
def grid_topk(spark, d):
    px, done = _px(spark, d)
    return grid.top_pixels(grid.weights(px, done), done, 50)


@query(f"WITH {_PX} SELECT 'target' AS axis, x AS chunk, sum(len)::BIGINT AS bases FROM px GROUP BY x UNION ALL SELECT 'query', y, sum(len)::BIGINT FROM px GROUP BY y")
def occupancy(spark, d):
    return grid.occupancy(_px(spark, d)[0])


_LINES = """ax AS (SELECT source AS seq, doc_id // 20 AS chunk, CASE WHEN n_chars > 900 THEN 0 ELSE n_chars END AS bases FROM documents),
fr AS (SELECT *, (bases = 0)::INTEGER AS free FROM ax), ru AS (SELECT *, sum(CASE WHEN pf = free THEN 0 ELSE 1 END) OVER (PARTITION BY seq ORDER BY chunk) AS run FROM (SELECT *, lag(free) OVER (PARTITION BY seq ORDER BY chunk) AS pf FROM fr)),
st AS (SELECT seq, min(chunk) AS first, max(chunk) AS last FROM ru WHERE free = 1 GROUP BY seq, run)"""


@query(
    f"""WITH {_LINES}, t AS (SELECT *, row_number() OVER (ORDER BY last - first DESC, seq, first) AS line FROM st WHERE last - first + 1 >= 4 QUALIFY rank() OVER (ORDER BY last - first DESC) <= 20), q AS (SELECT *, row_number() OVER (ORDER BY last - first DESC, seq, first) AS line FROM st QUALIFY rank() OVER (ORDER BY last - first DESC) <= 20)
SELECT line::INTEGER AS line, t.seq AS target_id, t.first AS t_first, t.last AS t_last, q.seq AS query_id, q.first AS q_first, q.last AS q_last FROM t JOIN q USING (line)"""
)
def seed_lines(spark, d):
    axis = table(spark, d, "documents").select(F.col("source").alias("seq"), F.floor(F.col("doc_id") / 20).alias("chunk"), F.when(F.col("n_chars") > 900, 0).otherwise(F.col("n_chars")).alias("bases"))
    return grid.seed_lines(axis, axis, 20)


@query(f"WITH {_PX}, r AS (SELECT x, y FROM own) SELECT count(*) AS pairs, sum(t * 1000 + q)::BIGINT AS mark FROM r, LATERAL (SELECT unnest(range(x, x + 2)) AS t), LATERAL (SELECT unnest(range(y, y + 3)) AS q)")
def chunk_pairs(spark, d):
    px, _ = _px(spark, d)
    tasks = px.select("x", "y").distinct().select(F.col("x").alias("t_first"), (F.col("x") + 1).alias("t_last"), F.col("y").alias("q_first"), (F.col("y") + 2).alias("q_last"))
    return grid.chunk_pairs(tasks).agg(F.count("*").alias("pairs"), F.sum(F.col("t_chunk") * 1000 + F.col("q_chunk")).alias("mark"))


@query("SELECT a.name, a.i, b.i AS j FROM (SELECT source AS name, doc_id // 20 AS i FROM documents) a JOIN (SELECT source AS name, doc_id // 20 AS i FROM documents) b ON a.name = b.name AND abs(a.i - b.i) <= 3")
def banded_pairs(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("name"), F.floor(F.col("doc_id") / 20).alias("i"))
    return grid.banded_pairs(rows, rows, 3)


# Gaps, scores, scaffolds, plots


@query(
    f"""WITH {SUM}, g AS (SELECT *, lead(t_start) OVER w AS nt, lead(q_start) OVER w AS nqs, lead(q_end) OVER w AS nqe FROM s WINDOW w AS (PARTITION BY t_name, q_name, ori ORDER BY t_start, t_end, q_start, q_end)),
h AS (SELECT t_name, t_end AS t_from, nt AS t_to, q_name, CASE WHEN ori = '+' THEN q_end ELSE nqe END AS q_from, CASE WHEN ori = '+' THEN nqs ELSE q_start END AS q_to, ori FROM g)
SELECT * FROM h WHERE t_to - t_from BETWEEN 1 AND 15000 AND q_to - q_from BETWEEN 1 AND 15000"""
)
def gap_regions(spark, d):
    return blocks.gap_regions(summary_of(spark, d))


@query(
    f"""WITH {M}, g AS (SELECT target_id, query_id, rc, greatest(lag(t_start + len) OVER w - 32, 0) AS t_from, t_start + 32 AS t_to, greatest(lag(q_start + len) OVER w - 32, 0) AS q_from, q_start + 32 AS q_to, row_number() OVER w AS rn FROM m WINDOW w AS (PARTITION BY target_id, query_id, rc ORDER BY t_start, len, q_start)),
h AS (SELECT * FROM g WHERE rn > 1 AND t_to - t_from BETWEEN 84 AND 100000 AND q_to - q_from BETWEEN 84 AND 100000), p AS (SELECT *, unnest(range(0, greatest(ceil((t_to - t_from - 4096) / 2048)::BIGINT, 0) + 1)) AS piece FROM h)
SELECT target_id, query_id, rc, piece, t_from + piece * 2048 AS t_from, least(t_to, t_from + piece * 2048 + 4096) AS t_to, q_from, q_to FROM p"""
)
def guide_chunks(spark, d):
    m = lineitem_matches(spark, d)
    return blocks.guide_chunks(m)


@query(
    f"""WITH {M}, a AS (SELECT *, t_start - lag(t_start + len) OVER w AS dt, q_start - lag(q_start + len) OVER w AS dq, row_number() OVER w AS rn FROM m WINDOW w AS (PARTITION BY target_id, query_id, rc ORDER BY t_start, len, q_start)),
b AS (SELECT *, sum(CASE WHEN dt <= 1000 AND abs(dq) <= 1000 THEN 0 ELSE 1 END) OVER (PARTITION BY target_id, query_id, rc ORDER BY rn) AS g FROM a)
SELECT target_id, query_id, rc, min(t_start) AS t_start, max(t_start + len) AS t_end, min(q_start) AS q_start, max(q_start + len) AS q_end, count(*) AS n FROM b GROUP BY target_id, query_id, rc, g"""
)
def seed_groups(spark, d):
    return blocks.seed_groups(lineitem_matches(spark, d))


_Z = scoring.z_for(0.99999, 150000.0 * 20)


@query(f"WITH {M}, z AS (SELECT *, (0.3 * len) AS gq, (0.4 * len) AS gt FROM m), y AS (SELECT *, ((gq/len)*(gt/len) + (1-gq/len)*(1-gt/len))/2 AS p FROM z) SELECT target_id, query_id, rc, t_start, q_start, len FROM y WHERE (ident*len - p*len)/sqrt(p*(1-p)*len) >= {_Z!r}::DOUBLE")
def probability_filter(spark, d):
    m = lineitem_matches(spark, d)
    n = F.col("len")
    p = scoring.expected_share(0.3 * n, 0.4 * n, n)
    return m.where(scoring.z_score(F.col("ident") * n, n, p) >= _Z).select("target_id", "query_id", "rc", "t_start", "q_start", "len")


_T, _ABS = "(1 / (1 + abs(z / sqrt(2)) / 2))", "abs(z / sqrt(2))"
_UPPER = f"{_T} * exp({' + '.join(f'({c!r}) * pow({_T}, {k})' for k, c in enumerate(scoring.ERFC))} - {_ABS} * {_ABS})"


@query(
    f"""WITH {M}, y AS (SELECT *, (0.3 * 0.4 + 0.7 * 0.6)::DOUBLE / 2 AS p FROM m), x AS (SELECT *, (ident * len - p * len) / sqrt(p * (1 - p) * len) AS z FROM y),
t AS (SELECT *, (CASE WHEN z >= 0 THEN {_UPPER} ELSE 2 - {_UPPER} END) / 2 AS tail FROM x)
SELECT target_id, query_id, rc, t_start, q_start, len, round(z, 6) AS z, round(tail, 9) AS tail, round(exp(-tail * 3000000), 9) AS prob FROM t"""
)
def match_probabilities(spark, d):
    """The probability of every match, from its identity and length and the GC shares of both sides."""
    n = F.col("len").cast("double")
    m = lineitem_matches(spark, d).withColumn("z", scoring.z_score(F.col("ident") * n, n, scoring.expected_share(0.3 * n, 0.4 * n, n)))
    tail, prob = scoring.normal_tail(F.col("z")), scoring.match_probabilities(F.col("z"), 3_000_000.0)
    return m.select("target_id", "query_id", "rc", "t_start", "q_start", "len", F.round("z", 6).alias("z"), F.round(tail, 9).alias("tail"), F.round(prob, 9).alias("prob"))


_GUMBEL = ", ".join(f"1 - exp(-exp(-({r}) * (len - {u}))) AS p_{k.lower() or 'base'}" for k, (r, u) in scoring.GUMBEL.items())


@query(f"WITH {M} SELECT len, max(-200 * ln(prob)) AS penalty, {', '.join('max(' + x.replace(' AS ', ') AS ') for x in _GUMBEL.split(', '))} FROM m GROUP BY len")
def score_values(spark, d):
    n = F.col("len").cast("double")
    return lineitem_matches(spark, d).groupBy("len").agg(F.max(scoring.match_penalty(F.col("prob"))).alias("penalty"), *[F.max(scoring.gumbel_p(n, k)).alias(f"p_{k.lower() or 'base'}") for k in scoring.GUMBEL])


@query(
    f"""WITH {M}, a AS (SELECT *, t_start - lag(t_start) OVER w AS dt, q_start - lag(q_start) OVER w AS dq, lag(query_id) OVER w <> query_id AS oq, lag(rc) OVER w <> rc AS os FROM m WINDOW w AS (PARTITION BY target_id ORDER BY t_start, query_id, rc, len, q_start))
SELECT target_id, t_start, query_id, rc, len, q_start, CASE WHEN oq THEN 150 WHEN os THEN 20 WHEN abs(dq - dt) = 1 THEN 0 ELSE least(40, abs(dq - dt) / greatest(abs(dt), 300) + 0.01) END::DOUBLE AS cost FROM a WHERE dt IS NOT NULL"""
)
def transition_costs(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("target_id").orderBy("t_start", "query_id", "rc", "len", "q_start")
    m = lineitem_matches(spark, d).withColumns({"dt": F.col("t_start") - F.lag("t_start").over(w), "dq": F.col("q_start") - F.lag("q_start").over(w), "oq": F.lag("query_id").over(w) != F.col("query_id"), "os": F.lag("rc").over(w) != F.col("rc")})
    return m.where("dt is not null").select("target_id", "t_start", "query_id", "rc", "len", "q_start", scoring.transition(F.col("dt"), F.col("dq"), F.col("oq"), F.col("os")).alias("cost"))


HITS = "h AS (SELECT 's' || l_suppkey AS scaffold, l_orderkey * 10 + l_linenumber AS s_pos, l_partkey % 5 AS chr, (l_orderkey * 37 + l_suppkey * 101) % 1000000 AS pos, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS dir FROM lineitem)"
_ENDS = f"""{HITS}, r AS (SELECT *, count(*) OVER (PARTITION BY scaffold) AS n, count(*) OVER (PARTITION BY scaffold, chr) AS c FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY scaffold ORDER BY s_pos, chr, pos, dir) AS a, row_number() OVER (PARTITION BY scaffold ORDER BY s_pos DESC, chr DESC, pos DESC, dir DESC) AS z FROM r WHERE c >= n // 5),
en AS (SELECT lo.scaffold, lo.chr AS lo_chr, lo.pos AS lo_pos, hi.chr AS hi_chr, hi.pos AS hi_pos, lo.dir FROM k lo JOIN k hi ON lo.scaffold = hi.scaffold AND lo.a = 1 AND hi.z = 1)"""


def scaffold_hits(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("scaffold"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("s_pos"), (F.col("l_partkey") % 5).alias("chr"),
        ((F.col("l_orderkey") * 37 + F.col("l_suppkey") * 101) % 1000000).alias("pos"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("dir"), F.lit(5000).cast("long").alias("size"),
    )


@query(f"WITH {_ENDS} SELECT * FROM en")
def scaffold_anchors(spark, d):
    return scaffold.anchors(scaffold_hits(spark, d))


@query(f"WITH {_ENDS}, pt AS (SELECT scaffold, 'lo' AS e, lo_chr AS chr, lo_pos AS pos FROM en UNION ALL SELECT scaffold, 'hi', hi_chr, hi_pos FROM en), ad AS (SELECT chr, pos, scaffold AS a, e AS a_end, lead(scaffold) OVER w AS b, lead(e) OVER w AS b_end FROM pt WINDOW w AS (PARTITION BY chr ORDER BY pos, scaffold, e)) SELECT * FROM ad WHERE b <> a")
def scaffold_adjacency(spark, d):
    return scaffold.adjacency(scaffold.anchors(scaffold_hits(spark, d)))


@query(
    f"""WITH {HITS}, f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY scaffold ORDER BY chr, pos, s_pos) = 1), b AS (SELECT *, CASE WHEN dir > 0 THEN pos - s_pos ELSE pos - (5000 - s_pos) END AS beg FROM f),
p AS (SELECT *, row_number() OVER w - 1 AS place, beg - lag(beg + 5000) OVER w AS gap FROM b WINDOW w AS (PARTITION BY chr ORDER BY pos, scaffold))
SELECT 'Pseudo' || chr AS chr, place::INTEGER AS place, scaffold, dir, CASE WHEN place = 0 THEN 0 ELSE least(greatest(gap, 10), 1000) END::BIGINT AS gap FROM p"""
)
def scaffold_placement(spark, d):
    return scaffold.placement(scaffold_hits(spark, d))


_TURNED = "SELECT {a} AS s, CASE {a}_end WHEN 'hi' THEN 1 ELSE -1 END AS d, {b} AS t, CASE {b}_end WHEN 'lo' THEN 1 ELSE -1 END AS u FROM tk"


@query(
    f"""WITH RECURSIVE {_ENDS}, pt AS (SELECT scaffold, 'lo' AS e, lo_chr AS chr, lo_pos AS pos FROM en UNION ALL SELECT scaffold, 'hi', hi_chr, hi_pos FROM en),
ld AS (SELECT scaffold AS a, e AS a_end, lead(scaffold) OVER w AS b, lead(e) OVER w AS b_end, row_number() OVER (ORDER BY chr, pos, scaffold, e) AS n FROM pt WINDOW w AS (PARTITION BY chr ORDER BY pos, scaffold, e)),
lk AS (SELECT *, n - row_number() OVER (ORDER BY n) AS g FROM ld WHERE b <> a), tk AS (SELECT * FROM lk QUALIFY row_number() OVER (PARTITION BY g ORDER BY n) % 2 = 1),
hop AS ({_TURNED.format(a="a", b="b")} UNION ALL {_TURNED.format(a="b", b="a")}),
walk AS (SELECT s AS root, s, d, 0 AS place FROM hop AS x WHERE NOT EXISTS (FROM hop AS y WHERE y.s = x.s AND y.d = -x.d) UNION ALL SELECT root, t, u, place + 1 FROM walk JOIN hop USING (s, d)),
ring AS (SELECT DISTINCT s AS root, s, 1 AS d, 0 AS place FROM hop WHERE s NOT IN (SELECT s FROM walk) UNION ALL SELECT root, t, u, place + 1 FROM ring JOIN hop USING (s, d) WHERE t <> root),
walked AS (SELECT *, min(s) OVER (PARTITION BY root) AS path, arg_max(s, place) OVER (PARTITION BY root) AS last FROM walk), ringed AS (SELECT *, min(s) OVER (PARTITION BY root) AS path FROM ring)
SELECT path, place::BIGINT AS place, s AS scaffold, d::INTEGER AS dir FROM walked WHERE root < last UNION ALL SELECT path, place::BIGINT, s, d::INTEGER FROM ringed WHERE root = path
UNION ALL SELECT scaffold, 0, scaffold, 1 FROM en WHERE scaffold NOT IN (SELECT s FROM hop)"""
)
def superscaffold_paths(spark, d):
    ends = scaffold.anchors(scaffold_hits(spark, d))
    return scaffold.paths(scaffold.adjacency(ends), ends)


@query(f"WITH {SUM}, o AS (SELECT q_name, ori, max(q_end - q_start) AS bases FROM s WHERE ident >= 0.7 AND q_end - q_start >= 50 GROUP BY ALL) SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY q_name ORDER BY bases DESC, ori) = 1")
def orient_transcripts(spark, d):
    return scaffold.orient(summary_of(spark, d), 0.7, 50)


@query(f"WITH {SUM} SELECT 'target' AS axis, t_name AS name, t_start AS start, t_end AS \"end\", substr(q_name, 2)::BIGINT AS colour FROM s UNION ALL SELECT 'query', q_name, q_start, q_end, substr(t_name, 2)::BIGINT FROM s")
def paint_rectangles(spark, d):
    s = summary_of(spark, d)
    order = s.select(F.col("t_name").alias("name")).unionByName(s.select(F.col("q_name").alias("name"))).distinct().withColumn("i", F.substring("name", 2, 9).cast("long"))
    return tables.axis_paint(s, order)


@query(f"WITH {M} SELECT target_id, floor(t_start / 1000 + 0.5)::BIGINT AS bin, sum(len)::BIGINT AS bases, greatest(0.0, 0.999 - sum(len)::DOUBLE / 1000)::DOUBLE AS grey FROM m GROUP BY target_id, bin")
def density_bins(spark, d):
    return tables.density_cells(lineitem_matches(spark, d), 1000)


@query(f"WITH {SUM} SELECT target_id, query_id, t_start AS x1, t_start + len AS x2, CASE WHEN rc THEN q_from + len ELSE q_from END AS y1, CASE WHEN rc THEN q_from ELSE q_from + len END AS y2, (query_id + target_id) % 10 AS colour FROM f")
def dotplot_segments(spark, d):
    return tables.dot_plot(lineitem_matches(spark, d))


@query(f"WITH {M} SELECT max(t_start + len) AS t_max, max(q_start + len) AS q_max FROM m")
def axis_extent(spark, d):
    return tables.axis_extent(lineitem_matches(spark, d))


@query(
    f"""WITH {ITEMS}, i AS (SELECT 'q' || seq_id AS q_name, seq FROM items), {SUM}, x AS (SELECT s.*, i.seq, greatest(s.q_start // 2000 - 5, 0) AS a, least(s.q_end // 2000 + 5 + 30, length(i.seq)) AS b FROM s JOIN i USING (q_name))
SELECT q_name || ':' || greatest(q_start // 2000 - 5, 0) || '-' || (q_end // 2000 + 35) AS name, CASE WHEN b > a THEN CASE WHEN ori = '-' THEN {RC.format(s="substr(seq, a + 1, b - a)")} ELSE substr(seq, a + 1, b - a) END ELSE '' END AS seq FROM x"""
)
def extract_fasta(spark, d):
    s = summary_of(spark, d).withColumns({"q_start": F.floor(F.col("q_start") / 2000), "q_end": F.floor(F.col("q_end") / 2000) + 30})
    seqs = items(spark, d).select(F.concat(F.lit("q"), F.col("seq_id")).alias("name"), "seq")
    return tables.extracted(s, seqs, 5)


_BACK = "(VALUES " + ", ".join(f"('{a}', '{c}')" for a, c in sorted(S._codon_codes().items())) + ") AS b(a, c)"


@query(f"WITH {ITEMS}, p AS (SELECT seq_id, i, substr(seq, i + 1, 1) AS a FROM items, LATERAL (SELECT unnest(range(length(seq))) AS i)) SELECT seq_id, string_agg(coalesce(c, 'NNN'), '' ORDER BY i) AS dna FROM p LEFT JOIN {_BACK} USING (a) GROUP BY seq_id")
def back_translate(spark, d):
    return items(spark, d).where("seq <> ''").select("seq_id", S.back_translate(F.col("seq")).alias("dna"))


@query(f"""WITH {DOCS}, c AS (SELECT seq_id, unnest(range(0, length(seq) // 512 + 1)) AS chunk, length(seq) AS l FROM docs WHERE length(seq) >= 6), k AS (SELECT seq_id, chunk, row_number() OVER (ORDER BY seq_id, chunk) - 1 AS r, count(*) OVER () AS n FROM c WHERE least(l, (chunk + 1) * 512) > chunk * 512)
SELECT seq_id, chunk, floor(r * 9 / n)::INTEGER AS block FROM k""")
def chunk_blocks(spark, d):
    return grid.assign_blocks(grid.chunks(docs(spark, d), 512), 9).select("seq_id", "chunk", "block")


@query(
    f"""WITH {ITEMS}, x AS (SELECT seq_id, {RC.format(s="seq")} AS seq FROM items WHERE seq_id % 2 = 1), t AS (SELECT seq_id, p, substr(seq, p + 1, 24) AS word FROM (SELECT * FROM items WHERE seq_id % 2 = 0 UNION ALL SELECT * FROM x), LATERAL (SELECT unnest(range(greatest(length(seq) - 23, 0))) AS p)),
q AS (SELECT seq_id, substr(seq, p + 1, 24) AS word FROM (SELECT seq_id, seq FROM items UNION ALL SELECT seq_id, {RC.format(s="seq")} FROM items), LATERAL (SELECT unnest(range(greatest(length(seq) - 23, 0))) AS p))
SELECT seq_id, seq FROM items WHERE seq_id IN (SELECT seq_id FROM q WHERE word IN (SELECT word FROM t))"""
)
def shared_words(spark, d):
    """Items against items of which every other one is turned, so that half of them can be met on the reverse strand only."""
    a = items(spark, d)
    turned = a.withColumn("seq", F.when(F.col("seq_id") % 2 == 1, S.revcomp(F.col("seq"))).otherwise(F.col("seq")))
    return grid.shared_words(a, turned)


# Letters, pairs and orders


@query("SELECT letter, instr('ACGT', letter)::INTEGER - 1 AS nucleotide, instr('ACDEFGHIKLMNPQRSTVWY', letter)::INTEGER - 1 AS amino, count(*) AS n FROM (SELECT upper(unnest(regexp_extract_all(text, '[A-Za-z]'))) AS letter FROM documents) GROUP BY ALL")
def letter_index(spark, d):
    letters = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z])"), F.lit(1))).alias("letter")).withColumn("letter", F.upper("letter"))
    return letters.groupBy("letter").agg(F.count("*").alias("n")).select("letter", S.nucleotide_index(F.col("letter")).alias("nucleotide"), S.amino_index(F.col("letter")).alias("amino"), "n")


@query("SELECT doc_id, CASE WHEN list_has_any(string_split(lang, ''), string_split(source, '')) THEN 0 ELSE 1 END AS distance FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def column_distance(spark, d):
    rows = table(spark, d, "documents").where("lang is not null and source is not null")
    return rows.select("doc_id", S.column_distance(F.split("lang", ""), F.split("source", "")).alias("distance"))


@query("SELECT vec_id, CASE WHEN a >= c AND a >= g AND a >= t THEN 'A' WHEN c >= g AND c >= t THEN 'C' WHEN g >= t THEN 'G' ELSE 'T' END AS base FROM (SELECT vec_id, embedding[1] AS a, embedding[2] AS c, embedding[3] AS g, embedding[4] AS t FROM embeddings WHERE embedding IS NOT NULL)")
def likeliest_base(spark, d):
    e = [F.element_at("embedding", k) for k in range(1, 5)]
    return table(spark, d, "embeddings").where("embedding is not null").select("vec_id", S.likeliest_base(*e).alias("base"))


@query("SELECT a.n_nationkey AS a_n_nationkey, a.n_name AS a_n_name, b.n_nationkey AS b_n_nationkey, b.n_name AS b_n_name FROM nation a CROSS JOIN nation b")
def pairs_every(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", "n_name")
    return ranking.paired(rows, rows, "n_nationkey", every=True)


@query("SELECT a.item_id AS a_item_id, b.doc_id AS b_item_id, length(a.text) AS a_size, length(b.text) AS b_size FROM benchmark a JOIN documents b ON a.item_id = b.doc_id")
def pairs_diagonal(spark, d):
    items_ = table(spark, d, "benchmark").select("item_id", F.length("text").cast("long").alias("size"))
    documents = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.length("text").cast("long").alias("size"))
    return ranking.paired(items_, documents, "item_id")


@query(f"WITH {SUM} SELECT t_name, t_start, t_end, q_name, q_start, q_end, ident, ori, row_number() OVER (ORDER BY t_name, ori, q_name, t_start, t_end, q_start, q_end, ident) - 1 AS place FROM s")
def block_order(spark, d):
    return ranking.block_order(summary_of(spark, d))
