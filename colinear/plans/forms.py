"""Queries of files as text, predicates, ranges of chunks, substitution scores, float signals and the guided programs, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colinear.functions import scoring
from colinear.functions import sequence as S
from colinear.operators import align, blocks, grid, guided, intervals, star, tiles, xcorr
from colinear.plans import programs
from colinear.plans.heavy import _SYNTENY, _regions, _seeds
from colinear.plans.queries import DOCS, ITEMS, RC, SUM, _blocks, docs, docs_size, items, summary_of
from colinear.session import stored, table
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


# Sequences and their files


def _named(spark, d) -> DataFrame:
    return docs(spark, d).select("seq_id", F.concat(F.lit("d"), F.col("seq_id") % 300).alias("name"), "seq")


_NAMED = f"{DOCS}, n AS (SELECT seq_id, 'd' || seq_id % 300 AS name, seq FROM docs)"


@query(f"WITH {_NAMED} SELECT DISTINCT name, seq FROM n")
def unique_sequences(spark, d):
    return fasta.unique_sorted(_named(spark, d))


@query(f"WITH {_NAMED} SELECT * FROM n WHERE name NOT IN (SELECT 'd' || s_suppkey FROM supplier WHERE s_suppkey IS NOT NULL)")
def erased_sequences(spark, d):
    return fasta.erase(_named(spark, d), table(spark, d, "supplier").select(F.concat(F.lit("d"), "s_suppkey").alias("name")))


@query("SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL)")
def name_ids(spark, d):
    return fasta.name_ids(table(spark, d, "part").select(F.col("p_name").alias("name")).where("name is not null"))


@query(f"WITH {_NAMED} SELECT '>' || name || chr(10) || rtrim(regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10)) AS value FROM n WHERE seq <> ''")
def fasta_export(spark, d):
    return fasta.fasta_lines(_named(spark, d).drop("seq_id"), skip_empty=True)


@query("SELECT doc_id, regexp_replace(trim(regexp_replace(source, '^>', '')), '\\s+', '_', 'g') AS name, upper(lang) AS upper, reverse(lang) AS reversed FROM documents")
def clean_names(spark, d):
    return table(spark, d, "documents").select("doc_id", S.clean_name(F.col("source")).alias("name"), F.upper("lang").alias("upper"), F.reverse("lang").alias("reversed"))


@query("WITH c AS (SELECT item_id, text, i, substr(text, i + 1, 1) AS c FROM benchmark, unnest(range(0, length(text), 4)) AS r(i)) SELECT item_id, 2 * count(*) FILTER (WHERE c <> upper(c)) >= count(*) AS masked FROM c GROUP BY item_id")
def soft_masked(spark, d):
    return table(spark, d, "benchmark").where("text <> ''").select("item_id", S.soft_masked(F.col("text")).alias("masked"))


_CLASSES = ["AVLIMC", "FWYH", "STNQ", "KR", "DE", "GP"]
#: A table by rule: 4 for a letter and itself, 1 within a chemical class, -2 across.
SCORES = {(a, b): 4.0 if a == b else 1.0 if x == y else -2.0 for x in _CLASSES for y in _CLASSES for a in x for b in y}
_CLASS = "CASE " + " ".join(f"WHEN strpos('{x}', {{c}}) > 0 THEN {i}" for i, x in enumerate(_CLASSES)) + " END"


@query(
    f"SELECT a.n_nationkey, b.r_regionkey, CASE WHEN x IS NULL OR y IS NULL THEN -100 WHEN a.c = b.c THEN 4 WHEN x = y THEN 1 ELSE -2 END::DOUBLE AS score "
    f"FROM (SELECT *, upper(substr(n_name, 2, 1)) AS c, {_CLASS.format(c='upper(substr(n_name, 2, 1))')} AS x FROM nation) a, (SELECT *, upper(substr(r_name, 3, 1)) AS c, {_CLASS.format(c='upper(substr(r_name, 3, 1))')} AS y FROM region) b WHERE a.n_regionkey = b.r_regionkey"
)
def substitution_scores(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", "r_regionkey", S.substitution(F.substring("n_name", 2, 1), F.substring("r_name", 3, 1), SCORES).alias("score"))


# Predicates and ranges


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey % 100 AS a, l_partkey % 100 + l_quantity::BIGINT AS b, l_suppkey % 100 AS c, l_suppkey % 100 + 20 AS e, l_returnflag = 'R' AS same FROM lineitem)
SELECT l_orderkey, l_linenumber, a <= c AND b >= e AS holds, CASE WHEN same THEN greatest(least(b, e) - greatest(a, c) + 1, 0) ELSE 0 END::BIGINT AS shared FROM r"""
)
def interval_predicates(spark, d):
    a, c = F.col("l_partkey") % 100, F.col("l_suppkey") % 100
    b, e = a + F.col("l_quantity").cast("long"), c + 20
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", intervals.contains(a, b, c, e).alias("holds"), intervals.overlap(a, b, c, e, F.col("l_returnflag") == "R").cast("long").alias("shared"))


@query("SELECT l_suppkey AS seq_id, min(l_partkey) AS first, max(l_partkey) AS last FROM lineitem GROUP BY ALL")
def chunk_range(spark, d):
    return grid.chunk_range(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("seq_id"), F.col("l_partkey").alias("chunk")))


@query("SELECT l_orderkey, l_linenumber, l_suppkey AS t, l_partkey AS q FROM lineitem WHERE EXISTS (SELECT 1 FROM nation WHERE l_suppkey BETWEEN n_nationkey * 3 AND n_nationkey * 3 + 1 AND l_partkey BETWEEN n_regionkey * 10 AND n_regionkey * 10 + 60)")
def allowed_pairs(spark, d):
    ranges = table(spark, d, "nation").select((F.col("n_nationkey") * 3).alias("t1"), (F.col("n_nationkey") * 3 + 1).alias("t2"), (F.col("n_regionkey") * 10).alias("q1"), (F.col("n_regionkey") * 10 + 60).alias("q2"))
    return grid.allowed(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("t"), F.col("l_partkey").alias("q")), ranges)


@query("SELECT l_orderkey, l_linenumber, round(1 - exp(-(l_discount::DOUBLE)), 9) AS p FROM lineitem")
def poisson_tail(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(scoring.poisson_p(F.col("l_discount").cast("double")), 9).alias("p"))


# Signals


@query(
    """WITH p AS (SELECT a.vec_id AS id, a.embedding AS t, b.embedding AS q FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE len(a.embedding) > 0 AND len(b.embedding) > 0),
s AS (SELECT id, t, q, shift FROM p, unnest(range(1 - len(q), len(t))) AS r(shift)),
v AS (SELECT id, shift, list_dot_product(t[greatest(shift, 0) + 1:least(len(t), len(q) + shift)]::DOUBLE[], q[greatest(-shift, 0) + 1:least(len(q), len(t) - shift)]::DOUBLE[]) AS v FROM s)
SELECT id, shift, round(v, 6) AS strength FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY v DESC, shift) = 1"""
)
def signal_shifts(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("t")).join(e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("q")), "id")
    return xcorr.signal_shifts(pairs).withColumn("strength", F.round("strength", 6))


@query("SELECT l_orderkey, l_linenumber, greatest(s, 0) AS t_start, greatest(-s, 0) AS q_start, greatest(least(t - greatest(s, 0), q - greatest(-s, 0)), 0) AS len FROM (SELECT *, l_partkey % 90 - 45 AS s, l_quantity::BIGINT AS t, l_suppkey % 60 AS q FROM lineitem)")
def full_overlaps(spark, d):
    x = xcorr.full_overlap(F.col("l_quantity").cast("long"), F.col("l_suppkey") % 60, F.col("l_partkey") % 90 - 45)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x")).select("l_orderkey", "l_linenumber", "x.*")


# Block files

_SIZES = "z AS (SELECT name, size FROM (SELECT 't' || s_suppkey AS name, s_suppkey * 20000 AS size FROM supplier UNION ALL SELECT 'q' || p_partkey, p_partkey * 20000 FROM part) WHERE size >= 100000)"


@query(
    f"""WITH b AS ({_SYNTENY}), {_SIZES}, k AS (SELECT * FROM b WHERE t_name IN (SELECT name FROM z) AND q_name IN (SELECT name FROM z)),
h AS (SELECT 0 AS o, 't' AS p, 'Genome1' AS g UNION ALL SELECT 2, 'q', 'Genome2')
SELECT o AS section, '' AS key, 0::BIGINT AS line, 'genome' || chr(9) || g || chr(10) || 'chromosomes' || chr(9) || (SELECT count(*) FROM z WHERE name LIKE p || '%') AS value FROM h
UNION ALL SELECT o + 1, name, 0, name || CASE WHEN p = 'q' THEN 'Q' ELSE '' END || chr(9) || (size // 10) FROM h JOIN z ON name LIKE p || '%'
UNION ALL SELECT 4, concat_ws(chr(9), t_name, lpad(t_start::VARCHAR, 20, '0'), q_name, ori), -1, concat_ws(chr(9), t_name, t_start, t_end, '+1', q_name || 'Q', q_start, q_end, CASE WHEN ori = '-' THEN '-1' ELSE '+1' END, ident::DECIMAL(12, 9)::DECIMAL(9, 6)::VARCHAR, n) FROM k"""
)
def block_file(spark, d):
    sizes = lambda name, key, letter: table(spark, d, name).select(F.concat(F.lit(letter), key).alias("name"), (F.col(key) * 20000).alias("size"))
    found = blocks.synteny_blocks(summary_of(spark, d)).withColumn("ident", F.round("ident", 9))
    return tables.block_lines(found, sizes("supplier", "s_suppkey", "t"), sizes("part", "p_partkey", "q"))


# Programs


@query()
def refined_matches(spark, d):
    """The seeds of the items on the documents, and what a lenient correlation finds between them."""
    m = _seeds(spark, d)
    return programs.refined(m, items(spark, d), docs(spark, d, m.select("target_id")), total=docs_size(spark, d))


@query()
def seeded_alignments(spark, d):
    return programs.seeded_alignments(items(spark, d), docs(spark, d), 12, 2)


@query()
def reference_columns(spark, d):
    """Every item against the documents' surroundings of its seeds."""
    m = _seeds(spark, d).where("not rc").select("query_id", "target_id", (F.col("t_start") - F.col("q_start") - 20).alias("first")).distinct()
    m = m.join(items(spark, d).select(F.col("seq_id").alias("query_id"), F.col("seq").alias("t_seq")), "query_id").withColumn("size", F.length("t_seq") + 40)
    found = tiles.sliced(m, tiles.store(docs(spark, d, m.select("target_id"))), "target_id", "first", "size", "q_seq")
    pairs = found.select(F.col("query_id").alias("ref_id"), "target_id", "first", "t_seq", "q_seq")
    return guided.reference_columns(pairs, least=100, least_pairs=2)


@query()
def homopolymer_identities(spark, d):
    """Identity of every seed's surroundings, in which runs of one letter may differ in length."""
    return align.homopolymer_identities(_regions(spark, d).select("id", "t_seq", "q_seq"))


# Stars and scores of alignments


def _stack(spark, d) -> DataFrame:
    """(ref_id, t_off, t_aligned, q_aligned): each item and the documents' letters beside it, wherever a forward seed puts it, without gaps."""
    m = _seeds(spark, d).where("not rc").select("query_id", "target_id", (F.col("t_start") - F.col("q_start")).alias("first")).distinct()
    m = m.join(items(spark, d).select(F.col("seq_id").alias("query_id"), F.col("seq").alias("item")), "query_id").withColumn("size", F.length("item"))
    found = tiles.sliced(m, tiles.store(docs(spark, d, m.select("target_id"))), "target_id", "first", "size", "q_aligned")
    off = F.greatest(-F.col("first"), F.lit(0))
    return found.select(F.col("query_id").alias("ref_id"), off.alias("t_off"), F.substr("item", off + 1, F.length("q_aligned")).alias("t_aligned"), "q_aligned")


def _references(spark, d) -> DataFrame:
    return items(spark, d).withColumnRenamed("seq_id", "ref_id")


_STACK = f"""{DOCS}, {ITEMS}, sb AS (WITH {_blocks("items", "docs", 15, 4, 15)}), st AS (SELECT DISTINCT query_id, target_id, t_start - q_start AS f FROM sb WHERE NOT rc),
l AS (SELECT query_id AS ref_id, p AS pos, substr(i.seq, p + 1, 1) AS ref, substr(d.seq, f + p + 1, 1) AS c FROM st JOIN items AS i ON i.seq_id = query_id JOIN docs AS d ON d.seq_id = target_id, LATERAL (SELECT unnest(range(greatest(0, -f), least(length(i.seq), length(d.seq) - f))) AS p))"""


@query(
    f"""WITH {_STACK}, r AS (SELECT seq_id AS ref_id, p AS pos, substr(seq, p + 1, 1) AS ref FROM items, LATERAL (SELECT unnest(range(length(seq))) AS p)),
n AS (SELECT ref_id, pos, r.ref, count(c) AS members, {", ".join(f"count(*) FILTER (WHERE c = '{x}') AS {x.lower()}" for x in "ACGT")}, count(*) FILTER (WHERE c = r.ref) AS same FROM r LEFT JOIN l USING (ref_id, pos) GROUP BY ALL)
SELECT *, CASE WHEN same = members THEN ref ELSE '?' END AS consensus FROM n"""
)
def star_counts(spark, d):
    """Letters of the documents beside each letter of an item, stacked on their seeds without gaps."""
    return star.star_profile(_stack(spark, d), _references(spark, d)).where("slot = 0").select("ref_id", "pos", "ref", "members", "a", "c", "g", "t", "same", "consensus")


@query(
    f"""WITH {_STACK}, n AS (SELECT query_id AS ref_id, count(*) AS n FROM st GROUP BY ALL),
k AS (SELECT ref_id, pos, pos - row_number() OVER (PARTITION BY ref_id ORDER BY pos) AS g FROM (SELECT ref_id, pos, count(*) FILTER (WHERE c = ref) AS same FROM l GROUP BY ALL) JOIN n USING (ref_id) WHERE 10 * same >= 9 * n)
SELECT ref_id, min(pos) AS first, max(pos) AS last, substr(any_value(seq), min(pos) + 1, max(pos) - min(pos) + 1) AS motif FROM k JOIN items ON seq_id = ref_id GROUP BY ref_id, g HAVING max(pos) - min(pos) + 1 >= 6"""
)
def motifs(spark, d):
    """Stretches of items that nine of ten documents keep, of all that have a seed on the item."""
    rows = stored(_stack(spark, d), "stack")
    pairs = rows.groupBy("ref_id").agg(F.count("*").alias("pairs"))
    columns = star.star_profile(rows, _references(spark, d)).where("slot = 0").select("ref_id", "pos", "same").join(pairs, "ref_id")
    return star.conserved_motifs(columns, _references(spark, d))


@query()
def star_profile(spark, d):
    """Items and the documents' surroundings of their seeds, aligned with gaps: every column, those of inserts too."""
    m = _seeds(spark, d).where("not rc").select("query_id", "target_id", (F.col("t_start") - F.col("q_start") - 20).alias("first")).distinct()
    m = m.join(items(spark, d).select(F.col("seq_id").alias("query_id"), F.col("seq").alias("t_seq")), "query_id").withColumn("size", F.length("t_seq") + 40)
    found = tiles.sliced(m, tiles.store(docs(spark, d, m.select("target_id"))), "target_id", "first", "size", "q_seq").select(F.col("query_id").alias("id"), "t_seq", "q_seq")
    return star.star_profile(align.align_pairs(found.repartition("id", "q_seq"), "SWGA").withColumnRenamed("id", "ref_id"), _references(spark, d))


_REGIONS = f"""{DOCS}, {ITEMS}, sb AS (WITH {_blocks("items", "docs", 15, 4, 15)}), m AS (SELECT *, CASE WHEN rc THEN length(i.seq) - len - q_start ELSE q_start END AS q_at, CASE WHEN rc THEN {RC.format(s="i.seq")} ELSE i.seq END AS q FROM sb JOIN items AS i ON i.seq_id = query_id),
rg AS (SELECT DISTINCT substr(d.seq, greatest(t_start - 30, 0) + 1, t_start + len + 30 - greatest(t_start - 30, 0)) AS t, substr(q, greatest(q_at - 30, 0) + 1, q_at + len + 30 - greatest(q_at - 30, 0)) AS q FROM m JOIN docs AS d ON d.seq_id = target_id)"""


@query(
    f"""WITH {_REGIONS}, x AS (SELECT t, q, s + j AS i, j, s, CASE WHEN substr(t, s + j + 1, 1) = substr(q, j + 1, 1) THEN 1 ELSE 0 END AS e FROM rg, LATERAL (SELECT unnest(range(46 - length(q), length(t) - 45)) AS s), LATERAL (SELECT unnest(range(greatest(0, -s), least(length(q), length(t) - s))) AS j)),
w AS (SELECT *, sum(e) OVER o AS n, count(*) OVER o AS size, sum(e) OVER (PARTITION BY t, q, s ORDER BY j) AS upto FROM x WINDOW o AS (PARTITION BY t, q, s ORDER BY j ROWS BETWEEN CURRENT ROW AND 45 FOLLOWING)),
g AS (SELECT t, q, s, j, upto - e AS before, j - row_number() OVER (PARTITION BY t, q, s ORDER BY j) AS k FROM w WHERE size = 46 AND n >= 19),
r AS (SELECT t, q, s, min(j) AS a, max(j) + 46 AS b FROM g GROUP BY t, q, s, k)
SELECT md5(r.t || ',' || r.q) AS pair, a + r.s AS t_start, a AS q_start, b - a AS len, round((SELECT count(*) FROM range(a, b) AS u(p) WHERE substr(r.t, r.s + p + 1, 1) = substr(r.q, p + 1, 1))::DOUBLE / (b - a), 6) AS ident FROM r"""
)
def windowed_matches(spark, d):
    """Runs of good windows at every shift of the surroundings of seeds, without a transform."""
    pairs = _regions(spark, d).select("t_seq", "q_seq").distinct().withColumn("pair", F.md5(F.concat_ws(",", "t_seq", "q_seq").cast("binary")))
    return xcorr.windowed_matches(pairs).withColumn("ident", F.round("ident", 6))


_LINED = "x AS (SELECT doc_id, item_id, translate(d.text, ' .,', '---') AS a, translate(b.text, ' .,', '---') AS b, least(length(d.text), length(b.text)) AS n FROM documents AS d JOIN benchmark AS b ON d.doc_id % 40 = b.item_id % 40)"


def _lined(spark, d) -> DataFrame:
    """Documents and items of one remainder, side by side, with blanks, points and commas as gaps."""
    gaps = lambda c, name: F.translate(c, " .,", "---").alias(name)
    x = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 40).alias("g"), gaps("text", "a"))
    y = table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 40).alias("g"), gaps("text", "b"))
    return x.join(F.broadcast(y) if y.count() <= 10_000 else y, "g").where("a is not null and b is not null").drop("g")


@query(
    f"""WITH {_LINED}, k AS (SELECT doc_id, item_id, n, array_to_string(list_transform(range(n), lambda i: CASE WHEN a[i + 1] = '-' OR b[i + 1] = '-' THEN 'g' WHEN a[i + 1] = b[i + 1] THEN 'm' ELSE 'x' END), '') AS k FROM x WHERE n IS NOT NULL),
c AS (SELECT doc_id, item_id, n, (n - length(replace(k, 'm', '')))::BIGINT AS matches, (n - length(replace(k, 'x', '')))::BIGINT AS mismatches, regexp_extract_all(regexp_replace(k, 'g+$', ''), 'g+') AS gaps, len(regexp_extract_all(k, 'm+')) AS runs FROM k)
SELECT doc_id, item_id, n AS columns, matches, mismatches, mismatches + len(gaps) AS edits, matches - mismatches - coalesce(list_sum(list_transform(gaps, lambda g: least(length(g), 10))), 0)::BIGINT AS score, round(matches / greatest(runs, 1), 6) AS contiguity FROM c"""
)
def alignment_scores(spark, d):
    rows = _lined(spark, d).select("doc_id", "item_id", scoring.alignment_scores(F.col("a"), F.col("b")).alias("s"))
    return rows.select("doc_id", "item_id", "s.*").withColumn("contiguity", F.round("contiguity", 6))


# Features of a genome file

_AXIS = "'c' || doc_id % 12"


@query(
    f"""WITH d AS (SELECT *, {_AXIS} AS seq FROM documents WHERE doc_id IS NOT NULL AND n_chars IS NOT NULL),
f AS (SELECT seq, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS type, doc_id * 100 - 50 AS s, doc_id * 100 + least(n_chars, 5000) - 50 AS e FROM labels l JOIN d USING (doc_id)),
c AS (SELECT seq, doc_id * 100 + 50 AS s, doc_id * 100 + 50 + n_chars // 10 AS e FROM d),
z AS (SELECT seq, 0::BIGINT AS s, max(doc_id) * 100 + 5950 AS e FROM d GROUP BY seq),
u AS (SELECT seq, type, s, e FROM f UNION ALL SELECT seq, '', s, e FROM c UNION ALL SELECT seq, '*', s, e FROM z),
v AS (SELECT seq, type, s AS pos, 1 AS dl FROM u WHERE e > s UNION ALL SELECT seq, type, e, -1 FROM u WHERE e > s),
w AS (SELECT seq, pos, {", ".join(f"sum(CASE WHEN type = '{t}' THEN dl ELSE 0 END) AS {n}" for t, n in (("", "c"), ("*", "z"), ("good", "g"), ("poor", "p"), ("toxic", "t")))} FROM v GROUP BY ALL),
x AS (SELECT lead(pos) OVER o - pos AS size, {", ".join(f"sum({n}) OVER o > 0 AS {n}" for n in "czgpt")} FROM w WINDOW o AS (PARTITION BY seq ORDER BY pos)),
y AS (SELECT 'good' AS type, size, c FROM x WHERE z AND g UNION ALL SELECT 'poor', size, c FROM x WHERE z AND p UNION ALL SELECT 'toxic', size, c FROM x WHERE z AND t UNION ALL SELECT 'None', size, c FROM x WHERE z AND NOT g AND NOT p AND NOT t)
SELECT type, sum(size)::BIGINT AS bases, coalesce(sum(CASE WHEN c THEN size END), 0)::BIGINT AS covered, coalesce(sum(CASE WHEN c THEN size END), 0)::DOUBLE / sum(size) AS share FROM y GROUP BY type"""
)
def matches_by_feature(spark, d):
    """Labelled documents as features of twelve chromosomes, in the lines of a genome file, and the documents' first tenths as matches."""
    rows = table(spark, d, "documents").where("doc_id is not null and n_chars is not null").withColumn("seq", F.concat(F.lit("c"), F.col("doc_id") % 12))
    line = lambda kind, start, end: F.concat_ws("\t", "seq", F.lit("."), kind, start.cast("string"), end.cast("string"), F.lit("."), F.lit("+"), F.lit("."), F.lit("ID=x")).alias("value")
    at = F.col("doc_id") * 100
    axes = rows.groupBy("seq").agg((F.max("doc_id") * 100 + 6000).alias("last")).select(line(F.lit("chromosome"), F.lit(51), F.col("last")))
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    features = table(spark, d, "labels").join(rows, "doc_id").where("n_chars > 0").select(line(kind, at + 1, at + F.least(F.col("n_chars"), F.lit(5000))))
    axes, features = tables.parse_gff(axes.unionByName(features))
    found = rows.select(F.col("seq").alias("t_name"), (at + 50).alias("t_start"), (at + 50 + F.floor(F.col("n_chars") / 10)).alias("t_end"))
    return programs.matches_by_feature(features, axes, found)
