"""URL filters as a sort-merge range join over reversed-host keys.

A host's labels are reversed (``www.example.com`` becomes ``com.example.www.``),
so that a rule's host and all its subdomains form one interval of the sorted
keys. Host intervals nest or are disjoint. A sorted sweep keeps a stack of the
rule hosts whose interval holds the current key; each level of the stack has the
paths ruled for that host, looked up by their distinct lengths. (A path can't be
part of the interval, as a rule's path holds under every subdomain.)
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.session import partitions, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the rules of the registered query.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Keys per output partition that are drawn to place the range bounds. They only set how rows are dealt.
BOUND_KEYS = 32


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (ASCII lower case) and ``path``; a null url or one without ``://`` has empty ones."""
    u = F.col(url)
    rest = F.when(F.locate("://", u) > 0, u.substr(F.locate("://", u) + F.lit(3), F.length(u))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    clean = F.regexp_extract(rest, r"(?s)^[^?#]*", 0)
    host = F.translate(F.regexp_extract(clean, r"(?s)^[^/]*", 0), UPPER, LOWER)
    path = F.regexp_extract(clean, r"(?s)^[^/]*(.*)$", 1)
    return df.withColumns({"host": host, "path": path})


def host_key(host):
    """Reversed labels, each closed by a dot; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def key_of(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


def above(key: str) -> str | None:
    """The least key above all that start with ``key``; None if there is none."""
    return key[:-1] + "/" if key else None


def best_rule(stack: list, path: str):
    """(length, host length, rule, verdict) of the longest rule of any level that starts ``path``."""
    best = None
    for host_len, lengths, paths in stack:
        for n in lengths:  # longest first: the first that fits is the level's longest
            if n <= len(path) and (hit := paths.get(path[:n])):
                found = (host_len + n, host_len, *hit)
                if best is None or found[:2] > best[:2]:
                    best = found
                break
    return best


def sweep(default: str):
    """mapInArrow body over rows sorted by (part, key, kind): rules (kind 0) before pages (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack, memo_key, memo = None, [], None, []
        for b in batches:
            rules, verdicts, keep = [], [], []
            columns = [b.column(c).to_pylist() for c in ("part", "key", "kind", "path", "rule", "verdict")]
            for i, (p, key, kind, path, rule, verdict) in enumerate(zip(*columns, strict=True)):
                if p != part:
                    part, stack, memo_key = p, [], None
                if kind == 0:
                    while stack and not key.startswith(stack[-1][0]):
                        stack.pop()
                    if not stack or stack[-1][0] != key:
                        stack.append((key, len(rule) - len(path), set(), {}))
                    _, _, lengths, paths = stack[-1]
                    lengths.add(len(path))
                    if path not in paths or verdict < paths[path][1]:  # of equal rules that differ in the verdict, the first by name
                        paths[path] = (rule, verdict)
                    memo_key = None
                    continue
                if key != memo_key:
                    while stack and not key.startswith(stack[-1][0]):
                        stack.pop()
                    memo_key, memo = key, [(n, sorted(lengths, reverse=True), paths) for _, n, lengths, paths in stack]
                hit = best_rule(memo, path)
                keep.append(i)
                rules.append(hit[2] if hit else None)
                verdicts.append(hit[3] if hit else default)
            kept = b.select(["id", "host", "path"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["id", "host", "path", "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]], id_col: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """The verdict of the longest fitting rule for every row of ``pages``.

    ``rules``: (verdict, host, path) rows, as a DataFrame or a list. A rule fits
    its host and all subdomains if the url's path starts with the rule's path;
    an empty rule host fits every host. The longest rule string wins; of equal
    length, the longer host. Returns ``id_col, host, path, rule, verdict``, one
    row for each input row; ``rule`` is null and ``verdict`` is ``default`` where
    no rule fits. Null or malformed urls have an empty host and path; null ids and
    repeated rows are kept as they are; other columns are not read. Rules with a
    null verdict are ignored, a null rule host or path counts as empty. Empty
    tables give an empty result.

    Pages are dealt by ranges of (key, path, id), so a host that holds a third of
    all rows spreads over many tasks. A rule goes only to the ranges that its
    interval meets; at any key no more rule hosts are active than the key has labels.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    rules = rules.select("verdict", F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("verdict is not null").distinct()
    p = with_parts(pages.select(F.col(id_col).alias("id"), F.col(url).alias("url")), "url").select("id", "host", "path")
    p = p.withColumn("key", host_key(F.col("host")))
    n = partitions(spark)
    # A bounded draw of keys by hash places the bounds; every row is then dealt by them.
    drawn = p.select("key", "path", F.xxhash64("key", "path", "id").alias("h")).orderBy("h", "key", "path").limit(BOUND_KEYS * n)
    marks = sorted((r["key"], r["path"], r["h"]) for r in drawn.collect())
    bounds = [marks[i * len(marks) // n] for i in range(1, n)] if marks else []
    hosts = [m[0] for m in bounds]

    @F.pandas_udf("int")
    def deal(key: pd.Series, path: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, x) for x in zip(key, path, h, strict=True)], dtype="int32")

    @F.pandas_udf("array<int>")
    def meets(key: pd.Series) -> pd.Series:
        from bisect import bisect_left

        return pd.Series([list(range(bisect_left(hosts, k), (bisect_left(hosts, above(k)) if above(k) else len(hosts)) + 1)) for k in key])

    rows = p.withColumn("h", F.xxhash64("key", "path", "id")).withColumn("part", deal("key", "path", "h"))
    rows = rows.select("part", "key", F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    id_type = dict(p.dtypes)["id"]
    r = rules.withColumn("key", host_key(F.col("host"))).withColumn("part", F.explode(meets("key")))
    r = r.select("part", "key", F.lit(0).alias("kind"), F.lit(None).cast(id_type).alias("id"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")
    sorted_rows = rows.unionByName(r).repartitionById(n, "part").sortWithinPartitions("part", "key", "kind", "path", "rule")
    out = sorted_rows.mapInArrow(sweep(default), f"id {id_type}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


ORACLE = {
    "op1_url_filter": """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*', 0) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(coalesce(rest, ''), '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM parts
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC) AS rn
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN (SELECT * FROM fits WHERE rn = 1) f ON s.page_id = f.page_id AND s.host = f.host AND s.path = f.path
"""
}
