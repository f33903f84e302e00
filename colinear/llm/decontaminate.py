"""Benchmark decontamination: which document words lie in windows of benchmark items.

A prefix-filtered set join, in DataFrame operations throughout. Texts are cut into
words and read as shingles of ``SHINGLE`` words. A window is wholly contained or not
at all, so of its shingles, ordered by how rare they are in the documents, the first
alone is a necessary prefix. Neighbouring windows of an item that have their prefix in
common form one stretch. A document's occurrence of a prefix gives the one place where the
stretch could lie; places where none of its windows fits are left out, and the
words of the others are compared, window by window.

One pass over the texts finds the occurrences of the items' shingles; texts are read again
for documents with a prefix only. Documents are never paired with items: stretches
with the same items, and documents with the same sets of items, are put together first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.session import stored, table

#: Words of a window, and of a shingle.
WINDOW, SHINGLE = 10, 5
#: Rows (of two longs), and bytes of the stretches' words, up to which a side is broadcast, by count.
SMALL, SMALL_BYTES = 1_000_000, 32 << 20
#: ASCII characters that separate words: all but digits and letters.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased: what stands between ASCII characters other than digits and letters."""
    plain = F.translate(text, SEPARATORS + UPPER, " " * len(SEPARATORS) + UPPER.lower())
    return F.array_remove(F.split(plain, " "), "")


def once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns that are worked out once for each row, however often they are named later."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def shingles(hashes: str, sizes: list[int]) -> Column:
    """Array of (pos, g): the digests of all runs of so many words, from the array of the words' digests."""
    none = F.array().cast("array<struct<pos: int, g: long>>")
    one = lambda s: F.transform(F.sequence(F.lit(0), F.size(hashes) - s), lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(s)]).alias("g")))
    return F.concat(none, *[F.when(F.size(hashes) >= s, one(s)).otherwise(none) for s in sizes])


def digests(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def item_shingles(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """``item, id, w, m, s, list``: an item's words, the length of its windows and of its shingles, and these as (pos, g). Items without a word have no row."""
    rows = once(items, ["id"], w=words_of(F.col("text"))).where("size(w) > 0")
    rows = rows.withColumns({"item": F.md5(F.to_json(F.struct("id", "w"))), "m": F.least(F.size("w"), F.lit(window))}).dropDuplicates(["item"])
    rows = rows.withColumn("s", F.least("m", F.lit(shingle)))
    rows = once(rows, ["item", "id", "w", "m", "s"], h=digests(F.col("w")))
    cut = F.lit(None)
    for s in range(shingle, 0, -1):
        cut = F.when(F.col("s") == s, shingles("h", [s])).otherwise(cut)
    return rows.select("item", "id", "w", "m", "s", cut.alias("list"))


def stretches(items: DataFrame, counts: DataFrame) -> DataFrame:
    """``id, sid, g, rel, m, s_words``: the windows of an item that share their rarest shingle ``g``, put together.

    ``counts`` (g, n): how often shingles occur in the documents. Of equally rare ones
    the smaller digest counts as rarer, then the earlier place. ``rel`` is the place
    of the shingle in the stretch, ``sid`` names the stretch by what it holds.
    """
    each = items.select("item", F.inline("list")).join(counts, "g", "left").select("item", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g", "pos").alias("x"))
    ranked = each.groupBy("item").agg(F.array_sort(F.collect_list("x"), lambda a, b: a["pos"] - b["pos"]).alias("list"))
    rows = items.drop("list").join(ranked, "item")
    offsets = F.sequence(F.lit(0), F.size("w") - F.col("m"))
    windows = rows.select("item", F.explode(F.transform(offsets, lambda o: F.struct(o.alias("at"), F.array_min(F.slice("list", o + 1, F.col("m") - F.col("s") + 1)).alias("x")))).alias("win"))
    # a shingle that no document has rules its windows out
    runs = windows.where("win.x.n > 0").groupBy("item", F.col("win.x.pos").alias("pos"), F.col("win.x.g").alias("g")).agg(F.min("win.at").alias("first"), F.max("win.at").alias("last"))
    found = runs.join(rows.select("item", "id", "w", "m"), "item").select("id", "g", (F.col("pos") - F.col("first")).alias("rel"), "m", F.slice("w", F.col("first") + 1, F.col("last") - F.col("first") + F.col("m")).alias("s_words"))
    return found.withColumn("sid", F.md5(F.to_json(F.struct("rel", "m", "s_words"))))


def covered(spans: Column) -> Column:
    """Words in an array of (at, m), each counted once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["at"] + x["m"] - F.greatest(x["at"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["at"] + x["m"]).alias("end"))
    return F.aggregate(F.array_sort(F.array_distinct(spans)), start, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_words, n_hit, item_ids, spans`` of every row of ``docs``.

    ``n_hit`` counts the words inside windows of items, each once; ``item_ids`` are
    those of the items with such windows, as strings, distinct and sorted; ``spans`` (at, m) the
    windows' places, distinct and sorted. An item of fewer than ``window`` words, but not none, is one window.
    Null and empty texts have no words, on either side. Repeated rows and ids stand
    for themselves, with equal results for equal texts; items of one id count once. A null
    item id is written as an empty string. Empty tables: no rows, or rows without a hit.
    Other columns of either table play no part, whatever their names.
    """
    known = stored(item_shingles(items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")), window, shingle), "items")
    sizes = sorted(r["s"] for r in known.select("s").distinct().collect()) or [shingle]
    wanted = known.select(F.explode("list.g").alias("g")).distinct()
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = once(texts, ["id", "th"], h=digests(F.coalesce(words_of(F.col("text")), F.array().cast("array<string>"))))
    # every document has a row of its own (pos -1), and one for each shingle that an item has
    own = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("g")))
    rows = rows.select("id", "th", F.size("h").alias("n_words"), F.inline(F.concat(own, shingles("h", sizes))))
    small = wanted.count() <= SMALL
    if small:
        hit = F.broadcast(wanted.withColumnRenamed("g", "wanted"))
        rows = rows.join(hit, rows["g"] == hit["wanted"], "left").where("pos < 0 or wanted is not null").drop("wanted")
    else:
        rows = rows.where("pos < 0").unionByName(rows.where("pos >= 0").join(wanted, "g", "left_semi"))
    seen = stored(rows, "occurrences")
    heads, places = seen.where("pos < 0").select("id", "th", "n_words"), seen.where("pos >= 0")
    parts = stored(stretches(known, places.groupBy("g").agg(F.count("*").alias("n"))), "stretches")
    prefixes = parts.select("sid", "g", "rel", "m", "s_words").dropDuplicates(["sid"])
    held = prefixes.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("s_words", " "))).alias("bytes")).first()
    light = small and held["n"] <= SMALL // 10 and (held["bytes"] or 0) <= SMALL_BYTES
    # the one place of the stretch, and those of its windows that the document has room for
    at = F.col("pos") - F.col("rel")
    k_first, k_last = F.greatest(F.lit(0), -at), F.least(F.size("s_words") - F.col("m"), F.col("n_words") - F.col("m") - at)
    near = places.distinct().join(F.broadcast(prefixes) if light else prefixes, "g").select("id", "th", F.struct(at.alias("at"), k_first.alias("k_first"), k_last.alias("k_last"), "sid", "m", "s_words").alias("c")).where("c.k_first <= c.k_last")
    near = stored(near.groupBy("id", "th").agg(F.collect_list("c").alias("near")), "candidates")
    keys = near.select(F.col("id").alias("c_id"), F.col("th").alias("c_th"))
    same = texts["id"].eqNullSafe(F.col("c_id")) & (texts["th"] == F.col("c_th"))
    open_ = texts.dropDuplicates(["id", "th"]) if near.count() > SMALL else texts.join(F.broadcast(keys), same, "left_semi").dropDuplicates(["id", "th"])
    both = open_.join(near.toDF("c_id", "c_th", "near"), open_["id"].eqNullSafe(F.col("c_id")) & (open_["th"] == F.col("c_th")))
    both = once(both, ["id", "th", "near"], w=words_of(F.col("text")))

    def windows(c: Column) -> Column:
        equal = F.filter(F.sequence(c["k_first"], c["k_last"]), lambda k: F.slice("w", c["at"] + k + 1, c["m"]) == F.slice(c["s_words"], k + 1, c["m"]))
        return F.struct(c["sid"].alias("sid"), F.transform(equal, lambda k: F.struct((c["at"] + k).alias("at"), c["m"].alias("m"))).alias("spans"))

    held = once(both, ["id", "th"], kept=F.filter(F.transform("near", windows), lambda x: F.size(x["spans"]) > 0)).where("size(kept) > 0")
    held = once(held, ["id", "th", "kept"], all_spans=F.flatten("kept.spans"))
    held = stored(held.select("id", "th", covered(F.col("all_spans")).alias("n_hit"), F.array_sort(F.array_distinct("all_spans")).alias("spans"), F.array_distinct("kept.sid").alias("sids")), "verified")
    # stretches with the same items, then documents with the same sets of items
    groups = parts.groupBy("sid").agg(F.array_sort(F.collect_set(F.coalesce(F.col("id").cast("string"), F.lit("")))).alias("ids"))
    groups = stored(groups.withColumn("set_id", F.md5(F.to_json("ids"))), "item_sets")
    each = held.select("id", "th", F.explode("sids").alias("sid")).join(groups.select("sid", "set_id"), "sid")
    of_doc = stored(each.groupBy("id", "th").agg(F.array_sort(F.collect_set("set_id")).alias("sets")).select("id", "th", "sets", F.md5(F.array_join("sets", "")).alias("class")), "classes")
    sets = of_doc.select("class", "sets").dropDuplicates(["class"]).select("class", F.explode("sets").alias("set_id"))
    lists = sets.join(groups.select("set_id", "ids").dropDuplicates(["set_id"]), "set_id").groupBy("class").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("item_ids"))
    lists = stored(lists, "item_lists")
    named = of_doc.select("id", "th", "class").join(lists, "class").drop("class")
    found = held.select("id", "th", "n_hit", "spans").join(named.toDF("n_id", "n_th", "item_ids"), F.col("id").eqNullSafe(F.col("n_id")) & (F.col("th") == F.col("n_th"))).select(F.col("id").alias("f_id"), F.col("th").alias("f_th"), "n_hit", "spans", "item_ids")
    out = heads.join(found, heads["id"].eqNullSafe(F.col("f_id")) & (heads["th"] == F.col("f_th")), "left")
    return out.select(
        F.col("id").alias(doc_id),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("spans", F.array().cast("array<struct<at: int, m: int>>")).alias("spans"),
    )


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = f"regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE = {
    "op13_decontaminate": f"""
with it as (select item_id, {_WORDS} as w from benchmark where text is not null),
win as (select distinct item_id, w[i + 1 : i + least(len(w), {WINDOW})] as x from (select item_id, w, unnest(range(0, len(w) - least(len(w), {WINDOW}) + 1)) as i from it where len(w) > 0)),
d as (select row_number() over () as r, doc_id, case when text is null then [] else {_WORDS} end as w from documents),
dw as (select r, m, i, w[i + 1 : i + m] as x from (select r, m, w, unnest(range(0, len(w) - m + 1)) as i from d, (select distinct len(x) as m from win) where len(w) >= m)),
hit as (select r, m, i, item_id from dw join win using (x)),
word as (select r, count(distinct place) as n_hit from (select r, unnest(range(i, i + m)) as place from (select distinct r, i, m from hit)) group by r),
named as (select r, count(distinct coalesce(item_id::varchar, '')) as n_items, string_agg(distinct coalesce(item_id::varchar, ''), ',' order by coalesce(item_id::varchar, '')) as ids from hit group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join word using (r) left join named using (r)""",
}
