"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A benchmark item is cut into windows of ``size`` consecutive words (an item of fewer words is one
window). A window occurs in a document if its words stand there in a row. Seen as a set join, a
window's tokens are its shingles, and an occurrence must contain all of them; so of the tokens
ordered by rarity a prefix of one is necessary. The steps:

1. One pass over all documents counts how often each benchmark shingle occurs in them.
2. Each window keeps its rarest shingle and that shingle's offset in the window.
3. A second pass joins the documents' shingles with these prefixes by hash. A match at position p
   of a shingle with offset o can only be the window at p - o: that start must not be negative and
   the window must end within the document (positional and length bound). Then all words of the
   window are compared, so a hash collision changes nothing.

The prefixes are broadcast while they and their words take at most ``limit`` bytes (measured first);
then the document's words are at hand for step 3 and nothing of a document is shuffled. Beyond it,
(digest of the text, position, hash) rows are joined by shuffle, where the skew join splits a shingle
that many documents share, and the words come back by a join on the digest.

Defined results
  * null or wordless text has no words, no hits and is not contaminated;
  * an item without words has no window; equal windows of several items count for each of them;
  * every row is a document of its own and has a row in the report, whether its id repeats or is null;
  * the filter ``keep_clean`` judges each row by its own text, too;
  * a null item id is named "null";
  * without items, or without documents, nothing is contaminated;
  * further columns are not looked at, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posegrid.llm._common import BROADCAST_BYTES, Scratch, bounded, broadcast_bytes, free_name

SIZE = 13
SHINGLE = 5
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    low = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(low, NOT_WORD), "")


def windows(bench: DataFrame, size: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(wid, win, k) of distinct windows, and (wid, item) of the items that have them."""
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("words"))
    items = items.withColumn("n", F.size("words")).where("n > 0").withColumn("k", F.least("n", F.lit(size)))
    each = items.select("item", "k", "words", F.explode(F.sequence(F.lit(1), F.expr("n - k + 1"))).alias("at"))
    each = scratch.table(each.select("item", "k", F.expr("slice(words, at, k)").alias("win")).distinct(), "windows")
    distinct = scratch.table(each.select("win", "k").distinct().withColumn("wid", F.monotonically_increasing_id()), "distinct")
    return distinct, each.join(distinct.select("wid", "win"), "win").select("wid", "item")


def _hash(array: str, at: str, m: int) -> Column:
    return F.xxhash64(*[F.expr(f"get({array}, {at} + {i})") for i in range(m)])


def _positions(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """Every shingle of every document: the columns of ``docs``, pos, m (its words) and h."""
    at = docs.withColumn("pos", F.explode(F.expr("CASE WHEN n > 0 THEN sequence(0, n - 1) ELSE array() END")))
    if len(lengths) == 1:
        out = at.withColumn("m", F.lit(lengths[0])).withColumn("h", _hash("words", "pos", lengths[0]))
    else:
        each = F.array(*[F.struct(F.lit(m).alias("m"), _hash("words", "pos", m).alias("h")) for m in lengths])
        out = at.withColumn("s", F.explode(each)).select(*at.columns, "s.m", "s.h")
    return out.where("pos + m <= n")


def occurrences(docs: DataFrame, wins: DataFrame, scratch: Scratch, shingle: int = SHINGLE, limit: int = BROADCAST_BYTES):
    """(row, doc_id, n, start, wid, k): every occurrence of a window; and one without wid for each row of ``docs``."""
    digest = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", digest.alias("digest"), words(F.col("text")).alias("words"))
    docs = docs.withColumn("n", F.size("words"))
    lengths = sorted(r[0] for r in wins.select(F.least("k", F.lit(shingle))).distinct().collect())  # 1 to ``shingle``
    plain = docs.select("row", "doc_id", "n", F.lit(None).cast("int").alias("start"), F.lit(None).cast("long").alias("wid"), F.lit(None).cast("int").alias("k"))
    if not lengths:
        return scratch.table(plain, "occurrences")

    parts = wins.withColumn("m", F.least("k", F.lit(shingle))).withColumn("o", F.explode(F.expr("sequence(0, k - m)")))
    by_m = reduce(lambda c, m: c.when(F.col("m") == m, _hash("win", "o", m)), lengths[1:], F.when(F.col("m") == lengths[0], _hash("win", "o", lengths[0])))
    parts = scratch.table(parts.withColumn("h", by_m).select("wid", "o", "m", "h"), "shingles")
    distinct = parts.select("h", "m").distinct()
    seen = _positions(docs.select("words", "n"), lengths).select("h", "m").join(bounded(distinct, limit=limit), ["h", "m"])
    counts = scratch.table(seen.groupBy("h", "m").agg(F.count("*").alias("df")), "rarity")
    # a window with a shingle that occurs nowhere can't occur: its prefix never matches
    ranked = parts.join(counts, ["h", "m"], "left").groupBy("wid").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "o", "m")).alias("p")
    )
    prefix = scratch.table(
        ranked.where("p.df > 0").select("wid", "p.h", "p.o", "p.m").join(wins, "wid"), "prefixes"
    )
    bounds = "start >= 0 AND start + k <= n"
    same = "slice(words, greatest(start, 0) + 1, k) = win"
    if broadcast_bytes(prefix) <= limit:
        # a row at position -1 stands for the document itself
        at = docs.drop("digest").withColumn("pos", F.explode(F.expr("sequence(-1, n - 1)")))
        if len(lengths) == 1:
            at = at.withColumn("m", F.lit(lengths[0])).withColumn("h", _hash("words", "pos", lengths[0]))
        else:
            each = F.array(*[F.struct(F.lit(m).alias("m"), _hash("words", "pos", m).alias("h")) for m in lengths])
            at = at.withColumn("s", F.explode(each)).select("row", "doc_id", "words", "n", "pos", "s.m", "s.h")
        p = F.broadcast(prefix.select("wid", F.col("h").alias("ph"), "o", F.col("m").alias("pm"), "k", "win"))
        start = "(pos - o)"
        on = F.expr(f"h = ph AND m = pm AND pos >= 0 AND {bounds} AND {same}".replace("start", start))
        found = at.join(p, on, "left").where("wid IS NOT NULL OR pos = -1")
        found = found.select("row", "doc_id", "n", F.expr(f"CASE WHEN wid IS NOT NULL THEN {start} END").alias("start"), "wid", "k")
        return scratch.table(found, "occurrences")
    at = _positions(docs.select("digest", "words", "n"), lengths).select("digest", "n", "pos", "m", "h")
    near = at.join(prefix.select("wid", "h", "o", "m", "k", "win"), ["h", "m"]).withColumn("start", F.expr("pos - o")).where(bounds)
    near = near.select("digest", "start", "wid", "k", "win").distinct()
    found = docs.join(near, "digest").where(f"{bounds} AND {same}")
    return scratch.table(plain.unionByName(found.select("row", "doc_id", "n", "start", "wid", "k")), "occurrences")


def contamination(docs: DataFrame, bench: DataFrame, scratch: Scratch, size: int = SIZE, shingle: int = SHINGLE, share: int = 20, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated.

    A document is contaminated if at least one of ``share`` of its words lies in a window's occurrence.
    """
    from pyspark.sql import Window

    wins, of = windows(bench, size, scratch)
    found = occurrences(docs.select("doc_id", "text"), wins, scratch, shingle, limit)
    hits = found.where("wid IS NOT NULL")
    none = {"n_words": "int", "covered": "long", "item": "string"}
    rows = lambda df, *have: df.select("row", "doc_id", *[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in none.items()])
    # a row is one text, so neither a repeated nor a null id makes a large group
    order = Window.partitionBy("row").orderBy("start", "k").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("row", "doc_id", "start", "k").distinct().withColumn("before", F.max(F.expr("start + k")).over(order))
    spans = spans.withColumn("covered", F.expr("greatest(0, start + k - greatest(start, coalesce(before, start)))"))
    covered = spans.groupBy("row", "doc_id").agg(F.sum("covered").alias("covered"))
    named = hits.select("row", "doc_id", "wid").distinct().join(bounded(of, limit=limit), "wid").select("row", "doc_id", "item").distinct()
    every = rows(found.where("wid IS NULL").withColumnRenamed("n", "n_words"), "n_words")
    every = every.unionByName(rows(covered, "covered")).unionByName(rows(named, "item"))
    out = every.groupBy("row", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.coalesce(F.sum("covered"), F.lit(0)).cast("long").alias("n_hit"),
        F.sort_array(F.collect_list("item")).alias("items"),
    )
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        F.expr(f"n_hit > 0 AND {share} * n_hit >= n_words").alias("contaminated"),
    )


def keep_clean(docs: DataFrame, bench: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns as they are."""
    # a text is known by its digest, so that rows that share an id, or have none, are judged one by one
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    name = free_name(docs.columns, "gone_digest")
    found = contamination(docs.select(digest.alias("doc_id"), "text"), bench, scratch).where("contaminated")
    found = scratch.table(found.select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.join(bounded(found), digest == F.col(name), "left_anti")
