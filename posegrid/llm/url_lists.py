"""Temporal URL lists, in DataFrame operations only: every capture is judged by the entries of its time.

List entries (pattern, action, since) are dated changes: from ``since`` on the pattern is blocked,
allowed, or (``drop``) no longer listed. They become validity intervals [since, until). A pattern
is a domain (``example.org``: it and its subdomains) or a domain and a path (``example.org/a/b``:
that path and what lies below). A capture gives one key for each domain suffix of its host and
for each path prefix, as far as the list has keys of that many labels and of that depth; so a top-level domain,
which every host has, makes no key unless it is listed. The as-of join is an equality join on (key,
month) with the interval's bounds as a condition; an interval stands in each month that it
touches, up to the last capture. So a key's captures never meet all of its history, a key of many
captures is split by month, and further by the skew join; a list of a checked size is broadcast.
Of a capture's matches the most specific decides: the longest path, then the longest domain.

Defined results
  * captures without a url, a host or a time match nothing and are not blocked;
  * entries without pattern, action or time are no entries; of several entries of a pattern with
    the same time, ``block`` wins over ``allow`` over ``drop``;
  * hosts and domains are compared in lower case, without a trailing dot; paths as they are; an
    address in brackets is one label;
  * repeated captures are judged once; an empty list blocks nothing; no captures give no rows;
  * further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posegrid.llm._common import Scratch, bounded

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)"
ACTIONS = ("drop", "allow", "block")


def host_of(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), F.lit("."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def month_of(time: Column) -> Column:
    return F.year(time) * 12 + F.month(time)


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until) from dated entries; ``until`` is null while an entry is in force."""
    text = F.col("pattern")
    domain = F.rtrim(F.lower(F.substring_index(text, "/", 1)), F.lit("."))
    path = F.rtrim(F.substr(text, F.length(F.substring_index(text, "/", 1)) + 1), F.lit("/"))
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    rows = entries.where("pattern IS NOT NULL AND since IS NOT NULL").where(F.col("action").isin(*ACTIONS))
    rows = rows.select(F.concat(domain, path).alias("key"), F.col("since").cast("timestamp").alias("since"), rank.alias("rank"))
    rows = rows.groupBy("key", "since").agg(F.max("rank").alias("rank"))  # a row a pattern and moment
    order = Window.partitionBy("key").orderBy("since")
    rows = rows.withColumn("until", F.lead("since").over(order))
    return rows.where("rank > 1").select("key", F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("rank").cast("int")).alias("action"), "since", "until")


def keys_of(host: Column, path: Column, sizes: list[int], depth: int) -> Column:
    """Candidate keys: the domain suffixes of ``sizes`` labels, then the path prefixes of up to ``depth`` parts below each."""
    labels = F.split(host, r"\.")
    at = F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n <= F.size(labels))
    suffixes = F.transform(at, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    if not depth:
        return F.when(host != "", suffixes).otherwise(F.array().cast("array<string>"))
    parts = F.filter(F.slice(F.split(path, "/"), 2, depth), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    prefixes = F.when(F.size(parts) > 0, prefixes).otherwise(F.array().cast("array<string>"))
    below = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(host != "", F.concat(suffixes, below)).otherwise(F.array().cast("array<string>"))


def judge(captures: DataFrame, entries: DataFrame, scratch: Scratch) -> DataFrame:
    """Per capture (page_id, url, fetched): host, blocked, rule, rule_since. ``rule`` is null where nothing matches."""
    spans = scratch.table(intervals(entries), "intervals")
    seen = captures.select("page_id", F.col("url").cast("string").alias("url"), F.col("fetched").cast("timestamp").alias("fetched")).distinct()
    seen = scratch.table(seen.withColumn("host", host_of(F.col("url"))), "captures")
    last = seen.agg(F.max("fetched")).first()[0]
    domain = F.substring_index("key", "/", 1)
    # how deep the list's paths are, and how many labels its domains have: names have 127 at most
    shape = spans.agg(F.max(F.size(F.split("key", "/")) - 1), F.sort_array(F.collect_set(F.size(F.split(domain, r"\.")))))
    depth, sizes = shape.first()
    none = seen.withColumns({"key": F.lit(None).cast("string"), "action": F.lit(None).cast("string"), "since": F.lit(None).cast("timestamp")})
    if last is None or not sizes:
        found = none
    else:
        end = F.least(F.coalesce("until", F.lit(last)), F.lit(last))
        months = spans.where(F.col("since") <= F.lit(last)).withColumn("month", F.explode(F.sequence(month_of(F.col("since")), month_of(end))))
        keyed = seen.where("fetched IS NOT NULL").withColumn("key", F.explode(keys_of(F.col("host"), path_of(F.col("url")), sizes, depth)))
        keyed = keyed.withColumn("month", month_of(F.col("fetched")))
        hit = keyed.join(bounded(months), ["key", "month"]).where("since <= fetched AND (until IS NULL OR fetched < until)")
        found = none.unionByName(hit.select(*none.columns))
    # the path counts first, then the domain: a longer key of the same host is always more specific
    slash = F.instr("key", "/")
    rule = F.struct(
        F.when(slash > 0, F.length("key") - slash + 1).otherwise(0).alias("path"), F.length("key").alias("size"),
        F.col("key").alias("key"), F.col("action").alias("action"), F.col("since").alias("since"),
    )
    best = found.groupBy("page_id", "url", "fetched", "host").agg(F.max(F.when(F.col("key").isNotNull(), rule)).alias("r"))
    return best.select(
        "page_id", "url", "fetched", "host", F.coalesce(F.col("r.action") == "block", F.lit(False)).alias("blocked"),
        F.col("r.key").alias("rule"), F.col("r.since").alias("rule_since"),
    )
