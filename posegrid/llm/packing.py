"""Packing into optimal length buckets and token-budget batches.

1. One pass counts each document's units (words between white space, unless a length column is
   given) and reduces them to a global histogram: exact up to 131,071 units, then 65,536 steps an
   octave, so that it has a bounded number of bins however long documents get. A bin knows its
   count, its sum and its longest document. A boundary is off by less than 1/65,536 of its length.
2. A dynamic programme over the histogram finds the boundaries of at most ``buckets`` buckets with
   the least padding in all; each layer is solved in linear time by the lower envelope of lines.
3. In a bucket with boundary L a batch holds up to max(1, budget // L) documents. Buckets are cut
   into shards of about SHARD documents by a hash of the row's number, so that no bucket, no id
   and no group of equal rows is ordered in one task; within a shard documents are ordered by length
   and id and cut into batches. A shard has at most one batch that is not full.

Defined results
  * null and empty texts have length 0; a bucket of boundary 0 holds only those;
  * a document longer than the budget is a batch by itself;
  * rows that repeat an id are packed one by one; a null id is an id like any other;
  * without documents the result is empty; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posegrid.llm._common import Scratch

BUCKETS = 16
BUDGET = 16_384
EXACT_BITS = 17
SHARD = 20_000


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def bin_of(length: Column) -> Column:
    """The upper end of the histogram's bin that a length falls into."""
    shift = F.greatest(F.lit(0), F.length(F.bin(length)) - EXACT_BITS)
    step = F.pow(F.lit(2), shift).cast("long")
    return F.floor((length + step - 1) / step).cast("long") * step


def boundaries(tops: list[int], counts: list[int], sums: list[int], buckets: int) -> list[int]:
    """The boundaries with least padding; ``tops``: each bin's longest document, ascending."""
    n = len(tops)
    total, units = [0], [0]
    for c, s in zip(counts, sums, strict=True):
        total.append(total[-1] + c)
        units.append(units[-1] + s)
    inf = float("inf")
    # best[j]: least padding of the first j bins; padding of bins i..j is tops[j] * documents - units
    best, choice = [0] + [inf] * n, []
    for _ in range(min(buckets, n)):
        now, back, hull = [0] + [inf] * n, [0] * (n + 1), []
        at = 0
        for j in range(1, n + 1):
            i = j - 1
            if best[i] < inf:
                # the line of a bucket that starts after bin i: slope -total[i], height best[i] + units[i]
                line = (-total[i], best[i] + units[i], i)
                while len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - line[0]) >= (line[1] - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append(line)
                at = min(at, len(hull) - 1)
            if hull:
                x = tops[j - 1]
                while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                    at += 1
                now[j], back[j] = hull[at][0] * x + hull[at][1] + x * total[j] - units[j], hull[at][2]
        choice.append(back)
        best = now
    out, j = [], n
    for back in reversed(choice):
        if j:
            out.append(tops[j - 1])
            j = back[j]
    return out[::-1]


def pack(
    docs: DataFrame, scratch: Scratch, buckets: int = BUCKETS, budget: int = BUDGET, shard: int = SHARD, length: Column | None = None
) -> DataFrame:
    """Per document: doc_id, n_units, bucket, boundary, shard, batch, slot. A batch is (bucket, shard, batch)."""
    units = n_words(F.col("text")) if length is None else F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long")
    sized = scratch.table(docs.select("doc_id", units.alias("n_units"), F.monotonically_increasing_id().alias("row")), "lengths")
    hist = sized.groupBy(bin_of(F.col("n_units")).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("n_units").alias("s"), F.max("n_units").alias("top")
    )
    rows = sorted(hist.collect(), key=lambda r: r["bin"])  # at most 131,072 bins and 65,536 an octave
    cuts = boundaries([r["top"] for r in rows], [r["n"] for r in rows], [r["s"] for r in rows], buckets)
    counts = [0] * len(cuts)
    for r in rows:
        counts[bisect_left(cuts, r["top"])] += r["n"]
    if not cuts:
        cuts, counts = [0], [0]
    of = F.lit(len(cuts) - 1)
    for k in range(len(cuts) - 2, -1, -1):
        of = F.when(F.col("n_units") <= cuts[k], F.lit(k)).otherwise(of)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("bucket") + 1)
    placed = sized.withColumn("bucket", of).withColumn("boundary", pick(cuts).cast("long"))
    shards = [max(1, -(-n // shard)) for n in counts]
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("row"), pick(shards)).cast("int"))
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("n_units", "doc_id", "row")) - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), "boundary"))).cast("long")
    out = placed.withColumn("rank", rank).withColumn("room", room)
    return out.select(
        "doc_id", "n_units", "bucket", "boundary", "shard",
        F.floor(F.col("rank") / F.col("room")).cast("long").alias("batch"), (F.col("rank") % F.col("room")).cast("int").alias("slot"),
    )
