"""Connected components of a graph kept in tables, by hooking and pointer jumping.

Each round every root with a smaller neighbour hooks to the smallest of them, pointers are jumped
until they are flat, and edges are renamed to roots; edges within a component go. A component
loses at least half of its roots that still have a smaller neighbour each round, so the number of
rounds grows with the logarithm of the nodes. All tables are written to the shared folder; nothing
is collected but counts. Each round costs several jobs: a graph of at most ONE_TASK rows, counted first,
is joined by one task in one job instead; its result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posegrid.llm._common import Scratch, bounded

#: Rows (edges and known labels) of a graph that one task joins: some 100 MB there.
ONE_TASK = 1_000_000


def flatten(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) from (id, parent) with parent < id: pointer jumping to the roots."""
    now = scratch.table(parents.select("id", F.col("parent").alias("root")), "pointers")
    n = now.count()
    while n:
        up = now.select(F.col("id").alias("root"), F.col("root").alias("up"))
        after = scratch.table(
            now.join(bounded(up, n), "root", "left").select("id", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "pointers"
        )
        moved = after.where("moved").limit(1).count()
        now = after.select("id", "root")
        if not moved:
            break
    return now


def hook(labels: DataFrame, edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """One round: labels (id, root) of all that are not their own root, and edges (a, b) between roots."""
    least = edges.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("parent")).groupBy("id").agg(F.min("parent").alias("parent"))
    moved = flatten(least, scratch)
    n = moved.count()
    few = bounded(moved.select(F.col("id").alias("root"), F.col("root").alias("up")), n)
    labels = scratch.table(
        labels.join(few, "root", "left").select("id", F.coalesce("up", "root").alias("root")).unionByName(
            moved.join(labels.select("id"), "id", "left_anti")
        ),
        "labels",
    )
    return labels, relabel(edges, moved, scratch, n)


def relabel(edges: DataFrame, labels: DataFrame, scratch: Scratch, n: int | None = None) -> DataFrame:
    """The edges between the roots of ``labels``, without those inside a component."""
    few = bounded(labels, n)
    for c in ("a", "b"):
        named = few.select(F.col("id").alias(c), F.col("root").alias("__root"))
        edges = edges.join(named, c, "left").withColumn(c, F.coalesce("__root", c)).drop("__root")
    return scratch.table(edges.where("a <> b").distinct(), "edges")


def in_one_task(edges: DataFrame) -> DataFrame:
    """(id, root) of every node that is not the smallest of its component. ``edges``: (a, b), a checked number of rows."""

    def run(batches):
        import pyarrow as pa

        up: dict[int, int] = {}

        def root(i: int) -> int:
            while (j := up.get(i, i)) != i:
                up[i] = up.get(j, j)
                i = j
            return i

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        ids = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(i) for i in ids], pa.int64())], names=["id", "root"])

    return edges.coalesce(1).mapInArrow(run, "id long, root long")


def components(edges: DataFrame, scratch: Scratch, labels: DataFrame | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """(id, root) of every node that is not the smallest of its component. ``edges``: (a, b).

    ``labels``: what is known already, in the same form.
    """
    edges = scratch.table(edges.select("a", "b"), "edges")
    known = labels.select(F.col("id").alias("a"), F.col("root").alias("b")) if labels is not None else None
    if edges.count() + (0 if known is None else known.count()) <= one_task:
        return scratch.table(in_one_task(edges if known is None else edges.unionByName(known)), "labels")
    if labels is None:
        labels = edges.select(F.col("a").alias("id"), F.col("a").alias("root")).limit(0)
        edges = scratch.table(edges.where("a <> b").distinct(), "edges")
    else:
        edges = relabel(edges, labels, scratch)
    while edges.limit(1).count():
        labels, edges = hook(labels, edges, scratch)
    return labels
