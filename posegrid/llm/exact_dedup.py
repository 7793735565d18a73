"""Exact deduplication on a persistent digest index.

The index is a Parquet table of one row per distinct normalised text, bucketed and sorted by the
SHA-256 of that text. A new batch is hashed, reduced to one row per digest before its shuffle, and
joined to the index by a sort-merge anti join, which reads the index in its bucket order: no shuffle
of it, and no sort either as long as each bucket is one file (``compact`` after many appends).
Digests that the index lacks are appended.

Defined results
  * null text counts as the empty text; empty texts are equal to each other;
  * every row has a row in the result; rows with equal id and equal text are kept or dropped
    together in the report, and a filter keeps one of them, the smallest as JSON;
  * rows with one id and different texts are different documents;
  * a null id is larger than every other id, so it stays only where a group has no other id;
  * ids may be of any type that has an order; an index has ids of one type;
  * an empty batch changes nothing and gives no rows;
  * columns beside id and text are never looked at; their names may clash with the result's.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posegrid.llm._common import Scratch, bounded, free_name

#: A group of at least this share of a batch's rows, and of HOT_ROWS rows, is joined by broadcast.
HOT_SHARE = 1 / 1000
HOT_ROWS = 1000
#: A bucket of an index is made for about this many digests.
BUCKET_ROWS = 2_000_000
LEAST_BUCKETS = 16
IN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def text_digest(text) -> F.Column:
    """SHA-256 (binary) of the text with each run of white space replaced by one space.

    A single space is such a run already, so only runs that change are matched.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")
    return F.unhex(F.sha2(plain, 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest"))


def buckets_for(rows: int) -> int:
    """A power of two, so that each bucket has about BUCKET_ROWS digests."""
    return max(LEAST_BUCKETS, 1 << max(0, -(-rows // BUCKET_ROWS) - 1).bit_length())


@contextmanager
def in_bucket_order(spark: SparkSession):
    """Plans made within know that a bucket of one file is sorted."""
    before = spark.conf.get(IN_ORDER, "false")
    spark.conf.set(IN_ORDER, "true")
    try:
        yield
    finally:
        spark.conf.set(IN_ORDER, before)


class DigestIndex:
    """A persistent set of digests at ``location``; it can be opened again by any later session."""

    def __init__(self, spark: SparkSession, location: str, buckets: int = 64, id_type: str = "bigint"):
        self.spark, self.location = spark, location.rstrip("/")
        spec = self._spec()
        if spec is None:
            spec = {"buckets": buckets, "id_type": id_type}
            spark.createDataFrame([(json.dumps(spec),)], "spec string").coalesce(1).write.text(f"{self.location}/spec")
        self.buckets, self.id_type = spec["buckets"], spec.get("id_type", "bigint")
        self.name = "digest_index_" + spark.range(1).select(F.md5(F.lit(self.location))).first()[0]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {self.id_type}, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}/data'"
        )

    def _spec(self) -> dict | None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.location}/spec")
        if not path.getFileSystem(conf).exists(path):
            return None
        return json.loads(self.spark.read.text(f"{self.location}/spec").first()[0])

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def close(self) -> None:
        """Take the table's name out of the catalog; the files stay, and the index can be opened again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups`` (one per digest) whose digest the index lacks."""
        return groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str = "") -> None:
        """Add (digest, keep_id) rows; each bucket gets one sorted file."""
        rows = groups.select("digest", F.col("keep_id").cast(self.id_type).alias("keep_id"), F.lit(batch).alias("batch"))
        with in_bucket_order(self.spark):
            rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)

    def compact(self, to: str) -> "DigestIndex":
        """A copy at ``to`` with one file a bucket, after many appends."""
        out = DigestIndex(self.spark, to, self.buckets, self.id_type)
        out.append(self.table().groupBy("digest").agg(F.min("keep_id").alias("keep_id")))
        return out


def deduplicate(docs: DataFrame, index: DigestIndex, scratch: Scratch, batch: str = "") -> DataFrame:
    """Append the batch's new texts to the index and tell what became of every document.

    One row per row: doc_id, keep_id, group_size (rows of this batch with that text), kept, digest
    (binary). ``keep_id`` is the id in the index, which for a text of an earlier batch is a document
    of that batch; then no row of this batch is kept.
    """
    batch = batch or uuid.uuid4().hex
    each = scratch.table(digests(docs), "digests")
    groups = scratch.table(each.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    index.append(index.unseen(groups), batch)
    # what the index says now; groups has the sizes
    entries = index.table().select("digest", "keep_id", (F.col("batch") == batch).alias("fresh")).hint("merge")
    with in_bucket_order(index.spark):
        known = scratch.table(groups.select("digest", "group_size").join(entries, "digest"), "known")
    total = each.count()
    limit = max(HOT_ROWS, int(total * HOT_SHARE))
    # at most total/limit <= 1000 digests are hot: a broadcast of a proven size takes those rows out of the shuffle
    hot = known.where(F.col("group_size") >= limit)
    cold = known.where(F.col("group_size") < limit)
    named = each.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left")
    keep = ["doc_id", "digest", "group_size", "keep_id", "fresh"]
    out = named.where("hot").select(keep).unionByName(named.where("hot is null").select("doc_id", "digest").join(cold, "digest").select(keep))
    kept = F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return scratch.table(out.withColumn("kept", kept).drop("fresh"), "decided")


def keep_first(docs: DataFrame, scratch: Scratch, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are."""
    spark = docs.sparkSession
    own = index is None
    index = index or DigestIndex(spark, scratch.path("index"), buckets_for(docs.count()), dict(docs.dtypes)["doc_id"])
    batch = uuid.uuid4().hex
    decided = deduplicate(docs.select("doc_id", "text"), index, scratch, batch)
    # more rows are kept than texts are new: a document that stays is there several times
    repeats = decided.where("kept").count() > index.table().where(F.col("batch") == batch).count()
    if own:
        index.close()
    digest, gone_id, gone_digest, row = (free_name(docs.columns, n) for n in ("text_digest", "gone_id", "gone_digest", "least_row"))
    pair = [F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_digest)]
    marked = docs.withColumn(digest, text_digest(F.col("text")))
    same = marked["doc_id"].eqNullSafe(F.col(gone_id)) & (marked[digest] == F.col(gone_digest))
    left = marked.join(bounded(decided.where(~F.col("kept")).select(*pair).distinct()), same, "left_anti")
    if repeats:
        # the smallest of the repeated rows stays; only those rows are shuffled
        twice = decided.where("kept").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select(*pair)
        twice = scratch.table(twice, "twice")
        once = left.join(bounded(twice), same, "left_anti")
        many = left.join(bounded(twice), same, "left_semi")
        every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        least = many.groupBy(digest, "doc_id").agg(F.min_by(every, F.to_json(every)).alias(row))
        left = once.select(*docs.columns).unionByName(least.select(f"{row}.*"))
    return left.select(*docs.columns)
