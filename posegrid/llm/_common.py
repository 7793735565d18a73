"""Shared pieces of the training-data operators: scratch tables, bounded broadcasts, free names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side of a join is broadcast; its rows, and the bytes of its texts, are always counted first.
BROADCAST_BYTES = 48 << 20
#: What a row and a column of a fixed width take in a broadcast, at most.
ROW_BYTES, COLUMN_BYTES = 16, 8

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]"


class Scratch:
    """Written tables in the folder that all executors share.

    The folder is ``spark.checkpoint.dir`` of the session. Where that is unset and the session is
    local, as in tests, one temporary folder a session is made; on a cluster that is an error. A
    table that was written is read back from the store, so that a lost executor never makes an
    earlier step run again. ``drop`` deletes tables that no later step reads.
    """

    _own: dict[str, str] = {}

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            app = spark.sparkContext.applicationId
            base = self._own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="posegrid-"))
        self.root = f"{base.rstrip('/')}/posegrid/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._at: dict[int, tuple[DataFrame, str]] = {}

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the written table."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._at[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            _, path = self._at.pop(id(table), (None, None))
            if path:
                self.delete(path)

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _width(name: str, kind: T.DataType) -> tuple[int, Column | None]:
    """The bytes of a column of a fixed width, and what measures one without."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return COLUMN_BYTES, F.octet_length(c)
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
        return COLUMN_BYTES, F.greatest(F.lit(0), F.size(c)) * 8
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return COLUMN_BYTES, F.octet_length(F.to_json(F.struct(c)))
    return COLUMN_BYTES, None


def broadcast_bytes(df: DataFrame, rows: int | None = None) -> int:
    """An upper estimate of a broadcast of ``df``; one aggregation, or none if ``rows`` is known and no column varies."""
    widths = [_width(f.name, f.dataType) for f in df.schema.fields]
    fixed, sizes = ROW_BYTES + sum(w for w, _ in widths), [c for _, c in widths if c is not None]
    if rows is not None and not sizes:
        return rows * fixed
    each = sum((F.coalesce(c.cast("long"), F.lit(0)) for c in sizes), F.lit(0).cast("long"))
    n, extra = df.agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return n * fixed + extra


def bounded(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for a broadcast if it has at most ``limit`` bytes; else leave the join to shuffle.

    ``rows``: the count, if it is known already.
    """
    return F.broadcast(df) if broadcast_bytes(df, rows) <= limit else df


def free_name(df_columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front as long as a column has that name (in any case)."""
    taken = {c.lower() for c in df_columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
