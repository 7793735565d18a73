"""Array archives of positions; pickled objects are refused."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def loads(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as f:
        return {k: f[k] for k in f.files}


def dumps(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def positions(files: DataFrame) -> DataFrame:
    """(path, frame, joint, x, y, z) from (path, content) rows."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                p = loads(content.as_py())["positions"].astype(float)
                f, j = p.shape[:2]
                cols = [pa.array([path.as_py()] * (f * j)), pa.array(np.repeat(np.arange(f, dtype=np.int32), j)), pa.array(np.tile(np.arange(j, dtype=np.int32), f))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(p[..., k].ravel()) for k in range(3))], names=["path", "frame", "joint", "x", "y", "z"])

    return files.select("path", "content").mapInArrow(run, "path string, frame int, joint int, x double, y double, z double")


def read(spark: SparkSession, path: str) -> DataFrame:
    return positions(spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path))
