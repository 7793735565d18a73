"""Hierarchies of joints.

A pose is one row with flat arrays, so a walk from the root down needs no shuffle: batches of
poses go through NumPy joint by joint, all frames of a batch at once. A skeleton is a table of a few
hundred rows at most and is passed as arrays.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def np_multiply(a, b):
    aw, ax, ay, az = np.moveaxis(a, -1, 0)
    bw, bx, by, bz = np.moveaxis(b, -1, 0)
    return np.stack(
        [aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw], -1
    )


def np_rotate(q, v):
    w, u = q[..., :1], q[..., 1:]
    t = 2 * np.cross(u, v)
    return v + w * t + np.cross(u, t)


def np_conjugate(q):
    return q * np.array([1.0, -1.0, -1.0, -1.0])


def walk(parents: list[int], rotations: np.ndarray, translations: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Global rotations (F, J, 4) and positions (F, J, 3) from local ones; parents come before children."""
    g, p = np.empty_like(rotations), np.empty_like(translations)
    for j, parent in enumerate(parents):
        if parent < 0:
            g[:, j], p[:, j] = rotations[:, j], translations[:, j]
        else:
            g[:, j] = np_multiply(g[:, parent], rotations[:, j])
            p[:, j] = p[:, parent] + np_rotate(g[:, parent], translations[:, j])
    return g, p


def flat(column, width: int) -> np.ndarray:
    """An Arrow list column of numbers as (rows, n, width)."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1, width)


def forward_kinematics(poses: DataFrame, parents: list[int], offsets: list[Iterable[float]], keys=("clip", "frame")) -> DataFrame:
    """(keys, joint, gw..gz, x, y, z) from rows with ``rotations`` (4 numbers a joint, unit quaternions).

    ``translations`` (3 numbers a joint) are used if the column is there, else the rest offsets.
    """
    moving = "translations" in poses.columns
    rest = np.array([list(o) for o in offsets], float)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            r = flat(b.column(len(keys)), 4)
            t = flat(b.column(len(keys) + 1), 3) if moving else np.broadcast_to(rest, (len(r), *rest.shape)).copy()
            g, p = walk(parents, r, t)
            n = len(parents)
            at = pa.array(np.repeat(np.arange(len(r)), n))
            cols = [c.take(at) for c in b.columns[: len(keys)]] + [pa.array(np.tile(np.arange(n, dtype=np.int32), len(r)))]
            cols += [pa.array(g[..., k].ravel()) for k in range(4)] + [pa.array(p[..., k].ravel()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "joint", *"gw gx gy gz x y z".split()])

    types = dict(poses.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "joint int", *(f"{c} double" for c in "gw gx gy gz x y z".split())])
    return poses.select(*keys, "rotations", *(["translations"] if moving else [])).mapInArrow(run, schema)


def global_positions(poses: DataFrame, parents: list[int], offsets: list[Iterable[float]], keys=("clip", "frame")) -> DataFrame:
    """(keys, positions): global positions as one flat array a pose, 3 numbers a joint."""
    moving = "translations" in poses.columns
    rest = np.array([list(o) for o in offsets], float)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            r = flat(b.column(len(keys)), 4)
            t = flat(b.column(len(keys) + 1), 3) if moving else np.broadcast_to(rest, (len(r), *rest.shape)).copy()
            _, p = walk(parents, r, t)
            out = pa.ListArray.from_arrays(np.arange(0, p.size + 1, p[0].size, dtype=np.int32), p.ravel())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], out], names=[*keys, "positions"])

    types = dict(poses.dtypes)
    return poses.select(*keys, "rotations", *(["translations"] if moving else [])).mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", positions array<double>")


def ancestors(spark, joints: DataFrame, levels: int = 100) -> DataFrame:
    """(joint, ancestor, depth) of every joint and itself, by a recursive query; skeletons are small."""
    joints.createOrReplaceTempView("skeleton_joint")
    return spark.sql(
        f"""WITH RECURSIVE up MAX RECURSION LEVEL {levels} AS (
              SELECT joint, joint AS ancestor, parent AS next, 0 AS depth FROM skeleton_joint
              UNION ALL
              SELECT u.joint, s.joint, s.parent, u.depth + 1 FROM up u JOIN skeleton_joint s ON s.joint = u.next)
            SELECT joint, ancestor, depth FROM up"""
    )


def rest_positions(spark, joints: DataFrame) -> DataFrame:
    """(joint, x, y, z, length): where a joint rests, and the bones' length from the root (its own offset not counted)."""
    bone = joints.select(F.col("joint").alias("ancestor"), "parent", "ox", "oy", "oz", F.sqrt(F.expr("ox*ox+oy*oy+oz*oz")).alias("bone"))
    chain = ancestors(spark, joints).join(F.broadcast(bone), "ancestor")  # a skeleton's joints
    return chain.groupBy("joint").agg(*[F.sum("o" + c).alias(c) for c in "xyz"], F.sum(F.when(F.col("parent") >= 0, F.col("bone")).otherwise(0.0)).alias("length"))


def skeleton_height(spark, joints: DataFrame, up: str = "y") -> DataFrame:
    """(height): head chain and mean foot chain; else the extent along ``up`` with end sites; else the longest distance from the root.

    End sites are columns ex, ey, ez of ``joints``, null where a joint has none.
    """
    from posegrid.functions.names import meaning

    end = F.col("e" + up) if "e" + up in joints.columns else F.lit(None).cast("double")
    rest = rest_positions(spark, joints).join(joints.select("joint", "name", "parent", end.alias("end")), "joint").withColumn("what", meaning(F.col("name")))
    # of joints that mean the same the last counts
    last = lambda what: F.max_by(F.when(F.col("what") == what, F.col("length")), F.when(F.col("what") == what, F.col("joint")))
    head, left, right = last("head"), last("left_foot"), last("right_foot")
    feet = F.coalesce((left + right) / 2, left, right)
    root = lambda c: F.max(F.when(F.col("parent") < 0, F.col(c))).over(Window.partitionBy())  # noqa: E731  a skeleton's joints
    rest = rest.withColumn("away", F.sqrt(sum(((F.col(c) - root(c)) ** 2 for c in "yz"), (F.col("x") - root("x")) ** 2)))
    tip = F.col(up) + F.coalesce("end", F.lit(0.0))
    human, extent, away = head + feet, F.max(F.greatest(F.col(up), tip)) - F.min(F.least(F.col(up), tip)), F.max("away")
    return rest.agg(F.when(human > 1e-8, human).when(extent > 1e-8, extent).otherwise(away).alias("height"))
