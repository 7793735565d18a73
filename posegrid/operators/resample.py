"""Samples of clips by frame and by time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posegrid.operators.hierarchy import flat
from posegrid.operators.keys import np_slerp


def clip_time(t: Column, frames: Column, frame_time: float, loop: bool) -> Column:
    """Time within the clip: wrapped into its duration, or held at its ends. A clip of one frame holds."""
    d = (frames - 1) * F.lit(frame_time)
    held = F.least(F.greatest(t, F.lit(0.0)), d)
    return F.when(d > 0, t - d * F.floor(t / F.when(d > 0, d).otherwise(1.0))).otherwise(held) if loop else held


def bracket(samples: DataFrame, frame_time: float, loop: bool) -> DataFrame:
    """``samples`` (clip, t, n: the clip's frames) with frame, next and share."""
    at = samples.withColumn("at", clip_time(F.col("t"), F.col("n"), frame_time, loop) / frame_time)
    at = at.withColumn("frame", F.least(F.floor("at"), F.col("n") - 1).cast("int"))
    return at.withColumn("next", F.least(F.col("frame") + 1, F.col("n") - 1).cast("int")).withColumn("share", F.col("at") - F.col("frame")).drop("at")


def with_next(track: DataFrame, values: list[str]) -> DataFrame:
    """Each frame with the values of the next one (``<value>_next``), the last with its own."""
    after = Window.partitionBy("clip").orderBy("frame")
    return track.withColumns({f"{v}_next": F.coalesce(F.lead(v).over(after), F.col(v)) for v in values})


def sample_scalars(samples: DataFrame, track: DataFrame, frame_time: float, loop: bool) -> DataFrame:
    """Linear values at the samples' times: frames know the next one, so one equality join on (clip, frame) will do."""
    at = bracket(samples, frame_time, loop)
    both = with_next(track.select("clip", "frame", F.col("v").alias("va")), ["va"]).withColumnRenamed("va_next", "vb")
    return at.join(both, ["clip", "frame"]).withColumn("value", F.col("va") + F.col("share") * (F.col("vb") - F.col("va")))


def sample_poses(samples: DataFrame, poses: DataFrame, frame_time: float, loop: bool, keys=("sample",), profile=None) -> DataFrame:
    """(keys, rotations, translations) at the samples' times: slerp along the shorter arc, linear translations.

    ``samples``: keys, clip, t, n; ``poses``: clip, frame, rotations, translations. With a retarget
    ``profile`` the sampled pose is carried over to its target, in the same pass.
    """
    at = bracket(samples, frame_time, loop)
    both = with_next(poses.select("clip", "frame", "rotations", "translations"), ["rotations", "translations"])
    rows = at.join(both, ["clip", "frame"]).select(*keys, "share", "rotations", "rotations_next", "translations", "translations_next")

    def run(batches):
        import pyarrow as pa

        n = len(keys)
        for b in batches:
            if not b.num_rows:
                continue
            q, q2, p, p2 = (flat(b.column(n + 1 + k), w) for k, w in enumerate((4, 4, 3, 3)))
            share = np.repeat(np.asarray(b.column(n)), q.shape[1])
            q = np_slerp(q.reshape(-1, 4), q2.reshape(-1, 4), share).reshape(q.shape)
            p = p + np.asarray(b.column(n))[:, None, None] * (p2 - p)
            if profile is not None:
                q, p = profile.run(q, p)
            lists = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x[0].size, dtype=np.int32), x.ravel()) for x in (q, p)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *lists], names=[*keys, "rotations", "translations"])

    types = dict(samples.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", rotations array<double>, translations array<double>"
    return rows.mapInArrow(run, schema)


def sample_frames(samples: DataFrame, poses: DataFrame) -> DataFrame:
    """The poses of ``samples`` (clip, frame, ...); a frame that a clip does not have gives no row."""
    return samples.join(poses.select("clip", "frame", "rotations", "translations"), ["clip", "frame"])
