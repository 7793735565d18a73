"""Error-bounded key reduction of tracks.

A track keeps its ends and, as long as a segment's worst frame is off by more than the bound, that
frame too. Each segment's decision depends on its two ends alone, so the segments of one level are
split together: a level is one vectorised pass over the frames of the segments that are still open.
Tracks are dealt by their key and sorted, and a task takes its tracks one after the other from Arrow
batches, without a group's overhead; a track is bounded by a clip's length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame


def scalar_error(values: np.ndarray, a: np.ndarray, b: np.ndarray, u: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.abs(values[at, 0] - (values[a, 0] + u * (values[b, 0] - values[a, 0])))


def np_slerp(a: np.ndarray, b: np.ndarray, u: np.ndarray) -> np.ndarray:
    d = (a * b).sum(-1)
    b = np.where(d[:, None] < 0, -b, b)
    d = np.minimum(1.0, np.abs(d))
    theta = np.arccos(d)
    near = d > 0.9995
    s = np.where(near, 1.0, np.sin(theta))
    out = np.where(near, 1 - u, np.sin((1 - u) * theta) / s)[:, None] * a + np.where(near, u, np.sin(u * theta) / s)[:, None] * b
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def np_angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.degrees(2 * np.arccos(np.minimum(1.0, np.abs((a * b).sum(-1)))))


def rotation_error(values, a, b, u, at) -> np.ndarray:
    return np_angle(values[at], np_slerp(values[a], values[b], u))


def reduce_track(values: np.ndarray, bound: float, error) -> np.ndarray:
    """The kept frames of (frames, width) values."""
    n = len(values)
    every = np.arange(n)
    if n == 1 or (error(values, np.zeros(n, int), np.zeros(n, int), np.zeros(n), every) <= bound).all():
        return np.array([0])
    key = np.zeros(n, bool)
    key[[0, n - 1]] = True
    a, b = np.array([0]), np.array([n - 1])
    while True:
        wide = b - a > 1
        a, b = a[wide], b[wide]
        if not len(a):
            break
        # the inner frames of the open segments, one segment after the other
        size = b - a - 1
        first = np.cumsum(size) - size
        s = np.repeat(np.arange(len(a)), size)
        inner = np.arange(len(s)) - first[s] + a[s] + 1
        e = error(values, a[s], b[s], (inner - a[s]) / (b - a)[s], inner)
        worst = np.maximum.reduceat(e, first)
        split = worst > bound
        # the first of equally bad frames
        at = np.minimum.reduceat(np.where(e == worst[s], inner, n), first)[split]
        key[at] = True
        a, b = np.concatenate([a[split], at]), np.concatenate([at, b[split]])
    return np.flatnonzero(key)


def _tracks(tracks: DataFrame, keys: list[str], frame: str, cols: list[str], reduce) -> DataFrame:
    """(keys, frame, cols) of the rows that ``reduce`` keeps of each track, given its (frames, cols) values."""
    types = dict(tracks.dtypes)

    def run(batches):
        import pyarrow as pa

        def kept(rows: pa.RecordBatch, bounds) -> pa.RecordBatch:
            values = np.stack([np.asarray(rows.column(len(keys) + 1 + k), dtype=float) for k in range(len(cols))], 1)
            found = [reduce(values[i:j]) + i for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            return rows.take(pa.array(np.concatenate(found)))

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            new = np.zeros(rows.num_rows, bool)
            new[0] = True
            for k in range(len(keys)):
                new[1:] |= ~_same(rows.column(k))
            bounds = np.flatnonzero(new)
            # the last track may go on in the next batch
            held = rows.slice(int(bounds[-1]))
            if len(bounds) > 1:
                yield kept(rows, bounds)
        if held is not None:
            yield kept(held, np.array([0, held.num_rows]))

    names = [*keys, frame, *cols]
    ordered = tracks.select(*names).repartition(*keys).sortWithinPartitions(*keys, frame)
    return ordered.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in names))


def _same(column) -> np.ndarray:
    """Whether each value but the first is the one before it; nulls are equal."""
    codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return codes[1:] == codes[:-1]


def reduce_scalar_tracks(tracks: DataFrame, keys: list[str], fraction: float, frame: str = "frame", value: str = "v") -> DataFrame:
    """(keys, frame, value) of the kept frames; the bound is a share of each track's range."""
    return _tracks(tracks, keys, frame, [value], lambda v: reduce_track(v, max(float(np.ptp(v)) * fraction, 1e-12), scalar_error))


def reduce_rotation_tracks(tracks: DataFrame, keys: list[str], degrees: float, frame: str = "frame") -> DataFrame:
    """(keys, frame, qw..qz) of the kept frames."""
    return _tracks(tracks, keys, frame, ["qw", "qx", "qy", "qz"], lambda q: reduce_track(q, degrees, rotation_error))
