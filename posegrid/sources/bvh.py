"""Motion text files: a hierarchy of joints, then a row of channel values for each frame."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from posegrid.operators.hierarchy import np_multiply
from posegrid.sources.clip import AXES, Clip, ClipError, Rig

TOKEN = re.compile(r"[{}]|[^\s{}]+")
SMALL = 5e-12


def axis_turn(axis: str, angle: np.ndarray) -> np.ndarray:
    q = np.zeros((*angle.shape, 4))
    q[..., 0], q[..., 1 + AXES[axis]] = np.cos(angle / 2), np.sin(angle / 2)
    return q


def loads(text: str) -> Clip:
    """Read a motion text; whatever breaks the format raises a ``ClipError``."""
    head, mark, body = text.lstrip("﻿").partition("MOTION")
    if not mark:
        raise ClipError("no MOTION section")
    names, parents, offsets, channels, ends = [], [], [], [], []
    # the open blocks: a joint's number, or None for an end site
    stack: list[int | None] = []
    words = iter(TOKEN.findall(head))

    def numbers(n: int) -> list[float]:
        try:
            out = [float(next(words)) for _ in range(n)]
        except (ValueError, StopIteration) as e:
            raise ClipError("a number is missing") from e
        if not np.isfinite(out).all():
            raise ClipError("a value is not finite")
        return out

    if next(words, "") != "HIERARCHY":
        raise ClipError("no HIERARCHY section")
    for word in words:
        if word in ("ROOT", "JOINT"):
            if (word == "ROOT") == bool(names) or (names and (not stack or stack[-1] is None)):
                raise ClipError(f"{word} stands in a wrong place")
            parents.append(stack[-1] if stack else -1)
            names.append(next(words, ""))
            offsets.append(None), channels.append(None), ends.append(None)
            opened: int | None = len(names) - 1
        elif word == "End":
            if next(words, "") != "Site" or not stack or stack[-1] is None or ends[stack[-1]] is not None:
                raise ClipError("an end site stands in a wrong place")
            opened = None
        elif word == "{":
            stack.append(opened)
        elif word == "}":
            if not stack:
                raise ClipError("a bracket too many")
            stack.pop()
        elif word == "OFFSET" and stack:
            value = numbers(3)
            if stack[-1] is None:
                ends[stack[-2]] = value
            elif offsets[stack[-1]] is not None:
                raise ClipError("a joint repeats OFFSET")
            else:
                offsets[stack[-1]] = value
        elif word == "CHANNELS" and stack and stack[-1] is not None and channels[stack[-1]] is None:
            n = next(words, "")
            if not n.isdigit():
                raise ClipError("CHANNELS needs a count")
            channels[stack[-1]] = [next(words, "") for _ in range(int(n))]
        else:
            raise ClipError(f"unexpected {word!r}")
    if stack or not names or any(v is None for v in [*offsets, *channels]):
        raise ClipError("the hierarchy is not complete")
    rig = Rig(names, parents, np.array(offsets, float), channels, ends).check()

    found = re.match(r"\s*Frames\s*:\s*(\S+)\s+Frame\s+Time\s*:\s*(\S+)", body)
    try:
        frames, frame_time = int(found[1]), float(found[2])
        # a line at a time: the words of a whole clip take several times its text
        values = np.fromiter((float(w) for line in body[found.end() :].splitlines() for w in line.split()), float)
    except (TypeError, ValueError) as e:
        raise ClipError("the motion section can't be read") from e
    width = sum(map(len, channels))
    if frames < 1 or len(values) != frames * width:
        raise ClipError(f"{len(values)} values, where {frames} frames need {frames * width}")
    if not np.isfinite(values).all():
        raise ClipError("a value is not finite")
    values = values.reshape(frames, width)
    rotations = np.zeros((frames, len(names), 4))
    rotations[..., 0] = 1
    translations = np.repeat(rig.offsets[None], frames, 0)
    at = 0
    for j, c in enumerate(channels):
        for name in c:
            if name.endswith("position"):
                translations[:, j, AXES[name[0]]] += values[:, at]
            else:
                rotations[:, j] = np_multiply(rotations[:, j], axis_turn(name[0], np.radians(values[:, at])))
            at += 1
    return Clip(rig, rotations, translations, frame_time).check()


def euler(q: np.ndarray, order: str) -> np.ndarray:
    """Angles of the product of axis turns, unwrapped over frames."""
    i, j, k = (AXES[c] for c in order)
    s = 1.0 if (j - i) % 3 == 1 else -1.0
    w, x, y, z = np.moveaxis(q, -1, 0)
    m = np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ])
    free = np.hypot(m[i, i], m[i, j]) > 1e-9
    first = np.where(free, np.arctan2(-s * m[j, k], m[k, k]), np.arctan2(s * m[k, j], m[j, j]))
    third = np.where(free, np.arctan2(-s * m[i, j], m[i, i]), 0.0)
    return np.unwrap(np.stack([first, np.arcsin(np.clip(s * m[i, k], -1, 1)), third], -1), axis=0)


def number(value: float) -> str:
    return f"{0.0 if abs(value) < SMALL else value:.9g}"


def dumps(clip: Clip, text=number) -> str:
    """The motion text; ``text`` writes a number: nine digits, or with ``repr`` all, so that reading gives the same doubles."""
    rig, out = clip.rig, ["HIERARCHY"]

    def vector(v) -> str:
        return "OFFSET " + " ".join(text(float(x)) for x in v)

    def joint(j: int, tab: str) -> None:
        c = rig.channels[j]
        out.extend([f"{tab}{'JOINT' if j else 'ROOT'} {rig.names[j]}", tab + "{", f"{tab}\t{vector(rig.offsets[j])}", f"{tab}\t" + " ".join(["CHANNELS", str(len(c)), *c])])
        for child, p in enumerate(rig.parents):
            if p == j:
                joint(child, tab + "\t")
        if rig.ends[j] is not None:
            out.extend([f"{tab}\tEnd Site", f"{tab}\t{{", f"{tab}\t\t{vector(rig.ends[j])}", f"{tab}\t}}"])
        out.append(tab + "}")

    joint(0, "")
    columns = []
    for j, c in enumerate(rig.channels):
        order = "".join(x[0] for x in c if x.endswith("rotation"))
        angles = iter(np.degrees(euler(clip.rotations[:, j], order)).T) if order else iter(())
        for x in c:
            a = AXES[x[0]]
            columns.append(clip.translations[:, j, a] - rig.offsets[j, a] if x.endswith("position") else next(angles))
    rows = zip(*columns, strict=True) if columns else [()] * len(clip.rotations)
    out.extend(["MOTION", f"Frames: {len(clip.rotations)}", f"Frame Time: {text(float(clip.frame_time))}"])
    out.extend(" ".join(text(float(v)) for v in r) for r in rows)
    return "\n".join(out) + "\n"


POSE = "path string, rig string, frame_time double, frame int, rotations array<double>, translations array<double>"


def pose_rows(path: str, clip: Clip):
    """The rows of one clip as Arrow columns in the order of ``POSE``."""
    import pyarrow as pa

    from posegrid.sources.clip import canonical

    n, kind = len(clip.rotations), pa.list_(pa.float64())
    cols = [pa.array([path] * n), pa.array([canonical(clip.rig.document())] * n), pa.array([clip.frame_time] * n), pa.array(range(n), pa.int32())]
    cols += [pa.array(list(clip.rotations.reshape(n, -1)), kind), pa.array(list(clip.translations.reshape(n, -1)), kind)]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in POSE.split(", ")])


def parse(files: DataFrame, loads_=loads) -> DataFrame:
    """Poses from (path, content) rows; content is text or bytes."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                data = content.as_py()
                if loads_ is loads and isinstance(data, bytes):
                    data = data.decode("utf-8-sig")
                yield pose_rows(path.as_py(), loads_(data))

    return files.select("path", "content").mapInArrow(run, POSE)


def read(spark: SparkSession, path: str, pattern: str = "*.bvh") -> DataFrame:
    """Poses of all motion texts below a folder; a file is one task's row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return parse(files)


def whole(poses: DataFrame, write, out: str) -> DataFrame:
    """(path, content) of every clip: its poses gathered by clip, written by ``write`` (clip to text or bytes)."""
    import json

    import pandas as pd

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("frame")
        rig = Rig.of(json.loads(p["rig"].iloc[0]))
        r = np.stack(p["rotations"].to_list()).reshape(len(p), -1, 4)
        t = np.stack(p["translations"].to_list()).reshape(len(p), -1, 3)
        return pd.DataFrame({"path": [p["path"].iloc[0]], "content": [write(Clip(rig, r, t, float(p["frame_time"].iloc[0])).check())]})

    return poses.groupBy("path").applyInPandas(run, f"path string, content {out}")
