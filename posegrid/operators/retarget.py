"""Retargeting: which joint drives which, how their rest frames differ, and the motion that follows."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posegrid.functions import names
from posegrid.operators.constraints import violations
from posegrid.operators.hierarchy import flat, np_conjugate, np_multiply, np_rotate, walk
from posegrid.sources.clip import canonical

UP = {"x": 0, "y": 1, "z": 2}


def described(joints: DataFrame) -> DataFrame:
    """Joints with their plain names and meanings; collars change what shoulders are."""
    plain = names.plain_name(F.col("name"))
    collars = F.bool_or(plain.isin("leftcollar", "rightcollar")).over(Window.partitionBy())  # one skeleton
    rows = joints.withColumn("plain", plain).withColumn("collars", collars)
    return rows.withColumn("what", names.meaning_in(F.col("name"), F.col("collars"))).drop("collars")


def exact_mapping(source: DataFrame, target: DataFrame) -> DataFrame:
    """(target, source) of joints with equal local names; of equal names the first counts."""
    first = source.groupBy(names.local_name(F.col("name")).alias("local")).agg(F.min("joint").alias("source"))
    return target.select(F.col("joint").alias("target"), names.local_name(F.col("name")).alias("local")).join(F.broadcast(first), "local").select("target", "source")


def driver_bones(driver: DataFrame, target: DataFrame) -> DataFrame:
    """(target, driver) of bones with equal plain names; of a driver's equal names the last counts."""
    last = driver.groupBy(names.plain_name(F.col("name")).alias("plain")).agg(F.max("joint").alias("driver"))
    return target.select(F.col("joint").alias("target"), names.plain_name(F.col("name")).alias("plain")).join(F.broadcast(last), "plain").select("target", "driver")


def spine_ranks(joints: DataFrame) -> DataFrame:
    """(what, joint, rank, n) of a described skeleton's spine joints, from the root up."""
    spine = Window.partitionBy("what")
    return joints.where("what = 'spine'").select("what", "joint", (F.row_number().over(spine.orderBy("joint")) - 1).alias("rank"), F.count("*").over(spine).alias("n"))


def spine_pairs(s: DataFrame, t: DataFrame) -> DataFrame:
    """(target, source) of spine joints at the same share of their chains, half to even."""
    a = spine_ranks(s).select(F.col("joint").alias("source"), F.col("rank").alias("wanted"), F.col("n").alias("ns"))
    b = spine_ranks(t).select(F.col("joint").alias("target"), "rank", F.col("n").alias("nt"))
    of = a.select("ns").distinct()
    b = b.join(F.broadcast(of))  # one row: the length of the source's chain
    b = b.withColumn("wanted", F.rint(F.col("rank") * (F.col("ns") - 1) / F.greatest(F.lit(1), F.col("nt") - 1)).cast("int")).drop("ns")
    return b.join(F.broadcast(a), "wanted").select("target", "source")


def mapping(source: DataFrame, target: DataFrame) -> DataFrame:
    """(target, source, method): by equal names, else by a meaning that one source joint has, spines by share."""
    s, t = described(source), described(target)
    exact = s.groupBy("plain").agg(F.max_by(F.struct("joint", "what"), "joint").alias("e")).select("plain", F.col("e.joint").alias("by_name"), F.col("e.what").alias("name_what"))
    alias = s.where("what <> 'spine' AND NOT startswith(what, 'twist:')").groupBy("what").agg(F.min("joint").alias("by_what"), F.count("*").alias("n")).where("n = 1").drop("n")
    spine = spine_pairs(s, t).select(F.col("target").alias("joint"), F.col("source").alias("by_rank"))
    j = t.join(F.broadcast(exact), "plain", "left").join(F.broadcast(alias), "what", "left").join(F.broadcast(spine), "joint", "left")
    same = F.col("by_name").isNotNull() & (F.col("name_what") == F.col("what"))
    root = s.where("joint = 0").select(F.col("what").alias("root_what"))
    j = j.join(F.broadcast(root))  # one row
    picked = F.coalesce(F.col("by_rank"), F.when(same, F.col("by_name")), F.col("by_what"))
    method = F.when(F.col("by_rank").isNotNull(), "normalized_chain").when(same, "exact_name").when(F.col("by_what").isNotNull(), "semantic_alias")
    top = (F.col("joint") == 0) & (F.col("what") == F.col("root_what")) & picked.isNull()
    drop = (F.col("joint") == 0) & (F.col("what") == "root") & (F.col("root_what") != "root")
    out = j.select(F.col("joint").alias("target"), F.when(top, 0).otherwise(picked).alias("source"), F.when(top, "root_semantic").otherwise(method).alias("method"), drop.alias("drop"))
    return out.where("source IS NOT NULL AND NOT drop").drop("drop")


def coverage(source: DataFrame, target: DataFrame, mapped: DataFrame) -> DataFrame:
    """(shared, mapped): how many core meanings both skeletons have, and how many of them are mapped."""
    core = lambda d: described(d).where(F.col("what").isin(names.CORE))
    shared = core(source).select("what").intersect(core(target).select("what"))
    have = core(target).join(F.broadcast(mapped.select(F.col("target").alias("joint"))), "joint", "left_semi").select("what").distinct()
    both = shared.join(have.withColumn("hit", F.lit(1)), "what", "left")
    return both.agg(F.count("*").alias("shared"), F.count("hit").alias("mapped"))


@dataclass
class Skeleton:
    """A skeleton as arrays; the driver's form of a small table."""

    names: list[str]
    parents: list[int]
    offsets: np.ndarray
    what: list[str] = field(default_factory=list)
    ends: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, joints: DataFrame) -> "Skeleton":
        """From joint, name, parent, ox, oy, oz and, where there are end sites, ex, ey, ez."""
        rows = sorted(joints.collect(), key=lambda r: r["joint"])  # one skeleton's joints
        names_ = [r["name"] for r in rows]
        ends = {r["joint"]: np.array([r["ex"], r["ey"], r["ez"]], float) for r in rows if r["ex"] is not None} if "ex" in joints.columns else {}
        return cls(names_, [r["parent"] for r in rows], np.array([[r["ox"], r["oy"], r["oz"]] for r in rows], float), names.meanings_in(names_), ends)

    @classmethod
    def of_rig(cls, rig) -> "Skeleton":
        ends = {j: np.array(e, float) for j, e in enumerate(rig.ends) if e is not None}
        return cls(list(rig.names), list(rig.parents), np.asarray(rig.offsets, float), names.meanings_in(rig.names), ends)

    def rest(self) -> np.ndarray:
        n = len(self.names)
        unit = np.zeros((1, n, 4))
        unit[..., 0] = 1
        return walk(self.parents, unit, self.offsets[None])[1][0]

    def height(self, up: int) -> float:
        """As ``hierarchy.skeleton_height`` for a skeleton that the driver holds already."""
        at = self.rest()

        def chain(j: int) -> float:
            return 0.0 if self.parents[j] < 0 else float(np.linalg.norm(self.offsets[j])) + chain(self.parents[j])

        of = {meaning: j for j, meaning in enumerate(names.meanings(self.names))}  # the last of equal ones
        feet = [chain(of[f]) for f in ("left_foot", "right_foot") if f in of]
        human = chain(of["head"]) + float(np.mean(feet)) if feet and "head" in of else 0.0
        extent = float(np.ptp([*at[:, up], *(at[j, up] + e[up] for j, e in self.ends.items())]))
        return next((v for v in (human, extent) if v > 1e-8), float(np.linalg.norm(at - at[0], axis=1).max()))

    def basis(self, joint: int, up: int) -> np.ndarray:
        """The rest frame of a joint: along its bone, and across it by the first usable hint."""
        at = self.rest()
        bones = [at[c] - at[joint] for c, p in enumerate(self.parents) if p == joint]
        bones = [b for b in bones if np.linalg.norm(b) > 1e-8]
        inward = [at[joint] - at[self.parents[joint]]] if self.parents[joint] >= 0 else []
        wide = self.what[joint] in ("pelvis", "root")
        along = (max(bones, key=lambda b: abs(b[up])) if wide else bones[0]) if bones else inward[0] if inward else np.eye(3)[up]
        x = along / np.linalg.norm(along)
        across = (np.cross(x, h) for h in [*inward, *bones[1:], *np.eye(3)])
        z = next(c / np.linalg.norm(c) for c in across if np.linalg.norm(c) > 1e-8)
        return np.stack([x, np.cross(z, x), z], axis=1)


def matrix_quaternion(mat: np.ndarray) -> np.ndarray:
    """The unit quaternion of a rotation matrix, by the largest of its four squares."""
    squares = np.array([1 + mat.trace(), *(1 + 2 * mat[i, i] - mat.trace() for i in range(3))])
    k = int(np.argmax(squares))
    s = np.sqrt(max(0.0, squares[k])) * 2
    q = np.empty(4)
    q[k] = s / 4
    pairs = {0: [(2, 1), (0, 2), (1, 0)]}
    if k == 0:
        for i, (a, b) in enumerate(pairs[0]):
            q[1 + i] = (mat[a, b] - mat[b, a]) / s
    else:
        i, j, l = k - 1, k % 3, (k + 1) % 3
        q[0] = (mat[l, j] - mat[j, l]) / s
        q[1 + j] = (mat[j, i] + mat[i, j]) / s
        q[1 + l] = (mat[l, i] + mat[i, l]) / s
    return q / np.linalg.norm(q)


@dataclass
class Profile:
    """What a retarget needs: pairs with their basis change, both hierarchies, and the scale of the root."""

    source: Skeleton
    target: Skeleton
    pairs: dict[int, tuple[int, np.ndarray, str]]
    scale: float
    up: int

    def problems(self) -> list[str]:
        """Why the profile can't be compiled: joints out of range, or a basis that is no rotation."""
        out = [f"joint {t} or {s} is out of range" for t, (s, _, _) in self.pairs.items() if not (t < len(self.target.names) and s < len(self.source.names))]
        out += [f"basis of joint {t} is no unit quaternion" for t, (_, b, _) in self.pairs.items() if abs(np.linalg.norm(b) - 1) > 1e-5]
        return out if self.scale > 0 else [*out, "scale is not positive"]

    def document(self) -> dict:
        """The profile as it is written, with the hash of its content."""
        pairs = [[t, s, list(map(float, b)), w] for t, (s, b, w) in sorted(self.pairs.items())]
        body = {"pairs": pairs, "scale": self.scale, "up": self.up, "source": self.source.names, "target": self.target.names}
        return body | {"sha256": hashlib.sha256(canonical(body).encode()).hexdigest()}

    def run(self, rotations: np.ndarray, translations: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Local rotations and translations of the target for (F, J, 4) and (F, J, 3) of the source."""
        g, _ = walk(self.source.parents, rotations, translations)
        n = len(self.target.names)
        world = np.empty((len(g), n, 4))
        local = np.empty_like(world)
        for j, parent in enumerate(self.target.parents):
            above = world[:, parent] if parent >= 0 else np.broadcast_to([1.0, 0, 0, 0], (len(g), 4))
            if j in self.pairs:
                s, b, _ = self.pairs[j]
                world[:, j] = np_multiply(np_multiply(np.broadcast_to(b, g[:, s].shape), g[:, s]), np.broadcast_to(np_conjugate(b), g[:, s].shape))
                local[:, j] = np_multiply(np_conjugate(above), world[:, j])
            else:
                local[:, j] = [1.0, 0, 0, 0]
                world[:, j] = above
        moved = np.broadcast_to(self.target.offsets, (len(g), n, 3)).copy()
        moved[:, 0] += (translations[:, 0] - self.source.offsets[0]) * self.scale
        return local, moved

    def run_matrices(self, rotations: np.ndarray) -> np.ndarray:
        """Global rotation matrices of the mapped joints by matrix products: an independent check of ``run``."""
        def matrix(q):
            e = np.eye(3)
            return np.stack([np_rotate(q, np.broadcast_to(e[k], (*q.shape[:-1], 3))) for k in range(3)], -1)

        local = matrix(rotations)
        g = np.empty_like(local)
        for j, p in enumerate(self.source.parents):
            g[:, j] = local[:, j] if p < 0 else g[:, p] @ local[:, j]
        out = np.full((len(g), len(self.target.names), 3, 3), np.nan)
        for j, (s, b, _) in self.pairs.items():
            m = matrix(np.asarray(b, float))
            out[:, j] = m @ g[:, s] @ m.T
        return out


def pairs_of(a: Skeleton, b: Skeleton) -> dict[int, tuple[int, str]]:
    """``mapping`` of two skeletons that the driver holds: target joint to source joint and method."""
    by_name = {names.plain(n): j for j, n in enumerate(a.names)}  # the last of equal ones
    by_what: dict[str, list[int]] = {}
    for j, w in enumerate(a.what):
        by_what.setdefault(w, []).append(j)
    spine, own = by_what.get("spine", []), [j for j, w in enumerate(b.what) if w == "spine"]
    out = {}
    for t, w in enumerate(b.what):
        same = by_name.get(names.plain(b.names[t]))
        single = by_what.get(w, []) if w != "spine" and not w.startswith("twist:") else []
        if w == "spine" and spine:
            out[t] = (spine[round(own.index(t) * (len(spine) - 1) / max(1, len(own) - 1))], "normalized_chain")  # half to even
        elif same is not None and a.what[same] == w:
            out[t] = (same, "exact_name")
        elif len(single) == 1:
            out[t] = (single[0], "semantic_alias")
    if a.what[0] == b.what[0]:
        out.setdefault(0, (0, "root_semantic"))
    if b.what[0] == "root" and a.what[0] != "root":
        out.pop(0, None)
    return dict(sorted(out.items()))


def core_of(a: Skeleton, b: Skeleton, pairs) -> tuple[int, int]:
    """(shared, mapped): ``coverage`` of two skeletons that the driver holds."""
    shared = {*names.CORE} & {*a.what} & {*b.what}
    return len(shared), len(shared & {b.what[t] for t in pairs})


def compile_profile(a: Skeleton, b: Skeleton, up: str = "y") -> Profile:
    """Pairs, basis changes and the ratio of heights. Equal plain names share their rest frame."""
    pairs = {}
    for t, (s, method) in pairs_of(a, b).items():
        if names.plain(a.names[s]) == names.plain(b.names[t]):
            q = np.array([1.0, 0, 0, 0])
        else:
            q = matrix_quaternion(b.basis(t, UP[up]) @ a.basis(s, UP[up]).T)
        pairs[t] = (s, q, method)
    return Profile(a, b, pairs, b.height(UP[up]) / a.height(UP[up]), UP[up])


def build_profile(source: DataFrame, target: DataFrame, up: str = "y") -> Profile:
    """The profile of two skeleton tables: both are read once, and everything else is done on the driver."""
    return compile_profile(Skeleton.of(source), Skeleton.of(target), up)


def transfer_violations(rows: DataFrame, source_joints: int, target_joints: int) -> DataFrame:
    """``rows`` (target, source, bw..bz) with ``violations``: what keeps a transfer out of a compiled profile."""
    c = F.col
    unit = F.abs(F.sqrt(c("bw") * c("bw") + c("bx") * c("bx") + c("by") * c("by") + c("bz") * c("bz")) - 1) <= 1e-5
    rules = {"target": (c("target") >= 0) & (c("target") < target_joints), "source": (c("source") >= 0) & (c("source") < source_joints), "basis": unit}
    return rows.withColumn("violations", violations(rules))


def retarget(poses: DataFrame, profile: Profile, keys=("clip", "frame")) -> DataFrame:
    """(keys, joint, qw..qz, tx..tz) of the target; poses are single rows, so nothing is shuffled."""
    moving = "translations" in poses.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            r = flat(b.column(len(keys)), 4)
            t = flat(b.column(len(keys) + 1), 3) if moving else np.broadcast_to(profile.source.offsets, (len(r), *profile.source.offsets.shape)).copy()
            q, p = profile.run(r, t)
            n = q.shape[1]
            at = pa.array(np.repeat(np.arange(len(r)), n))
            cols = [c.take(at) for c in b.columns[: len(keys)]] + [pa.array(np.tile(np.arange(n, dtype=np.int32), len(r)))]
            cols += [pa.array(q[..., k].ravel()) for k in range(4)] + [pa.array(p[..., k].ravel()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "joint", *"qw qx qy qz tx ty tz".split()])

    types = dict(poses.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "joint int", *(f"{c} double" for c in "qw qx qy qz tx ty tz".split())])
    return poses.select(*keys, "rotations", *(["translations"] if moving else [])).mapInArrow(run, schema)


def retarget_poses(poses: DataFrame, profile: Profile, keys=("clip", "frame")) -> DataFrame:
    """(keys, rotations, translations) of the target: a pose stays one row."""
    moving = "translations" in poses.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            r = flat(b.column(len(keys)), 4)
            t = flat(b.column(len(keys) + 1), 3) if moving else np.broadcast_to(profile.source.offsets, (len(r), *profile.source.offsets.shape)).copy()
            lists = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x[0].size, dtype=np.int32), np.ascontiguousarray(x).ravel()) for x in profile.run(r, t)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *lists], names=[*keys, "rotations", "translations"])

    types = dict(poses.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", rotations array<double>, translations array<double>"
    return poses.select(*keys, "rotations", *(["translations"] if moving else [])).mapInArrow(run, schema)


def copy_rotations(poses: DataFrame, pairs: dict[int, int], joints: int, ratio: float) -> DataFrame:
    """``poses`` with the rotations of ``pairs`` (target to source joint), others at rest, and ``root``: its position times ``ratio``.

    Expressions alone: a pose's arrays are gathered where they lie.
    """
    rest = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    turned = F.concat(*[F.slice("rotations", pairs[j] * 4 + 1, 4) if j in pairs else rest for j in range(joints)])
    root = F.transform(F.slice("translations", 1, 3), lambda v: v * ratio)
    return poses.withColumn("root", root).withColumn("rotations", turned)


def lock_feet(active: np.ndarray, at: np.ndarray, decay: float = 0.8) -> np.ndarray:
    """The corrections (F, 3) that keep feet where they touched down; ``active`` (F, feet), ``at`` (F, feet, 3).

    A true recurrence: a touch-down's anchor holds the correction so far, and the feet on the ground are averaged.
    """
    out, c = np.zeros((len(at), at.shape[2])), np.zeros(at.shape[2])
    anchor, before = np.zeros(at.shape[1:]), np.zeros(at.shape[1], bool)
    for f, (on, p) in enumerate(zip(active, at, strict=True)):
        if on.any():
            down = on & ~before
            anchor[down] = p[down] + c
            c = (anchor[on] - p[on]).mean(0)
        else:
            c = c * decay
        before, out[f] = on, c
    return out


def foot_lock(rows: DataFrame, decay: float = 0.8) -> DataFrame:
    """(clip, frame, cx, cy, cz) from (clip, frame, foot, active, x, y, z): one pass over each clip, which is one group.

    Every frame has a row for each foot of its clip.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["frame", "foot"])
        feet = p["foot"].nunique()
        c = lock_feet(p["active"].to_numpy().reshape(-1, feet), p[["x", "y", "z"]].to_numpy(float).reshape(-1, feet, 3), decay)
        return pd.DataFrame({"clip": p["clip"].to_numpy()[::feet], "frame": p["frame"].to_numpy()[::feet], "cx": c[:, 0], "cy": c[:, 1], "cz": c[:, 2]})

    types = dict(rows.dtypes)
    schema = f"clip {types['clip']}, frame {types['frame']}, cx double, cy double, cz double"
    return rows.select("clip", "frame", "foot", "active", "x", "y", "z").groupBy("clip").applyInPandas(run, schema)


def contact_lock(rows: DataFrame, decay: float = 0.8) -> DataFrame:
    """(clip, frame, correction) of one foot along one axis, from (clip, frame, active, v)."""
    foot = rows.select("clip", "frame", F.lit(0).alias("foot"), "active", F.col("v").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return foot_lock(foot, decay).select("clip", "frame", F.col("cx").alias("correction"))
