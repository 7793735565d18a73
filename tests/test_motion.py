"""Closed forms, seeded round trips and broken inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrid.functions import codes, names
from posegrid.functions import quat as Q
from posegrid.operators import agent, constraints, gates, hierarchy, ik, keys, resample, retarget
from posegrid.plans import catalog, projections, windows
from posegrid.plans.registry import ENGINE, TOY, skeleton
from posegrid.sources import bvh, container, npz
from posegrid.sources.clip import Clip, ClipError, Rig
from tests.sql_compare import compare, connect

BVH = """HIERARCHY
ROOT Hips
{
  OFFSET 1 2 3
  CHANNELS 6 Xposition Yposition Zposition Zrotation Xrotation Yrotation
  JOINT Chest
  {
    OFFSET 0 10 0
    CHANNELS 3 Zrotation Xrotation Yrotation
    End Site
    {
      OFFSET 0 8 0
    }
  }
}
MOTION
Frames: 3
Frame Time: 0.0333333333
0 0 0 10 20 30 5 6 7
1 0 0 11 21 31 5 6 7
2 0 1 12 22 32 5 6 7
"""


def unit(rng, n):
    q = rng.normal(size=(n, 4))
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def sample(frames=120):
    t = np.linspace(0, 6, frames)
    rig = Rig(["Root", "Chest", "Hand"], [-1, 0, 1], np.array([[0, 0, 0], [0, 10, 0], [5, 0, 0.0]]), [["Xposition", "Yposition", "Zposition", "Zrotation", "Xrotation", "Yrotation"]] + [["Zrotation", "Xrotation", "Yrotation"]] * 2, [None, None, [1.0, 0, 0]])
    r = np.zeros((frames, 3, 4))
    for j in range(3):
        r[:, j] = hierarchy.np_multiply(bvh.axis_turn("Z", 0.6 * np.sin(t + j)), bvh.axis_turn("X", 0.4 * np.cos(2 * t + j)))
    p = np.repeat(rig.offsets[None], frames, 0)
    p[:, 0, 0] += np.linspace(0, 100, frames)
    p[:, 0, 1] += 2 * np.sin(t)
    return Clip(rig, r, p, 1 / 30).check()


def degrees(a, b):
    return keys.np_angle(a, b).max()


def test_bvh_reads_offsets_plus_channels():
    c = bvh.loads(BVH)
    assert c.rig.names == ["Hips", "Chest"] and c.rig.ends == [None, [0, 8, 0]]
    assert c.translations[:, 0].tolist() == [[1, 2, 3], [2, 2, 3], [3, 2, 4]]
    assert c.raw_bytes() == 3 * 9 * 4


def test_bvh_round_trip():
    c = bvh.loads(BVH)
    d = bvh.loads(bvh.dumps(c))
    assert d.rig.signature() == c.rig.signature()
    assert np.abs(c.translations - d.translations).max() < 1e-8 and degrees(c.rotations, d.rotations) < 1e-5


@pytest.mark.parametrize("change", [("MOTION", "MOTIN"), ("Frames: 3", "Frames: 4"), ("JOINT Chest", "JOINT Hips"), ("5 6 7\n1", "5 6 x\n1"), ("OFFSET 0 10 0", ""), ("Xrotation Yrotation\n  JOINT", "Xrotation Xrotation\n  JOINT"), ("0.0333333333", "-1"), ("}\nMOTION", "MOTION")])
def test_bvh_rejects(change):
    with pytest.raises(ClipError):
        bvh.loads(BVH.replace(*change, 1))


def test_container_high_preset():
    c = sample()
    data = container.encode(c)
    d = container.decode(data)
    assert data == container.encode(c) and len(data) < c.raw_bytes()
    assert degrees(c.rotations, d.rotations) <= 0.055 and np.abs(c.translations - d.translations).max() < 1e-3


def test_container_presets_are_ordered():
    c = sample()
    sizes, errors = [], []
    for p in container.PRESETS.values():
        data = container.encode(c, p)
        sizes.append(len(data))
        errors.append(degrees(c.rotations, container.decode(data).rotations))
    assert sizes == sorted(sizes) and errors == sorted(errors, reverse=True)


def test_container_rejects_damage():
    data = container.encode(sample(4))
    with pytest.raises(ClipError, match="CRC"):
        container.decode(data[:-1] + bytes([data[-1] ^ 0x55]))
    with pytest.raises(ClipError, match="expected size"):
        container.decode(data + b"x")
    with pytest.raises(ClipError):
        container.decode(b"X" + data[1:])
    with pytest.raises(ClipError, match="version"):
        container.decode(data[:10] + b"\x09" + data[11:])
    document, raw = container.opened(data)
    document["codec"]["rotation_key_counts"][0] -= 1
    with pytest.raises(ClipError, match="declared"):
        container.decode(container.framed(document, raw))
    document["codec"]["rotation_key_counts"].pop()
    with pytest.raises(ClipError, match="each track"):
        container.decode(container.framed(document, raw))
    assert container.inspect(data)["frames"] == 4


def test_files_through_spark(spark, tmp_path):
    (tmp_path / "a.bvh").write_text(BVH)
    rows = bvh.read(spark, str(tmp_path))
    assert rows.count() == 3
    packed = bvh.whole(rows, container.encode, "binary")
    again = bvh.parse(packed, container.decode).orderBy("frame").collect()
    assert np.abs(np.array([r["translations"] for r in again]) - bvh.loads(BVH).translations.reshape(3, -1)).max() < 1e-4
    (tmp_path / "p.npz").write_bytes(npz.dumps(positions=np.zeros((2, 22, 3))))
    assert npz.read(spark, str(tmp_path)).count() == 44


@pytest.mark.parametrize("values, kept", [([0, 1, 2, 3, 4], [0, 4]), ([5, 5, 5], [0]), ([0, 10, 0], [0, 1, 2]), ([3], [0]), ([0, 0, 9, 0, 0], [0, 1, 2, 3, 4])])
def test_scalar_keys(values, kept):
    assert keys.reduce_track(np.array(values, float)[:, None], 1e-9, keys.scalar_error).tolist() == kept


def test_keys_hold_their_bound():
    c = sample()
    k = keys.reduce_track(c.rotations[:, 1], 0.25, keys.rotation_error)
    a, b, u = container.spread(k, 120)
    assert 2 < len(k) < 120 and degrees(c.rotations[:, 1], keys.np_slerp(c.rotations[k[a], 1], c.rotations[k[b], 1], u)) <= 0.25 + 1e-9


def brute_keys(values, bound, error):
    """One segment after the other."""
    n = len(values)
    zero = np.zeros(n, int)
    if n == 1 or (error(values, zero, zero, np.zeros(n), np.arange(n)) <= bound).all():
        return [0]
    kept, todo = {0, n - 1}, [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        at = np.arange(a + 1, b)
        if len(at):
            e = error(values, np.full(len(at), a), np.full(len(at), b), (at - a) / (b - a), at)
            if e.max() > bound:
                w = int(at[e.argmax()])
                kept.add(w)
                todo += [(a, w), (w, b)]
    return sorted(kept)


def test_keys_against_one_by_one():
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 40, 300):
        v = np.cumsum(rng.normal(size=(n, 1)), 0)
        assert keys.reduce_track(v, 0.8, keys.scalar_error).tolist() == brute_keys(v, 0.8, keys.scalar_error)
        q = unit(rng, n)
        assert keys.reduce_track(q, 50.0, keys.rotation_error).tolist() == brute_keys(q, 50.0, keys.rotation_error)


def test_tracks_across_batches(spark):
    """Tracks that are cut by batches, tracks of null keys, and tracks of one frame."""
    rng = np.random.default_rng(2)
    rows = [(None if c == 0 else c, f, float(v)) for c in range(12) for f, v in enumerate(np.cumsum(rng.normal(size=1 if c == 5 else 50)))]
    tracks = spark.createDataFrame(rows, "clip int, frame int, v double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        got = {(r["clip"], r["frame"]) for r in keys.reduce_scalar_tracks(tracks, ["clip"], 0.1).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = set()
    for c in {r[0] for r in rows}:
        v = np.array([[r[2]] for r in rows if r[0] == c])
        want |= {(c, f) for f in brute_keys(v, max(np.ptp(v) * 0.1, 1e-12), keys.scalar_error)}
    assert got == want


def test_bits_round_trip():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, 77), rng.integers(0, 1 << 19, 77)
    x, y = container.unpack_fields(container.pack_fields([(a, 2), (b, 19)]), 77, [2, 19])
    assert (x == a).all() and (y == b).all()


def test_quaternion_columns_match_numpy(spark):
    q = unit(np.random.default_rng(42), 100)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(q)], "i int, qw double, qx double, qy double, qz double")
    # each form is a select of its own: an expression that is used often would be written out each time
    mat = Q.to_matrix(Q.quat())
    df = df.select("*", *[mat[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)])
    df = df.select("*", *Q.named(Q.from_matrix([[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]), "m"))
    assert df.select(F.max(Q.angle_degrees(Q.quat(), Q.quat("m")))).first()[0] < 1e-5
    for order in ("ZXY", "XYZ"):
        e = df.select(*[f"q{c}" for c in "wxyz"], *[x.alias(f"a{k}") for k, x in enumerate(Q.to_euler(Q.quat(), order))])
        turns = [Q.axis_angle(x, F.col(f"a{k}")) for k, x in enumerate(order)]
        e = e.select("*", *Q.named(Q.multiply(turns[0], turns[1]), "h"))
        e = e.select("*", *Q.named(Q.multiply(Q.quat("h"), turns[2]), "r"))
        assert e.select(F.max(Q.angle_degrees(Q.quat(), Q.quat("r")))).first()[0] < 1e-5
    v = df.select(*[c.alias(n) for c, n in zip(Q.rotate(Q.quat(), (F.lit(1.0), F.lit(2.0), F.lit(3.0))), "xyz", strict=True)]).toPandas().to_numpy()
    assert np.abs(v - hierarchy.np_rotate(q, np.tile([1.0, 2, 3], (100, 1)))).max() < 1e-12


def test_euler_orders(spark):
    """Products of axis turns in any order, and the query over six orders as compiled code, without a fall back to interpreting."""
    a = np.random.default_rng(5).uniform(-4, 4, (50, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in a], "a0 double, a1 double, a2 double")
    for order in ("XYZ", "XZY", "YXZ", "YZX", "ZXY", "ZYX", "ZXZ", "YY", "Y"):
        want = bvh.axis_turn(order[0], a[:, 0])
        for k, axis in enumerate(order[1:], 1):
            want = hierarchy.np_multiply(want, bvh.axis_turn(axis, a[:, k]))
        have = df.select(*Q.named(Q.from_euler(order, [F.col(f"a{k}") for k in range(len(order))]))).toPandas().to_numpy()
        assert np.abs(have - want).max() < 1e-12, order
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert len(projections.euler(spark, "/root/testdata/sf0.001").collect()) == 3000
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_numbers_as_text_match_their_sql(spark, tmp_path):
    """Zeros of both signs, nulls, infinities and large values in the query's events."""
    values = [0.0, -0.0, None, float("inf"), float("-inf"), 1e5, -1e300, 12.345, 560.21]
    rows = [(50 * i + k, v) for i, v in enumerate(values) for k in (0, 1, 3)]
    spark.createDataFrame(rows, "event_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    compare(spark, connect(str(tmp_path)), str(tmp_path), catalog.QUERIES["PRJ23"], catalog.ORACLES["PRJ23"])


def test_texts_of_many_clips_match_their_sql(spark, tmp_path):
    """Clips of one frame, so many that some means lie within the ninth digit of a rounding edge."""
    e = np.random.default_rng(11).normal(size=(1000, 64)).astype("float32").tolist()
    rows = spark.createDataFrame([(i, i, x) for i, x in enumerate(e)], "vec_id long, label int, embedding array<float>")
    rows.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    compare(spark, connect(str(tmp_path)), str(tmp_path), catalog.QUERIES["SRC1"], catalog.ORACLES["SRC1"])


def test_text_of_all_digits():
    """What is written with all digits is read as the same doubles."""
    way = np.tile([0.1 + 0.2, -1e-13, 1234567.890123456], (200, 1, 1))
    rig = Rig(["Hips"], [-1], np.zeros((1, 3)), [["Xposition", "Yposition", "Zposition", "Zrotation", "Xrotation", "Yrotation"]], [None])
    q = unit(np.random.default_rng(3), 200).reshape(200, 1, 4)
    back = bvh.loads(bvh.dumps(Clip(rig, q, way, 1 / 30), repr))
    assert (back.translations == way).all() and back.frame_time == 1 / 30
    assert np.abs(np.abs((back.rotations * q).sum(-1)) - 1).max() < 1e-12


def test_slerp_halfway(spark):
    turn = lambda x: Q.axis_angle("Z", F.lit(x))
    df = spark.range(1).select(*Q.named(Q.identity(), "a"), *Q.named(turn(np.pi), "b"), *Q.named(turn(np.pi / 2), "h"))
    df = df.select("*", *Q.named(Q.slerp(Q.quat("a"), Q.quat("b"), F.lit(0.5)), "s"))
    assert df.select(Q.angle_degrees(Q.quat("s"), Q.quat("h"))).first()[0] < 1e-5


def test_smallest_three_within_a_step(spark):
    q = unit(np.random.default_rng(7), 50)
    df = spark.createDataFrame([tuple(map(float, r)) for r in q], "qw double, qx double, qy double, qz double")
    o, c = codes.smallest_three(Q.quat(), 16)
    df = df.select("*", o.alias("o"), c.alias("c"))
    df = df.select("*", *Q.named(codes.from_smallest_three(F.col("o"), F.col("c"), 16), "r"))
    assert df.select(F.max(Q.angle_degrees(Q.quat(), Q.quat("r")))).first()[0] < 0.01


def shifted(spark):
    return spark.createDataFrame([(0, f, j, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0) for f in range(2) for j in range(22)], "clip int, frame int, joint int, px double, py double, pz double, tx double, ty double, tz double")


def test_metrics_of_a_shift(spark):
    r = shifted(spark).groupBy("clip").agg(windows.mse(2.0).alias("mse"), windows.mean_distance(2.0).alias("d")).first()
    assert abs(r["mse"] - 1 / 3) < 1e-12 and abs(r["d"] - 1000) < 1e-9
    assert windows.root_aligned(shifted(spark)).groupBy("clip").agg(windows.mse(2.0).alias("m")).first()["m"] == 0


def test_report_has_empty_groups(spark):
    rows = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, 4.0)], "split string, mse double, geometry double")
    got = {r["split"]: (r["n"], r["mse"], r["geometry"]) for r in windows.split_report(rows, ["a", "b"]).collect()}
    assert got == {"a": (2, 2.0, 4.0), "b": (0, None, None), "overall": (2, 2.0, 4.0)}


def test_mapping_of_collars(spark):
    rows = lambda n: spark.createDataFrame([(i, x, i - 1, 0.0, 1.0, 0.0) for i, x in enumerate(n)], "joint int, name string, parent int, ox double, oy double, oz double")
    s, t = rows(["Hips", "Spine", "LeftShoulder", "LeftArm"]), rows(["pelvis", "spine1", "left_collar", "left_shoulder"])
    assert {r["target"]: r["source"] for r in retarget.mapping(s, t).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_profile_and_matrix_form(spark):
    p = retarget.build_profile(skeleton(spark, TOY), skeleton(spark, ENGINE))
    assert len(p.pairs) == 17 and not p.problems()
    # the engine's chains end at its root, below the pelvis
    toy = 1 + 1.5 + 2.5**0.5 + 1 + (1.25**0.5 + 4 + 16.25**0.5)
    assert abs(p.source.height(1) - hierarchy.skeleton_height(spark, skeleton(spark, TOY)).first()[0]) < 1e-9
    assert abs(p.scale - (1.2 * toy + 2 * 10.8) / toy) < 1e-9
    q = unit(np.random.default_rng(3), 5 * 16).reshape(5, 16, 4)
    t = np.repeat(p.source.offsets[None], 5, 0)
    t[:, 0, 0] += np.arange(5)
    local, moved = p.run(q, t)
    g, _ = hierarchy.walk(p.target.parents, local, moved)
    assert np.abs(local[:, 0] - [1, 0, 0, 0]).max() == 0 and np.allclose(moved[:, 0, 0] - p.target.offsets[0, 0], np.arange(5) * p.scale)
    want = p.run_matrices(q)
    e = np.stack([hierarchy.np_rotate(g, np.broadcast_to(np.eye(3)[k], (*g.shape[:-1], 3))) for k in range(3)], -1)
    assert np.nanmax(np.abs(e - want)) < 1e-12


def test_pairs_on_the_driver_are_those_of_the_tables(spark):
    rows = lambda n: spark.createDataFrame([(i, x, i - 1, 0.0, 1.0, 0.0) for i, x in enumerate(n)], "joint int, name string, parent int, ox double, oy double, oz double")
    some = [
        ["Hips", "Spine", "Spine1", "Spine2", "LeftShoulder", "LeftArm", "Head"], ["pelvis", "spine1", "spine3", "left_collar", "left_shoulder", "HEAD", "head_twist"],
        ["root", "pelvis", "spine_01", "upperarm_l", "upperarm_twist_01_l"], ["x:Root", "rig:Hips", "Spine", "LeftArm", "LeftUpperArm", "Leftfuß"], ["a", "b", "c"],
    ]
    for s, t in zip(some, [*some[1:], some[0]], strict=True):
        s, t = rows(s), rows(t)
        a, b = retarget.Skeleton.of(s), retarget.Skeleton.of(t)
        pairs = retarget.pairs_of(a, b)
        assert pairs == {r["target"]: (r["source"], r["method"]) for r in retarget.mapping(s, t).collect()}
    assert a.what == [r["what"] for r in retarget.described(s).orderBy("joint").collect()]
    assert retarget.core_of(a, b, pairs) == tuple(retarget.coverage(s, t, retarget.mapping(s, t)).first())


def test_heights_count_end_sites(spark):
    rows = [(0, "b0", -1, 0.0, 0.0, 0.0, None, None, None), (1, "b1", 0, 1.0, 0.0, 0.0, 0.0, 2.0, 0.0)]
    joints = spark.createDataFrame(rows, "joint int, name string, parent int, ox double, oy double, oz double, ex double, ey double, ez double")
    assert hierarchy.skeleton_height(spark, joints).first()[0] == retarget.Skeleton.of(joints).height(1) == 2.0
    flat = joints.drop("ex", "ey", "ez")
    assert hierarchy.skeleton_height(spark, flat).first()[0] == retarget.Skeleton.of(flat).height(1) == 1.0


def test_feet_are_averaged():
    at = np.array([[[0, 0, 0], [5, 0, 0]], [[1, 0, 0], [5, 0, 0]], [[2, 0, 0], [6, 0, 0]], [[2, 0, 0], [9, 0, 0]]], float)
    on = np.array([[True, False], [True, True], [True, True], [False, False]])
    # the second foot touches down when the first has been held back by one already
    assert np.allclose(retarget.lock_feet(on, at)[:, 0], [0, -0.5, -1.5, -1.2])


def test_contact_lock_holds_and_decays(spark):
    rows = spark.createDataFrame([("c", i, a, v) for i, (a, v) in enumerate([(False, 0.0), (True, 1.0), (True, 3.0), (False, 3.0), (False, 3.0)])], "clip string, frame int, active boolean, v double")
    got = [r["correction"] for r in retarget.contact_lock(rows).orderBy("frame").collect()]
    assert np.allclose(got, [0, 0, -2, -1.6, -1.28])


def test_times_wrap_and_hold(spark):
    rows = spark.createDataFrame([(t, n) for t in (-0.25, 0.0, 1.5, 3.0, 7.25) for n in (4, 1)], "t double, n int")
    got = {(r["t"], r["n"]): (r["a"], r["b"]) for r in rows.select("t", "n", resample.clip_time(F.col("t"), F.col("n"), 1.0, True).alias("a"), resample.clip_time(F.col("t"), F.col("n"), 1.0, False).alias("b")).collect()}
    assert got[(-0.25, 4)] == (2.75, 0.0) and got[(7.25, 4)] == (1.25, 3.0) and got[(3.0, 4)] == (0.0, 3.0) and got[(1.5, 1)] == (0.0, 0.0)


def test_whole_poses_at_a_time(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [float(np.cos(0.4)), float(np.sin(0.4)), 0.0, 0.0]
    poses = spark.createDataFrame([("c", 0, [*a, *a], [0.0, 0.0, 0.0, 1.0, 0.0, 0.0]), ("c", 1, [*b, *[-v for v in b]], [2.0, 0.0, 0.0, 1.0, 0.0, 0.0])], "clip string, frame int, rotations array<double>, translations array<double>")
    asked = spark.createDataFrame([(1, "c", 0.5, 2), (2, "c", 1.25, 2), (3, "c", -3.0, 2)], "sample int, clip string, t double, n int")
    hold = {r["sample"]: r for r in resample.sample_poses(asked, poses, 1.0, False).collect()}
    half = [np.cos(0.2), np.sin(0.2), 0, 0]
    assert np.allclose(hold[1]["rotations"], [*half, *half]) and np.allclose(hold[1]["translations"], [1, 0, 0, 1, 0, 0])
    assert np.allclose(np.abs(hold[2]["rotations"]), np.abs([*b, *b])) and np.allclose(hold[3]["rotations"], [*a, *a])
    loop = {r["sample"]: r for r in resample.sample_poses(asked, poses, 1.0, True).collect()}
    assert np.allclose(loop[2]["rotations"][:4], [np.cos(0.1), np.sin(0.1), 0, 0])
    assert [r["sample"] for r in resample.sample_frames(asked.withColumn("frame", F.col("sample") - 1), poses).orderBy("sample").collect()] == [1, 2]


def test_names_fold_and_strip(spark):
    n = ["a:\u00a0 Leftfu\u00df\t", "\ufb01nger", "HIPS "]
    df = spark.createDataFrame([(x,) for x in n], "n string")
    assert [r[0] for r in df.select(names.plain_name(F.col("n"))).collect()] == [names.plain(x) for x in n] == ["leftfuss", "finger", "hips"]
    assert [r[0] for r in df.select(names.local_name(F.col("n"))).collect()] == [x.rsplit(":", 1)[-1].strip() for x in n]


def test_paths_stay_inside(spark):
    paths = ["a/b", "../a", "a/../../b", "a/./../b", "/a", "", "a/..", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    want = [True, False, False, True, False, False, True, False]
    assert [r[0] for r in df.select(constraints.inside_workspace(F.col("p"))).collect()] == want == [agent.inside(p) for p in paths]


def test_release_findings(spark):
    files = [("docs/a.md", b"fine"), ("docs/b.exe", b"secret"), ("docs/c.py", b"\xff\xfe"), ("docs/d.svg", b"<SCRIPT>"), ("x/e.txt", b"see /home/me, my Secret."), ("docs/f", b""), ("docs/g.md", b"x" * 100), ("docs/secretary.md", b"secretary")]
    got = {r[0] for r in constraints.release_findings(spark.createDataFrame(files, "path string, content binary"), ["docs"], ["secret"], 50).collect()}
    assert got == {
        "forbidden file type: docs/b.exe", "text file is not valid UTF-8: docs/c.py", "active or external SVG content: docs/d.svg", "unexpected top-level entry: x",
        "denied term in file: x/e.txt", "absolute path in file: x/e.txt", "unreviewed file type: docs/f", "file is too large: docs/g.md",
    }


def test_penetration_counts_must_be_sound(spark, tmp_path):
    for discount in (0.5, -0.1):
        spark.createDataFrame([(1, 0.05, 0.0), (1, discount, 0.0)], "l_orderkey long, l_discount double, l_tax double").write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))
        with pytest.raises(Exception, match="penetrated"):
            windows.agg5(spark, str(tmp_path)).collect()


def test_gates():
    clip = sample(40)
    high, low = container.PRESETS["high"], container.PRESETS["low"]
    report = gates.judge(clip, None, high)
    assert report["case"] == "same_character" and [c["id"] for c in report["checks"]] == ["codec_rotation", "codec_global_position", "codec_quaternion_norm", "decode_realtime_factor"]
    assert all(c["passed"] for c in report["checks"] if c["kind"] == "quality")
    assert not gates.judge(clip, None, low, limits=gates.Limits.of(high))["passed"]
    big = Rig(["Root", "Chest", "Arm"], clip.rig.parents, clip.rig.offsets * 2, clip.rig.channels, clip.rig.ends)
    other = gates.judge(clip, big, high, samples=5)
    assert other["case"] == "different_character" and len(other["checks"]) == 10
    assert {c["id"]: c["passed"] for c in other["checks"]}["runtime_rotation_equivalence"]
    with pytest.raises(ValueError, match="equal skeletons"):
        gates.judge(clip, big, high, "same_character")
    assert gates.svg(other).count("<text") == 11


def test_agent_operations():
    import json

    ask = lambda operation, **k: agent.answer(json.dumps({"protocol": "v1", "operation": operation, "arguments": k}))
    assert sorted(agent.OPERATIONS) == ["capabilities", "decode", "encode", "inspect", "profile", "quality_gate", "quality_gate_different", "quality_gate_same", "runtime_skeleton"]
    profile = json.loads(ask("profile", source=BVH, target=BVH)[3])
    assert profile["mapped"] == 2 and len(profile["profile"]["sha256"]) == 64
    assert json.loads(ask("runtime_skeleton", text=BVH)[3])["joint_count"] == 2
    for name, more in (("quality_gate", {}), ("quality_gate_same", {}), ("quality_gate_different", {"target": BVH})):
        _, ok, status, result, _ = ask(name, source=BVH, preset="high", **more)
        assert ok and status == 0 and "<svg" in json.loads(result)["visual"]
    assert ask("encode", text=BVH, preset="low", output="a/../../b")[2] == 2 and ask("encode", text=BVH, preset="low", output="a/b")[2] == 0
    assert ask("quality_gate_different", source=BVH, preset="high")[2] == 2


def test_names(spark):
    n = ["mixamorig:Hips", "a:b: Spine2 ", "LeftArm_twist", "ball_r"]
    df = spark.createDataFrame([(x,) for x in n], "n string")
    assert [r[0] for r in df.select(names.meaning(F.col("n"))).collect()] == ["pelvis", "spine", "twist:leftarmtwist", "right_toe"]


def test_rules_name_what_fails(spark):
    df = spark.createDataFrame([("public_data/a", None), ("/x", "y"), ("public_data/../z", "y")], "p string, q string")
    bad = constraints.violations({"path": constraints.relative_path(F.col("p")), "q": F.col("q") == "y"})
    assert [r[0] for r in df.select(bad).collect()] == [["q"], ["path"], ["path"]]


def test_ik_reaches():
    t = np.repeat(np.array([[[0, 0, 0], [0, 1, 0], [0, 1, 0.0]]]), 2, 0)
    r = np.zeros((2, 3, 4))
    r[..., 0] = 1
    goal = {2: np.array([[1.0, 1, 0], [0.4, -1.4, 0.2]])}
    _, p = hierarchy.walk([-1, 0, 1], ik.descend([-1, 0, 1], r, t, {2: [1, 0]}, goal, 200), t)
    assert np.abs(p[:, 2] - goal[2]).max() < 0.05


def test_agent_batch(spark):
    import json

    ask = lambda **k: json.dumps({"protocol": "v1", "request_id": "r", **k})
    lines = [ask(operation="none"), ask(operation="encode", arguments={"text": BVH, "preset": "low"}), "{", " ", ask(operation="encode", arguments={"text": "x", "preset": "low"}), ask(operation="inspect", arguments={"content": "", "more": 1})]
    got = agent.run_batch(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [r["status"] for r in got] == [2, 0, 2, 3, 2]
    content = json.loads(got[1]["result"])["content"]
    again = [ask(operation="decode", arguments={"content": content}), ask(operation="inspect", arguments={"content": content}), ask(operation="capabilities")]
    text, facts, able = (json.loads(agent.answer(x)[3]) for x in again)
    assert bvh.loads(text["text"]).rig.names == ["Hips", "Chest"] and facts["frames"] == 3 and "encode" in able["operations"]


def test_metadata_without_a_field_is_an_error():
    from posegrid.plans.files import RIG

    rest = np.zeros((3, 16, 4))
    rest[..., 0] = 1
    meta, raw = container.opened(container.encode(Clip(RIG, rest, np.repeat(RIG.offsets[None], 3, 0), 1 / 30)))
    assert container.decode_raw(meta, raw).rotations.shape == (3, 16, 4)
    for gone in ("codec", "frame_count", "skeleton"):
        with pytest.raises(ClipError):
            container.decode_raw({k: v for k, v in meta.items() if k != gone}, raw)
    with pytest.raises(ClipError):
        container.open_raw(b"[]", raw)
