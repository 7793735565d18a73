"""What a scene holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scene_summary(objects: DataFrame, keys=("scene",)) -> DataFrame:
    """Counts of armatures, bones, meshes, distinct materials, actions and key frames, and the images that are missing.

    ``objects``: ``keys``, kind (ARMATURE, MESH, ACTION, IMAGE), name, n (an armature's bones, an
    action's keys), materials (a mesh's), packed (an image's data is in the scene), found (or its file is there).
    """
    # a mesh is one row and a row for each material, so that a single aggregation counts both
    slots = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.when(F.col("kind") == "MESH", F.col("materials")), F.array().cast("array<string>")))
    rows = objects.select(*keys, "kind", "name", "n", "packed", "found", F.posexplode(slots).alias("at", "material"))
    of = lambda kind: (F.col("kind") == kind) & (F.col("at") == 0)
    total = lambda kind: F.coalesce(F.sum(F.when(of(kind), F.col("n"))), F.lit(0)).cast("long")
    lost = of("IMAGE") & ~F.coalesce("packed", F.lit(False)) & ~F.coalesce("found", F.lit(False))
    return rows.groupBy(*keys).agg(
        F.count_if(of("ARMATURE")).alias("armature_count"), total("ARMATURE").alias("bone_count"), F.count_if(of("MESH")).alias("mesh_count"),
        F.count_distinct("material").alias("material_count"), F.count_if(of("ACTION")).alias("action_count"), total("ACTION").alias("keyframe_count"),
        F.array_join(F.sort_array(F.collect_list(F.when(lost, F.col("name")))), ",").alias("missing"),
    )
