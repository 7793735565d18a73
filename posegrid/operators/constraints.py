"""Rules on tables: a row's violations, and checks with limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of evaluation manifests.
VERSION = "0.1.0"
FORBIDDEN_TYPES = [".exe", ".dll", ".zip", ".bvh", ".npz"]
TEXT_TYPES = [".md", ".py", ".json", ".svg", ".txt"]
UNSAFE_SVG = r"(?i)<script|href\s*=\s*[\"']https?:"
ABSOLUTE_PATH = r"(^|[^A-Za-z0-9])([A-Za-z]:\\|/home/|/Users/)"
LAYERS = ["retargeting", "codec_roundtrip", "artist_gold"]


def relative_path(c: Column) -> Column:
    """A POSIX path below ``public_data`` without ways out."""
    return (c != "") & ~c.rlike(r"(^|/)\.\.(/|$)|[\\:]") & c.rlike("^public_data(/|$)")


def inside_workspace(path: Column) -> Column:
    """A relative path that at no step leaves the folder it starts from; a null or empty path is none."""
    step = lambda s: F.when(s.isin("", "."), 0).when(s == "..", -1).otherwise(1)
    walk = F.aggregate(
        F.split(path, "/"), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")),
        lambda a, s: F.struct((a["depth"] + step(s)).alias("depth"), F.least(a["least"], a["depth"] + step(s)).alias("least")),
    )
    return F.coalesce((path != "") & ~F.startswith(path, F.lit("/")) & (walk["least"] >= 0), F.lit(False))


def release_findings(files: DataFrame, allowed: list[str], denied: list[str], most_bytes: int) -> DataFrame:
    """(finding) of ``files`` (path, content binary), each once: what keeps a tree from being published.

    A path of a forbidden type, or of one that nobody reviews, and a file that is too large are not read further.
    """
    path, name = F.col("path"), F.substring_index("path", "/", -1)
    dot = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    read = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    term = lambda c: reduce(lambda a, b: a | b, [F.lower(c).rlike(rf"(^|[^a-z0-9]){t}([^a-z0-9]|$)") for t in denied], F.lit(False))
    say = lambda when, what: F.when(when, F.concat(F.lit(what + ": "), path))
    forbidden, reviewed, large = dot.isin(FORBIDDEN_TYPES), dot.isin(TEXT_TYPES), F.length("content") > most_bytes
    seen = ~forbidden & reviewed & ~large
    found = F.array(
        F.when(~F.substring_index("path", "/", 1).isin(allowed), F.concat(F.lit("unexpected top-level entry: "), F.substring_index("path", "/", 1))),
        say(term(path), "denied term in path"), say(forbidden, "forbidden file type"), say(~forbidden & ~reviewed, "unreviewed file type"),
        say(~forbidden & reviewed & large, "file is too large"), say(seen & read.isNull(), "text file is not valid UTF-8"),
        say(seen & (dot == ".svg") & read.rlike(UNSAFE_SVG), "active or external SVG content"), say(seen & term(read), "denied term in file"),
        say(seen & read.rlike(ABSOLUTE_PATH), "absolute path in file"),
    )
    return files.select(F.explode(F.array_compact(found)).alias("finding")).distinct()


def sha256_hex(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{64}$")


def https(c: Column) -> Column:
    return c.rlike("^https://[^/?#]+")


def violations(rules: dict[str, Column]) -> Column:
    """The names of the rules that do not hold; a rule that is null does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def manifest_rules(datasets: list[str], methods: list[str]) -> dict[str, Column]:
    c = F.col
    return {
        "schema_version": c("schema_version") == VERSION, "dataset": c("dataset").isin(datasets), "method": c("method").isin(methods),
        "quality_layer": c("quality_layer").isin(LAYERS), "track": c("track").isin("automatic", "artist_gold"),
        "adjustment": (c("track") != "automatic") | ~c("per_animation_adjustment"),
        "gold": (c("track") != "artist_gold") | (c("quality_layer") == "artist_gold"),
        "scope": c("configuration_scope") == "skeleton",
        "joints": (c("joint_count") > 0) & ((c("dataset") != "Mixamo") | (c("quality_layer") != "retargeting") | (c("joint_count") == 22)),
        "root": (c("root_index") >= 0) & (c("root_index") < c("joint_count")), "height": c("character_height") > 0,
        "prediction_path": relative_path(c("prediction_path")), "ground_truth_path": relative_path(c("ground_truth_path")),
        "sha256": sha256_hex(c("skeleton_config_sha256")), "provenance": https(c("provenance_url")), "license": F.trim(c("license_note")) != "",
    }


def check(actual: Column, comparator: str, limit: Column) -> Column:
    return actual <= limit if comparator == "<=" else actual >= limit


def gate(measures: DataFrame, limits: dict[str, tuple[str, float]], keys: list[str]) -> DataFrame:
    """(keys, id, actual, comparator, limit, passed): a row for each check of each row of ``measures``."""
    rows = F.array(*[
        F.struct(F.lit(n).alias("id"), F.col(n).cast("double").alias("actual"), F.lit(op).alias("comparator"), F.lit(float(v)).alias("limit"), check(F.col(n), op, F.lit(v)).alias("passed"))
        for n, (op, v) in limits.items()
    ])
    return measures.select(*keys, F.inline(rows))


def verdict(checks: DataFrame, keys: list[str]) -> DataFrame:
    failed = F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("id"))))  # the checks of one report
    return checks.groupBy(*keys).agg(F.bool_and("passed").alias("passed"), F.array_join(failed, ",").alias("failed"))
