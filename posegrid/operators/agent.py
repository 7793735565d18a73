"""A batch of requests, one JSON line each: a bad line never stops a good one.

A request is ``{protocol, request_id, operation, arguments}``. Its answer has ok, the result's JSON
or an error, and a status: 0 done, 2 refused (unreadable, unknown, missing or unexpected arguments, a
path that leaves the workspace), 3 failed while it ran. A batch's status is the largest of its lines.
A gate that does not pass is an answer like any other: its status is 0.

Files are columns here: an operation takes contents and gives contents, and ``output`` only names the
path that a result is for.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posegrid.operators.gates import judge, svg
from posegrid.operators.retarget import Skeleton, compile_profile, core_of
from posegrid.sources import bvh, container
from posegrid.sources.clip import ClipError

# Fixed value of the request format.
PROTOCOL_VERSION = "v1"


def _encode(text: str, preset: str) -> dict:
    clip = bvh.loads(text)
    data = container.encode(clip, container.PRESETS[preset])
    return {"content": base64.b64encode(data).decode(), "raw_bytes": clip.raw_bytes(), "file_bytes": len(data)}


def _decode(content: str) -> dict:
    return {"text": bvh.dumps(container.decode(base64.b64decode(content)))}


def _inspect(content: str) -> dict:
    return container.inspect(base64.b64decode(content))


def _profile(source: str, target: str) -> dict:
    """The profile from one motion text's skeleton to another's."""
    a, b = (Skeleton.of_rig(bvh.loads(t).rig) for t in (source, target))
    profile = compile_profile(a, b)
    if profile.problems():
        raise ValueError("; ".join(profile.problems()))
    shared, mapped = core_of(a, b, profile.pairs)
    return {"profile": profile.document(), "mapped": len(profile.pairs), "shared_core": shared, "mapped_core": mapped}


def _runtime_skeleton(text: str) -> dict:
    rig = bvh.loads(text).rig
    return {"skeleton": rig.document(), "sha256": rig.signature(), "joint_count": len(rig.names)}


def _gate(case: str):
    def run(source: str, preset: str, target: str | None = None) -> dict:
        report = judge(bvh.loads(source), None if target is None else bvh.loads(target).rig, container.PRESETS[preset], case)
        return report | {"failed": [c["id"] for c in report["checks"] if not c["passed"]], "visual": svg(report)}

    return run


#: Each operation with the names of its arguments, and of those that may be left out.
OPERATIONS: dict[str, tuple[Callable[..., dict], tuple[str, ...], tuple[str, ...]]] = {
    "encode": (_encode, ("text", "preset"), ()), "decode": (_decode, ("content",), ()), "inspect": (_inspect, ("content",), ()),
    "profile": (_profile, ("source", "target"), ()), "runtime_skeleton": (_runtime_skeleton, ("text",), ()),
    "quality_gate_same": (_gate("same_character"), ("source", "preset"), ()), "quality_gate_different": (_gate("different_character"), ("source", "target", "preset"), ()),
    "quality_gate": (_gate("auto"), ("source", "preset"), ("target",)),
    "capabilities": (lambda: {"operations": sorted(OPERATIONS), "presets": sorted(container.PRESETS)}, (), ()),
}


def inside(path) -> bool:
    """Whether a path is relative and at no step leaves the folder it starts from."""
    if not isinstance(path, str) or not path or path.startswith("/"):
        return False
    depth = 0
    for step in path.split("/"):
        depth += 0 if step in ("", ".") else -1 if step == ".." else 1
        if depth < 0:
            return False
    return True


def answer(line: str | None) -> tuple[str | None, bool, int, str | None, str | None]:
    """(request_id, ok, status, result, error) of one line."""
    name = None
    try:
        request = json.loads(line or "")
        if not isinstance(request, dict):
            raise ValueError("a request is a JSON object")
        name = request.get("request_id")
        name = None if name is None else str(name)
        if not str(request.get("protocol", "")).endswith(PROTOCOL_VERSION):
            raise ValueError("unknown protocol")
        if request.get("operation") not in OPERATIONS:
            raise ValueError(f"unknown operation {request.get('operation')!r}")
        run, wanted, spare = OPERATIONS[request["operation"]]
        given = dict(request.get("arguments") or {})
        if "output" in given and not inside(given.pop("output")):
            raise ValueError("the output path leaves the workspace")
        missing, unknown = sorted(set(wanted) - set(given)), sorted(set(given) - set(wanted) - set(spare))
        if missing or unknown:
            raise ValueError(f"missing {missing}, unexpected {unknown}")
    except ValueError as e:
        return name, False, 2, None, str(e)
    try:
        return name, True, 0, json.dumps(run(**given), sort_keys=True), None
    except (ClipError, KeyError, TypeError, ValueError, AttributeError) as e:
        return name, False, 3, None, str(e)


def run_batch(requests: DataFrame, column: str = "line") -> DataFrame:
    """(request_id, ok, status, result, error): an answer for each line that is not blank."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string()]
        for b in batches:
            rows = list(zip(*(answer(x.as_py()) for x in b.column(0)), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["request_id", "ok", "status", "result", "error"])

    lines = requests.select(column).where(F.trim(F.coalesce(column, F.lit(""))) != "")
    return lines.mapInArrow(run, "request_id string, ok boolean, status int, result string, error string")
