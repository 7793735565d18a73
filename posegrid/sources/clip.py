"""A clip in memory: what one file holds."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np

AXES = {"X": 0, "Y": 1, "Z": 2}


class ClipError(ValueError):
    """A file that breaks its format."""


@dataclass
class Rig:
    names: list[str]
    parents: list[int]
    offsets: np.ndarray
    channels: list[list[str]]
    ends: list[list[float] | None]

    def check(self) -> "Rig":
        if not self.names or any(not n or n != n.strip() for n in self.names) or len(set(self.names)) < len(self.names):
            raise ClipError("joint names must be given, stripped and unique")
        if self.parents[0] != -1 or any(not 0 <= p < i for i, p in enumerate(self.parents) if i):
            raise ClipError("a parent must come before its joint")
        for name, c in zip(self.names, self.channels, strict=True):
            turns = sorted(x[0] for x in c if x.endswith("rotation"))
            known = all(x[0] in AXES and x[1:] in ("position", "rotation") for x in c)
            if not known or len(set(c)) < len(c) or turns not in ([], ["X", "Y", "Z"]):
                raise ClipError(f"joint {name!r} has unusable channels")
        if not np.isfinite(self.offsets).all():
            raise ClipError("offsets must be finite")
        return self

    def document(self) -> dict:
        return {
            "names": self.names, "parents": [int(p) for p in self.parents], "offsets": np.asarray(self.offsets, float).tolist(), "channels": [list(c) for c in self.channels],
            "end_site_offsets": [list(map(float, e)) if e is not None else [0.0, 0.0, 0.0] for e in self.ends], "has_end_sites": [e is not None for e in self.ends],
        }

    @classmethod
    def of(cls, d: dict) -> "Rig":
        ends = [list(e) if h else None for e, h in zip(d["end_site_offsets"], d["has_end_sites"], strict=True)]
        return cls([str(n) for n in d["names"]], [int(p) for p in d["parents"]], np.array(d["offsets"], float).reshape(-1, 3), [list(c) for c in d["channels"]], ends).check()

    def turning(self) -> list[int]:
        return [j for j, c in enumerate(self.channels) if any(x.endswith("rotation") for x in c)]

    def moving(self) -> list[tuple[int, int]]:
        return [(j, AXES[x[0]]) for j, c in enumerate(self.channels) for x in c if x.endswith("position")]

    def signature(self) -> str:
        return hashlib.sha256(canonical(self.document()).encode()).hexdigest()


def canonical(value) -> str:
    """Compact JSON with sorted keys and Python's shortest floats: what content hashes are taken of."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


@dataclass
class Clip:
    rig: Rig
    rotations: np.ndarray
    translations: np.ndarray
    frame_time: float

    def check(self) -> "Clip":
        n = np.linalg.norm(self.rotations, axis=-1, keepdims=True)
        if len(self.rotations) < 1 or not np.isfinite(self.rotations).all() or not np.isfinite(self.translations).all():
            raise ClipError("a clip needs frames with finite values")
        if (n <= 1e-12).any():
            raise ClipError("a rotation has no length")
        if not (np.isfinite(self.frame_time) and self.frame_time > 0):
            raise ClipError("the frame time must be positive")
        self.rotations = self.rotations / n
        return self

    def raw_bytes(self) -> int:
        """As 32-bit floats, one a channel and frame."""
        return len(self.rotations) * sum(map(len, self.rig.channels)) * 4
