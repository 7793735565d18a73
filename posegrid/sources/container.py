"""The key container: a fixed prefix, canonical JSON, and one compressed payload of tracks."""

from __future__ import annotations

import json
import struct
import zlib
from dataclasses import dataclass

import numpy as np

from posegrid.operators.keys import np_slerp, reduce_track, rotation_error, scalar_error
from posegrid.sources.clip import Clip, ClipError, Rig, canonical

# Fixed values of the file format.
MAGIC = b"SKACANIM"
SCHEMA = "skac.animation"
SCHEMA_VERSION = "1.0.0"
CODEC = "key_reduced_smallest_three_v1"
PREFIX = struct.Struct("<8sHHIIQQII")
MAJOR, MINOR = 1, 0
ZLIB = 1
MOST_METADATA = 8 << 20
MOST_PAYLOAD = 512 << 20
MOST_FRAMES = 100_000_000
LIMIT = 0.5**0.5


@dataclass(frozen=True)
class Preset:
    quality: str
    rotation_bits: int
    translation_bits: int
    degrees: float
    fraction: float
    level: int


PRESETS = {p.quality: p for p in (Preset("low", 10, 12, 1.0, 1e-3, 6), Preset("medium", 13, 16, 0.25, 1e-4, 9), Preset("high", 16, 20, 0.05, 1e-5, 9))}


def pack_fields(columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Rows of unsigned fields, low bits first; each column has its width."""
    if not columns or not len(columns[0][0]):
        return b""
    bits = [(c.astype(np.uint64)[:, None] >> np.arange(w, dtype=np.uint64)) & np.uint64(1) for c, w in columns]
    return np.packbits(np.hstack(bits).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_fields(data: bytes, rows: int, widths: list[int]) -> list[np.ndarray]:
    width = sum(widths)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: rows * width].reshape(rows, width).astype(np.int64)
    out, at = [], 0
    for w in widths:
        out.append(bits[:, at : at + w] @ (1 << np.arange(w, dtype=np.int64)))
        at += w
    return out


def pack_indices(indices: np.ndarray) -> bytes:
    """Differences as variable-length integers, seven bits a byte."""
    out = bytearray()
    for d in np.diff(indices, prepend=0).tolist():
        while d >= 128:
            out.append(d & 127 | 128)
            d >>= 7
        out.append(d)
    return bytes(out)


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ClipError("the payload ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def indices(self, frames: int, count: int) -> np.ndarray:
        (n,) = struct.unpack("<I", self.take(4))
        if not 1 <= n <= frames or n != count:
            raise ClipError("a track has an impossible number of keys, or not the declared one")
        steps = []
        for _ in range(n):
            value = shift = 0
            while True:
                (b,) = self.take(1)
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    break
                if shift >= 35:
                    raise ClipError("a key index is too long")
            steps.append(value)
        out = np.cumsum(steps)
        if out[0] != 0 or (np.diff(out) <= 0).any() or out[-1] >= frames or (n > 1 and out[-1] != frames - 1):
            raise ClipError("key indices must rise from the first frame to the last")
        return out


def quantize(values: np.ndarray, low: float, high: float, bits: int) -> np.ndarray:
    if high <= low:
        return np.zeros(len(values), np.int64)
    return np.rint(np.clip((values - low) / (high - low), 0, 1) * ((1 << bits) - 1)).astype(np.int64)


def smallest_three(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    omitted = np.abs(q).argmax(1)
    q = q * np.where(q[np.arange(len(q)), omitted] < 0, -1, 1)[:, None]
    return omitted, q[np.arange(4) != omitted[:, None]].reshape(-1, 3)


def restored(omitted: np.ndarray, three: np.ndarray) -> np.ndarray:
    out = np.empty((len(three), 4))
    mask = np.arange(4) != omitted[:, None]
    out[mask] = three.ravel()
    out[~mask] = np.sqrt(np.maximum(0, 1 - (three**2).sum(1)))
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def spread(keys: np.ndarray, frames: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each frame the keys around it and its share between them."""
    at = np.arange(frames)
    if len(keys) == 1:
        return np.zeros(frames, int), np.zeros(frames, int), np.zeros(frames)
    a = np.clip(np.searchsorted(keys, at, side="right") - 1, 0, len(keys) - 2)
    return a, a + 1, (at - keys[a]) / (keys[a + 1] - keys[a])


def encode(clip: Clip, preset: Preset = PRESETS["high"]) -> bytes:
    rig, p = clip.rig, preset
    turns, moves = bytearray(), bytearray()
    turn_keys, move_keys, lows, highs = [], [], [], []
    for j in rig.turning():
        keys = reduce_track(clip.rotations[:, j], p.degrees, rotation_error)
        omitted, three = smallest_three(clip.rotations[keys, j])
        fields = [(omitted, 2), *((quantize(three[:, k], -LIMIT, LIMIT, p.rotation_bits), p.rotation_bits) for k in range(3))]
        turns += struct.pack("<I", len(keys)) + pack_indices(keys) + pack_fields(fields)
        turn_keys.append(len(keys))
    for j, a in rig.moving():
        track = clip.translations[:, j, a]
        low, high = float(track.min()), float(track.max())
        keys = reduce_track(track[:, None], max((high - low) * p.fraction, 1e-12), scalar_error)
        moves += struct.pack("<I", len(keys)) + pack_indices(keys) + pack_fields([(quantize(track[keys], low, high, p.translation_bits), p.translation_bits)])
        move_keys.append(len(keys))
        lows.append(low)
        highs.append(high)
    n = len(clip.rotations)
    document = {
        "schema": SCHEMA, "schema_version": SCHEMA_VERSION, "frame_count": n, "frame_time": clip.frame_time, "duration_seconds": (n - 1) * clip.frame_time,
        "skeleton": rig.document(), "skeleton_sha256": rig.signature(),
        "codec": {
            "name": CODEC, "quality": p.quality, "rotation_bits": p.rotation_bits, "translation_bits": p.translation_bits,
            "rotation_error_degrees": p.degrees, "translation_error_fraction": p.fraction,
            "rotation_joints": rig.turning(), "rotation_key_counts": turn_keys, "translation_components": [list(c) for c in rig.moving()], "translation_key_counts": move_keys,
            "translation_minima": lows, "translation_maxima": highs, "rotation_payload_bytes": len(turns), "translation_payload_bytes": len(moves), "compression": "zlib",
        },
    }
    return framed(document, bytes(turns + moves), p.level)


def framed(document: dict, raw: bytes, level: int = 9) -> bytes:
    """The file of a metadata document and a raw payload."""
    meta, payload = canonical(document).encode(), zlib.compress(raw, level)
    return PREFIX.pack(MAGIC, MAJOR, MINOR, ZLIB, len(meta), len(payload), len(raw), zlib.crc32(meta), zlib.crc32(payload)) + meta + payload


def opened(data: bytes) -> tuple[dict, bytes]:
    """The checked metadata and inflated payload; lengths and CRCs come before anything is inflated."""
    if len(data) < PREFIX.size:
        raise ClipError("the file is shorter than its prefix")
    magic, major, minor, flags, n_meta, n_payload, n_raw, crc_meta, crc_payload = PREFIX.unpack_from(data)
    if magic != MAGIC or (major, minor) != (MAJOR, MINOR) or flags != ZLIB:
        raise ClipError("unknown magic, version or flags")
    if n_meta > MOST_METADATA or n_raw > MOST_PAYLOAD:
        raise ClipError("the file declares too large a size")
    if len(data) != PREFIX.size + n_meta + n_payload:
        raise ClipError(f"the file has {len(data)} bytes, its expected size is {PREFIX.size + n_meta + n_payload}")
    meta, payload = data[PREFIX.size : PREFIX.size + n_meta], data[PREFIX.size + n_meta :]
    if zlib.crc32(meta) != crc_meta or zlib.crc32(payload) != crc_payload:
        raise ClipError("CRC mismatch")
    inflate = zlib.decompressobj()
    try:
        document = json.loads(meta.decode("utf-8"))
        raw = inflate.decompress(payload, n_raw + 1)
    except (ValueError, zlib.error) as e:
        raise ClipError("the file can't be read") from e
    if len(raw) != n_raw or not inflate.eof or inflate.unused_data:
        raise ClipError("the payload does not have its declared size")
    if not isinstance(document, dict) or document.get("schema") != SCHEMA or document.get("schema_version") != SCHEMA_VERSION:
        raise ClipError("unknown schema")
    return document, raw


def decode(data: bytes) -> Clip:
    return decode_raw(*opened(data))


def open_raw(metadata: bytes, raw: bytes) -> Clip:
    """A clip from its metadata text and a payload that a host has inflated already."""
    if not metadata or len(metadata) > MOST_METADATA or len(raw) > MOST_PAYLOAD:
        raise ClipError("the metadata or payload is empty or too large")
    try:
        document = json.loads(metadata.decode("utf-8"))
    except ValueError as e:
        raise ClipError("the metadata can't be read") from e
    if not isinstance(document, dict) or document.get("schema") != SCHEMA or document.get("schema_version") != SCHEMA_VERSION:
        raise ClipError("unknown schema")
    return decode_raw(document, raw)


def decode_raw(document: dict, raw: bytes) -> Clip:
    """A clip from its metadata and the inflated payload; metadata that lack a field are an error of the clip."""
    try:
        return _decode(document, raw)
    except (KeyError, TypeError, AttributeError) as e:
        raise ClipError(f"the metadata lack a field or have it in another type: {e}") from e


def _decode(document: dict, raw: bytes) -> Clip:
    rig, c, n = Rig.of(document["skeleton"]), document["codec"], document["frame_count"]
    problems = [
        not (isinstance(n, int) and 1 <= n <= MOST_FRAMES), c["name"] != CODEC, rig.signature() != document["skeleton_sha256"],
        not (8 <= c["rotation_bits"] <= 20 and 8 <= c["translation_bits"] <= 24), c["rotation_joints"] != rig.turning(),
        [tuple(x) for x in c["translation_components"]] != rig.moving(), c["rotation_payload_bytes"] + c["translation_payload_bytes"] != len(raw),
    ]
    if any(problems):
        raise ClipError("the metadata contradicts itself")
    rotations = np.zeros((n, len(rig.names), 4))
    rotations[..., 0] = 1
    translations = np.repeat(rig.offsets[None], n, 0)
    part, b = Cursor(raw), c["rotation_bits"]
    if len(c["rotation_key_counts"]) != len(rig.turning()) or len(c["translation_key_counts"]) != len(rig.moving()):
        raise ClipError("there is not a count of keys for each track")
    for j, count in zip(rig.turning(), c["rotation_key_counts"], strict=True):
        keys = part.indices(n, count)
        omitted, *three = unpack_fields(part.take((len(keys) * (2 + 3 * b) + 7) // 8), len(keys), [2, b, b, b])
        q = restored(omitted, np.stack(three, 1) / ((1 << b) - 1) * (2 * LIMIT) - LIMIT)
        x, y, u = spread(keys, n)
        rotations[:, j] = q[0] if len(keys) == 1 else np_slerp(q[x], q[y], u)
    if part.at != c["rotation_payload_bytes"]:
        raise ClipError("the rotation section does not have its declared size")
    b = c["translation_bits"]
    for (j, a), low, high, count in zip(rig.moving(), c["translation_minima"], c["translation_maxima"], c["translation_key_counts"], strict=True):
        keys = part.indices(n, count)
        (code,) = unpack_fields(part.take((len(keys) * b + 7) // 8), len(keys), [b])
        v = low + code / ((1 << b) - 1) * (high - low)
        x, y, u = spread(keys, n)
        translations[:, j, a] = v[0] if len(keys) == 1 else v[x] + u * (v[y] - v[x])
    if part.at != len(raw):
        raise ClipError("bytes are left after the last track")
    return Clip(rig, rotations, translations, float(document["frame_time"])).check()


def inspect(data: bytes) -> dict:
    """What the metadata says; tracks are not decoded."""
    document, raw = opened(data)
    c = document["codec"]
    return {
        "frames": document["frame_count"], "joints": len(document["skeleton"]["names"]), "quality": c["quality"], "file_bytes": len(data), "raw_bytes": len(raw),
        "rotation_keys": sum(c["rotation_key_counts"]), "translation_keys": sum(c["translation_key_counts"]),
    }
