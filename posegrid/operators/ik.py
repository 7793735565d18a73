"""Cyclic coordinate descent: limbs are turned until their ends meet their goals."""

from __future__ import annotations

import numpy as np

from posegrid.operators.hierarchy import np_conjugate, np_multiply, walk


def shortest_turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unit quaternions that turn directions a to b; opposite directions turn about any axis across."""
    a = a / np.linalg.norm(a, axis=-1, keepdims=True)
    b = b / np.linalg.norm(b, axis=-1, keepdims=True)
    w = 1 + (a * b).sum(-1)
    v = np.cross(a, b)
    back = w < 1e-9
    side = np.where(np.abs(a[:, :1]) < 0.9, [[1.0, 0, 0]], [[0, 1.0, 0]])
    v = np.where(back[:, None], np.cross(a, side), v)
    q = np.concatenate([np.where(back, 0.0, w)[:, None], v], 1)
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def descend(parents: list[int], rotations: np.ndarray, translations: np.ndarray, chains: dict[int, list[int]], goals: dict[int, np.ndarray], rounds: int) -> np.ndarray:
    """New local rotations (F, J, 4). ``chains``: for each end its joints from the end inward; frames are independent."""
    out = rotations.copy()
    for _ in range(rounds):
        for end, chain in chains.items():
            for joint in chain:
                g, p = walk(parents, out, translations)
                have, want = p[:, end] - p[:, joint], goals[end] - p[:, joint]
                ok = (np.linalg.norm(have, axis=1) > 1e-8) & (np.linalg.norm(want, axis=1) > 1e-8)
                if ok.any():
                    turned = np_multiply(shortest_turn(have[ok], want[ok]), g[ok, joint])
                    up = parents[joint]
                    out[ok, joint] = turned if up < 0 else np_multiply(np_conjugate(g[ok, up]), turned)
    return out
