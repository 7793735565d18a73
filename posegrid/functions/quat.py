"""Quaternion algebra as Column expressions. A quaternion is a tuple of four columns (w, x, y, z)."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

Quat = tuple[Column, Column, Column, Column]
Vec = tuple[Column, Column, Column]

#: Above this dot product interpolation is linear.
NEARLY_EQUAL = 0.9995
#: A shorter quaternion has no direction.
SHORTEST = 1e-12


def identity() -> Quat:
    return F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)


def quat(prefix: str = "q") -> Quat:
    """The columns ``<prefix>w`` to ``<prefix>z``."""
    return tuple(F.col(prefix + c) for c in "wxyz")


def named(q: Quat, prefix: str = "q") -> list[Column]:
    return [c.alias(prefix + n) for c, n in zip(q, "wxyz", strict=True)]


def dot(a, b) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def length(a) -> Column:
    return F.sqrt(dot(a, a))


def normalize(q: Quat, check: bool = False) -> Quat:
    """Unit length; a quaternion without direction gives nulls, or an error with ``check``."""
    n = length(q)
    short = F.raise_error(F.lit("quaternion of zero length")) if check else F.lit(None)
    return tuple(F.when(n > SHORTEST, c / n).otherwise(short.cast("double") if not check else short) for c in q)


def multiply(a: Quat, b: Quat) -> Quat:
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return (
        aw * bw - ax * bx - ay * by - az * bz,
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
    )


def conjugate(q: Quat) -> Quat:
    return q[0], -q[1], -q[2], -q[3]


def rotate(q: Quat, v: Vec) -> Vec:
    """The vector turned by the unit quaternion."""
    w, x, y, z = q
    tx, ty, tz = 2 * (y * v[2] - z * v[1]), 2 * (z * v[0] - x * v[2]), 2 * (x * v[1] - y * v[0])
    return (
        v[0] + w * tx + (y * tz - z * ty),
        v[1] + w * ty + (z * tx - x * tz),
        v[2] + w * tz + (x * ty - y * tx),
    )


def axis_angle(axis: str, angle: Column) -> Quat:
    s, c = F.sin(angle / 2), F.cos(angle / 2)
    return (c, *(s if a == axis else F.lit(0.0) for a in "XYZ"))


def turns(order: str, halves) -> Quat:
    """The product of axis rotations in the order of ``order``, from the (cosine, sine) of each half angle.

    Terms with a component that an axis rotation lacks are left out, so three different axes give two terms a component.
    """
    out = {0: halves[0][0], 1 + "XYZ".index(order[0]): halves[0][1]}
    for axis, (c, s) in zip(order[1:], halves[1:], strict=True):
        j, terms = 1 + "XYZ".index(axis), {}
        for i, part in out.items():
            terms.setdefault(i, []).append((part * c, False))
            terms.setdefault(i ^ j, []).append((part * s, i == j or i > 0 and (j - i) % 3 == 2))
        out = {}
        for k, found in terms.items():
            first, *rest = sorted(found, key=lambda t: t[1])
            out[k] = -first[0] if first[1] else first[0]
            for part, negative in rest:
                out[k] = out[k] - part if negative else out[k] + part
    return tuple(out.get(k, F.lit(0.0)) for k in range(4))


def from_euler(order: str, angles) -> Quat:
    """The product of axis rotations in the order of ``order``; one angle (radians) for each letter.

    Over several orders take ``turns`` of half angles, and ``normalize`` in a select of its own.
    """
    return normalize(turns(order, [(F.cos(a / 2), F.sin(a / 2)) for a in angles]))


def to_matrix(q: Quat) -> list[list[Column]]:
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def from_matrix(m) -> Quat:
    """By the trace if it is positive, else by the largest diagonal entry, the first of equal ones.

    Of unit length as far as the matrix is a rotation; ``normalize`` it in a select of its own,
    for the expression is too large to repeat.
    """
    trace = m[0][0] + m[1][1] + m[2][2]
    d = [m[0][0], m[1][1], m[2][2]]

    def by(i: int) -> Quat:
        j, k = (i + 1) % 3, (i + 2) % 3
        s = F.sqrt(F.greatest(F.lit(0.0), 1 + m[i][i] - m[j][j] - m[k][k])) * 2
        out = [None] * 4
        out[0] = (m[k][j] - m[j][k]) / s
        out[1 + i] = s / 4
        out[1 + j] = (m[j][i] + m[i][j]) / s
        out[1 + k] = (m[k][i] + m[i][k]) / s
        return tuple(out)

    s = F.sqrt(F.greatest(F.lit(0.0), trace + 1)) * 2
    positive = (s / 4, (m[2][1] - m[1][2]) / s, (m[0][2] - m[2][0]) / s, (m[1][0] - m[0][1]) / s)
    first, second = (d[0] >= d[1]) & (d[0] >= d[2]), d[1] >= d[2]
    arms = list(zip(positive, by(0), by(1), by(2), strict=True))
    return tuple(F.when(trace > 0, p).when(first, a).when(second, b).otherwise(c) for p, a, b, c in arms)


def slerp(a: Quat, b: Quat, u: Column) -> Quat:
    """Along the shorter arc; nearly equal quaternions are mixed linearly."""
    d = dot(a, b)
    sign = F.when(d < 0, -1.0).otherwise(1.0)
    d = F.least(F.lit(1.0), F.abs(d))
    theta = F.acos(d)
    near = d > NEARLY_EQUAL
    s = F.when(near, 1.0).otherwise(F.sin(theta))
    wa = F.when(near, 1 - u).otherwise(F.sin((1 - u) * theta) / s)
    wb = F.when(near, u).otherwise(F.sin(u * theta) / s) * sign
    return normalize(tuple(wa * x + wb * y for x, y in zip(a, b, strict=True)))


def to_euler(q: Quat, order: str) -> list[Column]:
    """Angles (radians) in the order of ``order`` of the product of axis rotations; three different axes.

    With the axes i, j, k of the order the matrix R = Ri Rj Rk has sin(second) at [i][k]; where that
    is one, the third angle is 0.
    """
    i, j, k = ("XYZ".index(c) for c in order)
    parity = 1.0 if (i, j, k) in ((0, 1, 2), (1, 2, 0), (2, 0, 1)) else -1.0
    m = to_matrix(q)
    sine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), parity * m[i][k]))
    free = F.sqrt(m[i][i] * m[i][i] + m[i][j] * m[i][j]) > 1e-9
    first = F.when(free, F.atan2(-parity * m[j][k], m[k][k])).otherwise(F.atan2(parity * m[k][j], m[j][j]))
    third = F.when(free, F.atan2(-parity * m[i][j], m[i][i])).otherwise(0.0)
    return [first, F.asin(sine), third]


def angle_degrees(a: Quat, b: Quat) -> Column:
    """The angle between two rotations."""
    d = F.abs(dot(normalize(a), normalize(b)))
    return 2 * F.acos(F.least(F.lit(1.0), d)) * (180 / pi)


def canonical(q: Quat) -> Quat:
    """The one of q and -q whose first component that is not zero is positive."""
    w, x, y, z = q
    flip = (w < 0) | ((w == 0) & ((x < 0) | ((x == 0) & ((y < 0) | ((y == 0) & (z < 0))))))
    return tuple(F.when(flip, -c).otherwise(c) for c in q)
