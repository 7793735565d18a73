"""Quantisers and sizes of the key codec as Column expressions."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: No component but the largest exceeds this in a unit quaternion.
LIMIT = 1 / sqrt(2)


def quantize(value: Column, low: Column, high: Column, bits: int) -> Column:
    """A code of ``bits`` bits for a value between low and high, half to even; an empty range gives 0."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / F.when(high > low, high - low).otherwise(1.0)))
    return F.when(high > low, F.rint(share * ((1 << bits) - 1)).cast("long")).otherwise(F.lit(0).cast("long"))


def dequantize(code: Column, low: Column, high: Column, bits: int) -> Column:
    return low + code.cast("double") / ((1 << bits) - 1) * (high - low)


def smallest_three(q: tuple[Column, ...], bits: int) -> tuple[Column, Column]:
    """(omitted, codes): the place of the first largest component and the codes of the other three in order."""
    size = F.array(*[F.abs(c) for c in q])
    omitted = (F.array_position(size, F.array_max(size)) - 1).cast("int")
    values = F.array(*q)
    sign = F.when(F.get(values, omitted) < 0, -1.0).otherwise(1.0)
    low, high = F.lit(-LIMIT), F.lit(LIMIT)
    codes = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i != omitted), lambda i: quantize(sign * F.get(values, i), low, high, bits)
    )
    return omitted, codes


def from_smallest_three(omitted: Column, codes: Column, bits: int) -> tuple[Column, ...]:
    """The quaternion with a positive omitted component; ``normalize`` it in a select of its own."""
    v = [dequantize(F.get(codes, F.lit(i)), F.lit(-LIMIT), F.lit(LIMIT), bits) for i in range(3)]
    rest = F.sqrt(F.greatest(F.lit(0.0), 1 - (v[0] * v[0] + v[1] * v[1] + v[2] * v[2])))
    q = []
    for k in range(4):
        # components before the omitted one keep their place, those after it move up
        before = v[k] if k < 3 else None
        after = v[k - 1] if k > 0 else None
        c = F.when(omitted == k, rest)
        c = c.when(omitted > k, before) if before is not None else c
        q.append(c.otherwise(after) if after is not None else c)
    return tuple(q)


def varuint_bytes(value: Column) -> Column:
    """The bytes of a value in groups of seven bits."""
    out = F.lit(1)
    for k in range(1, 5):
        out = out + F.when(value >= (1 << (7 * k)), 1).otherwise(0)
    return out.cast("long")


def packed_bytes(count: Column, bits: int) -> Column:
    return F.ceil(count * bits / 8).cast("long")
