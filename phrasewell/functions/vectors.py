"""Column functions over vectors held as arrays; arithmetic is in double precision and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Defaults of the 8-bit code: values from OFFSET - 128 / SCALE to OFFSET + 127 / SCALE.
OFFSET, SCALE = -2.0, 20.0


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def part(v: Column, first: int, n: int) -> Column:
    """n components from the one numbered first (from 1)."""
    return doubles(F.slice(v, first, n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str = "ip") -> Column:
    """ip: the inner product; l2: minus half the squared distance."""
    if metric == "ip":
        return dot(a, b)
    if metric == "l2":
        return dot(a, b) - 0.5 * (dot(a, a) + dot(b, b))
    raise ValueError(f"unknown metric {metric}")


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def quantize(v: Column, offset: float = OFFSET, scale: float = SCALE) -> Column:
    """Clipped to the 8-bit range first, then rounded half to even."""
    return F.transform(v, lambda x: F.rint(F.greatest(F.lit(-128.0), F.least(F.lit(127.0), (x - offset) * scale))).cast("tinyint"))


def dequantize(v: Column, offset: float | Column = OFFSET, scale: float | Column = SCALE) -> Column:
    return F.transform(v, lambda x: x / scale + offset)


def maybe_dequantize(v: Column, offset: Column, scale: Column) -> Column:
    """v itself where it was stored without an offset."""
    return F.when(offset.isNull(), doubles(v)).otherwise(dequantize(v, offset, scale))


def lift(v: Column, max_norm: Column | float, zeros: int = 0) -> Column:
    """A first component that gives every vector the same norm, so nearest by distance is largest by product; zeros pad the end."""
    first = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) * max_norm * max_norm - dot(v, v)))
    return F.concat(F.array(first), v, F.array_repeat(F.lit(0.0), zeros))


def lift_question(v: Column, zeros: int = 0) -> Column:
    return F.concat(F.array(F.lit(0.0)), v, F.array_repeat(F.lit(0.0), zeros))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance_to_product(l2: Column, max_norm: Column | float | None = None, question_norm: Column | None = None) -> Column:
    """The inner product that a squared distance between lifted vectors stands for."""
    if max_norm is None:
        return -0.5 * l2
    if question_norm is None:
        raise ValueError("question_norm is needed with max_norm")
    return -0.5 * (l2 - question_norm * question_norm - F.lit(1.0) * max_norm * max_norm)


def linear(v: Column, weights: list[float], bias: float) -> Column:
    return dot(v, F.array(*map(F.lit, map(float, weights)))) + bias


def unpack_id(packed: Column, size: int = 100_000_000) -> tuple[Column, Column]:
    """(shard offset, index in the shard) of a packed id."""
    return (F.floor(packed / size) * size).cast("long"), (packed % size).cast("long")


def text_of(v: Column, digits: int = 6) -> Column:
    """The components as comma-joined decimals, for results that are compared."""
    return F.array_join(F.transform(v, lambda x: F.format_number(x, f"0.{'0' * digits}")), ",")
