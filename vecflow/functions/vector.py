"""Vector arithmetic as column expressions (JVM side). Vectors are array<double>; no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def inner_product(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; a zero vector counts as orthogonal to all."""
    return 1 - inner_product(a, b) / (F.greatest(norm(a), F.lit(EPSILON)) * F.greatest(norm(b), F.lit(EPSILON)))


def normalized(a: Column) -> Column:
    return F.transform(a, lambda x: x / F.greatest(norm(a), F.lit(EPSILON)))


def residual(a: Column, centroid: Column) -> Column:
    return F.zip_with(a, centroid, lambda x, y: x - y)


def subspaces(a: Column, parts: int, dimension: int) -> list[Column]:
    """Equal slices; the last takes what is left."""
    width = dimension // parts
    return [F.slice(a, i * width + 1, width if i < parts - 1 else dimension - i * width) for i in range(parts)]


def similarity(distance: Column, metric: str) -> Column:
    """Similarity of unit vectors from l2, l2_squared or cosine distance."""
    if metric == "l2":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance * distance / 2))
    return 1 - distance / 2 if metric == "l2_squared" else 1 - distance


def thirds(a: Column) -> Column:
    """Three coordinates of a vector where no projection was fitted: the mean of each third, times 30."""
    third = F.ceil(F.size(a) / 3).cast("int")
    part = lambda i: F.slice(a, i * third + 1, third)
    return F.array(*[F.when(F.size(part(i)) > 0, total(part(i)) / F.size(part(i)) * 30).otherwise(F.lit(0.0)) for i in range(3)])


def projected(a: Column, mean: Column, components: list[Column], scale: Column) -> Column:
    """Coordinates of a vector under a fitted projection."""
    centred = F.zip_with(a, mean, lambda x, m: x - m)
    return F.array(*[inner_product(centred, c) * scale for c in components])
