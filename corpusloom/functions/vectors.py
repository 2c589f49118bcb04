"""Vector and geometry functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def hash_bucket(token: Column, dims: int) -> Column:
    """Bucket of a token from the first eight hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dims


def hash_sign(token: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(token), 9, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


def box_area(b: Column) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    return w * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    union = box_area(a) + box_area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def center_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow((a[0] + a[2] - b[0] - b[2]) / 2, F.lit(2.0)) + F.pow((a[1] + a[3] - b[1] - b[3]) / 2, F.lit(2.0)))


def union_box(a: Column, b: Column) -> Column:
    return F.array(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))
