"""Geometry, bands, vectors and rates as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = ("small", "medium", "large")


def band(fraction: Column) -> Column:
    """small below 0.02, medium to 0.05 inclusive, else large; null for null."""
    return F.when(fraction < 0.02, "small").when(fraction <= 0.05, "medium").when(fraction > 0.05, "large")


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of (x1, y1, x2, y2); 0 without overlap."""
    inter = box_area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    union = box_area(*a) + box_area(*b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def overlaps(a: tuple[Column, ...], b: tuple[Column, ...], margin: float = 2) -> Column:
    return ~((a[2] + margin < b[0]) | (b[2] + margin < a[0]) | (a[3] + margin < b[1]) | (b[3] + margin < a[1]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union == 0, 1.0).otherwise(inter / union)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    n = F.greatest(norm(v), F.lit(eps))
    return F.transform(v, lambda x: x.cast("double") / n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def anneal_factor(step: Column, total: Column, start: float = 1.0, end: float = 0.25, schedule: str = "cosine") -> Column:
    """From start to end over total steps; end where total is not positive."""
    t = F.least(F.greatest(step / total, F.lit(0.0)), F.lit(1.0))
    linear = start + (end - start) * t
    cosine = end + (start - end) * 0.5 * (1 + F.cos(math.pi * t))
    return F.when(total <= 0, end).otherwise(cosine if schedule == "cosine" else linear)


def resolve_k(n: int, spec: str | int = "sqrt") -> int:
    return min(max(round(math.sqrt(n)) if spec == "sqrt" else int(spec), 1), max(n, 1))


def rate(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = rate(tp, tp + fp), rate(tp, tp + fn)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
