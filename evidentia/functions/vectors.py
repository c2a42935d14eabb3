"""Vector and box arithmetic in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import _col


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def box_area(b: str) -> Column:
    return (F.col(f"{b}_xmax") - F.col(f"{b}_xmin")) * (F.col(f"{b}_ymax") - F.col(f"{b}_ymin"))


def iou(a: str, b: str) -> Column:
    """Intersection over union of boxes held as ``a_xmin`` and so on."""
    w = F.greatest(F.lit(0.0), F.least(f"{a}_xmax", f"{b}_xmax") - F.greatest(f"{a}_xmin", f"{b}_xmin"))
    h = F.greatest(F.lit(0.0), F.least(f"{a}_ymax", f"{b}_ymax") - F.greatest(f"{a}_ymin", f"{b}_ymin"))
    union = box_area(a) + box_area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def to_pixels(c: str | Column, size: int) -> Column:
    """A share of the page as a pixel."""
    return (_col(c) * size).cast("int")


def fraction_score(numerator: str | Column, denominator: str | Column) -> Column:
    """A fraction on a scale to ten, halves to the even number."""
    return F.when(_col(denominator) != 0, F.bround(_col(numerator) / _col(denominator) * 10)).cast("int")
