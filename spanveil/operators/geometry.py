"""Rectangles on images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersection(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The common area of two rectangles with x, y, width and height."""
    side = lambda at, size: F.greatest(F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]), F.lit(0.0))
    return side("x", "width") * side("y", "height")


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    common = intersection(a, b)
    union = a["width"] * a["height"] + b["width"] * b["height"] - common
    return F.when(union > 0, common / union).otherwise(0.0)


def rects_overlap(a: dict[str, Column], b: dict[str, Column], threshold: float = 0.3, least: float = 0.45) -> Column:
    """Do they overlap by their union, or does one lie in the other for the most part?"""
    smaller = F.least(a["width"] * a["height"], b["width"] * b["height"])
    return (iou(a, b) >= threshold) | F.coalesce(F.when(smaller > 0, intersection(a, b) / smaller >= least), F.lit(False))


def clamped(rect: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """The part of a rectangle that lies on an image, at least one pixel in size."""
    x = F.greatest(F.lit(0.0), F.least(rect["x"], width - 1))
    y = F.greatest(F.lit(0.0), F.least(rect["y"], height - 1))
    return {"x": x, "y": y, "width": F.greatest(F.lit(1.0), F.least(rect["width"], width - x)), "height": F.greatest(F.lit(1.0), F.least(rect["height"], height - y))}
