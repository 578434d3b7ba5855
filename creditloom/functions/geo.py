"""Postal codes and great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KM_PER_DEGREE = 111.045


def compact_postal(code: Column) -> Column:
    return F.regexp_replace(code, r"\s+", "")


def split_postal(code: Column) -> tuple[Column, Column]:
    """(region, delivery unit) of a postal code with or without blanks."""
    compact = compact_postal(code)
    return F.substring(compact, 1, 3), F.substring(compact, 4, 6)


def cosine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Cosine of the angle between two points (spherical law of cosines)."""
    a, b = F.radians(lat1), F.radians(lat2)
    return F.cos(a) * F.cos(b) * F.cos(F.radians(lon1 - lon2)) + F.sin(a) * F.sin(b)


def km_of_cosine(value: Column) -> Column:
    """Great-circle distance of that angle; the clamp absorbs rounding for coincident points."""
    return F.lit(KM_PER_DEGREE) * F.degrees(F.acos(F.least(F.lit(1.0), value)))


def geo_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return km_of_cosine(cosine(lat1, lon1, lat2, lon2))
