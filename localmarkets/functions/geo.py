"""Distances, boxes, grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = 6371000.0) -> Column:
    """Great-circle distance in the unit of the radius; metres by default."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * radius)


def distance_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return haversine(lat1, lng1, lat2, lng2, 6371.0)


def in_denmark(lat: Column, lng: Column) -> Column:
    return F.coalesce(lat.between(54.4, 57.9) & lng.between(7.8, 15.3), F.lit(False))


def snap(v: Column, size: Column) -> Column:
    return F.floor(v / size + 0.5) * size


def blur(lat: Column, lng: Column, size: float = 0.02) -> Column:
    """struct(lat, lng) at the centre of a cell that is about as wide as high."""
    wide = F.lit(size) / F.greatest(F.lit(0.3), F.cos(F.radians(lat)))
    return F.struct(F.round(snap(lat, F.lit(size)), 5).alias("lat"), F.round(snap(lng, wide), 5).alias("lng"))


def coarsen(v: Column) -> Column:
    return F.floor(v * 1000 + 0.5) / 1000


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def near_cells(v: Column, size: float) -> Column:
    """The cell and its two neighbours on one axis."""
    return F.sequence(cell(v, size) - 1, cell(v, size) + 1)
