"""Great-circle distance from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_MILES = 3958.7613
# No two places are further apart than half the circumference.
MAX_DISTANCE_MILES = 12_440.0


def miles(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Haversine distance between two points given in degrees."""
    half_lat = F.sin(F.radians(lat_b - lat_a) / 2)
    half_lon = F.sin(F.radians(lon_b - lon_a) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half_lon * half_lon
    return 2 * EARTH_RADIUS_MILES * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))
