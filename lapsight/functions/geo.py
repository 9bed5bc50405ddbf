"""Distances and a local frame on the sphere, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: mean radius of the earth, metres.
EARTH_RADIUS_M = 6_371_008.8


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), F.lit(2)
    )
    return 2 * radius * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))  # least() would turn null into 1


def with_local_xy(points: DataFrame, lat: str = "latitude_deg", lon: str = "longitude_deg") -> DataFrame:
    """``points`` with x_m and y_m, east and north of the median position (one broadcast row)."""
    origin = points.agg(F.median(lat).alias("__lat0"), F.median(lon).alias("__lon0"))
    k = EARTH_RADIUS_M
    return (
        points.join(F.broadcast(origin))
        .withColumn("x_m", k * F.radians(F.col(lon) - F.col("__lon0")) * F.cos(F.radians("__lat0")))
        .withColumn("y_m", k * F.radians(F.col(lat) - F.col("__lat0")))
        .drop("__lat0", "__lon0")
    )


def to_latlon(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    lat = lat0 + F.degrees(y / EARTH_RADIUS_M)
    return lat, lon0 + F.degrees(x / (EARTH_RADIUS_M * F.cos(F.radians(lat0))))


def semicircles_to_degrees(value: Column, latitude: bool) -> Column:
    """Values beyond the limit of degrees are semicircles of 2^31 to 180 degrees."""
    limit = 90.0 if latitude else 180.0
    return F.when(F.abs(value) <= limit, value).otherwise(value * (180.0 / 2**31))
