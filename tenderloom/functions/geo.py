"""Distances between provinces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom import fixed


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    return F.lit(2 * fixed.EARTH_RADIUS_KM) * F.asin(F.sqrt(h))


def province_distances(dimension: DataFrame) -> DataFrame:
    """All province pairs, one row-local explode over the 24-name dimension."""
    everyone = dimension.agg(F.collect_list(F.struct("province", "lat", "lon"))).scalar()
    return (
        dimension.withColumn("_all", everyone)
        .select(
            F.col("province").alias("from_province"),
            "lat",
            "lon",
            F.explode_outer("_all").alias("to"),
        )
        .select(
            "from_province",
            F.col("to.province").alias("to_province"),
            haversine_km(F.col("lat"), F.col("lon"), F.col("to.lat"), F.col("to.lon")).alias("km"),
        )
    )
