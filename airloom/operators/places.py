"""Distance join: the nearest stations of every city within a radius."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def _band(latitude: Column, step: float) -> Column:
    return F.floor((latitude + 90.0) / step).cast("int")


def _cells_around(band: Column, step: float) -> Column:
    """How many cells circle the globe in a band, so that a cell is never wider than it is high."""
    low = band * step - 90.0
    nearest_equator = F.when((low <= 0) & (low + step >= 0), F.lit(0.0)).otherwise(
        F.least(F.abs(low), F.abs(low + step)))
    return F.greatest(F.lit(1), F.ceil(F.lit(360.0 / step) * F.cos(F.radians(nearest_equator)))).cast("int")


def _column(longitude: Column, around: Column) -> Column:
    return F.pmod(F.floor((longitude + 180.0) / 360.0 * around), around).cast("int")


def nearest_stations(cities: DataFrame, stations: DataFrame, *, radius_km: float = 25.0,
                     per_city: int = 5) -> DataFrame:
    """Up to ``per_city`` closest stations within ``radius_km`` of every city, with their position.

    ``cities``: city_id, latitude, longitude. ``stations``: station_id, latitude, longitude. Ties go to the
    smaller station id.

    No city meets all stations of its neighbourhood. Stations are counted per fine grid cell first; from
    the counts each city learns how far it has to look for ``per_city`` stations, and only cells that
    reach into that distance are joined. Stations at one and the same spot differ in nothing but their id,
    so ``per_city`` of them are all that can be needed.

    A city has hundreds of cells around it, which the planner, who goes by the size of the cities, does not see. They are
    dealt out by cell before the join, so that their real size is known when it is chosen: they are never broadcast unless
    they are small.
    """
    step = math.degrees(radius_km / EARTH_RADIUS_KM) / 8
    spot = W.partitionBy("latitude", "longitude").orderBy("station_id")
    placed = (
        stations.select("station_id", "latitude", "longitude")
        .withColumn("at_spot", F.row_number().over(spot))
        .where(F.col("at_spot") <= per_city)
        .drop("at_spot")
        .withColumn("band", _band(F.col("latitude"), step))
        .withColumn("cell", _column(F.col("longitude"), _cells_around(F.col("band"), step)))
    )
    counts = placed.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("stations_here"))

    reach = math.degrees(radius_km / EARTH_RADIUS_KM)
    lat, lon = F.col("city_latitude"), F.col("city_longitude")
    bands = F.sequence(_band(F.greatest(lat - reach, F.lit(-90.0)), step),
                       _band(F.least(lat + reach, F.lit(90.0)), step))
    around = _cells_around(F.col("band"), step)
    # Widest longitude difference on the circle of the radius; all the way round where it holds a pole.
    ratio = F.lit(math.sin(radius_km / EARTH_RADIUS_KM)) / F.cos(F.radians(lat))
    spread = F.when((F.abs(lat) + reach >= 90.0) | (ratio >= 1.0), F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))
    first = F.floor((lon - spread + 180.0) / 360.0 * around).cast("int")
    last = F.floor((lon + spread + 180.0) / 360.0 * around).cast("int")
    # The cells of a band are numbers in a row: what they are made of is worked out per city and band, then dealt out.
    rows = (
        cities.select("city_id", F.col("latitude").alias("city_latitude"),
                      F.col("longitude").alias("city_longitude"))
        .withColumn("band", F.explode(bands))
        .withColumns({"around": around, "first": first, "last": last,
                      "cell_latitude": F.greatest(F.least((F.col("band") + 0.5) * step - 90.0, F.lit(90.0)),
                                                  F.lit(-90.0))})
        .withColumn("last", F.least("last", F.col("first") + F.col("around") - 1))
        .repartition("city_id", "band")
    )
    cell = F.pmod(F.col("column"), F.col("around"))
    centre = haversine_km(lat, lon, F.col("cell_latitude"), (cell + 0.5) * 360.0 / F.col("around") - 180.0)
    # No point of a cell is further from its centre than this: half a height plus half an equator-wide cell.
    half_cell = radius_km / 8 * 1.05
    wanted = (
        rows.withColumn("column", F.explode(F.sequence("first", "last")))
        .select("city_id", "city_latitude", "city_longitude", "band", cell.alias("cell"), centre.alias("centre"))
        .where(F.col("centre") - half_cell <= radius_km)
        .repartition("band", "cell")
    )
    known = wanted.join(counts, ["band", "cell"]).withColumns({
        "at_least": F.greatest(F.col("centre") - half_cell, F.lit(0.0)), "at_most": F.col("centre") + half_cell})
    outward = W.partitionBy("city_id").orderBy("at_most").rangeBetween(W.unboundedPreceding, W.currentRow)
    whole_city = W.partitionBy("city_id")
    enough = F.when(F.col("seen") >= per_city, F.col("at_most"))
    needed = (
        known.withColumn("seen", F.sum("stations_here").over(outward))
        .withColumn("far_enough", F.min(enough).over(whole_city))
        .where(F.col("far_enough").isNull() | (F.col("at_least") <= F.col("far_enough")))
        .select("city_id", "city_latitude", "city_longitude", "band", "cell")
    )
    distance = haversine_km(lat, lon, F.col("latitude"), F.col("longitude"))
    by_distance = W.partitionBy("city_id").orderBy("distance_km", "station_id")
    return (
        needed.join(placed, ["band", "cell"])
        .withColumn("distance_km", distance)
        .where(F.col("distance_km") <= radius_km)
        .withColumn("position", F.row_number().over(by_distance))
        .where(F.col("position") <= per_city)
        .select("city_id", "station_id", "distance_km", F.col("position").cast("long").alias("position"))
    )
