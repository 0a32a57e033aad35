"""The test tables seen through the engine's data model.

events are the readings: each event is one reading of a parameter at one of 25 cities. nation and region
are the cities those readings belong to; customers, suppliers and orders stand for the larger site
dimension, its change requests and the insight cache.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from airloom.functions.quality import canonical_unit, quality_flag
from airloom.functions.text import slug
from airloom.schemas import CITIES, INSIGHT_CACHE, VALID

AS_OF = "2024-01-31T00:00:00Z"
PARAMETERS = {"view": "pm25", "click": "pm10", "purchase": "no2", "error": "temperature", "signup": "humidity"}
DETECTION_LIMIT = 0.5


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table; its schema is taken from the file once and declared from then on."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by their key: a table file may hold fewer row groups than there are cores."""
    return rows.repartition(key)


def parameter_of(event_type: Column) -> Column:
    chosen = event_type
    for kind, parameter in PARAMETERS.items():
        chosen = F.when(event_type == kind, parameter).otherwise(chosen)
    return chosen


def as_staged(events: DataFrame) -> DataFrame:
    """Events as staged readings; below the detection limit a sensor reports nothing."""
    measured = F.when(F.col("value") >= DETECTION_LIMIT, F.col("value"))
    parameter = parameter_of(F.col("event_type"))
    return events.select(
        (F.col("user_id") % 25).cast("string").alias("city_id"), parameter.alias("parameter"),
        measured.alias("value"), canonical_unit(parameter).alias("unit"), measured.alias("raw_value"),
        canonical_unit(parameter).alias("raw_unit"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.lit("events").alias("source"), F.lit(None).cast("string").alias("quality_flag"),
        F.col("event_id").alias("ingest_seq"), F.col("event_id").cast("string").alias("id"),
    )


def _stored(staged: DataFrame) -> DataFrame:
    written = F.col("timestamp") + F.expr("INTERVAL 5 MINUTES")
    return staged.withColumns({
        "quality_flag": quality_flag(F.col("parameter"), F.col("value")),
        "created_at": written, "updated_at": written, "reading_date": F.to_date("timestamp"),
    })


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """One reading per event."""
    return _stored(as_staged(table(spark, folder, "events")))


def hourly_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly means of the valid readings, so that parameters share their timestamps."""
    hourly = (
        readings(spark, folder).where(F.col("quality_flag") == VALID)
        .groupBy("city_id", "parameter", F.date_trunc("hour", "timestamp").alias("timestamp"))
        .agg(F.avg("value").alias("value"))
    )
    return _stored(hourly)


def cities(spark: SparkSession, folder: str) -> DataFrame:
    region = table(spark, folder, "region")
    opened = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    return table(spark, folder, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"),
        F.col("r_name").alias("country"), F.upper(F.substring("r_name", 1, 2)).alias("country_code"),
        (F.col("n_nationkey") * 2.0).alias("latitude"), (F.col("n_nationkey") * 5.0).alias("longitude"),
        F.lit("UTC").alias("timezone"), (F.col("r_name") != "MIDDLE EAST").alias("is_active"),
        opened.alias("created_at"), opened.alias("updated_at"),
    )


def _placed(spark: SparkSession, folder: str, rows: DataFrame, nation_key: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    return rows.join(nation, F.col(nation_key) == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey"))


def sites(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as a large city dimension; those of one market segment are closed."""
    opened = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    return _placed(spark, folder, table(spark, folder, "customer"), "c_nationkey").select(
        slug(F.col("c_name")).alias("id"), F.col("c_name").alias("name"), F.col("r_name").alias("country"),
        F.upper(F.substring("r_name", 1, 2)).alias("country_code"), (F.col("c_acctbal") / 200.0).alias("latitude"),
        (F.col("c_nationkey") * 0.04).alias("longitude"), F.lit("UTC").alias("timezone"),
        (F.col("c_mktsegment") != "MACHINERY").alias("is_active"), opened.alias("created_at"),
        opened.alias("updated_at"),
    ).select(*CITIES.fieldNames())


def site_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every supplier applies twice under names with one slug, then every customer applies again in capitals."""
    suppliers = _placed(spark, folder, table(spark, folder, "supplier"), "s_nationkey")
    customers = _placed(spark, folder, table(spark, folder, "customer"), "c_nationkey")

    def applying(rows: DataFrame, seq: Column, name: Column, latitude: Column, nation_key: str) -> DataFrame:
        return rows.select(
            seq.alias("request_seq"), name.alias("name"), F.col("r_name").alias("country"),
            F.upper(F.substring("r_name", 1, 2)).alias("country_code"), latitude.alias("latitude"),
            (F.col(nation_key) * 0.04).alias("longitude"), F.lit("UTC").alias("timezone"))

    return (
        applying(suppliers, F.col("s_suppkey"), F.col("s_name"), F.col("s_acctbal") / 100.0, "s_nationkey")
        .unionByName(applying(suppliers, F.col("s_suppkey") + 1_000_000_000_000, F.lower("s_name"),
                              F.col("s_acctbal") / 200.0, "s_nationkey"))
        .unionByName(applying(customers, F.col("c_custkey") + 2_000_000_000_000, F.upper("c_name"),
                              F.col("c_acctbal") / 200.0, "c_nationkey"))
    )


def site_patches(spark: SparkSession, folder: str) -> DataFrame:
    """Every order asks for a change to its customer's site."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_name")
    neighbour = customer.select((F.col("c_custkey") - 1).alias("before"), F.col("c_name").alias("next_name"))
    orders = table(spark, folder, "orders")
    name = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("Renamed "), F.col("o_custkey").cast("string")))
        .when((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") == "F"), F.col("next_name"))
    )
    no_text = F.lit(None).cast("string")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(neighbour, F.col("o_custkey") == F.col("before"), "left")
        .select(
            F.col("o_orderkey").alias("request_seq"), slug(F.col("c_name")).alias("id"), name.alias("name"),
            no_text.alias("country"), no_text.alias("country_code"),
            F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") / 5000.0).alias("latitude"),
            F.lit(None).cast("double").alias("longitude"),
            F.when(F.col("o_orderstatus") == "F", "Europe/London").alias("timezone"))
    )


def site_deletions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").where("c_acctbal < 0").select(slug(F.col("c_name")).alias("id"))


def name_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every order names its customer's site: in capitals, as an id, or loosely."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_name")
    orders = table(spark, folder, "orders")
    asked = (
        F.when(F.col("o_orderstatus") == "F", F.upper("c_name"))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("  "), F.upper(slug(F.col("c_name")))))
        .when(F.col("o_orderpriority") == "1-URGENT", F.concat(slug(F.col("c_name")), F.lit(" !")))
        .otherwise(F.regexp_replace("c_name", "#", " "))
    )
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("request_seq"), asked.alias("requested_name"))


def insight_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Every order is a stored insight of its customer's city, valid for 30 days."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    made = F.col("o_orderdate").cast("timestamp")
    city = F.col("c_nationkey").cast("string")
    return table(spark, folder, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("id"), city.alias("city_id"), made.alias("generated_at"),
        (made + F.expr("INTERVAL 30 DAYS")).alias("expires_at"), F.col("o_orderpriority").alias("insight_text"),
        F.sha2(F.concat_ws("|", city, F.col("o_orderstatus")), 256).alias("context_hash"),
        F.concat(F.lit("writer-"), F.lower(F.substring("o_orderpriority", 1, 1))).alias("model_used"),
        F.floor(F.col("o_totalprice") / 100).cast("int").alias("input_tokens"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("output_tokens"),
        made.alias("created_at"), made.alias("updated_at"), F.to_date(made).alias("generated_date"),
    ).select(*INSIGHT_CACHE.fieldNames())


def _iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def location_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer is a city with two stations; the second repeats one pollutant and adds others."""
    key = F.col("c_custkey")

    def sensor(place: int, name: Column, units: Column) -> Column:
        return F.struct((key * 10 + place).alias("id"), F.struct(name.alias("name"), units.alias("units"))
                        .alias("parameter"))

    micro = F.lit("µg/m³")
    first = F.struct(F.col("c_name").alias("name"), F.array(
        sensor(1, F.lit("PM25"), micro), sensor(2, F.lit("cosmic_rays"), F.lit("n")),
        sensor(3, F.when(F.col("c_mktsegment") == "BUILDING", F.lit("no2")).otherwise(F.lit("pm10")), micro),
    ).alias("sensors"))
    second = F.struct(F.lit("second").alias("name"), F.array(
        sensor(4, F.lit("pm25"), micro), sensor(5, F.lit("no2"), F.lit(None).cast("string")),
        sensor(6, F.lit("O3"), F.lit("ppm")),
    ).alias("sensors"))
    return table(spark, folder, "customer").select(
        key.cast("string").alias("city_id"), F.lit("2024-01-31T00:00:00Z").alias("fetched_at"),
        F.lit(None).cast("string").alias("error"), F.array(first, second).alias("results"))


def measurement_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every event is a document of one measurement, taken by one of the sensors of its user's city.

    Clicks carry the start of their period instead of an instant; sign-ups an unreadable one.
    """
    place = F.create_map(*[F.lit(item) for pair in
                           {"view": 1, "click": 3, "purchase": 5, "error": 6, "signup": 4}.items() for item in pair])
    kind = F.col("event_type")
    stamp = _iso(F.col("ts"))
    utc = (F.when(kind == "view", F.concat(stamp, F.lit("Z"))).when(kind == "click", "")
           .when(kind == "signup", "not-a-date").otherwise(F.concat(stamp, F.lit("+00:00"))))
    begin = F.when(kind == "click", F.concat(F.lit("  "), stamp, F.lit(" ")))
    result = F.struct(
        F.when(F.col("value") >= DETECTION_LIMIT, F.col("value")).alias("value"),
        F.struct(utc.alias("utc")).alias("datetime"),
        F.struct(F.struct(begin.alias("utc")).alias("datetimeFrom")).alias("period"))
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("city_id"),
        (F.col("user_id") * 10 + F.element_at(place, kind)).alias("sensor_id"),
        F.concat(stamp, F.lit("Z")).alias("fetched_at"), F.lit(None).cast("string").alias("error"),
        F.array(result).alias("results"))


def weather_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every event is a forecast of three hours with a short, a gappy, a full and an empty value array."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    value = F.col("value")
    times = F.array(*[F.date_format(hour + F.expr(f"INTERVAL {i} HOURS"), "yyyy-MM-dd'T'HH:mm") for i in range(3)])
    hourly = F.struct(
        times.alias("time"), F.array(value, value / 2).alias("temperature_2m"),
        F.array(F.lit(None).cast("double"), value, value).alias("relative_humidity_2m"),
        F.array(value, value * 2, value * 3).alias("wind_speed_10m"),
        F.array().cast("array<double>").alias("precipitation"))
    units = F.struct(
        F.lit("°C").alias("temperature_2m"), F.lit("%").alias("relative_humidity_2m"),
        F.when(F.col("event_type") != "error", "km/h").otherwise("m/s").alias("wind_speed_10m"),
        F.lit("mm").alias("precipitation"))
    return spread(table(spark, folder, "events"), "event_id").select(
        (F.col("user_id") % 25).cast("string").alias("city_id"),
        F.concat(_iso(F.col("ts")), F.lit("Z")).alias("fetched_at"), F.lit(None).cast("string").alias("error"),
        hourly.alias("hourly"), units.alias("hourly_units"))
