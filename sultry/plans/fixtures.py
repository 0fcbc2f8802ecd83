"""Projection of the driver tables onto the domain schemas, as DataFrames and as DuckDB CTEs.

Both sides use the same integer arithmetic, so inputs are equal. The grid has 24 x 36 cells whatever the size of the tables, so that times of its
queries say what a small grid costs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

INIT = "2024-01-01 00:00:00"
ROWS, COLS = 24, 36
#: Cities whose hours one task makes.
CITIES_A_TASK = 5000


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that a query writes and reads back."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; times without a zone are UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def grid_forecast(spark: SparkSession, sf_dir: str, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """Long grid: init, step, valid_time, cell_row, cell_col, lat, lon, temperature_k, dew_point_k, pressure_pa."""
    li = table(spark, sf_dir, "lineitem")
    cell = [(F.col("l_partkey") % rows).cast("int").alias("cell_row"), (F.col("l_orderkey") * 7 % cols).cast("int").alias("cell_col"), (3 * (F.col("l_linenumber") - 1)).cast("int").alias("step")]
    top = F.max(290.15 + F.col("l_quantity") * 0.4)
    grid = li.groupBy(*cell).agg(
        top.alias("temperature_k"), (top - (F.min("l_discount") * 100 + F.max("l_orderkey") % 6)).alias("dew_point_k"), (95000.0 + 100 * (F.max("l_partkey") % 80)).alias("pressure_pa")
    )
    init = F.lit(INIT).cast("timestamp")
    return grid.select(
        init.alias("init"), "step", F.timestamp_add("HOUR", F.col("step"), init).alias("valid_time"), "cell_row", "cell_col",
        (57.5 - F.col("cell_row") * (120.0 / rows)).alias("lat"), (F.col("cell_col") * (360.0 / cols)).alias("lon"), "temperature_k", "dew_point_k", "pressure_pa",
    )


def land_mask(spark: SparkSession, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    cells = spark.range(rows * cols)
    return cells.select((F.col("id") / cols).cast("int").alias("cell_row"), (F.col("id") % cols).cast("int").alias("cell_col"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(1.0).alias("fraction"))


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """city_id, name, country, state, latitude, longitude, population; names repeat."""
    key = F.col("c_custkey")
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        key.alias("city_id"), F.concat(F.lit("City "), (key % 10).cast("string")).alias("name"), F.col("n_name").alias("country"), F.col("c_mktsegment").alias("state"),
        ((key * 7919 % 12000) / 100.0 - 60).alias("latitude"), ((key * 104729 % 36000) / 100.0 - 180).alias("longitude"), (key * 31 % 400 * 500).alias("population"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    return e.select(
        (F.col("user_id") % 10).alias("station_id"), F.col("ts").alias("obs_time"), (10.0 + F.col("value") % 25).alias("temperature_c"), (10.0 + F.col("value") % 25 - F.col("event_id") % 9).alias("dew_point_c"),
        ((950 + F.col("event_id") % 60) * 100.0).alias("pressure_pa"), F.when(k == 0, "").when(k == 1, "1").when(k == 2, "5").otherwise("3").alias("quality_code"),
    )


def ga_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.when(i % 10 == 0, "staging.example").when(i % 7 == 0, F.lit(None)).otherwise("www.example.org").alias("host_name"),
        F.when(i % 11 == 0, "(not set)").otherwise(F.concat(F.lit("/wetbulb-temperature/c"), (F.col("user_id") % 4).cast("string"), F.lit("/s/"), F.col("event_type"), F.lit("/?q="), i.cast("string"))).alias("landing_page"),
        F.col("event_type").alias("channel"), F.to_date("ts").alias("day"), (1 + i % 6).alias("sessions"), (1 + i % 2).alias("users"), (i % 3).alias("engaged"),
    )


def city_hours(spark: SparkSession, sf_dir: str, hours: int = 168, of: DataFrame | None = None) -> DataFrame:
    """Hourly forecasts: city_id, hour, valid_time, offset_s, temperature_c, dew_point_c, pressure_pa; with `of` (city_id) those of its cities only.

    Cities are dealt to tasks of CITIES_A_TASK before they become many hours, as a file of cities is small and would be one task. A city's hours
    are made by one task, so that what is summed up by city shrinks there."""
    key = F.col("c_custkey")
    cities = table(spark, sf_dir, "customer").select("c_custkey")
    if of is not None:
        cities = cities.join(of.select(F.col("city_id").alias("c_custkey")), "c_custkey", "left_semi")
    tasks = max(spark.sparkContext.defaultParallelism, -(-(cities if of is None else of).count() // CITIES_A_TASK))
    base = cities.repartition(tasks, "c_custkey").select(key.alias("city_id"), ((key % 25 - 12) * 3600).cast("int").alias("offset_s"), F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("hour"))
    t = 15 + ((F.col("city_id") * 17 + F.col("hour") * 11) % 300) / 10.0
    return base.select("city_id", "hour", F.timestamp_add("HOUR", F.col("hour"), F.lit(INIT).cast("timestamp")).alias("valid_time"), "offset_s", t.alias("temperature_c"), (t - F.col("hour") % 10).alias("dew_point_c"), (95000.0 + F.col("city_id") % 60 * 100).alias("pressure_pa"))


def forecast_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' hours for ten stations over the days that observations cover: model, station_id, valid_time, hour and fields."""
    span = observations(spark, sf_dir).agg(F.date_trunc("DAY", F.min("obs_time")).alias("a"), F.date_trunc("DAY", F.max("obs_time")).alias("b"))
    spine = span.select(F.explode(F.expr("sequence(a, b + interval 23 hours, interval 1 hour)")).alias("valid_time"), "a")
    spine = spine.select("valid_time", ((F.unix_timestamp("valid_time") - F.unix_timestamp("a")) / 3600).cast("long").alias("hour"))
    each = spine.select("valid_time", "hour", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("station_id")).select("*", F.explode(F.array(F.lit("ifs"), F.lit("gfs"))).alias("model"))
    t = 10 + ((F.col("station_id") * 37 + F.col("hour") * 13) % 250) / 10.0 + F.when(F.col("model") == "gfs", (F.col("hour") % 5) / 10.0).otherwise(0.0)
    return each.select("model", "station_id", "valid_time", "hour", t.alias("temperature_c"), (t - F.col("hour") % 8).alias("dew_point_c"), ((950 + F.col("hour") % 60) * 100.0).alias("pressure_pa"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("station_id"), (57.5 - 5 * (k % 24) + 0.3).alias("latitude"), (F.pmod(10 * (k * 5 % 36) + 0.2 + 180, F.lit(360.0)) - 180).alias("longitude"), F.when(k % 3 != 0, F.concat(F.lit("W"), k.cast("string"))).alias("wmo_id"),
    )


def raster(spark: SparkSession) -> DataFrame:
    cells = spark.range(ROWS * COLS).select((F.col("id") / COLS).cast("int").alias("cell_row"), (F.col("id") % COLS).cast("int").alias("cell_col"))
    return cells.select("*", ((F.col("cell_row") * 7 + F.col("cell_col") * 3) % 31).alias("cls"))


def gsc_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(F.to_date("o_orderdate").alias("snapshot_at"), F.concat(F.lit("/c/"), F.col("o_custkey").cast("string"), F.lit("/")).alias("url"), k.alias("id"), (k % 50).alias("clicks"), (k % 900).alias("impressions"))


GRID = f"""grid AS (SELECT *, 57.5 - 5.0*cell_row AS lat, 10.0*cell_col AS lon, TIMESTAMP '{INIT}' + to_hours(step) AS valid_time FROM (
 SELECT CAST(l_partkey % 24 AS INT) AS cell_row, CAST((l_orderkey * 7) % 36 AS INT) AS cell_col, CAST(3 * (l_linenumber - 1) AS INT) AS step,
  MAX(290.15 + l_quantity * 0.4) AS temperature_k, MAX(290.15 + l_quantity * 0.4) - (MIN(l_discount) * 100 + MAX(l_orderkey) % 6) AS dew_point_k,
  95000.0::DOUBLE + 100 * (MAX(l_partkey) % 80) AS pressure_pa FROM lineitem GROUP BY 1, 2, 3))"""
LAND = "land AS (SELECT CAST(i // 36 AS INT) AS cell_row, CAST(i % 36 AS INT) AS cell_col, CASE WHEN i % 3 = 0 THEN 0.0 ELSE 1.0 END AS fraction FROM range(864) t(i))"
CITIES = """cities AS (SELECT c_custkey AS city_id, concat('City ', CAST(c_custkey % 10 AS VARCHAR)) AS name, n_name AS country, c_mktsegment AS state,
 CAST(c_custkey * 7919 % 12000 AS DOUBLE) / 100.0 - 60 AS latitude, CAST(c_custkey * 104729 % 36000 AS DOUBLE) / 100.0 - 180 AS longitude, (c_custkey * 31 % 400) * 500 AS population
 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
OBS = """obs AS (SELECT user_id % 10 AS station_id, ts AS obs_time, 10.0 + (value % 25) AS temperature_c, 10.0 + (value % 25) - event_id % 9 AS dew_point_c,
 CAST((950 + event_id % 60) * 100 AS DOUBLE) AS pressure_pa, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '5' ELSE '3' END AS quality_code FROM events)"""
GA = """ga AS (SELECT CASE WHEN event_id % 10 = 0 THEN 'staging.example' WHEN event_id % 7 = 0 THEN NULL ELSE 'www.example.org' END AS host_name,
 CASE WHEN event_id % 11 = 0 THEN '(not set)' ELSE concat('/wetbulb-temperature/c', CAST(user_id % 4 AS VARCHAR), '/s/', event_type, '/?q=', CAST(event_id AS VARCHAR)) END AS landing_page,
 event_type AS channel, CAST(ts AS DATE) AS day, 1 + event_id % 6 AS sessions, 1 + event_id % 2 AS users, event_id % 3 AS engaged FROM events)"""
CITY_HOURS = f"""city_hours AS (SELECT city_id, hour, TIMESTAMP '{INIT}' + to_hours(CAST(hour AS INT)) AS valid_time, offset_s, t AS temperature_c, t - hour % 10 AS dew_point_c, 95000.0::DOUBLE + city_id % 60 * 100 AS pressure_pa
 FROM (SELECT c_custkey AS city_id, CAST((c_custkey % 25 - 12) * 3600 AS INT) AS offset_s, hour, 15 + CAST((c_custkey * 17 + hour * 11) % 300 AS DOUBLE) / 10.0 AS t FROM customer, range(168) h(hour)))"""
FORECAST = """span AS (SELECT date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) AS b FROM events),
spine AS (SELECT a + to_hours(CAST(h AS INT)) AS valid_time, h AS hour FROM span, range(100000) r(h) WHERE a + to_hours(CAST(h AS INT)) <= b + INTERVAL 23 HOUR),
fc AS (SELECT model, station_id, valid_time, hour, t AS temperature_c, t - hour % 8 AS dew_point_c, CAST((950 + hour % 60) * 100 AS DOUBLE) AS pressure_pa FROM
 (SELECT *, 10 + CAST((station_id * 37 + hour * 13) % 250 AS DOUBLE) / 10.0 + CASE WHEN model = 'gfs' THEN CAST(hour % 5 AS DOUBLE) / 10.0 ELSE 0.0 END AS t
  FROM spine, range(10) s(station_id), (VALUES ('ifs'), ('gfs')) m(model)))"""
STATIONS = """stations AS (SELECT s_suppkey AS station_id, 57.5::DOUBLE - 5 * (s_suppkey % 24) + 0.3 AS latitude,
 (10 * (s_suppkey * 5 % 36) + 0.2::DOUBLE + 180) - 360.0 * floor((10 * (s_suppkey * 5 % 36) + 0.2::DOUBLE + 180) / 360.0) - 180 AS longitude,
 CASE WHEN s_suppkey % 3 <> 0 THEN concat('W', CAST(s_suppkey AS VARCHAR)) END AS wmo_id FROM supplier)"""
RASTER = "raster AS (SELECT CAST(i // 36 AS INT) AS cell_row, CAST(i % 36 AS INT) AS cell_col, CAST(((i // 36) * 7 + (i % 36) * 3) % 31 AS INT) AS cls FROM range(864) t(i))"
GSC = "gsc AS (SELECT CAST(o_orderdate AS DATE) AS snapshot_at, concat('/c/', CAST(o_custkey AS VARCHAR), '/') AS url, o_orderkey AS id, o_orderkey % 50 AS clicks, o_orderkey % 900 AS impressions FROM orders)"
