"""Queries on verification, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..operators import grid as g
from ..operators import verify as v
from ..sources import files
from . import fixtures as fx
from .columns import haversine_sql
from .define import Registry
from .weather import GRID_WET, HOURLY, PEAK, esat_sql, peaks, wet_sql

R = Registry()
O = f"WITH {fx.OBS} "  # noqa: E741
FIELDS = ["temperature_c", "dew_point_c"]
CLEAN = """clean AS (SELECT station_id, obs_time, CASE WHEN ok AND temperature_c BETWEEN -100 AND 70 THEN temperature_c END AS temperature_c, CASE WHEN ok AND dew_point_c BETWEEN -110 AND 70 THEN dew_point_c END AS dew_point_c,
 CASE WHEN ok AND pressure_pa BETWEEN 45000 AND 110000 THEN pressure_pa END AS pressure_pa, quality_code FROM (SELECT *, trim(coalesce(quality_code, '')) IN ('', '1', '5') AS ok FROM obs))"""
MATCH = f"""{fx.FORECAST}, {fx.OBS}, {CLEAN}, hrs AS (SELECT DISTINCT station_id, valid_time FROM fc),
hit AS (SELECT * FROM (SELECT h.valid_time, c.*, abs(epoch_us(c.obs_time) - epoch_us(h.valid_time)) / 1000000.0 AS gap_s, row_number() OVER (PARTITION BY h.station_id, h.valid_time ORDER BY abs(epoch_us(c.obs_time) - epoch_us(h.valid_time)), c.obs_time) AS rn
 FROM hrs h JOIN clean c ON c.station_id = h.station_id AND c.obs_time BETWEEN h.valid_time - INTERVAL 30 MINUTE AND h.valid_time + INTERVAL 30 MINUTE) WHERE rn = 1),
pairs AS (SELECT fc.model, fc.station_id, fc.valid_time, CASE WHEN fc.hour % 24 <= 6 THEN '0-6' WHEN fc.hour % 24 <= 12 THEN '7-12' WHEN fc.hour % 24 <= 18 THEN '13-18' ELSE '19+' END AS lead_bin,
 fc.temperature_c AS f_temperature_c, fc.dew_point_c AS f_dew_point_c, hit.temperature_c AS o_temperature_c, hit.dew_point_c AS o_dew_point_c FROM fc JOIN hit USING (station_id, valid_time)),
errs AS (SELECT * FROM (SELECT model, station_id, valid_time, lead_bin, 'temperature_c' AS field, f_temperature_c - o_temperature_c AS error FROM pairs UNION ALL SELECT model, station_id, valid_time, lead_bin, 'dew_point_c', f_dew_point_c - o_dew_point_c FROM pairs) WHERE error IS NOT NULL)"""
M = f"WITH {MATCH} "


def _clean(spark, d):
    return v.clean_observations(fx.observations(spark, d))


def matched(spark, d):
    return v.match_nearest(fx.forecast_hours(spark, d), _clean(spark, d))


def pairs(spark, d):
    f = fx.forecast_hours(spark, d).select("model", "station_id", "valid_time", times.lead_hour_bin(F.col("hour") % 24).alias("lead_bin"), *[F.col(c).alias(f"f_{c}") for c in FIELDS])
    return f.join(matched(spark, d).select("station_id", "valid_time", *[F.col(c).alias(f"o_{c}") for c in FIELDS]), ["station_id", "valid_time"])


def errors(spark, d):
    return v.error_rows(pairs(spark, d), FIELDS)


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 4) for c in cols})


@R.add("quality_accept", O + "SELECT quality_code, trim(coalesce(quality_code, '')) IN ('', '1', '5') AS accepted, count(*) AS n FROM obs GROUP BY 1, 2")
def quality_accept(spark, d):
    return fx.observations(spark, d).groupBy("quality_code", v.quality_accept(F.col("quality_code")).alias("accepted")).agg(F.count("*").alias("n"))


REPORT = "CASE WHEN {c} IN ('', '1', '5') AND {v} BETWEEN {a} AND {b} THEN round({v}, 4) END"
_SEEN = O.rstrip() + ", r AS (SELECT event_id, user_id % 10 AS s, ts, 10.0 + (value % 25) AS t, 10.0 + (value % 25) - event_id % 9 AS td, CAST((950 + event_id % 60) * 100 AS DOUBLE) AS p, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '5' ELSE '3' END AS q, CASE WHEN event_id % 7 = 0 THEN '2' ELSE '1' END AS qd FROM events) "


@R.add("src_observations", _SEEN + f"SELECT concat('S-', CAST(s AS VARCHAR)) AS station_id, date_trunc('second', ts) AS obs_time, {REPORT.format(c='q', v='t', a=-100, b=70)} AS temperature_c, {REPORT.format(c='qd', v='td', a=-110, b=70)} AS dew_point_c, CASE WHEN event_id % 11 <> 0 THEN p END AS pressure_pa FROM r")
def src_observations(spark, d):
    """Reports written as pipe-separated text, each field with its own code and some pressures unreadable, and read back."""
    k, value = F.col("event_id"), F.col("value")
    code = F.when(k % 4 == 0, "").when(k % 4 == 1, "1").when(k % 4 == 2, "5").otherwise("3")
    rows = fx.table(spark, d, "events").select(
        F.concat(F.lit("S-"), (F.col("user_id") % 10).cast("string")).alias("STATION"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("DATE"), (10.0 + value % 25).alias("temperature"), code.alias("temperature_Quality_Code"),
        (10.0 + value % 25 - k % 9).alias("dew_point_temperature"), F.when(k % 7 == 0, "2").otherwise("1").alias("dew_point_temperature_Quality_Code"),
        F.when(k % 11 == 0, "bad").otherwise((950 + k % 60).cast("string")).alias("station_level_pressure"), F.lit("1").alias("station_level_pressure_Quality_Code"),
    )
    path = fx.folder(spark, "reports")
    rows.write.csv(path, header=True, sep="|", quote="", emptyValue="")
    return _r(files.observations(spark, path), "temperature_c", "dew_point_c")


_td = "least(dew_point_c, temperature_c) + 273.15::DOUBLE"


@R.add("observed_wet_bulb", f"""WITH RECURSIVE {fx.OBS}, {CLEAN}, c AS (SELECT *, row_number() OVER () AS id FROM clean WHERE temperature_c IS NOT NULL AND dew_point_c IS NOT NULL AND pressure_pa IS NOT NULL),
{wet_sql(f"SELECT id, pressure_pa AS p, temperature_c + 273.15::DOUBLE AS t, {_td} AS lo, {esat_sql(_td)} AS e FROM c")}
SELECT station_id, obs_time, round(wet_bulb_k - 273.15, 6) AS wet_bulb_c FROM c JOIN wet USING (id)""")
def observed_wet_bulb(spark, d):
    return v.observed_wet_bulb(_clean(spark, d)).where("wet_bulb_c is not null").select("station_id", "obs_time", "wet_bulb_c")


@R.add("join_obs_asof", M + "SELECT station_id, valid_time, obs_time, round(gap_s, 3) AS gap_s FROM hit")
def join_obs_asof(spark, d):
    return matched(spark, d).select("station_id", "valid_time", "obs_time", F.round("gap_s", 3).alias("gap_s"))


def one_sql(hours: str, reports: str) -> str:
    """CTE one: each report of `reports` serves one hour of `hours`, hours in time order; only the report that the hour before took can be gone."""
    return f"""rep AS (SELECT *, row_number() OVER (PARTITION BY station_id, obs_time ORDER BY temperature_c NULLS FIRST, dew_point_c NULLS FIRST, pressure_pa NULLS FIRST, quality_code NULLS FIRST) AS nth FROM {reports}),
cand AS (SELECT h.valid_time, rep.*, abs(epoch_us(rep.obs_time) - epoch_us(h.valid_time)) AS gap, dense_rank() OVER (PARTITION BY h.station_id ORDER BY h.valid_time) AS k,
 row_number() OVER (PARTITION BY h.station_id, h.valid_time ORDER BY abs(epoch_us(rep.obs_time) - epoch_us(h.valid_time)), rep.obs_time, rep.nth) AS place
 FROM (SELECT DISTINCT station_id, valid_time FROM {hours}) h JOIN rep ON rep.station_id = h.station_id AND rep.obs_time BETWEEN h.valid_time - INTERVAL 30 MINUTE AND h.valid_time + INTERVAL 30 MINUTE),
two AS (SELECT station_id, k, max(valid_time) AS valid_time, max(concat(obs_time, '#', nth)) FILTER (place = 1) AS a, max(concat(obs_time, '#', nth)) FILTER (place = 2) AS b FROM cand WHERE place <= 2 GROUP BY 1, 2),
pick AS (SELECT station_id, k, valid_time, a AS took FROM two WHERE k = 1 UNION ALL SELECT two.station_id, two.k, two.valid_time, CASE WHEN two.a IS NOT DISTINCT FROM pick.took THEN two.b ELSE two.a END FROM pick JOIN two ON two.station_id = pick.station_id AND two.k = pick.k + 1),
one AS (SELECT cand.* FROM pick JOIN cand ON cand.station_id = pick.station_id AND cand.k = pick.k AND concat(cand.obs_time, '#', cand.nth) = pick.took)"""


@R.add("join_obs_one_to_one", f"WITH RECURSIVE {MATCH}, {one_sql('fc', 'clean')} SELECT station_id, valid_time, obs_time, round(gap / 1000000.0, 3) AS gap_s, round(temperature_c, 4) AS temperature_c FROM one")
def join_obs_one_to_one(spark, d):
    one = v.match_one_to_one(fx.forecast_hours(spark, d), _clean(spark, d))
    return one.select("station_id", "valid_time", "obs_time", F.round("gap_s", 3).alias("gap_s"), F.round("temperature_c", 4).alias("temperature_c"))


@R.add("agg_error_metrics", M + "SELECT model, field, count(*) AS n, round(avg(error), 4) AS bias, round(avg(abs(error)), 4) AS mae, round(sqrt(avg(error * error)), 4) AS rmse FROM errs GROUP BY 1, 2")
def agg_error_metrics(spark, d):
    return _r(v.error_metrics(errors(spark, d), "model", "field"), "bias", "mae", "rmse")


_FIGURES = "count(*) AS n, round(avg(error), 4) AS bias, round(avg(abs(error)), 4) AS mae, round(sqrt(avg(error * error)), 4) AS rmse"
CARD = f"""SELECT model, field, station_id, lead_bin, CAST(NULL AS VARCHAR) AS "group", {_FIGURES} FROM errs GROUP BY GROUPING SETS ((model, field), (model, field, station_id), (model, field, lead_bin))
UNION ALL SELECT model, field, NULL, NULL, kind, {_FIGURES} FROM errs JOIN kinds_of USING (station_id) GROUP BY model, field, kind"""
KINDS = "kinds_of AS (SELECT s AS station_id, 'fixed' AS kind FROM range(10) t(s) WHERE s % 2 = 0 UNION ALL SELECT s, 'dynamic' FROM range(10) t(s) WHERE s % 2 = 1 OR s % 5 = 0)"


def groups(spark):
    """The panel's fixed stations and those that hot cells have brought; some are both."""
    s = spark.range(10).select(F.col("id").alias("station_id"))
    return s.where("station_id % 2 = 0").withColumn("group", F.lit("fixed")).unionByName(s.where("station_id % 2 = 1 or station_id % 5 = 0").withColumn("group", F.lit("dynamic")))


@R.add("agg_scorecard", M.rstrip() + f", {KINDS} {CARD}")
def agg_scorecard(spark, d):
    return _r(v.scorecard(errors(spark, d), groups(spark)), "bias", "mae", "rmse")


PANEL = f"""{HOURLY}, panel AS (SELECT s_suppkey AS station_id, CAST(s_suppkey % 24 AS INT) AS cell_row, CAST(s_suppkey * 5 % 36 AS INT) AS cell_col FROM supplier WHERE s_suppkey < 10),
fc AS (SELECT model, station_id, valid_time, hour, temperature_k - 273.15 + CASE WHEN model = 'gfs' THEN CAST(hour % 5 AS DOUBLE) / 10.0 ELSE 0.0 END AS temperature_c, dew_point_k - 273.15 AS dew_point_c FROM panel JOIN hourly USING (cell_row, cell_col), (VALUES ('ifs'), ('gfs')) m(model)),
{fx.OBS}, {CLEAN}, {one_sql('fc', 'clean')},
pairs AS (SELECT fc.model, fc.station_id, fc.valid_time, CASE WHEN fc.hour % 24 <= 6 THEN '0-6' WHEN fc.hour % 24 <= 12 THEN '7-12' WHEN fc.hour % 24 <= 18 THEN '13-18' ELSE '19+' END AS lead_bin,
 fc.temperature_c AS f_temperature_c, fc.dew_point_c AS f_dew_point_c, one.temperature_c AS o_temperature_c, one.dew_point_c AS o_dew_point_c FROM fc JOIN one USING (station_id, valid_time)),
errs AS (SELECT * FROM (SELECT model, station_id, valid_time, lead_bin, 'temperature_c' AS field, f_temperature_c - o_temperature_c AS error FROM pairs UNION ALL SELECT model, station_id, valid_time, lead_bin, 'dew_point_c', f_dew_point_c - o_dew_point_c FROM pairs) WHERE error IS NOT NULL)"""


def panel_hours(spark, d):
    """Two models' hours at the panel's stations, from the nearest cells of their grids."""
    from .weather import _axes

    panel = g.nearest_cell(fx.stations(spark, d).where("station_id < 10"), *_axes(spark), key="station_id").select("station_id", "cell_row", "cell_col")
    hours = panel.join(g.interpolate_hourly(fx.grid_forecast(spark, d)), ["cell_row", "cell_col"]).withColumn("model", F.explode(F.array(F.lit("ifs"), F.lit("gfs"))))
    warmer = F.when(F.col("model") == "gfs", (F.col("hour") % 5) / 10.0).otherwise(0.0)
    return hours.select("model", "station_id", "valid_time", "hour", (F.col("temperature_k") - 273.15 + warmer).alias("temperature_c"), (F.col("dew_point_k") - 273.15).alias("dew_point_c"))


@R.add("pipe_verification", f"WITH RECURSIVE {PANEL}, {KINDS} {CARD}")
def pipe_verification(spark, d):
    """Panel stations take two models' hours from their nearest cells, each report serves one hour, and the errors are scored."""
    hours = panel_hours(spark, d)
    one = v.match_one_to_one(hours, _clean(spark, d)).select("station_id", "valid_time", *[F.col(c).alias(f"o_{c}") for c in FIELDS])
    f = hours.select("model", "station_id", "valid_time", times.lead_hour_bin(F.col("hour") % 24).alias("lead_bin"), *[F.col(c).alias(f"f_{c}") for c in FIELDS])
    return _r(v.scorecard(v.error_rows(f.join(one, ["station_id", "valid_time"]), FIELDS), groups(spark)), "bias", "mae", "rmse")


@R.add("agg_threshold_events", M + "SELECT model, threshold, count(*) FILTER (o_temperature_c >= threshold) AS events, count(*) FILTER (o_temperature_c >= threshold AND f_temperature_c < threshold) AS misses, count(*) FILTER (o_temperature_c < threshold AND f_temperature_c >= threshold) AS false_alarms FROM pairs, (VALUES (27.0), (30.0), (35.0)) t(threshold) WHERE o_temperature_c IS NOT NULL GROUP BY 1, 2")
def agg_threshold_events(spark, d):
    return v.threshold_events(pairs(spark, d), "temperature_c")


@R.add("agg_pairwise_models", M + """SELECT field, count(*) AS n, round(avg(abs(a)) - avg(abs(b)), 4) AS mae_difference, count(*) FILTER (round(abs(a), 6) < round(abs(b), 6)) AS wins_a, count(*) FILTER (round(abs(a), 6) > round(abs(b), 6)) AS wins_b, count(*) FILTER (round(abs(a), 6) = round(abs(b), 6)) AS ties
FROM (SELECT x.field, x.error AS a, y.error AS b FROM errs x JOIN errs y ON x.model = 'ifs' AND y.model = 'gfs' AND x.station_id = y.station_id AND x.valid_time = y.valid_time AND x.field = y.field) GROUP BY field""")
def agg_pairwise_models(spark, d):
    rows = errors(spark, d).withColumn("error", F.round("error", 6))
    return _r(v.pairwise_models(rows), "mae_difference")


@R.add("agg_observed_peak", O.rstrip() + f", {CLEAN} SELECT station_id, obs_time, round(temperature_c, 4) AS temperature_c FROM clean WHERE temperature_c IS NOT NULL ORDER BY temperature_c DESC, station_id, obs_time LIMIT 1")
def agg_observed_peak(spark, d):
    # The SQL's order is of the rounded temperature: of equal ones the first station and time.
    rows = _r(_clean(spark, d).where("temperature_c is not null"), "temperature_c")
    order = F.struct(F.col("temperature_c"), -F.col("station_id"), -F.unix_micros("obs_time"))
    return rows.agg(F.max_by(F.struct("station_id", "obs_time", "temperature_c"), order).alias("p")).select("p.*")


@R.add("agg_availability", M + "SELECT (SELECT count(DISTINCT station_id) FROM fc) AS stations, (SELECT count(DISTINCT station_id) FROM clean) AS with_data, (SELECT count(*) FROM fc) AS possible, count(*) AS matched, count(*) FILTER (o_temperature_c IS NOT NULL) AS scored FROM pairs")
def agg_availability(spark, d):
    f = fx.forecast_hours(spark, d).agg(F.countDistinct("station_id").alias("stations"), F.count("*").alias("possible"))
    o = _clean(spark, d).agg(F.countDistinct("station_id").alias("with_data"))
    p = pairs(spark, d).agg(F.count("*").alias("matched"), F.count_if(F.col("o_temperature_c").isNotNull()).alias("scored"))
    return f.join(F.broadcast(o)).join(F.broadcast(p)).select("stations", "with_data", "possible", "matched", "scored")


@R.add("join_two_models", f"WITH {fx.FORECAST}, a AS (SELECT * FROM fc WHERE model = 'ifs' AND hour % 11 <> 0), b AS (SELECT * FROM fc WHERE model = 'gfs' AND hour % 13 <> 0) SELECT station_id, count(*) FILTER (a.valid_time IS NOT NULL AND b.valid_time IS NOT NULL) AS both, count(*) FILTER (b.valid_time IS NULL) AS only_ifs, count(*) FILTER (a.valid_time IS NULL) AS only_gfs FROM a FULL JOIN b USING (station_id, valid_time) GROUP BY station_id")
def join_two_models(spark, d):
    """Valid times that two models share; both sides lack some hours here."""
    f = fx.forecast_hours(spark, d)
    a = f.where("model = 'ifs' and hour % 11 <> 0").select("station_id", "valid_time", F.lit(1).alias("a"))
    b = f.where("model = 'gfs' and hour % 13 <> 0").select("station_id", "valid_time", F.lit(1).alias("b"))
    both = a.join(b, ["station_id", "valid_time"], "full_outer")
    return both.groupBy("station_id").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_ifs"), F.count_if(F.col("a").isNull()).alias("only_gfs"))


@R.add("src_station_catalog", f"WITH {fx.STATIONS} SELECT concat('S-', lpad(CAST(station_id AS VARCHAR), 6, '0')) AS station_id, round(latitude, 4) AS latitude, round(longitude, 4) AS longitude, wmo_id FROM stations WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND station_id % 10 <> 3 AND station_id % 10 <> 7")
def src_station_catalog(spark, d):
    """The catalogue written as CSV, some rows with an improper id or an unreadable latitude, and read back."""
    k = F.col("station_id")
    ident = F.when(k % 10 == 3, "no").otherwise(F.concat(F.lit("S-"), F.lpad(k.cast("string"), 6, "0")))
    rows = fx.stations(spark, d).select(ident.alias("GHCN_ID"), F.when(k % 10 == 7, "north").otherwise(F.round("latitude", 4).cast("string")).alias("LATITUDE"), F.round("longitude", 4).alias("LONGITUDE"), F.lit("12.5").alias("ELEVATION"), F.lit("A name").alias("NAME"), F.col("wmo_id").alias("WMO_ID"), F.lit(None).cast("string").alias("ICAO"))
    path = fx.folder(spark, "stations")
    rows.write.csv(path, header=True)
    return _r(files.station_catalog(spark, path).select("station_id", "latitude", "longitude", "wmo_id"), "latitude", "longitude")


STATION = f"""WITH RECURSIVE {GRID_WET}, {PEAK}, {fx.STATIONS}, top AS (SELECT lat, lon, 'ifs' AS model, CAST(row_number() OVER (ORDER BY round(wet_bulb_k, 6) DESC, lat, lon) AS INT) AS rank FROM peak UNION ALL SELECT lat, lon, 'gfs', CAST(row_number() OVER (ORDER BY round(temperature_k, 6) DESC, lat, lon) AS INT) FROM peak),
near AS (SELECT * FROM (SELECT top.*, station_id, {haversine_sql('lat', 'lon', 'latitude', 'longitude')} AS km, row_number() OVER (PARTITION BY model, rank ORDER BY {haversine_sql('lat', 'lon', 'latitude', 'longitude')}, station_id) AS rn FROM top, stations WHERE wmo_id IS NOT NULL AND {haversine_sql('lat', 'lon', 'latitude', 'longitude')} <= 100) WHERE rn = 1),
fresh AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY rank, model) = 1 AS is_new FROM near),
kept AS (SELECT *, coalesce(sum(CAST(is_new AS INT)) OVER (ORDER BY rank, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fresh)
SELECT rank, model, station_id, round(km, 3) AS km, is_new FROM kept WHERE before < 5"""


@R.add("join_station_nearest", STATION)
def join_station_nearest(spark, d):
    """Two models' cells in order of rank and model; the second model ranks by temperature here."""
    p = peaks(spark, d)
    top = g.ranked_cells(p).select("rank", "lat", "lon", F.lit("ifs").alias("model"))
    top = top.unionByName(g.ranked_cells(p.withColumn("temperature_k", F.round("temperature_k", 6)), "temperature_k").select("rank", "lat", "lon", F.lit("gfs").alias("model")))
    return v.new_stations(v.nearest_station(top, fx.stations(spark, d)), 5).select("rank", "model", "station_id", F.round("km", 3).alias("km"), "is_new")


@R.add("join_station_sample", f"WITH {fx.GRID}, {fx.STATIONS}, s AS (SELECT station_id, CAST(station_id % 24 AS INT) AS cell_row, CAST(station_id * 5 % 36 AS INT) AS cell_col FROM stations) SELECT station_id, step, round(temperature_k, 4) AS temperature_k FROM s JOIN grid USING (cell_row, cell_col)")
def join_station_sample(spark, d):
    """Each station takes the values of its nearest cell."""
    from .weather import _axes

    cells = g.nearest_cell(fx.stations(spark, d), *_axes(spark), key="station_id")
    return cells.join(fx.grid_forecast(spark, d), ["cell_row", "cell_col"]).select("station_id", "step", F.round("temperature_k", 4).alias("temperature_k"))


