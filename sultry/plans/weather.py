"""Queries on physics and grids, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, physics
from ..functions.physics import CPA, CPV, CVL, CVV, E0V, ICE_POWER, ICE_RATE, LIQUID_POWER, LIQUID_RATE, RGASA, RGASV
from ..operators import grid as g
from . import fixtures as fx
from .define import Registry

R = Registry()


def r4(c, name: str | None = None):
    """Rounded for comparison: wet bulbs, which a solver gives, to six digits, other values to four."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 6 if name in ("wet_bulb_k", "max_value") else 4)
    return out.alias(name) if name else out


def esat_sql(t: str, power: float = LIQUID_POWER, rate: float = LIQUID_RATE) -> str:
    return f"(611.65::DOUBLE * pow(({t}) / 273.16::DOUBLE, {power!r}::DOUBLE) * exp({rate!r}::DOUBLE * (1 / 273.16::DOUBLE - 1.0::DOUBLE / ({t}))))"


def wet_sql(source: str, id_cols: str = "id") -> str:
    """CTEs rows_in -> wet(id, wet_bulb_k) by 60 bisection steps; source has id, p, t, e and lo, the temperature where e saturates."""
    m = "((lo + hi) / 2)"
    es = esat_sql(m)
    qs = f"(CASE WHEN {es} > p THEN {es} / p ELSE 1 / ({RGASV}::DOUBLE * p / ({RGASA}::DOUBLE * {es}) - {RGASV / RGASA!r}::DOUBLE + 1) END)"
    qv = f"({RGASA}::DOUBLE * e / ({RGASV}::DOUBLE * p - {RGASV}::DOUBLE * e + {RGASA}::DOUBLE * e))"
    res = f"(((1 - {qv}) * {CPA}::DOUBLE + {qv} * {CPV}::DOUBLE) * ({m} - t) * (1 - {qs}) + ({qs} - {qv}) * ({E0V}::DOUBLE + {CVV - CVL}::DOUBLE * ({m} - 273.16::DOUBLE) + {RGASV}::DOUBLE * {m}))"
    return f"""bis AS (SELECT id, p, t, e, lo, t AS hi, 0 AS k FROM ({source})
 UNION ALL SELECT id, p, t, e, CASE WHEN {res} < 0 THEN {m} ELSE lo END, CASE WHEN {res} < 0 THEN hi ELSE {m} END, k + 1 FROM bis WHERE k < 45),
wet AS (SELECT id, round((lo + hi) / 2, 6) AS wet_bulb_k FROM bis WHERE k = 45)"""


GRID_WET = f"""{fx.GRID}, g AS (SELECT *, cell_row * 100000 + cell_col * 1000 + step AS id FROM grid WHERE temperature_k > 273.16),
{wet_sql(f"SELECT id, pressure_pa AS p, temperature_k AS t, least(dew_point_k, temperature_k) AS lo, {esat_sql('least(dew_point_k, temperature_k)')} AS e FROM g")},
gw AS (SELECT g.*, wet_bulb_k FROM g JOIN wet USING (id))"""
PEAK = """peak AS (SELECT * EXCLUDE (rn) FROM (SELECT cell_row, cell_col, lat, lon, wet_bulb_k, temperature_k, dew_point_k, pressure_pa, step AS peak_step, valid_time AS peak_time,
 row_number() OVER (PARTITION BY cell_row, cell_col ORDER BY round(wet_bulb_k, 6) DESC, step) AS rn FROM gw) WHERE rn = 1)"""
HOURLY = f"""{fx.GRID}, nx AS (SELECT *, lead(step) OVER w AS ns, lead(temperature_k) OVER w AS nt, lead(dew_point_k) OVER w AS nd, lead(pressure_pa) OVER w AS np FROM grid WINDOW w AS (PARTITION BY cell_row, cell_col ORDER BY step)),
hourly AS (SELECT cell_row, cell_col, lat, lon, hour, TIMESTAMP '{fx.INIT}' + to_hours(CAST(hour AS INT)) AS valid_time,
 CASE WHEN hour = step THEN temperature_k ELSE temperature_k + (nt - temperature_k) * (hour - step) / (ns - step) END AS temperature_k,
 CASE WHEN hour = step THEN dew_point_k ELSE dew_point_k + (nd - dew_point_k) * (hour - step) / (ns - step) END AS dew_point_k,
 CASE WHEN hour = step THEN pressure_pa ELSE pressure_pa + (np - pressure_pa) * (hour - step) / (ns - step) END AS pressure_pa
 FROM (SELECT *, unnest(range(step, coalesce(ns, step + 1))) AS hour FROM nx))"""


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.with_wet_bulb(g.warm_finite(fx.grid_forecast(spark, sf_dir)))
    return g.cell_peak(rows.withColumn("wet_bulb_k", F.round("wet_bulb_k", 6)))


GRID_BASE = f"WITH {fx.GRID} "
WET = f"WITH RECURSIVE {GRID_WET} "
PK = f"WITH RECURSIVE {GRID_WET}, {PEAK} "
LANDED = f"{PK}, {fx.LAND}, lp AS (SELECT peak.* FROM peak JOIN land USING (cell_row, cell_col) WHERE fraction >= 0.5) "


@R.add("src_grid_long", GRID_BASE + "SELECT step, count(*) AS n_rows, count(DISTINCT (cell_row, cell_col)) AS n_cells, count(*) - count(DISTINCT (cell_row, cell_col)) AS n_duplicates, max(valid_time) AS valid_time FROM grid GROUP BY step")
def src_grid_long(spark, d):
    grid = fx.grid_forecast(spark, d)
    cells = F.countDistinct("cell_row", "cell_col")
    return grid.groupBy("step").agg(F.count("*").alias("n_rows"), cells.alias("n_cells"), (F.count("*") - cells).alias("n_duplicates"), F.max("valid_time").alias("valid_time"))


@R.add("filter_warm_finite", GRID_BASE + "SELECT cell_row, cell_col, step, round(temperature_k, 4) AS temperature_k FROM grid WHERE temperature_k > 273.16 AND isfinite(temperature_k) AND isfinite(dew_point_k) AND isfinite(pressure_pa)")
def filter_warm_finite(spark, d):
    return g.warm_finite(fx.grid_forecast(spark, d)).select("cell_row", "cell_col", "step", r4("temperature_k", "temperature_k"))


def _fields(spark, d):
    return fx.grid_forecast(spark, d).select("cell_row", "cell_col", "step", "temperature_k", "dew_point_k", "pressure_pa")


@R.add("esat_liquid", GRID_BASE + f"SELECT cell_row, cell_col, step, round({esat_sql('temperature_k')}, 4) AS esat FROM grid")
def esat_liquid(spark, d):
    return _fields(spark, d).select("cell_row", "cell_col", "step", r4(physics.esat_liquid(F.col("temperature_k")), "esat"))


@R.add("esat_ice", GRID_BASE + f"SELECT cell_row, cell_col, step, round({esat_sql('temperature_k - 40', ICE_POWER, ICE_RATE)}, 4) AS esat FROM grid")
def esat_ice(spark, d):
    return _fields(spark, d).select("cell_row", "cell_col", "step", r4(physics.esat_ice(F.col("temperature_k") - 40), "esat"))


@R.add("tsat_liquid", GRID_BASE + "SELECT cell_row, cell_col, step, round(dew_point_k, 4) AS tsat FROM grid")
def tsat_liquid(spark, d):
    """The inverse of esat_liquid brings the dew point back."""
    return _fields(spark, d).select("cell_row", "cell_col", "step", r4(physics.tsat_liquid(physics.esat_liquid(F.col("dew_point_k"))), "tsat"))


@R.add("wetbulb_romps_dewpoint", WET + "SELECT cell_row, cell_col, step, round(wet_bulb_k, 6) AS wet_bulb_k FROM gw")
def wetbulb_romps_dewpoint(spark, d):
    return g.with_wet_bulb(g.warm_finite(fx.grid_forecast(spark, d))).select("cell_row", "cell_col", "step", r4("wet_bulb_k", "wet_bulb_k"))


@R.add("wetbulb_romps_vapor", WET + "SELECT cell_row, cell_col, step, round(wet_bulb_k, 6) AS wet_bulb_k FROM gw")
def wetbulb_romps_vapor(spark, d):
    e = physics.esat_liquid(F.least("dew_point_k", "temperature_k"))
    wet = physics.wetbulb_romps_vapor(F.col("pressure_pa"), F.col("temperature_k"), e)
    return _fields(spark, d).where("temperature_k > 273.16").select("cell_row", "cell_col", "step", r4(wet, "wet_bulb_k"))


@R.add("wetbulb_romps_rh", f"""WITH RECURSIVE {fx.GRID}, g AS (SELECT *, cell_row * 100000 + cell_col * 1000 + step AS id FROM grid WHERE temperature_k > 273.16),
{wet_sql(f"SELECT id, pressure_pa AS p, temperature_k AS t, 0.5 * {esat_sql('temperature_k')} AS e, 200.0::DOUBLE AS lo FROM g")}
SELECT cell_row, cell_col, step, round(wet_bulb_k, 6) AS wet_bulb_k FROM g JOIN wet USING (id)""")
def wetbulb_romps_rh(spark, d):
    wet = physics.wetbulb_romps_rh(F.col("pressure_pa"), F.col("temperature_k"), F.lit(0.5))
    return _fields(spark, d).where("temperature_k > 273.16").select("cell_row", "cell_col", "step", r4(wet, "wet_bulb_k"))


_T, _RH = "(CAST(c_custkey % 90 AS DOUBLE) - 30)", "CAST(c_custkey % 111 AS DOUBLE)"


def _stull_sql(t: str, rh: str) -> str:
    return f"(floor((({t}) * atan(0.151977::DOUBLE * sqrt(({rh}) + 8.313659::DOUBLE)) + atan(({t}) + ({rh})) - atan(({rh}) - 1.676331::DOUBLE) + 0.00391838::DOUBLE * pow(({rh}), 1.5) * atan(0.023101::DOUBLE * ({rh})) - 4.686035::DOUBLE) * 100 + 0.5) / 100)"


_CT, _CRH = f"least(greatest({_T}, -20), 50)", f"least(greatest({_RH}, 5), 99)"


def _readings(spark, d):
    k = F.col("c_custkey")
    return fx.table(spark, d, "customer").select(k.alias("id"), ((k % 90).cast("double") - 30).alias("t"), (k % 111).cast("double").alias("rh"))


@R.add("wetbulb_stull_strict", f"SELECT c_custkey AS id, CASE WHEN {_T} BETWEEN -20 AND 50 AND {_RH} BETWEEN 5 AND 99 THEN {_stull_sql(_T, _RH)} END AS wet_bulb_c FROM customer")
def wetbulb_stull_strict(spark, d):
    return _readings(spark, d).select("id", physics.wetbulb_stull_strict(F.col("t"), F.col("rh")).alias("wet_bulb_c"))


@R.add("wetbulb_stull_clamped", f"SELECT c_custkey AS id, CASE WHEN {_RH} >= 100 THEN floor({_T} * 100 + 0.5) / 100 ELSE {_stull_sql(_CT, _CRH)} END AS wet_bulb_c, {_stull_sql(_CT, _CRH)} AS browser_c FROM customer")
def wetbulb_stull_clamped(spark, d):
    t, rh = F.col("t"), F.col("rh")
    return _readings(spark, d).select("id", physics.wetbulb_stull_clamped(t, rh).alias("wet_bulb_c"), physics.wetbulb_stull_browser(t, rh).alias("browser_c"))


@R.add("kelvin_to_celsius", GRID_BASE + "SELECT cell_row, cell_col, step, floor((temperature_k - 273.15) * 100 + 0.5) / 100 AS celsius FROM grid")
def kelvin_to_celsius(spark, d):
    return _fields(spark, d).select("cell_row", "cell_col", "step", physics.kelvin_to_celsius(F.col("temperature_k")).alias("celsius"))


@R.add("win_interpolate_hourly", f"WITH {HOURLY} SELECT cell_row, cell_col, CAST(hour AS INT) AS hour, valid_time, round(temperature_k, 4) AS temperature_k, round(dew_point_k, 4) AS dew_point_k, round(pressure_pa, 4) AS pressure_pa FROM hourly")
def win_interpolate_hourly(spark, d):
    return g.interpolate_hourly(fx.grid_forecast(spark, d)).select("cell_row", "cell_col", "hour", "valid_time", *[r4(c, c) for c in g.FIELDS])


_PEAK_COLS = "cell_row, cell_col, round(wet_bulb_k, 6) AS wet_bulb_k, round(temperature_k, 4) AS temperature_k, round(dew_point_k, 4) AS dew_point_k, pressure_pa, peak_step, peak_time"


def _peak_cols(df):
    return df.select("cell_row", "cell_col", r4("wet_bulb_k", "wet_bulb_k"), r4("temperature_k", "temperature_k"), r4("dew_point_k", "dew_point_k"), "pressure_pa", "peak_step", "peak_time")


@R.add("agg_cell_peak", PK + f"SELECT {_PEAK_COLS} FROM peak")
def agg_cell_peak(spark, d):
    return _peak_cols(peaks(spark, d))


@R.add("topk_grid_cells", PK + "SELECT cell_row, cell_col, round(wet_bulb_k, 6) AS wet_bulb_k, CAST(row_number() OVER (ORDER BY round(wet_bulb_k, 6) DESC, lat, lon) AS INT) AS rank FROM peak QUALIFY rank <= 50")
def topk_grid_cells(spark, d):
    return g.hottest_cells(peaks(spark, d)).select("cell_row", "cell_col", r4("wet_bulb_k", "wet_bulb_k"), "rank")


@R.add("filter_land", LANDED + "SELECT cell_row, cell_col, round(wet_bulb_k, 6) AS wet_bulb_k FROM lp")
def filter_land(spark, d):
    return g.land_cells(peaks(spark, d), fx.land_mask(spark)).select("cell_row", "cell_col", r4("wet_bulb_k", "wet_bulb_k"))


@R.add("agg_global_land_max", LANDED + "SELECT cell_row, cell_col, round(wet_bulb_k, 6) AS max_value, (SELECT count(*) FROM lp) AS n_cells FROM lp ORDER BY round(wet_bulb_k, 6) DESC, cell_row, cell_col LIMIT 1")
def agg_global_land_max(spark, d):
    return g.land_maximum(g.land_cells(peaks(spark, d), fx.land_mask(spark))).select("cell_row", "cell_col", r4("max_value", "max_value"), "n_cells")


HOT = LANDED + ", hot AS (SELECT * FROM lp WHERE round(wet_bulb_k, 6) >= (SELECT max(round(wet_bulb_k, 6)) FROM lp) - 2.0 OR round(wet_bulb_k, 6) >= 305.15) "


def _hot(spark, d):
    return g.hot_cells(g.land_cells(peaks(spark, d), fx.land_mask(spark)), threshold=305.15)


@R.add("select_hot_cells", HOT + "SELECT cell_row, cell_col, round(wet_bulb_k, 6) AS wet_bulb_k FROM hot")
def select_hot_cells(spark, d):
    return _hot(spark, d).select("cell_row", "cell_col", r4("wet_bulb_k", "wet_bulb_k"))


_DILATE = "SELECT DISTINCT cell_row + dr AS cell_row, (cell_col + dc + 36) % 36 AS cell_col FROM hot, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc) WHERE cell_row + dr BETWEEN 0 AND 23"


@R.add("win_dilate_cells", HOT + _DILATE)
def win_dilate_cells(spark, d):
    return g.dilate_cells(_hot(spark, d), 1, fx.ROWS, fx.COLS)


NEAR = f"""{fx.CITIES}, latax AS (SELECT CAST(i AS INT) AS cell_row, 57.5 - 5.0 * i AS lat FROM range(24) t(i)), lonax AS (SELECT CAST(i AS INT) AS cell_col, 10.0 * i AS lon FROM range(36) t(i)),
near AS (SELECT c.*, (SELECT cell_row FROM latax ORDER BY abs(lat - c.latitude), cell_row LIMIT 1) AS cell_row,
 (SELECT cell_col FROM lonax ORDER BY abs((lon - c.longitude + 540) - 360 * floor((lon - c.longitude + 540) / 360) - 180), cell_col LIMIT 1) AS cell_col FROM cities c)"""


def _axes(spark):
    lats = spark.range(fx.ROWS).select(F.col("id").cast("int").alias("cell_row"), (57.5 - 5.0 * F.col("id")).alias("lat"))
    lons = spark.range(fx.COLS).select(F.col("id").cast("int").alias("cell_col"), (10.0 * F.col("id")).alias("lon"))
    return lats, lons


def _near(spark, d):
    return g.nearest_cell(fx.cities(spark, d), *_axes(spark), key="city_id")


@R.add("join_nearest_cell", f"WITH {NEAR} SELECT city_id, cell_row, cell_col FROM near")
def join_nearest_cell(spark, d):
    return _near(spark, d).select("city_id", "cell_row", "cell_col")


@R.add("join_cities_in_hot_cells", HOT.rstrip() + f", dil AS ({_DILATE}), {NEAR} SELECT city_id, near.cell_row, near.cell_col, round(peak.wet_bulb_k, 6) AS wet_bulb_k FROM near JOIN dil USING (cell_row, cell_col) LEFT JOIN peak ON peak.cell_row = near.cell_row AND peak.cell_col = near.cell_col")
def join_cities_in_hot_cells(spark, d):
    cells = g.dilate_cells(_hot(spark, d), 1, fx.ROWS, fx.COLS).join(peaks(spark, d), ["cell_row", "cell_col"], "left")
    return _near(spark, d).join(cells, ["cell_row", "cell_col"]).select("city_id", "cell_row", "cell_col", r4("wet_bulb_k", "wet_bulb_k"))


R.queries["pipe_city_candidates"] = join_cities_in_hot_cells
R.sql["pipe_city_candidates"] = R.sql["join_cities_in_hot_cells"]

TOP_HOURLY = f"""WITH RECURSIVE {HOURLY}, g AS (SELECT *, cell_row * 100000 + cell_col * 1000 + hour AS id FROM hourly WHERE temperature_k > 273.16),
{wet_sql(f"SELECT id, pressure_pa AS p, temperature_k AS t, least(dew_point_k, temperature_k) AS lo, {esat_sql('least(dew_point_k, temperature_k)')} AS e FROM g")},
gw AS (SELECT g.*, hour AS step, wet_bulb_k FROM g JOIN wet USING (id)), {PEAK}
SELECT cell_row, cell_col, round(wet_bulb_k, 6) AS wet_bulb_k, CAST(peak_step AS INT) AS peak_step, peak_time, CAST(row_number() OVER (ORDER BY round(wet_bulb_k, 6) DESC, lat, lon) AS INT) AS rank FROM peak QUALIFY rank <= 50"""


def hourly_top(spark, d, rows=fx.ROWS, cols=fx.COLS):
    hourly = g.interpolate_hourly(fx.grid_forecast(spark, d, rows, cols))
    wet = g.with_wet_bulb(g.warm_finite(hourly)).withColumn("wet_bulb_k", F.round("wet_bulb_k", 6))
    return g.hottest_cells(g.cell_peak(wet, step="hour"))


@R.add("pipe_global_grid_top50", TOP_HOURLY)
def pipe_global_grid_top50(spark, d):
    """Flagship: hourly interpolation, thermodynamic wet bulb, each cell's peak, the 50 hottest; an error if the list is not a valid snapshot."""
    top = hourly_top(spark, d).select("cell_row", "cell_col", r4("wet_bulb_k", "wet_bulb_k"), "peak_step", "peak_time", "rank")
    return g.valid_snapshot(top)


@R.add("project_public_grid", PK + ", top AS (SELECT *, CAST(row_number() OVER (ORDER BY round(wet_bulb_k, 6) DESC, lat, lon) AS INT) AS rank FROM peak QUALIFY rank <= 50) SELECT rank, lat AS latitude, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS longitude, pressure_pa / 100 AS pressure_hpa, peak_time, peak_time + INTERVAL 3 HOUR AS until FROM top")
def project_public_grid(spark, d):
    return g.public_grid(g.hottest_cells(peaks(spark, d)))


_WARMER = PK + """, a AS (SELECT lat, lon, row_number() OVER (ORDER BY round(wet_bulb_k, 6) DESC, lat, lon) AS r FROM peak), b AS (SELECT lat, lon, row_number() OVER (ORDER BY round(temperature_k, 6) DESC, lat, lon) AS r FROM peak),
ta AS (SELECT lat, (lon + 180) - 360 * floor((lon + 180) / 360) - 180 AS lon FROM a WHERE r <= 20), tb AS (SELECT lat, (lon + 180) - 360 * floor((lon + 180) / 360) - 180 AS lon FROM b WHERE r <= 20)"""


def _two(spark, d):
    p = peaks(spark, d)
    return g.hottest_cells(p, 20), g.hottest_cells(p.withColumn("temperature_k", F.round("temperature_k", 6)), 20, "temperature_k")


_RANKED = """, a AS (SELECT lat, lon, wet_bulb_k, row_number() OVER (ORDER BY round(wet_bulb_k, 6) DESC, lat, lon) AS r FROM peak), b AS (SELECT lat, lon, round(temperature_k, 6) AS wet_bulb_k, row_number() OVER (ORDER BY round(temperature_k, 6) DESC, lat, lon) AS r FROM peak),
t AS (SELECT * FROM (SELECT 'a' AS m, * FROM a WHERE r <= 50 UNION ALL SELECT 'b', * FROM b WHERE r <= 50)), o AS (SELECT x.r AS ra, y.r AS rb FROM t x JOIN t y ON x.m = 'a' AND y.m = 'b' AND x.lat = y.lat AND x.lon = y.lon),
ca AS (SELECT city_id FROM cities WHERE city_id % 3 = 0), cb AS (SELECT city_id FROM cities WHERE city_id % 4 = 0)"""


@R.add("agg_model_comparison", PK.rstrip() + f""", {fx.CITIES}{_RANKED} SELECT (SELECT count(*) FROM o WHERE ra <= 20 AND rb <= 20) AS top20_overlap, (SELECT count(*) FROM o) AS top50_overlap,
 (SELECT CAST(round(lat, 4) AS DOUBLE) FROM a WHERE r = 1) AS lat_a, (SELECT round((lon + 180) - 360 * floor((lon + 180) / 360) - 180, 4) FROM a WHERE r = 1) AS lon_a, (SELECT round(wet_bulb_k, 6) FROM a WHERE r = 1) AS wet_bulb_k_a,
 (SELECT CAST(round(lat, 4) AS DOUBLE) FROM b WHERE r = 1) AS lat_b, (SELECT round((lon + 180) - 360 * floor((lon + 180) / 360) - 180, 4) FROM b WHERE r = 1) AS lon_b, (SELECT wet_bulb_k FROM b WHERE r = 1) AS wet_bulb_k_b,
 (SELECT count(*) FROM ca) AS candidates_a, (SELECT count(*) FROM cb) AS candidates_b, (SELECT count(*) FROM ca JOIN cb USING (city_id)) AS candidates_both, (SELECT count(*) FROM ca ANTI JOIN cb USING (city_id)) AS only_a, (SELECT count(*) FROM cb ANTI JOIN ca USING (city_id)) AS only_b""")
def agg_model_comparison(spark, d):
    """The wet bulb against the temperature as if of two models, with candidates that overlap in part."""
    p = peaks(spark, d)
    a, b = g.hottest_cells(p, 50), g.hottest_cells(p.withColumn("temperature_k", F.round("temperature_k", 6)), 50, "temperature_k").withColumn("wet_bulb_k", F.col("temperature_k"))
    c = fx.cities(spark, d).select(F.col("city_id").alias("path"))
    out = g.model_comparison(a, b, c.where("path % 3 = 0"), c.where("path % 4 = 0"))
    rounded = {f"{x}_{m}": F.round(f"{x}_{m}", 4) for x in ("lat",) for m in "ab"} | {f"lon_{m}": F.round(geo.normalize_lon(F.col(f"lon_{m}")), 4) for m in "ab"} | {f"wet_bulb_k_{m}": F.round(f"wet_bulb_k_{m}", 6) for m in "ab"}
    return out.withColumns(rounded)


@R.add("set_top_overlap", _WARMER + " SELECT round(lat, 4) AS lat, round(lon, 4) AS lon FROM (SELECT * FROM ta INTERSECT SELECT * FROM tb)")
def set_top_overlap(spark, d):
    a, b = _two(spark, d)
    cells = lambda x: x.select(F.round("lat", 4).alias("lat"), F.round(geo.normalize_lon(F.col("lon")), 4).alias("lon"))
    return cells(a).intersect(cells(b))


@R.add("validate_axes", GRID_BASE + """SELECT 'latitude' AS axis, count(DISTINCT lat) AS n_values, count(*) FILTER (lat IS NULL OR NOT isfinite(lat) OR abs(lat) > 90) AS n_bad, count(DISTINCT cell_row) - count(DISTINCT lat) AS n_repeated FROM grid
UNION ALL SELECT 'longitude', count(DISTINCT lon), count(*) FILTER (lon IS NULL OR NOT isfinite(lon) OR lon < -180 OR lon >= 360), count(DISTINCT cell_col) - count(DISTINCT lon) FROM grid""")
def validate_axes(spark, d):
    grid = fx.grid_forecast(spark, d)

    def axis(name, value, index, ok):
        return grid.agg(F.countDistinct(value).alias("n_values"), F.count_if(~(g.finite(F.col(value)) & ok)).alias("n_bad"), (F.countDistinct(index) - F.countDistinct(value)).alias("n_repeated")).select(F.lit(name).alias("axis"), "*")

    return axis("latitude", "lat", "cell_row", F.col("lat").between(-90, 90)).union(axis("longitude", "lon", "cell_col", (F.col("lon") >= -180) & (F.col("lon") < 360)))


@R.add("validate_step_times", GRID_BASE + "SELECT step, count(*) FILTER (valid_time <> TIMESTAMP '2024-01-01' + to_hours(step)) AS n_shifted, count(*) FILTER (temperature_k <= 0 OR pressure_pa <= 0) AS n_not_positive FROM grid GROUP BY step")
def validate_step_times(spark, d):
    due = F.timestamp_add("HOUR", F.col("step"), F.col("init"))
    return fx.grid_forecast(spark, d).groupBy("step").agg(F.count_if(F.col("valid_time") != due).alias("n_shifted"), F.count_if((F.col("temperature_k") <= 0) | (F.col("pressure_pa") <= 0)).alias("n_not_positive"))
