"""Queries on city forecasts and snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, times
from ..operators import forecast as fc
from ..session import materialize
from ..sources import files
from . import fixtures as fx
from .columns import PATH, with_path
from .define import Registry
from .weather import _DILATE, HOT, NEAR, esat_sql, join_cities_in_hot_cells, wet_sql

R = Registry()
NOW = "2024-01-02 05:30:00"
#: The most places that one snapshot may ask a provider for.
PLACES = 1_000_000
_td = "least(dew_point_c, temperature_c) + 273.15::DOUBLE"
HOURS_WET = f"""{fx.CITY_HOURS}, ch AS (SELECT *, city_id * 1000 + hour AS id FROM city_hours), kinds AS (SELECT DISTINCT pressure_pa, temperature_c, dew_point_c, dense_rank() OVER (ORDER BY pressure_pa, temperature_c, dew_point_c) AS id FROM ch),
{wet_sql(f"SELECT id, pressure_pa AS p, temperature_c + 273.15::DOUBLE AS t, {_td} AS lo, {esat_sql(_td)} AS e FROM kinds")},
hw AS (SELECT ch.*, round(wet_bulb_k - 273.15, 6) AS wet_bulb_c, CAST(valid_time + to_seconds(offset_s) AS DATE) AS local_day FROM ch JOIN kinds USING (pressure_pa, temperature_c, dew_point_c) JOIN wet ON wet.id = kinds.id)"""
H = f"WITH RECURSIVE {HOURS_WET} "


def _hours(spark, d, of=None):
    """Hours with their wet bulbs; only those of wanted locations (`of`) go through the solver."""
    return fc.with_wet_bulb_c(fx.city_hours(spark, d, of=of))


def _ts(s):
    return F.lit(s).cast("timestamp")


def payload(spark, d):
    """city_hours collected into provider documents."""
    rows = fx.city_hours(spark, d).groupBy("city_id", "offset_s").agg(F.array_sort(F.collect_list(F.struct("hour", "valid_time", "temperature_c", "dew_point_c", "pressure_pa"))).alias("h"))
    col = lambda f: F.transform("h", f)
    hourly = F.struct(col(lambda x: F.date_format(x["valid_time"], "yyyy-MM-dd HH:mm:ss")).alias("time"), col(lambda x: x["temperature_c"]).alias("temperature_2m"), col(lambda x: x["dew_point_c"]).alias("dew_point_2m"), col(lambda x: x["pressure_pa"] / 100).alias("surface_pressure"))
    return rows.select(F.col("city_id").alias("path"), hourly.alias("hourly"), F.struct(F.lit("°C").alias("temperature_2m")).alias("hourly_units"), F.col("offset_s").alias("utc_offset_seconds"))


@R.add("src_hourly_payload", f"WITH {fx.CITY_HOURS} SELECT city_id AS path, CAST(hour AS INT) AS hour, offset_s, valid_time, round(temperature_c, 4) AS temperature_c, round(dew_point_c, 4) AS dew_point_c, round(pressure_pa, 4) AS pressure_pa FROM city_hours WHERE city_id % 9 <> 4")
def src_hourly_payload(spark, d):
    """Provider documents, some of them in another unit, written as JSON and read back."""
    docs = payload(spark, d)
    unit = F.when(F.col("path") % 9 == 4, "°F").otherwise("°C")
    path = fx.folder(spark, "payloads")
    docs.withColumn("hourly_units", F.struct(unit.alias("temperature_2m"))).write.json(path)
    return fc.explode_payload(files.hourly_payloads(spark, path)).select("path", "hour", "offset_s", "valid_time", *[F.round(c, 4).alias(c) for c in ("temperature_c", "dew_point_c", "pressure_pa")])


PEAK24 = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY wet_bulb_c DESC, valid_time) AS rn, count(*) OVER (PARTITION BY city_id) AS n FROM hw WHERE valid_time >= TIMESTAMP '2024-01-01 06:00:00' AND valid_time < TIMESTAMP '2024-01-02 06:00:00') WHERE rn = 1 AND n = 24"


def peak24(spark, d):
    return fc.location_maximum(_hours(spark, d), _ts("2024-01-01 06:00:00"))


@R.add("agg_location_24h_max", H + f"SELECT city_id, round(wet_bulb_c, 6) AS wet_bulb_c, valid_time AS peak_time, round(temperature_c, 6) AS temperature_c, round(dew_point_c, 6) AS dew_point_c FROM ({PEAK24})")
def agg_location_24h_max(spark, d):
    return peak24(spark, d).select("city_id", "peak_time", *[F.round(c, 6).alias(c) for c in ("wet_bulb_c", "temperature_c", "dew_point_c")])


DAILY = "daily AS (SELECT city_id, local_day, max(wet_bulb_c) AS wet_bulb_c, arg_min(valid_time, -wet_bulb_c * 1e6 + epoch(valid_time) * 1e-9) AS peak_time, max(offset_s) AS offset_s FROM hw GROUP BY 1, 2 HAVING count(*) = 24)"


@R.add("agg_daily_complete_max", H.rstrip() + f", {DAILY} SELECT city_id, local_day, round(wet_bulb_c, 6) AS wet_bulb_c FROM daily")
def agg_daily_complete_max(spark, d):
    return fc.daily_complete_maximum(_hours(spark, d)).select("city_id", "local_day", F.round("wet_bulb_c", 6).alias("wet_bulb_c"))


FIVE = f"""spine AS (SELECT city_id, CAST(TIMESTAMP '{NOW}' + to_seconds(offset_s) AS DATE) AS today, CAST(TIMESTAMP '{NOW}' + to_seconds(offset_s) AS DATE) + CAST(i AS INT) AS local_day FROM (SELECT DISTINCT city_id, offset_s FROM hw), range(5) r(i)),
best AS (SELECT city_id, local_day, max(wet_bulb_c) AS wet_bulb_c FROM hw WHERE valid_time > TIMESTAMP '{NOW}' GROUP BY 1, 2),
five AS (SELECT spine.city_id, spine.local_day, wet_bulb_c, count(*) FILTER (wet_bulb_c IS NULL AND spine.local_day > today) OVER (PARTITION BY spine.city_id) AS missing FROM spine LEFT JOIN best ON best.city_id = spine.city_id AND best.local_day = spine.local_day)"""


@R.add("agg_five_day_remaining", H.rstrip() + f", {FIVE} SELECT city_id, local_day, round(wet_bulb_c, 6) AS wet_bulb_c FROM five WHERE missing = 0")
def agg_five_day_remaining(spark, d):
    return fc.five_day_remaining(_hours(spark, d), _ts(NOW)).select("city_id", "local_day", F.round("wet_bulb_c", 6).alias("wet_bulb_c"))


PINNED = f"""pin AS (SELECT city_id, local_day, count(*) AS n, count(*) FILTER (valid_time > TIMESTAMP '{NOW}') AS left_, max(wet_bulb_c) AS wet_bulb_c, max(CASE WHEN valid_time > TIMESTAMP '{NOW}' THEN wet_bulb_c END) AS rest_c, any_value(CAST(TIMESTAMP '{NOW}' + to_seconds(offset_s) AS DATE)) AS today, any_value(offset_s) AS offset_s FROM hw GROUP BY 1, 2)"""


@R.add("agg_pinned_five_day", H.rstrip() + f""", {PINNED} SELECT city_id, local_day, round(CASE WHEN local_day = today THEN rest_c ELSE wet_bulb_c END, 6) AS wet_bulb_c FROM pin
WHERE (local_day > today AND n = 24) OR (local_day = today AND left_ = 23 - floor(epoch(TIMESTAMP '{NOW}' + to_seconds(offset_s) - CAST(local_day AS TIMESTAMP)) / 3600))""")
def agg_pinned_five_day(spark, d):
    return pinned_days(_hours(spark, d)).withColumn("wet_bulb_c", F.round("wet_bulb_c", 6))


def pinned_days(hours):
    """Today counts if all its remaining hours are there, later days if all 24 are."""
    now = _ts(NOW)
    rows = hours.withColumn("local_day", times.local_date(F.col("valid_time"), F.col("offset_s"))).withColumn("today", times.local_date(now, F.col("offset_s")))
    rest = F.col("valid_time") > now
    agg = rows.groupBy("city_id", "local_day", "today", "offset_s").agg(F.count("*").alias("n"), F.count_if(rest).alias("left"), F.max("wet_bulb_c").alias("all_c"), F.max(F.when(rest, F.col("wet_bulb_c"))).alias("rest_c"))
    due = 23 - F.hour(F.timestamp_add("SECOND", F.col("offset_s"), now))
    ok = ((F.col("local_day") > F.col("today")) & (F.col("n") == 24)) | ((F.col("local_day") == F.col("today")) & (F.col("left") == due))
    return agg.where(ok).select("city_id", "local_day", F.when(F.col("local_day") == F.col("today"), F.col("rest_c")).otherwise(F.col("all_c")).alias("wet_bulb_c"))


MERGE = f"""{DAILY}, sp AS (SELECT city_id, DATE '2024-01-02' + CAST(i AS INT) AS local_day FROM (SELECT DISTINCT city_id FROM hw), range(5) r(i)),
a AS (SELECT city_id, local_day, wet_bulb_c + 1 AS a, offset_s + CASE WHEN city_id % 5 = 0 THEN 3600 ELSE 0 END AS oa FROM daily WHERE city_id % 3 <> 0 OR local_day < DATE '2024-01-04'), b AS (SELECT city_id, local_day, wet_bulb_c AS b, offset_s AS ob FROM daily WHERE city_id % 7 <> 0 OR local_day <> DATE '2024-01-04'),
j AS (SELECT sp.*, a, b, coalesce(max(oa) OVER w <> max(ob) OVER w, false) AS differ FROM sp LEFT JOIN a USING (city_id, local_day) LEFT JOIN b USING (city_id, local_day) WINDOW w AS (PARTITION BY city_id)),
m AS (SELECT city_id, local_day, CASE WHEN NOT differ AND a IS NOT NULL THEN a ELSE b END AS wet_bulb_c, CASE WHEN NOT differ AND a IS NOT NULL THEN 'pinned' ELSE 'latest' END AS run FROM j)"""


@R.add("join_merge_runs", H.rstrip() + f", {MERGE} SELECT city_id, local_day, round(wet_bulb_c, 6) AS wet_bulb_c, run FROM (SELECT *, count(*) FILTER (wet_bulb_c IS NULL) OVER (PARTITION BY city_id) AS gaps FROM m) WHERE gaps = 0")
def join_merge_runs(spark, d):
    # The wet bulbs are computed once: the narrow table of daily maxima is read twice.
    daily = materialize(fc.daily_complete_maximum(_hours(spark, d)).select("city_id", "local_day", "wet_bulb_c", ((F.col("city_id") % 25 - 12) * 3600).cast("int").alias("offset_s")), "daily")
    cut = F.lit("2024-01-04").cast("date")
    spine = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("city_id"), F.explode(F.expr("sequence(date'2024-01-02', date'2024-01-06')")).alias("local_day"))
    pinned = daily.where((F.col("city_id") % 3 != 0) | (F.col("local_day") < cut)).select("city_id", "local_day", (F.col("wet_bulb_c") + 1).alias("wet_bulb_c"), (F.col("offset_s") + F.when(F.col("city_id") % 5 == 0, 3600).otherwise(0)).alias("offset_s"))
    latest = daily.where((F.col("city_id") % 7 != 0) | (F.col("local_day") != cut))
    return fc.merge_runs(spine, pinned, latest).select("city_id", "local_day", F.round("wet_bulb_c", 6).alias("wet_bulb_c"), "run")


PIPE_FIVE = f"""{FIVE}, latest AS (SELECT city_id, local_day, wet_bulb_c AS b FROM five WHERE missing = 0),
{PINNED}, pinned AS (SELECT city_id, local_day, CASE WHEN local_day = today THEN rest_c ELSE wet_bulb_c END + 1 AS a, offset_s + CASE WHEN city_id % 5 = 0 THEN 3600 ELSE 0 END AS oa, offset_s AS ob FROM pin
 WHERE ((local_day > today AND n = 24) OR (local_day = today AND left_ = 23 - floor(epoch(TIMESTAMP '{NOW}' + to_seconds(offset_s) - CAST(local_day AS TIMESTAMP)) / 3600))) AND city_id % 3 <> 0),
days5 AS (SELECT city_id, local_day, max(offset_s) OVER (PARTITION BY city_id) AS ob FROM spine JOIN (SELECT DISTINCT city_id, offset_s FROM hw) USING (city_id)),
jj AS (SELECT days5.city_id, days5.local_day, a, b, coalesce(max(oa) OVER (PARTITION BY days5.city_id) <> max(days5.ob) OVER (PARTITION BY days5.city_id), false) AS differ FROM days5 LEFT JOIN pinned ON pinned.city_id = days5.city_id AND pinned.local_day = days5.local_day LEFT JOIN latest ON latest.city_id = days5.city_id AND latest.local_day = days5.local_day),
mm AS (SELECT city_id, local_day, CASE WHEN NOT differ AND a IS NOT NULL THEN a ELSE b END AS wet_bulb_c, CASE WHEN NOT differ AND a IS NOT NULL THEN 'pinned' ELSE 'latest' END AS run FROM jj)"""


@R.add("pipe_city_five_day", H.rstrip() + f", {PIPE_FIVE} SELECT city_id, local_day, round(wet_bulb_c, 6) AS wet_bulb_c, run FROM (SELECT *, count(*) FILTER (wet_bulb_c IS NULL) OVER (PARTITION BY city_id) AS gaps FROM mm) WHERE gaps = 0")
def pipe_city_five_day(spark, d):
    """Provider documents to hours, the latest run's remaining five days, a pinned run's days, and the two merged over each location's five dates."""
    # The wet bulbs of the exploded documents are computed once, for both runs.
    hours = materialize(fc.with_wet_bulb_c(fc.explode_payload(payload(spark, d)).withColumnRenamed("path", "city_id")), "hours")
    now = _ts(NOW)
    offset = hours.groupBy("city_id").agg(F.max("offset_s").alias("offset_s"))
    latest = fc.five_day_remaining(hours, now).join(offset, "city_id")
    pinned = pinned_days(hours).where("city_id % 3 <> 0").join(offset, "city_id")
    pinned = pinned.select("city_id", "local_day", (F.col("wet_bulb_c") + 1).alias("wet_bulb_c"), (F.col("offset_s") + F.when(F.col("city_id") % 5 == 0, 3600).otherwise(0)).alias("offset_s"))
    today = times.local_date(now, F.col("offset_s"))
    spine = offset.select("city_id", F.explode(F.sequence(today, F.date_add(today, 4))).alias("local_day"))
    return fc.merge_runs(spine, pinned, latest).select("city_id", "local_day", F.round("wet_bulb_c", 6).alias("wet_bulb_c"), "run")


_CELL = "concat(printf('%.4f', floor(latitude / 5) * 5), ':', printf('%.4f', floor(longitude / 10) * 10))"
REFINED = f"{fx.CITIES}, p24 AS ({PEAK24}), refined AS (SELECT city_id, {PATH} || CAST(city_id AS VARCHAR) AS path, {_CELL} AS cell, wet_bulb_c, valid_time AS peak_time, city_id % 7 = 0 AS is_control FROM p24 JOIN cities USING (city_id))"
ORDER = "wet_bulb_c DESC, peak_time, cell, path"
TOP = f"top AS (SELECT *, CAST(row_number() OVER (ORDER BY {ORDER}) AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {ORDER}) AS nth FROM refined) WHERE nth = 1 QUALIFY rank <= 50)"


def refined(spark, d):
    c = with_path(fx.cities(spark, d)).withColumn("path", F.concat("path", F.col("city_id").cast("string")))
    cell = geo.cell_id(F.floor(F.col("latitude") / 5) * 5.0, F.floor(F.col("longitude") / 10) * 10.0)
    return peak24(spark, d).join(c.select("city_id", "path", cell.alias("cell")), "city_id").select("city_id", "path", "cell", "wet_bulb_c", "peak_time", (F.col("city_id") % 7 == 0).alias("is_control"))


@R.add("topk_dedup_model_cell", H.rstrip() + f", {REFINED}, {TOP} SELECT city_id, path, cell, round(wet_bulb_c, 6) AS wet_bulb_c, peak_time, rank FROM top")
def topk_dedup_model_cell(spark, d):
    return fc.rank_by_cell(refined(spark, d)).select("city_id", "path", "cell", F.round("wet_bulb_c", 6).alias("wet_bulb_c"), "peak_time", "rank")


@R.add("agg_snapshot_counts", H.rstrip() + f""", {REFINED}, {TOP} SELECT (SELECT count(*) FROM refined) AS n_candidates, (SELECT count(*) FILTER (is_control) FROM refined) AS n_controls, (SELECT count(DISTINCT cell) FROM refined) AS n_cells,
count(*) AS n_published, count(*) FILTER (is_control AND rank <= 20) AS controls_in_top20, (SELECT round(max(wet_bulb_c), 6) FROM refined WHERE is_control) AS max_control_c FROM top""")
def agg_snapshot_counts(spark, d):
    rows = refined(spark, d)
    top = fc.rank_by_cell(rows).agg(F.count("*").alias("n_published"), F.count_if(F.col("is_control") & (F.col("rank") <= 20)).alias("controls_in_top20"))
    whole = rows.agg(F.count("*").alias("n_candidates"), F.count_if("is_control").alias("n_controls"), F.countDistinct("cell").alias("n_cells"), F.round(F.max(F.when(F.col("is_control"), F.col("wet_bulb_c"))), 6).alias("max_control_c"))
    return whole.join(F.broadcast(top))


INHABITED = f"""{fx.CITIES}, cand AS ({HOT.rstrip()}, dil AS ({_DILATE}), {NEAR} SELECT city_id FROM near JOIN dil USING (cell_row, cell_col)), p24 AS ({PEAK24}),
k30 AS (SELECT city_id FROM (SELECT city_id, sha256(concat('init', chr(0), CAST(city_id AS VARCHAR))) AS o FROM cities WHERE city_id NOT IN (SELECT city_id FROM cand) ORDER BY o LIMIT 30)),
refined AS (SELECT city_id, {PATH} || CAST(city_id AS VARCHAR) AS path, {_CELL} AS cell, wet_bulb_c, valid_time AS peak_time, city_id NOT IN (SELECT city_id FROM cand) AS is_control FROM p24 JOIN cities USING (city_id) WHERE city_id IN (SELECT city_id FROM cand) OR city_id IN (SELECT city_id FROM k30))"""


@R.add("pipe_inhabited_top50", H.rstrip() + f""", {INHABITED}, {TOP} SELECT rank, path, round(wet_bulb_c, 6) AS wet_bulb_c, is_control, (SELECT count(*) FILTER (NOT is_control) FROM refined) AS n_candidates, (SELECT count(*) FILTER (is_control) FROM refined) AS n_controls,
(SELECT count(DISTINCT cell) FROM refined) AS n_cells, count(*) OVER () AS n_published, count(*) FILTER (is_control AND rank <= 20) OVER () AS controls_in_top20 FROM top""")
def pipe_inhabited_top50(spark, d):
    """Cities in and around the grid's hot cells and a hashed sample of controls, their maxima over 24 hours, one location a model cell, the 50 hottest; with
    the snapshot's counts. No provider is asked, as the hours are made from the table, so that places have no limit."""
    c = with_path(fx.cities(spark, d)).withColumn("path", F.concat("path", F.col("city_id").cast("string")))
    found = materialize(join_cities_in_hot_cells(spark, d).select("city_id"), "candidates")
    wanted = materialize(fc.with_controls(c, found, "city_id", "init", 30, None), "wanted")
    cell = geo.cell_id(F.floor(F.col("latitude") / 5) * 5.0, F.floor(F.col("longitude") / 10) * 10.0)
    places = wanted.join(c.select("city_id", "path", cell.alias("cell")), "city_id")
    rows = fc.location_maximum(_hours(spark, d, wanted), _ts("2024-01-01 06:00:00")).join(places, "city_id").select("city_id", "path", "cell", "wet_bulb_c", "peak_time", "is_control")
    rows = materialize(rows, "refined")
    top = fc.rank_by_cell(rows)
    whole = rows.agg(F.count_if(~F.col("is_control")).alias("n_candidates"), F.count_if("is_control").alias("n_controls"), F.countDistinct("cell").alias("n_cells"))
    some = top.agg(F.count("*").alias("n_published"), F.count_if(F.col("is_control") & (F.col("rank") <= 20)).alias("controls_in_top20"))
    out = top.select("rank", "path", F.round("wet_bulb_c", 6).alias("wet_bulb_c"), "is_control")
    return out.join(F.broadcast(whole)).join(F.broadcast(some))


@R.add("validate_snapshot", H.rstrip() + f""", {REFINED}, {TOP} SELECT 'ranks' AS rule, CAST(count(*) FILTER (rank NOT BETWEEN 1 AND 50) + abs(count(*) - coalesce(max(rank), 0)) AS BIGINT) AS violations FROM top
UNION ALL SELECT 'cells', count(*) - count(DISTINCT cell) FROM top UNION ALL SELECT 'window', count(*) FILTER (peak_time < TIMESTAMP '2024-01-01 06:00:00' OR peak_time >= TIMESTAMP '2024-01-02 06:00:00') FROM top
UNION ALL SELECT 'counts', abs((SELECT count(*) FROM top) - least(50, count(DISTINCT cell))) + (SELECT count(*) FROM top WHERE path NOT IN (SELECT path FROM refined)) + count(*) - count(DISTINCT path) FROM refined
UNION ALL SELECT 'times', CASE WHEN TIMESTAMP '{fx.INIT}' <= TIMESTAMP '2024-01-01 04:30:00' AND TIMESTAMP '2024-01-01 05:10:00' < TIMESTAMP '2024-01-01 06:00:00' THEN 0 ELSE 1 END""")
def validate_snapshot(spark, d):
    rows = materialize(refined(spark, d), "refined")
    times_ = {"init": _ts(fx.INIT), "first_seen": _ts("2024-01-01 04:30:00"), "retrieved": _ts("2024-01-01 05:10:00"), "start": _ts("2024-01-01 06:00:00"), "end": _ts("2024-01-02 06:00:00")}
    return fc.snapshot_violations(fc.rank_by_cell(rows), rows, times_)


@R.add("topk_hash_sample", f"WITH {fx.CITIES} SELECT city_id, sha256(concat('init', chr(0), CAST(city_id AS VARCHAR))) AS order_key FROM cities WHERE city_id % 3 <> 0 ORDER BY order_key LIMIT 30")
def topk_hash_sample(spark, d):
    c = fx.cities(spark, d)
    return fc.hash_sample(c, c.where("city_id % 3 = 0"), "city_id", "init", 30).select("city_id", "order_key")


@R.add("topk_gsc_controls", f"WITH {fx.CITIES}, top AS (SELECT city_id FROM cities ORDER BY population DESC, city_id LIMIT 200) SELECT city_id, sha256(concat('gsc', chr(0), CAST(city_id AS VARCHAR))) AS order_key FROM cities WHERE city_id NOT IN (SELECT city_id FROM top) ORDER BY order_key LIMIT 200")
def topk_gsc_controls(spark, d):
    c = fx.cities(spark, d)
    return fc.hash_sample(c, c.orderBy(F.desc("population"), "city_id").limit(200), "city_id", "gsc", 200).select("city_id", "order_key")


@R.add("topk_validation_sample", f"WITH {fx.CITIES} SELECT city_id FROM cities ORDER BY city_id > 4, sha256(concat('7', chr(0), CAST(city_id AS VARCHAR))) LIMIT 40")
def topk_validation_sample(spark, d):
    """Fixed rows first, then the lowest seeded hashes."""
    c = fx.cities(spark, d)
    return c.orderBy(F.col("city_id") > 4, F.sha2(F.concat(F.lit("7\0"), F.col("city_id").cast("string")), 256)).limit(40).select("city_id")


@R.add("set_candidates_plus_controls", f"WITH {fx.CITIES}, k AS (SELECT city_id, 'control' AS kind FROM (SELECT city_id, sha256(concat('init', chr(0), CAST(city_id AS VARCHAR))) AS o FROM cities WHERE city_id % 3 <> 0 ORDER BY o LIMIT 30)) SELECT city_id, 'candidate' AS kind FROM cities WHERE city_id % 3 = 0 UNION ALL SELECT * FROM k")
def set_candidates_plus_controls(spark, d):
    c = fx.cities(spark, d)
    both = fc.with_controls(c, c.where("city_id % 3 = 0"), "city_id", "init", 30, PLACES)
    return both.select("city_id", F.when(F.col("is_control"), "control").otherwise("candidate").alias("kind"))


@R.add("validate_hourly_coverage", f"""WITH {fx.CITY_HOURS}, x AS (SELECT *, CAST(valid_time + to_seconds(offset_s) AS DATE) AS local_day, valid_time - lag(valid_time) OVER (PARTITION BY city_id ORDER BY valid_time) AS gap FROM city_hours),
dd AS (SELECT city_id, local_day, count(*) AS n, count(*) FILTER (gap <> INTERVAL 1 HOUR) AS gaps FROM x GROUP BY 1, 2) SELECT city_id, CAST(sum(n) AS BIGINT) AS n_hours, count(*) FILTER (n = 24) AS full_days, CAST(sum(gaps) AS BIGINT) AS n_gaps FROM dd GROUP BY city_id""")
def validate_hourly_coverage(spark, d):
    gap = F.unix_timestamp("valid_time") - F.unix_timestamp(F.lag("valid_time").over(Window.partitionBy("city_id").orderBy("valid_time")))
    x = fx.city_hours(spark, d).withColumn("gap", gap).withColumn("local_day", times.local_date(F.col("valid_time"), F.col("offset_s")))
    days = x.groupBy("city_id", "local_day").agg(F.count("*").alias("n"), F.count_if(F.col("gap") != 3600).alias("gaps"))
    return days.groupBy("city_id").agg(F.sum("n").alias("n_hours"), F.count_if(F.col("n") == 24).alias("full_days"), F.sum("gaps").alias("n_gaps"))


@R.add("agg_point_coverage", f"""WITH {fx.CITY_HOURS}, dd AS (SELECT city_id, CAST(valid_time + to_seconds(offset_s) AS DATE) AS local_day, count(DISTINCT valid_time) AS n, count(*) FILTER (valid_time >= TIMESTAMP '2024-01-01 06:00:00' AND valid_time < TIMESTAMP '2024-01-02 06:00:00') AS w FROM city_hours GROUP BY 1, 2)
SELECT city_id, CAST(sum(w) AS BIGINT) AS window_hours, count(*) FILTER (n = 24) AS full_days FROM dd GROUP BY city_id""")
def agg_point_coverage(spark, d):
    return fc.payload_coverage(fx.city_hours(spark, d), _ts("2024-01-01 06:00:00"))


@R.add("forecast_is_current", H.rstrip() + f""", {DAILY}, f AS (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY local_day) AS rn, (SELECT valid_time FROM hw h WHERE h.city_id = daily.city_id AND h.local_day = daily.local_day ORDER BY h.wet_bulb_c DESC, h.valid_time LIMIT 1) AS at_ FROM daily)
SELECT city_id, local_day = CAST(TIMESTAMP '{NOW}' + to_seconds(offset_s) AS DATE) AND at_ > TIMESTAMP '{NOW}' AS current FROM f WHERE rn = 1""")
def forecast_is_current(spark, d):
    """Whether the first day is today's local date with its peak still ahead."""
    daily = fc.daily_complete_maximum(_hours(spark, d))
    first = daily.groupBy("city_id").agg(F.min(F.struct("local_day", "peak_time")).alias("f"))
    today = times.local_date(_ts(NOW), ((F.col("city_id") % 25 - 12) * 3600).cast("int"))
    return first.select("city_id", ((F.col("f.local_day") == today) & (F.col("f.peak_time") > _ts(NOW))).alias("current"))


@R.add("join_pinned_daily", H.rstrip() + f", {DAILY}, {REFINED}, {TOP} SELECT top.city_id, rank, CAST(count(daily.local_day) AS BIGINT) AS n_days, round(max(daily.wet_bulb_c), 6) AS max_c FROM top LEFT JOIN daily ON daily.city_id = top.city_id GROUP BY 1, 2")
def join_pinned_daily(spark, d):
    """Hotspots with up to seven daily maxima of their own location."""
    # The ranked locations are few: only their hours become days.
    ranked = materialize(fc.rank_by_cell(refined(spark, d)).select("city_id", "rank"), "ranked")
    daily = fc.daily_complete_maximum(_hours(spark, d, ranked)).groupBy("city_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("local_day", "wet_bulb_c"))), 1, 7).alias("days"))
    top = ranked.join(daily, "city_id", "left")
    return top.select("city_id", "rank", F.coalesce(F.size("days"), F.lit(0)).cast("bigint").alias("n_days"), F.round(F.array_max(F.transform("days", lambda x: x["wet_bulb_c"])), 6).alias("max_c"))
