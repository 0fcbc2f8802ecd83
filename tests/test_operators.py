"""Operators on tiny tables with known results."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sultry.functions import geo, physics, text, times
from sultry.operators import analytics, grid, inventory, numbering, verify
from sultry.sources import sinks


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


VECTORS = [(100000.0, 310.0, 0.5, 300.796982564553), (101325.0, 300.0, 0.0, 282.266332743183), (90000.0, 268.15, 0.7, 266.550977075616)]


@pytest.mark.parametrize("p,t,rh,want", VECTORS)
def test_wet_bulb_vectors(spark, p, t, rh, want):
    assert abs(one(spark, physics.wetbulb_romps_rh(F.lit(p), F.lit(t), F.lit(rh))) - want) < 1e-8


def test_wet_bulb_rises_with_humidity_and_stays_below_air(spark):
    rows = spark.range(101).select((F.col("id") / 100).alias("rh")).select(physics.wetbulb_romps_rh(F.lit(95000.0), F.lit(303.0), F.col("rh")).alias("w")).collect()
    values = [r.w for r in rows]
    assert values == sorted(values) and max(values) <= 303.0 + 1e-9


def test_wet_bulb_rejects_bad_input(spark):
    bad = [(0.0, 300.0, 0.5), (1e5, -1.0, 0.5), (1e5, 300.0, 1.5), (float("nan"), 300.0, 0.5)]
    assert all(one(spark, physics.wetbulb_romps_rh(F.lit(p), F.lit(t), F.lit(h))) is None for p, t, h in bad)


def test_stull_variants_differ_at_saturation(spark):
    t, rh = F.lit(20.0), F.lit(100.0)
    assert one(spark, physics.wetbulb_stull_strict(t, rh)) is None
    assert one(spark, physics.wetbulb_stull_clamped(t, rh)) == 20.0
    assert one(spark, physics.wetbulb_stull_browser(t, rh)) != 20.0


def test_half_up(spark):
    assert one(spark, physics.half_up(F.lit(-2.5), 0)) == -2


def cells(spark, rows):
    init = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(init, s, init + dt.timedelta(hours=s), r, c, float(10 - r), float(c), t, d, p) for s, r, c, t, d, p in rows], "init timestamp, step int, valid_time timestamp, cell_row int, cell_col int, lat double, lon double, temperature_k double, dew_point_k double, pressure_pa double")


def test_interpolation(spark):
    g = cells(spark, [(9, 0, 0, 300.0, 290.0, 100000.0), (12, 0, 0, 306.0, 293.0, 100300.0)])
    got = {r.hour: r for r in grid.interpolate_hourly(g, 10, 12).collect()}
    assert sorted(got) == [10, 11, 12] and got[10].temperature_k == 302.0 and got[11].pressure_pa == 100200.0


def test_interpolation_strict(spark):
    g = cells(spark, [(9, 0, 0, 300.0, 290.0, 100000.0), (12, 0, 0, 306.0, 293.0, 100300.0)])
    with pytest.raises(Exception, match="bracket"):
        grid.interpolate_hourly(g, 6, 12, strict=True).collect()


def test_peak_ties_and_nan(spark):
    nan = float("nan")
    g = cells(spark, [(0, 0, 0, 300.0, 295.0, 1e5), (3, 0, 0, 300.0, 295.0, 1e5), (0, 0, 1, nan, 295.0, 1e5), (0, 1, 0, 270.0, 265.0, 1e5)])
    got = grid.cell_peak(grid.with_wet_bulb(grid.warm_finite(g))).collect()
    assert [(r.cell_row, r.cell_col, r.peak_step) for r in got] == [(0, 0, 0)]


def test_top_ties(spark):
    p = spark.createDataFrame([(r, c, float(r - 1), float(c), 300.0) for r in range(3) for c in range(20)], "cell_row int, cell_col int, lat double, lon double, wet_bulb_k double")
    top = grid.hottest_cells(p, 50).orderBy("rank").collect()
    assert len(top) == 50 and (top[0].lat, top[0].lon) == (-1.0, 0.0) and (top[-1].lat, top[-1].lon) == (1.0, 9.0)


def test_dilation_wraps_columns(spark):
    got = {tuple(r) for r in grid.dilate_cells(spark.createDataFrame([(0, 0)], "cell_row int, cell_col int"), 1, 3, 4).collect()}
    assert got == {(0, 3), (0, 0), (0, 1), (1, 3), (1, 0), (1, 1)}


def test_nearest_cell_across_date_line(spark):
    lats = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 0.75, 0.5])], "cell_row int, lat double")
    lons = spark.createDataFrame([(i, -180 + 0.25 * i) for i in range(1440)], "cell_col int, lon double")
    points = spark.createDataFrame([(1, 0.62, -179.9), (2, 0.88, 179.9)], "id int, latitude double, longitude double")
    got = {r.id: (r.cell_row, r.cell_col) for r in grid.nearest_cell(points, lats, lons, "id").collect()}
    assert got == {1: (1, 0), 2: (0, 0)} or got == {1: (2, 0), 2: (0, 0)} or got[2][1] == 0


def test_geo(spark):
    assert one(spark, geo.normalize_lon(F.lit(270.0))) == -90.0
    assert abs(one(spark, geo.wrapped_lon_distance(F.lit(179.0), F.lit(-179.0))) - 2) < 1e-9
    assert one(spark, geo.coordinate_suffix(F.lit(-1.5), F.lit(-20.25))) == "s1-5000-w20-2500"
    assert one(spark, geo.merra2_cell(F.lit(22.749), F.lit(88.125))) == (225, 429)
    assert one(spark, geo.merra2_cell(F.lit(22.75), F.lit(88.125))) is None


def test_text(spark):
    assert one(spark, text.slugify(F.lit("  São Tomé & Príncipe! "))) == "sao-tome-and-principe"
    assert one(spark, text.latin_portion(F.lit("東京 (Tokyo City) 日本 Edo"))) == "Tokyo City"
    assert one(spark, text.fnv1a_bucket(F.lit("a"), 1 << 31)) == 0xE40C292C % (1 << 31)
    assert one(spark, text.location_key(F.lit(-0.0), F.lit(12.5))) == "0,12.5"


def test_week(spark):
    w = one(spark, times.complete_week(F.lit("2026-10-07").cast("date")))
    assert (str(w.first), str(w.last)) == ("2026-09-28", "2026-10-04")


def test_spikes(spark):
    def days(past, now):
        start = dt.date(2026, 1, 1)
        return spark.createDataFrame([(start + dt.timedelta(days=i), v) for i, v in enumerate([*past, now])], "day date, sessions long")

    assert analytics.spike_days(days([20] * 28, 150)).count() == 1
    assert analytics.spike_days(days([100, 200] * 14, 300)).count() == 1
    assert analytics.spike_days(days([20] * 28, 99)).count() == 0


def test_matching(spark):
    t = dt.datetime(2026, 1, 1, 9)
    hours = spark.createDataFrame([(1, t), (1, t + dt.timedelta(hours=1))], "station_id long, valid_time timestamp")
    obs = spark.createDataFrame([(1, t + dt.timedelta(minutes=m), 1.0) for m in (20, 31)], "station_id long, obs_time timestamp, temperature_c double")
    got = {r.valid_time: r.obs_time for r in verify.match_nearest(hours, obs).collect()}
    assert got == {t: t + dt.timedelta(minutes=20), t + dt.timedelta(hours=1): t + dt.timedelta(minutes=31)}


def test_report_at_half_past_serves_once(spark):
    t = dt.datetime(2026, 1, 1, 9)
    hours = spark.createDataFrame([(1, t), (1, t + dt.timedelta(hours=1))], "station_id long, valid_time timestamp")
    obs = spark.createDataFrame([(1, t + dt.timedelta(minutes=30))], "station_id long, obs_time timestamp")
    assert [(r.valid_time, r.obs_time) for r in verify.match_one_to_one(hours, obs).collect()] == [(t, t + dt.timedelta(minutes=30))]


def test_error_metrics(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", -3.0)], "model string, error double")
    r = verify.error_metrics(rows, "model").first()
    assert (r.n, r.bias, r.mae) == (2, -1.0, 2.0) and abs(r.rmse - math.sqrt(5)) < 1e-12


@pytest.mark.parametrize("values", [[0.1, 0.2, 0.3], [0.3, 0.2, 0.1]])
def test_scorecard_does_not_depend_on_order(spark, values):
    rows = spark.createDataFrame([("a", 1, "0-6", "t", -v) for v in values], "model string, station_id long, lead_bin string, field string, error double").coalesce(1)
    got = verify.scorecard(rows).collect()
    assert len(got) == 3 and {(r.n, r.bias, r.mae) for r in got} == {(3, -0.2, 0.2)} and all(abs(r.rmse - math.sqrt(0.14 / 3)) < 1e-12 for r in got)


def test_scorecard_keeps_errors_without_a_decimal(spark):
    rows = spark.createDataFrame([("a", "t", math.nan), ("a", "t", 1.0), ("b", "t", 1e20), ("b", "t", 3e20)], "model string, field string, error double")
    got = {r.model: r for r in verify.scorecard(rows.selectExpr("*", "1L as station_id", "'0-6' as lead_bin")).where("station_id is null and lead_bin is null").collect()}
    assert got["a"].n == 2 and math.isnan(got["a"].bias) and math.isnan(got["a"].rmse)
    assert (got["b"].n, got["b"].bias, got["b"].mae) == (2, 2e20, 2e20)


def test_collisions_get_suffix(spark):
    c = spark.createDataFrame([(1, "Metsamor", "Armenia", "04", 40.0, 44.0), (2, "Metsamor", "Armenia", "04", 41.0, 44.5), (3, "Erevan", "Armenia", "11", 40.2, 44.5)], "city_id long, name string, country string, state string, latitude double, longitude double")
    paths = {r.city_id: r.path for r in inventory.dedupe_slugs(c).collect()}
    assert paths[3].endswith("/erevan/") and paths[1] != paths[2] and paths[1].endswith("metsamor-40-0000-44-0000/")


def test_nearest_cities(spark):
    c = spark.createDataFrame([(i, 10.0, 20 + 0.05 * i) for i in range(12)], "city_id long, latitude double, longitude double")
    got = inventory.nearest_cities(c).where("city_id = 0").orderBy("rank").collect()
    assert [r.other for r in got] == list(range(1, 9))


def test_modal_class(spark):
    raster = spark.createDataFrame([(r, c, 5 if (r, c) != (0, 0) else 7) for r in range(3) for c in range(3)], "cell_row int, cell_col int, cls int")
    points = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 9, 9)], "city_id long, cell_row int, cell_col int")
    got = {r.city_id: (r.cls, r.reason) for r in inventory.koppen_modal(points, raster).collect()}
    assert got == {1: (5, None), 2: (None, "centerNotModal"), 3: (None, "centerNoData")}


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("v"))
    got = [(r.v, r.n) for r in numbering.global_rank(df, "v", "n").collect()]
    assert [n for _, n in sorted(got)] == list(range(1000))


def test_one_run_of_streams_equals_its_twin(spark):
    from sultry.plans import streams

    got = {(r.key, r.event_id): r.state for r in streams.stream_freshness(spark, "/root/testdata/sf0.001").collect()}
    rows = sorted(((r.ts, r.event_id, r.user_id, r.event_type) for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").collect()))
    stored, want = {}, {}
    for ts, i, k, kind in rows:
        if kind == "purchase":
            stored[k] = ts
        else:
            age = (ts - stored[k]).total_seconds() if k in stored else None
            want[k, i] = "miss" if age is None or age >= 12 * 3600 else "fresh" if age < 3 * 3600 else "stale"
    assert got == want


def test_one_to_one_tells_reports_of_one_time_apart(spark):
    t = dt.datetime(2024, 1, 1, 12)
    half = t + dt.timedelta(minutes=30)
    hours = spark.createDataFrame([(1, t), (1, t + dt.timedelta(hours=1)), (2, t), (2, t + dt.timedelta(hours=1)), (3, t)], "station_id long, valid_time timestamp")
    obs = spark.createDataFrame([(1, half, 5.0), (1, half, 6.0), (2, half, 7.0), (3, t + dt.timedelta(minutes=31), 1.0)], "station_id long, obs_time timestamp, temperature_c double")
    got = sorted((r.station_id, r.valid_time, r.obs_time, r.temperature_c) for r in verify.match_one_to_one(hours, obs).collect())
    assert got == [(1, t, half, 5.0), (1, t + dt.timedelta(hours=1), half, 6.0), (2, t, half, 7.0)]


def test_one_to_one_chains(spark):
    t = dt.datetime(2024, 1, 1)
    at = lambda m: t + dt.timedelta(minutes=m)
    hours = spark.createDataFrame([(1, at(60 * h)) for h in range(4)], "station_id long, valid_time timestamp")
    obs = spark.createDataFrame([(1, at(m), float(m)) for m in (30, 90, 150, 160)], "station_id long, obs_time timestamp, temperature_c double")
    got = sorted((r.valid_time.hour, r.temperature_c) for r in verify.match_one_to_one(hours, obs).collect())
    assert got == [(0, 30.0), (1, 90.0), (2, 150.0), (3, 160.0)]


def test_new_stations_stop_at_the_nth(spark):
    rows = [(1, "gfs", 7), (1, "ifs", 8), (2, "gfs", 7), (2, "ifs", 9), (3, "gfs", 8), (3, "ifs", 5)]
    got = sorted((r.rank, r.model, r.is_new) for r in verify.new_stations(spark.createDataFrame(rows, "rank int, model string, station_id long"), 3).collect())
    assert got == [(1, "gfs", True), (1, "ifs", True), (2, "gfs", False), (2, "ifs", True)]
    assert verify.new_stations(spark.createDataFrame(rows, "rank int, model string, station_id long"), 9).count() == 6


def test_search_takes_any_number_of_queries(spark):
    index = spark.range(300).select(F.col("id").alias("city_id"), F.concat(F.lit("city "), F.col("id").cast("string"), F.lit(", state")).alias("label"))
    log = spark.range(12_000).select(F.col("id").alias("q"), F.concat(F.lit("y "), F.col("id").cast("string")).alias("query"))
    log = log.unionByName(spark.createDataFrame([(-1, ""), (-2, None), (-3, "ci"), (-4, "city 7, state"), (-5, "9"), (-6, "none")], "q long, query string"))
    got = {r.q: r.city_id for r in inventory.search_match(log, index).collect()}
    want = {q: next((i for i in range(300) if f"y {q}" in f"city {i}, state"), None) for q in range(0, 12_000, 97)}
    assert {q: got[q] for q in want} == want and len(got) == 12_006
    assert [got[q] for q in (-1, -2, -3, -4, -5, -6)] == [0, None, 0, 7, 9, None]


def test_region_buckets_are_the_least(spark):
    cities = spark.range(400).select(F.lit("a").alias("country"), F.when(F.col("id") < 5, "s").otherwise("t").alias("state"), F.lit("City").alias("name"), F.col("id").alias("city_id"))
    got = {r.state: (r.n, r.buckets) for r in inventory.region_buckets(cities, most=20, aim=10).collect()}

    def fnv(s):
        h = 2166136261
        for c in s.encode():
            h = ((h ^ c) * 16777619) & 0xFFFFFFFF
        return h

    hashes = [fnv(f"city-{i}") for i in range(5, 400)]
    fits = lambda b: (lambda c: len(c) == b and max(c.values()) <= 20)({k: sum(h % b == k for h in hashes) for k in {h % b for h in hashes}})
    assert got == {"s": (5, 1), "t": (395, next((b for b in range(40, 395) if fits(b)), 395))}


def test_sinks(spark, tmp_path):
    table = f"file://{tmp_path}/history"
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v string, n long, part long")
    for batch in (rows((1, "a", 1, 0), (2, "b", 1, 1)), rows((1, "c", 2, 0), (3, "d", 1, 2)), rows((2, "old", 0, 1))):
        back = sinks.upsert(table, batch, ["k", "part"], "n", "part")
    assert sorted((r.k, r.v) for r in back.collect()) == [(1, "c"), (2, "b"), (3, "d")]
    docs = spark.createDataFrame([("x",), ("x",), ("y",)], "doc string")
    for _ in range(2):
        back = sinks.content_addressed(docs, "doc", f"file://{tmp_path}/objects")
    assert sorted(r.value for r in back.collect()) == ["x", "y"]
    ranked = spark.range(5).select(F.col("id").alias("rank"))
    with pytest.raises(ValueError):
        sinks.snapshot_json(ranked, most=4)
    shards = sinks.redirect_shards(spark.createDataFrame([("/a/", "X"), ("/b/", "Y"), ("/c/", "X")], "alias string, country string"))
    assert sorted((r.alias, r.country) for r in shards.collect()) == [("/a/", "X"), ("/b/", "Y"), ("/c/", "X")]


def test_publish_guard_tries_a_batch_again(spark, tmp_path):
    from sultry.streaming import jobs

    write = jobs.publish_guard(f"file://{tmp_path}/published")
    day = lambda n: dt.datetime(2024, 1, n)
    for number, runs in enumerate([[(1, day(2)), (2, day(1))], [(3, day(2))], [(4, day(5))]]):
        for _ in range(2):
            write(spark.createDataFrame(runs, "id long, init timestamp"), number)
    assert sorted((r.id, r.init) for r in spark.read.parquet(f"file://{tmp_path}/published").collect()) == [(1, day(2)), (4, day(5))]


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from sultry import session

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_invalid_snapshot_is_an_error(spark):
    rows = [(1, 0, 0, 300.0, dt.datetime(2024, 1, 1)), (3, 0, 1, 299.0, dt.datetime(2024, 1, 1))]
    bad = spark.createDataFrame(rows, "rank int, cell_row int, cell_col int, wet_bulb_k double, peak_time timestamp")
    with pytest.raises(Exception, match="snapshot"):
        grid.valid_snapshot(bad).collect()
