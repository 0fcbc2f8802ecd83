"""Joins that stop on drift, and reports on made cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sultry import registry
from sultry.operators import analytics, forecast, grid, inventory
from sultry.sources import files

ROUTES = [("a", 1.0, 2.0), ("b", 3.0, 4.0), ("c", 5.0, 6.0), ("d", 7.0, 8.0)]
IDS = [("a", 10, "UTC"), ("b", 11, "UTC"), ("c", 11, "UTC"), ("d", None, None)]
SOURCE = [(10, 1.001, 2.0, 500, None, 40, "UTC"), (11, 3.0, 4.0, 0, 7, 8, "UTC"), (99, 0.0, 0.0, -5, None, None, "Mars")]


def facts(spark, routes=ROUTES, ids=IDS, source=SOURCE):
    return inventory.location_facts(
        spark.createDataFrame(routes, "path string, latitude double, longitude double"),
        spark.createDataFrame(ids, "path string, geonameid long, time_zone string"),
        spark.createDataFrame(source, "geonameid long, latitude double, longitude double, population long, elevation int, dem int, time_zone string"),
    )


def test_location_facts(spark):
    got = {r.path: (r.geonameid, r.population, r.elevation, r.elevation_source, r.time_zone, r.state) for r in facts(spark).collect()}
    none = (None,) * 5
    assert got == {"a": (10, 500, 40, "dem", "UTC", "matched"), "b": (*none, "ambiguous"), "c": (*none, "ambiguous"), "d": (*none, "unmatched")}
    sea = facts(spark, source=[(10, 1.0, 2.0, 0, None, -9999, "UTC"), SOURCE[1]])
    assert sea.where("path = 'a'").select("population", "elevation", "elevation_source").first() == (None, None, None)


@pytest.mark.parametrize(("change", "message"), [
    ({"routes": ROUTES[:3]}, "same paths"), ({"ids": IDS[:3]}, "same paths"), ({"ids": [*IDS, IDS[0]]}, "same paths"), ({"source": SOURCE[1:]}, "source lacks"), ({"source": [*SOURCE, SOURCE[0]]}, "id twice"),
    ({"source": [(10, 1.001, 2.0, 500, None, 40, "CET"), *SOURCE[1:]]}, "time zone"), ({"source": [(10, 1.03, 2.0, 500, None, 40, "UTC"), *SOURCE[1:]]}, "too far"),
    ({"source": [(10, 1.0, 2.0, -1, None, 40, "UTC"), *SOURCE[1:]]}, "negative"), ({"source": [(10, 1.0, 2.0, 1, 9001, 40, "UTC"), *SOURCE[1:]]}, "out of range"),
])
def test_location_facts_stop_on_drift(spark, change, message):
    with pytest.raises(Exception, match=message):
        facts(spark, **change).collect()


def test_climate_cells(spark):
    points = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, None, 1)], "city_id long, cell_row int, cell_col int")
    values = spark.createDataFrame([(1, 1, 200), (1, 2, None)], "cell_row int, cell_col int, tenths int")
    got = {r.city_id: (r.tenths, r.reason) for r in inventory.climate_cells(points, values).collect()}
    assert got == {1: (200, None), 2: (None, "fillOrInvalidValue"), 3: (None, "cellEdgeTie")}
    with pytest.raises(Exception, match="lack a cell"):
        inventory.climate_cells(points, values.where("cell_col = 1")).collect()
    with pytest.raises(Exception, match="twice"):
        inventory.climate_cells(points, values.union(values)).collect()


@pytest.mark.parametrize(("path", "message"), [("x", "not matched"), ("u", "not matched"), ("n", "no elevation"), ("p", "no climate cell"), ("v", "no climate values")])
def test_reviewed_paths_must_be_whole(spark, path, message):
    known = spark.createDataFrame([("a", 5, "UTC", "matched"), ("u", None, None, "unmatched"), ("n", None, "UTC", "matched"), ("p", 5, "UTC", "matched"), ("v", 5, "UTC", "matched")], "path string, elevation int, time_zone string, state string")
    climate = spark.createDataFrame([("a", 100), ("u", 100), ("n", 100), ("v", None)], "path string, tenths int")
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert [tuple(r) for r in inventory.reviewed_enrichment(paths("a"), known, climate).collect()] == [("a", 5, "UTC", 100)]
    with pytest.raises(Exception, match=message):
        inventory.reviewed_enrichment(paths("a", path), known, climate).collect()


def test_download_timing_stops_where_a_run_has_none(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    products = spark.createDataFrame([(1, at(0)), (2, at(6))], "id long, init timestamp")
    timing = spark.createDataFrame([(at(0), at(5), at(6)), (at(6), at(11), at(12))], "init timestamp, first_ready timestamp, retrieved timestamp")
    assert {(r.id, r.first_ready) for r in analytics.download_timing(products, timing).collect()} == {(1, at(5)), (2, at(11))}
    for broken, message in ((timing.limit(1), "no download timing"), (timing.union(timing), "two download timings")):
        with pytest.raises(Exception, match=message):
            analytics.download_timing(products, broken).collect()


def test_cohorts_and_controls(spark):
    ids = lambda *r: spark.createDataFrame([(i,) for i in range(*r)], "city_id long")
    assert analytics.cohort_union(ids(5), ids(5, 10), "city_id", 10).count() == 10
    for tier, controls, message in ((ids(5), ids(4, 9), "share a city"), (ids(5), ids(5, 9), "are not 10 cities")):
        with pytest.raises(Exception, match=message):
            analytics.cohort_union(tier, controls, "city_id", 10).collect()
    both = forecast.with_controls(ids(100), ids(20), "city_id", "x", 7, 27).collect()
    assert len(both) == 27 and all((r.city_id >= 20) == r.is_control for r in both)
    with pytest.raises(Exception, match="more than 26 places"):
        forecast.with_controls(ids(100), ids(20), "city_id", "x", 7, 26).collect()


def test_requested_records_are_there_once(spark):
    lines = lambda *v: spark.createDataFrame([("f", i, x) for i, x in enumerate(v)], "file string, line int, value string")
    rows = ["1:0:d=1:TMP:surface:anl:", "2:90:d=1:LAND:surface:anl:", "no record", "3:x:d=1:TMP:surface:anl:", "4:150:d=1:TMP:2 m:anl:", "5:200:d=1:END:surface:anl:"]
    got = [(r.field, r.start, r.end) for r in files.byte_ranges(lines(*rows), [("LAND", "surface"), ("TMP", "surface")]).orderBy("start").collect()]
    assert got == [("TMP", 0, 89), ("LAND", 90, 149)]
    for asked, given in ((("END", "surface"), rows), (("TMP", "surface"), [*rows[:2], *rows])):
        with pytest.raises(Exception, match="exactly one"):
            files.byte_ranges(lines(*given), [asked]).collect()


def test_climate_documents_are_as_agreed(spark):
    months = ",".join(f'"{m}": {i}' for i, m in enumerate(files.MONTHS))
    doc = '{"header": {"time_standard": "LST", "fill_value": -999, "range": "r", "sources": ["POWER", "MERRA2"], "api": {"version": "v"}}, "parameters": {"T2MWET": {"units": "C"}}, "properties": {"parameter": {"T2MWET": {%s}}}}' % months
    read = lambda text, *agreed: [r.months for r in files.power_climatology(spark.createDataFrame([(1, text)], "cell int, value string"), *agreed).collect()]
    assert read(doc, "v", "r") == [[float(i) for i in range(12)]] and read(doc.replace('"JAN": 0', '"JAN": -999'), "v", "r") == [None]
    for old, new in (('"v"', '"w"'), ('"r"', '"s"'), ('"POWER", ', ""), ('"C"', '"K"'), ("LST", "UTC")):
        with pytest.raises(Exception, match="climate document changed"):
            read(doc.replace(old, new), "v", "r")


def test_models_are_compared(spark):
    cells = lambda *c: spark.createDataFrame([(i + 1, *x, 300.0 - i) for i, x in enumerate(c)], "rank int, lat double, lon double, wet_bulb_k double")
    a, b = cells((1.0, 190.0), (2.0, 2.0), (3.0, 3.0)), cells((2.0, 2.0), (1.0, -170.0), (9.0, 9.0))
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    r = grid.model_comparison(a, b, paths("x", "y", "y"), paths("y", "z", "w"), tops=(1, 2)).first()
    assert (r.top1_overlap, r.top2_overlap, r.lat_a, r.lat_b, r.candidates_a, r.candidates_b, r.candidates_both, r.only_a, r.only_b) == (0, 2, 1.0, 2.0, 2, 3, 1, 1, 2)
    with pytest.raises(Exception, match="no ranked cells"):
        grid.model_comparison(a, b.limit(0), paths("x"), paths("y")).collect()


def test_alert_quality(spark):
    rows = spark.createDataFrame([
        (1, "(not set)", "/a", 9, 9), (1, "x", "/b", 5, 1), (1, "x", None, 2, 2), (2, "b", "/a", 5, 5), (2, "a", "(not set)", 5, 1)
    ], "day int, source string, page string, sessions long, users long")
    got = {r.day: tuple(r)[1:] for r in analytics.alert_quality(rows, "day", "source", "page").collect()}
    assert got == {1: ("unknown", True, True, 2), 2: ("a", False, False, 5)}


def test_product_events_and_weeks(spark):
    names = ["location_search_success"] * 3 + ["location_search_no_match"] + ["forecast_load_failure"] + ["other"] * 5
    r = analytics.product_events(spark.createDataFrame([(n,) for n in names], "event string"), []).first()
    assert (r.location_search_success, r.search_no_match_rate, r.forecast_load_failure_rate, r.weather_load_failure_rate, r.map_view) == (3, 0.25, 1.0, None, 0)
    day = lambda n: dt.date(2024, 1, n)
    rows = spark.createDataFrame([(day(1), 10, 0), (day(8), 15, 3), (day(9), 5, 0)], "day date, sessions long, views long")
    got = {r.metric: (r.this_week, r.week_before, r.change) for r in analytics.week_over_week(rows, "day", ("2024-01-08", "2024-01-14"), ("2024-01-01", "2024-01-07"), ["sessions", "views"]).collect()}
    assert got == {"sessions": (20, 10, 100.0), "views": (3, 0, None)}


@pytest.mark.parametrize(("latest", "seen", "status"), [(8, [("ok", "PASS")], "ok"), (7, [("ok", "PASS")], "degraded"), (10, [("ok", "FAIL")], "degraded"), (10, [("ok", "PASS"), ("error", None)], "degraded"), (10, [], "ok"), (None, [("ok", "PASS")], "degraded")])
def test_search_health(spark, latest, seen, status):
    days = spark.createDataFrame([(dt.date(2024, 1, latest),)] if latest else [], "day date")
    out = analytics.search_health(days, spark.createDataFrame(seen, "outcome string, verdict string"), F.lit("2024-01-10").cast("date"))
    assert out.first().status == status


def test_tier_manifest(spark):
    rows = [(i, "1A" if i <= 50 else "1B" if i <= 100 else "1C", f"/wetbulb-temperature/a/b/c{i}/", i <= 40) for i in range(1, 201)]
    told = lambda r: {x.rule: x.violations for x in inventory.tier_violations(spark.createDataFrame(r, "rank int, tier string, path string, popular boolean"), "^/wetbulb-temperature/[a-z0-9-]+/[a-z0-9-]+/[a-z0-9-]+/$").collect() if x.violations}
    assert told(rows) == {}
    assert told(rows[:-1]) == {"rows": 1, "tier 1C": 1} and told([(1, "1B", "/x", False), *rows[1:]]) == {"tier 1A": 1, "tier 1B": 1, "tier of rank": 1, "popular": 1, "paths": 1}


def events(spark, path, rows):
    """A folder with a table of events (event_id, day of January, event_type)."""
    rows = [(i, dt.datetime(2024, 1, day), 1, kind, 1.0) for i, day, kind in rows]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_attribution_tells_what_dominates(spark, tmp_path):
    d = events(spark, tmp_path, [(1, 1, "click"), (2, 1, "view"), (3, 2, "click"), (5, 2, "view")])
    got = {r.day.day: (r.attribution, r.not_set_dominates) for r in registry.queries()["derive_attribution"](spark, d).collect()}
    assert got == {1: ("view", False), 2: ("unknown", True)}


def test_agents_of_events_without_a_type_are_kept(spark, tmp_path):
    d = events(spark, tmp_path, [(i, 1, None if i % 2 else "click") for i in range(12)] + [(16, 1, None)])
    assert sorted(r.event_id for r in registry.queries()["filter_bots"](spark, d).collect()) == [1, 2, 4, 5, 7, 8, 10, 11, 16]
