"""Cases that larger tables bring: equal values after rounding, rows that are combined before a shuffle."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sultry import registry
from sultry.functions import geo
from sultry.operators import forecast, inventory
from sultry.plans import fixtures, forecasts
from sultry.session import materialize
from sultry.streaming import jobs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_peak_of_equal_rounded_temperatures(spark, tmp_path):
    """10 + 149.99 % 25 is a little more than 10 + 24.99; both are 34.99 when rounded, and then the first station counts."""
    at = dt.datetime(2024, 1, 2, 3, 4, 5, 678901)
    rows = [(1, at, 2, "click", 149.99), (2, at, 1, "click", 24.99), (4, at - dt.timedelta(microseconds=1), 1, "click", 24.99), (5, at, 0, "click", 24.98)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    r = registry.queries()["agg_observed_peak"](spark, str(tmp_path)).first()
    assert (r.station_id, r.obs_time, r.temperature_c) == (1, at - dt.timedelta(microseconds=1), 34.99)


def test_days_are_combined_before_the_shuffle(spark):
    """Hours go through one shuffle, as one row for each day of a task; days with 24 different times count, whole hours or not."""
    r = random.Random(5)
    rows = []
    for city in range(60):
        step, off, at = r.choice([1, 1, 1, 0.5, 2]), r.choice([0, 3600, -19800, 64800, 90000 * 40, None]), dt.datetime(2024, 1, 2) - dt.timedelta(hours=r.choice([0, 5.5, 24, 0.25]))
        for i in range(80):
            time = at + dt.timedelta(hours=i * step) + dt.timedelta(minutes=r.choice([0] * 200 + [20]))
            rows += [(city, time, off if r.random() < 0.99 else 0, None if r.random() < 0.005 else round(r.random(), 1))] * r.choice([1] * 50 + [2])
    hours = spark.createDataFrame(rows, "city_id long, valid_time timestamp, offset_s int, wet_bulb_c double")
    hours = hours.withColumns({"temperature_c": F.lit(1.0), "dew_point_c": F.lit(1.0)}).repartition(3)
    days = {}
    for c, t, o, w in rows:
        days.setdefault((c, None if o is None else (t + dt.timedelta(seconds=o)).date()), []).append((w, t))
    want = {}
    for k, seen in days.items():
        seen = [x for x in seen if x[0] is not None]
        if len({t for _, t in seen}) == 24:
            best = max(w for w, _ in seen)
            want[k] = (best, min(t for w, t in seen if w == best))
    out = forecast.daily_complete_maximum(hours)
    assert plan(out).count("Exchange hashpartitioning") == 1
    assert {(x.city_id, x.local_day): (x.wet_bulb_c, x.peak_time) for x in out.collect()} == want and len(want) > 30


def test_reports_meet_forecasts_by_station_and_hour(spark):
    """The join's keys hold the hour, so that a stream's row does not look through all of a station's; pairs up to exactly half an hour apart, once each."""
    r = random.Random(8)
    at = lambda: dt.datetime(1970, 1, 1) + r.choice([dt.timedelta(minutes=30 * r.randrange(-9, 9)), dt.timedelta(seconds=r.randrange(-16000, 16000)), dt.timedelta(minutes=30, microseconds=r.choice([-1, 1]))])
    f, o = ([(r.choice([1, 1, 2, None]), at(), float(i)) for i in range(150)] for _ in range(2))
    out = jobs.observe_forecasts(spark.createDataFrame(f, "station_id long, valid_time timestamp, forecast double"), spark.createDataFrame(o, "station_id long, obs_time timestamp, observed double"))
    keys = re.search(r"Join \[([^\]]*)\], \[([^\]]*)\]", plan(out))
    assert all(k.count(",") == 1 for k in keys.groups()), keys
    want = sorted((s, a, v, b, w) for s, a, v in f for z, b, w in o if s is not None and s == z and abs(a - b) <= dt.timedelta(minutes=30))
    assert sorted(map(tuple, out.collect())) == want and len(want) > 500
    assert out.columns == ["station_id", "valid_time", "forecast", "obs_time", "observed"]


@pytest.mark.parametrize(("held", "work"), [(10**6, 10**9), (10**6, 1500), (50, 10**9)])
def test_buckets_of_regions(spark, monkeypatch, held, work):
    """Regions by tasks that hold them, in one and in more rounds, and by counting; the numbers asked grow from round to round."""
    monkeypatch.setattr(inventory, "WORK", work)
    k = F.col("id")
    cities = spark.range(400).select(k.alias("city_id"), F.concat(F.lit("City "), (k % 7).cast("string")).alias("name"), F.when(k % 50 != 0, F.lit("x")).alias("country"), F.when(k < 300, "a").when(k < 370, "b").otherwise("c").alias("state"))

    def fnv(name):
        h = 2166136261
        for c in name:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        return h

    by = {}
    for r in cities.collect():
        by.setdefault((r.country, r.state), []).append(fnv(f"{r['name'].lower().replace(' ', '-')}-{r.city_id}"))
    most, aim = 9, 3
    want = {}
    for key, hs in by.items():
        n = len(hs)
        fits = lambda b, hs=hs: len(c := Counter(h % b for h in hs)) == b and max(c.values()) <= most  # noqa: E731, B023
        want[key] = (n, 1 if n <= most else n if key[0] is None else next((b for b in range(-(-n // aim), n) if fits(b)), n))
    asked = []
    monkeypatch.setattr(inventory, "materialize", lambda df, name, f=materialize: asked.append(name) or f(df, name))
    got = {(r.country, r.state): (r.n, r.buckets) for r in inventory.region_buckets(cities, most, aim, 64, held).collect()}
    monkeypatch.setattr(inventory, "materialize", materialize)
    assert got == want and any(1 < b < n for n, b in want.values()) and any(b == n > most for n, b in want.values())
    if held > 100:
        assert asked.count("regions") <= 5


SMALL = "/root/testdata/sf0.001"


def test_inhabited_places_have_no_limit(spark, monkeypatch):
    monkeypatch.setattr(forecasts, "PLACES", 5)
    assert registry.queries()["pipe_inhabited_top50"](spark, SMALL).first().n_candidates > 5


def test_only_ranked_locations_have_days(spark, monkeypatch):
    seen, daily = [], forecast.daily_complete_maximum
    monkeypatch.setattr(forecast, "daily_complete_maximum", lambda hours: seen.append(hours) or daily(hours))
    assert registry.queries()["join_pinned_daily"](spark, SMALL).count() == 50
    assert seen[0].select("city_id").distinct().count() == 50 < fixtures.table(spark, SMALL, "customer").count()


def test_runs_are_made_of_combined_days(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(forecasts, "materialize", lambda df, name: plans.update({name: plan(df)}) or materialize(df, name))
    assert registry.queries()["join_merge_runs"](spark, SMALL).count() > 0
    assert plans["daily"].count("ENSURE_REQUIREMENTS") == 1 and "REPARTITION_BY_NUM" in plans["daily"]


def test_first_days_are_of_combined_days(spark):
    out = registry.queries()["forecast_is_current"](spark, SMALL)
    assert plan(out).count("ENSURE_REQUIREMENTS") == 2 and "REPARTITION_BY_NUM" in plan(out)
    assert out.count() == fixtures.table(spark, SMALL, "customer").count()


def test_hubs_of_stacked_cities(spark):
    """Cities of one point look for hubs once, and a point brings only as many hubs as can count; equal to all pairs."""
    r = random.Random(2)
    at = [(r.choice([-0.0, 0.0, 59.5, 61.2]), r.choice([179.9, -179.8, 10.0, 10.5])) for _ in range(9)]
    cities = [(i, *r.choice(at), r.choice([100, 20000, 30000, 30000])) for i in range(220)]
    near = [(i, j) for i in range(0, 220, 2) for j in {r.randrange(220) for _ in range(3)}]
    c = spark.createDataFrame(cities, "city_id long, latitude double, longitude double, population long")
    out = inventory.hubs_nearby(c, spark.createDataFrame(near, "city_id long, other long"), n=3)
    assert "HashAggregate(keys=[latitude" in plan(out)
    pairs = c.alias("a").crossJoin(c.alias("b")).where("a.city_id <> b.city_id and b.population >= 20000")
    pairs = pairs.select(F.col("a.city_id"), F.col("b.city_id").alias("other"), F.col("b.population"), geo.haversine_km(*[F.col(x) for x in ("a.latitude", "a.longitude", "b.latitude", "b.longitude")]).alias("km"))
    by, known = {}, set(near)
    for x in pairs.where("km <= 150").collect():
        if (x.city_id, x.other) not in known:
            by.setdefault(x.city_id, []).append((-x.population, x.km, x.other))
    want = {(i, k): (o, -p, km) for i, seen in by.items() for k, (p, km, o) in enumerate(sorted(seen)[:3], 1)}
    assert {(x.city_id, x["rank"]): (x.other, x.population, x.km) for x in out.collect()} == want and len(want) > 400
