"""Hot groups, dense cells and exact ranks; versions that a failed run leaves; readiness of runs; digests; sliding minutes."""

import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from sultry.operators import analytics, inventory, numbering
from sultry.sources import files, sinks


def test_grouped_rank_of_a_hot_group_splits(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.lit("cold")).when(F.col("id") % 997 == 1, F.lit(None)).otherwise(F.lit("hot")).alias("country"), (F.col("id") * 7919 % 20_011).alias("path"))
    ranked = numbering.grouped_rank(df, ["country"], ["path"], "nth", parts=8)
    by = {}
    for r in sorted(ranked.collect(), key=lambda r: r.path):
        by.setdefault(r.country, []).append(r.nth)
    assert all(v == list(range(len(v))) for v in by.values()) and len(by) == 3
    wrote = df.repartitionByRange(8, "country", "path").withColumn("p", F.spark_partition_id()).where("country = 'hot'").groupBy("p").count().collect()
    assert len(wrote) >= 6 and max(r["count"] for r in wrote) < 20_000 / 4
    assert numbering.grouped_rank(df.limit(0), ["country"], ["path"], "nth").count() == 0


@pytest.mark.parametrize("ahead", [False, True])
def test_neighbours_across_partitions(spark, ahead):
    df = spark.range(3000).select(F.when(F.col("id") % 7 == 0, F.lit("a")).when(F.col("id") % 501 == 1, F.lit(None)).otherwise(F.lit("hot")).alias("g"), (F.col("id") * 7919 % 30_011).alias("o"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("v"))
    rows = sorted(((r.g or "", r.o, r.v) for r in df.collect()), reverse=ahead)
    want = {(g, o): (rows[i - 1][2],) if i and rows[i - 1][0] == g else None for i, (g, o, _) in enumerate(rows)}
    got = {(r.g or "", r.o): None if r.near is None else (r.near.v,) for r in numbering.neighbours(df, ["g"], ["o"], ["v"], "near", ahead, parts=8).collect()}
    assert got == want


@pytest.mark.parametrize("least", [4096, 40])
def test_nearest_ranks(spark, least):
    r = random.Random(3)
    rows = [("a", r.lognormvariate(3, 2)) for _ in range(3000)] + [("b", 5.0)] * 2000 + [("b", float(r.randrange(900))) for _ in range(1000)] + [(None, 1.0), (None, 2.0), ("c", None), ("d", 7.5)]
    df = spark.createDataFrame(rows, "status string, ms double")
    got = {(x.status, x.percent): x.ms for x in analytics.nearest_ranks(df, "status", "ms", [1, 50, 95, 100], least=least).collect()}
    want = {}
    for s in ("a", "b", None, "d"):
        v = sorted(x for k, x in rows if k == s)
        want.update({(s, p): v[max(1, math.ceil(len(v) * p / 100)) - 1] for p in (1, 50, 95, 100)})
    assert got == want
    summary = {x.status: (x.n, x.p50, x.p95, x.max_ms) for x in analytics.latency_summary(df, "status", "ms").collect()}
    assert summary["c"] == (1, None, None, None) and summary[None] == (2, 1.0, 2.0, 2.0) and summary["b"][0] == 3000


def plain_nearest(places, n=8):
    def km(a, b):
        (la, lo), (lb, lp) = (tuple(map(math.radians, x)) for x in (a, b))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))

    return {i: [j for _, j in sorted((km(p, q), j) for j, q in places.items() if j != i)[:n]] for i, p in places.items()}


def test_neighbours_in_dense_country(spark):
    r = random.Random(12)
    places = {i: (10 + r.random() * 0.01, 20 + r.random() * 0.01) for i in range(400)}  # one crowded cell
    places |= {1000 + i: (10.0051, 20.0049) for i in range(150)}  # a stack
    places |= {2000 + i: (10 + r.random() * 0.5, 20 + r.random() * 0.5) for i in range(60)} | {3000 + i: (8 + r.random() * 4, 18 + r.random() * 4) for i in range(60)}
    df = spark.createDataFrame([(i, *p) for i, p in places.items()], "city_id long, latitude double, longitude double")
    got = {}
    for x in inventory.nearest_cities(df).orderBy("city_id", "rank").collect():
        got.setdefault(x.city_id, []).append(x.other)
    want = plain_nearest(places)
    assert {i for i in want if got.get(i) != want[i]} == set()


def test_crowded_cells_are_halved(spark):
    r = random.Random(2)
    rows = [(10 + r.random() * 0.02, 20 + r.random() * 0.02) for _ in range(2000)] + [(30.0, 40.0)] * 3 + [(50 + r.random(), 60 + r.random()) for _ in range(100)]
    place = spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], "city_id long, latitude double, longitude double")
    other = place.select(F.col("city_id").alias("other"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    cells = lambda lat, lon, s: [F.floor(F.col(lat) / s).alias("r"), F.floor(F.col(lon) / s).alias("c")]
    seen = 0
    for level, points in inventory._crowded(place, other, cells, 0.5):
        seen += points.count()
        full = points.select(*cells("latitude", "longitude", 0.5 / 2**level)).groupBy("r", "c").count().agg(F.max("count")).first()[0]
        assert full is None or full <= inventory.FULL or level == inventory.DEPTH
    assert seen == 2000


def test_fingerprint_is_of_the_sorted_lines(spark):
    lines = [(k, f"{k}{i * 7919 % 1000}é\n") for k in ("a", "b", None) for i in range(300)]
    got = {r.k: r.fingerprint for r in inventory.fingerprints(spark.createDataFrame(lines, "k string, line string"), "k", "line").collect()}
    assert got == {k: hashlib.sha256("".join(sorted(x for g, x in lines if g == k)).encode()).hexdigest() for k in ("a", "b", None)}


def test_a_failed_sitemap_run_leaves_the_old_index(spark, tmp_path):
    root = f"file://{tmp_path}/maps"
    pages = spark.createDataFrame([("main", "/"), ("x-1", "/a/"), ("x-1", "/b/")], "member string, path string")
    first = {(r.member, r.value) for r in sinks.sitemap_set(pages, "https://e.org", root).collect()}
    assert ("index", "<sitemap><loc>https://e.org/sitemaps/x-1.xml</loc></sitemap>") in first and len(first) == 5
    bad = pages.withColumn("path", F.when(F.col("path") == "/b/", F.raise_error(F.lit("lost")).cast("string")).otherwise("/new/"))
    with pytest.raises(Exception, match="lost"):
        sinks.sitemap_set(bad, "https://e.org", root)
    assert {(r.member, r.value) for r in sinks.read_sitemaps(spark, root).collect()} == first
    second = sinks.sitemap_set(pages.where("member = 'main'"), "https://e.org", root)
    assert sorted(r.member for r in second.collect()) == ["index", "main"]


RUN = dt.datetime(2024, 5, 1, 6)
FIELDS = ["2t", "2d", "sp"]


def index_lines(spark, rows):
    """rows: (run, step of the file, date, hour, step, param, length)."""
    return spark.createDataFrame(
        [(r, s, f'{{"date":"{d}","time":"{h}00","type":"fc","stream":"oper","levtype":"sfc","param":"{p}","step":{k},"_length":{n}}}') for r, s, d, h, k, p, n in rows] + [(RUN, 0, "{bad"), (RUN, 0, "[]")],
        "run timestamp, for_step int, value string",
    )


def test_index_rows_match_their_run_and_step_and_have_bytes(spark):
    good = (RUN, 3, "20240501", "06", 3, "2t", 9)
    rows = [good, (RUN, 3, "20240430", "06", 3, "2d", 9), (RUN, 3, "20240501", "00", 3, "2d", 9), (RUN, 3, "20240501", "06", 6, "2d", 9), (RUN, 3, "20240501", "06", 3, "2d", 0)]
    assert [(r.run, r.step, r.param) for r in files.run_index(index_lines(spark, rows)).collect()] == [(RUN, 3, "2t")]


def test_the_newest_complete_run_wins(spark):
    older, newest = RUN - dt.timedelta(hours=12), RUN + dt.timedelta(hours=6)
    index = [(r, s, p) for r in (older, RUN, newest) for s in (3, 6) for p in FIELDS if (r, s, p) != (newest, 6, "sp")] + [(r, 0, "lsm") for r in (older, RUN, newest)]
    runs = spark.createDataFrame([(r, [3, 6]) for r in (older, RUN, newest)] + [(newest + dt.timedelta(hours=6), [3])], "run timestamp, steps array<int>")
    ready = lambda rows: {r.run: (r.ready, r.wins) for r in analytics.run_readiness(spark.createDataFrame(rows, "run timestamp, step int, param string"), runs, FIELDS, "lsm").collect()}
    got = ready(index)
    assert got[older] == (True, False) and got[RUN] == (True, True) and got[newest] == (False, False) and not any(got[newest + dt.timedelta(hours=6)])
    assert ready([x for x in index if x != (RUN, 0, "lsm")])[older] == (True, True)
