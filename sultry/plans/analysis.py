"""Queries on analytics, search history, operations data, and batch twins of streams; with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import analytics as an
from ..operators.forecast import hash_sample
from ..session import materialize
from ..sources import files, sinks
from ..streaming import jobs
from . import fixtures as fx
from .columns import CLASSIFY, GA_PATH
from .define import Registry
from .streams import alerts_sql, arriving, replay
from .weather import TOP_HOURLY, pipe_global_grid_top50

R = Registry()
G = f"WITH {fx.GA}, prod AS (SELECT * FROM ga WHERE coalesce(host_name, 'www.example.org') = 'www.example.org')"
PAGES = f"pg AS (SELECT {GA_PATH} AS path, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(users) AS BIGINT) AS users, CAST(sum(engaged) AS BIGINT) AS engaged FROM prod WHERE landing_page <> '(not set)' GROUP BY 1)"
TODAY = "2024-01-20"


def _ga(spark, d):
    return fx.ga_rows(spark, d)


def _events(spark, d):
    return fx.table(spark, d, "events")


def _date(s):
    return F.lit(s).cast("date")


def _ts(s):
    return F.lit(s).cast("timestamp")


@R.add("filter_production_host", G + " SELECT host_name, count(*) AS n FROM prod GROUP BY 1")
def filter_production_host(spark, d):
    return an.production_rows(_ga(spark, d)).groupBy("host_name").agg(F.count("*").alias("n"))


@R.add("agg_page_rollup", G + f", {PAGES} SELECT path, sessions, users, engaged, {CLASSIFY.format('path')} AS page_type FROM pg")
def agg_page_rollup(spark, d):
    return an.page_rollup(_ga(spark, d))


@R.add("agg_repeat_heavy", G + f", {PAGES} SELECT path, sessions, users FROM pg WHERE users > 0 AND sessions / users >= 2.3")
def agg_repeat_heavy(spark, d):
    """With a low bound, as the projected pages are alike."""
    return an.repeat_heavy(an.page_rollup(_ga(spark, d)), 2.3).select("path", "sessions", "users")


@R.add("agg_dimension_rollup", G + " SELECT coalesce(channel, '(not set)') AS name, CAST(sum(sessions) AS BIGINT) AS sessions FROM prod GROUP BY 1")
def agg_dimension_rollup(spark, d):
    return an.dimension_rollup(_ga(spark, d), "channel")


def _product(spark, d):
    """Each event as one of the eleven product events, and some of none."""
    names = F.array(*[F.lit(e) for e in an.PRODUCT_EVENTS], F.lit("page_view"))
    return _events(spark, d).select(F.to_date("ts").alias("day"), names[F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(12)).cast("int")].alias("event"))


_NAMES = f"[{', '.join(repr(e) for e in (*an.PRODUCT_EVENTS, 'page_view'))}]"
PRODUCT = f"pe AS (SELECT CAST(ts AS DATE) AS day, ({_NAMES})[CAST((event_id * 7 + user_id) % 12 AS INT) + 1] AS event FROM events)"
_COUNTS = ", ".join(f"count(*) FILTER (event = '{e}') AS {e}" for e in an.PRODUCT_EVENTS)
_RATES = ", ".join(f"round({bad} / nullif({good} + {bad}, 0), 6) AS {name}_rate" for name, (good, bad) in an.RATES.items())


@R.add("agg_product_events", f"WITH {PRODUCT}, n AS (SELECT day, {_COUNTS} FROM pe GROUP BY 1) SELECT *, {_RATES} FROM n")
def agg_product_events(spark, d):
    out = an.product_events(_product(spark, d), ["day"])
    return out.withColumns({f"{name}_rate": F.round(f"{name}_rate", 6) for name in an.RATES})


METRICS = ["sessions", "users", "views", "engaged"]
WEEKS = ("2024-01-15", "2024-01-21"), ("2024-01-08", "2024-01-14")
_week = lambda m, k: f"coalesce(sum({m}) FILTER (day BETWEEN DATE '{WEEKS[k][0]}' AND DATE '{WEEKS[k][1]}'), 0)"
WEEK = G + ", v AS (SELECT *, 2 * sessions + engaged AS views FROM prod), w AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({_week(m, 0)} AS BIGINT) AS this_week, CAST({_week(m, 1)} AS BIGINT) AS week_before FROM v" for m in METRICS) + ") "


@R.add("agg_week_over_week", WEEK + "SELECT *, round(100.0 * (this_week - week_before) / nullif(week_before, 0), 4) AS change FROM w")
def agg_week_over_week(spark, d):
    rows = an.production_rows(_ga(spark, d)).withColumn("views", 2 * F.col("sessions") + F.col("engaged"))
    return an.week_over_week(rows, "day", *WEEKS, METRICS).withColumn("change", F.round("change", 4))


_EVENT_ROWS = " UNION ALL ".join(f"SELECT 'events', '{e}', 'count', count(*) FILTER (event = '{e}') FROM pe WHERE day BETWEEN DATE '2024-01-15' AND DATE '2024-01-21'" for e in an.PRODUCT_EVENTS)
_RATE_ROWS = " UNION ALL ".join(f"SELECT 'rates', '{name}', 'share', round(count(*) FILTER (event = '{bad}') / nullif(count(*) FILTER (event IN ('{good}', '{bad}')), 0), 6) FROM pe WHERE day BETWEEN DATE '2024-01-15' AND DATE '2024-01-21'" for name, (good, bad) in an.RATES.items())


@R.add("pipe_weekly_report", WEEK.rstrip() + f""", {PRODUCT}, wk AS (SELECT * FROM prod WHERE day BETWEEN DATE '2024-01-15' AND DATE '2024-01-21'), wp AS (SELECT {GA_PATH} AS path, sum(sessions) AS sessions, sum(users) AS users FROM wk WHERE landing_page <> '(not set)' GROUP BY 1)
SELECT 'pages' AS section, {CLASSIFY.format('path')} AS name, 'sessions' AS metric, CAST(sum(sessions) AS DOUBLE) AS value FROM wp GROUP BY 2 UNION ALL SELECT 'pages', {CLASSIFY.format('path')}, 'users', sum(users) FROM wp GROUP BY 2
UNION ALL SELECT 'channels', coalesce(channel, '(not set)'), 'sessions', sum(sessions) FROM wk GROUP BY 2 UNION ALL {_EVENT_ROWS} UNION ALL {_RATE_ROWS}
UNION ALL SELECT 'totals', metric, 'this_week', this_week FROM w UNION ALL SELECT 'totals', metric, 'week_before', week_before FROM w UNION ALL SELECT 'totals', metric, 'change', round(100.0 * (this_week - week_before) / nullif(week_before, 0), 4) FROM w""")
def pipe_weekly_report(spark, d):
    """A week's pages, channels, product events with their rates, and headline totals against the week before, as rows (section, name, metric, value)."""
    inside = F.col("day").between(*[_date(x) for x in WEEKS[0]])
    week = _ga(spark, d).where(inside)
    long = lambda df, section, name, *metrics: df.select(F.lit(section).alias("section"), F.col(name).alias("name"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("section", "name", "m.metric", "m.value")
    wide = lambda df, section, metric, names: df.select(F.inline(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(n.removesuffix("_rate")).alias("name"), F.lit(metric).alias("metric"), F.round(F.col(n).cast("double"), 6).alias("value")) for n in names])))
    pages = an.page_rollup(week).groupBy("page_type").agg(F.sum("sessions").alias("sessions"), F.sum("users").alias("users"))
    products = an.product_events(_product(spark, d).where(inside), [])
    return (
        long(pages, "pages", "page_type", "sessions", "users")
        .unionByName(long(an.dimension_rollup(week, "channel"), "channels", "name", "sessions"))
        .unionByName(wide(products, "events", "count", an.PRODUCT_EVENTS))
        .unionByName(wide(products, "rates", "share", [f"{name}_rate" for name in an.RATES]))
        .unionByName(long(agg_week_over_week(spark, d), "totals", "metric", "this_week", "week_before", "change"))
    )


def _win(n, a, b, m):
    return f"CAST(coalesce(sum({m}) FILTER (DATE '2000-06-30' - snapshot_at BETWEEN {a} AND {b}), 0) AS BIGINT) AS {n}_{m}"


@R.add("agg_search_windows", f"WITH {fx.GSC} SELECT " + ", ".join(_win(n, a, b, m) for m in ("clicks", "impressions") for n, a, b in (("last7", 0, 6), ("prior7", 7, 13), ("last28", 0, 27), ("prior28", 28, 55))) + " FROM gsc")
def agg_search_windows(spark, d):
    return an.windows_ending(fx.gsc_snapshots(spark, d), "snapshot_at", _date("2000-06-30"), ["clicks", "impressions"])


@R.add("agg_complete_through", "SELECT event_id, CASE WHEN date_diff('day', CAST(ts AS DATE) - CAST(event_id % 20 AS INT) - 1, CAST(ts AS DATE)) BETWEEN 1 AND 10 THEN CAST(ts AS DATE) - CAST(event_id % 20 AS INT) - 1 ELSE CAST(ts AS DATE) - 3 END AS through FROM events")
def agg_complete_through(spark, d):
    today = F.to_date("ts")
    return _events(spark, d).select("event_id", an.complete_through(today, F.date_sub(today, (F.col("event_id") % 20).cast("int"))).alias("through"))


DAYS = "dy AS (SELECT CAST(ts AS DATE) AS day, count(*) * 10 AS sessions FROM events GROUP BY 1)"


def _days(spark, d):
    return _events(spark, d).groupBy(F.to_date("ts").alias("day")).agg((F.count("*") * 10).alias("sessions"))


@R.add("agg_daily_sessions", G + " SELECT day, CAST(sum(sessions) AS BIGINT) AS sessions FROM prod GROUP BY 1")
def agg_daily_sessions(spark, d):
    return an.production_rows(_ga(spark, d)).groupBy("day").agg(F.sum("sessions").alias("sessions"))


@R.add("agg_headline_totals", G + " SELECT CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(users) AS BIGINT) AS users, CAST(sum(engaged) AS BIGINT) AS engaged, count(*) AS n_rows FROM prod")
def agg_headline_totals(spark, d):
    return an.production_rows(_ga(spark, d)).agg(*[F.sum(c).alias(c) for c in ("sessions", "users", "engaged")], F.count("*").alias("n_rows"))


@R.add("agg_daily_sessions_filled", f"WITH {DAYS} SELECT CAST(s AS DATE) AS day, coalesce(sessions, 0) AS sessions FROM generate_series(DATE '2024-01-25', DATE '2024-02-07', INTERVAL 1 DAY) g(s) LEFT JOIN dy ON dy.day = CAST(s AS DATE)")
def agg_daily_sessions_filled(spark, d):
    return an.filled_days(_days(spark, d), "day", "sessions", _date("2024-01-25"), _date("2024-02-07"))


SPIKE = f"""{DAYS}, sp AS (SELECT CAST(s AS DATE) AS day, coalesce(sessions, 0) * CASE WHEN day(CAST(s AS DATE)) IN (14, 29) THEN 3 ELSE 1 END AS sessions FROM generate_series(DATE '2023-12-31', DATE '2024-01-30', INTERVAL 1 DAY) g(s) LEFT JOIN dy ON dy.day = CAST(s AS DATE)),
past AS (SELECT day, sessions, list(sessions) OVER (ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS p FROM sp), md AS (SELECT *, list_median(p) AS median, list_median([abs(x - list_median(p)) FOR x IN p]) AS mad FROM past WHERE len(p) = 28)
SELECT day, sessions, median, mad FROM md WHERE sessions >= 100 AND sessions - median >= 100 AND (sessions >= 2 * median OR sessions > median + 4 * mad)""".replace("list_median(p)", "list_aggregate(p, 'median')").replace("list_median([", "list_aggregate([").replace("FOR x IN p])", "FOR x IN p], 'median')")


def _spiky(spark, d):
    days = an.filled_days(_days(spark, d), "day", "sessions", _date("2023-12-31"), _date("2024-01-30"))
    return days.withColumn("sessions", F.col("sessions") * F.when(F.dayofmonth("day").isin(14, 29), 3).otherwise(1))


@R.add("win_spike_baseline", f"WITH {SPIKE}")
def win_spike_baseline(spark, d):
    return an.spike_days(_spiky(spark, d))


@R.add("pipe_spike_alerts", f"WITH RECURSIVE spk AS ({'WITH ' + SPIKE}), dd AS (SELECT day, 1 AS seq, CAST(floor(sessions * CASE WHEN day(day) % 2 = 0 THEN 0.7::DOUBLE ELSE 0.95::DOUBLE END) AS BIGINT) AS sessions, CASE WHEN day(day) % 3 = 0 THEN 'unknown' ELSE 'search' END AS attribution FROM spk UNION ALL SELECT day, 2, CAST(sessions AS BIGINT), 'search' FROM spk), " + alerts_sql("dd"))
def pipe_spike_alerts(spark, d):
    """Spiking days, seen twice: with part of their sessions, some without a known source, and whole; alerts once a day, and again where that changed enough."""
    days = an.spike_days(_spiky(spark, d)).select("day", F.col("sessions").cast("long").alias("sessions"))
    n = F.dayofmonth("day")
    part = F.floor(F.col("sessions") * F.when(n % 2 == 0, 0.7).otherwise(0.95)).cast("long")
    seen = days.select("day", F.lit(1).cast("long").alias("seq"), part.alias("sessions"), F.when(n % 3 == 0, "unknown").otherwise("search").alias("attribution"))
    seen = seen.unionByName(days.select("day", F.lit(2).cast("long").alias("seq"), "sessions", F.lit("search").alias("attribution")))
    return replay(jobs.spike_alerts(arriving(materialize(seen, "spikes"), F.col("seq"), "spikes", cuts=[1])))


_SOURCES = G + ", src AS (SELECT * REPLACE (CASE WHEN sessions = 6 THEN '(not set)' ELSE channel END AS channel) FROM prod), s AS (SELECT day, channel, sum(sessions) AS v FROM src GROUP BY 1, 2), b AS (SELECT day, channel, row_number() OVER (PARTITION BY day ORDER BY v DESC, channel) AS rn FROM s)"


def _sources(spark, d):
    return an.production_rows(_ga(spark, d)).withColumn("channel", F.when(F.col("sessions") == 6, "(not set)").otherwise(F.col("channel")))


@R.add("flag_alert_quality", _SOURCES + f""", pd AS (SELECT day, {GA_PATH} AS path, sum(sessions) AS sessions, sum(users) AS users FROM src WHERE landing_page <> '(not set)' GROUP BY 1, 2), hv AS (SELECT DISTINCT day FROM pd WHERE users > 0 AND sessions / users >= 2.6),
lost AS (SELECT day, CAST(coalesce(sum(sessions) FILTER (landing_page = '(not set)'), 0) AS BIGINT) AS n FROM src GROUP BY 1)
SELECT day, CASE WHEN channel = '(not set)' THEN 'unknown' ELSE channel END AS attribution, channel = '(not set)' AS not_set_dominates, day IN (SELECT day FROM hv) AS repeat_heavy, n AS not_set_landing_sessions FROM b JOIN lost USING (day) WHERE rn = 1""")
def flag_alert_quality(spark, d):
    return an.alert_quality(_sources(spark, d), "day", "channel", "landing_page", 2.6)


@R.add("derive_attribution", _SOURCES + " SELECT day, CASE WHEN channel = '(not set)' THEN 'unknown' ELSE channel END AS attribution, channel = '(not set)' AS not_set_dominates FROM b WHERE rn = 1")
def derive_attribution(spark, d):
    return an.attribution(_sources(spark, d), "day", "channel", "sessions")


@R.add("agg_latency_summary", "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max_ms FROM events GROUP BY 1")
def agg_latency_summary(spark, d):
    return an.latency_summary(_events(spark, d), "event_type", "value")


#: Eight runs six hours apart. Run 3 has no index for step 5, run 7 no mask, run 1 has step 4 in another stream and run 5 step 2 of the day before.
INDEX = """idx AS (SELECT DISTINCT l_suppkey % 8 AS k, CAST(l_linenumber AS INT) AS step, CASE l_partkey % 3 WHEN 0 THEN '2t' WHEN 1 THEN '2d' ELSE 'sp' END AS param FROM lineitem WHERE l_suppkey % 8 <> 3 OR l_linenumber <> 5
UNION SELECT DISTINCT l_suppkey % 8, 0, 'lsm' FROM lineitem WHERE l_suppkey % 8 <> 7),
listed AS (SELECT TIMESTAMP '2024-01-01' + to_hours(CAST(6 * k AS BIGINT)) AS run, k, step, param FROM idx WHERE NOT (k = 1 AND step = 4) AND NOT (k = 5 AND step = 2))"""


def _index(spark, d):
    """Index lines of the runs as they lie in files (run, for_step, value), some of them broken, of another stream or of another day."""
    k, p = F.col("k"), F.col("l_partkey") % 3
    li = fx.table(spark, d, "lineitem").withColumn("k", F.col("l_suppkey") % 8)
    rows = li.where("k <> 3 or l_linenumber <> 5").select("k", F.col("l_linenumber").cast("int").alias("step"), F.when(p == 0, "2t").when(p == 1, "2d").otherwise("sp").alias("param"))
    rows = rows.union(li.where("k <> 7").select("k", F.lit(0), F.lit("lsm"))).distinct().withColumn("run", _run_time(k))
    day = F.when((k == 5) & (F.col("step") == 2), F.timestamp_add("DAY", F.lit(-1), F.col("run"))).otherwise(F.col("run"))
    stream = F.when((k == 1) & (F.col("step") == 4), "enfo").otherwise("oper")
    line = F.to_json(F.struct(F.date_format(day, "yyyyMMdd").alias("date"), F.date_format("run", "HH00").alias("time"), F.lit("fc").alias("type"), stream.alias("stream"), F.lit("sfc").alias("levtype"), "param", "step", (F.col("step") + 100).alias("_length")))
    lines = rows.select("run", F.col("step").alias("for_step"), line.alias("value"))
    broken = fx.table(spark, d, "nation").select(_run_time(F.lit(0)).alias("run"), F.lit(0).alias("for_step"), F.concat(F.lit("{bad "), "n_name").alias("value"))
    return lines.union(broken)


def _run_time(k):
    return F.timestamp_add("HOUR", (6 * k).cast("int"), _ts("2024-01-01"))


@R.add("src_run_index", f"WITH {INDEX} SELECT CAST(run AS TIMESTAMP) AS run, step, param, CAST(100 + step AS BIGINT) AS length FROM listed")
def src_run_index(spark, d):
    return files.run_index(_index(spark, d)).select("run", "step", "param", "length")


@R.add("agg_run_ready", f"""WITH {INDEX}, runs AS (SELECT k, TIMESTAMP '2024-01-01' + to_hours(6 * k) AS run FROM range(8) t(k)),
needs AS (SELECT run, s.step, p.param FROM runs, LATERAL (SELECT unnest(range(1 + k % 2, 8)) AS step) s, (VALUES ('2t'), ('2d'), ('sp')) p(param) UNION SELECT run, 0, 'lsm' FROM runs),
c AS (SELECT needs.run, count(*) AS needed, count(listed.run) AS listed FROM needs LEFT JOIN listed USING (run, step, param) GROUP BY 1)
SELECT CAST(run AS TIMESTAMP) AS run, needed, listed, needed = listed AS ready, run IS NOT DISTINCT FROM (SELECT max(run) FROM c WHERE needed = listed) AS wins FROM c""")
def agg_run_ready(spark, d):
    """Every other run needs its steps from 2 on, the rest from 1; all need the mask."""
    runs = spark.range(8).select(_run_time(F.col("id")).alias("run"), F.sequence((1 + F.col("id") % 2).cast("int"), F.lit(7)).alias("steps"))
    return an.run_readiness(src_run_index(spark, d), runs, ["2t", "2d", "sp"], "lsm")


@R.add("src_byte_ranges", """WITH r AS (SELECT concat('f', CAST(o_custkey % 20 AS VARCHAR)) AS file, o_orderkey AS line, o_orderkey * 1000 AS start FROM orders), e AS (SELECT *, lead(start) OVER (PARTITION BY file ORDER BY line) - 1 AS "end" FROM r) SELECT file, line, start, 'TMP' AS field, 'surface' AS level, "end" FROM e WHERE "end" IS NOT NULL""")
def src_byte_ranges(spark, d):
    k = F.col("o_orderkey")
    lines = fx.table(spark, d, "orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 20).cast("string")).alias("file"), k.alias("line"), F.concat_ws(":", k.cast("string"), (k * 1000).cast("string"), F.lit("d=2024"), F.lit("TMP"), F.lit("surface"), F.lit("anl"), F.lit("")).alias("value"))
    return files.byte_ranges(lines)


@R.add("src_power_climatology", "SELECT c_custkey AS cell, CAST(m + 1 AS INT) AS month, CASE WHEN c_custkey % 9 <> 0 THEN CAST((c_custkey + m) % 40 AS DOUBLE) END AS value FROM customer, range(12) t(m)")
def src_power_climatology(spark, d):
    """Climate documents, some with a fill value, whose months are then all unknown."""
    k = F.col("c_custkey")
    months = F.struct(*[F.when((k % 9 == 0) & F.lit(i == 3), -999.0).otherwise((k + i) % 40 * 1.0).alias(m) for i, m in enumerate(files.MONTHS)])
    header = F.struct(F.lit("LST").alias("time_standard"), F.lit(-999.0).alias("fill_value"), F.lit("1991-2020").alias("range"), F.array(F.lit("POWER"), F.lit("MERRA2")).alias("sources"), F.struct(F.lit("v2").alias("version")).alias("api"))
    unit = F.struct(F.struct(F.lit("C").alias("units")).alias("T2MWET"))
    doc = F.to_json(F.struct(header.alias("header"), unit.alias("parameters"), F.struct(F.struct(months.alias("T2MWET")).alias("parameter")).alias("properties")))
    rows = files.power_climatology(fx.table(spark, d, "customer").select(k.alias("cell"), doc.alias("value")), "v2", "1991-2020")
    return rows.select("cell", "months", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")).select("cell", "month", F.get("months", F.col("month") - 1).alias("value"))


@R.add("src_gsc_exports", f"WITH {fx.GSC} SELECT id, clicks, round(clicks * 100.0 / nullif(impressions, 0), 2) AS ctr FROM gsc WHERE impressions > 0")
def src_gsc_exports(spark, d):
    """A table with percent strings written as CSV and read back."""
    rows = fx.gsc_snapshots(spark, d).where("impressions > 0")
    shown = F.concat(F.round(F.col("clicks") * F.lit(100.0) / F.col("impressions"), 2).cast("string"), F.lit("%"))
    path = fx.folder(spark, "gsc")
    rows.select("id", F.col("clicks").alias("Clicks"), shown.alias("CTR")).write.csv(path, header=True)
    return files.gsc_export(spark, path).select(F.col("id").cast("long").alias("id"), F.col("Clicks").cast("long").alias("clicks"), F.col("CTR").alias("ctr"))


@R.add("src_ga_export", f"WITH {DAYS} SELECT strftime(day, '%Y%m%d') AS date, sessions FROM dy")
def src_ga_export(spark, d):
    """A report, one file with a preamble, a header and a grand total, written and read back. A report has a row for each day."""
    days = _days(spark, d)
    line = lambda n, text: F.struct(F.lit(n).alias("n"), text.alias("value"))
    body = days.select(line(2, F.concat_ws(",", F.date_format("day", "yyyyMMdd"), F.col("sessions").cast("string"))).alias("l"))
    total = days.agg(line(3, F.concat(F.lit("Grand total,"), F.sum("sessions").cast("string"))).alias("l"))
    head = spark.range(2).select(line(0, F.when(F.col("id") == 0, "# exported").otherwise("Date,Sessions")).alias("l")).select(F.struct(F.when(F.col("l.value").startswith("#"), 0).otherwise(1).alias("n"), F.col("l.value")).alias("l"))
    path = fx.folder(spark, "ga")
    head.union(body).union(total).select("l.*").orderBy("n", "value").coalesce(1).select("value").write.text(path)
    return files.ga_export(spark, path).select(F.col("Date").alias("date"), F.col("Sessions").cast("long").alias("sessions"))


@R.add("src_event_log", "SELECT event_type AS event, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id % 13 <> 0 GROUP BY 1")
def src_event_log(spark, d):
    inner = F.when(F.col("event_id") % 13 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("key"), "ts")))
    lines = _events(spark, d).select(F.to_json(F.struct(F.array(F.struct(F.array(inner).alias("message"))).alias("logs"))).alias("value"))
    return files.envelopes(lines).groupBy("event").agg(F.count("*").alias("n"))


@R.add("extract_snapshot_meta", f"""WITH k AS (SELECT o_orderkey, o_orderkey % 6 AS k FROM orders), m AS (SELECT o_orderkey, CASE WHEN k IN (0, 1, 2, 5) THEN TIMESTAMP '2024-01-01 06:00:00' END AS initialization,
 CASE WHEN k IN (0, 1, 5) THEN TIMESTAMP '2024-01-02 00:00:00' WHEN k = 2 THEN TIMESTAMP '2024-01-03 00:00:00' END AS valid_from, CASE WHEN k IN (0, 1, 2, 3) THEN TIMESTAMP '2024-01-03 00:00:00' END AS valid_to, CASE WHEN k = 0 THEN 50 WHEN k = 1 THEN 2 END AS published FROM k)
SELECT o_orderkey, initialization, valid_from, valid_to, CAST(published AS INT) AS published, CASE WHEN valid_from IS NULL OR valid_to IS NULL OR valid_from >= valid_to THEN 'invalid' ELSE 'published' END AS availability FROM m""")
def extract_snapshot_meta(spark, d):
    """Documents of two formats; one with a list in place of its count, one reversed, one without a start, one unreadable, one whose end is no time."""
    a, b, c = "2024-01-01T06:00:00Z", "2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z"
    docs = [
        f'{{"discovery": {{"initialization": "{a}"}}, "validFrom": "{b}", "validTo": "{c}", "counts": {{"published": 50}}}}',
        f'{{"model": {{"initialization": "{a}", "validTimeBounds": {{"start": "{b}", "end": "{c}"}}}}, "hotspots": [{{}}, {{}}]}}',
        f'{{"model": {{"initialization": "{a}"}}, "validFrom": "{c}", "validTo": "{c}"}}', f'{{"validTo": "{c}"}}', "{", f'{{"model": {{"initialization": "{a}"}}, "validFrom": "{b}", "validTo": "soon", "counts": {{"published": -1}}}}',
    ]
    doc = F.array(*[F.lit(x) for x in docs])[(F.col("o_orderkey") % 6).cast("int")]
    return files.snapshot_meta(fx.table(spark, d, "orders").select("o_orderkey", doc.alias("doc")), "doc")


@R.add("classify_search_health", f"""WITH {fx.GSC}, site AS (SELECT url, string_split(url, '/')[3]::BIGINT % 9 AS site, snapshot_at, id FROM gsc), i AS (SELECT site, count(*) FILTER (id % 97 <> 0) AS inspected, count(*) FILTER (id % 97 = 0) AS failed, bool_or(id % 89 = 0) AS refused FROM site WHERE id % 13 = 0 AND site = 4 GROUP BY 1)
SELECT CASE WHEN DATE '1998-08-05' - (SELECT max(snapshot_at) FROM site WHERE site = 4) > 2 OR failed > 0 OR refused THEN 'degraded' ELSE 'ok' END AS status, (SELECT max(snapshot_at) FROM site WHERE site = 4) AS latest, inspected, failed FROM i""")
def classify_search_health(spark, d):
    """One site's search data, and inspections of some of its pages."""
    rows = fx.gsc_snapshots(spark, d).where(F.split("url", "/")[2].cast("long") % 9 == 4)
    inspections = rows.where("id % 13 = 0").select(F.when(F.col("id") % 97 == 0, "error").otherwise("ok").alias("outcome"), F.when(F.col("id") % 89 == 0, "FAIL").otherwise("PASS").alias("verdict"))
    return an.search_health(rows.select(F.col("snapshot_at").alias("day")), inspections, _date("1998-08-05"))


@R.add("sink_upsert_history", f"WITH {fx.GSC} SELECT snapshot_at, url, id, clicks FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_at, url ORDER BY id DESC) AS rn FROM gsc) WHERE rn = 1")
def sink_upsert_history(spark, d):
    """Two batches put into a table by snapshot and url, the later row of a key staying."""
    rows = fx.gsc_snapshots(spark, d).select("snapshot_at", "url", "id", "clicks", F.year("snapshot_at").alias("year"))
    table = fx.folder(spark, "history")
    for batch in (rows.where("id % 3 <> 0"), rows.where("id % 3 = 0")):
        back = sinks.upsert(table, batch, ["snapshot_at", "url", "year"], "id", "year")
    return back.select("snapshot_at", "url", "id", "clicks")


@R.add("sink_history_csv", f"WITH {fx.GSC} SELECT CAST(snapshot_at AS VARCHAR) AS snapshot_at, url, CAST(clicks AS VARCHAR) AS clicks FROM gsc")
def sink_history_csv(spark, d):
    """Ordered history written as CSV and read back."""
    return sinks.history_csv(fx.gsc_snapshots(spark, d).select("snapshot_at", "url", "clicks"))


@R.add("sink_content_addressed", "SELECT DISTINCT sha256(concat(CAST(o_custkey AS VARCHAR), ':', o_orderstatus)) AS name, concat(CAST(o_custkey AS VARCHAR), ':', o_orderstatus) AS value FROM orders")
def sink_content_addressed(spark, d):
    """Objects written once under their digests, in two batches that share some, and read back."""
    docs = fx.table(spark, d, "orders").select("o_orderkey", F.concat_ws(":", F.col("o_custkey").cast("string"), "o_orderstatus").alias("doc"))
    path = fx.folder(spark, "objects")
    for batch in (docs.where("o_orderkey % 2 = 0"), docs):
        back = sinks.content_addressed(batch, "doc", path)
    return back.select("name", "value")


@R.add("sink_snapshot_json", TOP_HOURLY)
def sink_snapshot_json(spark, d):
    """One document of the ranked cells, written, read back and taken apart."""
    top = pipe_global_grid_top50(spark, d)
    doc = sinks.snapshot_json(top)
    row = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in top.schema.fields)
    rows = doc.select(F.explode(F.from_json("value", f"count long, rows array<struct<rank:int,r:struct<{row}>>>")["rows"]).alias("x"))
    return rows.select("x.r.*")


@R.add("set_cohort_union", f"WITH {fx.CITIES}, top AS (SELECT city_id FROM cities ORDER BY population DESC, city_id LIMIT 200), k AS (SELECT city_id FROM (SELECT city_id, sha256(concat('gsc', chr(0), CAST(city_id AS VARCHAR))) AS o FROM cities WHERE city_id NOT IN (SELECT city_id FROM top)) ORDER BY o LIMIT 200) SELECT city_id, 'tier' AS cohort FROM top UNION ALL SELECT city_id, 'control' FROM k")
def set_cohort_union(spark, d):
    """The 200 ranked cities and as many controls; fewer cities than 400 leave as many controls as there are."""
    c = fx.cities(spark, d)
    top = c.orderBy(F.desc("population"), "city_id").limit(200).select("city_id")
    return an.cohort_union(top, hash_sample(c, top, "city_id", "gsc", 200), "city_id", min(400, c.count()))


@R.add("join_cohort_metrics", f"WITH {fx.CITIES}, {fx.GSC}, m AS (SELECT url, CAST(sum(clicks) AS BIGINT) AS clicks FROM gsc GROUP BY 1) SELECT city_id, clicks FROM (SELECT city_id, concat('/c/', CAST(city_id AS VARCHAR), '/') AS url FROM cities WHERE population >= 100000) LEFT JOIN m USING (url)")
def join_cohort_metrics(spark, d):
    """Metrics by url; missing ones are unknown, not zero."""
    cohort = fx.cities(spark, d).where("population >= 100000").select("city_id", F.concat(F.lit("/c/"), F.col("city_id").cast("string"), F.lit("/")).alias("url"))
    return cohort.join(fx.gsc_snapshots(spark, d).groupBy("url").agg(F.sum("clicks").alias("clicks")), "url", "left").select("city_id", "clicks")


@R.add("set_non_production_hosts", f"WITH {fx.GA} SELECT DISTINCT host_name FROM ga WHERE host_name <> 'www.example.org'")
def set_non_production_hosts(spark, d):
    return _ga(spark, d).where(F.col("host_name") != an.PRODUCTION).select("host_name").distinct()


CRAWL = "a AS (SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages), b AS (SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN upper(title) ELSE title END AS title FROM a WHERE page_id % 6 <> 0)"


@R.add("join_crawl_parity", f"WITH {CRAWL} SELECT coalesce(a.page_id, b.page_id) AS page_id, b.page_id IS NULL AS missing, a.title IS DISTINCT FROM b.title AS title_differs FROM a FULL JOIN b ON a.page_id = b.page_id AND a.url = b.url WHERE b.page_id IS NULL OR a.title IS DISTINCT FROM b.title")
def join_crawl_parity(spark, d):
    a = fx.table(spark, d, "pages").select("page_id", "url", text.page_title(F.col("html")).alias("title"))
    b = a.where("page_id % 6 <> 0").select("page_id", "url", F.when(F.col("page_id") % 4 == 0, F.upper("title")).otherwise(F.col("title")).alias("title_b"), F.lit(True).alias("there"))
    both = a.join(b, ["page_id", "url"], "full_outer")
    differs = ~F.col("title").eqNullSafe(F.col("title_b"))
    return both.where(F.col("there").isNull() | differs).select("page_id", F.col("there").isNull().alias("missing"), differs.alias("title_differs"))


_PAIR = "SELECT c_custkey AS id, TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 7 * 6 AS INT)) AS init, TIMESTAMP '2024-01-02' + to_hours(CAST(c_custkey % 5 AS INT)) AS a, TIMESTAMP '2024-01-03' AS b FROM customer"


def products(spark, d, shift=0):
    """Snapshots of a product: id, init, a (start), b (end)."""
    k = F.col("c_custkey") + shift
    hour = lambda t, h: F.timestamp_add("HOUR", h.cast("int"), _ts(t))
    return fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), hour("2024-01-01 00:00:00", k % 7 * 6).alias("init"), hour("2024-01-02 00:00:00", k % 5).alias("a"), _ts("2024-01-03 00:00:00").alias("b"))


_PAIR2 = _PAIR.replace("c_custkey % 7", "(c_custkey + (c_custkey % 3)) % 7").replace("c_custkey % 5", "(c_custkey + c_custkey % 3) % 5")


def _second(spark, d):
    return products(spark, d, F.col("c_custkey") % 3)


@R.add("join_snapshot_pair", f"WITH x AS ({_PAIR}), y AS ({_PAIR2}) SELECT id FROM x JOIN y USING (id, init) WHERE (x.a <= y.a AND x.b >= y.b) OR (y.a <= x.a AND y.b >= x.b)")
def join_snapshot_pair(spark, d):
    """Products of one run of which one window contains the other."""
    x, y = products(spark, d), _second(spark, d).select("id", "init", F.col("a").alias("a2"), F.col("b").alias("b2"))
    inside = ((F.col("a") <= F.col("a2")) & (F.col("b") >= F.col("b2"))) | ((F.col("a2") <= F.col("a")) & (F.col("b2") >= F.col("b")))
    return x.join(y, ["id", "init"]).where(inside).select("id")


@R.add("join_public_private_run", f"WITH x AS ({_PAIR}), y AS ({_PAIR2}) SELECT id, x.init IS NOT DISTINCT FROM y.init AND x.a IS NOT DISTINCT FROM y.a AS same FROM x JOIN y USING (id)")
def join_public_private_run(spark, d):
    y = _second(spark, d).select("id", F.col("init").alias("i2"), F.col("a").alias("a2"))
    return products(spark, d).join(y, "id").select("id", (F.col("init").eqNullSafe(F.col("i2")) & F.col("a").eqNullSafe(F.col("a2"))).alias("same"))


@R.add("join_download_timing", f"WITH x AS ({_PAIR}) SELECT id, init + INTERVAL 5 HOUR AS first_ready, init + INTERVAL 6 HOUR AS retrieved FROM x")
def join_download_timing(spark, d):
    x = products(spark, d)
    later = lambda h: F.timestamp_add("HOUR", F.lit(h), F.col("init"))
    timing = x.select("init").distinct().select("init", later(5).alias("first_ready"), later(6).alias("retrieved"))
    return an.download_timing(x, timing).select("id", "first_ready", "retrieved")


NOWS = "TIMESTAMP '2024-01-02 12:00:00'"


@R.add("stream_snapshot_state", f"WITH x AS ({_PAIR}), s AS (SELECT id, CASE WHEN a >= b THEN 'invalid' WHEN {NOWS} >= b THEN 'expired' WHEN init > a OR init > {NOWS} THEN 'invalid' WHEN epoch({NOWS}) - epoch(init) > 18 * 3600 THEN 'behind' WHEN {NOWS} < a THEN 'upcoming' ELSE 'in_window' END AS state FROM x) SELECT id % 10 AS product, max(CASE state WHEN 'invalid' THEN 3 WHEN 'expired' THEN 3 WHEN 'behind' THEN 2 ELSE 0 END) AS worst, count(*) AS n FROM s GROUP BY 1".replace("max(CASE", "CASE max(CASE").replace("ELSE 0 END) AS worst", "ELSE 0 END) WHEN 3 THEN 'down' WHEN 2 THEN 'degraded' ELSE 'ok' END AS worst"))
def stream_snapshot_state(spark, d):
    now = _ts("2024-01-02 12:00:00")
    s = products(spark, d).select("id", an.snapshot_state(now, F.col("init"), F.col("a"), F.col("b")).alias("state"))
    return s.groupBy((F.col("id") % 10).alias("product")).agg(an.worst_state(F.col("state")).alias("worst"), F.count("*").alias("n"))


@R.add("batch_publish_guard", f"WITH x AS ({_PAIR}), y AS ({_PAIR2}) SELECT id, CASE WHEN y.b <= {NOWS} THEN 'candidate-expired' WHEN y.init < x.init THEN 'older-run' WHEN y.init > x.init THEN 'newer-run' WHEN {NOWS} >= x.b AND y.a >= x.b THEN 'same-run-after-expiry' ELSE 'same-run-current' END AS decision FROM x JOIN y USING (id)")
def batch_publish_guard(spark, d):
    """Batch twin of the publish guard."""
    y = _second(spark, d).toDF("id", "i2", "a2", "b2")
    decision = an.publish_decision(_ts("2024-01-02 12:00:00"), F.col("i2"), F.col("a2"), F.col("b2"), F.col("init"), F.col("b"))
    return products(spark, d).join(y, "id").select("id", decision.alias("decision"))


@R.add("batch_daily_budget", "WITH n AS (SELECT event_type AS provider, CAST(ts AS DATE) AS day, count(*) AS used FROM events GROUP BY 1, 2) SELECT provider, day, used, used > 70 AS over FROM n")
def batch_daily_budget(spark, d):
    """Batch twin: attempts of a UTC day and whether they exceed the limit."""
    n = _events(spark, d).groupBy(F.col("event_type").alias("provider"), F.to_date("ts").alias("day")).agg(F.count("*").alias("used"))
    return n.withColumn("over", F.col("used") > 70)


@R.add("stream_budget_status", "WITH n AS (SELECT event_type AS provider, CAST(ts AS DATE) AS day, count(*) AS used FROM events GROUP BY 1, 2) SELECT provider, day, CASE WHEN used / 80.0 >= 1 THEN 'down' WHEN used / 80.0 >= 0.9 THEN 'degraded' ELSE 'ok' END AS status FROM n")
def stream_budget_status(spark, d):
    return batch_daily_budget(spark, d).select("provider", "day", an.budget_state(F.col("used"), F.lit(80)).alias("status"))


@R.add("batch_minute_rate", "SELECT a.event_id, count(*) AS in_minute FROM events a JOIN events b ON b.ts <= a.ts AND b.ts > a.ts - INTERVAL 1 MINUTE GROUP BY 1")
def batch_minute_rate(spark, d):
    """Batch twin: attempts in the minute up to each one. Times are counted once, each meets its own and the next minute, and a sliding frame adds up."""
    e = _events(spark, d).select("event_id", F.unix_micros("ts").alias("us"))
    n = e.groupBy("us").agg(F.count("*").alias("n")).withColumn("m", F.floor(F.col("us") / 60_000_000))
    both = n.withColumn("own", F.lit(True)).unionByName(n.withColumn("m", F.col("m") + 1).withColumn("own", F.lit(False)))
    upto = Window.partitionBy("m").orderBy("us").rangeBetween(-59_999_999, 0)
    return e.join(both.withColumn("in_minute", F.sum("n").over(upto)).where("own"), "us").select("event_id", "in_minute")


PANELS = "pn AS (SELECT event_id, user_id % 12 AS panel, ts AS seen, event_type AS outcome, CASE WHEN event_type = 'error' THEN 'down' WHEN value > 15 THEN 'degraded' ELSE 'ok' END AS status FROM events)"


def panels(spark, d):
    status = F.when(F.col("event_type") == "error", "down").when(F.col("value") > 15, "degraded").otherwise("ok")
    return _events(spark, d).select("event_id", (F.col("user_id") % 12).alias("panel"), F.col("ts").alias("at"), F.col("event_type").alias("outcome"), status.alias("status"))


@R.add("win_status_change", f"WITH {PANELS}, l AS (SELECT *, lag(status) OVER w AS before, row_number() OVER w AS rn FROM pn WINDOW w AS (PARTITION BY panel ORDER BY event_id)) SELECT event_id, panel, status, before FROM l WHERE rn = 1 OR status IS DISTINCT FROM before")
def win_status_change(spark, d):
    return an.status_changes(panels(spark, d), "panel", "event_id", ["status"]).select("event_id", "panel", "status", "before")


@R.add("win_latest_cycles", f"WITH {PANELS} SELECT panel, max(event_id) AS latest, max(event_id) FILTER (outcome = 'error') AS latest_failed FROM pn GROUP BY 1")
def win_latest_cycles(spark, d):
    return panels(spark, d).groupBy("panel").agg(F.max("event_id").alias("latest"), F.max(F.when(F.col("outcome") == "error", F.col("event_id"))).alias("latest_failed"))


@R.add("batch_panel_state", f"WITH {PANELS}, g AS (SELECT panel, max(seen) FILTER (outcome <> 'error') AS collected, max(seen) AS attempted, arg_max(status, seen) FILTER (outcome <> 'error') AS status, arg_max(outcome, seen) = 'error' AS failed FROM pn GROUP BY 1) SELECT panel, CASE WHEN epoch(TIMESTAMP '2024-01-31') - epoch(collected) > 7200 OR (failed AND attempted > collected) THEN 'stale' ELSE status END AS state FROM g".replace("epoch(collected)", "floor(epoch(collected))"))
def batch_panel_state(spark, d):
    """Batch twin: the last good result of each panel, stale by age or a failed attempt since."""
    good = F.col("outcome") != "error"
    g = panels(spark, d).groupBy("panel").agg(F.max(F.when(good, F.col("at"))).alias("collected"), F.max("at").alias("attempted"), F.max_by(F.when(good, F.col("status")), F.when(good, F.col("at"))).alias("status"), (F.max_by("outcome", "at") == "error").alias("failed"))
    return g.select("panel", an.panel_state(F.col("status"), F.col("collected"), F.col("attempted"), F.col("failed"), _ts("2024-01-31 00:00:00"), 7200).alias("state"))


@R.add("stream_confirmed_failure", "WITH c AS (SELECT event_id, user_id, [event_type] AS cats, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT event_id, coalesce(cats[1] = before, false) AS confirmed FROM c")
def stream_confirmed_failure(spark, d):
    checks = _events(spark, d).select("event_id", "user_id", F.array("event_type").alias("categories"))
    return an.confirmed_failures(checks, "user_id", "event_id", "categories").select("event_id", "confirmed")

