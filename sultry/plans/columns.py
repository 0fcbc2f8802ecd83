"""Queries on scalar column jobs: geography, time, text, hashes; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text, times
from ..operators import analytics as an
from . import fixtures as fx
from .define import Registry

R = Registry()
C = f"WITH {fx.CITIES} "
E = "events"


def _c(spark, d):
    return fx.cities(spark, d)


def pmod_sql(x: str, n: str) -> str:
    return f"(({x}) - {n} * floor(({x}) / {n}))"


def haversine_sql(a: str, b: str, c: str, e: str, r: float = geo.EARTH_KM) -> str:
    return f"({2 * r}::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({e}) - ({b})) / 2), 2)))))"


@R.add("haversine_km", C + f"SELECT city_id, round({haversine_sql('latitude', 'longitude', '10.0::DOUBLE', '20.0::DOUBLE')}, 3) AS km, round({haversine_sql('latitude', 'longitude', '10.0::DOUBLE', '20.0::DOUBLE', 6371.0)}, 3) AS km_6371 FROM cities")
def haversine_km(spark, d):
    lat, lon = F.col("latitude"), F.col("longitude")
    km = lambda r: F.round(geo.haversine_km(lat, lon, F.lit(10.0), F.lit(20.0), r), 3)
    return _c(spark, d).select("city_id", km(geo.EARTH_KM).alias("km"), km(6371.0).alias("km_6371"))


@R.add("normalize_lon", C + f"SELECT city_id, round({pmod_sql('longitude * 3 + 180', '360.0')} - 180, 4) AS lon FROM cities")
def normalize_lon(spark, d):
    return _c(spark, d).select("city_id", F.round(geo.normalize_lon(F.col("longitude") * 3), 4).alias("lon"))


@R.add("wrapped_lon_distance", C + f"SELECT city_id, round(abs({pmod_sql('longitude - 170 + 540', '360.0')} - 180), 4) AS distance FROM cities")
def wrapped_lon_distance(spark, d):
    return _c(spark, d).select("city_id", F.round(geo.wrapped_lon_distance(F.col("longitude"), F.lit(170.0)), 4).alias("distance"))


@R.add("geo_cell_key", C + "SELECT city_id, CAST(floor(latitude / 0.5) AS INT) AS cell_row, CAST((CAST(floor(longitude / 0.5) AS INT) % 720 + 720) % 720 AS INT) AS cell_col FROM cities")
def geo_cell_key(spark, d):
    return _c(spark, d).select("city_id", geo.geo_cell(F.col("latitude"), 0.5).alias("cell_row"), geo.wrap_cell(geo.geo_cell(F.col("longitude"), 0.5), 0.5).alias("cell_col"))


MERRA = """merra AS (SELECT city_id, CASE WHEN (y % 500) <> 250 AND (x % 625) * 2 <> 625 THEN CAST((y + 250) // 500 AS INT) END AS cell_row, CASE WHEN (y % 500) <> 250 AND (x % 625) * 2 <> 625 THEN CAST(((2 * x + 625) // 1250) % 576 AS INT) END AS cell_col
 FROM (SELECT city_id, CAST(round((latitude + 90) * 1000) AS BIGINT) AS y, CAST(round((longitude + 180) * 1000) AS BIGINT) AS x FROM cities))"""


def merra(spark, d):
    cell = geo.merra2_cell(F.col("latitude"), F.col("longitude"))
    return _c(spark, d).withColumn("cell", cell).select("*", F.col("cell.row").alias("cell_row"), F.col("cell.col").alias("cell_col")).drop("cell")


@R.add("merra2_cell", C.rstrip() + f", {MERRA} SELECT * FROM merra")
def merra2_cell(spark, d):
    return merra(spark, d).select("city_id", "cell_row", "cell_col")


def _suffix_sql(v: str, s: str) -> str:
    return f"regexp_replace(replace(printf('%.4f', {v}), '-', '{s}'), '\\.', '-')"


SUFFIX = f"concat({_suffix_sql('latitude', 's')}, '-', {_suffix_sql('longitude', 'w')})"


@R.add("coordinate_suffix", C + f"SELECT city_id, {SUFFIX} AS suffix FROM cities")
def coordinate_suffix(spark, d):
    return _c(spark, d).select("city_id", geo.coordinate_suffix(F.col("latitude"), F.col("longitude")).alias("suffix"))


@R.add("cell_id", C + "SELECT city_id, concat(replace(printf('%.4f', latitude), '-0.0000', '0.0000'), ':', replace(printf('%.4f', longitude), '-0.0000', '0.0000')) AS cell FROM cities")
def cell_id(spark, d):
    return _c(spark, d).select("city_id", geo.cell_id(F.col("latitude"), F.col("longitude")).alias("cell"))


@R.add("format_coordinates", C + "SELECT city_id, concat(printf('%.4f', abs(latitude)), '°', CASE WHEN latitude >= 0 THEN 'N' ELSE 'S' END, ', ', printf('%.4f', abs(longitude)), '°', CASE WHEN longitude >= 0 THEN 'E' ELSE 'W' END) AS coordinates FROM cities")
def format_coordinates(spark, d):
    return _c(spark, d).select("city_id", geo.format_coordinates(F.col("latitude"), F.col("longitude")).alias("coordinates"))


SLUG = "regexp_replace(regexp_replace(trim(regexp_replace(lower({}), '[^a-z0-9\\s-]', '', 'g')), '[\\s-]+', '-', 'g'), '^-+|-+$', '', 'g')"


@R.add("slugify", C + f"SELECT city_id, {SLUG.format('replace(name, chr(32), chr(39))')} AS plain, {SLUG.format('name')} AS city, {SLUG.format('country')} AS country FROM cities")
def slugify(spark, d):
    return _c(spark, d).select("city_id", text.slugify(F.translate("name", " ", "'")).alias("plain"), text.slugify(F.col("name")).alias("city"), text.slugify(F.col("country")).alias("country"))


# The first of two runs of two Latin tokens each, around non-Latin ones, is the name.
@R.add("slug_latin_portion", C + f"SELECT city_id, {SLUG.format('name')} AS slug FROM cities")
def slug_latin_portion(spark, d):
    """The longest Latin run of names that mix scripts, as slugs."""
    mixed = F.concat(F.col("name"), F.lit(" (東京 "), F.col("country"), F.lit(" North) Москва"))
    return _c(spark, d).select("city_id", text.slugify(text.latin_portion(mixed)).alias("slug"))


PATH = f"concat('/wetbulb-temperature/', {SLUG.format('country')}, '/', {SLUG.format('state')}, '/', {SLUG.format('name')}, '/')"


def with_path(df):
    return df.withColumn("path", text.route_path(text.slugify(F.col("country")), text.slugify(F.col("state")), text.slugify(F.col("name"))))


@R.add("route_path", C + f"SELECT city_id, {PATH} AS path FROM cities")
def route_path(spark, d):
    return with_path(_c(spark, d)).select("city_id", "path")


_RAW = [*text.COUNTRIES, "the Gambia", "Republic of Nowhere", "Here (There)", "Sun and Moon"]
_RAWS = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _RAW) + "]"
_CLEANED = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^(?i)the ', ''), ' of$', ''), ',.*$', ''), ' \\(.*\\)$', ''), '^.*\\s+of\\s+', ''), '^.*\\s+and\\s+', ''))"


@R.add("normalize_country", "SELECT c_custkey AS city_id, CASE raw " + " ".join("WHEN '{}' THEN '{}'".format(a.replace("'", "''"), b) for a, b in text.COUNTRIES.items()) + f" ELSE {_CLEANED} END AS country FROM (SELECT c_custkey, {_RAWS}[c_custkey % {len(_RAW)} + 1] AS raw FROM customer)")
def normalize_country(spark, d):
    """Source names, with and without a fixed rename."""
    k = F.col("c_custkey")
    raw = F.element_at(F.array(*[F.lit(x) for x in _RAW]), (k % len(_RAW) + 1).cast("int"))
    return fx.table(spark, d, "customer").select(k.alias("city_id"), text.normalize_country(raw).alias("country"))


URL_PATH = "concat(regexp_replace(regexp_replace(regexp_replace({}, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '/+$', ''), '/')"


@R.add("normalize_url_path", f"SELECT page_id, {URL_PATH.format('url')} AS path FROM pages")
def normalize_url_path(spark, d):
    return fx.table(spark, d, "pages").select("page_id", text.url_path(F.col("url")).alias("path"))


CLASSIFY = """CASE WHEN len([x FOR x IN string_split({0}, '/') IF x <> '']) = 0 THEN 'homepage' WHEN [x FOR x IN string_split({0}, '/') IF x <> ''][1] <> 'wetbulb-temperature' THEN 'other'
 ELSE CASE len([x FOR x IN string_split({0}, '/') IF x <> '']) WHEN 1 THEN 'directory' WHEN 2 THEN 'country' WHEN 3 THEN 'region' ELSE 'city' END END"""
GA_PATH = URL_PATH.format("landing_page")


@R.add("classify_page", f"WITH {fx.GA}, p AS (SELECT {GA_PATH} AS path FROM ga WHERE landing_page <> '(not set)') SELECT {CLASSIFY.format('path')} AS page_type, count(*) AS n FROM p GROUP BY 1")
def classify_page(spark, d):
    p = fx.ga_rows(spark, d).where("landing_page <> '(not set)'").select(text.url_path(F.col("landing_page")).alias("path"))
    return p.groupBy(text.classify_page(F.col("path")).alias("page_type")).agg(F.count("*").alias("n"))


@R.add("safe_int", "SELECT event_id, coalesce(CAST(trunc(TRY_CAST(CASE WHEN event_id % 5 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE)) AS BIGINT), 0) AS n FROM events")
def safe_int(spark, d):
    s = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return fx.table(spark, d, E).select("event_id", text.safe_int(s).alias("n"))


@R.add("fnv1a_bucket", C + f"""SELECT city_id, CAST(list_reduce(list_prepend(2166136261, [ord(c) FOR c IN string_split({SLUG.format("concat(name, ' ', CAST(city_id AS VARCHAR))")}, '')]), lambda h, c: (xor(h, CAST(c AS BIGINT)) * 16777619) & 4294967295) % 16 AS INT) AS bucket FROM cities""")
def fnv1a_bucket(spark, d):
    return _c(spark, d).select("city_id", text.fnv1a_bucket(text.slugify(F.concat_ws(" ", "name", "city_id")), 16).alias("bucket"))


@R.add("sha_order_key", C + "SELECT city_id, sha256(concat('2024-01-01T00:00:00Z', chr(0), name, '/', CAST(city_id AS VARCHAR))) AS order_key FROM cities")
def sha_order_key(spark, d):
    return _c(spark, d).select("city_id", F.sha2(F.concat(F.lit("2024-01-01T00:00:00Z\0"), "name", F.lit("/"), F.col("city_id").cast("string")), 256).alias("order_key"))


@R.add("local_date", f"WITH {fx.CITY_HOURS} SELECT city_id, hour, CAST(valid_time + to_seconds(offset_s) AS DATE) AS local_day FROM city_hours")
def local_date(spark, d):
    return fx.city_hours(spark, d).select("city_id", F.col("hour").cast("bigint").alias("hour"), times.local_date(F.col("valid_time"), F.col("offset_s")).alias("local_day"))


@R.add("hourly_window", "SELECT event_id, date_trunc('hour', ts) + INTERVAL 1 HOUR AS first_hour, date_trunc('hour', ts) + INTERVAL 24 HOUR AS last_hour FROM events")
def hourly_window(spark, d):
    first = times.next_hour(F.col("ts"))
    return fx.table(spark, d, E).select("event_id", first.alias("first_hour"), F.timestamp_add("HOUR", F.lit(23), first).alias("last_hour"))


@R.add("covering_steps", "SELECT event_id, CAST(unnest(range((event_id % 220) // 3 * 3, -((-(event_id % 220 + 23)) // 3) * 3 + 1, 3)) AS INT) AS step FROM events WHERE -((-(event_id % 220 + 23)) // 3) * 3 <= 240".replace("-((-(event_id % 220 + 23)) // 3) * 3", "CAST(ceil((event_id % 220 + 23) / 3.0) AS BIGINT) * 3"))
def covering_steps(spark, d):
    a = F.col("event_id") % 220
    return fx.table(spark, d, E).select("event_id", F.explode(times.covering_steps(a, a + 23)).alias("step"))


@R.add("hourly_steps", "SELECT event_id, CAST(unnest(range(event_id % 120, event_id % 120 + 24)) AS INT) AS step FROM events WHERE event_id % 120 + 23 <= 120")
def hourly_steps(spark, d):
    return fx.table(spark, d, E).select("event_id", F.explode(times.hourly_steps(F.col("event_id") % 120)).alias("step"))


@R.add("candidate_cycles", """SELECT event_id, run FROM (SELECT event_id, ts, unnest([date_trunc('day', ts - INTERVAL 5 HOUR) + to_hours(CAST(date_part('hour', ts - INTERVAL 5 HOUR) // 6 * 6 AS INT)) - to_hours(CAST(6 * i AS INT)) FOR i IN range(6)]) AS run FROM events)
WHERE run >= ts - INTERVAL 30 HOUR AND run > ts - INTERVAL 20 HOUR""")
def candidate_cycles(spark, d):
    ts = F.col("ts")
    return fx.table(spark, d, E).select("event_id", F.explode(times.candidate_cycles(ts, F.timestamp_add("HOUR", F.lit(-20), ts))).alias("run"))


@R.add("lead_hour_bin", "SELECT event_id, CASE WHEN floor(value % 30) <= 6 THEN '0-6' WHEN floor(value % 30) <= 12 THEN '7-12' WHEN floor(value % 30) <= 18 THEN '13-18' ELSE '19+' END AS lead_bin FROM events")
def lead_hour_bin(spark, d):
    return fx.table(spark, d, E).select("event_id", times.lead_hour_bin(F.col("value") % 30).alias("lead_bin"))


@R.add("complete_week", "SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) - 7 AS first_day, CAST(date_trunc('week', o_orderdate) AS DATE) - 1 AS last_day FROM orders")
def complete_week(spark, d):
    return fx.table(spark, d, "orders").select("o_orderkey", times.complete_week(F.to_date("o_orderdate")).alias("w")).select("o_orderkey", F.col("w.first").alias("first_day"), F.col("w.last").alias("last_day"))


@R.add("resolve_run_init", "SELECT event_id, CASE WHEN date_trunc('hour', ts) + to_minutes(CAST(event_id % 60 AS INT)) + INTERVAL 10 MINUTE <= ts THEN date_trunc('day', ts) END AS run FROM events")
def resolve_run_init(spark, d):
    ts = F.col("ts")
    available = F.timestamp_add("MINUTE", (F.col("event_id") % 60).cast("int"), F.date_trunc("HOUR", ts))
    return fx.table(spark, d, E).select("event_id", times.resolve_run_init(F.date_trunc("DAY", ts), available, ts).alias("run"))


@R.add("whole_second_utc", "SELECT event_id, date_trunc('second', ts) AS at FROM events")
def whole_second_utc(spark, d):
    return fx.table(spark, d, E).select("event_id", times.whole_second(F.col("ts")).alias("at"))


MONTHS_SQL = "[((c_custkey * 7 + m * 53) % 421) - 100 FOR m IN range(12)]"


def monthly(spark, d):
    """Twelve values in hundredths of a degree for each city."""
    k = F.col("c_custkey")
    return fx.table(spark, d, "customer").select(k.alias("city_id"), F.transform(F.sequence(F.lit(0), F.lit(11)), lambda m: ((k * 7 + m * 53) % 421 - 100).cast("decimal(9,2)") / 100).alias("months"))


@R.add("monthly_tenths", f"""SELECT city_id, month, tenths, bits FROM (SELECT city_id, unnest(range(12)) AS month, unnest([CAST(CASE WHEN v >= 0 THEN (v + 5) // 10 ELSE -((-v + 5) // 10) END AS INT) FOR v IN vs]) AS tenths,
 CAST(list_sum([CASE WHEN vs[CAST(i + 1 AS INT)] = list_max(vs) THEN pow(2, i) ELSE 0 END FOR i IN range(12)]) AS INT) AS bits FROM (SELECT c_custkey AS city_id, {MONTHS_SQL} AS vs FROM customer))""")
def monthly_tenths(spark, d):
    """Half away from zero to tenths, and a bit for each month that equals the greatest unrounded value."""
    bits = F.aggregate(F.zip_with("months", F.sequence(F.lit(0), F.lit(11)), lambda v, i: F.when(v == F.array_max("months"), F.pow(F.lit(2), i).cast("int")).otherwise(0)), F.lit(0), lambda a, x: a + x)
    rows = monthly(spark, d).select("city_id", bits.alias("bits"), F.posexplode(F.transform("months", lambda v: F.round(v * 10, 0).cast("int"))).alias("month", "tenths"))
    return rows.select("city_id", F.col("month").cast("bigint").alias("month"), "tenths", "bits")


@R.add("expand_climate", f"""WITH v AS (SELECT c_custkey AS city_id, {MONTHS_SQL} AS vs FROM customer)
SELECT city_id, CAST(m AS INT) AS month, CASE WHEN vs[m] >= 0 THEN (vs[m] + 5) // 10 ELSE -((-vs[m] + 5) // 10) END / 10.0 AS value, vs[m] = list_max(vs) AS is_peak FROM v, range(1, 13) r(m)""")
def expand_climate(spark, d):
    """Tenths and the bitmask of peak months back to twelve values."""
    bits = F.aggregate(F.zip_with("months", F.sequence(F.lit(0), F.lit(11)), lambda v, i: F.when(v == F.array_max("months"), F.pow(F.lit(2), i).cast("int")).otherwise(0)), F.lit(0), lambda a, x: a + x)
    packed = monthly(spark, d).select("city_id", bits.alias("bits"), F.transform("months", lambda v: F.round(v * 10, 0).cast("int")).alias("tenths"))
    rows = packed.select("city_id", "bits", F.posexplode("tenths").alias("at", "tenths"))
    return rows.select("city_id", (F.col("at") + 1).alias("month"), (F.col("tenths") / 10.0).alias("value"), (F.getbit(F.col("bits"), F.col("at")) == 1).alias("is_peak"))


@R.add("rank_bucket", "SELECT o_orderkey, CASE WHEN r <= 10 THEN 'top_10' WHEN r <= 25 THEN 'top_25' WHEN r <= 50 THEN 'top_50' ELSE 'other' END AS bucket, CASE WHEN r <= 50 THEN '1A' WHEN r <= 100 THEN '1B' WHEN r <= 200 THEN '1C' END AS tier, CASE WHEN r <= 50 THEN 'top_50|top_100|top_200' WHEN r <= 100 THEN 'top_100|top_200' WHEN r <= 200 THEN 'top_200' ELSE '' END AS tags FROM (SELECT o_orderkey, o_orderkey % 250 + 1 AS r FROM orders)")
def rank_bucket(spark, d):
    """rank_bucket, tier_of_rank and cohort_tags of one rank."""
    r = F.col("r")
    bucket = F.when(r <= 10, "top_10").when(r <= 25, "top_25").when(r <= 50, "top_50").otherwise("other")
    tier = F.when(r <= 50, "1A").when(r <= 100, "1B").when(r <= 200, "1C")
    tags = F.array_compact(F.array(F.when(r <= 50, "top_50"), F.when(r <= 100, "top_100"), F.when(r <= 200, "top_200")))
    return fx.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 250 + 1).alias("r")).select("o_orderkey", bucket.alias("bucket"), tier.alias("tier"), F.array_join(tags, "|").alias("tags"))


for name in ("tier_of_rank", "cohort_tags"):
    R.queries[name], R.sql[name] = rank_bucket, R.sql["rank_bucket"]


def _attr(tag, name):
    return f"""concat(regexp_extract({tag}, '(?i)\\b{name}=(?:"([^"]*)"|''([^'']*)''|([^\\s>]+))', 1), regexp_extract({tag}, '(?i)\\b{name}=(?:"([^"]*)"|''([^'']*)''|([^\\s>]+))', 2), regexp_extract({tag}, '(?i)\\b{name}=(?:"([^"]*)"|''([^'']*)''|([^\\s>]+))', 3))"""


def _meta(key, name):
    return f"""coalesce({_attr(f"[t FOR t IN regexp_extract_all(html, '(?i)<meta\\b[^>]*>') IF lower({_attr('t', key)}) = '{name}'][1]", 'content')}, '')"""


_PAGE = ", ".join(f"{_meta('name', n)} AS {n}" for n in ("description", "robots")) + ", " + ", ".join(f"{_meta('property', 'og:' + n)} AS og_{n}" for n in text.OG)
_CANONICAL = f"""coalesce({_attr(f"[t FOR t IN regexp_extract_all(html, '(?i)<link\\b[^>]*>') IF lower({_attr('t', 'rel')}) = 'canonical'][1]", 'href')}, '')"""


@R.add("page_metadata", f"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(list_distinct(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1))) AS n_anchors, regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1) AS lang,
{_PAGE}, {_CANONICAL} AS canonical, len(regexp_extract_all(html, '(?is)<script\\b[^>]*type=["'']application/ld\\+json["''][^>]*>.*?</script>')) AS n_json_ld FROM pages""")
def page_metadata(spark, d):
    html = F.col("html")
    return fx.table(spark, d, "pages").select("page_id", text.page_title(html).alias("title"), F.size(text.page_anchors(html)).cast("bigint").alias("n_anchors"), F.regexp_extract(html, r'(?i)<html[^>]*lang="([^"]*)"', 1).alias("lang"), *text.page_fields(html))


@R.add("page_indexable", """SELECT page_id, NOT coalesce(list_bool_or([regexp_matches(lower(x), '\\b(?:noindex|none)\\b') FOR x IN regexp_extract_all(html, '(?i)<meta[^>]*name="robots"[^>]*content="([^"]*)"', 1)]), false) AS indexable FROM pages""")
def page_indexable(spark, d):
    return fx.table(spark, d, "pages").select("page_id", text.page_indexable(F.col("html")).alias("indexable"))


_PLAIN = "CASE WHEN floor({0}) = 0 THEN '0' ELSE regexp_replace(CAST(floor({0} * 10) / 10 AS VARCHAR), '\\.0$', '') END"


@R.add("location_key", C + f"SELECT city_id, concat({_PLAIN.format('latitude')}, ',', {_PLAIN.format('longitude')}) AS key FROM cities")
def location_key(spark, d):
    tenth = lambda c: F.when(F.floor(c) == 0, -0.0).otherwise(F.floor(F.col(c) * 10) / 10)
    return _c(spark, d).select("city_id", text.location_key(tenth("latitude"), tenth("longitude")).alias("key"))


@R.add("nearby_label", C + "SELECT city_id, concat_ws(', ', name, CASE WHEN country <> 'NATION_1' OR state <> 'BUILDING' THEN state END, CASE WHEN country <> 'NATION_1' THEN country END) AS label FROM cities")
def nearby_label(spark, d):
    return _c(spark, d).select("city_id", text.nearby_label(F.col("name"), F.col("state"), F.col("country"), F.lit("BUILDING"), F.lit("NATION_1")).alias("label"))


@R.add("compact_nearby", C + f"SELECT city_id, CASE WHEN {SLUG.format('country')} = 'nation1' THEN '' ELSE {SLUG.format('country')} END AS country, CASE WHEN {SLUG.format('state')} = 'building' THEN '' ELSE {SLUG.format('state')} END AS state, {SLUG.format('country')} AS country_back FROM cities")
def compact_nearby(spark, d):
    """Slugs equal to the linking city's are blank, and come back from there."""
    rows = _c(spark, d).select("city_id", text.slugify(F.col("country")).alias("c"), text.slugify(F.col("state")).alias("s"))
    blank = lambda x, own: F.when(x == own, "").otherwise(x)
    small = rows.select("city_id", blank(F.col("c"), F.lit("nation1")).alias("country"), blank(F.col("s"), F.lit("building")).alias("state"))
    return small.withColumn("country_back", F.coalesce(F.nullif("country", F.lit("")), F.lit("nation1")))


R.queries["expand_nearby"], R.sql["expand_nearby"] = compact_nearby, R.sql["compact_nearby"]


@R.add("parse_coordinates", "SELECT event_id, TRY_CAST(a AS DOUBLE) AS lat, TRY_CAST(b AS DOUBLE) AS lon FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '' WHEN event_id % 7 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS a, CAST(value * 2 - 100 AS VARCHAR) AS b FROM events) WHERE TRY_CAST(a AS DOUBLE) BETWEEN -90 AND 90 AND TRY_CAST(b AS DOUBLE) BETWEEN -180 AND 180")
def parse_coordinates(spark, d):
    i = F.col("event_id")
    a = F.when(i % 9 == 0, "").when(i % 7 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    rows = fx.table(spark, d, E).select("event_id", a.try_cast("double").alias("lat"), (F.col("value") * 2 - 100).cast("string").try_cast("double").alias("lon"))
    return rows.where(geo.valid_coordinates(F.col("lat"), F.col("lon")))


@R.add("unique_path_check", C.rstrip() + f", p AS (SELECT {PATH} AS path FROM cities) SELECT path, count(*) AS n, regexp_matches(path, '^/(?:[^/?#]+/)*$') AND NOT regexp_matches(path, '\\.\\.|://') AS safe FROM p GROUP BY path")
def unique_path_check(spark, d):
    return with_path(_c(spark, d)).groupBy("path").agg(F.count("*").alias("n")).withColumn("safe", text.safe_path(F.col("path")))


@R.add("non_latin_audit", "SELECT lang, count(*) AS n_rows, count(*) FILTER (regexp_matches(text, '[؀-ۿݐ-ݿᄀ-ᇿ぀-ゟ゠-ヿ㐀-䶿一-鿿가-힯Ѐ-ӿ฀-๿ऀ-ॿ]')) AS n_non_latin, count(*) FILTER (NOT regexp_matches(lower(text), '[a-z0-9]')) AS n_empty_slug FROM documents GROUP BY lang")
def non_latin_audit(spark, d):
    t = F.col("text")
    return fx.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n_rows"), F.count_if(t.rlike(text.NON_LATIN)).alias("n_non_latin"), F.count_if(~F.lower(t).rlike("[a-z0-9]")).alias("n_empty_slug"))


@R.add("validate_coordinate_precision", C.rstrip() + f", p AS (SELECT *, {PATH} AS path FROM cities) SELECT count(*) AS n_rows, count(*) FILTER (abs(latitude - round(latitude, 5)) > 1e-9 OR abs(longitude - round(longitude, 5)) > 1e-9) AS n_imprecise, count(*) - count(DISTINCT path) AS n_repeated FROM p")
def validate_coordinate_precision(spark, d):
    fine = lambda c: F.abs(F.col(c) - F.col(c).cast("decimal(9,5)").cast("double")) > 1e-9
    return with_path(_c(spark, d)).agg(F.count("*").alias("n_rows"), F.count_if(fine("latitude") | fine("longitude")).alias("n_imprecise"), (F.count("*") - F.countDistinct("path")).alias("n_repeated"))


@R.add("validate_city_manifest", C.rstrip() + f", p AS (SELECT {PATH} AS path, count(*) AS n, count(*) FILTER (latitude NOT BETWEEN -90 AND 90 OR longitude NOT BETWEEN -180 AND 180) AS bad FROM cities GROUP BY 1) SELECT path, n AS n_rows, bad AS n_out_of_range FROM p WHERE n > 1 OR bad > 0")
def validate_city_manifest(spark, d):
    ok = geo.valid_coordinates(F.col("latitude"), F.col("longitude"))
    return with_path(_c(spark, d)).groupBy("path").agg(F.count("*").alias("n_rows"), F.count_if(~ok).alias("n_out_of_range")).where("n_rows > 1 or n_out_of_range > 0")


# The parts of a user agent's name that mark it as a bot.
BOT_NAMES = "googlebot bingbot slurp duckduckbot baiduspider yandexbot applebot petalbot semrushbot ahrefsbot mj12bot dotbot bytespider crawler spider bot".split()
BOTS = f"(?i){'|'.join(BOT_NAMES)}"


@R.add("filter_bots", f"SELECT event_id FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Googlebot/2.1' WHEN 1 THEN 'HeadlessChrome' WHEN 2 THEN 'LinkPreview crawl' WHEN 3 THEN 'Yahoo! SLURP' ELSE concat('Mozilla ', event_type) END AS ua FROM events) WHERE NOT regexp_matches(ua, '{BOTS}')")
def filter_bots(spark, d):
    k = F.col("event_id") % 6
    ua = F.when(k == 0, "Googlebot/2.1").when(k == 1, "HeadlessChrome").when(k == 2, "LinkPreview crawl").when(k == 3, "Yahoo! SLURP").otherwise(F.concat(F.lit("Mozilla "), F.coalesce("event_type", F.lit(""))))
    return fx.table(spark, d, E).select("event_id", ua.alias("ua")).where(~F.col("ua").rlike(BOTS)).select("event_id")


@R.add("src_web_pages", "SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS n_bytes FROM pages WHERE url IS NOT NULL")
def src_web_pages(spark, d):
    return fx.table(spark, d, "pages").where("url is not null").select("page_id", "url", F.octet_length("html").cast("bigint").alias("n_bytes"))


_EVENTS = [*an.PRODUCT_EVENTS, "page_view"]
_VALUES = [v for values in an.FIELD_VALUES.values() for v in values]
_given = lambda i: f"([{', '.join(map(repr, _VALUES))}])[CAST((event_id + {i}) % {len(_VALUES)} AS INT) + 1]"
_allowed = lambda i, f: f"CASE WHEN event IN ({', '.join(repr(e) for e, of in an.EVENT_FIELDS.items() if f in of)}) AND {_given(i)} IN ({', '.join(map(repr, an.FIELD_VALUES[f]))}) THEN {_given(i)} END AS {f}"
_ALLOWED = f"""WITH e AS (SELECT event_id, ([{', '.join(map(repr, _EVENTS))}])[CAST(user_id % {len(_EVENTS)} AS INT) + 1] AS event FROM events)
SELECT event_id, event, {', '.join(_allowed(i, f) for i, f in enumerate(an.FIELD_VALUES))} FROM e WHERE event <> 'page_view'"""


@R.add("event_allowlist", _ALLOWED)
def event_allowlist(spark, d):
    """Each event with a value for every field, of that field or of another: known events keep the fields that they may have with values that these may have."""
    pick = lambda xs, i: F.array(*[F.lit(x) for x in xs])[F.pmod(i, F.lit(len(xs))).cast("int")]
    given = F.create_map(*[c for i, f in enumerate(an.FIELD_VALUES) for c in (F.lit(f), pick(_VALUES, F.col("event_id") + i))])
    rows = fx.table(spark, d, E).select("event_id", pick(_EVENTS, F.col("user_id")).alias("event"), given.alias("fields"))
    return an.allowed_events(rows).select("event_id", "event", *[F.element_at("fields", f).alias(f) for f in an.FIELD_VALUES])


@R.add("flag_peak_passed", f"WITH {fx.CITY_HOURS} SELECT city_id, hour, valid_time <= TIMESTAMP '2024-01-03 00:00:00' AS passed FROM city_hours")
def flag_peak_passed(spark, d):
    return fx.city_hours(spark, d).select("city_id", F.col("hour").cast("bigint").alias("hour"), (F.col("valid_time") <= F.lit("2024-01-03 00:00:00").cast("timestamp")).alias("passed"))


@R.add("validate_hour_window", f"WITH {fx.CITY_HOURS}, x AS (SELECT city_id, hour, lag(hour) OVER (PARTITION BY city_id ORDER BY hour) AS p FROM city_hours WHERE hour BETWEEN 6 AND 29) SELECT city_id, count(*) AS n_hours, count(*) FILTER (p IS NOT NULL AND hour - p <> 1) AS n_gaps, min(hour) = 6 AND max(hour) = 29 AS same_window FROM x GROUP BY city_id")
def validate_hour_window(spark, d):
    from pyspark.sql import Window

    x = fx.city_hours(spark, d).where("hour between 6 and 29").withColumn("p", F.lag("hour").over(Window.partitionBy("city_id").orderBy("hour")))
    return x.groupBy("city_id").agg(F.count("*").alias("n_hours"), F.count_if(F.col("hour") - F.col("p") != 1).alias("n_gaps"), ((F.min("hour") == 6) & (F.max("hour") == 29)).alias("same_window"))


@R.add("transform_current_weather", C + "SELECT city_id, name, latitude AS lat, longitude AS lon, floor((population % 40 + 273.15::DOUBLE - 273.15::DOUBLE) * 100 + 0.5) / 100 AS temperature_c, CAST(population % 100 AS DOUBLE) AS humidity, 1704067200000 AS time_ms FROM cities")
def transform_current_weather(spark, d):
    """A nested provider document becomes a location and a weather struct, flattened here."""
    doc = F.to_json(F.struct(F.col("name"), F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).alias("coord"), F.struct((F.col("population") % 40 + 273.15).alias("temp"), (F.col("population") % 100).alias("humidity")).alias("main"), F.lit(1704067200).alias("dt")))
    read = F.from_json(doc, "name string, coord struct<lat:double,lon:double>, main struct<temp:double,humidity:double>, dt long")
    from ..functions.physics import kelvin_to_celsius

    w = _c(spark, d).select("city_id", read.alias("w"))
    return w.select("city_id", "w.name", "w.coord.lat", "w.coord.lon", kelvin_to_celsius(F.col("w.main.temp")).alias("temperature_c"), F.col("w.main.humidity").alias("humidity"), (F.col("w.dt") * 1000).alias("time_ms"))
