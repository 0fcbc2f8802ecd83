"""Queries on the city inventory, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import inventory as inv
from ..operators.numbering import global_rank, grouped_rank, neighbours
from ..session import materialize
from ..sources import files, sinks
from . import fixtures as fx
from .columns import MERRA, PATH, SLUG, SUFFIX, haversine_sql, merra, with_path
from .define import Registry

R = Registry()
C = f"WITH {fx.CITIES}"
DEDUPED = f"""ded AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY base_path) > 1 THEN concat('/wetbulb-temperature/', {SLUG.format('country')}, '/', {SLUG.format('state')}, '/', {SLUG.format('name')}, '-', {SUFFIX}, '/') ELSE base_path END AS path FROM (SELECT *, {PATH} AS base_path FROM cities))"""


def _c(spark, d):
    return fx.cities(spark, d)


def deduped(spark, d):
    return inv.dedupe_slugs(_c(spark, d))


@R.add("src_geonames", C + ", g AS (SELECT c_custkey AS geonameid, c_name AS name, CASE WHEN c_custkey % 6 = 0 THEN 'A' ELSE 'P' END AS f, (c_custkey * 31 % 400) * 500 AS population FROM customer) SELECT geonameid, concat(name, ' \"x\"') AS name, population FROM g WHERE f = 'P' AND population >= 1000")
def src_geonames(spark, d):
    """A dump of 19 tab-separated columns, with quotes in names, written and read back: populated places of 1000 or more."""
    k = F.col("c_custkey")
    values = {"geonameid": k, "name": F.concat("c_name", F.lit(' "x"')), "latitude": F.lit(1.5), "longitude": F.lit(2.5), "featureClass": F.when(k % 6 == 0, "A").otherwise("P"), "population": k * 31 % 400 * 500}
    fields = [f.split()[0] for f in files.GEONAMES.split(", ")]
    line = F.concat_ws("\t", *[values.get(f, F.lit("")).cast("string") for f in fields])
    path = fx.folder(spark, "geonames")
    fx.table(spark, d, "customer").select(line.alias("value")).write.text(path)
    return files.populated_places(files.geonames(spark, path)).select("geonameid", "name", "population")


@R.add("src_admin1", "SELECT DISTINCT lower(concat(n_name, '.', c_mktsegment)) AS admin1_key, c_mktsegment AS region FROM customer JOIN nation ON c_nationkey = n_nationkey")
def src_admin1(spark, d):
    lines = _c(spark, d).select(F.concat_ws("\t", F.concat_ws(".", "country", "state"), "state").alias("value")).distinct()
    path = fx.folder(spark, "admin1")
    lines.write.text(path)
    return files.admin1_keys(spark.read.text(path))


@R.add("src_country_codes", "SELECT lower(concat('N', CAST(n_nationkey AS VARCHAR))) AS country_key, concat(n_name, ', the') AS country FROM nation")
def src_country_codes(spark, d):
    """Names, some with commas, and codes written as CSV and read back."""
    path = fx.folder(spark, "countries")
    fx.table(spark, d, "nation").select(F.concat("n_name", F.lit(", the")).alias("Name"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("Code")).write.csv(path, header=True)
    return files.country_codes(spark, path)


@R.add("join_resolve_cities", C + " SELECT city_id, country AS country_name, upper(state) AS region FROM cities WHERE city_id % 9 <> 0 AND country <> 'NATION_5' AND latitude <> 0 AND longitude <> 0")
def join_resolve_cities(spark, d):
    c = _c(spark, d).select("city_id", "latitude", "longitude", F.when(F.col("city_id") % 9 != 0, F.lower(F.concat_ws(".", "country", "state"))).alias("admin1_key"), F.lower("country").alias("country_key"))
    base = _c(spark, d)
    admin1 = base.select(F.lower(F.concat_ws(".", "country", "state")).alias("admin1_key"), F.upper("state").alias("region")).distinct()
    countries = fx.table(spark, d, "nation").where("n_name <> 'NATION_5'").select(F.lower("n_name").alias("country_key"), F.col("n_name").alias("country_name"))
    return inv.resolve_cities(c, admin1, countries).select("city_id", "country_name", "region")


@R.add("win_dedupe_slug", C + f", {DEDUPED} SELECT city_id, path FROM ded")
def win_dedupe_slug(spark, d):
    return deduped(spark, d).select("city_id", "path")


@R.add("agg_slug_collisions", C + f", {DEDUPED}, x AS (SELECT base_path, count(*) AS n FROM ded GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows FROM x")
def agg_slug_collisions(spark, d):
    return deduped(spark, d).groupBy("base_path").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"))


_KM = haversine_sql("a.latitude", "a.longitude", "b.latitude", "b.longitude")
_ROW = "CAST(floor({}.latitude / 0.5) AS INT)"
_COL = "CAST(floor({}.longitude / 0.5) AS INT)"
KNN = f"""knn AS (SELECT city_id, other, km, CAST(row_number() OVER (PARTITION BY city_id ORDER BY km, other) AS INT) AS rank FROM (SELECT a.city_id, b.city_id AS other, {_KM} AS km FROM cities a JOIN cities b ON a.city_id <> b.city_id
 AND abs({_ROW.format('a')} - {_ROW.format('b')}) <= 8 AND least(abs({_COL.format('a')} - {_COL.format('b')}), 720 - abs({_COL.format('a')} - {_COL.format('b')})) <= 8) QUALIFY rank <= 8)"""


@R.add("join_knn_grid", C + f", {KNN} SELECT city_id, other, round(km, 3) AS km, rank FROM knn")
def join_knn_grid(spark, d):
    return inv.nearest_cities(_c(spark, d)).select("city_id", "other", F.round("km", 3).alias("km"), "rank")


@R.add("join_hubs_radius", C + f""", {KNN}, h AS (SELECT a.city_id, b.city_id AS other, b.population, {_KM} AS km FROM cities a JOIN cities b ON a.city_id <> b.city_id AND b.population >= 20000 WHERE {_KM} <= 500)
SELECT city_id, other, round(km, 3) AS km, CAST(row_number() OVER (PARTITION BY city_id ORDER BY population DESC, km, other) AS INT) AS rank FROM h ANTI JOIN (SELECT * FROM knn WHERE rank = 1) k1 USING (city_id, other) QUALIFY rank <= 2""")
def join_hubs_radius(spark, d):
    """Within 500 km of the sparse projected cities, besides the nearest one."""
    c = _c(spark, d)
    return inv.hubs_nearby(c, inv.nearest_cities(c, n=1), most_km=500.0).select("city_id", "other", F.round("km", 3).alias("km"), "rank")


def gazetteer(spark, d):
    k = F.col("city_id")
    g = _c(spark, d).where("city_id % 4 <> 0")
    return g.select((k + 1000).alias("geonameid"), F.when(k % 3 == 0, F.concat(F.lit("Old "), "name")).otherwise(F.col("name")).alias("name"), F.lower(F.concat_ws(",", F.lit("x"), "name")).alias("alternates"), (F.col("latitude") + k % 5 * 0.01).alias("latitude"), "longitude", "population")


@R.add("join_population_match", C + f""", g AS (SELECT city_id + 1000 AS geonameid, CASE WHEN city_id % 3 = 0 THEN concat('Old ', name) ELSE name END AS gname, lower(concat('x,', name)) AS alternates, latitude + city_id % 5 * 0.01::DOUBLE AS latitude, longitude, population FROM cities WHERE city_id % 4 <> 0),
m AS (SELECT a.city_id, b.geonameid, b.population, {_KM} AS km, CASE WHEN a.city_id % 10 = 1 THEN CASE WHEN b.geonameid = a.city_id + 1000 THEN -1 END WHEN lower(a.name) = lower(gname) THEN 0 WHEN list_contains(string_split(lower(alternates), ','), lower(a.name)) THEN 1 END AS tier
 FROM cities a JOIN g b ON abs(CAST(floor(a.latitude / 0.05) AS INT) - CAST(floor(b.latitude / 0.05) AS INT)) <= 1 AND abs(CAST(floor(a.longitude / 0.05) AS INT) - CAST(floor(b.longitude / 0.05) AS INT)) <= 1)
SELECT city_id, geonameid, population, CAST(tier AS INT) AS tier, round(km, 3) AS km FROM (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY tier, km, geonameid) AS rn FROM m WHERE km <= 3 AND tier IS NOT NULL) WHERE rn = 1 AND population > 0""")
def join_population_match(spark, d):
    c = _c(spark, d).withColumn("city_geonameid", F.when(F.col("city_id") % 10 == 1, F.col("city_id") + 1000))
    return inv.match_population(c, gazetteer(spark, d)).select("city_id", "geonameid", "population", "tier", F.round("km", 3).alias("km"))


FACTS = """routes AS (SELECT concat('r', CAST(city_id AS VARCHAR)) AS path, city_id, population FROM cities), ident AS (SELECT path, CASE WHEN city_id % 10 = 2 AND (city_id - 1) % 8 <> 0 AND city_id - 1 IN (SELECT city_id FROM cities) THEN city_id - 1 ELSE city_id END AS geonameid FROM routes WHERE city_id % 8 <> 0),
src AS (SELECT city_id AS geonameid, population, CASE WHEN city_id % 6 <> 0 THEN city_id % 900 END AS surveyed, CASE WHEN city_id % 12 = 0 THEN -9999 ELSE city_id % 700 END AS dem, concat('Etc/GMT-', CAST(city_id % 12 AS VARCHAR)) AS time_zone FROM cities), cl AS (SELECT geonameid, count(*) AS claims FROM ident GROUP BY 1),
facts AS (SELECT routes.path, CASE WHEN claims = 1 THEN ident.geonameid END AS geonameid, CASE WHEN claims = 1 THEN nullif(src.population, 0) END AS population, CASE WHEN claims = 1 THEN coalesce(surveyed, nullif(dem, -9999)) END AS elevation,
 CASE WHEN claims = 1 AND surveyed IS NOT NULL THEN 'elevation' WHEN claims = 1 AND dem <> -9999 THEN 'dem' END AS elevation_source, CASE WHEN claims = 1 THEN time_zone END AS time_zone,
 CASE WHEN claims IS NULL THEN 'unmatched' WHEN claims > 1 THEN 'ambiguous' ELSE 'matched' END AS state FROM routes LEFT JOIN ident USING (path) LEFT JOIN cl ON cl.geonameid = ident.geonameid LEFT JOIN src ON src.geonameid = ident.geonameid)"""


def facts(spark, d):
    return facts_of(_c(spark, d))


def facts_of(c):
    """Every tenth city claims the id of the one before, if that is there to claim it."""
    k = F.col("city_id")
    path, zone = F.concat(F.lit("r"), k.cast("string")).alias("path"), F.concat(F.lit("Etc/GMT-"), (k % 12).cast("string")).alias("time_zone")
    before = c.select((k + 1).alias("city_id"), F.lit(True).alias("before"))
    claimed = F.when(k % 8 != 0, F.when((k % 10 == 2) & ((k - 1) % 8 != 0) & F.col("before"), k - 1).otherwise(k))
    ident = c.join(before, "city_id", "left").select(path, claimed.alias("geonameid"), zone)
    surveyed, dem = F.when(k % 6 != 0, k % 900), F.when(k % 12 == 0, -9999).otherwise(k % 700)
    source = c.select(k.alias("geonameid"), "latitude", "longitude", "population", surveyed.alias("elevation"), dem.alias("dem"), zone)
    return inv.location_facts(c.select(path, "latitude", "longitude"), ident, source)


@R.add("join_location_facts", C + f", {FACTS} SELECT * FROM facts")
def join_location_facts(spark, d):
    return facts(spark, d)


@R.add("agg_facts_counts", C + f", {FACTS} SELECT state, count(*) AS n, count(population) AS with_population, count(elevation) AS with_elevation FROM facts GROUP BY state")
def agg_facts_counts(spark, d):
    return facts(spark, d).groupBy("state").agg(F.count("*").alias("n"), F.count("population").alias("with_population"), F.count("elevation").alias("with_elevation"))


@R.add("validate_location_facts", C + f""", {FACTS} SELECT 'one row a route' AS rule, count(*) - count(DISTINCT path) AS violations FROM facts UNION ALL SELECT 'unique id', count(geonameid) - count(DISTINCT geonameid) FROM facts
UNION ALL SELECT 'population', count(*) FILTER (population <= 0) FROM facts UNION ALL SELECT 'elevation', count(*) FILTER (elevation NOT BETWEEN -1000 AND 9000) FROM facts""")
def validate_location_facts(spark, d):
    one = facts(spark, d).agg((F.count("*") - F.countDistinct("path")).alias("one row a route"), (F.count("geonameid") - F.countDistinct("geonameid")).alias("unique id"), F.count_if(F.col("population") <= 0).alias("population"), F.count_if(~F.col("elevation").between(-1000, 9000)).alias("elevation"))
    return one.unpivot([], ["`one row a route`", "`unique id`", "population", "elevation"], "rule", "violations")


CLIMATE = f"{MERRA}, vals AS (SELECT cell_row, cell_col, (cell_row * 13 + cell_col * 7) % 300 AS tenths FROM (SELECT DISTINCT cell_row, cell_col FROM merra WHERE cell_row IS NOT NULL) WHERE (cell_row + cell_col) % 9 <> 0), cc AS (SELECT city_id, cell_row, cell_col, tenths, CASE WHEN cell_row IS NULL OR cell_col IS NULL THEN 'cellEdgeTie' WHEN tenths IS NULL THEN 'fillOrInvalidValue' END AS reason FROM merra LEFT JOIN vals USING (cell_row, cell_col))"


def climate(spark, d):
    """Each ninth cell has no usable values."""
    m = merra(spark, d).select("city_id", "cell_row", "cell_col")
    r, c = F.col("cell_row"), F.col("cell_col")
    values = m.where("cell_row is not null").select("cell_row", "cell_col").distinct().withColumn("tenths", F.when((r + c) % 9 != 0, (r * 13 + c * 7) % 300))
    return inv.climate_cells(m, values).select("city_id", "cell_row", "cell_col", "tenths", "reason")


@R.add("join_climate_cell", C + f", {CLIMATE} SELECT * FROM cc")
def join_climate_cell(spark, d):
    return climate(spark, d)


@R.add("set_climate_cells", C + f", {MERRA} SELECT DISTINCT cell_row, cell_col FROM merra WHERE cell_row IS NOT NULL")
def set_climate_cells(spark, d):
    return merra(spark, d).where("cell_row is not null").select("cell_row", "cell_col").distinct()


KOP = f"""{fx.RASTER}, pts AS (SELECT city_id, CAST(city_id % 24 AS INT) AS cell_row, CAST(city_id * 5 % 36 AS INT) AS cell_col FROM cities),
win AS (SELECT city_id, raster.cls, raster.cell_row = pts.cell_row AND raster.cell_col = pts.cell_col AS own FROM pts JOIN raster ON abs(raster.cell_row - pts.cell_row) <= 1 AND abs(raster.cell_col - pts.cell_col) <= 1),
cnt AS (SELECT city_id, cls, count(*) AS n, bool_or(own) AS own FROM win WHERE cls BETWEEN 1 AND 30 GROUP BY 1, 2),
modal AS (SELECT city_id, arg_min(cls, -n * 100 + cls) AS m, max(n) AS mn, sum(n) AS total, max(CASE WHEN own THEN cls END) AS center FROM cnt GROUP BY 1),
kop AS (SELECT city_id, CASE WHEN center = m AND mn / total >= {{}} THEN center END AS cls, CASE WHEN center IS NULL THEN 'centerNoData' WHEN center <> m THEN 'centerNotModal' WHEN mn / total < {{}} THEN 'lowModalShare' END AS reason FROM pts LEFT JOIN modal USING (city_id))"""


def _points(spark, d):
    return _c(spark, d).select("city_id", (F.col("city_id") % 24).cast("int").alias("cell_row"), (F.col("city_id") * 5 % 36).cast("int").alias("cell_col"))


@R.add("join_koppen_window", C + f", {KOP.format(0.67, 0.67)} SELECT city_id, count(*) AS n, count(*) FILTER (cls BETWEEN 1 AND 30) AS n_valid FROM win GROUP BY 1")
def join_koppen_window(spark, d):
    side = F.array(F.lit(-1), F.lit(0), F.lit(1))
    asks = _points(spark, d).select("*", F.explode(side).alias("dr")).select("*", F.explode(side).alias("dc")).select("city_id", (F.col("cell_row") + F.col("dr")).alias("cell_row"), (F.col("cell_col") + F.col("dc")).alias("cell_col"))
    return asks.join(fx.raster(spark), ["cell_row", "cell_col"]).groupBy("city_id").agg(F.count("*").alias("n"), F.count_if(F.col("cls").between(1, 30)).alias("n_valid"))


@R.add("agg_koppen_modal", C + f", {KOP.format(0.1, 0.1)} SELECT city_id, cls, reason FROM kop")
def agg_koppen_modal(spark, d):
    """With a low share, as the projected raster changes class from cell to cell."""
    return inv.koppen_modal(_points(spark, d), fx.raster(spark), least=0.1).withColumn("cls", F.col("cls").cast("int"))


@R.add("agg_climate_counts", C + f", {CLIMATE}, {KOP.format(0.1, 0.1)} SELECT coalesce(kop.reason, 'classed') AS reason, count(*) AS n, count(tenths) AS with_cell FROM kop JOIN cc USING (city_id) GROUP BY 1")
def agg_climate_counts(spark, d):
    k = inv.koppen_modal(_points(spark, d), fx.raster(spark), least=0.1)
    return k.join(climate(spark, d).drop("reason"), "city_id").groupBy(F.coalesce("reason", F.lit("classed")).alias("reason")).agg(F.count("*").alias("n"), F.count("tenths").alias("with_cell"))


@R.add("validate_climate_context", C + f""", {CLIMATE} SELECT 'one row a route' AS rule, count(*) - count(DISTINCT city_id) AS violations FROM cc UNION ALL SELECT 'every route', count(*) FROM cities ANTI JOIN cc USING (city_id)
UNION ALL SELECT 'exclusions are the null rows', count(*) FILTER ((tenths IS NULL) <> (reason IS NOT NULL)) FROM cc UNION ALL SELECT 'unused cells', count(*) FROM vals ANTI JOIN cc USING (cell_row, cell_col) UNION ALL SELECT 'missing cells', count(*) FILTER (cell_row IS NOT NULL AND tenths IS NULL) FROM cc""")
def validate_climate_context(spark, d):
    """Violations of each rule; cells without usable values are told as missing."""
    cc = climate(spark, d)
    rule = lambda name, n: n.select(F.lit(name).alias("rule"), "violations")
    own = cc.agg((F.count("*") - F.countDistinct("city_id")).alias("a"), F.count_if(F.col("tenths").isNull() != F.col("reason").isNotNull()).alias("b"), F.count_if(F.col("cell_row").isNotNull() & F.col("tenths").isNull()).alias("c"))
    named = [rule(name, own.select(F.col(c).alias("violations"))) for name, c in (("one row a route", "a"), ("exclusions are the null rows", "b"), ("missing cells", "c"))]
    absent = _c(spark, d).join(cc, "city_id", "left_anti").agg(F.count("*").alias("violations"))
    used = cc.where("tenths is not null").select("cell_row", "cell_col").distinct()
    unused = used.join(cc, ["cell_row", "cell_col"], "left_anti").agg(F.count("*").alias("violations"))
    return reduce(DataFrame.unionByName, [*named, rule("every route", absent), rule("unused cells", unused)])


@R.add("win_dense_cell_index", C + f", {CLIMATE}, f AS (SELECT cell_row, cell_col, min(city_id) AS first FROM cc WHERE tenths IS NOT NULL GROUP BY 1, 2) SELECT cell_row, cell_col, CAST(row_number() OVER (ORDER BY first) - 1 AS INT) AS idx FROM f")
def win_dense_cell_index(spark, d):
    """Cells numbered by their first city; the index covers one value a cell, ordered by range and counted across partitions."""
    f = climate(spark, d).where("tenths is not null").groupBy("cell_row", "cell_col").agg(F.min("city_id").alias("first"))
    return global_rank(f, "first", "idx").select("cell_row", "cell_col", F.col("idx").cast("int").alias("idx"))


@R.add("join_enrichment_parity", C + f", {FACTS}, rev AS (SELECT path, CASE WHEN city_id % 40 = 3 THEN 1 ELSE CASE WHEN claims = 1 THEN nullif(x.population, 0) END END AS population FROM (SELECT routes.*, cl.claims, src.population AS sp FROM routes LEFT JOIN ident USING (path) LEFT JOIN cl ON cl.geonameid = ident.geonameid LEFT JOIN src ON src.geonameid = ident.geonameid) x WHERE city_id % 20 = 3) SELECT rev.path, rev.population AS reviewed, facts.population AS generated FROM rev JOIN facts USING (path) WHERE rev.population IS DISTINCT FROM facts.population".replace("nullif(x.population, 0)", "nullif(x.sp, 0)"))
def join_enrichment_parity(spark, d):
    """Reviewed values that the full run does not reproduce."""
    f = facts(spark, d)
    k = F.substring("path", 2, 20).cast("long")
    reviewed = f.where(k % 20 == 3).select("path", F.when(k % 40 == 3, F.lit(1)).otherwise(F.col("population")).alias("reviewed"))
    return reviewed.join(f.select("path", F.col("population").alias("generated")), "path").where(~F.col("reviewed").eqNullSafe(F.col("generated")))


@R.add("pipe_reviewed_enrichment", C + f", {FACTS}, {CLIMATE} SELECT facts.path, elevation, time_zone, tenths FROM facts JOIN cc ON facts.path = concat('r', CAST(cc.city_id AS VARCHAR)) WHERE state = 'matched' AND elevation IS NOT NULL AND tenths IS NOT NULL AND city_id % 20 = 3")
def pipe_reviewed_enrichment(spark, d):
    """The reviewed paths are those that were complete when they were reviewed; each must still be."""
    path = F.concat(F.lit("r"), F.col("city_id").cast("string")).alias("path")
    k, r, c = F.col("city_id"), F.col("cell_row"), F.col("cell_col")
    alone = ~((k % 10 == 1) & ((k + 1) % 8 != 0)) & ~((k % 10 == 2) & ((k - 1) % 8 != 0))
    whole = (k % 20 == 3) & (k % 8 != 0) & alone & (k % 12 != 0) & r.isNotNull() & ((r + c) % 9 != 0)
    reviewed = merra(spark, d).where(whole).select(path)
    return inv.reviewed_enrichment(reviewed, facts(spark, d), climate(spark, d).select(path, "tenths"))


HIST = f"hist AS (SELECT city_id, name, country, state, latitude, longitude, concat('/', {SLUG.format('name')}, '/', {SLUG.format('state')}, '/', {SLUG.format('country')}, '/') AS alias FROM cities WHERE city_id % 5 <> 0), fw AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY city_id) AS rn, count(*) OVER (PARTITION BY alias) - 1 AS collided FROM hist)"


def historical(spark, d):
    alias = F.concat(F.lit("/"), F.concat_ws("/", *[text.slugify(F.col(x)) for x in ("name", "state", "country")]), F.lit("/"))
    return _c(spark, d).where("city_id % 5 <> 0").select("city_id", "name", "country", "state", "latitude", "longitude", alias.alias("alias"))


@R.add("win_first_wins", C + f", {HIST} SELECT alias, city_id, collided FROM fw WHERE rn = 1")
def win_first_wins(spark, d):
    return inv.first_wins(historical(spark, d), "alias", "city_id").select("alias", "city_id", "collided")


IDENT = "idn AS (SELECT fw.alias, fw.city_id, (SELECT count(*) FROM cities c WHERE c.name = fw.name AND c.country = fw.country AND c.state = fw.state AND c.latitude = fw.latitude AND c.city_id % 11 <> 0) AS n_matches FROM fw WHERE rn = 1)"


def identity(spark, d):
    new = _c(spark, d).where("city_id % 11 <> 0")
    return inv.unique_identity(inv.first_wins(historical(spark, d), "alias", "city_id"), new, ["name", "country", "state", "latitude"], "city_id")


@R.add("join_redirect_identity", C + f", {HIST}, {IDENT} SELECT alias, city_id, n_matches FROM idn")
def join_redirect_identity(spark, d):
    return identity(spark, d).select("alias", "city_id", "n_matches")


@R.add("set_alias_overlap", C + f", {HIST} SELECT DISTINCT alias, alias IN (SELECT concat('/', {SLUG.format('name')}, '/', {SLUG.format('state')}, '/', {SLUG.format('country')}, '/') FROM cities WHERE city_id % 2 = 0) AS overlaps FROM hist")
def set_alias_overlap(spark, d):
    """Aliases that equal a current path, and those that do not."""
    alias = F.concat(F.lit("/"), F.concat_ws("/", *[text.slugify(F.col(x)) for x in ("name", "state", "country")]), F.lit("/"))
    now = _c(spark, d).where("city_id % 2 = 0").select(alias.alias("alias")).distinct()
    old = historical(spark, d).select("alias").distinct()
    return old.join(now, "alias", "left_semi").withColumn("overlaps", F.lit(True)).unionByName(old.join(now, "alias", "left_anti").withColumn("overlaps", F.lit(False)))


@R.add("pipe_legacy_redirects", C + f""", {HIST}, {IDENT}, now_ AS (SELECT DISTINCT concat('/', {SLUG.format('name')}, '/', {SLUG.format('state')}, '/', {SLUG.format('country')}, '/') AS alias FROM cities WHERE city_id % 2 = 0)
SELECT alias, city_id, n_matches, alias IN (SELECT alias FROM now_) AS overlaps, CASE WHEN alias IN (SELECT alias FROM now_) THEN 'overlap' WHEN n_matches = 1 THEN 'redirect' WHEN n_matches = 0 THEN 'gone' ELSE 'ambiguous' END AS outcome FROM idn""")
def pipe_legacy_redirects(spark, d):
    """The first row of each alias, its one current city, and whether a current path has the alias: such a page answers itself, so that no redirect may."""
    overlap = set_alias_overlap(spark, d).where("overlaps").select("alias", F.lit(True).alias("overlaps"))
    rows = identity(spark, d).join(overlap, "alias", "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(False)))
    outcome = F.when(F.col("overlaps"), "overlap").when(F.col("n_matches") == 1, "redirect").when(F.col("n_matches") == 0, "gone").otherwise("ambiguous")
    return rows.select("alias", "city_id", "n_matches", "overlaps", outcome.alias("outcome"))


@R.add("agg_country_region", C + " SELECT country, state, count(*) AS n FROM cities GROUP BY ROLLUP (country, state)")
def agg_country_region(spark, d):
    return _c(spark, d).rollup("country", "state").agg(F.count("*").alias("n"))


@R.add("agg_inventory_fingerprint", C + f", {DEDUPED}, ln AS (SELECT country, concat(path, chr(9), printf('%.4f', latitude), chr(9), printf('%.4f', longitude), chr(10)) AS line FROM ded) SELECT country, sha256(string_agg(line, '' ORDER BY line)) AS fingerprint FROM ln GROUP BY 1")
def agg_inventory_fingerprint(spark, d):
    line = F.concat(F.concat_ws("\t", "path", F.format_string("%.4f", "latitude"), F.format_string("%.4f", "longitude")), F.lit("\n"))
    return inv.fingerprints(deduped(spark, d).select("country", line.alias("line")), "country", "line")


@R.add("set_page_routes", C + f", {DEDUPED} SELECT '/' AS path UNION SELECT '/wetbulb-temperature/' UNION SELECT concat('/wetbulb-temperature/', {SLUG.format('country')}, '/') FROM ded UNION SELECT concat('/wetbulb-temperature/', {SLUG.format('country')}, '/', {SLUG.format('state')}, '/') FROM ded UNION SELECT path FROM ded")
def set_page_routes(spark, d):
    c = deduped(spark, d)
    country, state = text.slugify(F.col("country")), text.slugify(F.col("state"))
    top = spark.createDataFrame([("/",), ("/wetbulb-temperature/",)], "path string")
    return top.union(c.select(F.concat(F.lit("/wetbulb-temperature/"), country, F.lit("/")))).union(c.select(F.concat(F.lit("/wetbulb-temperature/"), F.concat_ws("/", country, state), F.lit("/")))).union(c.select("path")).distinct()


@R.add("set_category_routes", C + f", {DEDUPED}, r AS (SELECT '/' AS path UNION SELECT '/wetbulb-temperature/' UNION SELECT concat('/wetbulb-temperature/', {SLUG.format('country')}, '/') FROM ded UNION SELECT concat('/wetbulb-temperature/', {SLUG.format('country')}, '/', {SLUG.format('state')}, '/') FROM ded UNION SELECT path FROM ded) SELECT path FROM r EXCEPT SELECT path FROM ded")
def set_category_routes(spark, d):
    return set_page_routes(spark, d).subtract(deduped(spark, d).select("path"))


@R.add("set_route_equality", C + f", {DEDUPED}, a AS (SELECT path FROM ded WHERE city_id % 50 <> 1), b AS (SELECT path FROM ded WHERE city_id % 50 <> 2) SELECT path, 'only_a' AS side FROM (SELECT path FROM a EXCEPT SELECT path FROM b) UNION ALL SELECT path, 'only_b' FROM (SELECT path FROM b EXCEPT SELECT path FROM a)")
def set_route_equality(spark, d):
    c = deduped(spark, d)
    a, b = c.where("city_id % 50 <> 1").select("path"), c.where("city_id % 50 <> 2").select("path")
    return a.subtract(b).withColumn("side", F.lit("only_a")).unionByName(b.subtract(a).withColumn("side", F.lit("only_b")))


@R.add("win_sitemap_parts", C + f", {DEDUPED} SELECT country, part, count(*) AS n, min(path) AS first FROM (SELECT country, path, CAST((row_number() OVER (PARTITION BY country ORDER BY path) - 1) // 20 + 1 AS INT) AS part FROM ded) GROUP BY 1, 2")
def win_sitemap_parts(spark, d):
    """Parts of 20, as the projected countries are small."""
    return inv.sitemap_parts(deduped(spark, d), most=20).groupBy("country", "part").agg(F.count("*").alias("n"), F.min("path").alias("first"))


_WET = "/wetbulb-temperature/"
_PARTS = f"""parts AS (SELECT concat(country, '-', CAST((row_number() OVER (PARTITION BY country ORDER BY path) - 1) // 20 + 1 AS VARCHAR)) AS member, path FROM ded),
cats AS (SELECT concat('{_WET}', {SLUG.format('country')}, '/') AS path FROM ded UNION SELECT concat('{_WET}', {SLUG.format('country')}, '/', {SLUG.format('state')}, '/') FROM ded),
members AS (SELECT * FROM parts UNION ALL SELECT 'categories', path FROM cats UNION ALL SELECT 'main', unnest(['/', '{_WET}']))"""


@R.add("sink_sitemaps", C + f", {DEDUPED}, {_PARTS} SELECT member, count(*) AS n, min(path) AS first FROM members GROUP BY 1 UNION ALL SELECT 'index', count(DISTINCT member), concat('/sitemaps/', min(member), '.xml') FROM members")
def sink_sitemaps(spark, d):
    """The main pages, the categories and parts of 20 paths of each country, with an index of them, written as one version and read back."""
    cities = deduped(spark, d)
    parts = inv.sitemap_parts(cities, most=20).select(F.concat_ws("-", "country", "part").alias("member"), "path")
    top = ["/", _WET]
    categories = set_category_routes(spark, d).where(~F.col("path").isin(top)).select(F.lit("categories").alias("member"), "path")
    main = spark.createDataFrame([("main", p) for p in top], "member string, path string")
    lines = sinks.sitemap_set(parts.union(categories).union(main), "https://www.example.org", fx.folder(spark, "sitemaps"))
    path = F.regexp_extract("value", r"^<(?:url|sitemap)><loc>https://www\.example\.org(/[^<]*)</loc></(?:url|sitemap)>$", 1)
    return lines.groupBy("member").agg(F.count("*").alias("n"), F.min(path).alias("first"))


@R.add("agg_sitemap_audit", C + ", p AS (SELECT country, name, lag(name) OVER (PARTITION BY country ORDER BY city_id) AS before FROM cities) SELECT country, count(*) AS n, count(*) - count(DISTINCT name) AS n_repeated, count(*) FILTER (before > name) AS out_of_order FROM p GROUP BY 1")
def agg_sitemap_audit(spark, d):
    p = neighbours(_c(spark, d).select("country", "city_id", "name"), ["country"], ["city_id"], ["name"], "before")
    return p.groupBy("country").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("name")).alias("n_repeated"), F.count_if(F.col("before.name") > F.col("name")).alias("out_of_order"))


BUCKETS = C + f""", hs AS (SELECT country, state, list_reduce(list_prepend(2166136261, [ord(c) FOR c IN string_split({SLUG.format("concat(name, ' ', CAST(city_id AS VARCHAR))")}, '')]), lambda h, c: (xor(h, CAST(c AS BIGINT)) * 16777619) & 4294967295) AS h FROM cities),
sz AS (SELECT country, state, count(*) AS n FROM hs GROUP BY 1, 2), tr AS (SELECT country, state, n, unnest(range(CAST(ceil(n / 3.0) AS BIGINT), n)) AS b FROM sz WHERE n > 6),
ct AS (SELECT country, state, b, h % b AS k, count(*) AS m FROM hs JOIN tr USING (country, state) GROUP BY ALL), ok AS (SELECT country, state, b FROM ct GROUP BY ALL HAVING count(*) = b AND max(m) <= 6)
SELECT country, state, n, CAST(CASE WHEN n <= 6 THEN 1 ELSE coalesce((SELECT min(b) FROM ok WHERE ok.country = sz.country AND ok.state = sz.state), n) END AS BIGINT) AS buckets FROM sz"""


@R.add("win_region_buckets", BUCKETS)
def win_region_buckets(spark, d):
    """At most 6 cities a bucket, as the projected regions are small."""
    return inv.region_buckets(_c(spark, d), most=6, aim=3)


@R.add("sink_region_shards", C + f", {CLIMATE} SELECT country, state, count(*) AS n, count(DISTINCT (cell_row, cell_col)) FILTER (tenths IS NOT NULL) AS n_cells, CAST(count(DISTINCT (cell_row, cell_col)) FILTER (tenths IS NOT NULL) - 1 AS INT) AS last_local FROM cities JOIN cc USING (city_id) GROUP BY 1, 2")
def sink_region_shards(spark, d):
    """A shard for each region, its climate cells numbered anew, written as JSON and read back."""
    back = sinks.region_shards(_c(spark, d).join(climate(spark, d), "city_id"), ["cell_row", "cell_col"])
    return back.groupBy("country", "state").agg(F.count("*").alias("n"), F.countDistinct("local").alias("n_cells"), F.coalesce(F.max("local"), F.lit(-1)).alias("last_local"))


_PIPE = f"""WITH {fx.CITIES.replace('cities AS', 'everywhere AS')}, cities AS (SELECT * FROM everywhere WHERE city_id % 9 <> 0 AND country <> 'NATION_5' AND latitude <> 0 AND longitude <> 0), {DEDUPED}, {KNN}, {FACTS}, {CLIMATE},
kn AS (SELECT city_id, count(*) AS n_near, min(km) AS km FROM knn GROUP BY 1)
SELECT ded.country, ded.state, count(*) AS n, count(DISTINCT ded.path) AS n_paths, CAST(sum(coalesce(n_near, 0)) AS BIGINT) AS n_neighbours, round(min(km), 3) AS nearest_km, count(facts.population) AS with_population, count(facts.elevation) AS with_elevation,
 count(DISTINCT (cell_row, cell_col)) FILTER (tenths IS NOT NULL) AS n_cells FROM ded LEFT JOIN kn USING (city_id) LEFT JOIN facts ON facts.path = concat('r', CAST(ded.city_id AS VARCHAR)) JOIN cc USING (city_id) GROUP BY 1, 2"""


@R.add("pipe_inventory", _PIPE)
def pipe_inventory(spark, d):
    """Cities with their region and country, paths without collisions, eight neighbours, facts and climate, in one shard for each region, written and read back."""
    keys = _c(spark, d).select("*", F.when(F.col("city_id") % 9 != 0, F.lower(F.concat_ws(".", "country", "state"))).alias("admin1_key"), F.lower("country").alias("country_key"))
    admin1 = _c(spark, d).select(F.lower(F.concat_ws(".", "country", "state")).alias("admin1_key"), F.upper("state").alias("region")).distinct()
    countries = fx.table(spark, d, "nation").where("n_name <> 'NATION_5'").select(F.lower("n_name").alias("country_key"), F.col("n_name").alias("country_name"))
    known = materialize(inv.resolve_cities(keys, admin1, countries).select(*_c(spark, d).columns), "cities")
    near = inv.nearest_cities(known).groupBy("city_id").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "km"))).alias("nearby"))
    about = facts_of(known).withColumn("city_id", F.substring("path", 2, 20).cast("long")).select("city_id", F.col("population").alias("people"), "elevation")
    rows = inv.dedupe_slugs(known).join(near, "city_id", "left").join(about, "city_id", "left").join(climate(spark, d), "city_id")
    back = sinks.region_shards(rows.select("city_id", "country", "state", "path", "nearby", "people", "elevation", "cell_row", "cell_col", "tenths"), ["cell_row", "cell_col"])
    km = F.array_min(F.transform("nearby", lambda x: x["km"]))
    return back.groupBy("country", "state").agg(
        F.count("*").alias("n"), F.countDistinct("path").alias("n_paths"), F.sum(F.coalesce(F.size("nearby"), F.lit(0)).cast("long")).alias("n_neighbours"), F.round(F.min(km), 3).alias("nearest_km"),
        F.count("people").alias("with_population"), F.count("elevation").alias("with_elevation"), F.countDistinct("local").alias("n_cells"),
    )


@R.add("sink_search_index", C + f", {DEDUPED} SELECT concat_ws(', ', name, state, country) AS label, path AS url, round(latitude, 4) AS lat, round(longitude, 4) AS lon FROM ded")
def sink_search_index(spark, d):
    """The index written as JSON lines and read back."""
    return sinks.search_index(deduped(spark, d).select(F.concat_ws(", ", "name", "state", "country").alias("label"), F.col("path").alias("url"), F.round("latitude", 4).alias("lat"), F.round("longitude", 4).alias("lon")))


@R.add("sink_redirect_shards", C + f", {HIST} SELECT substr(sha256(country), 1, 16) AS shard, country, count(*) AS n FROM fw WHERE rn = 1 GROUP BY 1, 2")
def sink_redirect_shards(spark, d):
    """Redirects written in a shard for each country, and read back."""
    rows = inv.first_wins(historical(spark, d), "alias", "city_id").select("alias", "city_id", "country")
    return sinks.redirect_shards(rows).groupBy("shard", "country").agg(F.count("*").alias("n"))


@R.add("agg_shard_profile", C + " SELECT country, count(*) AS n, CAST(sum(strlen(concat(name, chr(9), state))) AS BIGINT) AS n_bytes, count(DISTINCT state) AS n_regions FROM cities GROUP BY 1")
def agg_shard_profile(spark, d):
    return _c(spark, d).groupBy("country").agg(F.count("*").alias("n"), F.sum(F.octet_length(F.concat_ws("\t", "name", "state")).cast("bigint")).alias("n_bytes"), F.countDistinct("state").alias("n_regions"))


@R.add("join_tier_annotate", C + ", tier AS (SELECT city_id, CAST(row_number() OVER (ORDER BY population DESC, city_id) AS INT) AS rank FROM cities QUALIFY rank <= 200) SELECT city_id, rank, CASE WHEN rank <= 50 THEN '1A' WHEN rank <= 100 THEN '1B' WHEN rank <= 200 THEN '1C' END AS tier FROM cities LEFT JOIN tier USING (city_id)")
def join_tier_annotate(spark, d):
    return _c(spark, d).select("city_id").join(F.broadcast(tiers(spark, d)), "city_id", "left").select("city_id", "rank", "tier")


def tiers(spark, d):
    """The manifest of 200 ranked cities."""
    top = _c(spark, d).orderBy(F.desc("population"), "city_id").limit(200)
    r = F.row_number().over(Window.orderBy(F.desc("population"), "city_id"))
    return top.select("city_id", "name", r.alias("rank")).withColumn("tier", F.when(F.col("rank") <= 50, "1A").when(F.col("rank") <= 100, "1B").otherwise("1C"))


_PATHS = "^/wetbulb-temperature/[a-z0-9-]+/[a-z0-9-]+/[a-z0-9-]+/$"


@R.add("validate_tier_manifest", C + f""", {DEDUPED}, t AS (SELECT city_id, path, row_number() OVER (ORDER BY population DESC, city_id) AS rank FROM ded QUALIFY rank <= 200), m AS (SELECT *, CASE WHEN rank <= 50 THEN '1A' WHEN rank <= 100 THEN '1B' ELSE '1C' END AS tier, rank <= 40 AS popular FROM t)
SELECT 'rows' AS rule, abs(count(*) - 200) AS violations FROM m UNION ALL SELECT 'ranks', count(*) - count(DISTINCT rank) + count(*) FILTER (rank NOT BETWEEN 1 AND 200) FROM m
UNION ALL SELECT 'tier 1A', abs(count(*) FILTER (tier = '1A') - 50) FROM m UNION ALL SELECT 'tier 1B', abs(count(*) FILTER (tier = '1B') - 50) FROM m UNION ALL SELECT 'tier 1C', abs(count(*) FILTER (tier = '1C') - 100) FROM m
UNION ALL SELECT 'tier of rank', count(*) FILTER (tier <> CASE WHEN rank <= 50 THEN '1A' WHEN rank <= 100 THEN '1B' ELSE '1C' END) FROM m UNION ALL SELECT 'popular', abs(count(*) FILTER (popular) - 40) FROM m
UNION ALL SELECT 'paths', count(*) - count(DISTINCT path) + count(*) FILTER (NOT regexp_matches(path, '{_PATHS}')) FROM m""")
def validate_tier_manifest(spark, d):
    """Violations of each rule by the manifest of 200 ranked cities with their paths, of which 40 are popular."""
    m = tiers(spark, d).join(deduped(spark, d).select("city_id", "path"), "city_id").withColumn("popular", F.col("rank") <= 40)
    return inv.tier_violations(m, _PATHS)


@R.add("select_popular", C + " SELECT city_id, name FROM (SELECT city_id, name, row_number() OVER (ORDER BY population DESC, city_id) AS r FROM cities) WHERE r <= 40")
def select_popular(spark, d):
    return tiers(spark, d).where("rank <= 40").select("city_id", "name").orderBy("name", "city_id")


@R.add("win_ordered_directory", C + f", {DEDUPED} SELECT country, path, CAST(row_number() OVER (PARTITION BY country ORDER BY name, path) AS INT) AS nth FROM ded")
def win_ordered_directory(spark, d):
    rows = deduped(spark, d).select("country", "path", F.collate("name", "UNICODE").alias("name"))
    return grouped_rank(rows, ["country"], ["name", "path"], "nth").select("country", "path", (F.col("nth") + 1).cast("int").alias("nth"))


@R.add("win_shard_slice", C + " SELECT city_id FROM (SELECT city_id, row_number() OVER (ORDER BY city_id) AS r FROM cities) WHERE (r - 1) % 7 = 3")
def win_shard_slice(spark, d):
    """Every seventh row from the fourth, by a rank counted across partitions."""
    return global_rank(_c(spark, d).select("city_id"), "city_id", "nth").where("nth % 7 = 3").select("city_id")


@R.add("join_search_match", C + f", {DEDUPED}, qs AS (SELECT n_nationkey AS q, concat('city ', CAST(n_nationkey % 12 AS VARCHAR), CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE ', b' END) AS query FROM nation), idx AS (SELECT city_id, lower(concat_ws(', ', name, state, country)) AS label FROM ded) SELECT q, coalesce((SELECT min(city_id) FROM idx WHERE label = query), (SELECT min(city_id) FROM idx WHERE contains(label, query))) AS city_id FROM qs")
def join_search_match(spark, d):
    """Each logged query's exact label, else the first label that contains it."""
    n = F.col("n_nationkey")
    log = fx.table(spark, d, "nation").select(n.alias("q"), F.concat(F.lit("city "), (n % 12).cast("string"), F.when(n % 2 == 0, "").otherwise(", b")).alias("query"))
    index = _c(spark, d).select("city_id", F.lower(F.concat_ws(", ", "name", "state", "country")).alias("label"))
    return inv.search_match(log, index).select("q", "city_id")
