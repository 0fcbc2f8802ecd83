"""Readers of the file formats: tab-, comma- and pipe-separated tables, JSON documents and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import guarded
from ..operators.numbering import neighbours

# The columns of the gazetteer's dump.
GEONAMES = "geonameid long, name string, asciiname string, alternates string, latitude double, longitude double, featureClass string, featureCode string, countryCode string, cc2 string, admin1 string, admin2 string, admin3 string, admin4 string, population long, elevation int, dem int, timezone string, modified date"


def geonames(spark: SparkSession, path: str) -> DataFrame:
    """The 19 tab-separated columns; quotes are ordinary characters."""
    return spark.read.csv(path, sep="\t", quote="", schema=GEONAMES)


def populated_places(rows: DataFrame, least: int = 1000) -> DataFrame:
    return rows.where((F.col("featureClass") == "P") & (F.col("population") >= least))


def admin1_keys(lines: DataFrame) -> DataFrame:
    """`CC.ADM<TAB>name` lines as (admin1_key, region)."""
    parts = F.split("value", "\t")
    return lines.select(F.lower(parts[0]).alias("admin1_key"), parts[1].alias("region"))


def country_codes(spark: SparkSession, path: str) -> DataFrame:
    """`Name,Code` rows as (country_key, country)."""
    rows = spark.read.csv(path, header=True, schema="Name string, Code string")
    return rows.select(F.lower("Code").alias("country_key"), F.col("Name").alias("country"))


def station_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Stations with readable numbers, a proper id and coordinates in range."""
    rows = spark.read.csv(path, header=True)
    lat, lon = F.col("LATITUDE").try_cast("double"), F.col("LONGITUDE").try_cast("double")
    ok = F.col("GHCN_ID").rlike("^[A-Z0-9-]{6,20}$") & lat.between(-90, 90) & lon.between(-180, 180)
    return rows.where(ok).select(F.col("GHCN_ID").alias("station_id"), lat.alias("latitude"), lon.alias("longitude"), F.col("ELEVATION").try_cast("double").alias("elevation"), F.col("NAME").alias("name"), F.col("WMO_ID").alias("wmo_id"), F.col("ICAO").alias("icao"))


def observations(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated hourly reports: station, time, three values, each with its quality code; pressure becomes Pa. A value that cannot be read, is
    outside its physical range or has a refused code (not blank, 1 or 5) is null."""
    rows = spark.read.csv(path, header=True, sep="|", quote="")

    def field(name: str, low: float, high: float, factor: int = 1) -> F.Column:
        value = F.col(name).try_cast("double") * factor
        accepted = F.trim(F.coalesce(F.col(f"{name}_Quality_Code"), F.lit(""))).isin("", "1", "5")
        return F.when(accepted & value.between(low, high), value)

    return rows.select(
        F.col("STATION").alias("station_id"), F.to_timestamp("DATE").alias("obs_time"), field("temperature", -100, 70).alias("temperature_c"), field("dew_point_temperature", -110, 70).alias("dew_point_c"),
        field("station_level_pressure", 45000, 110000, 100).alias("pressure_pa"),
    )


def hourly_payloads(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Provider documents, one a line, or with whole_files one JSON array or object a file."""
    hourly = "struct<time:array<string>,temperature_2m:array<double>,dew_point_2m:array<double>,surface_pressure:array<double>>"
    return spark.read.json(path, multiLine=whole_files, schema=f"path long, hourly {hourly}, hourly_units struct<temperature_2m:string>, utc_offset_seconds int")


MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


def power_climatology(docs: DataFrame, version: str | None = None, period: str | None = None) -> DataFrame:
    """(cell, months array<double>) of climate documents (cell, value JSON); a fill value or one out of range makes all twelve null. A document whose header is
    not as agreed is an error: time standard and fill value, and where given the version of the service and the period, with its sources and unit."""
    fields = ",".join(f"{m}:double" for m in MONTHS)
    header = "header struct<time_standard:string,fill_value:double,range:string,sources:array<string>,api:struct<version:string>>"
    doc = F.from_json("value", f"{header}, parameters struct<T2MWET:struct<units:string>>, properties struct<parameter:struct<T2MWET:struct<{fields}>>>")
    rows = docs.select("cell", doc.alias("d"))
    months = F.array(*[F.col(f"d.properties.parameter.T2MWET.{m}") for m in MONTHS])
    # Fixed values of the service: local solar time, its fill value, its two sources and its unit.
    good = (F.col("d.header.time_standard") == "LST") & (F.col("d.header.fill_value") == -999)
    if version is not None:
        sources = F.array_sort(F.array_distinct("d.header.sources")) == F.array(F.lit("MERRA2"), F.lit("POWER"))
        good &= (F.col("d.header.api.version") == version) & (F.col("d.header.range") == period) & sources & (F.col("d.parameters.T2MWET.units") == "C")
    checked = F.when(F.coalesce(good, F.lit(False)), months).otherwise(F.raise_error(F.lit("climate document changed")).cast("array<double>"))
    return rows.select("cell", F.when(F.forall(checked, lambda v: v.isNotNull() & v.between(-100, 60)), checked).alias("months"))


def percent(c: F.Column) -> F.Column:
    """`7.49%` as 7.49."""
    return F.regexp_replace(c, "%$", "").try_cast("double")


def gsc_export(spark: SparkSession, path: str) -> DataFrame:
    """A search console table, its click rate as a number."""
    rows = spark.read.csv(path, header=True)
    return rows.withColumn("CTR", percent(F.col("CTR")))


def ga_export(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a date; comment lines and the grand total go."""
    return spark.read.csv(path, header=True, comment="#").where(F.col("Date").rlike(r"^\d{8}$"))


def envelopes(lines: DataFrame) -> DataFrame:
    """Events inside JSON envelopes: logs[].message[0] is itself JSON. Lines that cannot be read give no rows."""
    outer = F.from_json("value", "logs array<struct<message:array<string>>>")
    inner = lines.select(F.explode(F.transform(F.col("o.logs") if "o" in lines.columns else outer["logs"], lambda x: x["message"][0])).alias("m"))
    event = F.from_json("m", "event string, outcome string, provider string, key string, ts timestamp")
    return inner.select(event.alias("e")).where("e.event is not null").select("e.*")


def run_index(lines: DataFrame) -> DataFrame:
    """JSON-lines field index: forecasts of the operational stream at the surface with a positive length; bad lines are skipped. Lines with the run (a time)
    and the step that their file is for count only where they name the same date, hour and step: an index of another run left in place lists nothing."""
    row = F.from_json("value", "date string, time string, type string, stream string, levtype string, param string, step int, _length long")
    named = [c for c in ("run", "for_step") if c in lines.columns]
    rows = lines.select(*named, row.alias("r")).where("r.type = 'fc' and r.stream = 'oper' and r.levtype = 'sfc' and r._length > 0 and r.param is not null")
    if named:
        rows = rows.where((F.col("r.date") == F.date_format("run", "yyyyMMdd")) & (F.col("r.time") == F.date_format("run", "HH00")) & (F.col("r.step") == F.col("for_step")))
    return rows.select(*[c for c in named if c == "run"], "r.date", "r.time", "r.param", "r.step", F.col("r._length").alias("length"))


#: Where a published snapshot may hold a field: the first path that is there counts. These are the names of two document formats.
META = {
    "initialization": ("$.model.initialization", "$.discovery.initialization", "$.initialization"),
    "valid_from": ("$.validFrom", "$.model.validTimeBounds.start"),
    "valid_to": ("$.validTo", "$.model.validTimeBounds.end"),
}


def snapshot_meta(rows: DataFrame, doc: str) -> DataFrame:
    """Rows with initialization, valid_from and valid_to (times; null where they are not proper UTC times), published (the count, or the length of the list)
    and availability of a JSON document: invalid if its window is missing or reversed."""
    found = {name: F.coalesce(*[F.get_json_object(doc, path) for path in paths]) for name, paths in META.items()}
    time = lambda c: F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{3})?Z$"), c.try_cast("timestamp"))
    out = rows.select("*", *[time(c).alias(name) for name, c in found.items()])
    count = F.get_json_object(doc, "$.counts.published").try_cast("int")
    listed = F.json_array_length(F.get_json_object(doc, "$.hotspots"))
    bad = F.col("valid_from").isNull() | F.col("valid_to").isNull() | (F.col("valid_from") >= F.col("valid_to"))
    return out.withColumn("published", F.coalesce(F.when(count >= 0, count), listed)).withColumn("availability", F.when(bad, "invalid").otherwise("published")).drop(doc)


def byte_ranges(lines: DataFrame, requested: list[tuple[str, str]] | None = None) -> DataFrame:
    """(file, field, level, start, end) of a colon-separated inventory (file, line): a record ends before the next begins; the last one has no end and goes.
    Lines that cannot be read are skipped. With `requested` (field, level), only these, and a file that has not exactly one record of each is an error."""
    p = F.split("value", ":")
    rows = lines.where(F.size(p) >= 6).select("file", "line", F.get(p, F.lit(1)).try_cast("long").alias("start"), F.get(p, F.lit(3)).alias("field"), F.get(p, F.lit(4)).alias("level")).where("start is not null")
    records = neighbours(rows, ["file"], ["line"], ["start"], "next_", ahead=True).withColumn("end", F.col("next_.start") - 1).where("end is not null").drop("next_")
    if requested is None:
        return records
    wanted = lines.select("file").distinct().withColumn("w_", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(l).alias("level")) for f, l in requested]))).select("file", "w_.field", "w_.level")
    counts = records.groupBy("file", "field", "level").agg(F.count("*").alias("n"), F.first(F.struct("line", "start", "end")).alias("r"))
    picked = guarded(wanted.join(counts, ["file", "field", "level"], "left"), {"an inventory has not exactly one record of a requested field": ~F.coalesce(F.col("n") == 1, F.lit(False))})
    return picked.select("file", "r.line", "r.start", "field", "level", "r.end")
