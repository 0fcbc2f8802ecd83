"""Geographic column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance; the root's argument is clipped to 1."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def normalize_lon(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def wrapped_lon_distance(a: Column, b: Column) -> Column:
    """Absolute longitude difference across the date line."""
    return F.abs(F.pmod(a - b + 540, F.lit(360.0)) - 180)


def geo_cell(deg: Column, size: float) -> Column:
    return F.floor(deg / size).cast("int")


def wrap_cell(col: Column, size: float) -> Column:
    return F.pmod(col, F.lit(round(360 / size))).cast("int")


def merra2_cell(lat: Column, lon: Column) -> Column:
    """Struct (row, col) of the nearest 0.5 x 0.625 degree cell in exact decimals; null on an exact edge."""
    y = (lat.cast("decimal(9,5)") + F.lit(90)) / F.lit("0.5").cast("decimal(4,3)")
    x = (lon.cast("decimal(9,5)") + F.lit(180)) / F.lit("0.625").cast("decimal(4,3)")
    half = F.lit("0.5").cast("decimal(2,1)")
    whole = lambda v: F.floor(v + half).cast("int")
    return F.when((y % 1 != half) & (x % 1 != half), F.struct(whole(y).alias("row"), F.pmod(whole(x), F.lit(576)).alias("col")))


def coordinate_suffix(lat: Column, lon: Column) -> Column:
    """Four fixed digits each; the first minus becomes s or w, the first point a dash."""
    part = lambda v, s: F.regexp_replace(F.regexp_replace(F.format_string("%.4f", v), "^-", s), r"^([^.]*)\.", "$1-")
    return F.concat_ws("-", part(lat, "s"), part(lon, "w"))


def cell_id(lat: Column, lon: Column) -> Column:
    """lat:lon with four fixed digits, without a minus before zero."""
    fixed = lambda v: F.regexp_replace(F.format_string("%.4f", v), r"^-(0\.0000)$", "$1")
    return F.concat_ws(":", fixed(lat), fixed(lon))


def format_coordinates(lat: Column, lon: Column) -> Column:
    """Text like 12.3456°N, 98.7654°W."""
    side = lambda v, p, n: F.concat(F.format_string("%.4f", F.abs(v)), F.lit("°"), F.when(v >= 0, p).otherwise(n))
    return F.concat_ws(", ", side(lat, "N", "S"), side(lon, "E", "W"))


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)
