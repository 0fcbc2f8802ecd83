"""Gridded-forecast analytics on long tables: one row for each cell and step."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, physics
from .checks import guarded
from .numbering import global_rank

FIELDS = ["temperature_k", "dew_point_k", "pressure_pa"]
#: An axis travels with the plan to every task up to so many values; a longer one is an error, as no grid has one.
AXIS_ROWS = 100_000


def interpolate_hourly(grid: DataFrame, first: int | None = None, last: int | None = None, strict: bool = False) -> DataFrame:
    """Linear interpolation of the three fields between a cell's steps to every hour in [first, last].

    Hours outside a cell's steps give no row; strict raises an error for a cell whose steps do not bracket the window. One
    shuffle by cell; wet bulb is computed afterwards, never interpolated."""
    w = Window.partitionBy("cell_row", "cell_col").orderBy("step")
    nxt = F.lead(F.struct("step", *FIELDS)).over(w)
    spans = grid.withColumn("next_", nxt).withColumn("hours_", F.when(F.col("next_").isNull(), F.array("step")).otherwise(F.sequence(F.col("step"), F.col("next_.step") - 1)))
    hours = spans.select("*", F.explode("hours_").alias("hour"))
    part = (F.col("hour") - F.col("step")) / (F.col("next_.step") - F.col("step"))
    fields = [F.when(F.col("hour") == F.col("step"), F.col(c)).otherwise(F.col(c) + (F.col(f"next_.{c}") - F.col(c)) * part).alias(c) for c in FIELDS]
    out = hours.select("cell_row", "cell_col", "lat", "lon", "init", "hour", F.timestamp_add("HOUR", F.col("hour"), F.col("init")).alias("valid_time"), *fields)
    if first is not None:
        out = out.where(F.col("hour") >= first)
    if last is not None:
        out = out.where(F.col("hour") <= last)
    if strict:
        cell = Window.partitionBy("cell_row", "cell_col")
        whole = (F.min("hour").over(cell) == first) & (F.max("hour").over(cell) == last)
        out = out.withColumn("hour", F.when(whole, F.col("hour")).otherwise(F.raise_error(F.lit("steps do not bracket the window"))))
    return out


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def warm_finite(grid: DataFrame) -> DataFrame:
    """Rows whose three fields are finite and whose air is above the triple point."""
    return grid.where(reduce(lambda a, b: a & b, [finite(F.col(c)) for c in FIELDS]) & (F.col("temperature_k") > physics.TRIPLE_K))


def with_wet_bulb(grid: DataFrame) -> DataFrame:
    """Adds wet_bulb_k, the thermodynamic wet bulb from the dew point."""
    return grid.withColumn("wet_bulb_k", physics.wetbulb_romps_dewpoint(F.col("pressure_pa"), F.col("temperature_k"), F.col("dew_point_k")))


def cell_peak(grid: DataFrame, value: str = "wet_bulb_k", step: str = "step", keys: tuple[str, ...] = ("cell_row", "cell_col", "lat", "lon")) -> DataFrame:
    """Each cell's greatest value with the fields, step and time there; the earliest step wins ties. NaN is no value."""
    rows = grid.where(finite(F.col(value)))
    best = F.max_by(F.struct(value, *FIELDS, F.col(step).alias("peak_step"), F.col("valid_time").alias("peak_time")), F.struct(F.col(value), -F.col(step)))
    return rows.groupBy(*keys).agg(best.alias("p")).select(*keys, "p.*")


def hottest_cells(peaks: DataFrame, n: int = 50, value: str = "wet_bulb_k") -> DataFrame:
    """The n hottest cells by value descending, then latitude and longitude, with rank 1..n."""
    top = peaks.orderBy(F.desc(value), "lat", "lon").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), "lat", "lon")))


def ranked_cells(peaks: DataFrame, value: str = "wet_bulb_k") -> DataFrame:
    """All cells with their rank from 1 in the order of hottest_cells, counted across range partitions."""
    order = F.struct((-F.col(value)).alias("a"), F.col("lat").alias("b"), F.col("lon").alias("c"))
    ranked = global_rank(peaks.withColumn("order_", order), "order_", "rank")
    return ranked.withColumn("rank", (F.col("rank") + 1).cast("int")).drop("order_")


def land_cells(peaks: DataFrame, mask: DataFrame, least: float = 0.5) -> DataFrame:
    return peaks.join(mask.where(F.col("fraction") >= least).select("cell_row", "cell_col"), ["cell_row", "cell_col"])


def land_maximum(land: DataFrame, value: str = "wet_bulb_k") -> DataFrame:
    """One row: the hottest land cell, the first in row-major order of equal ones, and the number of cells."""
    best = F.max_by(F.struct("cell_row", "cell_col", F.col(value).alias("max_value")), F.struct(F.col(value), -F.col("cell_row"), -F.col("cell_col")))
    return land.agg(best.alias("b"), F.count("*").alias("n_cells")).select("b.*", "n_cells")


def hot_cells(land: DataFrame, value: str = "wet_bulb_k", margin: float = 2.0, threshold: float = 299.15) -> DataFrame:
    """Land cells within margin of the hottest or at least at threshold. The maximum is one row, joined as such."""
    top = land.agg(F.max(value).alias("top_"))
    return land.join(F.broadcast(top), (F.col(value) >= F.col("top_") - margin) | (F.col(value) >= threshold)).drop("top_")


def dilate_cells(cells: DataFrame, rings: int, n_rows: int, n_cols: int) -> DataFrame:
    """Distinct cells within `rings` steps in any direction; columns wrap around, rows do not."""
    side = F.array(*[F.lit(i) for i in range(-rings, rings + 1)])
    grown = cells.select("cell_row", "cell_col").select("*", F.explode(side).alias("dr")).select("*", F.explode(side).alias("dc"))
    grown = grown.select((F.col("cell_row") + F.col("dr")).alias("cell_row"), F.pmod(F.col("cell_col") + F.col("dc"), F.lit(n_cols)).cast("int").alias("cell_col"))
    return grown.where(F.col("cell_row").between(0, n_rows - 1)).distinct()


def _axis(values: DataFrame, index: str, value: str) -> list[tuple[float, int]]:
    """The axis as sorted (value, index), the least index of equal values."""
    rows = values.groupBy(F.col(value).cast("double").alias("v")).agg(F.min(F.col(index).cast("int")).alias("i")).orderBy("v").limit(AXIS_ROWS + 1).collect()
    if len(rows) > AXIS_ROWS:
        raise ValueError(f"an axis has more than {AXIS_ROWS} values")
    return [(r.v, r.i) for r in rows]


def nearest_cell(points: DataFrame, lats: DataFrame, lons: DataFrame, key: str) -> DataFrame:
    """Adds cell_row and cell_col of the nearest row and column axis values, the first of equal ones; points without a coordinate get null.

    lats (cell_row, lat) and lons (cell_col, lon) are the two axes of one grid, of at most AXIS_ROWS values. Points are searched in the
    sorted axes in Arrow batches, where they are read: nothing is shuffled, and the work a point is the logarithm of an axis."""
    rows, cols = _axis(lats, "cell_row", "lat"), _axis(lons, "cell_col", "lon")

    def nearest(axis: list[tuple[float, int]], wraps: bool):
        at, index = np.array([v for v, _ in axis], float), np.array([i for _, i in axis], np.int64)
        if wraps:
            at = (at + 180) % 360 - 180
            order = np.lexsort([index, at])
            at, index = at[order], index[order]
            at, index = np.concatenate([at[-1:] - 360, at, at[:1] + 360]), np.concatenate([index[-1:], index, index[:1]])

        def pick(c: pd.Series) -> pd.Series:
            x = c.to_numpy(dtype=float, na_value=np.nan)
            x = (x + 180) % 360 - 180 if wraps else x
            right = np.clip(np.searchsorted(at, x), 1, len(at) - 1) if len(at) > 1 else np.zeros(len(x), int)
            left = np.maximum(right - 1, 0)
            a, b = np.round(np.abs(x - at[left]), 9), np.round(np.abs(at[right] - x), 9)
            best = np.where((a < b) | (a == b) & (index[left] < index[right]), index[left], index[right])
            return pd.Series(best).astype("Int64").where(~np.isnan(x), pd.NA)

        return F.pandas_udf(pick, "int")

    if not rows or not cols:
        return points.withColumn("cell_row", F.lit(None).cast("int")).withColumn("cell_col", F.lit(None).cast("int"))
    return points.withColumn("cell_row", nearest(rows, False)(F.col("latitude").cast("double"))).withColumn("cell_col", nearest(cols, True)(F.col("longitude").cast("double")))


def public_grid(ranked: DataFrame, hours: int = 3) -> DataFrame:
    """Publication form of ranked cells: hPa, longitudes in [-180, 180), the end of the peak's interval."""
    lon = F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon"))
    return ranked.select("rank", F.col("lat").alias("latitude"), lon.alias("longitude"), (F.col("pressure_pa") / 100).alias("pressure_hpa"), "peak_time", F.timestamp_add("HOUR", F.lit(hours), F.col("peak_time")).alias("until"))


def valid_snapshot(ranked: DataFrame, most: int = 50) -> DataFrame:
    """The ranked list itself; an error where its ranks are not 1 to its length, at most `most`, a cell stands twice, or a value is missing. The list is
    short, so that its rows are counted over one window."""
    whole = Window.partitionBy()
    n, cell = F.count("*").over(whole), F.count("*").over(Window.partitionBy("cell_row", "cell_col"))
    ranks = (F.min("rank").over(whole) == 1) & (F.max("rank").over(whole) == n) & (n <= most)
    good = ranks & (cell == 1) & F.col("wet_bulb_k").isNotNull() & F.col("peak_time").isNotNull()
    return ranked.withColumn("rank", F.when(good, F.col("rank")).otherwise(F.raise_error(F.lit("not a valid snapshot")).cast("int")))


def model_comparison(a: DataFrame, b: DataFrame, candidates_a: DataFrame, candidates_b: DataFrame, path: str = "path", tops: tuple[int, ...] = (20, 50)) -> DataFrame:
    """One row on two models' ranked cells (rank, lat, lon, wet_bulb_k) and candidate places (path): how many of the first n coordinates they share, the
    hottest cell of each, and how many candidates both have, or one alone. Two lists without cells are not compared: that is an error."""
    cells = lambda d: d.select("rank", F.round("lat", 4).alias("lat"), F.round(geo.normalize_lon(F.col("lon")), 4).alias("lon"))
    x, y = cells(a).withColumnRenamed("rank", "rank_a"), cells(b).withColumnRenamed("rank", "rank_b")
    met = x.join(y, ["lat", "lon"]).agg(*[F.countDistinct(F.when((F.col("rank_a") <= n) & (F.col("rank_b") <= n), F.struct("lat", "lon"))).alias(f"top{n}_overlap") for n in tops])
    first = lambda d, side: d.agg(F.min_by(F.struct("lat", "lon", "wet_bulb_k"), "rank").alias("t")).select(*[F.col(f"t.{c}").alias(f"{c}_{side}") for c in ("lat", "lon", "wet_bulb_k")])
    places = lambda d, side: d.select(path).distinct().withColumn(f"in_{side}", F.lit(True))
    both = places(candidates_a, "a").join(places(candidates_b, "b"), path, "full_outer")
    shared = both.agg(
        F.count("in_a").alias("candidates_a"), F.count("in_b").alias("candidates_b"), F.count_if(F.col("in_a") & F.col("in_b")).alias("candidates_both"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b")
    )
    one = met.join(F.broadcast(first(a, "a"))).join(F.broadcast(first(b, "b"))).join(F.broadcast(shared))
    return guarded(one, {"a model has no ranked cells": F.col("wet_bulb_k_a").isNull() | F.col("wet_bulb_k_b").isNull()})
