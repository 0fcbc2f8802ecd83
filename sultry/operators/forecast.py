"""City forecasts: hourly rows to daily local maxima, run merging and ranked snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics, times
from .checks import guarded_total

HOUR_US = 3_600_000_000
#: The most that a local time is from UTC, in seconds.
OFFSET_S = 18 * 3600


def explode_payload(payload: DataFrame, unit: str = "°C") -> DataFrame:
    """Hourly rows of provider documents (path, hourly struct of aligned arrays, hourly_units, utc_offset_seconds). Documents with other units
    or arrays of unequal length give no rows."""
    h = F.col("hourly")
    n = F.size(h["time"])
    aligned = (F.size(h["temperature_2m"]) == n) & (F.size(h["dew_point_2m"]) == n) & (F.size(h["surface_pressure"]) == n)
    rows = payload.where(aligned & (F.col("hourly_units.temperature_2m") == unit))
    zipped = F.arrays_zip(h["time"].alias("time"), h["temperature_2m"].alias("t"), h["dew_point_2m"].alias("td"), h["surface_pressure"].alias("p"))
    return rows.select("path", "utc_offset_seconds", F.posexplode(zipped).alias("hour", "z")).select(
        "path", "hour", F.col("utc_offset_seconds").alias("offset_s"), F.to_timestamp("z.time").alias("valid_time"), F.col("z.t").alias("temperature_c"), F.col("z.td").alias("dew_point_c"), (F.col("z.p") * 100).alias("pressure_pa")
    )


def with_wet_bulb_c(hours: DataFrame) -> DataFrame:
    wet = physics.wetbulb_romps_dewpoint(F.col("pressure_pa"), F.col("temperature_c") + 273.15, F.col("dew_point_c") + 273.15) - 273.15
    return hours.withColumn("wet_bulb_c", F.round(wet, 6))


def _distinct_times(time: Column, near: Column) -> Column:
    """The number of distinct times of a group, null ones aside. `near` says which are within 64 hours of each other: of these, whole hours are bits of
    a number, so that rows are combined before a shuffle; only other times make a set."""
    us = F.unix_micros(time)
    whole = F.coalesce(near & (us % HOUR_US == 0), F.lit(False))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.floor(us / HOUR_US), F.lit(64)).cast("int"))
    return F.bit_count(F.coalesce(F.bit_or(F.when(whole, bit)), F.lit(0).cast("long"))) + F.size(F.collect_set(F.when(~whole, us)))


def _peak(*extra: str) -> Column:
    return F.max_by(F.struct("wet_bulb_c", F.col("valid_time").alias("peak_time"), "temperature_c", "dew_point_c", *extra), F.struct(F.col("wet_bulb_c"), -F.unix_timestamp("valid_time")))


def location_maximum(hours: DataFrame, first: Column, n: int = 24, key: str = "city_id") -> DataFrame:
    """Each location's maximum over n hours from `first`, with the inputs of the earliest hour that has it; only locations
    with all n hours count."""
    rows = hours.where((F.col("valid_time") >= first) & (F.col("valid_time") < F.timestamp_add("HOUR", F.lit(n), first)))
    best = rows.groupBy(key).agg(_peak().alias("p"), F.count("wet_bulb_c").alias("n"), _distinct_times(F.col("valid_time"), F.lit(n <= 64)).alias("d"))
    return best.where((F.col("n") == n) & (F.col("d") == n)).select(key, "p.*")


def daily_complete_maximum(hours: DataFrame, key: str = "city_id") -> DataFrame:
    """Maximum of each local date that has all its 24 hours."""
    day = times.local_date(F.col("valid_time"), F.col("offset_s"))
    time, us = F.when(F.col("wet_bulb_c").isNotNull(), F.col("valid_time")), F.unix_micros("valid_time")
    best = hours.groupBy(key, day.alias("local_day")).agg(F.max(F.struct("wet_bulb_c", (-us).alias("before"))).alias("p"), _distinct_times(time, F.col("offset_s").between(-OFFSET_S, OFFSET_S)).alias("n"))
    return best.where("n = 24").select(key, "local_day", "p.wet_bulb_c", F.timestamp_micros(-F.col("p.before")).alias("peak_time"))


def five_day_remaining(hours: DataFrame, retrieved: Column, key: str = "city_id", days: int = 5) -> DataFrame:
    """Daily maxima of the hours strictly after `retrieved` for today and four more local days; today without a remaining
    hour is a null row. Locations that cannot give all later days are left out."""
    day = times.local_date(F.col("valid_time"), F.col("offset_s"))
    today = times.local_date(retrieved, F.col("offset_s"))
    rows = hours.withColumn("local_day", day).withColumn("today", today)
    spine = rows.groupBy(key).agg(F.first("today").alias("today")).select(key, "today", F.explode(F.expr(f"sequence(today, date_add(today, {days - 1}))")).alias("local_day"))
    best = rows.where(F.col("valid_time") > retrieved).groupBy(key, "local_day").agg(_peak().alias("p"))
    out = spine.join(best, [key, "local_day"], "left").select(key, "local_day", "today", "p.wet_bulb_c", "p.peak_time")
    missing = F.count_if(F.col("wet_bulb_c").isNull() & (F.col("local_day") > F.col("today"))).over(Window.partitionBy(key))
    return out.withColumn("missing_", missing).where("missing_ = 0").drop("missing_", "today")


def merge_runs(spine: DataFrame, pinned: DataFrame, latest: DataFrame, key: str = "city_id") -> DataFrame:
    """For each date of a location's spine the pinned run's day, else the latest run's, labelled; locations with an uncovered date are left
    out, and a location whose runs disagree on the offset takes the latest run only. All carry local_day, wet_bulb_c and offset_s."""
    a = pinned.select(key, "local_day", F.col("wet_bulb_c").alias("a"), F.col("offset_s").alias("oa"))
    b = latest.select(key, "local_day", F.col("wet_bulb_c").alias("b"), F.col("offset_s").alias("ob"))
    w = Window.partitionBy(key)
    rows = spine.join(a, [key, "local_day"], "left").join(b, [key, "local_day"], "left")
    differ = (F.max("oa").over(w) != F.max("ob").over(w)) & F.max("oa").over(w).isNotNull()
    rows = rows.withColumn("differ_", F.coalesce(differ, F.lit(False)))
    own = F.when(~F.col("differ_"), F.col("a"))
    rows = rows.withColumn("wet_bulb_c", F.coalesce(own, "b")).withColumn("run", F.when(own.isNotNull(), "pinned").when(F.col("b").isNotNull(), "latest"))
    return rows.withColumn("gaps_", F.count_if(F.col("wet_bulb_c").isNull()).over(w)).where("gaps_ = 0").select(key, "local_day", "wet_bulb_c", "run")


def rank_by_cell(rows: DataFrame, n: int = 50) -> DataFrame:
    """The hottest row of each model cell, the n hottest of these, ranked; ties by peak time, cell and path."""
    order = [F.desc("wet_bulb_c"), F.col("peak_time"), F.col("cell"), F.col("path")]
    first = rows.withColumn("nth_", F.row_number().over(Window.partitionBy("cell").orderBy(*order))).where("nth_ = 1").drop("nth_")
    top = first.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hash_sample(population: DataFrame, excluded: DataFrame, key: str, salt: str, n: int) -> DataFrame:
    """The n rows outside `excluded` with the lowest SHA-256 of salt, a zero byte and key."""
    rows = population.join(excluded.select(key), key, "left_anti")
    return rows.withColumn("order_key", F.sha2(F.concat(F.lit(salt + "\0"), F.col(key).cast("string")), 256)).orderBy("order_key").limit(n)


def with_controls(population: DataFrame, found: DataFrame, key: str, salt: str, n: int, limit: int | None) -> DataFrame:
    """(key, is_control) of the places found and a sample of n others as controls. More than `limit` together are an error where a provider is asked for each;
    None where none is asked."""
    controls = hash_sample(population, found, key, salt, n)
    both = found.select(key, F.lit(False).alias("is_control")).unionByName(controls.select(key, F.lit(True).alias("is_control")))
    return both if limit is None else guarded_total(both, {f"more than {limit} places to refine": F.count("*") > limit})


def snapshot_violations(ranked: DataFrame, refined: DataFrame, times_: dict[str, Column], most: int = 50) -> DataFrame:
    """(rule, violations) of a snapshot: ranks 1, 2, ... to at most `most`; one place a cell; peaks inside the window; as many published as cells allow,
    all of them refined places; and init <= first_seen <= retrieved < start < end (times_)."""
    t = times_
    outside = (F.col("peak_time") < t["start"]) | (F.col("peak_time") >= t["end"])
    top = ranked.agg((F.count_if(~F.col("rank").between(1, most)) + F.abs(F.count("*") - F.coalesce(F.max("rank"), F.lit(0)))).alias("ranks"), (F.count("*") - F.countDistinct("cell")).alias("cells"), F.count_if(outside).alias("window"), F.count("*").alias("published"))
    whole = refined.agg(F.countDistinct("cell").alias("n_cells"), F.count("*").alias("n"), F.countDistinct("path").alias("n_paths"))
    stray = ranked.join(refined.select("path"), "path", "left_anti").agg(F.count("*").alias("stray"))
    late = F.coalesce((t["init"] <= t["first_seen"]) & (t["first_seen"] <= t["retrieved"]) & (t["retrieved"] < t["start"]) & (t["start"] < t["end"]), F.lit(False))
    one = top.join(F.broadcast(whole)).join(F.broadcast(stray))
    counts = F.abs(F.col("published") - F.least(F.lit(most), F.col("n_cells"))) + F.col("stray") + F.col("n") - F.col("n_paths")
    return one.select("ranks", "cells", "window", counts.alias("counts"), F.when(late, 0).otherwise(1).cast("long").alias("times")).unpivot([], ["ranks", "cells", "window", "counts", "times"], "rule", "violations")


def payload_coverage(hours: DataFrame, first: Column, key: str = "city_id") -> DataFrame:
    """Whether a location has 24 distinct hours in the window and 24 in each of the five local days from its first full one."""
    inside = (F.col("valid_time") >= first) & (F.col("valid_time") < F.timestamp_add("HOUR", F.lit(24), first))
    day = times.local_date(F.col("valid_time"), F.col("offset_s"))
    per_day = hours.groupBy(key, day.alias("local_day")).agg(F.countDistinct("valid_time").alias("n"), F.count_if(inside).alias("w"))
    return per_day.groupBy(key).agg(F.sum("w").alias("window_hours"), F.count_if(F.col("n") == 24).alias("full_days"))
