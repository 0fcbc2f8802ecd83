"""Forecast verification against station observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, physics

HALF_HOUR = 1800


def quality_accept(code: Column) -> Column:
    """Blank, 1 and 5 are accepted."""
    return F.trim(F.coalesce(code, F.lit(""))).isin("", "1", "5")


def clean_observations(obs: DataFrame) -> DataFrame:
    """Fields outside their physical range or with a refused quality code become null."""
    ok = quality_accept(F.col("quality_code"))
    gate = lambda c, a, b: F.when(ok & F.col(c).between(a, b), F.col(c)).alias(c)
    return obs.select("station_id", "obs_time", gate("temperature_c", -100, 70), gate("dew_point_c", -110, 70), gate("pressure_pa", 45000, 110000), "quality_code")


def observed_wet_bulb(obs: DataFrame) -> DataFrame:
    """Adds wet_bulb_c where all three fields are present."""
    wet = physics.wetbulb_romps_dewpoint(F.col("pressure_pa"), F.col("temperature_c") + 273.15, F.col("dew_point_c") + 273.15) - 273.15
    return obs.withColumn("wet_bulb_c", F.round(wet, 6))


def _near(hours: DataFrame, obs: DataFrame) -> DataFrame:
    """Reports within half an hour of a valid time. Both sides fall into hour buckets, a report into each of the at most two hours that it can
    serve, so the join is an equi join on station and hour."""
    secs = F.unix_micros("obs_time") / 1000000
    bucket = lambda s: F.floor(s / 3600)
    reports = obs.select("*", F.explode(F.array_distinct(F.array(bucket(secs - HALF_HOUR), bucket(secs), bucket(secs + HALF_HOUR)))).alias("bucket"))
    slots = hours.withColumn("bucket", bucket(F.unix_micros("valid_time") / 1000000))
    gap = F.abs(F.unix_micros("obs_time") - F.unix_micros("valid_time")) / 1000000
    return slots.join(reports, ["station_id", "bucket"]).withColumn("gap_s", gap).where(F.col("gap_s") <= HALF_HOUR).drop("bucket")


def match_nearest(hours: DataFrame, obs: DataFrame) -> DataFrame:
    """For each station and valid time the nearest report within half an hour, the earlier of equally near ones."""
    first = F.min_by(F.struct(*[c for c in obs.columns if c != "station_id"], "gap_s"), F.struct("gap_s", "obs_time"))
    return _near(hours.select("station_id", "valid_time").distinct(), obs).groupBy("station_id", "valid_time").agg(first.alias("o")).select("station_id", "valid_time", "o.*")


def match_one_to_one(hours: DataFrame, obs: DataFrame) -> DataFrame:
    """Each report serves one hour: hours in time order take the nearest report that is still free, the earlier of equally near ones. Rows
    (station_id, valid_time, gap_s and the report's fields).

    A report can only be in reach of two hours, so that only the report that the hour before took can be missing: each hour's two nearest
    reports decide. Hours that depend on the one before form chains, mostly of one hour, and a chain is folded in its row. Reports are told apart by
    their number among those of one time, so that two reports of one time can serve two hours."""
    fields = [c for c in obs.columns if c != "station_id"]
    numbered = obs.withColumn("nth_", F.row_number().over(Window.partitionBy("station_id", "obs_time").orderBy(*[c for c in fields if c != "obs_time"], F.lit(1))))
    near = _near(hours.select("station_id", "valid_time").distinct(), numbered)
    place = F.row_number().over(Window.partitionBy("station_id", "valid_time").orderBy("gap_s", "obs_time", "nth_"))
    two = near.withColumn("place_", place).where("place_ <= 2")
    report = F.struct("gap_s", "nth_", *fields)
    hour = two.groupBy("station_id", "valid_time").agg(F.max(F.when(F.col("place_") == 1, report)).alias("one"), F.max(F.when(F.col("place_") == 2, report)).alias("two"))
    same = lambda a, b: (a["obs_time"] == b["obs_time"]) & (a["nth_"] == b["nth_"])
    by_time = Window.partitionBy("station_id").orderBy("valid_time")
    before = F.lag(F.struct("one", "two")).over(by_time)
    tied = F.coalesce(same(F.col("one"), F.col("before_.one")), F.lit(False)) | F.coalesce(same(F.col("one"), F.col("before_.two")), F.lit(False))
    chained = hour.withColumn("before_", before).withColumn("starts_", F.when(tied, 0).otherwise(1)).withColumn("chain_", F.sum("starts_").over(by_time))
    rows = chained.groupBy("station_id", "chain_").agg(F.array_sort(F.collect_list(F.struct("valid_time", "one", "two"))).alias("hours_"))
    kind = rows.schema["hours_"].dataType.elementType["one"].dataType.simpleString()
    start = F.struct(F.lit(None).cast(kind).alias("last"), F.array().cast(f"array<struct<valid_time:timestamp,o:{kind}>>").alias("out"))

    def take(acc, h):
        free = F.when(F.coalesce(same(h["one"], acc["last"]), F.lit(False)), h["two"]).otherwise(h["one"])
        return F.struct(free.alias("last"), F.array_append(acc["out"], F.struct(h["valid_time"].alias("valid_time"), free.alias("o"))).alias("out"))

    out = rows.select("station_id", F.explode(F.aggregate("hours_", start, take, lambda acc: acc["out"])).alias("h"))
    return out.where("h.o is not null").select("station_id", "h.valid_time", "h.o.gap_s", *[f"h.o.{c}" for c in fields])


def error_rows(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """Long table of errors, forecast minus observation: model, station_id, valid_time, field, error. pairs has f_<field> and o_<field>."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f"f_{f}") - F.col(f"o_{f}")).alias("error")) for f in fields])
    return pairs.select("model", "station_id", "valid_time", "lead_bin", F.explode(each).alias("e")).select("model", "station_id", "valid_time", "lead_bin", "e.field", "e.error").where("error is not null")


def error_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Count, bias, MAE and RMSE."""
    e = F.col("error")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def exact_avg(c: Column) -> Column:
    """Average of doubles, added as decimals of twelve places: the order of adding, which differs between runs, does not change it, and a figure halfway
    between two rounded ones stays there. A plain average where a value has no such decimal: not finite, or 1e16 and more."""
    exact = c.try_cast("decimal(28,12)")
    return F.when(F.count(exact) == F.count(c), F.avg(exact).cast("double")).otherwise(F.avg(c))


def scorecard(rows: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Metrics by model and field, by station too, by lead bin, and by each of a station's groups (station_id, group), in one pass over the errors.

    A row counts once without a group, for the first three, and once for each group."""
    e = F.col("error")
    if groups is None:
        rows = rows.withColumn("group", F.lit(None).cast("string"))
    else:
        of = groups.groupBy("station_id").agg(F.collect_set("group").alias("groups_"))
        rows = rows.join(of, "station_id", "left").withColumn("group", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("groups_", F.array().cast("array<string>")))))
    sets = [["model", "field", "group"], ["model", "field", "group", "station_id"], ["model", "field", "group", "lead_bin"]]
    cols = ["model", "field", "group", "station_id", "lead_bin"]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(
        F.count("*").alias("n"), exact_avg(e).alias("bias"), exact_avg(F.abs(e)).alias("mae"), F.sqrt(exact_avg(e * e)).alias("rmse"), F.grouping_id().alias("set_")
    )
    return out.where("group is null or station_id is null and lead_bin is null").drop("set_")


def threshold_events(pairs: DataFrame, field: str, thresholds: tuple[float, ...] = (27.0, 30.0, 35.0)) -> DataFrame:
    """Observed events, misses and false alarms of each model at each threshold."""
    f, o, t = F.col(f"f_{field}"), F.col(f"o_{field}"), F.col("threshold")
    rows = pairs.where(f.isNotNull() & o.isNotNull()).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    return rows.groupBy("model", "threshold").agg(F.count_if(o >= t).alias("events"), F.count_if((o >= t) & (f < t)).alias("misses"), F.count_if((o < t) & (f >= t)).alias("false_alarms"))


def pairwise_models(rows: DataFrame, a: str = "ifs", b: str = "gfs") -> DataFrame:
    """By field: paired errors of two models, MAE difference, wins and ties."""
    wide = rows.groupBy("station_id", "valid_time", "field").pivot("model", [a, b]).agg(F.first("error")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    x, y = F.abs(F.col(a)), F.abs(F.col(b))
    return wide.groupBy("field").agg(F.count("*").alias("n"), (F.avg(x) - F.avg(y)).alias("mae_difference"), F.count_if(x < y).alias("wins_a"), F.count_if(x > y).alias("wins_b"), F.count_if(x == y).alias("ties"))


def nearest_station(targets: DataFrame, stations: DataFrame, most_km: float = 100.0) -> DataFrame:
    """The nearest eligible station (with a wmo_id) within most_km of each target (rank, model, lat, lon), ties by station id.

    Stations fall into one-degree rows; a target looks into the rows that its radius can reach, so the join is an equi join."""
    reach = int(most_km / 111.0) + 1
    own = stations.where(F.col("wmo_id").isNotNull()).withColumn("band", F.floor("latitude"))
    asks = targets.select("*", F.explode(F.sequence(F.floor("lat") - reach, F.floor("lat") + reach)).alias("band"))
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    near = asks.join(own, "band").withColumn("km", km).where(F.col("km") <= most_km)
    best = near.groupBy("rank", "model", "lat", "lon").agg(F.min_by(F.struct("station_id", "km"), F.struct("km", "station_id")).alias("s"))
    return best.select("rank", "model", "lat", "lon", "s.station_id", "s.km")


def new_stations(matched: DataFrame, n: int) -> DataFrame:
    """Targets (rank, model, station_id) in order of rank and model, up to the one that brings the n-th new station; is_new marks a station's first
    target. The order is cut at the n-th least of the stations' first targets, so that no task sees the whole list."""
    order = F.struct("rank", "model")
    firsts = matched.groupBy("station_id").agg(F.min(order).alias("first_"))
    last = firsts.orderBy("first_").limit(n).agg(F.max("first_").alias("last_"), F.count("*").alias("found_"))
    rows = matched.join(firsts, "station_id").join(F.broadcast(last)).where((order <= F.col("last_")) | (F.col("found_") < n))
    return rows.withColumn("is_new", order == F.col("first_")).drop("first_", "last_", "found_")
