"""Web and search analytics: rollups, windows, spikes, cohorts, status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import materialize
from .checks import guarded, guarded_total
from .numbering import neighbours

PRODUCTION = "www.example.org"
#: Values that split a bracket in a round of nearest_ranks, and the rows from which on its values are counted one by one.
PROBES, NEAR = 63, 4096


def production_rows(rows: DataFrame, host: str = PRODUCTION) -> DataFrame:
    """Rows of the production host; a row without a host counts as one."""
    return rows.where(F.coalesce("host_name", F.lit(host)) == host)


def page_rollup(rows: DataFrame) -> DataFrame:
    """Sums by normalized landing page with its type; rows whose page is not set are left out."""
    named = production_rows(rows).where(F.col("landing_page").isNotNull() & (F.col("landing_page") != "(not set)"))
    sums = named.groupBy(text.url_path(F.col("landing_page")).alias("path")).agg(*[F.sum(c).alias(c) for c in ("sessions", "users", "engaged")])
    return sums.withColumn("page_type", text.classify_page(F.col("path")))


def not_set_sessions(rows: DataFrame) -> DataFrame:
    lost = F.col("landing_page").isNull() | (F.col("landing_page") == "(not set)")
    return production_rows(rows).agg(F.coalesce(F.sum(F.when(lost, F.col("sessions"))), F.lit(0)).alias("not_set_sessions"))


def repeat_heavy(pages: DataFrame, least: float = 5.0) -> DataFrame:
    return pages.where((F.col("users") > 0) & (F.col("sessions") / F.col("users") >= least))


def dimension_rollup(rows: DataFrame, dimension: str, metric: str = "sessions") -> DataFrame:
    """Sum of a metric by a dimension, missing values as (not set)."""
    return production_rows(rows).groupBy(F.coalesce(F.col(dimension).cast("string"), F.lit("(not set)")).alias("name")).agg(F.sum(metric).alias(metric))


# The product events, and the failure rates that are told of them.
PRODUCT_EVENTS = (
    "location_search_success", "location_search_no_match", "current_location_success", "current_location_failure", "weather_load_success", "weather_load_failure",
    "forecast_view", "forecast_load_failure", "map_view", "map_interaction", "hotspot_city_click",
)
RATES = {
    "search_no_match": ("location_search_success", "location_search_no_match"), "current_location_failure": ("current_location_success", "current_location_failure"),
    "weather_load_failure": ("weather_load_success", "weather_load_failure"), "forecast_load_failure": ("forecast_view", "forecast_load_failure"),
}


# The fields that each product event may have, and the values that each field may have.
EVENT_FIELDS = {
    "location_search_success": ("search_method",), "location_search_no_match": ("search_method",), "current_location_success": (), "current_location_failure": ("failure_category",),
    "weather_load_success": ("trigger",), "weather_load_failure": ("trigger", "failure_category"), "forecast_view": (), "forecast_load_failure": ("failure_category",),
    "map_view": (), "map_interaction": ("interaction_type",), "hotspot_city_click": ("rank_bucket",),
}
FIELD_VALUES = {
    "search_method": ("static", "places"),
    "trigger": ("page_init", "current_location", "places_search"),
    "failure_category": ("denied", "timeout", "unsupported", "http", "invalid_payload", "network", "unknown"),
    "interaction_type": ("pointer", "keyboard", "zoom"),
    "rank_bucket": ("top_10", "top_25", "top_50", "other"),
}


def allowed_events(rows: DataFrame, event: str = "event", fields: str = "fields") -> DataFrame:
    """Rows of known events, whose fields (a map) are those that the event may have with a value that the field may have. The contract is a few fixed rows."""
    contract = [(e, {f: list(FIELD_VALUES[f]) for f in of}) for e, of in EVENT_FIELDS.items()]
    allowed = rows.sparkSession.createDataFrame(contract, f"{event} string, allowed_ map<string, array<string>>")
    kept = F.map_filter(fields, lambda k, v: F.coalesce(F.array_contains(F.element_at("allowed_", k), v), F.lit(False)))
    return rows.join(F.broadcast(allowed), event).withColumn(fields, kept).drop("allowed_")


def product_events(events: DataFrame, keys: list[str], event: str = "event") -> DataFrame:
    """Counts of the product events by `keys`, a column each, and the share of bad outcomes among good and bad ones, null where there is neither."""
    n = events.groupBy(*keys).agg(*[F.count_if(F.col(event) == e).alias(e) for e in PRODUCT_EVENTS])
    rate = lambda good, bad: F.col(bad) / F.nullif(F.col(good) + F.col(bad), F.lit(0))
    return n.withColumns({f"{name}_rate": rate(*of) for name, of in RATES.items()})


def week_over_week(rows: DataFrame, day: str, week: tuple[str, str], before: tuple[str, str], metrics: list[str]) -> DataFrame:
    """(metric, this_week, week_before, change) of each headline metric; change is in percent, null where the week before has none."""
    total = lambda m, days: F.coalesce(F.sum(F.when(F.col(day).between(*[F.lit(x).cast("date") for x in days]), F.col(m))), F.lit(0)).cast("long")
    one = rows.agg(*[F.struct(F.lit(m).alias("metric"), total(m, week).alias("this_week"), total(m, before).alias("week_before")).alias(m) for m in metrics])
    out = one.select(F.inline(F.array(*metrics)))
    return out.withColumn("change", 100.0 * (F.col("this_week") - F.col("week_before")) / F.nullif("week_before", F.lit(0)))


def alert_quality(rows: DataFrame, key: str, source: str, page: str, least: float = 5.0) -> DataFrame:
    """(key, attribution, not_set_dominates, repeat_heavy, not_set_landing_sessions) of each key's rows: whether the traffic may be called demand for
    anything. A source or page that is not set is the largest single one as any other is."""
    named = attribution(rows, key, source, "sessions")
    not_set = F.col(page).isNull() | (F.col(page) == "(not set)")
    pages = rows.where(~not_set).groupBy(key, text.url_path(F.col(page)).alias("path")).agg(F.sum("sessions").alias("sessions"), F.sum("users").alias("users"))
    heavy = repeat_heavy(pages, least).groupBy(key).agg(F.lit(True).alias("repeat_heavy"))
    lost = rows.groupBy(key).agg(F.coalesce(F.sum(F.when(not_set, F.col("sessions"))), F.lit(0)).alias("not_set_landing_sessions"))
    return named.join(heavy, key, "left").join(lost, key).select(key, "attribution", "not_set_dominates", F.coalesce("repeat_heavy", F.lit(False)).alias("repeat_heavy"), "not_set_landing_sessions")


def search_health(pages: DataFrame, inspections: DataFrame, through: Column, most_days: int = 2) -> DataFrame:
    """(status, latest, inspected, failed) of search data by day and of inspections (outcome, verdict): degraded when the newest data lies more than
    most_days before the day that should be complete, when an inspection failed, or when a verdict is FAIL."""
    data = pages.agg(F.max("day").alias("latest"))
    seen = inspections.agg(F.count_if(F.col("outcome") == "ok").alias("inspected"), F.count_if(~F.col("outcome").eqNullSafe(F.lit("ok"))).alias("failed"), F.coalesce(F.bool_or(F.col("verdict") == "FAIL"), F.lit(False)).alias("refused"))
    bad = F.col("latest").isNull() | (F.datediff(through, F.col("latest")) > most_days) | (F.col("failed") > 0) | F.col("refused")
    return data.join(F.broadcast(seen)).select(F.when(bad, "degraded").otherwise("ok").alias("status"), "latest", "inspected", "failed")


def windows_ending(rows: DataFrame, day: str, through: Column, metrics: list[str], lengths: tuple[int, ...] = (7, 28)) -> DataFrame:
    """Sums over the last and the prior n days that end at a complete day; days without rows count as nothing."""
    age = F.datediff(through, F.col(day))
    aggs = []
    for n in lengths:
        for m in metrics:
            aggs.append(F.coalesce(F.sum(F.when(age.between(0, n - 1), F.col(m))), F.lit(0)).alias(f"last{n}_{m}"))
            aggs.append(F.coalesce(F.sum(F.when(age.between(n, 2 * n - 1), F.col(m))), F.lit(0)).alias(f"prior{n}_{m}"))
    return rows.agg(*aggs)


def complete_through(today: Column, first_incomplete: Column, lag: int = 3) -> Column:
    """The day before the first incomplete one, if that is 1 to lag + 7 days back; else today less the lag."""
    known = F.date_sub(first_incomplete, 1)
    return F.when(F.datediff(today, known).between(1, lag + 7), known).otherwise(F.date_sub(today, lag))


def filled_days(rows: DataFrame, day: str, metric: str, first: Column, last: Column) -> DataFrame:
    """Daily sums from first to last with zero for days without rows."""
    spark = rows.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(first, last)).alias(day))
    return spine.join(rows.groupBy(day).agg(F.sum(metric).alias(metric)), day, "left").withColumn(metric, F.coalesce(metric, F.lit(0)))


def spike_days(days: DataFrame, day: str = "day", value: str = "sessions", n: int = 28, least: int = 100) -> DataFrame:
    """Days whose value stands out from the n days before, with their median and MAD. A day needs all n days of history.

    days: one row for each day without gaps, so the one ordered window covers a row a day."""
    w = Window.orderBy(day).rowsBetween(-n, -1)
    middle = lambda a: (F.get(a, F.lit(n // 2 - 1)) + F.get(a, F.lit(n // 2))) / 2
    rows = days.withColumn("past_", F.sort_array(F.collect_list(value).over(w))).where(F.size("past_") == n)
    rows = rows.withColumn("median", middle(F.col("past_")))
    rows = rows.withColumn("mad", middle(F.sort_array(F.transform("past_", lambda v: F.abs(v - F.col("median"))))))
    v, m = F.col(value), F.col("median")
    return rows.where((v >= least) & (v - m >= least) & ((v >= 2 * m) | (v > m + 4 * F.col("mad")))).drop("past_")


def attribution(rows: DataFrame, key: str, source: str, value: str) -> DataFrame:
    """Of each key the source with the greatest sum (first by name of equal ones); (not set) becomes unknown and is flagged."""
    sums = rows.groupBy(key, source).agg(F.sum(value).alias("v"))
    best = sums.groupBy(key).agg(F.min_by(F.struct(source, "v"), F.struct(-F.col("v"), F.col(source))).alias("b"))
    lost = F.col(f"b.{source}") == "(not set)"
    return best.select(key, F.when(lost, "unknown").otherwise(F.col(f"b.{source}")).alias("attribution"), lost.alias("not_set_dominates"))


def nearest_ranks(rows: DataFrame, group: str, value: str, percents: list[int], least: int = NEAR) -> DataFrame:
    """Rows (group, percent, value): the least value that at least `percent` of a group's values do not exceed, exactly.

    Each group and percent has a bracket of values that holds the wanted rank. A round takes PROBES values that split it about evenly, from a
    sketch of fixed size, counts its rows up to each, and keeps the part between two of them that the rank falls into. When a bracket
    holds `least` rows or one value, its values are counted one by one. No task holds a group, and brackets are a few rows for each group."""
    rows = materialize(rows.select(F.col(group).alias("g_"), F.col(value).alias("v_")).where("v_ is not null").groupBy("g_", "v_").agg(F.count("*").alias("n_")), "values")
    sizes = rows.groupBy("g_").agg(F.sum("n_").alias("in_"), F.min("v_").alias("low"), F.max("v_").alias("high"))
    open_ = sizes.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    # rank counts within the bracket, which is [low, high].
    open_ = open_.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("in_") * F.col("percent") / 100)).cast("long"))
    open_, closed = materialize(open_.select("g_", "percent", "rank", "in_", "low", "high"), "brackets"), []
    small = (F.col("in_") <= least) | (F.col("low") == F.col("high"))
    inside = lambda brackets: rows.join(brackets, rows["g_"].eqNullSafe(brackets["b_"])).where("v_ between low and high")
    shares = [i / (PROBES + 1) for i in range(1, PROBES + 1)]
    while True:
        closed.append(open_.where(small))
        open_ = open_.where(~small)
        if open_.isEmpty():
            break
        named = open_.withColumnRenamed("g_", "b_")
        # Frequent values count once here: probes only have to split what is left of different ones.
        probes = inside(named).groupBy("b_", "percent").agg(F.array_distinct(F.percentile_approx("v_", shares, 1000)).alias("probes"))
        probed = materialize(named.join(probes.withColumnsRenamed({"b_": "p_", "percent": "q_"}), (F.col("b_").eqNullSafe(F.col("p_"))) & (F.col("percent") == F.col("q_"))).drop("p_", "q_"), "probes")
        part = F.size(F.filter("probes", lambda p: p < F.col("v_")))
        counts = inside(probed).groupBy("b_", "percent", part.alias("part")).agg(F.sum("n_").alias("n"), F.min("v_").alias("low"), F.max("v_").alias("high"), F.first("rank").alias("rank"))
        upto = F.sum("n").over(Window.partitionBy("b_", "percent").orderBy("part"))  # at most PROBES + 1 rows
        hit = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        open_ = materialize(hit.select(F.col("b_").alias("g_"), "percent", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), F.col("n").alias("in_"), "low", "high"), "brackets")
    last = inside(reduce(DataFrame.unionByName, closed).withColumnRenamed("g_", "b_"))
    upto = F.sum("n_").over(Window.partitionBy("b_", "percent").orderBy("v_"))
    return last.withColumn("upto", upto).where("upto >= rank").groupBy(F.col("b_").alias(group), "percent").agg(F.min("v_").alias(value))


def latency_summary(rows: DataFrame, status: str, ms: str) -> DataFrame:
    """Count and nearest-rank p50, p95 and maximum by status."""
    ranks = nearest_ranks(rows, status, ms, [50, 95]).withColumnRenamed(status, "s_")
    ranks = ranks.groupBy("s_").agg(*[F.max(F.when(F.col("percent") == p, F.col(ms))).alias(f"p{p}") for p in (50, 95)])
    counts = rows.groupBy(status).agg(F.count("*").alias("n"), F.max(ms).alias("max_ms"))
    return counts.join(ranks, F.col(status).eqNullSafe(F.col("s_")), "left").select(status, "n", "p50", "p95", "max_ms")


def ready_runs(index: DataFrame, run: str, need: list[tuple[int, str]]) -> DataFrame:
    """Runs that list every needed (step, field), newest first by name: relational division on distinct hits."""
    wanted = index.sparkSession.createDataFrame(need, "step int, param string")
    hits = index.select(run, F.col("step").cast("int").alias("step"), "param").distinct().join(F.broadcast(wanted), ["step", "param"])
    return hits.groupBy(run).agg(F.count("*").alias("n")).where(F.col("n") == len(need)).select(run)


def run_readiness(index: DataFrame, runs: DataFrame, fields: list[str], mask: str) -> DataFrame:
    """Rows (run, needed, listed, ready, wins) of runs (run, steps: the steps that each is needed for): a run is ready when its index lists every field for
    each of its steps, and the mask for step 0; of the ready ones the newest wins.

    Runs differ in their needs, so that these are rows, and the division counts what of them the index has."""
    steps = runs.select("run", F.explode("steps").alias("step")).distinct()
    needs = steps.withColumn("param", F.explode(F.array(*[F.lit(f) for f in fields])))
    needs = needs.unionByName(runs.select("run", F.lit(0).alias("step"), F.lit(mask).alias("param"))).distinct()
    listed = index.select("run", F.col("step").cast("int").alias("step"), "param").distinct().withColumn("there", F.lit(True))
    counts = needs.join(listed, ["run", "step", "param"], "left").groupBy("run").agg(F.count("*").alias("needed"), F.count("there").alias("listed"))
    counts = counts.withColumn("ready", F.col("needed") == F.col("listed"))
    newest = counts.where("ready").agg(F.max("run").alias("newest"))
    return counts.join(F.broadcast(newest)).select("run", "needed", "listed", "ready", (F.col("run").eqNullSafe(F.col("newest"))).alias("wins"))


def download_timing(products: DataFrame, timing: DataFrame, run: str = "init") -> DataFrame:
    """Products with first_ready and retrieved of their run's download. A product whose run has no timing, or has it twice, is an error."""
    known = timing.groupBy(run).agg(F.first("first_ready").alias("first_ready"), F.first("retrieved").alias("retrieved"), F.count("*").alias("n_timings"))
    rows = products.join(known, run, "left")
    return guarded(rows, {"a product's run has no download timing": F.col("n_timings").isNull(), "a run has two download timings": F.col("n_timings") > 1}).drop("n_timings")


def cohort_union(tier: DataFrame, controls: DataFrame, key: str, size: int = 400) -> DataFrame:
    """(key, cohort) of both cohorts. Cohorts that share a city, or that are not `size` cities together, are an error."""
    both = tier.select(key, F.lit("tier").alias("cohort")).unionByName(controls.select(key, F.lit("control").alias("cohort")))
    return guarded_total(both, {"cohorts share a city": F.count("*") != F.countDistinct(key), f"cohorts are not {size} cities": F.count("*") != size})


def status_changes(docs: DataFrame, key: str, time: str, fields: list[str]) -> DataFrame:
    """Rows whose fields differ from the key's row before; the first row counts as a change."""
    rows = neighbours(docs, [key], [time], fields, "was_")
    same = reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(F.col(f"was_.{f}")) for f in fields])
    changed = rows.where(F.col("was_").isNull() | ~same)
    return changed.select(*docs.columns, F.col(f"was_.{fields[0]}").alias("before"))


def latest_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Newest row of each key: what an upsert leaves."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def budget_state(used: Column, limit: Column) -> Column:
    ratio = used / F.nullif(limit, F.lit(0))
    return F.when(ratio.isNull(), "unknown").when(ratio >= 1, "down").when(ratio >= 0.9, "degraded").otherwise("ok")


def snapshot_state(now: Column, init: Column, start: Column, end: Column, most_h: int = 18) -> Column:
    """invalid, expired, run_unknown, behind, upcoming or in_window at a clock time."""
    bad = start.isNull() | end.isNull() | (start >= end)
    late = (F.unix_timestamp(now) - F.unix_timestamp(init)) > most_h * 3600
    return F.when(bad, "invalid").when(now >= end, "expired").when(init.isNull(), "run_unknown").when((init > start) | (init > now), "invalid").when(late, "behind").when(now < start, "upcoming").otherwise("in_window")


# How bad each snapshot state is.
STATE_RANK = {"upcoming": 0, "in_window": 0, "not_published": 1, "behind": 2, "unavailable": 2, "run_unknown": 2, "invalid": 3, "expired": 3}


def worst_state(state: Column) -> Column:
    """Aggregate: ok, unknown, degraded or down by the worst state."""
    rank = F.lit(3)
    for name, r in STATE_RANK.items():
        rank = F.when(state == name, r).otherwise(rank)
    return F.element_at(F.array(F.lit("ok"), F.lit("unknown"), F.lit("degraded"), F.lit("down")), F.max(rank) + 1)


def publish_decision(now: Column, new_init: Column, new_start: Column, new_end: Column, init: Column, end: Column) -> Column:
    """newer-run, older-run, same-run-after-expiry, same-run-current, candidate-invalid, candidate-expired or no-valid-current."""
    return (
        F.when(new_init.isNull() | new_start.isNull() | new_end.isNull() | (new_start >= new_end), "candidate-invalid").when(new_end <= now, "candidate-expired").when(init.isNull() | end.isNull(), "no-valid-current")
        .when(new_init < init, "older-run").when(new_init > init, "newer-run").when((now >= end) & (new_start >= end), "same-run-after-expiry").otherwise("same-run-current")
    )


def panel_state(status: Column, collected: Column, attempted: Column, failed: Column, now: Column, most_s: int) -> Column:
    """A panel's status, or stale when it is older than most_s seconds or a later attempt failed; unknown without a result."""
    since = F.coalesce(failed, F.lit(False)) & (attempted > collected)
    return F.when(collected.isNull(), F.when(status == "unavailable", "unavailable").otherwise("unknown")).when(((F.unix_timestamp(now) - F.unix_timestamp(collected)) > most_s) | since, "stale").otherwise(status)


def confirmed_failures(checks: DataFrame, key: str, time: str, categories: str) -> DataFrame:
    """Checks that fail with a category that the check before had too."""
    rows = neighbours(checks, [key], [time], [categories], "was_")
    return rows.withColumn("confirmed", F.coalesce(F.arrays_overlap(F.col(categories), F.col(f"was_.{categories}")), F.lit(False))).drop("was_")
