"""All queries of the library, by name, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analysis, columns, forecasts, inventories, streams, verification, weather
from .session import ship

REGISTRIES = [weather.R, columns.R, forecasts.R, verification.R, inventories.R, analysis.R, streams.R]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["pipe_global_grid_top50"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(f):
        return lambda spark, sf_dir: f(ship(spark), sf_dir)

    return {name: bound(f) for r in REGISTRIES for name, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in REGISTRIES for name, sql in r.sql.items()}
