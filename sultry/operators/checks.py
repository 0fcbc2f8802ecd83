"""Checks that stop a job rather than let rows go missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows of df. The first rule, a message and a condition, that a row meets is an error when the row is read."""
    passes = F.lit(True)
    for message, broken in reversed(rules.items()):
        passes = F.when(broken, F.raise_error(F.lit(message)).cast("boolean")).otherwise(passes)
    return df.where(passes)


def guarded_total(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows of df. Rules are conditions on aggregates of the whole table; the row of these is read with the first rows of df."""
    total = df.agg(*[F.coalesce(broken, F.lit(False)).alias(f"rule{i}_") for i, broken in enumerate(rules.values())])
    checked = guarded(total, {message: F.col(f"rule{i}_") for i, message in enumerate(rules)})
    return df.join(F.broadcast(checked.select(F.lit(True).alias("checked_")))).drop("checked_")
