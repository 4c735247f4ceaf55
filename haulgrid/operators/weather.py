"""Daily and hourly weather rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_daily_hourly(daily: DataFrame, hourly: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Inner join on site and time; a day is stamped midnight, so it meets its first hour only."""
    return daily.join(hourly, [*keys, "time"])


def hours_to_days(hourly: DataFrame, aggs: Sequence[Column], keys: Sequence[str] = ("site",)) -> DataFrame:
    """Aggregate hourly rows to one row per site and day, stamped midnight."""
    day = F.date_trunc("day", F.col("time")).alias("time")
    return hourly.groupBy(*keys, day).agg(*aggs)
