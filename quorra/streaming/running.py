"""Running statistics of a stream: the batch aggregates, kept incrementally by the state store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def statistics(value: str) -> list[Column]:
    """count, mean, population variance and std, share above zero: all merge from partial states."""
    x = F.col(value)
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"), F.stddev_pop(x).alias("std"), (F.count_if(x > 0) / F.greatest(F.count(x), F.lit(1))).alias("p_nonzero")]


def running_statistics(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Statistics by key; on a stream use output mode update or complete."""
    return stream.groupBy(key).agg(*statistics(value))


def windowed_statistics(stream: DataFrame, key: str, value: str, time: str = "ts", size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """The same by event-time window; rows later than the watermark are left out on a stream."""
    frame = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(frame, key).agg(*statistics(value))
