"""Extension: observations as a stream. A scalar Kalman filter per key, and windowed summaries with late data.

The filter is an associative fold in information form (a precision and a precision-weighted sum), so the same state
serves batches and streams: a stream keeps two sums per key in Spark's own aggregation state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(sums: DataFrame, noise: Column | float, prior_mean: Column | float, prior_variance: Column | float) -> DataFrame:
    """sums (..., n, s) of observations with mean and variance of their posterior: sums of parts add up to those of the whole."""
    noise, prior_mean, prior_variance = (x if isinstance(x, Column) else F.lit(float(x)) for x in (noise, prior_mean, prior_variance))
    precision = 1 / prior_variance + F.col("n") / noise
    return sums.withColumns({"mean": (prior_mean / prior_variance + F.coalesce("s", F.lit(0.0)) / noise) / precision, "variance": 1 / precision})


def posterior(seen: DataFrame, key: str, value: str, noise: float, prior_mean: float, prior_variance: float) -> DataFrame:
    """(key, n, mean, variance): works on batches and streams alike."""
    g = seen.groupBy(key).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    return settled(g, noise, prior_mean, prior_variance).select(key, "n", "mean", "variance")


def windows(seen: DataFrame, time: str, value: str, key: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(key, start, n, total): tumbling windows, closed when the watermark passes them."""
    return seen.withWatermark(time, late).groupBy(key, F.window(time, length)).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("window.start").alias("start"), "n", "total")
