"""Marginals are sums, so a stream's are kept by a streaming aggregation, windowed where late rows must end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running(stream: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Counts since the start; for the update and complete modes."""
    return stream.groupBy(*attrs).agg(F.count(F.lit(1)).alias("n"))


def windowed(stream: DataFrame, time: str, attrs: Sequence[str], length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window; rows later than the watermark are left out, so the state is bounded."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *attrs).agg(F.count(F.lit(1)).alias("n"))
