"""An extra over what batch evaluation offers: metric rows that arrive as a stream, aggregated as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_metrics(metrics: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per window and metric the observed mean and the counts of statuses; rows later than `late` are left out.

    metrics: a streaming (or static) table with ts, metric_id, status, value.
    """
    observed = F.when(F.col("status") == "observed", F.col("value"))
    return (
        metrics.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("window"), "metric_id")
        .agg(F.avg(observed).alias("value"), F.count(observed).alias("denominator"), F.count(F.lit(1)).alias("n"))
    )
