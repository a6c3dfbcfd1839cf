"""Symbol strings of a stream: event-time windows, late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe.operators import signal


def symbolised(samples: DataFrame, record: str, time: str, order: list[str], value: str = "value", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """start, record, symbols of each window of a record, by the same plan as the batch operator. State is the open windows' samples."""
    timely = samples.withWatermark(time, late).withColumn("_w", F.window(time, window))
    return signal.symbolise(timely, ["_w", record], order, value).select(F.col("_w.start").alias("start"), record, "symbols")
