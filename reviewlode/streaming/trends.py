"""Trends over a stream of reviews: an addition to the batch operators, with the same measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlode.operators.delivery import message_id
from reviewlode.operators.relational import rate


def windowed(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and means of tumbling windows; rows later than the watermark are left out, state is bounded by it."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    out = w.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"), rate(F.col(value) <= 2).alias("low_rate"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "mean_value", "low_rate")


def once(stream: DataFrame, identifier: str, time: str, late: str = "2 days") -> DataFrame:
    """Each message once within the watermark, by the meaning of its identifier; rows without one pass."""
    keyed = stream.withColumn("id_", F.coalesce(F.hex(message_id(identifier)), F.concat(F.lit("-"), F.expr("uuid()"))))
    return keyed.withWatermark(time, late).dropDuplicatesWithinWatermark(["id_"]).drop("id_")
