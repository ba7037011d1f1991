"""Sessions: events of a key of which each follows the one before it within a gap, as a stream and as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_stream(events: DataFrame, key: str = "user_id", time: str = "ts", gap_seconds: int = 1800, late: str = "1 hour") -> DataFrame:
    """(key, session_start, session_end, n) of a stream. A session is given out when the watermark has passed its end; until
    then a late event may join two of them."""
    timed = events.where(F.col(key).isNotNull()).withWatermark(time, late)
    return timed.groupBy(F.session_window(time, f"{gap_seconds} seconds").alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap_seconds: int = 1800) -> DataFrame:
    """The same of a table; session_end is the last event and the gap, as it is of the stream's.

    Events of a key in one bin of the gap's width are in one session, so they are aggregated before they move, and a key
    with any number of events has no more rows to sort than its time has bins.
    """
    micros = gap_seconds * 1_000_000
    number = F.unix_micros(F.col(time).cast("timestamp"))
    bins = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key, F.floor(number / F.lit(micros)).alias("_b")).agg(F.min(number).alias("_s"), F.max(number).alias("_e"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(key).orderBy("_b")
    opens = F.coalesce(F.col("_s") - F.lag("_e").over(order) > micros, F.lit(True)).cast("int")
    named = bins.withColumn("_opens", opens).withColumn("_session", F.sum("_opens").over(order))
    own = named.groupBy(key, "_session").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("n").alias("n"))
    return own.select(key, F.timestamp_micros("_s").alias("session_start"), F.timestamp_micros(F.col("_e") + micros).alias("session_end"), "n")
