"""Sessions of events by event time: runs of a user's events with no longer gap than stated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_arriving(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the events in Parquet files as they come into a folder, or under a pattern."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, start, stop (the last event's time plus the gap), n, total: one row per session, of a table or of a stream.

    On a stream ``late`` is how long events may come after newer ones; later ones are dropped, and a session is given, once, when no event can join it
    any more.  Only sessions that are still open are kept as state.
    """
    timed = events.withWatermark("ts", late) if late else events
    found = timed.where("ts is not null").groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select("user_id", F.col("session.start").alias("start"), F.col("session.end").alias("stop"), "n", "total")


def write_closed(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a stream of sessions until the files that are there now are used up; closed sessions are appended to ``path``, each once."""
    return found.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
