"""Logs as streams, and event-time windows.

The windows are an extension: logs have no event time.  Each function is the same plan for a stream
and for a table, so the tests compare one with the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from veriscope.functions import outcome as O
from veriscope.operators.metrics import count


def follow(spark: SparkSession, path: str, schema: str | StructType, files_at_once: int = 100) -> DataFrame:
    """Files of a growing folder of logs."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def first_answers(log: DataFrame, key: str = "task_id", time: str | None = None, late: str = "1 day") -> DataFrame:
    """One answer a task; with a time column, state is kept only as long as answers may be late."""
    if time is None:
        return log.dropDuplicates([key])
    return log.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counters(log: DataFrame, by: list[str], failure: str = "failure_type") -> DataFrame:
    f = F.col(failure)
    return log.groupBy(*by).agg(F.count("*").alias("answers"), count(O.correct(f)).alias("correct"), count(O.wrong(f)).alias("wrong"), count(O.invalid(f)).alias("invalid"))


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream's event time needs a zone and a watermark; a table needs neither."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    return _timed(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    return _timed(events, late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    return _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet folder; offsets in the checkpoint are where a restart goes on."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
