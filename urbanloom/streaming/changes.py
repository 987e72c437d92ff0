"""The change feed as a stream: changes go into a log that is idempotent by batch, states are read from the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from urbanloom.operators.change_feed import apply_changes


def log_changes(stream: DataFrame, log: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends a stream of changes to the folder ``log``, one subfolder per batch; a batch that is repeated replaces its own.

    As changes may come in any order, nothing is applied on arrival: ``current_state`` orders the whole log by the points of
    time. With ``once`` the query ends when what is there has been read.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_state(spark: SparkSession, log: str, key: str, at: str, row_id: str, kind: str, values: list[str] | None = None) -> DataFrame:
    """State of every key after all changes in the log; see ``apply_changes``."""
    return apply_changes(spark.read.parquet(log), key, at, row_id, kind, values)


def changes_by_window(stream: DataFrame, at: str, kind: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Changes per window of time and type; what comes later than ``late`` after the newest change is left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("window"), F.col(kind)).agg(F.count("*").alias("n"))
