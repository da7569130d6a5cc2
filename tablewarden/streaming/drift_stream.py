"""Drift of arriving rows against stored training histograms, by micro-batch or by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewarden.operators.drift import psi_against_histograms, psi_per_window


def watch_drift(
    stream: DataFrame, histograms: DataFrame, output_path: str, checkpoint_path: str, **trigger
) -> StreamingQuery:
    """Write ``batch_id, column, psi, severity`` of every micro-batch that drifted.

    A batch that is run again after a failure replaces its own rows, so results hold each
    batch once. ``trigger`` goes to the stream writer, e.g. ``availableNow=True``.
    """

    def measure(batch: DataFrame, batch_id: int) -> None:
        found = psi_against_histograms(batch, histograms).withColumn("batch_id", F.lit(batch_id))
        (
            found.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(output_path)
        )

    writer = stream.writeStream.foreachBatch(measure).option("checkpointLocation", checkpoint_path)
    return (writer.trigger(**trigger) if trigger else writer).start()


def watch_window_drift(
    stream: DataFrame,
    histograms: DataFrame,
    output_path: str,
    checkpoint_path: str,
    time: str,
    width: str,
    late: str,
    **trigger,
) -> StreamingQuery:
    """Write ``window_start, window_end, column, psi, severity`` of every event-time window that drifted.

    A window is written once, when the newest row is ``late`` past its end; rows that come until
    then count, later ones are dropped. The state is one row of bin counts per open window and
    column. Windows that no row has passed yet stay in the state. What is written equals
    ``psi_per_window`` over a table of the rows that were not dropped.
    """
    found = psi_per_window(stream, histograms, time, width, late)
    writer = (
        found.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output_path)
        .option("checkpointLocation", checkpoint_path)
    )
    return (writer.trigger(**trigger) if trigger else writer).start()
