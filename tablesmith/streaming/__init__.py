"""Streaming, an extra: the stateless cleaning operators (Select, RenameFields,
RemoveFields, Map, AddFields, Filter, FillNull, DropNull, Flat,
DropDuplicateColumns) take a streaming DataFrame as they are. Windows of events
with late rows are a small addition of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what is there as Parquet and ends; the checkpoint lets a next run go on from here."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows in each window and group; rows later than `late` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
