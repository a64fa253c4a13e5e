"""The batch operators over streams: store synchronisation per micro-batch, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators.synchronize import next_store, record_outcomes
from corpusmill.sources.sinks import Snapshots


def synchronize_stream(records: DataFrame, snapshots: Snapshots, table: str, checkpoint: str, empty_store: DataFrame, once: bool = True) -> StreamingQuery:
    """Apply each micro-batch of delivered records to the store, publishing one snapshot per batch.

    The batch's number is kept in every row it writes, so a batch that is replayed after a failure
    finds its own rows unchanged and the result is the same.
    """

    def apply(batch: DataFrame, number: int) -> None:
        store = snapshots.read(table)
        store = empty_store if store is None else store
        outcomes = record_outcomes(store, batch)
        spark = batch.sparkSession
        failures = spark.createDataFrame([], "canonical_uri string, failed int")
        missing = spark.createDataFrame([], "canonical_uri string")
        after = next_store(store, outcomes, failures, missing, F.lit(str(number)), F.lit(number).cast("timestamp"))
        snapshots.publish(table, after.select(*empty_store.columns))

    writer = records.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and mean value per window and group; events later than ``late`` behind the newest are dropped by the stream."""
    kind = dict(events.dtypes)[time]
    return (
        events.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), *by)
        .agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
        .select(F.col("w.start").cast(kind).alias("window_start"), *by, "n", "mean_value")
    )
