"""Windowed aggregates over a stream of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.graph import _kept


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts and exact sums by window and kind; works on a stream and on a table."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """All events of a table, read as a stream, once to its end."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    _kept(spark.range(1))  # makes sure that there is a shared folder
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    at, out = f"{base}/stream-{uuid.uuid4().hex}", f"{base}/stream-out-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/of={number}")

    query = windowed(spark.readStream.schema(schema).parquet(path + "*")).writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", at).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema("w struct<start: timestamp, end: timestamp>, event_type string, n long, total decimal(28,4), of int").parquet(out)
    last = found.agg(F.max("of")).first()[0]
    return found.filter(F.col("of") == last).select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", F.col("total").cast("double").alias("total"))
