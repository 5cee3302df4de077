"""Streaming over an event table (an extension: the batch operators have no stream of their own)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import ensure_checkpoint_dir

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def windows(stream: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums per tumbling window and type; events later than the watermark are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Drains what is there and returns the last result, kept in the shared checkpoint folder."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    at = os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"stream-{uuid.uuid4().hex}")
    schema = stream.schema
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).start().awaitTermination()
    try:
        return spark.read.schema(schema).parquet(f"{at}/out")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
