"""The same folds over streams: counters, windowed rates and keys that expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of event files, those of a folder or a single one, with ``at`` as a timestamp."""
    reader = spark.readStream.schema(schema)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        # streams read folders
        reader, path = reader.option("pathGlobFilter", at.getName()), str(at.getParent().toString())
    return reader.parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def counters(stream: DataFrame) -> DataFrame:
    """Running operations and values by key; for output mode update or complete."""
    return stream.groupBy("user_id").agg(F.count("*").alias("n_ops"), F.max_by("props", "event_id").alias("last"))


def windowed_rates(stream: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Operations by kind in tumbling windows; late rows are taken up to the watermark."""
    return (stream.withWatermark("at", late).groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n_ops"))
            .select(F.col("w.start").alias("start"), "event_type", "n_ops"))


def sessions(stream: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Operations of each user in sessions that end after a gap."""
    return (stream.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n_ops"))
            .select(F.col("w.start").alias("start"), "user_id", "n_ops"))


def expiring_counters(stream: DataFrame, ttl: str = "1 day") -> DataFrame:
    """(user_id, n_ops, expired): counters that vanish when no operation came for ``ttl`` of event time."""
    milliseconds = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (n,) = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "n_ops": [n], "expired": [True]})
            return
        n, latest = (state.get[0] if state.exists else 0), 0
        for f in frames:
            n += len(f)
            latest = max(latest, int(f["at"].max().timestamp() * 1000))
        state.update((n,))
        state.setTimeoutTimestamp(max(latest + milliseconds, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "n_ops": [n], "expired": [False]})

    return (stream.withWatermark("at", ttl).groupBy("user_id")
            .applyInPandasWithState(step, "user_id long, n_ops long, expired boolean", "n_ops long", "update", "EventTimeTimeout"))


def settled(updates: DataFrame, by: list[str], path: str) -> DataFrame:
    """Run a stream of updates over all that is there and return the last row of each ``by``.

    Each batch's updates are a folder of Parquet, replaced if the batch runs again after a failure;
    nothing is held by the driver. ``path``: a fresh folder that executors share.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/updates/{number}")

    query = updates.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [c for c in updates.columns if c not in by]
    rows = updates.sparkSession.read.option("recursiveFileLookup", "true").schema(StructType([*updates.schema.fields, StructField("batch", IntegerType())])).parquet(f"{path}/updates")
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("row")).select(*by, *[F.col("row")[c].alias(c) for c in rest])


def drain(query_df: DataFrame, mode: str, name: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there and return what its memory sink holds."""
    query = query_df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query_df.sparkSession.table(name)
