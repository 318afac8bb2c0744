"""The change log as a stream: running state, deduplicated requests, windowed counts, leases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, glob: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """Events that arrive as Parquet files, with a timestamp that watermarks accept."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def changes(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    return events.select(F.floor(F.col("event_id") / 3).alias("revision"), (F.col("event_id") % 3).alias("event_index"), F.col("user_id").alias("key"), kind.alias("kind"), "value", "ts")


def running_state(feed: DataFrame) -> DataFrame:
    """The last change of every key so far; for update or complete mode. State is one row a key."""
    return feed.groupBy("key").agg(F.max_by(F.struct("revision", "event_index", "kind", "value"), F.struct("revision", "event_index")).alias("last")).select("key", "last.*")


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and type; late rows are dropped, closed windows leave the state."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event id once within the watermark: replayed requests leave no second change."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


class Epochs(StatefulProcessor):
    """Lease epochs per node: another session than the last raises the epoch; rows of a batch are taken in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("session", StringType()), StructField("epoch", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        session, epoch = self.last.get() if self.last.exists() else (None, 0)
        for batch in rows:
            batch, out = batch.sort_values("event_id"), []
            for now in batch["event_type"]:
                epoch, session = epoch + (now != session), now
                out.append(epoch)
            yield pd.DataFrame({"node": [key[0]] * len(batch), "event_id": batch["event_id"].to_numpy(), "session": batch["event_type"].to_numpy(), "epoch": out})
        self.last.update((session, epoch))

    def close(self) -> None:
        pass


def session_epochs(events: DataFrame) -> DataFrame:
    """The live form of session registration, keyed by node."""
    return events.groupBy("user_id").transformWithStateInPandas(Epochs(), "node long, event_id long, session string, epoch long", "Append", "none")


def written(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into Parquet files under a shared folder, and read them.

    Progress and state lie beside the files, so a query that is started again goes on where it was."""
    query = df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").outputMode(mode).trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")
