"""The online behaviours as Structured Streaming queries over the events table.

`available(...)` runs a stream over what is there and ends, so the same code serves tests, backfills and, with another
trigger, a running service. State, output and progress lie in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.sources.shared import scratch


def events(spark: SparkSession, path: str) -> DataFrame:
    """The events as a stream; timestamps without a zone are UTC, as a watermark needs."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        # a stream watches a folder; a table of one file is that file in its folder
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name).option("recursiveFileLookup", True)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is available and returns what it wrote."""
    spark = df.sparkSession
    folder = scratch(spark, name)
    writer = df.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/out").start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out") if mode != "append" else spark.read.schema(df.schema).parquet(f"{folder}/out")


def session_membership(stream: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each event with 200, or 401 where its user has no session: a stream-static join."""
    known = sessions.select("user_id").distinct().withColumn("_known", F.lit(True))
    return stream.join(known, "user_id", "left").select("event_id", "user_id", F.when(F.col("_known"), 200).otherwise(401).alias("status"))


def displayed_exposures(exposures: DataFrame, displays: DataFrame, ttl: str = "15 minutes") -> DataFrame:
    """Exposures that the same user displayed within the time to live: a stream-stream join whose state the watermark
    bounds."""
    e = exposures.withWatermark("ts", ttl).select(F.col("event_id").alias("exposure_id"), F.col("user_id").alias("e_user"), F.col("ts").alias("shown_at"))
    d = displays.withWatermark("ts", ttl).select(F.col("event_id").alias("display_id"), F.col("user_id").alias("d_user"), F.col("ts").alias("seen_at"))
    inside = (F.col("e_user") == F.col("d_user")) & (F.col("seen_at") >= F.col("shown_at")) & (F.col("seen_at") <= F.col("shown_at") + F.expr(f"interval {ttl}"))
    return e.join(d, inside).select("exposure_id", "display_id")


def first_of_key(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Events whose key was not seen before within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def _idempotency(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first payload of a key owns it (200); the same again is answered as before (200), another is refused (409)."""
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    owner = state.get[0] if state.exists else rows["payload"].iloc[0]
    state.update((owner,))
    state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
    status = rows["payload"].map(lambda p: 200 if p == owner else 409)
    yield pd.DataFrame({"event_id": rows["event_id"], "status": status})


def select_status(stream: DataFrame, keep: str = "30 days") -> DataFrame:
    """Status of each select event (event_id, ts, key, payload) under idempotency keys. A key is forgotten `keep` after its
    last event, when the watermark passes it; events later than that are dropped."""
    marked = stream.withWatermark("ts", keep)
    return marked.groupBy("key").applyInPandasWithState(_idempotency, "event_id long, status long", "owner string", "append", GroupStateTimeout.EventTimeTimeout)


def session_windows(stream: DataFrame, gap: str) -> DataFrame:
    """Sessions of events of a user closer than `gap`: start, end, events."""
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", gap).groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("started"), "n")


def tumbling(stream: DataFrame, size: str) -> DataFrame:
    return stream.withWatermark("ts", size).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("started"), "event_type", "n")


def latest_revision(stream: DataFrame, revision: str, value: str) -> DataFrame:
    """The value of each user's highest revision; stale revisions change nothing. The state is one row a user, for good: a
    revision is stale however late it comes."""
    return stream.groupBy("user_id").agg(F.max(F.struct(revision, value)).alias("m")).select("user_id", f"m.{revision}", f"m.{value}")


def gate_late(stream: DataFrame, now: str, late: float = 120.0, ahead: float = 30.0) -> DataFrame:
    """Fixes older than 120 s are dropped from use, those over 30 s ahead rejected: a side column, nothing is lost."""
    age = F.col(now).cast("double") - F.col("ts").cast("double")
    return stream.withColumn("gate", F.when(age > late, "dropped").when(age < -ahead, "rejected").otherwise("used"))
