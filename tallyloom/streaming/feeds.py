"""The event feed as a stream: windows with late data, sessions, copies and current state.

Each function takes a streaming (or a batch) frame and returns the transformed one, so that the same code serves both;
:func:`drain` runs a stream over everything there is and returns what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.state import fold_memo, merge_memo
from tallyloom.sources.files import scratch


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """A file-source stream of the events table; ``at`` is the event time."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A single file is read through its folder and a filter on the name, a directory of parts as it is.
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    stream = raw.option("pathGlobFilter", "events.parquet").parquet(folder) if _is_file(spark, path) else raw.parquet(path)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "15 minutes") -> DataFrame:
    """Events and their values per window and category; rows later than ``late`` are left out."""
    per = events.withWatermark("at", late).groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.col("value").cast("decimal(30,4)")).alias("value"))
    return per.select(F.col("window.start").alias("window_start"), "event_type", "n_events", F.col("value").cast("double").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Stretches of a user's events with no gap longer than ``gap``."""
    per = events.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return per.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_events")


def first_deliveries(events: DataFrame, late: str | None = "1 day") -> DataFrame:
    """Each event once, however often it is delivered within ``late``; rows later than that are left out.

    With None nothing is late, in whatever order the files come: the state keeps every event's id.
    """
    if late is None:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream until its source is used up and returns its rows, written below the shared checkpoint folder."""
    spark = stream.sparkSession
    base = scratch(spark, name)
    if mode == "complete":

        def keep(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out/{epoch:08d}")

        _run(stream, keep, f"{base}/state", mode)
        return spark.read.parquet(_last(spark, f"{base}/out"))
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], state: str, mode: str) -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def _last(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return max(str(s.getPath()) for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p))


def memo_stream(events: DataFrame, key: str, value: str) -> DataFrame:
    """The usage memo kept up by batches: each epoch folds its own memo into the one before and writes it under its number,
    so a repeated epoch overwrites only itself."""
    spark = events.sparkSession
    base = scratch(spark, "memo")
    schema = "pattern string, hit_count long, resolved string, last_used string, last_id long"

    def fold(batch: DataFrame, epoch: int) -> None:
        uses = batch.select(F.col(key).cast("string").alias("k"), F.col(value).cast("string").alias("v"), F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"), F.col("event_id").alias("id"))
        own = merge_memo(uses, "k", "v", "t")
        if epoch:
            own = fold_memo(batch.sparkSession.read.schema(schema).parquet(f"{base}/out/{epoch - 1:08d}"), own)
        own.write.mode("overwrite").parquet(f"{base}/out/{epoch:08d}")

    _run(events, fold, f"{base}/state", "append")
    return spark.read.schema(schema).parquet(_last(spark, f"{base}/out"))
