"""Streaming twin of the path from events to bars and signals."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Events from a folder of parquet files, or from one file of a folder, with event time as TIMESTAMP."""
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        reader, path = reader.option("pathGlobFilter", p.getName()), p.getParent().toString()
    raw = reader.parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def bar_stream(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling OHLCV bars; an event that repeats within the watermark counts once, later ones are dropped."""
    known = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    grouped = known.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("symbol"))
    order = F.struct("ts", "event_id")
    bars = grouped.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume"))
    return bars.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: start, end and events."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def replay(spark: SparkSession, path: str, width: str = "1 hour") -> DataFrame:
    """All bars of a finished folder, through the stream: what batch bars give."""
    return _complete(spark, bar_stream(event_stream(spark, path), width))


def replay_sessions(spark: SparkSession, path: str, gap: str = "30 minutes") -> DataFrame:
    """All sessions of a finished folder, through the stream."""
    return _complete(spark, session_stream(event_stream(spark, path), gap))


def _complete(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """The stream's final table.

    Each trigger's complete table overwrites the last (idempotent, so a trigger that
    is run again does no harm); state and result are in the shared folder.  Complete
    output keeps all state, so it is for finished folders; a live stream appends.
    """
    root = f"{shared_dir(spark)}/cairn-stream-{uuid.uuid4().hex}"

    def put(df: DataFrame, _batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/table")

    stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/table")


_AVERAGES = "symbol string, ts timestamp, close double, n_held int, average double"


def average_stream(bars: DataFrame, size: int = 20) -> DataFrame:
    """(symbol, ts, close, n_held, average): each bar with the mean of the symbol's last ``size`` closes.

    State is those closes, with their times, for each symbol; bars that arrive together are taken in order, and one
    that is not later than the last taken is left out.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, held = (pd.Timestamp(state.get[0]), list(state.get[1])) if state.exists else (None, [])
        out = []
        for pdf in [pd.concat(list(frames)).sort_values("ts")]:
            for ts, close in zip(pdf["ts"], pdf["close"], strict=True):
                if last is not None and ts <= last:
                    continue
                last, held = ts, [*held, close][-size:]
                out.append((key[0], ts, close, len(held), math.fsum(held) / len(held)))
        state.update((last.isoformat(), held))
        yield pd.DataFrame(out, columns=["symbol", "ts", "close", "n_held", "average"])

    return bars.groupBy("symbol").applyInPandasWithState(step, _AVERAGES, "last string, held array<double>", "append", "NoTimeout")


def replay_averages(spark: SparkSession, bars: DataFrame, size: int = 20, files: int = 3) -> DataFrame:
    """The averages of finished bars, sent as a stream of a few files in the order of time and appended to a log."""
    root = f"{shared_dir(spark)}/cairn-stream-{uuid.uuid4().hex}"
    day = bars.withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = day.agg(F.percentile(F.unix_seconds("ts"), F.array(*[F.lit(i / files) for i in range(1, files)])).alias("c")).first()["c"]
    for i in range(files):  # a folder each, sent one after another
        at = F.unix_seconds("ts")
        part = day.filter((at > cuts[i - 1]) if i else F.lit(True)).filter((at <= cuts[i]) if i < files - 1 else F.lit(True))
        part.select("symbol", "ts", "close").write.mode("append").parquet(f"{root}/bars/part={i}")
        stream = spark.readStream.schema("symbol string, ts timestamp, close double").parquet(f"{root}/bars/part=*")
        append_log(average_stream(stream, size), f"{root}/log", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/log")


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Append-only log of a stream's rows, written once each."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
