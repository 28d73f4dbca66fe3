"""Bars and dimensions derived from the mounted tables, and simple connectors."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import asof_backward

#: Seconds of each bar width.
GRANULARITY = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "6h": 21600, "1d": 86400}
#: Symbols that were taken off exchanges, and since when.
DELISTED = [("LUNA", "2022-05-12"), ("FTT", "2022-11-08"), ("ICP", "2024-01-15")]
ONCHAIN_SYMBOLS = ("BTC", "ETH")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bar_start(ts, width: str):
    """The start of the bar that holds a time: an hour, a day, or a name of ``GRANULARITY``."""
    if width not in GRANULARITY:
        return F.date_trunc(width, ts).cast("timestamp_ntz")
    epoch = F.unix_seconds(F.col(ts).cast("timestamp"))
    return F.timestamp_seconds(epoch - F.pmod(epoch, F.lit(GRANULARITY[width]))).cast("timestamp_ntz")


def bars(events: DataFrame, width: str = "hour") -> DataFrame:
    """OHLCV bars by event type: first, highest, lowest and last value, and the number of events; equal times go by event_id."""
    order = F.struct("ts", "event_id")
    grouped = events.groupBy(F.col("event_type").alias("symbol"), bar_start("ts", width).alias("ts"))
    return grouped.agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume"),
    )


def venue_closes(events: DataFrame) -> DataFrame:
    """Daily close of two venues, the users with even and those with odd ids."""
    venue = F.when(F.pmod("user_id", F.lit(2)) == 0, "even").otherwise("odd")
    return events.groupBy(F.col("event_type").alias("symbol"), venue.alias("venue"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))


def delisting_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DELISTED, "symbol string, since string").select("symbol", F.try_to_date("since", "yyyy-MM-dd").alias("delisting_date"), F.lit(True).alias("is_delisted"))


def venue_ids(symbol, known: dict[str, str]):
    """The venue's name of a symbol, ``<symbol>-USD`` unless it is known by another."""
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), symbol), F.concat(F.upper(symbol), F.lit("-USD")))


def first_source(*frames: DataFrame, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Rows of the first frame that has any for the symbol; sources are ranked by their order."""
    tagged = [f.withColumn("source_rank", F.lit(i)) for i, f in enumerate(frames)]
    every = tagged[0]
    for f in tagged[1:]:
        every = every.unionByName(f)
    best = every.groupBy(keys[0]).agg(F.min("source_rank").alias("source_rank"))
    return every.join(best, [keys[0], "source_rank"])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_cached(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """A parquet table whose key, kept beside it, equals the one asked for; else None."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}.key")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    kept = "".join(r["value"] for r in spark.read.text(f"{path}.key", wholetext=True).collect())  # one short text
    return spark.read.parquet(path) if kept.strip() == key.strip() else None


def write_cached(df: DataFrame, path: str, key: str) -> None:
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.createDataFrame([(key,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.key")


def from_hex(text):
    """The whole number of a text like 0x1f."""
    return F.conv(F.regexp_replace(text, "^0x", ""), 16, 10).cast("bigint")


def block_facts(blocks: DataFrame, unit: float = 1e9) -> DataFrame:
    """(symbol, ts, block_number, n_transactions, total_value, keys) of JSON payloads with hexadecimal numbers."""
    parsed = blocks.withColumn("b", F.from_json("payload", "number string, transactions array<struct<value:string>>"))
    total = F.aggregate(F.transform("b.transactions", lambda t: from_hex(t["value"])), F.lit(0).cast("bigint"), lambda a, v: a + v)
    keys = F.array_join(F.json_object_keys("payload"), ",")
    return parsed.select("symbol", "ts", from_hex(F.col("b.number")).alias("block_number"), F.size("b.transactions").cast("bigint").alias("n_transactions"), (total / unit).alias("total_value"), keys.alias("keys"))


def with_volume(ohlc: DataFrame, volumes: DataFrame, by: str = "symbol") -> DataFrame:
    """Bars of a source without volume, each with the latest volume of another one up to its time."""
    return asof_backward(ohlc, volumes.select(by, "ts", "volume"), by, "ts", "volume", "volume")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, idx, shape, values) of the .npy and .npz files below a folder: a row for each entry of the first axis.

    ``name`` is the array's name within an .npz file, else empty; ``values`` are the entry's numbers, laid end to end.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                loaded = np.load(io.BytesIO(raw), allow_pickle=False)
                for name, array in loaded.items() if hasattr(loaded, "items") else [("", loaded)]:
                    array = np.atleast_1d(np.asarray(array, dtype=np.float64))
                    flat = array.reshape(len(array), int(np.prod(array.shape[1:])))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
                    shape = pa.array([list(array.shape[1:])] * len(flat), pa.list_(pa.int64()))
                    text = lambda value, n=len(flat): pa.array([value] * n, pa.string())
                    yield pa.RecordBatch.from_arrays([text(path_.rsplit("/", 1)[-1]), text(name), pa.array(np.arange(len(flat))), shape, lists], ["file", "name", "idx", "shape", "values"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.np[yz]").load(path).select("path", "content")
    return files.mapInArrow(rows, "file string, name string, idx bigint, shape array<bigint>, values array<double>")


def write_report(rows: DataFrame, path: str) -> None:
    """A small result as one JSON file of a line a row."""
    rows.coalesce(1).write.mode("overwrite").json(path)
