"""As-of, attach, cover and comparison joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ratio, rolling


def _tagged(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Both sides in one frame; of right rows of one key and time the largest value counts."""
    one = right.groupBy(key, ts).agg(F.max(value).alias("r_value"))
    one = one.select(key, ts, F.struct(F.col(ts).alias("t"), "r_value").alias("r"), F.lit(0).alias("is_left"))
    rows = left.withColumn("is_left", F.lit(1))
    return one.unionByName(rows, allowMissingColumns=True)


def asof_backward(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, name: str) -> DataFrame:
    """left with the latest ``value`` of right at or before its time: one shuffle and one sort, no range join."""
    w = W.partitionBy(key).orderBy(ts, "is_left").rowsBetween(W.unboundedPreceding, 0)
    both = _tagged(left, right, key, ts, value).withColumn("m", F.last("r", ignorenulls=True).over(w))
    return both.filter("is_left = 1").select(*left.columns, F.col("m.r_value").alias(name))


def asof_nearest(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, name: str) -> DataFrame:
    """left with the ``value`` of right that is nearest in time, the earlier one on a tie."""
    back = W.partitionBy(key).orderBy(ts, "is_left").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(key).orderBy(ts, F.desc("is_left")).rowsBetween(0, W.unboundedFollowing)
    both = _tagged(left, right, key, ts, value).withColumn("b", F.last("r", ignorenulls=True).over(back)).withColumn("a", F.first("r", ignorenulls=True).over(ahead))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap_b, gap_a = micros(F.col(ts)) - micros(F.col("b.t")), micros(F.col("a.t")) - micros(F.col(ts))
    pick = F.when(F.col("a").isNull() | (gap_b <= gap_a), F.col("b.r_value")).otherwise(F.col("a.r_value"))
    return both.filter("is_left = 1").select(*left.columns, pick.alias(name))


def attach_daily(hourly: DataFrame, daily: DataFrame, columns: list[str]) -> DataFrame:
    """Left equi-join on symbol and day; the day's columns are null where it is missing."""
    d = daily.select("symbol", F.col("ts").alias("day"), *columns)
    return hourly.withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz")).join(d, ["symbol", "day"], "left").drop("day")


def venue_spread(closes: DataFrame, base: str, other: str) -> DataFrame:
    """Daily spread of two venues, its trailing z-score, and the share of the last 10 days above zero."""
    w = W.partitionBy("symbol").orderBy("ts")
    a = closes.filter(F.col("venue") == base).select("symbol", "ts", F.col("close").alias("a_close"))
    b = closes.filter(F.col("venue") == other).select("symbol", "ts", F.col("close").alias("b_close"))
    df = a.join(b, ["symbol", "ts"]).withColumn("spread_pct", ratio(F.col("b_close") - F.col("a_close"), F.col("a_close")))
    z = ratio(F.col("spread_pct") - rolling(F.col("spread_pct"), 60, F.avg, 10, w), rolling(F.col("spread_pct"), 60, F.stddev_samp, 10, w) + 1e-8)
    share = rolling((F.coalesce(F.col("spread_pct"), F.lit(0.0)) > 0).cast("double"), 10, F.avg, 3, w)
    return df.select("symbol", "ts", "spread_pct", z.alias("spread_zscore_60"), share.alias("spread_persistence"))


def fill_gaps(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """first, and the rows of second whose keys it lacks."""
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"))


def divergence(a: DataFrame, b: DataFrame, keys: list[str], limit: float = 0.05) -> DataFrame:
    """For each symbol: rows in both sources, and those whose closes differ by more than ``limit``."""
    both = a.select(*keys, F.col("close").alias("x")).join(b.select(*keys, F.col("close").alias("y")), keys)
    return both.groupBy(keys[0]).agg(F.count("*").alias("n_both"), F.count_if(F.abs(ratio(F.col("x") - F.col("y"), F.col("x"))) > limit).alias("n_diverging"))


def merge_metrics(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, keys, "full")
    return out


def cover_intervals(points: DataFrame, value: Column, n_intervals: int, overlap: float) -> DataFrame:
    """points with ``interval`` for each closed interval of the cover that holds the value.

    The cover is arithmetic on the value's range, so each row computes the few
    intervals that may hold it instead of being compared with all.
    """
    p = points.withColumn("lens", value)
    r = p.agg(F.min("lens").alias("lo"), F.max("lens").alias("hi"))
    p = p.crossJoin(F.broadcast(r))  # one row
    step = (F.col("hi") - F.col("lo")) / float(n_intervals)
    length = step * (1.0 + overlap)
    start = lambda i: F.col("lo") + i * step - (length - step) / 2.0
    around = F.floor(ratio(F.col("lens") - F.col("lo"), step)).cast("int")
    reach = int(overlap) + 2
    near = F.when(step > 0, F.sequence(around - reach, around + reach)).otherwise(F.sequence(F.lit(0), F.lit(n_intervals - 1)))
    held = F.filter(near, lambda i: (i >= 0) & (i < n_intervals) & (F.col("lens") >= start(i)) & (F.col("lens") <= start(i) + length))
    return p.withColumn("interval", F.explode(held)).drop("lo", "hi")
