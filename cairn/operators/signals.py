"""Signals from rules, probabilities and topology, and regime masks.

A signal row has signal (BUY, SELL or HOLD) and position_size (signed share of the equity).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ratio, rolling, series, uniform
from .validation import temporal_split

def _signals(df: DataFrame, buy: Column, sell: Column, up: Column | float, down: Column | float) -> DataFrame:
    buy, sell = F.coalesce(buy, F.lit(False)), F.coalesce(sell, F.lit(False))
    up, down = (x if isinstance(x, Column) else F.lit(float(x)) for x in (up, down))
    return df.withColumns({"signal": F.when(buy, "BUY").when(sell, "SELL").otherwise("HOLD"), "position_size": F.when(buy, up).when(sell, down).otherwise(0.0)})


def momentum(df: DataFrame, lookback: int = 24, bps: float = 20.0) -> DataFrame:
    change = (ratio(F.col("close"), F.lag("close", lookback).over(series())) - 1.0) * 1e4
    return _signals(df, change > bps, change < -bps, 0.10, -0.10)


def vol_breakout(df: DataFrame, vol: str = "rv_20", z: float = 1.5, lookback: int = 100) -> DataFrame:
    """By the deviation of volatility from the ``lookback`` bars before, in the direction of the last return."""
    w = series().rowsBetween(-lookback, -1)
    sd = F.stddev_pop(vol).over(w)
    away = (F.col(vol) - F.avg(vol).over(w)) / F.when(sd == 0, 1.0).otherwise(sd)
    away = F.when(F.row_number().over(series()) > lookback, away)
    out = df.withColumn("r", F.coalesce(ratio(F.col("close"), F.lag("close").over(series())) - 1.0, F.lit(0.0)))
    out = out.withColumn("r_before", F.lag("r").over(series())).withColumn("away", away)
    return _signals(out, (F.col("away") > z) & (F.col("r_before") > 0), (F.col("away") > z) & (F.col("r_before") < 0), 0.10, -0.10).drop("r", "r_before", "away")


def ma_crossover(df: DataFrame, short: int = 10, long: int = 30) -> DataFrame:
    out = df.withColumn("above", rolling(F.col("close"), short, F.avg, 1) > rolling(F.col("close"), long, F.avg, 1))
    out = out.withColumn("was", F.lag("above").over(series()))
    return _signals(out, F.col("above") & ~F.col("was"), ~F.col("above") & F.col("was"), 0.5, -0.5).drop("above", "was")


def buy_and_hold(df: DataFrame, size: float = 1.0) -> DataFrame:
    return _signals(df, F.row_number().over(series()) == 1, F.lit(False), size, 0.0)


def cash(df: DataFrame) -> DataFrame:
    return _signals(df, F.lit(False), F.lit(False), 0.0, 0.0)


def random_signals(df: DataFrame, n: int = 10, seed: int = 42, size: float = 0.5) -> DataFrame:
    """BUY and SELL in turn at n rows of each symbol that a seeded digest picks."""
    by = W.partitionBy("symbol").orderBy(uniform(F.lit(seed), F.col("symbol"), F.unix_seconds(F.col("ts").cast("timestamp"))), "ts")
    out = df.withColumn("picked", F.row_number().over(by) <= n)
    turn = F.sum(F.col("picked").cast("int")).over(series().rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumn("turn", turn)
    return _signals(out, F.col("picked") & (F.col("turn") % 2 == 1), F.col("picked") & (F.col("turn") % 2 == 0), size, -size).drop("picked", "turn")


def from_probability(df: DataFrame, p: str = "p_up", threshold: float = 0.65, most: float = 0.10) -> DataFrame:
    size = most * 2.0 * F.abs(F.col(p) - 0.5)
    return _signals(df, F.col(p) > threshold, F.col(p) < 1.0 - threshold, size, -size)


def topology_scores(df: DataFrame, height: str = "H1_c1_norm", entropy: str = "H1_entropy", lookback: int = 20) -> DataFrame:
    """Adds c1_zscore, entropy_zscore, drift and confidence, which don't depend on thresholds."""
    z = lambda c: F.coalesce(ratio(F.col(c) - rolling(F.col(c), lookback, F.avg, 5), rolling(F.col(c), lookback, F.stddev_samp, 5)), F.lit(0.0))
    out = df.withColumns({"c1_zscore": z(height), "entropy_zscore": z(entropy), "drift": F.coalesce(ratio(F.col("close"), F.lag("close", 5).over(series())) - 1.0, F.lit(0.0))})
    return out.withColumn("confidence", 1.0 / (1.0 + F.abs("entropy_zscore")))


def topology_rule(scores: DataFrame, rise: Column | float = 1.5, drop: Column | float = -1.0, confidence: Column | float = 0.4, most: float = 0.5) -> DataFrame:
    """Signals of scored rows; a threshold may be a column, so that one table can hold many settings."""
    jump, sure = F.col("c1_zscore") > rise, F.col("confidence") > confidence
    buy = jump & sure & (F.col("drift") >= 0)
    sell = (F.col("c1_zscore") < drop) | (jump & (F.col("drift") < 0))
    up = F.least(F.lit(most), F.col("confidence") * most * F.abs("c1_zscore") / 2.0)
    return _signals(scores, buy, sell, up, -F.least(F.lit(most), F.col("confidence") * most))


def from_topology(df: DataFrame, height: str = "H1_c1_norm", entropy: str = "H1_entropy", lookback: int = 20, **thresholds) -> DataFrame:
    """Trades on jumps of the largest loop, sized by the confidence that the entropy's calm gives."""
    return topology_rule(topology_scores(df, height, entropy, lookback), **thresholds).drop("drift")


# --- regimes ----------------------------------------------------------------------------------


def _quantile(c: Column, q: float, by: list[str]) -> Column:
    return F.percentile(c, F.lit(q)).over(W.partitionBy(*by))


def vol_mask(threshold: str | float = "median", vol: str = "rv_20", by: tuple[str, ...] = ("symbol",)) -> Column:
    """Rows whose volatility is above the median, q75, q25 or a number; another word keeps all."""
    q = {"median": 0.5, "q75": 0.75, "q25": 0.25}
    if isinstance(threshold, str):
        return F.col(vol) > _quantile(F.col(vol), q[threshold], list(by)) if threshold in q else F.lit(True)
    return F.col(vol) > float(threshold)


def trend_mask(mode: str, trend: str = "trend_strength", by: tuple[str, ...] = ("symbol",)) -> Column:
    if mode == "up":
        return F.col(trend) > 0
    if mode == "down":
        return F.col(trend) < 0
    return F.abs(trend) > _quantile(F.abs(trend), 0.5, list(by)) if mode == "strong" else F.lit(True)


def volume_mask(df: DataFrame, threshold: float = 0.0) -> Column:
    return F.col("vol_zscore_20") > threshold if "vol_zscore_20" in df.columns else F.lit(True)


def hold_outside(df: DataFrame, *masks: Column) -> DataFrame:
    """Rows outside any mask keep their place and become HOLD."""
    inside = F.lit(True)
    for m in masks:
        inside = inside & F.coalesce(m, F.lit(False))
    df = df.withColumn("inside", inside)
    return df.withColumns({"signal": F.when(F.col("inside"), F.col("signal")).otherwise("HOLD"), "position_size": F.when(F.col("inside"), F.col("position_size")).otherwise(0.0)}).drop("inside")


def regime_labels(df: DataFrame, vol: str = "rv_20", share: float = 0.8) -> DataFrame:
    """0, 1, 2 below, between and from the 33rd and 66th percentile of volatility; 1 where it is missing.

    The percentiles are those of the first ``share`` of each symbol's rows, so no cut sees later rows.
    """
    cuts = temporal_split(df, share).filter("split = 'train'").agg(F.percentile(vol, F.lit(0.33)).alias("lo"), F.percentile(vol, F.lit(0.66)).alias("hi"))
    out = df.crossJoin(F.broadcast(cuts))  # one row
    return out.withColumn("regime", F.when(F.col(vol) < F.col("lo"), 0).when(F.col(vol) >= F.col("hi"), 2).otherwise(1)).drop("lo", "hi")


def time_regimes(df: DataFrame, k: int = 3) -> DataFrame:
    """Equal stretches of each symbol's rows, the last takes the remainder."""
    row, n = F.row_number().over(series()) - 1, F.count("*").over(W.partitionBy("symbol"))
    return df.withColumn("regime", F.least(F.floor(row / F.greatest(F.lit(1), F.floor(n / k))), F.lit(k - 1)).cast("int"))


def signal_summary(df: DataFrame) -> DataFrame:
    side = lambda s: F.col("signal") == s
    return df.groupBy("symbol").agg(
        F.count("*").alias("total"), F.count_if(side("BUY")).alias("n_buy"), F.count_if(side("SELL")).alias("n_sell"), F.count_if(side("HOLD")).alias("n_hold"),
        F.coalesce(F.avg(F.when(~side("HOLD"), F.abs("position_size"))), F.lit(0.0)).alias("avg_size"), F.max(F.abs("position_size")).alias("max_size"),
    )
