"""Causal features, targets and normalisation of bar series (symbol, ts, open, high, low, close, volume)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import percent_rank_in, ratio, rolling, safe_ln, series, uniform, with_ewm, zscore

TDA_FEATURES = [
    "log_return", "log_return_5", "accel", "gk_vol_20", "parkinson_20", "rv_20", "hl_spread", "oc_spread", "vol_zscore_20",
    "vol_ratio_5_20", "rsi_centered", "macd_normalized", "bb_position", "bb_width", "trend_strength",
]
ML_FEATURES = TDA_FEATURES + ["log_return_24", "gk_vol_60", "rv_60", "macd_signal_normalized", "vol_pressure", "vol_regime"]
ALL_FEATURES = ML_FEATURES + ["vol_momentum"]
#: Columns that no evaluation may use, and real ones that look like them.
SYNTHETIC = ("mvrv_ratio", "exchange_inflow_pct", "whale_supply_pct", "developer_activity", "is_delisted", "months_since_delisting", "exchange_concentration", "active_addresses_z")
REAL_EXTERNAL = ("transaction_count", "hash_rate", "mempool_size", "mean_block_size", "total_fees_usd", "miners_revenue", "eth_transaction_count", "eth_gas_used", "eth_gas_limit", "eth_base_fee_gwei")
REAL_SPREADS = ("spread_pct", "spread_zscore_60", "spread_persistence")


def log_change(c: Column, k: int) -> Column:
    before = F.lag(c, k).over(series())
    return F.when((before > 0) & (c > 0), F.ln(c / before))


def garman_klass(k: int) -> Column:
    hl, co = safe_ln(F.try_divide("high", "low")), safe_ln(F.try_divide("close", "open"))
    good = F.when((F.col("low") > 0) & (F.col("open") > 0), 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co)
    mean = rolling(good, k, F.avg)
    return F.when(mean.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), mean)))


def parkinson(k: int) -> Column:
    hl = F.when(F.col("low") > 0, safe_ln(F.try_divide("high", "low")))
    return F.sqrt(rolling(hl * hl / (4 * math.log(2)), k, F.avg))


def rsi(k: int = 14) -> Column:
    """Simple-mean RSI; 50 where it is undefined, also when nothing was lost."""
    delta = F.coalesce(F.col("close") - F.lag("close").over(series()), F.lit(0.0))
    gain, loss = rolling(F.greatest(delta, F.lit(0.0)), k, F.avg), rolling(F.greatest(-delta, F.lit(0.0)), k, F.avg)
    return F.coalesce(100.0 - F.try_divide(F.lit(100.0), 1.0 + ratio(gain, loss)), F.lit(50.0))


def feature_frame(bars: DataFrame) -> DataFrame:
    """All features beside the bars, null where they aren't defined; every row stays."""
    df = with_ewm(bars)
    df = df.withColumns(
        {
            "log_return": log_change(F.col("close"), 1), "log_return_5": log_change(F.col("close"), 5), "log_return_24": log_change(F.col("close"), 24),
            "gk_vol_20": garman_klass(20), "gk_vol_60": garman_klass(60), "parkinson_20": parkinson(20),
            "hl_spread": ratio(F.col("high") - F.col("low"), F.col("close")), "oc_spread": ratio(F.col("close") - F.col("open"), F.col("open")),
            "vol_zscore_20": zscore(F.col("volume"), 20, 20), "vol_momentum": ratio(F.col("volume"), F.lag("volume").over(series())) - 1.0,
            "vol_ratio_5_20": ratio(rolling(F.col("volume"), 5, F.avg), rolling(F.col("volume"), 20, F.avg)),
            "rsi_centered": (rsi() - 50.0) / 50.0, "macd_normalized": ratio(F.col("macd_line"), F.col("close")), "macd_signal_normalized": ratio(F.col("macd_signal"), F.col("close")),
            "sma20": rolling(F.col("close"), 20, F.avg), "sd20": rolling(F.col("close"), 20, F.stddev_samp),
            "trend_strength": ratio(F.col("ema12") - F.lag("ema12", 20).over(series()), F.col("close")),
        }
    )
    df = df.withColumns(
        {
            "accel": F.col("log_return") - F.lag("log_return").over(series()), "rv_20": rolling(F.col("log_return"), 20, F.stddev_samp), "rv_60": rolling(F.col("log_return"), 60, F.stddev_samp),
            "bb_position": ratio(F.col("close") - F.col("sma20"), 2.0 * F.col("sd20")), "bb_width": ratio(4.0 * F.col("sd20"), F.col("sma20")),
            "vol_pressure": F.col("vol_zscore_20") * F.signum("log_return"),
        }
    )
    return df.withColumn("vol_regime", F.coalesce(percent_rank_in(F.col("rv_20"), 100), F.lit(0.5)))


def base_features(bars: DataFrame) -> DataFrame:
    """Rows on which every feature is defined."""
    return feature_frame(bars).select("symbol", "ts", "open", "high", "low", "close", "volume", *ALL_FEATURES).na.drop()


def daily_indicators(bars: DataFrame) -> DataFrame:
    df = with_ewm(bars)
    sma, sd = rolling(F.col("close"), 20, F.avg), rolling(F.col("close"), 20, F.stddev_samp)
    df = df.withColumns({"rsi": rsi(), "bb_mid": sma, "bb_high": sma + 2 * sd, "bb_low": sma - 2 * sd, "return_1d": ratio(F.col("close"), F.lag("close").over(series())) - 1.0, "log_return": log_change(F.col("close"), 1)})
    df = df.withColumns({"bb_width": F.col("bb_high") - F.col("bb_low"), "volatility_10d": rolling(F.col("return_1d"), 10, F.stddev_samp), "macd_diff": F.col("macd_line") - F.col("macd_signal")})
    return df.select("symbol", "ts", "close", "rsi", F.col("macd_line").alias("macd"), "macd_signal", "macd_diff", "bb_high", "bb_low", "bb_mid", "bb_width", "return_1d", "log_return", "volatility_10d").na.drop()


def hourly_indicators(bars: DataFrame) -> DataFrame:
    df = with_ewm(bars)
    sma, sd = rolling(F.col("close"), 20, F.avg), rolling(F.col("close"), 20, F.stddev_samp)
    df = df.withColumns({"rsi": rsi(), "bb_mid": sma, "bb_high": sma + 2 * sd, "bb_low": sma - 2 * sd, "return_1": ratio(F.col("close"), F.lag("close").over(series())) - 1.0, "log_return": log_change(F.col("close"), 1), "volume_ma": rolling(F.col("volume"), 20, F.avg)})
    df = df.withColumns({"volatility_20": rolling(F.col("return_1"), 20, F.stddev_samp), "volume_ratio": F.coalesce(ratio(F.col("volume"), F.col("volume_ma")), F.lit(1.0))})
    return df.select("symbol", "ts", "close", "rsi", F.col("macd_line").alias("macd"), "macd_signal", "bb_high", "bb_low", "bb_mid", "return_1", "log_return", "volatility_20", "volume_ma", "volume_ratio").na.drop()


def add_targets(df: DataFrame, horizon: int, price: str = "close") -> DataFrame:
    """future_price, future_return and target (1 if it rises); the last ``horizon`` rows of a symbol go."""
    out = df.withColumn("future_price", F.lead(price, horizon).over(series())).filter(F.col("future_price").isNotNull())
    return out.withColumn("future_return", ratio(F.col("future_price"), F.col(price)) - 1.0).withColumn("target", (F.col("future_price") > F.col(price)).cast("int"))


def z_columns(df: DataFrame, columns: list[str], k: int = 60, least: int = 10) -> DataFrame:
    return df.withColumns({f"{c}_z": ratio(F.col(c) - rolling(F.col(c), k, F.avg, least), rolling(F.col(c), k, F.stddev_samp, least) + 1e-8) for c in columns})


def causal_zscores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column by mean and population deviation of its symbol's rows so far."""
    w = series().rowsBetween(W.unboundedPreceding, 0)
    one = lambda c: F.when(F.stddev_pop(c).over(w) == 0, 1.0).otherwise(F.stddev_pop(c).over(w))
    return df.withColumns({f"{c}_cz": (F.col(c) - F.avg(c).over(w)) / one(c) for c in columns})


def global_zscores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column by mean and population deviation of all rows (it sees the future)."""
    stats = df.agg(*[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns])
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({f"{c}_z": (F.col(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") == 0, 1.0).otherwise(F.col(f"{c}_s")) for c in columns}).drop(*[f"{c}_{x}" for c in columns for x in "ms"])


def sliding_windows(df: DataFrame, columns: list[str], size: int = 20, stride: int = 1, extra: list[Column] | None = None) -> DataFrame:
    """(symbol, ts, end_idx, points): the last ``size`` rows as arrays of values, at every ``stride``-th full window."""
    row = F.row_number().over(series()) - 1
    points = F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(series().rowsBetween(-(size - 1), 0))
    out = df.select("symbol", "ts", row.alias("end_idx"), points.alias("points"), *(extra or []))
    return out.filter((F.col("end_idx") >= size - 1) & (F.pmod(F.col("end_idx") - (size - 1), F.lit(stride)) == 0))


def survivorship(df: DataFrame, delisted: DataFrame) -> DataFrame:
    """is_delisted, months_since_delisting and exchange_concentration."""
    out = df.join(F.broadcast(delisted), "symbol", "left")  # a fixed list of a few rows
    return out.withColumns(
        {
            "is_delisted": F.coalesce("is_delisted", F.lit(False)),
            "months_since_delisting": F.coalesce(F.greatest(F.lit(0.0), F.datediff("ts", "delisting_date") / 30.0), F.lit(0.0)),
            "exchange_concentration": F.coalesce(rolling(F.col("vol_zscore_20"), 20, F.stddev_samp), F.lit(0.5)),
        }
    )


def interactions(df: DataFrame) -> DataFrame:
    whale = F.col("whale_supply_pct_z") if "whale_supply_pct_z" in df.columns else F.lit(0.0)
    return df.withColumns({"vol_volume_interaction": F.col("gk_vol_20") * F.col("vol_zscore_20"), "momentum_trend_interaction": F.col("macd_normalized") * F.col("trend_strength"), "accel_whale_interaction": F.col("accel") * whale})


def synthetic_onchain(df: DataFrame, columns: list[str], seed: int = 0) -> DataFrame:
    """Stand-ins for absent columns: noise that depends on the seed and the row only."""
    unit = lambda c, i: uniform(F.lit(seed), F.lit(c), F.lit(i), F.col("symbol"), F.unix_seconds(F.col("ts").cast("timestamp")))
    normal = lambda c: F.sqrt(-2.0 * F.ln(unit(c, 0))) * F.cos(2 * math.pi * unit(c, 1))
    return df.withColumns({c: normal(c) * 0.5 for c in columns if c not in df.columns})


def synthetic_spread(df: DataFrame, seed: int = 0) -> DataFrame:
    """spread_pct as 0.1 and a random walk, its z-score and its persistence."""
    df = synthetic_onchain(df, ["spread_noise"], seed)
    df = df.withColumn("spread_pct", 0.1 + F.sum(F.col("spread_noise") * 0.02).over(series().rowsBetween(W.unboundedPreceding, 0))).drop("spread_noise")
    z = ratio(F.col("spread_pct") - rolling(F.col("spread_pct"), 20, F.avg), rolling(F.col("spread_pct"), 20, F.stddev_samp) + 1e-8)
    return df.withColumns({"spread_zscore_20": F.coalesce(z, F.lit(0.0)), "spread_persistence": rolling((F.col("spread_pct") > 0.1).cast("double"), 10, F.sum) / 10.0})


def fill_forward(df: DataFrame, columns: list[str]) -> DataFrame:
    """The last known value of the symbol, else 0; every row stays."""
    w = series().rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0.0)) for c in columns})


def is_synthetic(column: str) -> bool:
    real = column in REAL_EXTERNAL or column.removesuffix("_z") in REAL_EXTERNAL or column in REAL_SPREADS
    return not real and (column == "spread_zscore_20" or any(column == p or column.startswith(p + "_") for p in SYNTHETIC))


def drop_synthetic(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if is_synthetic(c)])
