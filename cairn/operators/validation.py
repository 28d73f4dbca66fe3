"""Splits, folds and statistics of ordered evaluation."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import let, ratio, series, student_p, uniform, wilson



def numbered(df: DataFrame) -> DataFrame:
    """idx, the row's place in its symbol, and n, the symbol's rows."""
    return df.withColumns({"idx": (F.row_number().over(series()) - 1).cast("long"), "n": F.count("*").over(W.partitionBy("symbol"))})


def temporal_split(df: DataFrame, share: float = 0.8, gap: int = 0) -> DataFrame:
    """split: ``train`` for the first share of each symbol's rows, then ``holdout``.

    The last ``gap`` rows before the cut, whose targets reach beyond it, are ``gap``.
    """
    cut = F.floor(F.col("n") * share)
    split = F.when(F.col("idx") + gap < cut, "train").when(F.col("idx") < cut, "gap").otherwise("holdout")
    return numbered(df).withColumn("split", split).drop("n")


def walk_forward_split(df: DataFrame, train: float = 0.7, val: float = 0.15, gap: int = 0) -> DataFrame:
    """split: ``train``, ``val`` and ``test`` in order; the last ``gap`` rows before each cut are ``gap``."""
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * (train + val))
    idx = F.col("idx")
    split = F.when(idx + gap < a, "train").when(idx < a, "gap").when(idx + gap < b, "val").when(idx < b, "gap").otherwise("test")
    return numbered(df).withColumn("split", split).drop("n")


def kfold(df: DataFrame, k: int = 5, min_train: int | None = None) -> DataFrame:
    """(symbol, n, fold, train_end, test_end): expanding train rows [0, train_end), test rows up to test_end."""
    n = F.col("n")
    least = F.greatest(F.lit(20), F.floor(n / (k + 1))) if min_train is None else F.lit(min_train)
    size = F.greatest(F.lit(5), F.floor((n - least) / k))
    folds = df.groupBy("symbol").agg(F.count("*").alias("n")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    folds = folds.withColumn("train_end", (least + F.col("fold") * size).cast("long")).withColumn("test_end", (F.col("train_end") + size).cast("long"))
    return folds.filter(F.col("test_end") <= n)


def purged(folds: DataFrame, horizon: int, embargo: int = 0, val_share: float = 0.15) -> DataFrame:
    """Adds n_train, n_val and n_test: train rows whose horizon and embargo end before the test, their tail held for validation."""
    n_tr = F.greatest(F.lit(0), F.col("train_end") - horizon - embargo)
    n_val = F.greatest(F.lit(20), F.floor(n_tr * val_share))
    out = folds.withColumn("n_val", n_val.cast("long")).withColumn("n_train", (n_tr - n_val).cast("long")).withColumn("n_test", F.col("test_end") - F.col("train_end"))
    return out.filter((n_tr >= 30) & (F.col("n_train") >= 30))


def fold_rows(df: DataFrame, k: int, horizon: int, embargo: int = 0, least_rows: int = 50) -> DataFrame:
    """Each row once for every fold it takes part in, with fold and role (train or test); small symbols are left out."""
    folds = kfold(df, k).filter(F.col("n") >= k + least_rows).select("symbol", "fold", "train_end", "test_end")
    rows = numbered(df).drop("n").join(folds, "symbol")
    role = F.when(F.col("idx") + horizon + embargo < F.col("train_end"), "train").when((F.col("idx") >= F.col("train_end")) & (F.col("idx") < F.col("test_end")), "test")
    return rows.withColumn("role", role).filter("role is not null").drop("train_end", "test_end")


def direction_accuracy(df: DataFrame, by: list[str], none: float = 0.5) -> DataFrame:
    """Signals and the share that was right: BUY if the return is above zero, SELL if below."""
    right = ((F.col("signal") == "BUY") & (F.col("future_return") > 0)) | ((F.col("signal") == "SELL") & (F.col("future_return") < 0))
    n = F.count_if(F.col("signal") != "HOLD")
    out = df.groupBy(*by).agg(n.alias("n_signals"), F.count_if(right).alias("n_correct"))
    return out.withColumn("direction_accuracy", F.coalesce(F.try_divide("n_correct", "n_signals"), F.lit(none)))


def with_wilson(df: DataFrame, good: str = "n_correct", n: str = "n_signals") -> DataFrame:
    share, lo, hi = wilson(F.col(good).cast("double"), F.col(n).cast("double"))
    return df.withColumns({"share": F.when(F.col(n) > 0, share).otherwise(0.0), "wilson_lower": F.when(F.col(n) > 0, lo).otherwise(0.0), "wilson_upper": F.when(F.col(n) > 0, hi).otherwise(0.0)})


def weighted_accuracy(folds: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy weighted by signals; 0.5 without any."""
    total = F.sum("n_signals")
    return folds.groupBy(*by).agg(F.coalesce(ratio(F.sum(F.col("direction_accuracy") * F.col("n_signals")), total.cast("double")), F.lit(0.5)).alias("weighted_accuracy"), total.alias("n_signals"))


def t_statistic(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    c = F.col(value)
    return df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), ratio(F.avg(c), F.stddev_samp(c) / F.sqrt(F.count(c))).alias("t_stat"))


def t_test(df: DataFrame, value: str, by: list[str], alpha: float = 0.05) -> DataFrame:
    """(by..., n, mean, t_stat, p_value, above): whether the mean differs from zero; ``above`` if it does and t is positive."""
    out = t_statistic(df, value, by).withColumn("p_value", student_p(F.col("t_stat"), (F.col("n") - 1).cast("double")))
    return out.withColumn("above", F.coalesce((F.col("p_value") < alpha) & (F.col("t_stat") > 0), F.lit(False)))


def mean_accuracy(folds: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy averaged over folds, each counting alike, and over those with any signal."""
    return folds.groupBy(*by).agg(F.avg("direction_accuracy").alias("mean_accuracy"), F.avg(F.when(F.col("n_signals") > 0, F.col("direction_accuracy"))).alias("mean_with_signals"))


def welch_free_t(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """Student's t of two groups with pooled variance."""
    g = lambda x: F.when(F.col(group) == x, F.col(value))
    na, nb, va, vb = F.count(g(a)), F.count(g(b)), F.var_samp(g(a)), F.var_samp(g(b))
    pooled = ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
    return df.agg(na.alias("n_a"), nb.alias("n_b"), ratio(F.avg(g(a)) - F.avg(g(b)), F.sqrt(pooled * (1 / na + 1 / nb))).alias("t_stat"))


def block_shuffle(df: DataFrame, value: str = "target", block: int = 168, seed: int | str = 0) -> DataFrame:
    """``value`` of each symbol permuted by whole blocks of consecutive rows, the short last one included."""
    rows = numbered(df).withColumn("block", F.floor(F.col("idx") / block).cast("long"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "symbol", F.col("block").cast("string")))
    sizes = rows.groupBy("symbol", "block").agg(F.count("*").alias("size")).withColumn("digest", digest)
    w = W.partitionBy("symbol").orderBy("digest", "block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("begin", F.coalesce(F.sum("size").over(w), F.lit(0)))
    moved = rows.join(sizes.select("symbol", "block", "begin"), ["symbol", "block"])
    moved = moved.select("symbol", (F.col("begin") + F.col("idx") - F.col("block") * block).alias("idx"), F.col(value).alias("shuffled"))
    return rows.drop("block", "n").join(moved, ["symbol", "idx"])


def permutation_p(observed: DataFrame, null: DataFrame, by: list[str], value: str = "value", require_null: bool = False) -> DataFrame:
    """(k + 1) / (B + 1) with k null values at or above the observed one; without any it is 1, or an error if they are required."""
    o = observed.select(*by, F.col(value).alias("observed"))
    b = F.count(value)
    p = (F.count_if(F.col(value) >= F.col("observed")) + 1) / (b + 1)
    if require_null:
        p = F.when(b == 0, F.raise_error(F.lit("no null values to compare with")).cast("double")).otherwise(p)
    return o.join(null.select(*by, value), by, "left").groupBy(*by, "observed").agg(b.alias("b"), p.alias("p_value"))


def poisson_draws(u: Column) -> Column:
    """A Poisson(1) draw from a uniform one of 32 bits: how many cumulated chances of 0 .. 12 draws it is above."""
    chances, total = [], 0.0
    for k in range(13):  # beyond, a chance is below 2**-32
        total += math.exp(-1.0) / math.factorial(k)
        chances.append(total)
    return let(u, lambda x: reduce(add, [(x > c).cast("int") for c in chances]))


def bootstrap_metric(df: DataFrame, metric: Column, by: list[str], row: list[Column], rounds: int = 1000, seed: int = 42, weight: str = "w") -> DataFrame:
    """(by..., point, lower, upper): a metric over all rows, and its 95 % interval over resamples.

    ``metric`` is any aggregate that weighs rows by the column ``weight``; ``row`` names a row for the seeded draws.
    A resample weighs rows where they are, so only what the aggregate sums is shuffled.
    """
    drawn = df.withColumn("round", F.explode(F.sequence(F.lit(-1), F.lit(rounds - 1))))
    drawn = drawn.withColumn(weight, F.when(F.col("round") < 0, 1).otherwise(poisson_draws(uniform(F.lit(seed), F.col("round"), *row))))
    values = drawn.groupBy(*by, "round").agg(metric.alias("value"))
    resampled = F.when(F.col("round") >= 0, F.col("value"))
    return values.groupBy(*by).agg(F.max(F.when(F.col("round") < 0, F.col("value"))).alias("point"), F.percentile(resampled, F.lit(0.025)).alias("lower"), F.percentile(resampled, F.lit(0.975)).alias("upper"))


def bootstrap_sharpe(returns: DataFrame, value: str = "r", rounds: int = 1000, seed: int = 42, periods: int = 365, risk_free: float = 0.02, least: int = 10) -> DataFrame:
    """Interval of the Sharpe ratio by symbol over resamples.

    A resample gives each row a Poisson(1) weight from a digest of (seed, round,
    row): rows are weighted where they are and only sums are shuffled, instead of
    gathering drawn rows.
    """
    rows = returns.select("symbol", "ts", F.col(value).alias("r")).filter("r is not null")
    drawn = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    drawn = drawn.withColumn("w", poisson_draws(uniform(F.lit(seed), F.col("round"), F.col("symbol"), F.unix_seconds(F.col("ts").cast("timestamp")))))
    s = drawn.groupBy("symbol", "round").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("r")).alias("s"), F.sum(F.col("w") * F.col("r") * F.col("r")).alias("q"))
    mean = F.col("s") / F.col("n")
    var = (F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1)
    s = s.filter(F.col("n") > 1).withColumn("sharpe", F.when(var > 0, (mean - risk_free / periods) / F.sqrt(var) * periods**0.5).otherwise(0.0))
    enough = rows.groupBy("symbol").agg(F.count("*").alias("rows"))
    out = s.groupBy("symbol").agg(F.avg("sharpe").alias("mean"), F.stddev_pop("sharpe").alias("std"), F.percentile("sharpe", F.lit(0.025)).alias("lower"), F.percentile("sharpe", F.lit(0.975)).alias("upper"))
    out = out.join(enough, "symbol")
    return out.select("symbol", *[F.when(F.col("rows") >= least, F.col(c)).otherwise(0.0).alias(c) for c in ("mean", "std", "lower", "upper")])


def auc(df: DataFrame, by: list[str], p: str = "p_up", y: str = "target") -> DataFrame:
    """Area under the curve from average ranks; 0.5 if a class is missing."""
    w = W.partitionBy(*by).orderBy(p)
    ties = W.partitionBy(*by, p)
    ranked = df.withColumn("avg_rank", F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0)
    pos, neg = F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)
    area = (F.sum(F.when(F.col(y) == 1, F.col("avg_rank"))) - pos * (pos + 1) / 2.0) / (pos * neg)
    return ranked.groupBy(*by).agg(F.when((pos > 0) & (neg > 0), area).otherwise(0.5).alias("auc"))


def break_even(df: DataFrame, accuracy: DataFrame, by: list[str]) -> DataFrame:
    """Edge in basis points that a horizon's accuracy and mean move give, beside two venues' costs."""
    moves = df.groupBy(*by).agg((F.avg(F.abs("future_return")) * 1e4).alias("avg_abs_move_bps"))
    out = moves.join(accuracy.select(*by, "direction_accuracy"), by)
    return out.withColumns({"gross_edge_bps": (2 * F.col("direction_accuracy") - 1) * F.col("avg_abs_move_bps"), "maker_cost_bps": F.lit(15), "taker_cost_bps": F.lit(85)})


def verdict(wins: Column, issues: Column) -> Column:
    return F.when(wins - issues >= 3, "PASS").when(wins - issues >= 0, "MARGINAL").otherwise("FAIL")
