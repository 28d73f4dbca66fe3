"""Thresholds of the topological rule: chosen on validation rows, then judged on rows that had no say.

All settings of a symbol are columns of one table, so a grid is one broadcast join of
a few rows and one backtest by (symbol, setting); nothing is looped over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .backtest import metrics, run_backtest
from .signals import topology_rule
from .validation import direction_accuracy, fold_rows, walk_forward_split, with_wilson

RISES = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0)


def _judged(rows: DataFrame, by: tuple[str, ...], **costs) -> DataFrame:
    signals = topology_rule(rows, rise=F.col("rise"))
    return metrics(run_backtest(signals, by=by, **costs), signals, by=by)


def best_rise(scores: DataFrame, rises: tuple[float, ...] = RISES, **costs) -> DataFrame:
    """(symbol, rise, val_sharpe): the rise of the best Sharpe ratio on each symbol's validation rows, the smaller one on ties."""
    grid = scores.sparkSession.createDataFrame([(float(r),) for r in rises], "rise double")
    val = walk_forward_split(scores).filter("split = 'val'").crossJoin(F.broadcast(grid))  # a few settings
    tried = _judged(val, ("symbol", "rise"), **costs)
    first = W.partitionBy("symbol").orderBy(F.desc("sharpe_ratio"), "rise")
    return tried.withColumn("place", F.row_number().over(first)).filter("place = 1").select("symbol", "rise", F.col("sharpe_ratio").alias("val_sharpe"))


def tuned_test(scores: DataFrame, best: DataFrame, **costs) -> DataFrame:
    """Each symbol's test rows, judged once with its own setting."""
    test = walk_forward_split(scores).filter("split = 'test'").join(best.select("symbol", "rise"), "symbol")
    return best.join(_judged(test, ("symbol",), **costs), "symbol")


def tuned_folds(scores: DataFrame, best: DataFrame, k: int = 5, horizon: int = 1, with_val: bool = False) -> DataFrame:
    """Accuracy and its interval over the test rows of all folds, with the symbol's setting; needs future_return.

    The folds pass over the validation rows that chose the setting: these are left out unless ``with_val``.
    Rows before them are judged by a setting that was chosen later.
    """
    test = fold_rows(walk_forward_split(scores), k, horizon).filter("role = 'test'")
    test = test if with_val else test.filter("split <> 'val'")
    test = test.join(best.select("symbol", "rise"), "symbol")
    return with_wilson(direction_accuracy(topology_rule(test, rise=F.col("rise")), ["symbol", "rise"]))


def across_symbols(scores: DataFrame, best: DataFrame, origin: str, **costs) -> DataFrame:
    """The setting of one symbol, judged on the test rows of all others."""
    setting = best.filter(F.col("symbol") == origin).select("rise")
    test = walk_forward_split(scores.filter(F.col("symbol") != origin)).filter("split = 'test'").crossJoin(F.broadcast(setting))  # one row
    return _judged(test, ("symbol",), **costs).withColumn("origin", F.lit(origin))
