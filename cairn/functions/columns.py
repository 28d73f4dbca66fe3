"""Column building blocks: guarded arithmetic, rolling frames, ordered folds, statistics.

A missing value is NULL, never NaN or an infinity: every division and logarithm
is guarded where it is made.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

_BLOCK = 256
Z95 = 1.959963984540054


def series():
    """The window of a symbol's bars in order (a spec needs a session, so it is made when used)."""
    return W.partitionBy("symbol").orderBy("ts")


def safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def frame(k: int, w=None):
    return (w or series()).rowsBetween(-(k - 1), 0)


def rolling(c: Column, k: int, how, least: int | None = None, w=None) -> Column:
    """how(c) over the last k rows, null while fewer than ``least`` (k) of them are present."""
    return F.when(F.count(c).over(frame(k, w)) >= (k if least is None else least), how(c).over(frame(k, w)))


def zscore(c: Column, k: int, least: int, eps: float = 0.0, w=None) -> Column:
    mean, sd = rolling(c, k, F.avg, least, w), rolling(c, k, F.stddev_samp, least, w)
    return ratio(c - mean, sd + eps)


def percent_rank_in(c: Column, k: int, w=None) -> Column:
    """Average-tie rank of the current value among the last k, over k."""
    values = F.collect_list(c).over(frame(k, w))
    below, same = F.size(F.filter(values, lambda x: x < c)), F.size(F.filter(values, lambda x: x == c))
    return F.when(F.size(values) == k, (below + (same + 1) / 2.0) / float(k))


def let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def fold(items: Column, start: Column, step, out: str, kind: str) -> Column:
    """Array of ``out(state)`` after each item of an array, in one linear pass.

    step(state, item) gives the next state, a struct with the field ``out``.  The
    pass goes by blocks, so growing arrays stay short.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(items) / float(_BLOCK)).cast("int") - 1)), lambda i: F.slice(items, i * _BLOCK + 1, F.lit(_BLOCK)))
    none = F.array().cast(f"array<{kind}>")

    def inner(acc, item):
        return let(step(acc["state"], item), lambda s: F.struct(s.alias("state"), F.concat(acc["done"], F.array(s[out])).alias("done")))

    def outer(acc, block):
        part = F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("done")), inner)
        return let(part, lambda p: F.struct(p["state"].alias("state"), F.concat(acc["done"], F.array(p["done"])).alias("done")))

    whole = F.aggregate(blocks, F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("done")), outer)
    return F.flatten(whole["done"])


def ewm_array(values: Column, span: int) -> Column:
    """Exponential mean of each prefix of an array: y0 = x0, y = a x + (1 - a) y', a = 2 / (span + 1)."""
    a = 2.0 / (span + 1)
    start = F.struct(F.lit(None).cast("double").alias("y"))
    return fold(values, start, lambda s, x: F.struct(F.when(s["y"].isNull(), x).otherwise(x * a + s["y"] * (1.0 - a)).alias("y")), "y", "double")


def with_ewm(df: DataFrame) -> DataFrame:
    """Adds ema12, ema26 and macd_line, macd_signal: one ordered fold a symbol, linear in its rows."""
    series = df.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", "close"))).alias("s"))
    series = series.withColumn("x", F.transform("s", lambda r: r["close"]))
    series = series.withColumn("e12", ewm_array(F.col("x"), 12)).withColumn("e26", ewm_array(F.col("x"), 26))
    series = series.withColumn("m", F.zip_with("e12", "e26", lambda a, b: a - b)).withColumn("g", ewm_array(F.col("m"), 9))
    rows = series.select("symbol", F.explode(F.arrays_zip(F.transform("s", lambda r: r["ts"]).alias("ts"), F.col("e12").alias("ema12"), F.col("e26").alias("ema26"), F.col("m").alias("macd_line"), F.col("g").alias("macd_signal"))).alias("r"))
    return df.join(rows.select("symbol", "r.*"), ["symbol", "ts"])


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """(share, lower, upper) of Wilson's interval; zeros without trials."""
    p = successes / n
    centre, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    none = n > 0
    return tuple(F.when(none, x).otherwise(0.0) for x in (p, F.greatest(F.lit(0.0), centre - spread), F.least(F.lit(1.0), centre + spread)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and without negative zeros, to be compared across engines."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- plain numbers (drivers and tests) ------------------------------------------------------


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Lentz's method
    tiny = 1e-300
    c, d = 1.0, 1.0 / ((1.0 - (a + b) * x / (a + 1.0)) or tiny)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + num * d) or tiny)
            c = (1.0 + num / c) or tiny
            f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * f


def uniform(*parts: Column) -> Column:
    """A number above 0 and below 1 from the MD5 digest of the parts' texts; the same in every engine."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    """The frame's columns that begin with one of the prefixes, in order."""
    return [c for c in df.columns if c.startswith(prefixes)]


def numeric(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    """The frame's numeric columns but those named, in order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in without]


_NODES = 400


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic with ``df`` degrees of freedom.

    With t = sqrt(df) tan(a) the density is proportional to cos(a)^(df - 1), so the p-value is a ratio of two
    integrals, each by Simpson's rule over the stretch that has any weight.
    """
    least = F.lit(math.pi / 2)

    def area(start: Column) -> Column:
        step = (F.least(least, start + 12.0 / F.sqrt(df)) - start) / float(_NODES)
        at = lambda i: F.pow(F.greatest(F.cos(start + i * step), F.lit(0.0)), df - 1.0)
        weight = lambda i: F.when((i == 0) | (i == _NODES), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return F.aggregate(F.sequence(F.lit(0), F.lit(_NODES)), F.lit(0.0), lambda s, i: s + weight(i) * at(i)) * step / 3.0

    return F.when(df > 0, F.least(F.lit(1.0), area(F.atan(F.abs(t) / F.sqrt(df))) / area(F.lit(0.0)))).otherwise(1.0)


def t_test_p(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic."""
    return beta_inc(df / 2.0, 0.5, df / (df + t * t)) if df > 0 else 1.0
