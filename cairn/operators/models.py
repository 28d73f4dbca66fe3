"""Classifiers of direction and their ordered evaluation.

Pooled fits use ``pyspark.ml``.  Fits that belong to one symbol's series or to one
replicate of a test run as NumPy fits inside grouped tasks, all in parallel.
A prediction table (fold, symbol, ts, close, future_return, target, p_up) is made
once for each model; thresholds and filters are then joined to it instead of
fitting again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import Stored, ship_package
from .homology import RESOLUTION, image_bounds, persistence_images
from .signals import from_probability
from .validation import auc, block_shuffle, direction_accuracy, fold_rows, temporal_split, walk_forward_split

KEPT = ["symbol", "ts", "close", "future_return", "target"]

#: Values that one task of a fit holds at least: rounds are short, so few rows go to few tasks.
VALUES_PER_TASK = 1 << 22
#: The same of a forest, whose few rounds pass each row down every tree.
FOREST_VALUES_PER_TASK = 1 << 17
#: Most values of the matrix that a permutation test sends to every task.
MAX_MATRIX = 1 << 25


def classifier(kind: str, n: int, c: float = 1.0):
    """logistic, rf or gbm; other boosting libraries' models are stood in for by gbm."""
    if kind == "logistic":
        return LogisticRegression(featuresCol="_scaled", labelCol="target", regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=50)
    if kind == "rf":
        return RandomForestClassifier(featuresCol="_scaled", labelCol="target", numTrees=200, maxDepth=6, minInstancesPerNode=20, seed=42)
    if kind in ("gbm", "xgboost", "lightgbm", "catboost"):
        return GBTClassifier(featuresCol="_scaled", labelCol="target", maxIter=120, maxDepth=3, stepSize=0.05, seed=42)
    raise ValueError(f"unknown model {kind!r}")


def fit(train: DataFrame, columns: list[str], kind: str, c: float = 1.0):
    """The fitted pipeline; None where the rows that have all values don't hold both targets."""
    train = train.na.drop(subset=[*columns, "target"])
    n, targets = train.agg(F.count("*"), F.count_distinct("target")).first()
    if targets < 2:
        return None
    tasks = -(-n * len(columns) // (FOREST_VALUES_PER_TASK if kind == "rf" else VALUES_PER_TASK)) or 1
    if kind == "rf" and tasks > 1:  # a forest draws rows by task and place: neither may depend on how the files were split
        train = train.repartition(tasks, *columns).sortWithinPartitions(*columns, "target")
    else:
        train = train.coalesce(tasks)
    stages = [VectorAssembler(inputCols=columns, outputCol="_assembled", handleInvalid="skip"), StandardScaler(inputCol="_assembled", outputCol="_scaled", withMean=True), classifier(kind, n, c)]
    return Pipeline(stages=stages).fit(train)


def predict(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("p_up", vector_to_array("probability")[1])


def unscored(df: DataFrame) -> DataFrame:
    """What there is without a model: none of the rows, with the columns of the scored ones."""
    return df.withColumn("p_up", F.lit(None).cast("double")).filter(F.lit(False))


def cross_validate(df: DataFrame, columns: list[str], kind: str = "logistic", k: int = 5, horizon: int = 1, embargo: int = 0, shuffled: list[str] | None = None) -> DataFrame:
    """Predictions of each fold's test rows by a model of the purged train rows of all symbols.

    ``shuffled`` columns are permuted among the train rows (a control).  Logistic models of all folds are fitted at once.
    A fold without train rows of both targets has no predictions.
    """
    rows = fold_rows(df, k, horizon, embargo)
    beside = [c for c in ("rv_20", "trend_strength", "vol_zscore_20") if c in df.columns]
    if kind == "logistic":
        stored = Stored(df.sparkSession)
        rows = stored.put(rows, "folds")
        train = rows.filter("role = 'train'")
        if shuffled:
            train = reduce(DataFrame.unionByName, [permute(train.filter(F.col("fold") == f), shuffled, f) for f in range(k)])
            train = stored.put(train, "shuffled")
        models = fit_logistics(train, "fold", columns)
        return score_logistics(rows.filter("role = 'test'"), "fold", columns, models).select("fold", *KEPT, *beside, "p_up")
    rows = Stored(df.sparkSession).put(rows, "folds")
    parts = []
    for fold in range(k):
        train = rows.filter((F.col("fold") == fold) & (F.col("role") == "train"))
        if shuffled:
            train = permute(train, shuffled, fold)
        model = fit(train.select(*columns, "target"), columns, kind)
        if model is None:
            continue
        test = rows.filter((F.col("fold") == fold) & (F.col("role") == "test"))
        parts.append(predict(model, test).select("fold", *KEPT, *beside, "p_up"))
    if not parts:
        return unscored(rows).select("fold", *KEPT, *beside, "p_up")
    return reduce(DataFrame.unionByName, parts)


# --- logistic models of many groups at once ---------------------------------------------------


def _vector(columns: list[str] | Column) -> Column:
    return columns if isinstance(columns, Column) else F.array(*[F.col(c).cast("double") for c in columns])


def _sums(rows: DataFrame, of, others: int = 0) -> dict[int, np.ndarray]:
    """For each group g of the rows (g, x, y), the sum of ``of(g, x, y)`` over them: in each task first, then a task a group.

    With ``others``, for each g below it the sum over the rows of all other groups.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            group, x, y = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1), batch.column(2).to_numpy()
            for g in range(others) if others else np.unique(group).tolist():
                mine = group != g if others else group == g
                part = of(g, x[mine], y[mine])
                total[g] = total[g] + part if g in total else part
        yield _packed(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw)
                total[g] = total[g] + part if g in total else part
        yield _packed(total)

    kind = "g bigint, v binary"
    table = rows.mapInArrow(scan, kind).repartition("g").mapInArrow(merge, kind).toArrow()  # a row a group
    return {g: np.frombuffer(v) for g, v in zip(table["g"].to_pylist(), table["v"].to_pylist(), strict=True)}


def _packed(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["g", "v"])


def fit_logistics(rows: DataFrame, group: str, columns: list[str] | Column, c: float = 1.0, rounds: int = 25, others: int = 0) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(means, deviations, weights) of an L2-regularised logistic model of standardised columns (or of an array column)
    for each value of ``group``.

    Newton's method: each round is one job, in which every task sums its rows' gradient and curvature for all groups;
    only those sums, columns by columns, reach the driver.  Groups without both targets have no model, rows without
    all values count in none.  With ``others``, groups are numbered from 0 to below it and each has the model of all
    rows but its own, which are stored once, not for each model.
    """
    ship_package(rows.sparkSession)
    stored = Stored(rows.sparkSession)
    slim = rows.select(F.col(group).cast("bigint").alias("g"), _vector(columns).alias("x"), F.col("target").cast("double").alias("y"))
    slim = stored.put(slim.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)) & F.col("y").isNotNull()), "rows")
    first = _sums(slim, lambda g, x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]), others)
    state: dict[int, list[np.ndarray]] = {}
    for g, v in first.items():
        n, up, p = v[0], v[1], len(v) // 2 - 1
        if 0 < up < n:
            mean = v[2 : 2 + p] / n
            sd = np.sqrt(np.maximum(v[2 + p :] / n - mean**2, 0.0))
            state[g] = [mean, np.where(sd < 1e-12 * np.maximum(1.0, np.abs(mean)), 1.0, sd), np.zeros(p + 1)]
    live = set(state)
    for _ in range(rounds):
        if not live:
            break
        now = {g: state[g] for g in live}

        def slopes(g: int, x: np.ndarray, y: np.ndarray, now=now) -> np.ndarray:
            if g not in now:
                return np.zeros(0)
            mean, sd, w = now[g]
            z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
            q = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
            return np.concatenate([((z.T * (q * (1 - q))) @ z).ravel(), z.T @ (q - y)])

        for g, v in _sums(slim, slopes, others).items():
            if g in now:
                w = state[g][2]
                penalty = np.append(np.full(len(w) - 1, 1.0 / c), 1e-9)
                step = np.linalg.solve(v[: len(w) ** 2].reshape(len(w), -1) + np.diag(penalty), v[len(w) ** 2 :] + penalty * w)
                state[g][2] = w - step
                if np.abs(step).max() < 1e-6:  # the next step would be about its square
                    live.discard(g)
    stored.drop(slim)
    return {g: tuple(s) for g, s in state.items()}


def score_logistics(rows: DataFrame, group: str, columns: list[str] | Column, models: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """The rows of groups that have a model, with its p_up (null where a value is missing)."""
    shared = rows.sparkSession.sparkContext.broadcast(models)  # columns by groups
    kept = rows.filter(F.col(group).isin(sorted(models)))
    # NaN for what is missing, so that every array has its length
    x = F.transform(_vector(columns), lambda v: F.coalesce(v, F.lit(float("nan"))))
    schema = StructType([*kept.schema.fields, StructField("p_up", DoubleType())])
    last = len(kept.columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, x = batch.column(last).to_numpy(), batch.column(last + 1).flatten().to_numpy().reshape(batch.num_rows, -1)
            p = np.full(batch.num_rows, np.nan)
            for k in np.unique(g).tolist():
                mean, sd, w = shared.value[k]
                p[g == k] = 1.0 / (1.0 + np.exp(-np.clip((x[g == k] - mean) / sd @ w[:-1] + w[-1], -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(p, mask=np.isnan(p))], schema.names)

    return kept.withColumns({"_group": F.col(group).cast("bigint"), "_x": x}).mapInArrow(scan, schema)


def permute(df: DataFrame, columns: list[str], seed: int) -> DataFrame:
    """The columns moved together to other rows: both orders are numbered in range partitions, without one large task."""
    left = _numbered(df, F.xxhash64(F.lit(seed), "symbol", "ts"))
    right = _numbered(df.select("symbol", "ts", *columns), F.xxhash64(F.lit(seed + 7919), "ts", "symbol")).drop("symbol", "ts")
    return left.drop(*columns).join(right, "_n").drop("_n")


def _numbered(df: DataFrame, order) -> DataFrame:
    """_n: the row's number in the order, from counts of digest buckets."""
    keyed = df.withColumn("_o", order).withColumn("_b", F.pmod("_o", F.lit(64)))
    sizes = keyed.groupBy("_b").agg(F.count("*").alias("_c"))
    sizes = sizes.withColumn("_first", F.coalesce(F.sum("_c").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")  # 64 rows
    return keyed.withColumn("_i", F.row_number().over(W.partitionBy("_b").orderBy("_o"))).join(F.broadcast(sizes), "_b").withColumn("_n", F.col("_first") + F.col("_i")).drop("_o", "_b", "_i", "_first")


def evaluate(predictions: DataFrame, threshold: float = 0.65, by: tuple[str, ...] = ("fold", "symbol")) -> DataFrame:
    """(by..., n_signals, n_correct, direction_accuracy, auc)."""
    acc = direction_accuracy(from_probability(predictions, threshold=threshold), list(by))
    return acc.join(auc(predictions, list(by)), list(by))


def grid(predictions: DataFrame, thresholds: list[float], filters: list[str]) -> DataFrame:
    """Accuracy of every threshold and volatility filter on one prediction table: a cross join, no new fits."""
    spark = predictions.sparkSession
    params = spark.createDataFrame([(t, f) for t in thresholds for f in filters], "threshold double, vol_filter string")
    rows = predictions.crossJoin(F.broadcast(params))  # a few configurations
    median = F.percentile("rv_20", F.lit(0.5)).over(W.partitionBy("fold", "symbol", "threshold", "vol_filter"))
    rows = rows.withColumn("keep", (F.col("vol_filter") == "none") | (F.col("rv_20") > median))
    signal = F.when(F.col("keep") & (F.col("p_up") > F.col("threshold")), "BUY").when(F.col("keep") & (F.col("p_up") < 1.0 - F.col("threshold")), "SELL").otherwise("HOLD")
    return direction_accuracy(rows.withColumn("signal", signal), ["threshold", "vol_filter"])


def ablate_images(df: DataFrame, columns: list[str], k: int = 5, horizon: int = 1, embargo: int = 0, c: float = 0.5) -> DataFrame:
    """Predictions (condition, fold, ...) by columns, persistence images and both, from rows with diagrams h0 and h1.

    The images' bounds come from each fold's purged train rows.  ``base_shuffled`` permutes the images
    among the train rows; ``h0_only`` and ``h1_only`` see the images of one dimension.
    A fold without train rows of both targets has no predictions.
    """
    stored = Stored(df.sparkSession)
    rows = stored.put(fold_rows(df, k, horizon, embargo), "folds")
    size = RESOLUTION * RESOLUTION
    nothing = unscored(rows).select(F.lit("").alias("condition"), "fold", *KEPT, "p_up")
    seen = []
    for fold in range(k):
        mine = rows.filter(F.col("fold") == fold)
        bounds = image_bounds(mine.filter("role = 'train'")).first()  # two numbers
        if bounds["h0_top"] is None:
            continue
        images = persistence_images(mine, (bounds["h0_top"], bounds["h1_top"]), ["fold", "role", *KEPT, *columns])
        seen.append(images.select("fold", "role", *KEPT, F.array(*columns).alias("base"), F.slice("image", 1, size).alias("image_h0"), F.slice("image", 1 + size, size).alias("image_h1")))
    if not seen:
        return nothing
    seen = stored.put(reduce(DataFrame.unionByName, seen), "images")
    train, test = seen.filter("role = 'train'"), seen.filter("role = 'test'")
    shuffled = stored.put(reduce(DataFrame.unionByName, [permute(train.filter(F.col("fold") == f), ["image_h0", "image_h1"], f) for f in range(k)]), "shuffled")
    parts = []
    for name, used in {"base": ["base"], "images": ["image_h0", "image_h1"], "base_images": ["base", "image_h0", "image_h1"], "base_shuffled": ["base", "image_h0", "image_h1"], "h0_only": ["image_h0"], "h1_only": ["image_h1"]}.items():
        x = F.concat(*used)
        models = fit_logistics(shuffled if name == "base_shuffled" else train, "fold", x, c)
        if models:
            parts.append(score_logistics(test, "fold", x, models).select(F.lit(name).alias("condition"), "fold", *KEPT, "p_up"))
    return reduce(DataFrame.unionByName, parts) if parts else nothing


def leave_one_out(df: DataFrame, columns: list[str], kind: str = "logistic") -> DataFrame:
    """Predictions of each symbol by a model of all others; none where those lack both targets."""
    symbols = sorted(r["symbol"] for r in df.select("symbol").distinct().collect())  # one fit each anyway
    nothing = unscored(df).select(F.lit(0).alias("fold"), *KEPT, "p_up")
    if not symbols:
        return nothing
    if kind == "logistic":
        number = F.create_map(*[F.lit(x) for i, s in enumerate(symbols) for x in (s, i)])[F.col("symbol")]
        rows = df.withColumn("_held", number)
        models = fit_logistics(rows, "_held", columns, others=len(symbols))
        return score_logistics(rows, "_held", columns, models).select(F.lit(0).alias("fold"), *KEPT, "p_up")
    parts = []
    for s in symbols:
        model = fit(df.filter(F.col("symbol") != s).select(*columns, "target"), columns, kind)
        if model is not None:
            parts.append(predict(model, df.filter(F.col("symbol") == s)).select(F.lit(0).alias("fold"), *KEPT, "p_up"))
    return reduce(DataFrame.unionByName, parts) if parts else nothing


def ablate_columns(df: DataFrame, groups: dict[str, list[str]], k: int = 5, horizon: int = 1, embargo: int = 0, shuffle: str | None = None) -> DataFrame:
    """Predictions (condition, fold, ...) by each group of columns; ``shuffle`` names a group whose columns are also
    taken from permuted train rows, beside all other columns of the union, as ``shuffled``."""
    every = list(dict.fromkeys(c for cols in groups.values() for c in cols))
    parts = [cross_validate(df, cols, "logistic", k, horizon, embargo).select(F.lit(name).alias("condition"), "fold", *KEPT, "p_up") for name, cols in groups.items()]
    if shuffle:
        parts.append(cross_validate(df, every, "logistic", k, horizon, embargo, groups[shuffle]).select(F.lit("shuffled").alias("condition"), "fold", *KEPT, "p_up"))
    return reduce(DataFrame.unionByName, parts)


def base_importances(df: DataFrame, columns: list[str], kinds: tuple[str, ...] = ("rf", "gbm"), share: float = 0.8, horizon: int = 0) -> DataFrame:
    """(kind, feature, importance): what the trees fitted to the first rows use; none if these don't hold both targets."""
    train = temporal_split(df, share, horizon).filter("split = 'train'").select(*columns, "target")
    rows = []
    for kind in kinds:
        model = fit(train, columns, kind)
        if model is None:
            continue
        given = model.stages[-1].featureImportances.toArray()
        rows += [(kind, c, float(v)) for c, v in zip(columns, given, strict=True)]
    return df.sparkSession.createDataFrame(rows, "kind string, feature string, importance double")


def save_model(model, path: str) -> None:
    """Writes a fitted pipeline to a folder, over what is there."""
    model.write().overwrite().save(path)


def load_model(path: str):
    return PipelineModel.load(path)


def holdout(df: DataFrame, columns: list[str], kind: str = "logistic", share: float = 0.8, horizon: int = 0) -> DataFrame:
    """Predictions of the last rows; train rows whose horizon reaches into them are left out."""
    rows = temporal_split(df, share, horizon)
    if kind == "logistic":
        rows = Stored(df.sparkSession).put(rows.withColumn("fold", F.lit(0)), "split")
        models = fit_logistics(rows.filter("split = 'train'"), "fold", columns)
        return score_logistics(rows.filter("split = 'holdout'"), "fold", columns, models).select("fold", *KEPT, "p_up")
    model = fit(rows.filter("split = 'train'").select(*columns, "target"), columns, kind)
    if model is None:
        return unscored(rows).select(F.lit(0).alias("fold"), *KEPT, "p_up")
    return predict(model, rows.filter("split = 'holdout'")).select(F.lit(0).alias("fold"), *KEPT, "p_up")


# --- NumPy fits inside tasks ------------------------------------------------------------------


class Logistic:
    """L2-regularised logistic regression on standardised columns, by Newton's method."""

    def __init__(self, c: float = 1.0, rounds: int = 25):
        self.c, self.rounds = c, rounds

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, sd = x.mean(0), x.std(0)
        self.sd = np.where(sd == 0, 1.0, sd)
        z = np.column_stack([(x - self.mean) / self.sd, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        penalty = np.append(np.full(x.shape[1], 1.0 / self.c), 1e-9)
        for _ in range(self.rounds):
            p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.w = w
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - self.mean) / self.sd, np.ones(len(x))])
        return 1.0 / (1.0 + np.exp(-np.clip(z @ self.w, -30, 30)))


def walk_forward(df: DataFrame, columns: list[str], horizon: int = 24, warmup: int = 240, refit: int = 168, threshold: float = 0.55) -> DataFrame:
    """Continuous evaluation: refit every ``refit`` bars on rows whose horizon has passed; positions last ``horizon`` bars.

    (symbol, ts, idx, p_up, signal, hold): hold marks bars inside an open position.
    """
    ship_package(df.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts").reset_index(drop=True)
        x, y = pdf[columns].to_numpy(float), pdf["target"].to_numpy(float)
        p = np.full(len(pdf), 0.5)
        for at in range(warmup, len(pdf), refit):
            train = slice(0, max(at - horizon, 0))
            if len(np.unique(y[train])) == 2:
                p[at : at + refit] = Logistic().fit(x[train], y[train]).predict(x[at : at + refit])
        signal, hold, until = [], [], -1
        for i, q in enumerate(p):
            side = "BUY" if q > threshold else "SELL" if q < 1 - threshold else "HOLD"
            opens = i > until and i >= warmup and side != "HOLD"
            signal.append(side if opens else "HOLD")
            until = i + horizon if opens else until
            hold.append(i <= until)
        return pd.DataFrame({"symbol": pdf["symbol"], "ts": pdf["ts"], "idx": np.arange(len(pdf)), "p_up": p, "signal": signal, "hold": hold})

    return df.select("symbol", "ts", "target", *columns).groupBy("symbol").applyInPandas(run, "symbol string, ts timestamp_ntz, idx long, p_up double, signal string, hold boolean")


def permutation_null(df: DataFrame, columns: list[str], rounds: int = 99, share: float = 0.8, threshold: float | tuple[float, ...] = 0.55, block: int = 168, seed: int = 0, horizon: int = 0, most_values: int = MAX_MATRIX) -> DataFrame:
    """(replicate, value): accuracy on the last rows after shuffling whole blocks of targets; replicate -1 is the real one.

    With several thresholds the value is the best accuracy among them, so the test covers the whole grid.
    Train rows whose horizon reaches into the last rows are left out.  Up to ``most_values`` numbers, the rows are sent
    to every task, which refits whole replicates; beyond, all replicates are fitted at once from sums over the rows.
    Both shuffle by the same digests and give the same values.
    """
    limits = threshold if isinstance(threshold, tuple) else (threshold,)
    spark = df.sparkSession
    ship_package(spark)
    if df.count() * (len(columns) + 3) > most_values:
        return _null_by_groups(df, columns, rounds, share, limits, block, seed, horizon)
    pdf = df.select("symbol", "ts", "target", *columns).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    shared = spark.sparkContext.broadcast((pdf["symbol"].to_numpy(), pdf["target"].to_numpy(float), pdf[columns].to_numpy(float)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbols, y, x = shared.value
        places = {s: np.flatnonzero(symbols == s) for s in np.unique(symbols)}
        for batch in batches:
            out = []
            for r in batch["replicate"]:
                t, train, held = y.copy(), np.zeros(len(y), bool), np.zeros(len(y), bool)
                for s, at in places.items():
                    cut = int(len(at) * share)
                    train[at[: max(cut - horizon, 0)]], held[at[cut:]] = True, True
                    if r >= 0:
                        blocks = [at[i : i + block] for i in range(0, len(at), block)]
                        order = sorted(range(len(blocks)), key=lambda i: (hashlib.md5(f"{seed}-{r}:{s}:{i}".encode()).hexdigest(), i))  # as block_shuffle
                        t[at] = y[np.concatenate([blocks[i] for i in order])]
                p = Logistic().fit(x[train], t[train]).predict(x[held])
                right, sure = (p > 0.5) == (t[held] == 1), [np.abs(p - 0.5) > z - 0.5 for z in limits]
                out.append(max(float(right[u].mean()) if u.any() else 0.5 for u in sure))
            yield pd.DataFrame({"replicate": batch["replicate"], "value": out})

    # the rows' order within the matrix is that of (symbol, ts)
    replicates = spark.range(-1, rounds).select(F.col("id").alias("replicate")).repartition(max(1, min(rounds, 64)))
    return replicates.mapInPandas(run, "replicate long, value double")


def _null_by_groups(df: DataFrame, columns: list[str], rounds: int, share: float, limits: tuple[float, ...], block: int, seed: int, horizon: int) -> DataFrame:
    """The same from as many logistic models as replicates, fitted together where the rows are."""
    stored = Stored(df.sparkSession)
    rows = stored.put(temporal_split(df.select("symbol", "ts", "target", *columns), share, horizon), "rows")
    slim = rows.select("symbol", "ts", "target")
    drawn = [slim.withColumn("shuffled", F.col("target")).withColumn("replicate", F.lit(-1))]
    drawn += [block_shuffle(slim, "target", block, f"{seed}-{r}").drop("idx").withColumn("replicate", F.lit(r)) for r in range(rounds)]
    every = reduce(DataFrame.unionByName, [d.select("replicate", "symbol", "ts", "shuffled") for d in drawn])
    every = stored.put(every.join(rows.drop("target"), ["symbol", "ts"]).withColumnRenamed("shuffled", "target"), "replicates")
    models = fit_logistics(every.filter("split = 'train'"), "replicate", columns)
    held = score_logistics(every.filter("split = 'holdout'"), "replicate", columns, models)
    right = (F.col("p_up") > 0.5) == (F.col("target") == 1)
    best = [F.coalesce(F.avg(F.when(F.abs(F.col("p_up") - 0.5) > z - 0.5, right.cast("double"))), F.lit(0.5)) for z in limits]
    return held.groupBy(F.col("replicate").cast("bigint").alias("replicate")).agg((F.greatest(*best) if len(best) > 1 else best[0]).alias("value"))


def importance(df: DataFrame, groups: dict[str, list[str]], rounds: int = 5, share: float = 0.8, horizon: int = 0) -> DataFrame:
    """(feature_group, feature, importance): fall of holdout accuracy when a column is permuted; none without train rows of both targets."""
    columns = [c for cols in groups.values() for c in cols]
    rows = temporal_split(df, share, horizon)
    model = fit(rows.filter("split = 'train'").select(*columns, "target"), columns, "logistic")
    if model is None:
        return df.sparkSession.createDataFrame([], "feature_group string, feature string, importance double")
    test = rows.filter("split = 'holdout'").select("symbol", "ts", "target", *columns)
    test = Stored(df.sparkSession).put(test, "holdout")
    right = lambda d: F.avg((F.col("prediction") == F.col("target")).cast("double"))
    parts = [model.transform(test).agg(F.lit("").alias("feature"), right(test).alias("a"))]
    for i, c in enumerate(columns):
        for r in range(rounds):
            parts.append(model.transform(permute(test, [c], 100 * i + r)).agg(F.lit(c).alias("feature"), right(test).alias("a")))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    base = every.filter("feature = ''").select(F.col("a").alias("base"))
    named = df.sparkSession.createDataFrame([(g, c) for g, cols in groups.items() for c in cols], "feature_group string, feature string")
    return every.groupBy("feature").agg(F.avg("a").alias("a")).join(named, "feature").crossJoin(base).select("feature_group", "feature", (F.col("base") - F.col("a")).alias("importance"))


def ensemble(df: DataFrame, columns: list[str], kinds: tuple[str, ...] = ("logistic", "rf", "gbm"), horizon: int = 0) -> DataFrame:
    """Stacked predictions of the last rows: base models on the first, a logistic model of their outputs on the middle.

    Middle rows without both targets, as of short series, teach nothing: the base models then count alike.
    Without first rows of both targets there are no predictions.
    """
    rows = walk_forward_split(df, gap=horizon)
    scored = rows.filter("split in ('val', 'test')")
    names = []
    for i, kind in enumerate(kinds):
        model = fit(rows.filter("split = 'train'").select(*columns, "target"), columns, kind)
        name = f"p_{kind}_{i}"
        if model is None:
            names = [f"p_{x}_{j}" for j, x in enumerate(kinds)]
            return unscored(rows).withColumns({n: F.col("p_up") for n in names}).select(F.lit(0).alias("fold"), *KEPT, *names, "p_up")
        scored = predict(model, scored).withColumnRenamed("p_up", name).drop("_assembled", "_scaled", "rawPrediction", "probability", "prediction")
        names.append(name)
    scored = Stored(df.sparkSession).put(scored, "scored")
    val, test = scored.filter("split = 'val'").select(*names, "target"), scored.filter("split = 'test'")
    model = fit(val, names, "logistic")
    if model is not None:
        out = predict(model, test)
    else:
        out = test.withColumn("p_up", sum((F.col(n) for n in names), F.lit(0.0)) / len(names))
    return out.select(F.lit(0).alias("fold"), *KEPT, *names, "p_up")


def regime_adaptive(df: DataFrame, columns: list[str], least: int = 30, share: float = 0.8, horizon: int = 0) -> DataFrame:
    """Predictions by a model of the row's volatility regime, or by the global one where a regime is too small.

    Cuts come from the train rows; the three regimes are fitted in parallel tasks.
    """
    rows = temporal_split(df, share, horizon)
    cuts = rows.filter("split = 'train'").agg(F.percentile("rv_20", F.lit(0.33)).alias("lo"), F.percentile("rv_20", F.lit(0.66)).alias("hi"))
    rows = rows.crossJoin(F.broadcast(cuts)).withColumn("regime", F.when(F.col("rv_20") < F.col("lo"), 0).when(F.col("rv_20") >= F.col("hi"), 2).otherwise(1)).drop("lo", "hi")
    rows = Stored(df.sparkSession).put(rows, "regimes")
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'holdout'")
    sizes = {r["regime"]: r["n"] for r in train.groupBy("regime").agg(F.count("*").alias("n")).collect()}  # three rows
    # the fourth model is that of all rows
    models = fit_logistics(train.withColumn("_model", F.explode(F.array(F.col("regime"), F.lit(3)))), "_model", columns)
    own = [g for g in range(3) if g in models and sizes.get(g, 0) >= least]
    test = test.withColumn("_model", F.when(F.col("regime").isin(own), F.col("regime")).otherwise(3))
    return score_logistics(test, "_model", columns, models).select("regime", *KEPT, "p_up")


def accuracy_by_regime(predictions: DataFrame) -> DataFrame:
    """Rows and accuracy of each regime and, with regime -1, of all (grouping sets)."""
    right = ((F.col("p_up") > 0.5) == (F.col("target") == 1)).cast("double")
    return predictions.groupingSets([["regime"], []], "regime").agg(F.count("*").alias("n"), F.avg(right).alias("accuracy")).withColumn("regime", F.coalesce("regime", F.lit(-1)))


def latest_features(df: DataFrame) -> DataFrame:
    """Each symbol's last row, for scoring live."""
    w = W.partitionBy("symbol").orderBy(F.desc("ts"))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
