import json
import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.functions.columns import beta_inc, numeric, student_p, t_test_p, with_prefix
from cairn.operators import backtest as bt
from cairn.operators import features as ft
from cairn.operators import homology as hom
from cairn.operators import joins as jn
from cairn.operators import mapper as mp
from cairn.operators import models as ml
from cairn.operators import signals as sg
from cairn.operators import tuning as tu
from cairn.operators import validation as va
from cairn.session import Stored
from cairn.sources import tables as tb
from cairn.sources.candles import CandleSource
from cairn.streaming import bars as st

SF = "/root/testdata/sf0.001"


def series(n=120, seed=42):
    r = np.random.RandomState(seed)
    close = 100 + r.randn(n).cumsum()
    open_ = close + r.randn(n) * 0.1
    high, low = np.maximum(open_, close) + np.abs(r.randn(n) * 0.3), np.minimum(open_, close) - np.abs(r.randn(n) * 0.3)
    return pd.DataFrame({"symbol": "A", "ts": pd.date_range("2025-01-01", periods=n, freq="h"), "open": open_, "high": high, "low": low, "close": close, "volume": 1000 + r.randn(n) * 100})


SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def test_features_match_pandas_and_see_no_future(spark):
    pdf = series()
    got = ft.feature_frame(spark.createDataFrame(pdf, SCHEMA)).orderBy("ts").toPandas()
    lr = np.log(pdf.close / pdf.close.shift(1))
    np.testing.assert_allclose(got.rv_20, lr.rolling(20).std(), atol=1e-9)
    ema = pdf.close.ewm(span=12, adjust=False).mean()
    np.testing.assert_allclose(got.ema12, ema, atol=1e-9)
    np.testing.assert_allclose(got.vol_zscore_20, (pdf.volume - pdf.volume.rolling(20).mean()) / pdf.volume.rolling(20).std(), atol=1e-9)
    changed = pdf.copy()
    changed.loc[100:, ["open", "high", "low", "close"]] *= 3
    other = ft.feature_frame(spark.createDataFrame(changed, SCHEMA)).orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(got.iloc[:100], other.iloc[:100])


def test_targets_drop_the_horizon(spark):
    assert ft.add_targets(spark.createDataFrame(series(10), SCHEMA), 3).count() == 7


def ledger(spark, prices, signals, **options):
    rows = [("A", (pd.Timestamp("2025-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), float(p), s, float(z)) for i, (p, (s, z)) in enumerate(zip(prices, signals, strict=True))]
    return bt.run_backtest(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, signal string, position_size double"), **options)


def test_costs(spark):
    hold = [("HOLD", 0)] * 3
    assert [r.equity for r in ledger(spark, [100, 110, 90], hold).collect()] == [10000.0] * 3
    flat = ledger(spark, [100] * 3, [("BUY", 0.5), ("HOLD", 0), ("SELL", -0.5)]).orderBy("idx").collect()
    assert flat[-1].equity < 10000 and flat[-1].trade.pnl < 0
    up = ledger(spark, [100, 105], [("BUY", 0.5), ("HOLD", 0)]).orderBy("idx").collect()
    assert 0 < up[-1].equity / 10000 - 1 < 0.05 and up[-1].trade.closed_at_end
    short = ledger(spark, [100, 90], [("SELL", -0.5), ("BUY", 0.5)], allow_short=True).orderBy("idx").collect()
    assert short[-1].trade.side == "short" and short[-1].equity > 10000


def test_kfold_and_purge(spark):
    folds = va.kfold(spark.createDataFrame(series(100), SCHEMA)).orderBy("fold").collect()
    assert [(r.train_end, r.test_end) for r in folds] == [(20 + 16 * i, 36 + 16 * i) for i in range(5)]
    rows = va.fold_rows(spark.createDataFrame(series(), SCHEMA), 5, 10)
    worst = rows.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("idx"))).alias("a"), F.min(F.when(F.col("role") == "test", F.col("idx"))).alias("b")).collect()
    assert all(r.a is None or r.a + 10 < r.b for r in worst)


def test_block_shuffle_is_a_permutation(spark):
    out = va.block_shuffle(spark.createDataFrame(series(100), SCHEMA).withColumn("target", F.col("close")), "target", 24, 3).toPandas()
    assert sorted(out.target) == sorted(out.shuffled) and (out.target != out.shuffled).any() and len(out) == 100


def test_student_t():
    assert beta_inc(2, 3, 0.5) == pytest.approx(0.6875, abs=1e-12)
    assert t_test_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)


def test_rips_on_known_shapes():
    for n in (4, 6, 12):
        a = 2 * np.pi * np.arange(n) / n
        h0, h1 = hom.rips(np.column_stack([np.cos(a), np.sin(a)]))
        side = 2 * math.sin(math.pi / n)
        assert len(h0) == n - 1 and np.allclose(h0[:, 1], side)
        assert len(h1) == 1 and h1[0, 0] == pytest.approx(side)
    h0, h1 = hom.rips(np.array([[0.0], [1.0], [3.0], [7.0]]))
    assert sorted(h0[:, 1]) == [1.0, 2.0, 4.0] and not len(h1)
    assert hom.statistics(hom.rips(np.zeros((1, 2)))[0]) == [0.0] * 8
    assert len(hom.rips(np.zeros((5, 2)))[0]) == 0


def test_scalar_features_and_images(spark):
    r = np.random.RandomState(0)
    clouds = [r.rand(20, 3).tolist() for _ in range(3)] + [[[0.0, 0.0, 0.0]]]
    df = spark.createDataFrame(list(enumerate(clouds)), "i int, points array<array<double>>")
    d = hom.diagrams(df, ["i"])
    for row in hom.scalar_features(d, ["i"]).collect():
        h0, h1 = hom.rips(np.array(clouds[row.i]))
        want = hom.statistics(h0) + hom.statistics(h1)
        np.testing.assert_allclose([row[f"{k}_{s}"] for k in ("H0", "H1") for s in hom.STATS], want, atol=1e-9)
    b = hom.image_bounds(d).first()
    images = {x.i: x.image for x in hom.persistence_images(d, (b.h0_top, b.h1_top), ["i"]).collect()}
    assert len(images[0]) == 200 and sum(images[0]) > 0 and sum(images[3]) == 0


def test_asof_ties_go_backward(spark):
    t = lambda h: (pd.Timestamp("2025-01-01") + pd.Timedelta(hours=h)).to_pydatetime()
    left = spark.createDataFrame([(1, "k", t(2)), (2, "k", t(9)), (3, "z", t(1))], "id int, k string, ts timestamp_ntz")
    right = spark.createDataFrame([("k", t(1), 10.0), ("k", t(3), 30.0), ("k", t(8), 80.0)], "k string, ts timestamp_ntz, v double")
    assert {r.id: r.x for r in jn.asof_nearest(left, right, "k", "ts", "v", "x").collect()} == {1: 10.0, 2: 80.0, 3: None}
    assert {r.id: r.x for r in jn.asof_backward(left, right, "k", "ts", "v", "x").collect()} == {1: 10.0, 2: 80.0, 3: None}


def test_graph_patterns():
    nodes, edges = list("abcde"), [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")]
    assert mp.connected(nodes, edges) == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e"}
    assert [sorted(x) for x in mp.cycle_basis(nodes, edges)] == [["a", "b", "c"]]
    assert mp.betweenness(nodes[:4], edges)["c"] == pytest.approx(2 / 3)
    assert mp.dbscan(np.array([[0.0], [0.5], [5.0]])).tolist() == [0, 0, -1]


def test_signals(spark):
    df = spark.createDataFrame([("A", pd.Timestamp("2025-01-01").to_pydatetime(), p) for p in (0.9, 0.1, 0.5)], "symbol string, ts timestamp_ntz, p_up double")
    out = {r.p_up: (r.signal, r.position_size) for r in sg.from_probability(df, threshold=0.6).collect()}
    assert out[0.9] == ("BUY", pytest.approx(0.08)) and out[0.1] == ("SELL", pytest.approx(-0.08)) and out[0.5][0] == "HOLD"
    assert ft.is_synthetic("mvrv_ratio_z") and not ft.is_synthetic("spread_pct") and not ft.is_synthetic("hash_rate_z") and ft.is_synthetic("spread_zscore_20")


def test_splits_keep_targets_apart(spark):
    df = spark.createDataFrame(series(100), SCHEMA)
    got = {r.split: (r.a, r.b) for r in va.temporal_split(df, 0.8, 10).groupBy("split").agg(F.min("idx").alias("a"), F.max("idx").alias("b")).collect()}
    assert got == {"train": (0, 69), "gap": (70, 79), "holdout": (80, 99)}
    got = {r.split: r.n for r in va.walk_forward_split(df, gap=5).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"train": 65, "val": 10, "gap": 10, "test": 15}
    assert {r.split for r in va.walk_forward_split(df).select("split").distinct().collect()} == {"train", "val", "test"}


def scores(spark, n=200):
    frames = []
    for k, symbol in enumerate("AB"):
        frames.append(series(n, 42 + k).assign(symbol=symbol))
    f = ft.add_targets(ft.base_features(spark.createDataFrame(pd.concat(frames), SCHEMA)), 3)
    return sg.topology_scores(f, "rv_20", "bb_width")


def test_tuning_picks_the_best_validation_sharpe(spark):
    f = scores(spark).cache()
    best = {r.symbol: r for r in tu.best_rise(f).collect()}
    val = va.walk_forward_split(f).filter("split = 'val'")
    for symbol in "AB":
        tried = []
        for rise in tu.RISES:
            signals = sg.topology_rule(val.filter(F.col("symbol") == symbol), rise=rise)
            tried.append((bt.metrics(bt.run_backtest(signals), signals).first().sharpe_ratio, rise))
        top = max(s for s, _ in tried)
        assert best[symbol].val_sharpe == pytest.approx(top)
        assert best[symbol].rise == min(r for s, r in tried if s == pytest.approx(top, abs=1e-12))
    b = tu.best_rise(f)
    n = {r.symbol: r.n_signals for r in tu.tuned_folds(f, b, 3, 3).collect()}
    every = {r.symbol: r.n_signals for r in tu.tuned_folds(f, b, 3, 3, with_val=True).collect()}
    used = val.join(b, "symbol").withColumn("s", F.lit(0))
    in_val = {r.symbol: r.n for r in sg.topology_rule(used, rise=F.col("rise")).filter("signal <> 'HOLD'").groupBy("symbol").agg(F.count("*").alias("n")).collect()}
    folds = va.fold_rows(va.walk_forward_split(f), 3, 3).filter("role = 'test' and split = 'val'").groupBy("symbol").agg(F.count("*").alias("n")).collect()
    whole = {r.symbol: r.n for r in val.groupBy("symbol").agg(F.count("*").alias("n")).collect()}
    assert {r.symbol: r.n for r in folds} == whole  # the folds pass over all validation rows
    assert all(every[s] - n[s] == in_val.get(s, 0) for s in "AB")
    assert {r.symbol for r in tu.across_symbols(f, b, "A").collect()} == {"B"}


def test_permutation_p_can_require_a_null(spark):
    o = spark.createDataFrame([("t", 0.6)], "test string, value double")
    null = spark.createDataFrame([("t", 0.5), ("t", 0.7), ("t", 0.6)], "test string, value double")
    assert va.permutation_p(o, null, ["test"], require_null=True).first().p_value == 0.75
    assert va.permutation_p(o, null.limit(0), ["test"]).first().p_value == 1.0
    with pytest.raises(Exception, match="no null values"):
        va.permutation_p(o, null.limit(0), ["test"], require_null=True).collect()


def test_grid_null_is_the_best_of_its_thresholds(spark):
    f = ft.add_targets(ft.base_features(spark.createDataFrame(series(200), SCHEMA)), 3)
    run = lambda t: {r.replicate: r.value for r in ml.permutation_null(f, ["rv_20", "bb_width"], 4, threshold=t, block=12, horizon=3).collect()}
    both, one, two = run((0.5, 0.55)), run(0.5), run(0.55)
    assert set(both) == {-1, 0, 1, 2, 3} and all(both[r] == max(one[r], two[r]) for r in both)


def test_image_ablation(spark):
    r = np.random.RandomState(1)
    f = ft.add_targets(spark.createDataFrame(series(160), SCHEMA), 3).withColumn("x", F.col("close"))
    clouds = spark.createDataFrame([(i, r.rand(8, 2).tolist()) for i in range(160)], "i long, points array<array<double>>")
    rows = va.numbered(f).join(clouds, F.col("idx") == F.col("i")).select("symbol", "ts", "close", "future_return", "target", "x", "points")
    d = hom.diagrams(rows, ["symbol", "ts", "close", "future_return", "target", "x"])
    out = ml.ablate_images(d, ["x"], 2, 3).toPandas()
    assert set(out.condition) == {"base", "images", "base_images", "base_shuffled", "h0_only", "h1_only"}
    assert out.groupby("condition").ts.nunique().nunique() == 1 and out.p_up.between(0, 1).all()


def test_ensemble_without_middle_rows_is_the_mean(spark):
    f = ft.add_targets(ft.base_features(spark.createDataFrame(series(160), SCHEMA)), 3)
    out = ml.ensemble(f, ["rv_20", "bb_width"], ("logistic", "rf"), horizon=60).toPandas()
    np.testing.assert_allclose(out.p_up, (out.p_logistic_0 + out.p_rf_1) / 2)
    fitted = ml.ensemble(f, ["rv_20", "bb_width"], ("logistic", "rf"), horizon=3).toPandas()
    assert len(fitted) == len(out) > 0 and fitted.p_up.between(0, 1).all()


def test_diagrams_of_float_vectors(spark):
    """Where every cloud of a batch has loops, none of the diagrams is an empty one of doubles."""
    turn = np.linspace(0, 2 * math.pi, 12, endpoint=False)
    circle = np.column_stack([np.cos(turn), np.sin(turn)]).astype(np.float32)
    clouds = spark.createDataFrame([(i, circle.tolist()) for i in range(3)], "i int, points array<array<float>>").coalesce(1)
    rows = hom.diagrams(clouds, ["i"]).collect()
    h0, h1 = hom.rips(circle.astype(np.float64))
    for r in rows:
        assert len(r.h1) == len(h1) == 1 and np.allclose(r.h1, h1, atol=1e-12) and np.allclose(r.h0, h0, atol=1e-12)


def few_rows(spark, case):
    """Rows with targets: none, or rising ones only."""
    rows = ft.add_targets(spark.createDataFrame(series(160), SCHEMA), 3).withColumn("x", F.col("close"))
    return Stored(spark).put(rows.filter("false") if case == "none" else rows.withColumn("target", F.lit(1)), case)


@pytest.mark.parametrize("case", ["none", "rising"])
@pytest.mark.parametrize("kind", ["gbm", "rf"])
def test_cv_without_both_targets_predicts_nothing(spark, kind, case):
    out = ml.evaluate(ml.cross_validate(few_rows(spark, case), ["x"], kind, 2, 3))
    assert out.columns == ["fold", "symbol", "n_signals", "n_correct", "direction_accuracy", "auc"] and out.count() == 0


def test_forest_of_many_tasks_does_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(ml, "VALUES_PER_TASK", 200)
    monkeypatch.setattr(ml, "FOREST_VALUES_PER_TASK", 200, raising=False)
    r = np.random.RandomState(5)
    rows = [(i, float(a), float(b), int(a + r.randn() > 0)) for i, (a, b) in enumerate(r.randn(400, 2))]
    f = spark.createDataFrame(rows, "i int, a double, b double, target int")
    p = [ml.predict(ml.fit(dealt, ["a", "b"], "rf"), f).orderBy("i").toPandas().p_up for dealt in (f.repartition(3, "i"), f.repartition(7, "b"))]
    np.testing.assert_allclose(p[0], p[1], atol=1e-9)
    assert 0.3 < p[0].mean() < 0.7 and p[0].std() > 0.05


@pytest.mark.parametrize("case", ["none", "rising"])
def test_images_without_both_targets_predict_nothing(spark, case):
    pair = F.array(F.struct(F.lit(0.0).alias("birth"), F.col("close").alias("death")))
    out = ml.evaluate(ml.ablate_images(few_rows(spark, case).withColumns({"h0": pair, "h1": pair}), ["x"], 2, 3), by=("condition", "fold", "symbol"))
    assert out.columns[:3] == ["condition", "fold", "symbol"] and out.count() == 0


@pytest.mark.parametrize("case", ["none", "rising"])
def test_importances_without_both_targets_are_none(spark, case):
    out = ml.base_importances(few_rows(spark, case), ["x"], ("rf",))
    assert out.columns == ["kind", "feature", "importance"] and out.count() == 0


@pytest.mark.parametrize("case", ["none", "rising"])
def test_falls_without_both_targets_are_none(spark, case):
    out = ml.importance(few_rows(spark, case), {"g": ["x"]}, 1)
    assert out.columns == ["feature_group", "feature", "importance"] and out.count() == 0


def no_events(spark, tmp_path):
    """A folder whose events are none."""
    tb.table(spark, SF, "events").filter("false").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_live_scores_without_rows(spark, tmp_path):
    from cairn.plans import queries as q

    out = q.live_scores(spark, no_events(spark, tmp_path))
    assert out.columns == ["symbol", "ts", "p_up", "signal", "position_size"] and out.count() == 0


@pytest.mark.parametrize("case", ["none", "rising"])
@pytest.mark.parametrize("kind", ["logistic", "rf"])
def test_leaving_one_out_without_both_targets_predicts_nothing(spark, kind, case):
    out = ml.evaluate(ml.leave_one_out(few_rows(spark, case), ["x"], kind))
    assert out.columns == ["fold", "symbol", "n_signals", "n_correct", "direction_accuracy", "auc"] and out.count() == 0


def test_leaving_one_out_stores_each_row_once(spark, monkeypatch):
    r = np.random.RandomState(3)
    rows = [(f"s{i % 4}", datetime(2024, 1, 1) + timedelta(hours=i), 1.0, 0.0, int(a + 0.3 * (i % 4) * b + r.randn() > 0), float(a), float(b)) for i, (a, b) in enumerate(r.randn(300, 2))]
    f = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, future_return double, target int, a double, b double")
    put, stored = Stored.put, []
    monkeypatch.setattr(Stored, "put", lambda self, df, name: (stored.append(df.count()), put(self, df, name))[1])
    out = ml.leave_one_out(f, ["a", "b"]).orderBy("ts").toPandas()
    assert stored == [300] and len(out) == 300
    monkeypatch.undo()
    for s in ("s0", "s3"):  # as by a model of the other symbols alone
        train = f.filter(F.col("symbol") != s).withColumn("g", F.lit(0))
        models = ml.fit_logistics(train, "g", ["a", "b"])
        want = ml.score_logistics(f.filter(F.col("symbol") == s).withColumn("g", F.lit(0)), "g", ["a", "b"], models).orderBy("ts").toPandas()
        np.testing.assert_allclose(out[out.symbol == s].p_up, want.p_up, atol=1e-9)


def test_loao_returns_only_without_rows(spark, tmp_path):
    from cairn.plans import queries as q

    assert q.loao_returns_only(spark, no_events(spark, tmp_path)).count() == 0


@pytest.mark.parametrize("case", ["none", "rising"])
def test_ensemble_without_both_targets_predicts_nothing(spark, case):
    out = ml.ensemble(few_rows(spark, case), ["x"], ("logistic", "rf"), horizon=3)
    assert out.columns == ["fold", *ml.KEPT, "p_logistic_0", "p_rf_1", "p_up"] and out.count() == 0
    assert ml.holdout(few_rows(spark, case), ["x"], "rf").count() == 0


def test_homology_queries_take_every_window(spark):
    from cairn.plans import queries as q

    d = "/root/testdata/sf0.001"
    want = sum(max(0, r["count"] - 19) for r in ft.base_features(q._bars(spark, d)).groupBy("symbol").count().collect())
    assert want > 0 and q.rips_scalars(spark, d).count() == q.persistence_images(spark, d).count() == want


def test_models_are_as_large_as_the_reference(spark, monkeypatch):
    from cairn.plans import queries as q

    assert ml.classifier("rf", 100).getNumTrees() == 200 and ml.classifier("gbm", 100).getMaxIter() == 120
    asked = []
    monkeypatch.setattr(q, "_ready", lambda s, d: None)
    monkeypatch.setattr(ml, "cross_validate", lambda df, columns, kind, k, horizon: asked.append((columns, kind, k)))
    monkeypatch.setattr(ml, "evaluate", lambda *a: None)
    q.cv_rf(spark, "")
    q.cv_gbm(spark, "")
    assert asked == [(ft.ML_FEATURES, "rf", 5), (ft.ML_FEATURES, "gbm", 5)]


def test_null_takes_the_default_number_of_replicates(spark):
    from cairn.plans import queries as q

    n = q.permutation_null(spark, "/root/testdata/sf0.01")
    assert n.filter("replicate >= 0").select("replicate").distinct().count() == 99


def test_null_by_groups_is_the_null_of_the_tasks(spark):
    f = Stored(spark).put(ft.add_targets(ft.base_features(tb.bars(tb.table(spark, SF, "events"))), 3), "rows")
    options = {"rounds": 3, "threshold": (0.5, 0.52), "block": 12, "horizon": 3}
    small = {r.replicate: r.value for r in ml.permutation_null(f, ["rv_20", "bb_width"], **options).collect()}
    large = {r.replicate: r.value for r in ml.permutation_null(f, ["rv_20", "bb_width"], **options, most_values=0).collect()}
    assert set(small) == set(large) == {-1, 0, 1, 2} and all(abs(small[r] - large[r]) < 1e-9 for r in small)


def test_logistic_models_of_groups_match_one_in_memory(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)) * [1.0, 50.0, 0.01]
    y = (x[:, 0] + x[:, 1] / 50 + rng.normal(size=600) > 0).astype(int)
    rows = [(i % 3 if i < 590 else 7, float(a), float(b), float(c), int(t) if i < 590 else 1) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, target int").repartition(5)
    models = ml.fit_logistics(df, "g", ["a", "b", "c"])
    assert set(models) == {0, 1, 2}  # 7 has one target
    got = {(r.a, r.b): r.p_up for r in ml.score_logistics(df, "g", ["a", "b", "c"], models).collect()}
    for g in range(3):
        at = [i for i in range(590) if i % 3 == g]
        p = ml.Logistic().fit(x[at], y[at].astype(float)).predict(x[at])
        assert all(abs(got[x[i, 0], x[i, 1]] - q) < 1e-7 for i, q in zip(at, p))


def test_p_values(spark):
    cases = [(0.0, 5.0), (2.0, 1.0), (2.0, 10.0), (-3.5, 40.0), (1.96, 5000.0), (30.0, 3.0), (0.5, 2.0)]
    got = spark.createDataFrame(cases, "t double, df double").select("t", "df", student_p(F.col("t"), F.col("df")).alias("p")).collect()
    assert all(abs(r.p - t_test_p(r.t, r.df)) < 1e-6 for r in got)


def held_by_hand(prices, p, horizon, warmup, threshold, fee=0.00075, slip=0.0005, most=0.5, capital=10000.0):
    cash, units, entry, paid, until, equity, pnls = capital, 0.0, 0.0, 0.0, -1, [], []
    for t, (price, q) in enumerate(zip(prices, p)):
        worth = cash + units * price
        if t >= warmup and units and t >= until:
            out = price * (1 - slip if units > 0 else 1 + slip)
            cost = abs(units) * out * fee
            pnls.append((out - entry) * units - cost - paid)
            cash, units = cash + units * out - cost, 0.0
        if t >= warmup and not units and q is not None and (q > threshold or q < 1 - threshold):
            value = worth * most * 2 * abs(q - 0.5)
            paid, until = value * fee, t + horizon
            entry = price * (1 + slip if q > threshold else 1 - slip)
            units = (value - paid) / entry if q > threshold else -value / entry
            cash += -value if q > threshold else value - paid
        equity.append(cash + units * price)
    if units:
        out = prices[-1] * (1 - slip if units > 0 else 1 + slip)
        equity[-1] = cash + units * out - abs(units) * out * fee
    return equity, pnls


def test_positions_that_last_a_horizon(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for s in ("a", "b", "c"):
        prices = (100 * np.exp(np.cumsum(rng.normal(size=90) * 0.03))).tolist()
        p = [None if rng.random() < 0.1 else float(rng.random()) for _ in prices]
        want[s] = held_by_hand(prices, p, 7, 10, 0.6)
        rows += [(s, datetime(2024, 1, 1) + timedelta(hours=i), float(c), q) for i, (c, q) in enumerate(zip(prices, p))]
    ledger = bt.run_held(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, p_up double"), horizon=7, warmup=10, threshold=0.6).collect()
    for s, (equity, pnls) in want.items():
        mine = sorted((r for r in ledger if r.symbol == s), key=lambda r: r.idx)
        assert np.allclose([r.equity for r in mine], equity) and np.allclose([r.trade.pnl for r in mine if r.trade], pnls) and len(pnls) > 3


def test_candle_pages(spark, tmp_path):
    start, step = 1_700_000_000, 3600
    for page in range(3):  # the second page can't be had
        if page != 1:
            first = start + page * 10 * step
            candles = [[first + i * step, 1.0, 3.0, 2.0, 2.5, float(i)] for i in range(10)]
            (tmp_path / f"{first}-{min(first + 10 * step, start + 25 * step)}.json").write_text(json.dumps(candles))
    spark.dataSource.register(CandleSource)
    df = spark.read.format("candles").option("url", f"{tmp_path}/{{start}}-{{end}}.json").options(start=str(start), end=str(start + 25 * step), page="10", pause="0").load()
    assert df.columns == ["ts", "open", "high", "low", "close", "volume"]
    assert df.dropDuplicates(["ts"]).count() == 15 and df.agg(F.max("high")).first()[0] == 3.0
    bars = df.withColumn("symbol", F.lit("x")).drop("volume")
    volumes = df.withColumn("symbol", F.lit("x")).filter("volume <> 4")
    assert tb.with_volume(bars, volumes).filter("volume = 3").count() == 4  # the fourth, and the one without its own, in two pages


def test_cache_and_log(spark, tmp_path):
    df = spark.range(5)
    assert tb.read_cached(spark, str(tmp_path / "t"), "k") is None
    tb.write_cached(df, str(tmp_path / "t"), "k")
    assert tb.read_cached(spark, str(tmp_path / "t"), "other") is None and tb.read_cached(spark, str(tmp_path / "t"), "k").count() == 5
    for i in range(2):
        spark.range(i * 3, i * 3 + 3).write.mode("append").parquet(str(tmp_path / "in"))
        st.append_log(spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "log")).collect()) == list(range(6))


def test_average_stream_leaves_out_what_comes_late(spark):
    bars = spark.createDataFrame([("a", datetime(2024, 1, 1, h), float(h), 1.0) for h in (0, 1, 2, 3, 4, 5)], "symbol string, ts timestamp_ntz, close double, volume double")
    got = sorted((r.ts.hour, r.n_held, r.average) for r in st.replay_averages(spark, bars, 3).collect())
    assert got == [(0, 1, 0.0), (1, 2, 0.5), (2, 3, 1.0), (3, 3, 2.0), (4, 3, 3.0), (5, 3, 4.0)]


def test_dbscan_clusters():
    x = np.array([[0.0], [0.5], [1.0], [5.0], [5.4], [20.0]])
    assert mp.dbscan(x, 0.6, 2).tolist() == [0, 0, 0, 1, 1, -1]
    assert mp.dbscan(x, 0.6, 3).tolist() == [0, 0, 0, -1, -1, -1]  # the ends are near a core


def test_column_selection(spark):
    df = spark.createDataFrame([(1, "x", 2.0, 3)], "vol_a int, name string, vol_b double, id bigint")
    assert with_prefix(df, "vol_") == ["vol_a", "vol_b"] and numeric(df, without=("id",)) == ["vol_a", "vol_b"]


def test_arrays_and_reports(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(12.0).reshape(2, 3, 2))
    np.savez(tmp_path / "b.npz", x=np.arange(3), y=np.zeros((0, 4)))
    got = {(r.file, r.name, r.idx): (r.shape, r["values"]) for r in tb.read_arrays(spark, str(tmp_path)).collect()}
    assert got[("a.npy", "", 1)] == ([3, 2], [6.0, 7.0, 8.0, 9.0, 10.0, 11.0])
    assert sorted(k for k in got if k[0] == "b.npz") == [("b.npz", "x", i) for i in range(3)] and got[("b.npz", "x", 2)] == ([], [2.0])
    tb.write_report(spark.range(2), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_a_target_needs_its_horizon(spark):
    """The last rows have no target; a rule that labels them all down would count them."""
    rows = ft.add_targets(spark.createDataFrame(series(), SCHEMA), 24)
    assert rows.count() == 120 - 24 and rows.filter("future_price is null").count() == 0
