"""One query for each operator, over the mounted tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import numeric, with_prefix
from ..operators import backtest as bt
from ..operators import features as ft
from ..operators import homology as hom
from ..operators import joins as jn
from ..operators import mapper as mp
from ..operators import models as ml
from ..operators import signals as sg
from ..operators import tuning as tu
from ..operators import validation as va
from ..session import Stored
from ..sources import tables as tb
from ..streaming import bars as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _events(s, d):
    return tb.table(s, d, "events")


def _bars(s, d, width="hour"):
    return tb.bars(_events(s, d), width)


def _frame(s, d):
    return ft.feature_frame(_bars(s, d))


def _ready(s, d, horizon=24):
    # read many times by fits: written once, which also keeps the later plans short
    return Stored(s).put(ft.add_targets(ft.base_features(_bars(s, d)), horizon), "ready")


# bars, features, targets


@query
def bars_hourly(s, d):
    return _bars(s, d)


@query
def bars_daily(s, d):
    return _bars(s, d, "day")


@query
def bars_six_hours(s, d):
    return _bars(s, d, "6h").select("symbol", "ts", "open", "close", "volume")


@query
def base_features(s, d):
    return ft.base_features(_bars(s, d))


@query
def volatility(s, d):
    return _frame(s, d).select("symbol", "ts", "gk_vol_20", "gk_vol_60", "parkinson_20", "rv_20", "rv_60")


@query
def rsi_bollinger(s, d):
    return _frame(s, d).select("symbol", "ts", "rsi_centered", "bb_position", "bb_width")


@query
def macd(s, d):
    return _frame(s, d).select("symbol", "ts", "macd_line", "macd_signal", "macd_normalized", "macd_signal_normalized", "trend_strength")


@query
def vol_regime_rank(s, d):
    return _frame(s, d).select("symbol", "ts", "vol_regime")


@query
def volume_features(s, d):
    return _frame(s, d).select("symbol", "ts", "vol_zscore_20", "vol_momentum", "vol_ratio_5_20", "vol_pressure")


@query
def daily_indicators(s, d):
    return ft.daily_indicators(_bars(s, d))


@query
def hourly_indicators(s, d):
    return ft.hourly_indicators(_bars(s, d))


@query
def targets_h24(s, d):
    return ft.add_targets(_bars(s, d), 24).select("symbol", "ts", "close", "future_price", "future_return", "target")


@query
def target_balance(s, d):
    t = ft.add_targets(_bars(s, d), 24)
    return t.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("target").alias("share_up"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query
def causal_zscore(s, d):
    return ft.causal_zscores(_bars(s, d), ["close", "volume"]).select("symbol", "ts", "close_cz", "volume_cz")


@query
def global_zscore(s, d):
    return ft.global_zscores(_bars(s, d), ["close", "volume"]).select("symbol", "ts", "close_z", "volume_z")


@query
def sliding_windows(s, d):
    w = ft.sliding_windows(_bars(s, d), ["close", "volume"], 20, 5)
    total = F.aggregate("points", F.lit(0.0), lambda a, p: a + p[0])
    return w.select("symbol", "ts", F.col("end_idx").cast("bigint").alias("end_idx"), F.size("points").alias("n_points"), F.col("points")[0][0].alias("first_close"), total.alias("sum_close"))


@query
def survivorship(s, d):
    symbol = F.when(F.col("symbol") == "view", "LUNA").when(F.col("symbol") == "click", "ICP").otherwise(F.col("symbol"))
    out = ft.survivorship(_frame(s, d).withColumn("symbol", symbol), tb.delisting_dimension(s))
    return out.select("symbol", "ts", "is_delisted", "months_since_delisting", "exchange_concentration")


@query
def interactions(s, d):
    return ft.interactions(_frame(s, d)).select("symbol", "ts", "vol_volume_interaction", "momentum_trend_interaction", "accel_whale_interaction")


@query
def comprehensive_features(s, d):
    df = ft.synthetic_spread(ft.synthetic_onchain(ft.base_features(_bars(s, d)), ["active_addresses_z", "whale_supply_pct_z"]))
    df = ft.interactions(ft.survivorship(df, tb.delisting_dimension(s)))
    return ft.fill_forward(df, ["exchange_concentration", "spread_persistence", "accel_whale_interaction"]).select("symbol", "ts", "exchange_concentration", "spread_pct", "spread_zscore_20", "spread_persistence", "accel_whale_interaction")


@query
def forward_fill(s, d):
    return ft.fill_forward(_frame(s, d), ["rv_20", "bb_width"]).select("symbol", "ts", "rv_20", "bb_width")


@query
def drop_synthetic(s, d):
    df = _bars(s, d).withColumns({"mvrv_ratio_z": F.lit(1.0), "spread_zscore_20": F.lit(0.0), "spread_pct": F.col("close") / 100.0, "hash_rate": F.col("volume")})
    return ft.drop_synthetic(df).select("symbol", "ts", *[c for c in ("mvrv_ratio_z", "spread_zscore_20", "spread_pct", "hash_rate") if not ft.is_synthetic(c)])


@query
def onchain_zscore(s, d):
    return ft.z_columns(_bars(s, d, "day"), ["volume", "close"]).select("symbol", "ts", "volume_z", "close_z")


# sources and joins


@query
def venue_ids(s, d):
    known = {"click": "XBT-USD", "view": "ETH-EUR"}
    return _events(s, d).select("event_type").distinct().select("event_type", tb.venue_ids(F.col("event_type"), known).alias("venue_id"))


@query
def first_source(s, d):
    closes = tb.venue_closes(_events(s, d))
    a = closes.filter("venue = 'even' and symbol <> 'view'").select("symbol", "ts", "close")
    b = closes.filter("venue = 'odd'").select("symbol", "ts", "close")
    return tb.first_source(a, b)


@query
def event_properties(s, d):
    k = F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999999")).cast("bigint")
    e = _events(s, d).withColumn("k", k).withColumn("back", F.conv(F.hex("k"), 16, 10).cast("bigint"))
    return e.groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.sum("back").alias("sum_back"), F.count_distinct("user_id").alias("n_users"))


@query
def supported_symbols(s, d):
    e = _events(s, d).select("event_type").distinct()
    return e.select("event_type", F.col("event_type").isin("click", "view").alias("supported"))


@query
def asof_backward(s, d):
    e = _events(s, d)
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return jn.asof_backward(left, e.filter("event_type = 'click'").select("user_id", "ts", "value"), "user_id", "ts", "value", "click_value")


@query
def asof_nearest(s, d):
    e = _events(s, d)
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return jn.asof_nearest(left, e.filter("event_type = 'click'").select("user_id", "ts", "value"), "user_id", "ts", "value", "click_value")


@query
def attach_daily(s, d):
    daily = _bars(s, d, "day").select("symbol", "ts", F.col("close").alias("day_close"), F.col("volume").alias("day_volume")).filter(F.dayofmonth("ts") % 3 != 0)
    return jn.attach_daily(_bars(s, d), daily, ["day_close", "day_volume"]).select("symbol", "ts", "close", "day_close", "day_volume")


@query
def attach_coverage(s, d):
    return attach_daily(s, d).groupBy("symbol").agg(F.count("*").alias("n"), (F.count("day_close") / F.count("*")).alias("coverage"))


@query
def venue_spread(s, d):
    return jn.venue_spread(tb.venue_closes(_events(s, d)), "even", "odd")


@query
def gap_fill(s, d):
    c = tb.venue_closes(_events(s, d))
    a = c.filter("venue = 'even'").select("symbol", "ts", "close").filter(F.dayofmonth("ts") % 4 != 0)
    return jn.fill_gaps(a, c.filter("venue = 'odd'").select("symbol", "ts", "close"), ["symbol", "ts"])


@query
def source_divergence(s, d):
    c = tb.venue_closes(_events(s, d))
    return jn.divergence(c.filter("venue = 'even'"), c.filter("venue = 'odd'"), ["symbol", "ts"])


@query
def merge_metrics(s, d):
    c = tb.venue_closes(_events(s, d))
    a = c.filter("venue = 'even' and symbol in ('click', 'view')").select("symbol", "ts", F.col("close").alias("even_close"))
    b = c.filter("venue = 'odd' and symbol in ('view', 'purchase')").select("symbol", "ts", F.col("close").alias("odd_close"))
    return jn.merge_metrics([a, b, _bars(s, d, "day").filter("symbol = 'view'").select("symbol", "ts", "volume")], ["symbol", "ts"])


@query
def first_per_key(s, d):
    w = W.partitionBy("user_id", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    return _events(s, d).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("user_id", "event_id", "ts", "value")


@query
def param_grid(s, d):
    a = s.createDataFrame([(x,) for x in (0.55, 0.60, 0.65, 0.70)], "threshold double")
    b = s.createDataFrame([("logistic",), ("rf",), ("gbm",)], "model string")
    return a.crossJoin(b).crossJoin(s.createDataFrame([("none",), ("median",)], "vol_filter string"))


@query
def loao_theta(s, d):
    """Train rows of each symbol's model: all but its own, that is the total less its own."""
    own = _bars(s, d).groupBy("symbol").agg(F.count("*").alias("n"))
    total = own.agg(F.sum("n").alias("total"), F.count("*").alias("symbols"))
    out = own.crossJoin(F.broadcast(total)).filter("symbols > 1")  # one row
    return out.select(F.col("symbol").alias("held_out"), (F.col("total") - F.col("n")).alias("n_train"), (F.col("symbols") - 1).alias("n_symbols"))


@query
def pool_union(s, d):
    b = _bars(s, d)
    majors = F.col("symbol").isin("click", "view")
    return b.filter(majors).unionByName(b.filter(~majors)).groupBy("symbol").agg(F.count("*").alias("n"), F.avg("close").alias("avg_close"))


@query
def top_bars(s, d):
    return _bars(s, d).orderBy(F.desc("volume"), "symbol", "ts").limit(10).select("symbol", "ts", "volume")


# regimes and signals


@query
def regime_mask_vol(s, d):
    f = _frame(s, d)
    return f.select("symbol", "ts", *[F.coalesce(sg.vol_mask(t), F.lit(False)).alias(f"above_{t}") for t in ("median", "q75", "q25")])


@query
def regime_mask_trend(s, d):
    f = _frame(s, d)
    return f.select("symbol", "ts", *[F.coalesce(sg.trend_mask(m), F.lit(False)).alias(m) for m in ("up", "down", "strong")])


@query
def regime_filter_hold(s, d):
    f = sg.momentum(_frame(s, d))
    return sg.hold_outside(f, sg.vol_mask("median"), sg.volume_mask(f)).select("symbol", "ts", "signal", "position_size")


@query
def regime_labels(s, d):
    return sg.regime_labels(_frame(s, d)).select("symbol", "ts", "regime")


@query
def time_regimes(s, d):
    return sg.time_regimes(_bars(s, d)).groupBy("symbol", "regime").agg(F.count("*").alias("n"), F.avg("close").alias("avg_close"), F.sum("volume").alias("sum_volume"))


@query
def momentum_signals(s, d):
    return sg.momentum(_bars(s, d)).select("symbol", "ts", "signal", "position_size")


@query
def vol_breakout_signals(s, d):
    return sg.vol_breakout(ft.base_features(_bars(s, d))).select("symbol", "ts", "signal", "position_size")


@query
def ma_crossover_signals(s, d):
    return sg.ma_crossover(_bars(s, d)).select("symbol", "ts", "signal", "position_size")


@query
def hold_and_cash_signals(s, d):
    a, b = sg.buy_and_hold(_bars(s, d)), sg.cash(_bars(s, d))
    return a.select("symbol", "ts", F.lit("hold").alias("rule"), "signal", "position_size").union(b.select("symbol", "ts", F.lit("cash"), "signal", "position_size"))


@query
def random_signals(s, d):
    return sg.random_signals(_bars(s, d)).select("symbol", "ts", "signal", "position_size")


def _probability(df):
    return df.withColumn("p_up", 1.0 / (1.0 + F.exp(-2.0 * F.col("rsi_centered"))))


@query
def probability_signals(s, d):
    return sg.from_probability(_probability(_frame(s, d)), threshold=0.6).select("symbol", "ts", "p_up", "signal", "position_size")


@query
def signal_summary(s, d):
    return sg.signal_summary(sg.momentum(_bars(s, d)))


# backtest


def _ledger(s, d, **options):
    return bt.run_backtest(sg.momentum(_bars(s, d)), fee=0.00075, slippage=0.0005, **options)


@query
def backtest_equity(s, d):
    return bt.drawdown(_ledger(s, d)).select("symbol", "idx", "ts", "equity", "drawdown")


@query
def backtest_trades(s, d):
    return bt.trades(_ledger(s, d))


@query
def backtest_short_trades(s, d):
    return bt.trades(_ledger(s, d, allow_short=True))


@query
def backtest_metrics(s, d):
    return bt.metrics(_ledger(s, d), _bars(s, d))


@query
def rule_ladder(s, d):
    f = ft.add_targets(ft.base_features(_bars(s, d)), 24)
    rules = {"momentum": sg.momentum(f), "vol_breakout": sg.vol_breakout(f), "ma_crossover": sg.ma_crossover(f), "buy_and_hold": sg.buy_and_hold(f), "cash": sg.cash(f)}
    every = None
    for name, df in rules.items():
        part = df.select(F.lit(name).alias("rule"), "symbol", "signal", "future_return")
        every = part if every is None else every.unionByName(part)
    return va.with_wilson(va.direction_accuracy(every, ["rule", "symbol"]))


# splits and statistics


@query
def temporal_split(s, d):
    return va.temporal_split(_bars(s, d)).groupBy("symbol", "split").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query
def walk_forward_split(s, d):
    return va.walk_forward_split(_bars(s, d)).groupBy("symbol", "split").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query
def kfold_folds(s, d):
    return va.kfold(_bars(s, d)).select("symbol", "n", "fold", "train_end", "test_end")


@query
def purged_folds(s, d):
    return va.purged(va.kfold(_bars(s, d)), 24, 5).select("symbol", "fold", "n_train", "n_val", "n_test")


@query
def fold_roles(s, d):
    return va.fold_rows(_bars(s, d), 5, 24).groupBy("symbol", "fold", "role").agg(F.count("*").alias("n"), F.avg("close").alias("avg_close"))


@query
def direction_accuracy(s, d):
    return va.direction_accuracy(sg.momentum(ft.add_targets(_bars(s, d), 24)), ["symbol"])


@query
def wilson_interval(s, d):
    return va.with_wilson(va.direction_accuracy(sg.momentum(ft.add_targets(_bars(s, d), 24)), ["symbol"]))


@query
def weighted_accuracy(s, d):
    folds = va.direction_accuracy(sg.time_regimes(sg.momentum(ft.add_targets(_bars(s, d), 24)), 5), ["symbol", "regime"])
    return va.weighted_accuracy(folds, ["symbol"])


@query
def t_statistic(s, d):
    return va.t_statistic(ft.add_targets(_bars(s, d), 24), "future_return", ["symbol"])


@query
def t_two_groups(s, d):
    return va.welch_free_t(ft.add_targets(_bars(s, d), 24), "future_return", "symbol", "click", "view")


@query
def block_shuffle(s, d):
    return va.block_shuffle(ft.add_targets(_bars(s, d), 24), "target", 48, 7).select("symbol", "ts", "target", "shuffled")


@query
def permutation_p(s, d):
    t = ft.add_targets(_bars(s, d), 24)
    null = t.groupBy("symbol", F.dayofmonth("ts").alias("day")).agg(F.avg("future_return").alias("value"))
    return va.permutation_p(t.groupBy("symbol").agg(F.avg("future_return").alias("value")), null, ["symbol"])


@query
def break_even(s, d):
    t = ft.add_targets(_bars(s, d), 24)
    return va.break_even(t, va.direction_accuracy(sg.momentum(t), ["symbol"]), ["symbol"])


@query
def verdicts(s, d):
    a = va.direction_accuracy(sg.momentum(ft.add_targets(_bars(s, d), 24)), ["symbol"])
    wins = (F.col("direction_accuracy") > 0.5).cast("int") * 3 + (F.col("n_signals") > 100).cast("int")
    return a.select("symbol", va.verdict(wins, (F.col("direction_accuracy") < 0.5).cast("int") * 2).alias("verdict"))


@query
def auc_by_symbol(s, d):
    return va.auc(_probability(ft.add_targets(_frame(s, d), 24)), ["symbol"])


@query
def bootstrap_sharpe(s, d):
    r = ft.daily_indicators(_bars(s, d)).withColumn("r", F.col("return_1d"))
    return va.bootstrap_sharpe(r, "r")


@query
def bootstrap_accuracy(s, d):
    right = ((F.col("signal") == "BUY") & (F.col("future_return") > 0)) | ((F.col("signal") == "SELL") & (F.col("future_return") < 0))
    w = F.col("w")
    accuracy = F.try_divide(F.sum(F.when(right, w)).cast("double"), F.sum(F.when(F.col("signal") != "HOLD", w)).cast("double"))
    row = [F.col("symbol"), F.unix_seconds(F.col("ts").cast("timestamp"))]
    return va.bootstrap_metric(sg.momentum(ft.add_targets(_bars(s, d), 24)), accuracy, ["symbol"], row, 200)


@query
def t_test(s, d):
    return va.t_test(ft.add_targets(_bars(s, d), 24), "future_return", ["symbol"])


@query
def mean_accuracy(s, d):
    folds = va.direction_accuracy(sg.time_regimes(sg.momentum(ft.add_targets(_bars(s, d), 24)), 5), ["symbol", "regime"])
    return va.mean_accuracy(folds, ["symbol"])


@query
def multi_aggregate(s, d):
    r = sg.time_regimes(ft.add_targets(_bars(s, d), 24))
    return r.groupBy("regime", "symbol").agg(F.avg("future_return").alias("avg_return"), F.stddev_samp("future_return").alias("sd_samp"), F.stddev_pop("future_return").alias("sd_pop"), F.sum("volume").alias("sum_volume"), F.percentile("close", F.lit(0.5)).alias("median_close"))


@query
def regime_rollup(s, d):
    r = sg.time_regimes(ft.add_targets(_bars(s, d), 24))
    out = r.groupingSets([[F.col("regime")], []], F.col("regime")).agg(F.count("*").alias("n"), F.avg("target").alias("share_up"))
    return out.withColumn("regime", F.coalesce("regime", F.lit(-1)))


# topology


def _clouds(s, d, stride=1):
    f = Stored(s).put(ft.base_features(_bars(s, d)), "features")
    w = W.partitionBy("symbol").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    one = lambda c: F.when(F.stddev_pop(c).over(w) == 0, 1.0).otherwise(F.stddev_pop(c).over(w))
    centre, scale = F.array(*[F.avg(c).over(w) for c in ft.TDA_FEATURES]), F.array(*[one(c) for c in ft.TDA_FEATURES])
    return ft.sliding_windows(f, ft.TDA_FEATURES, 20, stride, [centre.alias("centre"), scale.alias("scale"), F.col("close")])


def _diagrams(s, d, stride=1):
    return hom.diagrams(_clouds(s, d, stride), ["symbol", "ts", "end_idx", "close"], "points", "centre", "scale")


@query
def rips_scalars(s, d):
    return hom.scalar_features(_diagrams(s, d), ["symbol", "ts", "end_idx"])


@query
def rips_embeddings(s, d):
    """Diagrams of the vectors of each label, 20 at a time by id."""
    e = tb.table(s, d, "embeddings").withColumn("i", F.floor((F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1) / 20))
    c = e.groupBy("label", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda r: r["embedding"]).alias("points"))
    return hom.scalar_features(hom.diagrams(c, ["label", "i"]), ["label", "i"])


@query
def image_bounds(s, d):
    return hom.image_bounds(_diagrams(s, d))


@query
def persistence_images(s, d):
    stored = Stored(s)
    dg = stored.put(_diagrams(s, d), "diagrams")
    b = hom.image_bounds(dg.join(dg.groupBy("symbol").agg((F.max("end_idx") * 0.8).alias("cut")), "symbol").filter("end_idx < cut")).first()  # two numbers
    im = hom.persistence_images(dg, (b["h0_top"], b["h1_top"]), ["symbol", "end_idx"])
    return im.select("symbol", "end_idx", F.size("image").alias("n_pixels"), F.aggregate("image", F.lit(0.0), lambda a, x: a + x).alias("mass"))


@query
def topo_rule_signals(s, d):
    f = hom.scalar_features(_diagrams(s, d, 1), ["symbol", "ts", "close"])
    return sg.from_topology(f).select("symbol", "ts", "c1_zscore", "entropy_zscore", "confidence", "signal", "position_size")


@query
def rule_signals_z(s, d):
    """The topological rule on volatility and band width, which SQL has."""
    f = ft.base_features(_bars(s, d))
    return sg.from_topology(f, "rv_20", "bb_width").select("symbol", "ts", "c1_zscore", "entropy_zscore", "confidence", "signal", "position_size")


def _scored(s, d):
    # the rule on volatility and band width, as in rule_signals_z; read by the tuning and by the test
    f = ft.add_targets(ft.base_features(_bars(s, d)), 24)
    return Stored(s).put(sg.topology_scores(f, "rv_20", "bb_width").select("symbol", "ts", "close", "future_return", "c1_zscore", "entropy_zscore", "drift", "confidence"), "scored")


@query
def rule_tuning(s, d):
    f = _scored(s, d)
    return tu.tuned_test(f, tu.best_rise(f))


@query
def rule_kfold(s, d):
    f = _scored(s, d)
    return tu.tuned_folds(f, tu.best_rise(f), 5, 24)


@query
def rule_across_symbols(s, d):
    f = _scored(s, d)
    return tu.across_symbols(f, tu.best_rise(f), "click")


# Mapper


def _entities(s, d):
    c, o, l = (tb.table(s, d, t) for t in ("customer", "orders", "lineitem"))
    days = F.count_distinct(F.to_date("o_orderdate"))
    a = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("total"), (F.count("*") / days).alias("velocity"), F.avg("o_totalprice").alias("avg_size"), (F.max("o_totalprice") / F.avg("o_totalprice")).alias("max_to_avg"), F.count_distinct("c_custkey").cast("double").alias("counterparts"))
    sup = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count_distinct("l_suppkey").cast("double").alias("suppliers"))
    return mp.standardise(a.join(sup, "c_nationkey"), ["total", "velocity", "avg_size", "max_to_avg", "counterparts", "suppliers"])


def _graph(s, d):
    stored = Stored(s)
    m = stored.put(mp.mapper_members(_entities(s, d), "c_nationkey", 4, 0.5, mp.l2_lens(), lambda x: mp.dbscan(x, 1.8, 2)), "members")
    return m, mp.mapper_nodes(m), mp.mapper_edges(m)


@query
def mapper_cover(s, d):
    p = jn.cover_intervals(_entities(s, d).select("c_nationkey", "x"), mp.l2_lens(), 8, 0.3)
    return p.select("c_nationkey", F.col("interval").cast("bigint").alias("interval"), "lens")


@query
def mapper_nodes(s, d):
    return _graph(s, d)[1].select("node_id", "interval", "size", "lens_mean", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query
def mapper_edges(s, d):
    return _graph(s, d)[2]


@query
def mapper_summary(s, d):
    _, n, e = _graph(s, d)
    return mp.graph_summary(n, e)


@query
def mapper_patterns(s, d):
    _, n, e = _graph(s, d)
    return mp.graph_patterns(n, e)


@query
def mapper_bottlenecks(s, d):
    _, n, e = _graph(s, d)
    return mp.bottlenecks(mp.graph_patterns(n, e))


@query
def mapper_communities(s, d):
    _, n, e = _graph(s, d)
    return mp.communities(mp.graph_patterns(n, e)).select("rank", "component", "size")


@query
def mapper_rings(s, d):
    _, n, e = _graph(s, d)
    return mp.rings(n, e).select("ring", F.array_join("nodes", ",").alias("nodes"))


@query
def mapper_report(s, d):
    _, n, e = _graph(s, d)
    out = mp.report(n, e)
    return out.withColumns({"bottlenecks": F.array_join("bottlenecks", ","), "largest_communities": F.array_join(F.transform("largest_communities", lambda x: x.cast("string")), ",")})


@query
def mapper_ring_count(s, d):
    _, n, e = _graph(s, d)
    return mp.ring_count(n, e, mp.graph_patterns(n, e))


@query
def mapper_pca(s, d):
    p = mp.pca_lens(_entities(s, d))
    m = mp.mapper_members(p, "c_nationkey", 4, 0.5, None, lambda x: mp.dbscan(x, 1.8, 2))
    return m.groupBy("interval", "label").agg(F.count("*").alias("size"))


# models


@query
def cv_logistic(s, d):
    return ml.evaluate(ml.cross_validate(_ready(s, d), ft.ML_FEATURES, "logistic", 5, 24), 0.55)


@query
def cv_rf(s, d):
    return ml.evaluate(ml.cross_validate(_ready(s, d), ft.ML_FEATURES, "rf", 5, 24), 0.55)


@query
def cv_gbm(s, d):
    return ml.evaluate(ml.cross_validate(_ready(s, d), ft.ML_FEATURES, "gbm", 5, 24), 0.55)


@query
def grid_search(s, d):
    return ml.grid(ml.cross_validate(_ready(s, d), ft.ML_FEATURES, "logistic", 5, 24), [0.5, 0.55, 0.6, 0.65], ["none", "median"])


@query
def loao_logistic(s, d):
    return ml.evaluate(ml.leave_one_out(_ready(s, d), ft.ML_FEATURES), 0.55)


@query
def holdout_eval(s, d):
    return ml.evaluate(ml.holdout(_ready(s, d), ft.ML_FEATURES, horizon=24), 0.55)


@query
def ablation_shuffled(s, d):
    return ml.evaluate(ml.cross_validate(_ready(s, d), ft.ML_FEATURES, "logistic", 5, 24, 5, shuffled=["rv_20", "bb_width"]), 0.55)


@query
def ablation_images(s, d):
    stored = Stored(s)
    f, dg = _ready(s, d), stored.put(_diagrams(s, d, 1).select("symbol", "ts", "h0", "h1"), "diagrams")
    return ml.evaluate(ml.ablate_images(f.join(dg, ["symbol", "ts"]), ft.TDA_FEATURES, 5, 24), 0.55, ("condition", "fold", "symbol"))


@query
def walkforward(s, d):
    return ml.walk_forward(_ready(s, d), ft.ML_FEATURES, 24, 80, 48)


_HELD = {"horizon": 24, "warmup": 100, "threshold": 0.55}


@query
def walkforward_pnl(s, d):
    """Positions that last a day, by a given p_up."""
    return bt.held_metrics(bt.run_held(_probability(ft.base_features(_bars(s, d))), **_HELD), warmup=_HELD["warmup"])


@query
def walkforward_trades(s, d):
    ledger = bt.run_held(_probability(ft.base_features(_bars(s, d))), **_HELD)
    return bt.trades(ledger).select("symbol", "side", "exit_idx", "pnl")


@query
def walkforward_model_pnl(s, d):
    """The same by a model that is fitted again every 48 bars."""
    f = _ready(s, d)
    p = ml.walk_forward(f, ft.ML_FEATURES, 24, 80, 48).select("symbol", "ts", F.when(F.col("idx") >= 80, F.col("p_up")).alias("p_up"))
    return bt.held_metrics(bt.run_held(f.join(p, ["symbol", "ts"]), horizon=24, warmup=80, threshold=0.55), warmup=80)


@query
def grid_given(s, d):
    """The grid of thresholds and filters on a given p_up."""
    f = _probability(ft.add_targets(ft.base_features(_bars(s, d)), 24)).withColumn("fold", F.lit(0))
    return ml.grid(f, [0.5, 0.55, 0.6, 0.65], ["none", "median"])


@query
def loao_returns_only(s, d):
    """Leave one symbol out, by its returns alone: what the features are compared with."""
    return ml.evaluate(ml.leave_one_out(_ready(s, d), ["log_return", "log_return_5", "log_return_24"]), 0.55)


@query
def ablation_groups(s, d):
    """Base features, topological scalars, both, and both with the scalars shuffled among the train rows."""
    stored = Stored(s)
    scalars = stored.put(hom.scalar_features(_diagrams(s, d), ["symbol", "ts"]), "scalars")
    topology = [c for c in scalars.columns if c not in ("symbol", "ts")]
    rows = stored.put(_ready(s, d).join(scalars, ["symbol", "ts"]), "rows")
    groups = {"base": ft.TDA_FEATURES, "tda": topology, "base_tda": [*ft.TDA_FEATURES, *topology]}
    return ml.evaluate(ml.ablate_columns(rows, groups, 5, 24, shuffle="tda"), 0.55, ("condition", "fold", "symbol"))


@query
def base_importances(s, d):
    return ml.base_importances(_ready(s, d), ft.TDA_FEATURES, ("rf",), horizon=24)


@query
def live_scores(s, d):
    """Each symbol's last features, scored by a model that was saved and read again; none if no model can be fitted."""
    path = f"{Stored(s).root}/model"
    latest = ml.latest_features(ft.base_features(_bars(s, d)))
    model = ml.fit(_ready(s, d).select(*ft.TDA_FEATURES, "target"), ft.TDA_FEATURES, "logistic")
    if model is None:
        scored = ml.unscored(latest)
    else:
        ml.save_model(model, path)
        scored = ml.predict(ml.load_model(path), latest)
    return sg.from_probability(scored, threshold=0.55).select("symbol", "ts", "p_up", "signal", "position_size")


@query
def permutation_null(s, d):
    return ml.permutation_null(_ready(s, d), ft.TDA_FEATURES, horizon=24)


@query
def permutation_grid(s, d):
    return ml.permutation_null(_ready(s, d), ft.TDA_FEATURES, threshold=(0.5, 0.55, 0.6), horizon=24)


@query
def permutation_grid_p(s, d):
    n = ml.permutation_null(_ready(s, d), ft.TDA_FEATURES, threshold=(0.5, 0.55, 0.6), block=24, horizon=24)
    n = Stored(s).put(n.withColumn("test", F.lit("grid")), "null")
    return va.permutation_p(n.filter("replicate < 0"), n.filter("replicate >= 0"), ["test"], require_null=True)


@query
def feature_importance(s, d):
    out = ml.importance(_ready(s, d), {"volatility": ["rv_20", "gk_vol_20"], "trend": ["macd_normalized", "trend_strength"]}, horizon=24)
    return out.groupBy("feature_group").agg(F.avg("importance").alias("mean_importance"), F.sum("importance").alias("sum_importance"))


@query
def stacked_ensemble(s, d):
    # three kinds of boosting libraries are stood in for by one, so three distinct models
    return ml.ensemble(_ready(s, d), ft.TDA_FEATURES, ("logistic", "rf", "gbm"), 24).select("symbol", "ts", "target", "p_up")


@query
def regime_adaptive(s, d):
    return ml.accuracy_by_regime(ml.regime_adaptive(_ready(s, d), ft.TDA_FEATURES, horizon=24))


# streaming


@query
def stream_bars(s, d):
    return st.replay(s, f"{d}/events.parquet")


@query
def stream_sessions(s, d):
    out = st.replay_sessions(s, f"{d}/events.parquet")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query
def stream_averages(s, d):
    return st.replay_averages(s, _bars(s, d)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# columns, files


@query
def volume_attach(s, d):
    """Hourly bars whose volume is that of the latest six-hour bar, from a second scan."""
    hourly = _bars(s, d).select("symbol", "ts", "close")
    return tb.with_volume(hourly, _bars(s, d, "6h"))


@query
def prefix_selection(s, d):
    f = ft.base_features(_bars(s, d))
    return f.select("symbol", "ts", *with_prefix(f.select(*ft.ALL_FEATURES), "vol_", "macd"))


@query
def numeric_selection(s, d):
    c = tb.table(s, d, "customer")
    return c.agg(*[F.sum(F.col(x).cast("bigint" if x.endswith("key") else "double")).alias(x) for x in numeric(c, without=("c_nationkey",))])


@query
def price_alignment(s, d):
    b = _bars(s, d)
    windows = ft.sliding_windows(b, ["close"], 20, 5).select("symbol", F.col("end_idx").cast("bigint").alias("end_idx"))
    return bt.price_at(windows, b, 24).select("symbol", F.col("end_idx").cast("bigint").alias("end_idx"), "entry_close", "exit_close")


@query
def csv_round_trip(s, d):
    path = f"{Stored(s).root}/csv"
    tb.write_csv(_bars(s, d), path)
    return tb.read_csv(s, path, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


@query
def cached_table(s, d):
    """Bars from the cache whose key fits; the first call fills it, a wrong key doesn't find it."""
    path = f"{Stored(s).root}/cached"
    tb.write_cached(_bars(s, d), path, "bars-1")
    if tb.read_cached(s, path, "bars-2") is not None:
        raise ValueError("a cache of another key was read")
    return tb.read_cached(s, path, "bars-1")


@query
def json_payload(s, d):
    """Blocks as JSON texts with hexadecimal numbers, read by a schema: fields, list sizes and sums of amounts."""
    amount = F.concat(F.lit("0x"), F.hex(F.floor(F.col("volume") * 1000000)))
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    number = F.concat(F.lit("0x"), F.hex(F.unix_seconds(F.col("day").cast("timestamp"))))
    blocks = _bars(s, d).withColumn("day", day).groupBy("symbol", "day").agg(F.collect_list(F.struct(amount.alias("value"))).alias("transactions"))
    return tb.block_facts(blocks.select("symbol", F.col("day").alias("ts"), F.to_json(F.struct(number.alias("number"), "transactions")).alias("payload")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Direction base rates and feature means of each symbol."""
    f = ft.add_targets(_frame(s, d), 24)
    return f.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("target").alias("share_up"), F.avg("log_return").alias("avg_log_return"), F.avg("gk_vol_20").alias("avg_gk_vol_20"), F.avg("rv_20").alias("avg_rv_20"), F.avg("vol_zscore_20").alias("avg_vol_zscore_20"))


QUERIES["flagship"] = flagship
