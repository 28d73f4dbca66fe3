"""Cost-aware backtest of ordered signals, its trades and its metrics.

Positions depend on the path, so each symbol is one ordered fold over its bars, in
linear time and inside the JVM; symbols run in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import fold, let, ratio

_TRADE = "side string, entry_idx int, exit_idx int, entry_price double, exit_price double, units double, size_pct double, entry_fee double, pnl double, return_pct double, closed_at_end boolean"


def _step(fee: float, slip: float, allow_short: bool):
    def close(s, at: Column, price: Column, end: bool) -> Column:
        """State fields after leaving the position at this bar."""
        long = s["units"] > 0
        px = F.when(long, price * (1 - slip)).otherwise(price * (1 + slip))
        value = F.abs(s["units"]) * px
        cost = value * fee
        gain = F.when(long, px - s["entry_price"]).otherwise(s["entry_price"] - px)
        trade = F.struct(
            F.when(long, "long").otherwise("short").alias("side"), s["entry_idx"].alias("entry_idx"), at.alias("exit_idx"), s["entry_price"].alias("entry_price"), px.alias("exit_price"),
            s["units"].alias("units"), s["size_pct"].alias("size_pct"), s["entry_fee"].alias("entry_fee"), (gain * F.abs(s["units"]) - cost - s["entry_fee"]).alias("pnl"), (gain / s["entry_price"]).alias("return_pct"), F.lit(end).alias("closed_at_end"),
        )
        return _state(F.when(long, s["cash"] + value - cost).otherwise(s["cash"] - value - cost), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(-1), trade)

    def enter(s, bar, price: Column, equity: Column, side: int) -> Column:
        px = price * (1 + side * slip)
        value = equity * F.abs(bar["size"])
        cost = value * fee
        units = (value - cost) / px if side > 0 else -value / px
        left = s["cash"] - value if side > 0 else s["cash"] + value - cost
        return _state(left, units, px, cost, bar["size"], bar["idx"], F.lit(None))

    def step(s, bar):
        price, buy, sell, flat = bar["price"], bar["signal"] == "BUY", bar["signal"] == "SELL", s["units"] == 0
        equity = s["cash"] + s["units"] * price
        after = F.when(buy & flat & (bar["size"] > 0), enter(s, bar, price, equity, 1)).when((sell & (s["units"] > 0)) | (buy & (s["units"] < 0)), close(s, bar["idx"], price, False))
        if allow_short:
            after = after.when(sell & flat & (bar["size"] < 0), enter(s, bar, price, equity, -1))
        after = after.otherwise(_state(s["cash"], s["units"], s["entry_price"], s["entry_fee"], s["size_pct"], s["entry_idx"], F.lit(None)))
        # what is open on the last bar is left there
        after = let(after, lambda t: F.when(bar["last"] & (t["units"] != 0), close(t, bar["idx"], price, True)).otherwise(t))
        return let(after, lambda t: t.withField("bar", F.struct(bar["idx"].alias("idx"), bar["ts"].alias("ts"), (t["cash"] + t["units"] * price).alias("equity"), t["trade"].alias("trade"))))

    return step


def _state(cash: Column, units: Column, entry_price: Column, entry_fee: Column, size_pct: Column, entry_idx: Column, trade: Column) -> Column:
    kind = "struct<" + ",".join(x.strip().replace(" ", ":") for x in _TRADE.split(",")) + ">"
    return F.struct(
        cash.cast("double").alias("cash"), units.cast("double").alias("units"), entry_price.cast("double").alias("entry_price"), entry_fee.cast("double").alias("entry_fee"),
        size_pct.cast("double").alias("size_pct"), entry_idx.cast("int").alias("entry_idx"), trade.cast(kind).alias("trade"),
    )


def run_backtest(signals: DataFrame, *, capital: float = 10_000.0, fee: float = 0.001, slippage: float = 0.0005, allow_short: bool = False, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(by..., idx, ts, equity, trade) for every bar; trade is set where one ended."""
    w = W.partitionBy(*by).orderBy("ts")
    rows = signals.select(
        *by, F.struct((F.row_number().over(w) - 1).cast("int").alias("idx"), "ts", F.col("close").alias("price"), "signal", F.col("position_size").alias("size"), F.lead("ts").over(w).isNull().alias("last")).alias("bar")
    )
    series = rows.groupBy(*by).agg(F.array_sort(F.collect_list("bar")).alias("bars"))
    none = F.lit(None).cast("struct<" + ",".join(x.strip().replace(" ", ":") for x in _TRADE.split(",")) + ">")
    bar = "struct<idx:int,ts:timestamp_ntz,equity:double,trade:struct<" + ",".join(x.strip().replace(" ", ":") for x in _TRADE.split(",")) + ">>"
    start = _state(F.lit(capital), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(-1), none).withField("bar", F.lit(None).cast(bar))
    out = series.withColumn("out", fold(F.col("bars"), start, _step(fee, slippage, allow_short), "bar", bar))
    return out.select(*by, F.explode("out").alias("o")).select(*by, "o.*")


def trades(ledger: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return ledger.filter("trade is not null").select(*by, "trade.*")


def drawdown(ledger: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Every bar's fall from the highest equity so far."""
    w = W.partitionBy(*by).orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    return ledger.withColumn("drawdown", (F.col("equity") - F.max("equity").over(w)) / F.max("equity").over(w))


def metrics(ledger: DataFrame, prices: DataFrame, *, capital: float = 10_000.0, by: tuple[str, ...] = ("symbol",), periods: int = 365, risk_free: float = 0.02) -> DataFrame:
    """One row a symbol: returns, trades, drawdown, Sharpe, Sortino and Calmar ratios."""
    w = W.partitionBy(*by).orderBy("idx")
    rows = drawdown(ledger, by).withColumn("r", F.coalesce(ratio(F.col("equity"), F.lag("equity").over(w)) - 1.0, F.lit(0.0)))
    t = F.col("trade.return_pct")
    excess, root = F.avg("r") - risk_free / periods, float(periods) ** 0.5
    sd, down = F.stddev_samp("r"), F.stddev_samp(F.when(F.col("r") < 0, F.col("r")))
    wins, losses = F.sum(F.when(t > 0, F.col("trade.pnl"))), F.abs(F.sum(F.when(t < 0, F.col("trade.pnl"))))
    last, first = F.max_by("equity", "idx"), F.min_by("equity", "idx")
    n = F.count("*")
    agg = rows.groupBy(*by).agg(
        last.alias("final_equity"), ((last / capital - 1.0) * 100.0).alias("total_return_pct"), F.count("trade").alias("total_trades"),
        F.count_if(t > 0).alias("winning_trades"), F.count_if(t < 0).alias("losing_trades"), F.try_divide(F.count_if(t > 0), F.count("trade")).alias("win_rate"),
        (F.avg(t) * 100.0).alias("avg_return_per_trade_pct"), F.coalesce(F.avg(F.when(t > 0, t)) * 100.0, F.lit(0.0)).alias("avg_win_pct"), F.coalesce(F.avg(F.when(t < 0, t)) * 100.0, F.lit(0.0)).alias("avg_loss_pct"),
        F.when(F.count("trade") > 0, F.when(losses > 0, F.coalesce(wins, F.lit(0.0)) / losses).otherwise(float("inf"))).alias("profit_factor"), (F.min("drawdown") * 100.0).alias("max_drawdown_pct"),
        F.when(sd > 0, excess / sd * root).otherwise(0.0).alias("sharpe_ratio"), F.when(down > 0, excess / down * root).otherwise(0.0).alias("sortino_ratio"),
        F.when(F.min("drawdown") < 0, (F.pow(last / first, periods / n) - 1.0) / F.abs(F.min("drawdown"))).otherwise(0.0).alias("calmar_ratio"),
    )
    hold = prices.groupBy(*by).agg(((F.max_by("close", "ts") / F.min_by("close", "ts") - 1.0) * 100.0).alias("buy_hold_return_pct"))
    return agg.join(hold, list(by))


# --- positions that last a horizon ------------------------------------------------------------

_HELD = "side string, entry_idx int, exit_idx int, entry_price double, exit_price double, units double, p_entry double, entry_fee double, pnl double, return_pct double"
_HELD_KIND = "struct<" + ",".join(x.strip().replace(" ", ":") for x in _HELD.split(",")) + ">"


def _held_state(cash: Column, units: Column, price: Column, fee: Column, p: Column, entry: Column, until: Column, trade: Column) -> Column:
    return F.struct(
        cash.cast("double").alias("cash"), units.cast("double").alias("units"), price.cast("double").alias("entry_price"), fee.cast("double").alias("entry_fee"), p.cast("double").alias("p"),
        entry.cast("int").alias("entry_idx"), until.cast("int").alias("until"), trade.cast(_HELD_KIND).alias("trade"),
    )


def run_held(predictions: DataFrame, *, horizon: int = 168, warmup: int = 1440, threshold: float = 0.65, most: float = 0.5, capital: float = 10_000.0, fee: float = 0.00075, slippage: float = 0.0005, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(by..., idx, ts, price, equity, opened, trade): positions by p_up that last exactly ``horizon`` bars, long and short.

    From bar ``warmup`` on, a position whose time has come is left, and a new one may be opened on the same bar;
    its size is ``most`` times the confidence 2 |p_up - 0.5|, of the equity before the bar's trades.  A null p_up
    opens nothing.  What is open on the last bar is sold there without a trade row.
    """
    w = W.partitionBy(*by).orderBy("ts")
    rows = predictions.select(*by, F.struct((F.row_number().over(w) - 1).cast("int").alias("idx"), "ts", F.col("close").alias("price"), F.col("p_up").alias("p"), F.lead("ts").over(w).isNull().alias("last")).alias("bar"))
    series = rows.groupBy(*by).agg(F.array_sort(F.collect_list("bar")).alias("bars"))
    zero, none = F.lit(0.0), F.lit(None)

    def step(s, bar):
        price, live = bar["price"], bar["idx"] >= warmup
        equity = s["cash"] + s["units"] * price
        long = s["units"] > 0
        size = F.abs(s["units"])
        px = price * F.when(long, 1 - slippage).otherwise(1 + slippage)
        cost = size * px * fee
        pnl = F.when(long, px - s["entry_price"]).otherwise(s["entry_price"] - px) * size - cost - s["entry_fee"]
        trade = F.struct(F.when(long, "long").otherwise("short").alias("side"), s["entry_idx"].alias("entry_idx"), bar["idx"].alias("exit_idx"), s["entry_price"].alias("entry_price"), px.alias("exit_price"), s["units"].alias("units"), s["p"].alias("p_entry"), s["entry_fee"].alias("entry_fee"), pnl.alias("pnl"), (pnl / (size * s["entry_price"])).alias("return_pct"))
        left = _held_state(s["cash"] + s["units"] * px - cost, zero, zero, zero, zero, F.lit(-1), F.lit(-1), trade)
        kept = _held_state(s["cash"], s["units"], s["entry_price"], s["entry_fee"], s["p"], s["entry_idx"], s["until"], none)
        after = F.when(live & (s["units"] != 0) & (bar["idx"] >= s["until"]), left).otherwise(kept)

        def enter(t):
            value = equity * most * F.abs(bar["p"] - 0.5) * 2.0
            paid, until = value * fee, bar["idx"] + horizon
            up, down = price * (1 + slippage), price * (1 - slippage)
            free = live & (t["units"] == 0)
            bought = _held_state(t["cash"] - value, (value - paid) / up, up, paid, bar["p"], bar["idx"], until, t["trade"])
            sold = _held_state(t["cash"] + value - paid, -value / down, down, paid, bar["p"], bar["idx"], until, t["trade"])
            return F.when(free & (bar["p"] > threshold), bought).when(free & (bar["p"] < 1 - threshold), sold).otherwise(t)

        def end(t):
            out = price * F.when(t["units"] > 0, 1 - slippage).otherwise(1 + slippage)
            worth = F.when(bar["last"] & (t["units"] != 0), t["cash"] + t["units"] * out - F.abs(t["units"]) * out * fee).otherwise(t["cash"] + t["units"] * price)
            return t.withField("bar", F.struct(bar["idx"].alias("idx"), bar["ts"].alias("ts"), price.alias("price"), worth.alias("equity"), (t["entry_idx"] == bar["idx"]).alias("opened"), t["trade"].alias("trade")))

        return let(after, lambda t: let(enter(t), end))

    kind = f"struct<idx:int,ts:timestamp_ntz,price:double,equity:double,opened:boolean,trade:{_HELD_KIND}>"
    start = _held_state(F.lit(capital), zero, zero, zero, zero, F.lit(-1), F.lit(-1), none).withField("bar", F.lit(None).cast(kind))
    out = series.withColumn("out", fold(F.col("bars"), start, step, "bar", kind))
    return out.select(*by, F.explode("out").alias("o")).select(*by, "o.*")


def held_metrics(ledger: DataFrame, *, warmup: int = 1440, capital: float = 10_000.0, periods: int = 8760, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row a series: equity, return, opened and ended trades, their profit, Sharpe ratio and drawdown, beside holding from ``warmup`` on."""
    w = W.partitionBy(*by).orderBy("idx")
    top = F.max("equity").over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = ledger.withColumns({"r": F.coalesce(F.col("equity") / F.lag("equity").over(w) - 1.0, F.lit(0.0)), "down": (F.col("equity") - top) / top})
    last, sd = F.max_by("equity", "idx"), F.stddev_samp("r")
    held = F.max_by("price", "idx") / F.min_by(F.when(F.col("idx") >= warmup, F.col("price")), F.when(F.col("idx") >= warmup, F.col("idx")))
    return rows.groupBy(*by).agg(
        last.alias("final_equity"), ((last / capital - 1.0) * 100.0).alias("total_return_pct"), ((held - 1.0) * 100.0).alias("bh_return_pct"), F.count_if("opened").alias("n_trades"), F.count("trade").alias("n_ended"),
        F.coalesce(F.sum("trade.pnl"), F.lit(0.0)).alias("pnl"), F.when(sd > 0, F.avg("r") / sd * F.sqrt(F.lit(float(periods)))).otherwise(0.0).alias("sharpe_ratio"), (F.min("down") * 100.0).alias("max_drawdown_pct"),
    )


def price_at(signals: DataFrame, prices: DataFrame, horizon: int, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Signals that name their bar by end_idx, with the close there and ``horizon`` bars later (the last close if there are fewer)."""
    w = W.partitionBy(*by).orderBy("ts")
    rows = prices.select(*by, (F.row_number().over(w) - 1).alias("end_idx"), F.col("close").alias("entry_close"), F.coalesce(F.lead("close", horizon).over(w), F.last("close").over(w.rowsBetween(0, W.unboundedFollowing))).alias("exit_close"))
    return signals.join(rows, [*by, "end_idx"])
