"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from ..sources.tables import DELISTED

_W = "OVER (PARTITION BY symbol ORDER BY ts)"

_BARS = """
bars AS (
  SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, arg_min(value, {'ts': ts, 'e': event_id}) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, {'ts': ts, 'e': event_id}) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""
_DAILY = _BARS.replace("bars AS", "daily AS").replace("'hour'", "'day'")
_VENUES = """
venues AS (
  SELECT event_type AS symbol, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS venue, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, arg_max(value, {'ts': ts, 'e': event_id}) AS close
  FROM events GROUP BY 1, 2, 3)"""


def _roll(c: str, k: int, how: str, least: int | None = None) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {w} >= {least or k} THEN {how}({c}) {w} END"


def _lag(c: str, k: int = 1) -> str:
    return f"lag({c}, {k}) {_W}"


def _ln(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN ln({a} / {b}) END"


def _div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0.0)"


def _r(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)


_C1 = "2 * ln(2.0) - 1"
_FEAT = f"""
RECURSIVE_NUMBERED AS (SELECT *, row_number() {_W} AS i FROM bars),
e(symbol, i, ts, ema12, ema26, macd_line, macd_signal) AS (
  SELECT symbol, i, ts, close, close, close - close, close - close FROM RECURSIVE_NUMBERED WHERE i = 1
  UNION ALL
  SELECT symbol, i, ts, a, b, a - b, (a - b) * (2.0::DOUBLE / 10) + s * (1.0::DOUBLE - 2.0::DOUBLE / 10) FROM (
    SELECT n.symbol, n.i, n.ts, n.close * (2.0::DOUBLE / 13) + e.ema12 * (1.0::DOUBLE - 2.0::DOUBLE / 13) AS a, n.close * (2.0::DOUBLE / 27) + e.ema26 * (1.0::DOUBLE - 2.0::DOUBLE / 27) AS b, e.macd_signal AS s
    FROM e JOIN RECURSIVE_NUMBERED n ON n.symbol = e.symbol AND n.i = e.i + 1)),
f0 AS (
  SELECT b.*, e.ema12, e.ema26, e.macd_line, e.macd_signal,
    {_ln('b.close', 'lag(b.close) OVER s')} AS log_return, {_ln('b.close', 'lag(b.close, 5) OVER s')} AS log_return_5, {_ln('b.close', 'lag(b.close, 24) OVER s')} AS log_return_24,
    CASE WHEN b.low > 0 AND b.open > 0 AND b.close > 0 THEN 0.5 * pow(ln(b.high / b.low), 2) - ({_C1}) * pow(ln(b.close / b.open), 2) END AS gk,
    CASE WHEN b.low > 0 THEN pow(ln(b.high / b.low), 2) / (4 * ln(2.0)) END AS pk,
    coalesce(b.close - lag(b.close) OVER s, 0.0) AS delta
  FROM bars b JOIN e ON b.symbol = e.symbol AND b.ts = e.ts WINDOW s AS (PARTITION BY b.symbol ORDER BY b.ts)),
f1 AS (
  SELECT *, greatest(delta, 0.0) AS up, greatest(-delta, 0.0) AS down, log_return - {_lag('log_return')} AS accel,
    sqrt(greatest(0.0, {_roll('gk', 20, 'avg')})) AS gk_vol_20x, {_roll('gk', 20, 'avg')} AS gk20, {_roll('gk', 60, 'avg')} AS gk60, sqrt({_roll('pk', 20, 'avg')}) AS parkinson_20,
    {_roll('log_return', 20, 'stddev_samp')} AS rv_20, {_roll('log_return', 60, 'stddev_samp')} AS rv_60,
    {_div('high - low', 'close')} AS hl_spread, {_div('close - open', 'open')} AS oc_spread,
    {_div(f"volume - ({_roll('volume', 20, 'avg')})", _roll('volume', 20, 'stddev_samp'))} AS vol_zscore_20, {_div('volume', _lag('volume'))} - 1.0 AS vol_momentum,
    {_div(_roll('volume', 5, 'avg'), _roll('volume', 20, 'avg'))} AS vol_ratio_5_20,
    {_roll('close', 20, 'avg')} AS sma20, {_roll('close', 20, 'stddev_samp')} AS sd20,
    {_div('macd_line', 'close')} AS macd_normalized, {_div('macd_signal', 'close')} AS macd_signal_normalized, {_div(f"ema12 - {_lag('ema12', 20)}", 'close')} AS trend_strength
  FROM f0),
f2 AS (
  SELECT *, CASE WHEN gk20 IS NULL THEN NULL ELSE sqrt(greatest(0.0, gk20)) END AS gk_vol_20, CASE WHEN gk60 IS NULL THEN NULL ELSE sqrt(greatest(0.0, gk60)) END AS gk_vol_60,
    (coalesce(100.0 - 100.0 / nullif(1.0 + {_div(_roll('up', 14, 'avg'), _roll('down', 14, 'avg'))}, 0.0), 50.0) - 50.0) / 50.0 AS rsi_centered,
    {_div('close - sma20', '2.0 * sd20')} AS bb_position, {_div('4.0 * sd20', 'sma20')} AS bb_width, vol_zscore_20 * sign(log_return) AS vol_pressure,
    list(rv_20) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS past
  FROM f1),
feat AS (
  SELECT * EXCLUDE (past), CASE WHEN len(list_filter(past, lambda x: x IS NOT NULL)) = 100
    THEN (len(list_filter(past, lambda x: x < rv_20)) + (len(list_filter(past, lambda x: x = rv_20)) + 1) / 2.0) / 100.0 ELSE 0.5 END AS vol_regime
  FROM f2)""".replace("RECURSIVE_NUMBERED", "numbered").replace("sqrt(greatest(0.0, " + _roll("gk", 20, "avg") + ")) AS gk_vol_20x, ", "")

FEATURES = [
    "log_return", "log_return_5", "accel", "gk_vol_20", "parkinson_20", "rv_20", "hl_spread", "oc_spread", "vol_zscore_20", "vol_ratio_5_20", "rsi_centered", "macd_normalized",
    "bb_position", "bb_width", "trend_strength", "log_return_24", "gk_vol_60", "rv_60", "macd_signal_normalized", "vol_pressure", "vol_regime", "vol_momentum",
]
_ALL = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)
_BASE = f"base AS (SELECT * FROM feat WHERE {_ALL})"


def _feat(select: str, *more: str) -> str:
    return f"WITH RECURSIVE {_BARS}, {_FEAT}{''.join(', ' + m for m in more)} {select}"


def _bars(select: str, *more: str) -> str:
    return f"WITH {_BARS}{''.join(', ' + m for m in more)} {select}"


def _targets(source: str = "bars", h: int = 24) -> str:
    return f"t AS (SELECT * FROM (SELECT *, lead(close, {h}) {_W} AS future_price, lead(close, {h}) {_W} / nullif(close, 0.0) - 1.0 AS future_return, CASE WHEN lead(close, {h}) {_W} > close THEN 1 ELSE 0 END AS target FROM {source}) WHERE future_price IS NOT NULL)"


def _momentum(source: str) -> str:
    change = f"({_div('close', _lag('close', 24))} - 1.0) * 10000.0"
    return f"m AS (SELECT *, CASE WHEN ch > 20.0 THEN 'BUY' WHEN ch < -20.0 THEN 'SELL' ELSE 'HOLD' END AS signal, CASE WHEN ch > 20.0 THEN 0.1 WHEN ch < -20.0 THEN -0.1 ELSE 0.0 END AS position_size FROM (SELECT *, {change} AS ch FROM {source}))"


_ACC = "acc AS (SELECT symbol, count(*) FILTER (signal <> 'HOLD') AS n_signals, count(*) FILTER ((signal = 'BUY' AND future_return > 0) OR (signal = 'SELL' AND future_return < 0)) AS n_correct FROM m GROUP BY symbol), a AS (SELECT *, coalesce(n_correct / nullif(n_signals, 0)::DOUBLE, 0.5) AS direction_accuracy FROM acc)"
_Z = "1.959963984540054"
_P = "(n_correct::DOUBLE / n_signals)"
_MID = f"({_P} + {_Z} * {_Z} / (2 * n_signals)) / (1 + {_Z} * {_Z} / n_signals)"
_SPREAD = f"{_Z} / (1 + {_Z} * {_Z} / n_signals) * sqrt({_P} * (1 - {_P}) / n_signals + {_Z} * {_Z} / (4.0 * n_signals * n_signals))"
_KFOLD = "k AS (SELECT symbol, n, fold, least_n + fold * size AS train_end, least_n + (fold + 1) * size AS test_end FROM (SELECT symbol, n, least_n, greatest(5, (n - least_n) // 5) AS size, unnest(range(0, 5)) AS fold FROM (SELECT symbol, count(*) AS n, greatest(20, count(*) // 6) AS least_n FROM bars GROUP BY symbol)) WHERE least_n + (fold + 1) * size <= n)"


def _backtest(short: bool, signals: str | None = None, fee: str = "0.00075::DOUBLE", x: str = "") -> str:
    """The state machine, a bar at a time: cash, units, entry and the trade that ended; ``x`` ends the names of its tables.

    ``signals`` makes m (symbol, ts, close, signal, position_size).
    """
    slip = "0.0005::DOUBLE"
    return f"""
{signals or _momentum('bars')},
o{x} AS (SELECT symbol, row_number() {_W} - 1 AS idx, ts, close AS price, signal, position_size, lead(ts) {_W} IS NULL AS final FROM m{x}),
st{x}(symbol, idx, ts, price, final, cash, units, entry_price, entry_fee, size_pct, entry_idx, closed, c_units, c_price, c_fee, c_size, c_entry, exit_price, at_end) AS (
  SELECT symbol, CAST(-1 AS BIGINT), NULL::TIMESTAMP, 0.0::DOUBLE, FALSE, 10000.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, CAST(-1 AS BIGINT), FALSE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, CAST(-1 AS BIGINT), 0.0::DOUBLE, FALSE FROM o{x} WHERE idx = 0
  UNION ALL
  SELECT symbol, idx, ts, price, final,
    CASE WHEN ending THEN CASE WHEN u2 > 0 THEN k2 + u2 * x2 * (1 - {fee}) ELSE k2 + u2 * x2 * (1 + {fee}) END ELSE k2 END,
    CASE WHEN ending THEN 0.0::DOUBLE ELSE u2 END, p2, f2, z2, e2, closed OR ending,
    CASE WHEN ending THEN u2 ELSE units END, CASE WHEN ending THEN p2 ELSE entry_price END, CASE WHEN ending THEN f2 ELSE entry_fee END, CASE WHEN ending THEN z2 ELSE size_pct END, CASE WHEN ending THEN e2 ELSE entry_idx END,
    CASE WHEN ending THEN x2 ELSE x END, ending
  FROM (
    SELECT *, final AND u2 <> 0 AS ending, CASE WHEN u2 > 0 THEN price * (1 - {slip}) ELSE price * (1 + {slip}) END AS x2 FROM (
      SELECT *,
        CASE WHEN longs THEN cash - eq * position_size WHEN shorts THEN cash + eq * abs(position_size) * (1 - {fee}) WHEN closed AND units > 0 THEN cash + units * x * (1 - {fee}) WHEN closed THEN cash + units * x * (1 + {fee}) ELSE cash END AS k2,
        CASE WHEN longs THEN eq * position_size * (1 - {fee}) / (price * (1 + {slip})) WHEN shorts THEN -eq * abs(position_size) / (price * (1 - {slip})) WHEN closed THEN 0.0::DOUBLE ELSE units END AS u2,
        CASE WHEN longs THEN price * (1 + {slip}) WHEN shorts THEN price * (1 - {slip}) ELSE entry_price END AS p2,
        CASE WHEN longs OR shorts THEN eq * abs(position_size) * {fee} ELSE entry_fee END AS f2, CASE WHEN longs OR shorts THEN position_size::DOUBLE ELSE size_pct END AS z2, CASE WHEN longs OR shorts THEN idx ELSE entry_idx END AS e2
      FROM (
        SELECT o.symbol, o.idx, o.ts, o.price, o.final, o.position_size, st.cash, st.units, st.entry_price, st.entry_fee, st.size_pct, st.entry_idx, st.cash + st.units * o.price AS eq,
          st.units = 0 AS flat, st.units = 0 AND signal = 'BUY' AND position_size > 0 AS longs, st.units = 0 AND signal = 'SELL' AND position_size < 0 AND {'TRUE' if short else 'FALSE'} AS shorts,
          (signal = 'SELL' AND st.units > 0) OR (signal = 'BUY' AND st.units < 0) AS closed, CASE WHEN st.units > 0 THEN o.price * (1 - {slip}) ELSE o.price * (1 + {slip}) END AS x
        FROM st{x} AS st JOIN o{x} AS o ON o.symbol = st.symbol AND o.idx = st.idx + 1)))),
bt{x} AS (SELECT *, cash + units * price AS equity FROM st{x} WHERE idx >= 0)"""


_TRADES = f"""SELECT symbol, CASE WHEN c_units > 0 THEN 'long' ELSE 'short' END AS side, CAST(c_entry AS INTEGER) AS entry_idx, CAST(idx AS INTEGER) AS exit_idx, {_r('entry_price', 'exit_price', 'units', 'size_pct', 'entry_fee', 'pnl', 'return_pct')}, at_end AS closed_at_end
FROM (SELECT symbol, c_units, c_entry, idx, c_price AS entry_price, exit_price, c_units AS units, c_size AS size_pct, c_fee AS entry_fee, at_end,
  (CASE WHEN c_units > 0 THEN exit_price - c_price ELSE c_price - exit_price END) * abs(c_units) - abs(c_units) * exit_price * 0.00075::DOUBLE - c_fee AS pnl,
  (CASE WHEN c_units > 0 THEN exit_price - c_price ELSE c_price - exit_price END) / c_price AS return_pct FROM bt WHERE closed)"""

_OHLC = _r("open", "high", "low", "close", "volume")
_CUM = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

ORACLES: dict[str, str] = {
    "bars_hourly": _bars(f"SELECT symbol, ts, {_OHLC} FROM bars"),
    "bars_daily": f"WITH {_DAILY} SELECT symbol, ts, {_OHLC} FROM daily",
    "base_features": _feat(f"SELECT symbol, ts, {_OHLC}, {_r(*FEATURES)} FROM base", _BASE),
    "volatility": _feat(f"SELECT symbol, ts, {_r('gk_vol_20', 'gk_vol_60', 'parkinson_20', 'rv_20', 'rv_60')} FROM feat"),
    "rsi_bollinger": _feat(f"SELECT symbol, ts, {_r('rsi_centered', 'bb_position', 'bb_width')} FROM feat"),
    "macd": _feat(f"SELECT symbol, ts, {_r('macd_line', 'macd_signal', 'macd_normalized', 'macd_signal_normalized', 'trend_strength')} FROM feat"),
    "vol_regime_rank": _feat(f"SELECT symbol, ts, {_r('vol_regime')} FROM feat"),
    "volume_features": _feat(f"SELECT symbol, ts, {_r('vol_zscore_20', 'vol_momentum', 'vol_ratio_5_20', 'vol_pressure')} FROM feat"),
    "targets_h24": _bars(f"SELECT symbol, ts, {_r('close', 'future_price', 'future_return')}, target FROM t", _targets()),
    "target_balance": _bars(f"SELECT symbol, n, {_r('share_up')}, first_ts, last_ts FROM (SELECT symbol, count(*) AS n, avg(target) AS share_up, min(ts) AS first_ts, max(ts) AS last_ts FROM t GROUP BY symbol)", _targets()),
    "causal_zscore": _bars(f"SELECT symbol, ts, {_r('close_cz', 'volume_cz')} FROM (SELECT symbol, ts, (close - avg(close) {_CUM}) / CASE WHEN stddev_pop(close) {_CUM} = 0 THEN 1.0 ELSE stddev_pop(close) {_CUM} END AS close_cz, (volume - avg(volume) {_CUM}) / CASE WHEN stddev_pop(volume) {_CUM} = 0 THEN 1.0 ELSE stddev_pop(volume) {_CUM} END AS volume_cz FROM bars)"),
    "global_zscore": _bars(f"SELECT symbol, ts, {_r('close_z', 'volume_z')} FROM (SELECT symbol, ts, (close - avg(close) OVER ()) / stddev_pop(close) OVER () AS close_z, (volume - avg(volume) OVER ()) / stddev_pop(volume) OVER () AS volume_z FROM bars)"),
    "sliding_windows": _bars(f"SELECT symbol, ts, i AS end_idx, CAST(20 AS INTEGER) AS n_points, {_r('first_close', 'sum_close')} FROM (SELECT symbol, ts, row_number() {_W} - 1 AS i, lag(close, 19) {_W} AS first_close, sum(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sum_close FROM bars) WHERE i >= 19 AND (i - 19) % 5 = 0"),
    "interactions": _feat(f"SELECT symbol, ts, {_r('vol_volume_interaction', 'momentum_trend_interaction', 'accel_whale_interaction')} FROM (SELECT symbol, ts, gk_vol_20 * vol_zscore_20 AS vol_volume_interaction, macd_normalized * trend_strength AS momentum_trend_interaction, accel * 0.0 AS accel_whale_interaction FROM feat)"),
    "forward_fill": _feat(f"SELECT symbol, ts, {_r('rv_20', 'bb_width')} FROM (SELECT symbol, ts, coalesce(last_value(rv_20 IGNORE NULLS) {_CUM}, 0.0) AS rv_20, coalesce(last_value(bb_width IGNORE NULLS) {_CUM}, 0.0) AS bb_width FROM feat)"),
    "drop_synthetic": _bars("SELECT symbol, ts, round(close / 100.0, 6) + 0.0 AS spread_pct, volume AS hash_rate FROM bars"),
    "onchain_zscore": f"WITH {_DAILY} SELECT symbol, ts, {_r('volume_z', 'close_z')} FROM (SELECT symbol, ts, " + ", ".join(f"({c} - ({_roll(c, 60, 'avg', 10)})) / (({_roll(c, 60, 'stddev_samp', 10)}) + 1e-8) AS {c}_z" for c in ("volume", "close")) + " FROM daily)",
    "venue_ids": "SELECT DISTINCT event_type, CASE event_type WHEN 'click' THEN 'XBT-USD' WHEN 'view' THEN 'ETH-EUR' ELSE upper(event_type) || '-USD' END AS venue_id FROM events",
    "first_source": f"WITH {_VENUES} SELECT symbol, CAST(CASE WHEN symbol = 'view' THEN 1 ELSE 0 END AS INTEGER) AS source_rank, ts, {_r('close')} FROM venues WHERE venue = CASE WHEN symbol = 'view' THEN 'odd' ELSE 'even' END",
    "event_properties": "SELECT event_type, CAST(sum(k) AS BIGINT) AS sum_k, CAST(sum(k) AS BIGINT) AS sum_back, count(DISTINCT user_id) AS n_users FROM (SELECT event_type, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
    "supported_symbols": "SELECT DISTINCT event_type, event_type IN ('click', 'view') AS supported FROM events",
    "asof_backward": f"WITH c AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2), p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') SELECT p.event_id, p.user_id, p.ts, round(c.value, 6) + 0.0 AS click_value FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts",
    "asof_nearest": "WITH c AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2), p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), j AS (SELECT p.*, c.value, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(c.ts)), c.ts) AS i FROM p LEFT JOIN c ON p.user_id = c.user_id) SELECT event_id, user_id, ts, round(value, 6) + 0.0 AS click_value FROM j WHERE i = 1",
    "attach_daily": f"WITH {_BARS}, {_DAILY}, d AS (SELECT * FROM daily WHERE day(ts) % 3 <> 0) SELECT bars.symbol, bars.ts, round(bars.close, 6) + 0.0 AS close, round(d.close, 6) + 0.0 AS day_close, d.volume AS day_volume FROM bars LEFT JOIN d ON bars.symbol = d.symbol AND date_trunc('day', bars.ts) = d.ts",
    "attach_coverage": f"WITH {_BARS}, {_DAILY}, d AS (SELECT * FROM daily WHERE day(ts) % 3 <> 0) SELECT bars.symbol, count(*) AS n, round(count(d.close) / count(*)::DOUBLE, 6) + 0.0 AS coverage FROM bars LEFT JOIN d ON bars.symbol = d.symbol AND date_trunc('day', bars.ts) = d.ts GROUP BY 1",
    "venue_spread": f"WITH {_VENUES}, sp AS (SELECT symbol, ts, (b.close - a.close) / nullif(a.close, 0.0) AS spread_pct FROM (SELECT * FROM venues WHERE venue = 'even') a JOIN (SELECT * FROM venues WHERE venue = 'odd') b USING (symbol, ts)), q AS (SELECT *, CASE WHEN coalesce(spread_pct, 0.0) > 0 THEN 1.0 ELSE 0.0 END AS pos FROM sp) SELECT symbol, ts, {_r('spread_pct', 'spread_zscore_60', 'spread_persistence')} FROM (SELECT symbol, ts, spread_pct, (spread_pct - ({_roll('spread_pct', 60, 'avg', 10)})) / (({_roll('spread_pct', 60, 'stddev_samp', 10)}) + 1e-8) AS spread_zscore_60, {_roll('pos', 10, 'avg', 3)} AS spread_persistence FROM q)",
    "gap_fill": f"WITH {_VENUES}, a AS (SELECT symbol, ts, close FROM venues WHERE venue = 'even' AND day(ts) % 4 <> 0), b AS (SELECT symbol, ts, close FROM venues WHERE venue = 'odd') SELECT symbol, ts, {_r('close')} FROM (SELECT * FROM a UNION ALL SELECT b.* FROM b ANTI JOIN a USING (symbol, ts))",
    "source_divergence": f"WITH {_VENUES} SELECT symbol, count(*) AS n_both, count(*) FILTER (abs((a.close - b.close) / nullif(a.close, 0.0)) > 0.05) AS n_diverging FROM (SELECT * FROM venues WHERE venue = 'even') a JOIN (SELECT * FROM venues WHERE venue = 'odd') b USING (symbol, ts) GROUP BY symbol",
    "merge_metrics": f"WITH {_VENUES}, {_DAILY}, a AS (SELECT symbol, ts, close AS even_close FROM venues WHERE venue = 'even' AND symbol IN ('click', 'view')), b AS (SELECT symbol, ts, close AS odd_close FROM venues WHERE venue = 'odd' AND symbol IN ('view', 'purchase')), c AS (SELECT symbol, ts, volume FROM daily WHERE symbol = 'view') SELECT symbol, ts, {_r('even_close', 'odd_close', 'volume')} FROM a FULL JOIN b USING (symbol, ts) FULL JOIN c USING (symbol, ts)",
    "first_per_key": "SELECT user_id, event_id, ts, round(value, 6) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS i FROM events) WHERE i = 1",
    "param_grid": "SELECT threshold::DOUBLE AS threshold, model, vol_filter FROM (VALUES (0.55), (0.60), (0.65), (0.70)) a(threshold), (VALUES ('logistic'), ('rf'), ('gbm')) b(model), (VALUES ('none'), ('median')) c(vol_filter)",
    "loao_theta": _bars("SELECT h.symbol AS held_out, CAST(sum(n) AS BIGINT) AS n_train, count(*) AS n_symbols FROM g JOIN (SELECT DISTINCT symbol FROM bars) h ON g.symbol <> h.symbol GROUP BY 1", "g AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol)"),
    "pool_union": _bars("SELECT symbol, count(*) AS n, round(avg(close), 6) + 0.0 AS avg_close FROM bars WHERE symbol IN ('click', 'view', 'purchase') GROUP BY symbol"),
    "top_bars": _bars("SELECT symbol, ts, volume FROM bars ORDER BY volume DESC, symbol, ts LIMIT 10"),
    "regime_mask_vol": _feat("SELECT symbol, ts, " + ", ".join(f"coalesce(rv_20 > quantile_cont(rv_20, {q}) OVER (PARTITION BY symbol), FALSE) AS above_{n}" for n, q in (("median", 0.5), ("q75", 0.75), ("q25", 0.25))) + " FROM feat"),
    "regime_mask_trend": _feat("SELECT symbol, ts, coalesce(trend_strength > 0, FALSE) AS up, coalesce(trend_strength < 0, FALSE) AS down, coalesce(abs(trend_strength) > quantile_cont(abs(trend_strength), 0.5) OVER (PARTITION BY symbol), FALSE) AS strong FROM feat"),
    "regime_filter_hold": _feat("SELECT symbol, ts, CASE WHEN ok THEN signal ELSE 'HOLD' END AS signal, CASE WHEN ok THEN position_size ELSE 0.0 END::DOUBLE AS position_size FROM (SELECT *, coalesce(rv_20 > quantile_cont(rv_20, 0.5) OVER (PARTITION BY symbol), FALSE) AND coalesce(vol_zscore_20 > 0, FALSE) AS ok FROM m)", _momentum("feat")),
    "regime_labels": _feat("SELECT symbol, ts, CAST(CASE WHEN rv_20 < lo THEN 0 WHEN rv_20 >= hi THEN 2 ELSE 1 END AS INTEGER) AS regime FROM feat, (SELECT quantile_cont(rv_20, 0.33) AS lo, quantile_cont(rv_20, 0.66) AS hi FROM feat)"),
    "time_regimes": _bars(f"SELECT symbol, CAST(regime AS INTEGER) AS regime, count(*) AS n, round(avg(close), 6) + 0.0 AS avg_close, sum(volume) AS sum_volume FROM (SELECT *, least((row_number() {_W} - 1) // greatest(1, count(*) OVER (PARTITION BY symbol) // 3), 2) AS regime FROM bars) GROUP BY 1, 2"),
    "momentum_signals": _bars("SELECT symbol, ts, signal, position_size::DOUBLE AS position_size FROM m", _momentum("bars")),
    "ma_crossover_signals": _bars(f"SELECT symbol, ts, CASE WHEN above AND NOT was THEN 'BUY' WHEN NOT above AND was THEN 'SELL' ELSE 'HOLD' END AS signal, CASE WHEN above AND NOT was THEN 0.5 WHEN NOT above AND was THEN -0.5 ELSE 0.0 END::DOUBLE AS position_size FROM (SELECT *, {_lag('above')} AS was FROM (SELECT *, ({_roll('close', 10, 'avg', 1)}) > ({_roll('close', 30, 'avg', 1)}) AS above FROM bars))"),
    "hold_and_cash_signals": _bars(f"SELECT symbol, ts, 'hold' AS rule, CASE WHEN row_number() {_W} = 1 THEN 'BUY' ELSE 'HOLD' END AS signal, CASE WHEN row_number() {_W} = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS position_size FROM bars UNION ALL SELECT symbol, ts, 'cash', 'HOLD', 0.0::DOUBLE FROM bars"),
    "vol_breakout_signals": _feat(
        f"SELECT symbol, ts, CASE WHEN z > 1.5 AND rb > 0 THEN 'BUY' WHEN z > 1.5 AND rb < 0 THEN 'SELL' ELSE 'HOLD' END AS signal, CASE WHEN z > 1.5 AND rb > 0 THEN 0.1 WHEN z > 1.5 AND rb < 0 THEN -0.1 ELSE 0.0 END::DOUBLE AS position_size FROM (SELECT symbol, ts, {_lag('r')} AS rb, CASE WHEN row_number() {_W} > 100 THEN (rv_20 - mu) / CASE WHEN sd = 0 THEN 1.0 ELSE sd END END AS z FROM q)",
        _BASE,
        f"q AS (SELECT *, coalesce({_div('close', _lag('close'))} - 1.0, 0.0) AS r, avg(rv_20) OVER v AS mu, stddev_pop(rv_20) OVER v AS sd FROM base WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))",
    ),
    "probability_signals": _feat(f"SELECT symbol, ts, {_r('p_up')}, CASE WHEN p_up > 0.6 THEN 'BUY' WHEN p_up < 1.0 - 0.6 THEN 'SELL' ELSE 'HOLD' END AS signal, round(CASE WHEN p_up > 0.6 THEN 0.2 * abs(p_up - 0.5) WHEN p_up < 1.0 - 0.6 THEN -0.2 * abs(p_up - 0.5) ELSE 0.0 END, 6)::DOUBLE + 0.0 AS position_size FROM (SELECT symbol, ts, 1.0 / (1.0 + exp(-2.0 * rsi_centered)) AS p_up FROM feat)"),
    "signal_summary": _bars("SELECT symbol, count(*) AS total, count(*) FILTER (signal = 'BUY') AS n_buy, count(*) FILTER (signal = 'SELL') AS n_sell, count(*) FILTER (signal = 'HOLD') AS n_hold, round(coalesce(avg(abs(position_size)) FILTER (signal <> 'HOLD'), 0.0)::DOUBLE, 6) + 0.0 AS avg_size, max(abs(position_size))::DOUBLE AS max_size FROM m GROUP BY symbol", _momentum("bars")),
    "backtest_equity": f"WITH RECURSIVE {_BARS}, {_backtest(False)} SELECT symbol, CAST(idx AS INTEGER) AS idx, ts, {_r('equity', 'drawdown')} FROM (SELECT *, equity / max(equity) OVER (PARTITION BY symbol ORDER BY idx) - 1.0 AS drawdown FROM bt)",
    "backtest_trades": f"WITH RECURSIVE {_BARS}, {_backtest(False)} {_TRADES}",
    "backtest_short_trades": f"WITH RECURSIVE {_BARS}, {_backtest(True)} {_TRADES}",
    "temporal_split": _bars(f"SELECT symbol, split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, CASE WHEN row_number() {_W} - 1 < floor(count(*) OVER (PARTITION BY symbol) * 0.8::DOUBLE) THEN 'train' ELSE 'holdout' END AS split FROM bars) GROUP BY 1, 2"),
    "kfold_folds": _bars("SELECT symbol, n, CAST(fold AS INTEGER) AS fold, CAST(train_end AS BIGINT) AS train_end, CAST(test_end AS BIGINT) AS test_end FROM k", _KFOLD),
    "purged_folds": _bars("SELECT symbol, CAST(fold AS INTEGER) AS fold, CAST(tr - v AS BIGINT) AS n_train, CAST(v AS BIGINT) AS n_val, CAST(test_end - train_end AS BIGINT) AS n_test FROM (SELECT *, greatest(20, CAST(floor(tr * 0.15::DOUBLE) AS BIGINT)) AS v FROM (SELECT *, greatest(0, train_end - 29) AS tr FROM k)) WHERE tr >= 30 AND tr - v >= 30", _KFOLD),
    "direction_accuracy": _bars(f"SELECT symbol, n_signals, n_correct, {_r('direction_accuracy')} FROM a", _targets(), _momentum("t"), _ACC),
    "wilson_interval": _bars(f"SELECT symbol, n_signals, n_correct, {_r('direction_accuracy')}, round(CASE WHEN n_signals > 0 THEN {_P} ELSE 0.0 END, 6) + 0.0 AS share, round(CASE WHEN n_signals > 0 THEN greatest(0.0, {_MID} - {_SPREAD}) ELSE 0.0 END, 6) + 0.0 AS wilson_lower, round(CASE WHEN n_signals > 0 THEN least(1.0, {_MID} + {_SPREAD}) ELSE 0.0 END, 6) + 0.0 AS wilson_upper FROM a", _targets(), _momentum("t"), _ACC),
    "t_statistic": _bars(f"SELECT symbol, n, {_r('mean', 't_stat')} FROM (SELECT symbol, count(future_return) AS n, avg(future_return) AS mean, avg(future_return) / nullif(stddev_samp(future_return) / sqrt(count(future_return)), 0.0) AS t_stat FROM t GROUP BY symbol)", _targets()),
    "block_shuffle": _bars(
        "SELECT n.symbol, n.ts, n.target, x.target AS shuffled FROM n JOIN (SELECT n.symbol, s.b0 + n.idx - n.blk * 48 AS idx, n.target FROM n JOIN s ON n.symbol = s.symbol AND n.blk = s.blk) x ON n.symbol = x.symbol AND n.idx = x.idx",
        _targets(),
        f"n AS (SELECT *, idx // 48 AS blk FROM (SELECT *, row_number() {_W} - 1 AS idx FROM t))",
        "s AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY symbol ORDER BY md5('7:' || symbol || ':' || blk), blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b0 FROM (SELECT symbol, blk, count(*) AS c FROM n GROUP BY 1, 2))",
    ),
    "break_even": _bars("SELECT symbol, round(mv, 6) + 0.0 AS avg_abs_move_bps, round(direction_accuracy, 6) + 0.0 AS direction_accuracy, round((2 * direction_accuracy - 1) * mv, 6) + 0.0 AS gross_edge_bps, CAST(15 AS INTEGER) AS maker_cost_bps, CAST(85 AS INTEGER) AS taker_cost_bps FROM a JOIN (SELECT symbol, avg(abs(future_return)) * 10000.0 AS mv FROM t GROUP BY symbol) USING (symbol)", _targets(), _momentum("t"), _ACC),
    "permutation_p": _bars("SELECT o.symbol, round(o.v, 6) + 0.0 AS observed, count(n.v) AS b, round((count(*) FILTER (n.v >= o.v) + 1) / (count(n.v) + 1)::DOUBLE, 6) + 0.0 AS p_value FROM (SELECT symbol, avg(future_return) AS v FROM t GROUP BY 1) o JOIN (SELECT symbol, day(ts), avg(future_return) AS v FROM t GROUP BY 1, 2) n USING (symbol) GROUP BY 1, o.v", _targets()),
    "multi_aggregate": _bars(f"SELECT CAST(regime AS INTEGER) AS regime, symbol, round(avg(future_return), 6) + 0.0 AS avg_return, round(stddev_samp(future_return), 6) + 0.0 AS sd_samp, round(stddev_pop(future_return), 6) + 0.0 AS sd_pop, sum(volume) AS sum_volume, round(quantile_cont(close, 0.5), 6) + 0.0 AS median_close FROM (SELECT *, least((row_number() {_W} - 1) // greatest(1, count(*) OVER (PARTITION BY symbol) // 3), 2) AS regime FROM t) GROUP BY 1, 2", _targets()),
    "regime_rollup": _bars(f"SELECT CAST(coalesce(regime, -1) AS INTEGER) AS regime, count(*) AS n, round(avg(target), 6) + 0.0 AS share_up FROM (SELECT *, least((row_number() {_W} - 1) // greatest(1, count(*) OVER (PARTITION BY symbol) // 3), 2) AS regime FROM t) GROUP BY GROUPING SETS ((regime), ())", _targets()),
    "stream_bars": _bars(f"SELECT symbol, ts, {_OHLC} FROM bars"),
    "flagship": _feat("SELECT symbol, count(*) AS n, round(avg(target), 6) + 0.0 AS share_up, round(avg(log_return), 6) + 0.0 AS avg_log_return, round(avg(gk_vol_20), 6) + 0.0 AS avg_gk_vol_20, round(avg(rv_20), 6) + 0.0 AS avg_rv_20, round(avg(vol_zscore_20), 6) + 0.0 AS avg_vol_zscore_20 FROM t GROUP BY symbol", _targets("feat")),
}


_IND = f"ind AS (SELECT *, 50.0 + 50.0 * rsi_centered AS rsi, sma20 AS bb_mid, sma20 + 2 * sd20 AS bb_high, sma20 - 2 * sd20 AS bb_low, 4.0 * sd20 AS bb_span, macd_line AS macd, macd_line - macd_signal AS macd_diff, {_div('close', _lag('close'))} - 1.0 AS return_1d FROM feat)"
_DAY = ["close", "rsi", "macd", "macd_signal", "macd_diff", "bb_high", "bb_low", "bb_mid", "bb_width", "return_1d", "log_return", "volatility_10d"]
_HOUR = ["close", "rsi", "macd", "macd_signal", "bb_high", "bb_low", "bb_mid", "return_1", "log_return", "volatility_20", "volume_ma", "volume_ratio"]


def _whole(columns: list[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


def _zero_z(c: str) -> str:
    return "coalesce(" + _div(f"{c} - ({_roll(c, 20, 'avg', 5)})", _roll(c, 20, "stddev_samp", 5)) + ", 0.0)"


_SCORES = f"sc AS (SELECT *, 1.0 / (1.0 + abs(entropy_zscore)) AS confidence FROM (SELECT *, {_zero_z('rv_20')} AS c1_zscore, {_zero_z('bb_width')} AS entropy_zscore, coalesce({_div('close', _lag('close', 5))} - 1.0, 0.0) AS drift FROM base))"
_RULE = "ru AS (SELECT *, CASE WHEN c1_zscore > 1.5 AND confidence > 0.4 AND drift >= 0 THEN 'BUY' WHEN c1_zscore < -1.0 OR (c1_zscore > 1.5 AND drift < 0) THEN 'SELL' ELSE 'HOLD' END AS signal FROM sc)"


def _metrics(x: str = "", fee: str = "0.00075::DOUBLE", prices: str = "bars") -> str:
    """Tables of the metrics of bt: mt (symbol, ...)."""
    return f"""x{x} AS (SELECT *, coalesce(equity / nullif(lag(equity) OVER w, 0.0) - 1.0, 0.0) AS r, (equity - max(equity) OVER w) / max(equity) OVER w AS dd, CASE WHEN closed THEN gain / c_price END AS t,
  CASE WHEN closed THEN gain * abs(c_units) - abs(c_units) * exit_price * {fee} - c_fee END AS pnl
  FROM (SELECT *, CASE WHEN c_units > 0 THEN exit_price - c_price ELSE c_price - exit_price END AS gain FROM bt{x}) WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
y{x} AS (SELECT symbol, count(*) AS n, arg_max(equity, idx) AS final_equity, arg_min(equity, idx) AS first_equity, count(t) AS total_trades, count(*) FILTER (t > 0) AS winning_trades, count(*) FILTER (t < 0) AS losing_trades,
  avg(t) * 100.0 AS avg_return_per_trade_pct, coalesce(avg(t) FILTER (t > 0) * 100.0, 0.0) AS avg_win_pct, coalesce(avg(t) FILTER (t < 0) * 100.0, 0.0) AS avg_loss_pct,
  CASE WHEN count(t) > 0 THEN CASE WHEN abs(sum(pnl) FILTER (t < 0)) > 0 THEN coalesce(sum(pnl) FILTER (t > 0), 0.0) / abs(sum(pnl) FILTER (t < 0)) ELSE 'inf'::DOUBLE END END AS profit_factor, min(dd) AS worst, avg(r) - 0.02::DOUBLE / 365 AS excess, stddev_samp(r) AS sd, stddev_samp(r) FILTER (r < 0) AS down FROM x{x} GROUP BY symbol),
h{x} AS (SELECT symbol, (arg_max(close, ts) / arg_min(close, ts) - 1.0) * 100.0 AS buy_hold_return_pct FROM {prices} GROUP BY symbol),
mt{x} AS (SELECT y.*, buy_hold_return_pct, (final_equity / 10000.0 - 1.0) * 100.0 AS total_return_pct, winning_trades / nullif(total_trades, 0)::DOUBLE AS win_rate, worst * 100.0 AS max_drawdown_pct,
  CASE WHEN sd > 0 THEN excess / sd * sqrt(365.0) ELSE 0.0 END AS sharpe_ratio, CASE WHEN down > 0 THEN excess / down * sqrt(365.0) ELSE 0.0 END AS sortino_ratio, CASE WHEN worst < 0 THEN (pow(final_equity / first_equity, 365.0 / n) - 1.0) / abs(worst) ELSE 0.0 END AS calmar_ratio FROM y{x} AS y JOIN h{x} USING (symbol))"""


_METRIC_COLUMNS = ["final_equity", "total_return_pct", "win_rate", "avg_return_per_trade_pct", "avg_win_pct", "avg_loss_pct", "profit_factor", "max_drawdown_pct", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "buy_hold_return_pct"]

ORACLES |= {
    "daily_indicators": _feat(f"SELECT symbol, ts, {_r(*_DAY)} FROM (SELECT * REPLACE (bb_span AS bb_width), {_roll('return_1d', 10, 'stddev_samp')} AS volatility_10d FROM ind) WHERE {_whole(_DAY)}", _IND),
    "hourly_indicators": _feat(f"SELECT symbol, ts, {_r(*_HOUR)} FROM (SELECT *, return_1d AS return_1, {_roll('return_1d', 20, 'stddev_samp')} AS volatility_20, {_roll('volume', 20, 'avg')} AS volume_ma, coalesce({_div('volume', _roll('volume', 20, 'avg'))}, 1.0) AS volume_ratio FROM ind) WHERE {_whole(_HOUR)}", _IND),
    "auc_by_symbol": _feat(
        "SELECT symbol, round(CASE WHEN pos > 0 AND neg > 0 THEN (s - pos * (pos + 1) / 2.0::DOUBLE) / (pos * neg) ELSE 0.5 END, 6) + 0.0::DOUBLE AS auc FROM (SELECT symbol, count(*) FILTER (target = 1) AS pos, count(*) FILTER (target = 0) AS neg, sum(rk) FILTER (target = 1) AS s FROM q GROUP BY symbol)",
        _targets("feat"),
        "q AS (SELECT symbol, target, (rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2.0)::DOUBLE AS rk FROM (SELECT *, 1.0 / (1.0 + exp(-2.0 * rsi_centered)) AS p FROM t))",
    ),
    "walk_forward_split": _bars(f"SELECT symbol, split, count(*) AS n, min(ts) AS first_ts FROM (SELECT symbol, ts, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() {_W} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars)) GROUP BY 1, 2"),
    "fold_roles": _bars(
        "SELECT symbol, CAST(fold AS INTEGER) AS fold, role, count(*) AS n, round(avg(close), 6) + 0.0 AS avg_close FROM (SELECT k.symbol, fold, close, CASE WHEN i + 24 < train_end THEN 'train' WHEN i >= train_end AND i < test_end THEN 'test' END AS role FROM b JOIN k ON b.symbol = k.symbol WHERE n >= 55) WHERE role IS NOT NULL GROUP BY 1, 2, 3",
        _KFOLD,
        f"b AS (SELECT *, row_number() {_W} - 1 AS i FROM bars)",
    ),
    "weighted_accuracy": _bars(
        "SELECT symbol, round(coalesce(sum(coalesce(good / nullif(n, 0)::DOUBLE, 0.5) * n) / nullif(sum(n), 0)::DOUBLE, 0.5), 6) + 0.0 AS weighted_accuracy, CAST(sum(n) AS BIGINT) AS n_signals FROM f GROUP BY symbol",
        _targets(),
        _momentum("t"),
        f"f AS (SELECT symbol, regime, count(*) FILTER (signal <> 'HOLD') AS n, count(*) FILTER ((signal = 'BUY' AND future_return > 0) OR (signal = 'SELL' AND future_return < 0)) AS good FROM (SELECT *, least((row_number() {_W} - 1) // greatest(1, count(*) OVER (PARTITION BY symbol) // 5), 4) AS regime FROM m) GROUP BY 1, 2)",
    ),
    "verdicts": _bars("SELECT symbol, CASE WHEN points >= 3 THEN 'PASS' WHEN points >= 0 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict FROM (SELECT symbol, CASE WHEN direction_accuracy > 0.5 THEN 3 ELSE 0 END + CASE WHEN n_signals > 100 THEN 1 ELSE 0 END - CASE WHEN direction_accuracy < 0.5 THEN 2 ELSE 0 END AS points FROM a)", _targets(), _momentum("t"), _ACC),
    "t_two_groups": _bars("SELECT n_a, n_b, round((m_a - m_b) / nullif(sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2) * (1.0::DOUBLE / n_a + 1.0::DOUBLE / n_b)), 0.0), 6) + 0.0 AS t_stat FROM (SELECT " + ", ".join(f"count(future_return) FILTER (symbol = '{g}') AS n_{x}, avg(future_return) FILTER (symbol = '{g}') AS m_{x}, var_samp(future_return) FILTER (symbol = '{g}') AS v_{x}" for x, g in (("a", "click"), ("b", "view"))) + " FROM t)", _targets()),
    "rule_signals_z": _feat(
        f"SELECT symbol, ts, {_r('c1_zscore', 'entropy_zscore', 'confidence')}, signal, round(CASE signal WHEN 'BUY' THEN least(0.5, confidence * 0.5 * abs(c1_zscore) / 2.0) WHEN 'SELL' THEN -least(0.5, confidence * 0.5) ELSE 0.0 END, 6)::DOUBLE + 0.0 AS position_size FROM ru",
        _BASE,
        _SCORES,
        _RULE,
    ),
    "rule_ladder": _feat(
        "SELECT rule, symbol, n_signals, n_correct, round(coalesce(n_correct / nullif(n_signals, 0)::DOUBLE, 0.5), 6) + 0.0 AS direction_accuracy, "
        f"round(CASE WHEN n_signals > 0 THEN {_P} ELSE 0.0 END, 6) + 0.0 AS share, round(CASE WHEN n_signals > 0 THEN greatest(0.0, {_MID} - {_SPREAD}) ELSE 0.0 END, 6) + 0.0 AS wilson_lower, round(CASE WHEN n_signals > 0 THEN least(1.0, {_MID} + {_SPREAD}) ELSE 0.0 END, 6) + 0.0 AS wilson_upper "
        "FROM (SELECT rule, symbol, count(*) FILTER (signal <> 'HOLD') AS n_signals, count(*) FILTER ((signal = 'BUY' AND future_return > 0) OR (signal = 'SELL' AND future_return < 0)) AS n_correct FROM every_rule GROUP BY 1, 2)",
        _BASE,
        _targets("base"),
        _momentum("t"),
        f"q AS (SELECT *, coalesce({_div('close', _lag('close'))} - 1.0, 0.0) AS rn, avg(rv_20) OVER v AS mu, stddev_pop(rv_20) OVER v AS sd, ({_roll('close', 10, 'avg', 1)}) > ({_roll('close', 30, 'avg', 1)}) AS above, row_number() {_W} AS place FROM t WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))",
        f"q2 AS (SELECT *, {_lag('rn')} AS rb, {_lag('above')} AS was, CASE WHEN place > 100 THEN (rv_20 - mu) / CASE WHEN sd = 0 THEN 1.0 ELSE sd END END AS z FROM q)",
        """every_rule AS (
          SELECT 'momentum' AS rule, symbol, signal, future_return FROM m
          UNION ALL SELECT 'vol_breakout', symbol, CASE WHEN z > 1.5 AND rb > 0 THEN 'BUY' WHEN z > 1.5 AND rb < 0 THEN 'SELL' ELSE 'HOLD' END, future_return FROM q2
          UNION ALL SELECT 'ma_crossover', symbol, CASE WHEN above AND NOT was THEN 'BUY' WHEN NOT above AND was THEN 'SELL' ELSE 'HOLD' END, future_return FROM q2
          UNION ALL SELECT 'buy_and_hold', symbol, CASE WHEN place = 1 THEN 'BUY' ELSE 'HOLD' END, future_return FROM q2
          UNION ALL SELECT 'cash', symbol, 'HOLD', future_return FROM q2)""",
    ),
    "survivorship": _feat(
        "SELECT symbol, ts, since IS NOT NULL AS is_delisted, round(coalesce(greatest(0.0::DOUBLE, date_diff('day', since, CAST(ts AS DATE)) / 30.0::DOUBLE), 0.0), 6) + 0.0 AS months_since_delisting, round(coalesce(spread, 0.5), 6) + 0.0 AS exchange_concentration "
        f"FROM (SELECT CASE symbol WHEN 'view' THEN 'LUNA' WHEN 'click' THEN 'ICP' ELSE symbol END AS symbol, ts, {_roll('vol_zscore_20', 20, 'stddev_samp')} AS spread FROM feat) LEFT JOIN gone USING (symbol)",
        "gone(symbol, since) AS (VALUES " + ", ".join(f"('{x}', DATE '{d}')" for x, d in DELISTED) + ")",
    ),
    "mapper_cover": f"""WITH a AS (SELECT c_nationkey, sum(o_totalprice) AS total, count(*) / count(DISTINCT CAST(o_orderdate AS DATE))::DOUBLE AS velocity, avg(o_totalprice) AS avg_size, max(o_totalprice) / avg(o_totalprice) AS max_to_avg, count(DISTINCT c_custkey)::DOUBLE AS counterparts FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
s AS (SELECT c_nationkey, count(DISTINCT l_suppkey)::DOUBLE AS suppliers FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1),
x AS (SELECT c_nationkey, sqrt({' + '.join(f"pow(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 ELSE stddev_pop({c}) OVER () END, 2)" for c in ('total', 'velocity', 'avg_size', 'max_to_avg', 'counterparts', 'suppliers'))}) AS lens FROM a JOIN s USING (c_nationkey)),
r AS (SELECT min(lens) AS lo, (max(lens) - min(lens)) / 8 AS step FROM x)
SELECT c_nationkey, i AS interval, round(lens, 6) + 0.0 AS lens FROM x, r, range(0, 8) g(i) WHERE lens >= lo + i * step - 0.15::DOUBLE * step AND lens <= lo + i * step - 0.15::DOUBLE * step + 1.3::DOUBLE * step""",
    "backtest_metrics": f"WITH RECURSIVE {_BARS}, {_backtest(False)}, {_metrics()} SELECT symbol, total_trades, winning_trades, losing_trades, {_r(*_METRIC_COLUMNS)} FROM mt",
}


# --- seeded draws, statistics, sources --------------------------------------------------------


def _unit(*parts: str) -> str:
    """The number that functions.columns.uniform draws."""
    text = " || ':' || ".join(f"coalesce(CAST({p} AS VARCHAR), 'null')" for p in parts)
    return f"((('0x' || substr(md5({text}), 1, 8))::UBIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


_AT = "CAST(epoch(ts) AS BIGINT)"


def _normal(column: str) -> str:
    u = [_unit("0", f"'{column}'", str(i), "symbol", _AT) for i in (0, 1)]
    return f"sqrt(-2.0::DOUBLE * ln({u[0]})) * cos(2 * pi() * {u[1]}) * 0.5::DOUBLE"


def _chances() -> list[float]:
    import math

    out, total = [], 0.0
    for k in range(13):
        total += math.exp(-1.0) / math.factorial(k)
        out.append(total)
    return out


_DRAW = "(" + " + ".join(f"CAST(u > {c!r}::DOUBLE AS INTEGER)" for c in _chances()) + ")"


def _area(start: str) -> str:
    """Simpson's rule of cos(a)^(df - 1) from ``start`` on, as functions.columns.student_p has it."""
    step = f"((least(pi() / 2, {start} + 12.0::DOUBLE / sqrt(df)) - {start}) / 400.0::DOUBLE)"
    return f"(list_sum(list_transform(range(0, 401), lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END) * pow(greatest(cos({start} + i * {step}), 0.0::DOUBLE), df - 1.0::DOUBLE))) * {step} / 3.0::DOUBLE)"


_T_STAT = "ts0 AS (SELECT symbol, count(future_return) AS n, avg(future_return) AS mean, avg(future_return) / nullif(stddev_samp(future_return) / sqrt(count(future_return)), 0.0) AS t_stat, (count(future_return) - 1)::DOUBLE AS df FROM t GROUP BY symbol)"
_P_UP = "pr AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-2.0::DOUBLE * rsi_centered)) AS p_up FROM {source})"
_LONG = {"H": 24, "warmup": 100, "threshold": "0.55::DOUBLE", "fee": "0.00075::DOUBLE", "slip": "0.0005::DOUBLE"}
_HELD = """
o AS (SELECT symbol, row_number() OVER w - 1 AS idx, ts, close AS price, p_up AS p, lead(ts) OVER w IS NULL AS final FROM pr WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
hs(symbol, idx, ts, price, final, cash, units, entry_price, entry_fee, until, opened, ended, pnl, side) AS (
  SELECT symbol, CAST(-1 AS BIGINT), NULL::TIMESTAMP, 0.0::DOUBLE, FALSE, 10000.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, CAST(-1 AS BIGINT), FALSE, FALSE, 0.0::DOUBLE, 0.0::DOUBLE FROM o WHERE idx = 0
  UNION ALL
  SELECT symbol, idx, ts, price, final,
    CASE WHEN buys THEN c1 - v WHEN sells THEN c1 + v - v * {fee} ELSE c1 END, CASE WHEN buys THEN (v - v * {fee}) / (price * (1 + {slip})) WHEN sells THEN -v / (price * (1 - {slip})) ELSE u1 END,
    CASE WHEN buys THEN price * (1 + {slip}) WHEN sells THEN price * (1 - {slip}) WHEN ending THEN 0.0::DOUBLE ELSE entry_price END, CASE WHEN buys OR sells THEN v * {fee} WHEN ending THEN 0.0::DOUBLE ELSE entry_fee END,
    CASE WHEN buys OR sells THEN idx + {H} WHEN ending THEN CAST(-1 AS BIGINT) ELSE until END, buys OR sells, ending, gain, units
  FROM (SELECT *, idx >= {warmup} AND u1 = 0 AND p > {threshold} AS buys, idx >= {warmup} AND u1 = 0 AND p < 1 - {threshold} AS sells FROM (
    SELECT *, CASE WHEN ending THEN cash + units * px - abs(units) * px * {fee} ELSE cash END AS c1, CASE WHEN ending THEN 0.0::DOUBLE ELSE units END AS u1,
      CASE WHEN ending THEN (CASE WHEN units > 0 THEN px - entry_price ELSE entry_price - px END) * abs(units) - abs(units) * px * {fee} - entry_fee END AS gain FROM (
      SELECT o.symbol, o.idx, o.ts, o.price, o.final, o.p, hs.cash, hs.units, hs.entry_price, hs.entry_fee, hs.until, (hs.cash + hs.units * o.price) * 0.5::DOUBLE * abs(o.p - 0.5::DOUBLE) * 2.0::DOUBLE AS v,
        o.idx >= {warmup} AND hs.units <> 0 AND o.idx >= hs.until AS ending, o.price * (CASE WHEN hs.units > 0 THEN 1 - {slip} ELSE 1 + {slip} END) AS px FROM hs JOIN o ON o.symbol = hs.symbol AND o.idx = hs.idx + 1)))),
hb AS (SELECT *, CASE WHEN final AND units <> 0 THEN cash + units * price * (CASE WHEN units > 0 THEN 1 - {slip} ELSE 1 + {slip} END) - abs(units) * price * (CASE WHEN units > 0 THEN 1 - {slip} ELSE 1 + {slip} END) * {fee} ELSE cash + units * price END AS equity FROM hs WHERE idx >= 0),
hr AS (SELECT *, coalesce(equity / lag(equity) OVER w - 1.0::DOUBLE, 0.0::DOUBLE) AS r, (equity - max(equity) OVER w) / max(equity) OVER w AS dd FROM hb WINDOW w AS (PARTITION BY symbol ORDER BY idx))""".format(**_LONG)

_GRID = "gr(threshold, vol_filter) AS (SELECT * FROM (VALUES (0.5::DOUBLE), (0.55::DOUBLE), (0.6::DOUBLE), (0.65::DOUBLE)) a(threshold), (VALUES ('none'), ('median')) b(vol_filter))"

ORACLES |= {
    "bars_six_hours": "SELECT event_type AS symbol, CAST(time_bucket(INTERVAL 6 HOURS, ts) AS TIMESTAMP) AS ts, round(arg_min(value, {'ts': ts, 'e': event_id}), 6) + 0.0 AS open, round(arg_max(value, {'ts': ts, 'e': event_id}), 6) + 0.0 AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2",
    "random_signals": _bars(
        f"SELECT symbol, ts, CASE WHEN place > 10 THEN 'HOLD' WHEN turn % 2 = 1 THEN 'BUY' ELSE 'SELL' END AS signal, CASE WHEN place > 10 THEN 0.0::DOUBLE WHEN turn % 2 = 1 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS position_size FROM (SELECT *, sum(CASE WHEN place <= 10 THEN 1 ELSE 0 END) {_CUM} AS turn FROM pl)",
        f"pl AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY {_unit('42', 'symbol', _AT)}, ts) AS place FROM bars)",
    ),
    "comprehensive_features": _feat(
        f"SELECT symbol, ts, {', '.join(f'round(coalesce(last_value({c} IGNORE NULLS) {_CUM}, 0.0), 6) + 0.0 AS {c}' for c in ('exchange_concentration', 'spread_persistence', 'accel_whale_interaction'))}, {_r('spread_pct', 'spread_zscore_20')} FROM c3",
        _BASE,
        f"c1 AS (SELECT *, {_normal('spread_noise')} * 0.02::DOUBLE AS step, {_normal('whale_supply_pct_z')} AS whale FROM base)",
        f"c2 AS (SELECT *, 0.1::DOUBLE + sum(step) {_CUM} AS spread_pct FROM c1)",
        f"c3 AS (SELECT *, coalesce((spread_pct - {_roll('spread_pct', 20, 'avg')}) / nullif({_roll('spread_pct', 20, 'stddev_samp')} + 0.00000001::DOUBLE, 0.0), 0.0) AS spread_zscore_20, ({_roll('CASE WHEN spread_pct > 0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END', 10, 'sum')}) / 10.0::DOUBLE AS spread_persistence, accel * whale AS accel_whale_interaction, coalesce({_roll('vol_zscore_20', 20, 'stddev_samp')}, 0.5) AS exchange_concentration FROM c2)",
    ),
    "bootstrap_sharpe": _feat(
        "SELECT symbol, " + ", ".join(f"round(CASE WHEN c >= 10 THEN {x} ELSE 0.0::DOUBLE END, 6) + 0.0 AS {n}" for n, x in (("mean", "m"), ("std", "s"), ("lower", "lo"), ("upper", "hi"))) + " FROM bs JOIN (SELECT symbol, count(*) AS c FROM br GROUP BY 1) USING (symbol)",
        _IND,
        f"br AS (SELECT symbol, ts, return_1d AS r FROM (SELECT * REPLACE (bb_span AS bb_width), {_roll('return_1d', 10, 'stddev_samp')} AS volatility_10d FROM ind) WHERE {_whole(_DAY)} AND return_1d IS NOT NULL)",
        f"bd AS (SELECT symbol, round, r, {_DRAW} AS w FROM (SELECT *, {_unit('42', 'round', 'symbol', _AT)} AS u FROM br, (SELECT unnest(range(0, 1000)) AS round)))",
        "ba AS (SELECT symbol, round, sum(w)::DOUBLE AS n, sum(w * r) AS s, sum(w * r * r) AS q FROM bd GROUP BY 1, 2 HAVING sum(w) > 1)",
        "bv AS (SELECT symbol, CASE WHEN v > 0 THEN (s / n - 0.02::DOUBLE / 365) / sqrt(v) * sqrt(365.0::DOUBLE) ELSE 0.0::DOUBLE END AS sharpe FROM (SELECT *, (q - n * (s / n) * (s / n)) / (n - 1) AS v FROM ba))",
        "bs AS (SELECT symbol, avg(sharpe) AS m, stddev_pop(sharpe) AS s, quantile_cont(sharpe, 0.025) AS lo, quantile_cont(sharpe, 0.975) AS hi FROM bv GROUP BY 1)",
    ),
    "bootstrap_accuracy": _bars(
        "SELECT symbol, round(max(v) FILTER (round < 0), 6) + 0.0 AS point, round(quantile_cont(v, 0.025) FILTER (round >= 0), 6) + 0.0 AS lower, round(quantile_cont(v, 0.975) FILTER (round >= 0), 6) + 0.0 AS upper FROM bq GROUP BY symbol",
        _targets(),
        _momentum("t"),
        f"bp AS (SELECT symbol, round, CASE WHEN round < 0 THEN 1 ELSE {_DRAW} END AS w, signal, future_return FROM (SELECT *, {_unit('42', 'round', 'symbol', _AT)} AS u FROM m, (SELECT unnest(range(-1, 200)) AS round)))",
        "bq AS (SELECT symbol, round, sum(w) FILTER ((signal = 'BUY' AND future_return > 0) OR (signal = 'SELL' AND future_return < 0))::DOUBLE / nullif(sum(w) FILTER (signal <> 'HOLD'), 0) AS v FROM bp GROUP BY 1, 2)",
    ),
    "t_test": _bars(f"SELECT symbol, n, {_r('mean', 't_stat', 'p_value')}, coalesce(p_value < 0.05 AND t_stat > 0, FALSE) AS above FROM (SELECT *, least(1.0::DOUBLE, {_area('atan(abs(t_stat) / sqrt(df))')} / {_area('0.0::DOUBLE')}) AS p_value FROM ts0)", _targets(), _T_STAT),
    "mean_accuracy": _bars(
        "SELECT symbol, round(avg(a), 6) + 0.0 AS mean_accuracy, round(avg(a) FILTER (n > 0), 6) + 0.0 AS mean_with_signals FROM (SELECT *, coalesce(good / nullif(n, 0)::DOUBLE, 0.5) AS a FROM f) GROUP BY symbol",
        _targets(),
        _momentum("t"),
        f"f AS (SELECT symbol, regime, count(*) FILTER (signal <> 'HOLD') AS n, count(*) FILTER ((signal = 'BUY' AND future_return > 0) OR (signal = 'SELL' AND future_return < 0)) AS good FROM (SELECT *, least((row_number() {_W} - 1) // greatest(1, count(*) OVER (PARTITION BY symbol) // 5), 4) AS regime FROM m) GROUP BY 1, 2)",
    ),
    "grid_given": _feat(
        "SELECT threshold, vol_filter, count(*) FILTER (s <> 0) AS n_signals, count(*) FILTER (s * future_return > 0) AS n_correct, round(coalesce(count(*) FILTER (s * future_return > 0) / nullif(count(*) FILTER (s <> 0), 0)::DOUBLE, 0.5), 6) + 0.0 AS direction_accuracy "
        "FROM (SELECT *, CASE WHEN vol_filter = 'median' AND NOT rv_20 > med THEN 0 WHEN p_up > threshold THEN 1 WHEN p_up < 1.0::DOUBLE - threshold THEN -1 ELSE 0 END AS s FROM gp, gr) GROUP BY 1, 2",
        _BASE, _targets("base"), _P_UP.format(source="t"), "gp AS (SELECT *, quantile_cont(rv_20, 0.5) OVER (PARTITION BY symbol) AS med FROM pr)", _GRID,
    ),
    "walkforward_pnl": _feat(
        f"SELECT symbol, {_r('final_equity', 'total_return_pct', 'bh_return_pct', 'pnl', 'sharpe_ratio', 'max_drawdown_pct')}, n_trades, n_ended FROM (SELECT symbol, arg_max(equity, idx) AS final_equity, (arg_max(equity, idx) / 10000.0 - 1.0) * 100.0 AS total_return_pct, (arg_max(price, idx) / arg_min(price, idx) FILTER (idx >= {_LONG['warmup']}) - 1.0) * 100.0 AS bh_return_pct, "
        "count(*) FILTER (opened) AS n_trades, count(*) FILTER (ended) AS n_ended, coalesce(sum(pnl) FILTER (ended), 0.0) AS pnl, CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(8760.0::DOUBLE) ELSE 0.0 END AS sharpe_ratio, min(dd) * 100.0 AS max_drawdown_pct FROM hr GROUP BY symbol)",
        _BASE, _P_UP.format(source="base"), _HELD.strip(),
    ),
    "walkforward_trades": _feat("SELECT symbol, CASE WHEN side > 0 THEN 'long' ELSE 'short' END AS side, CAST(idx AS INTEGER) AS exit_idx, round(pnl, 6) + 0.0 AS pnl FROM hb WHERE ended", _BASE, _P_UP.format(source="base"), _HELD.strip()),
    "price_alignment": _bars(f"SELECT symbol, end_idx, round(entry_close, 6) + 0.0 AS entry_close, round(exit_close, 6) + 0.0 AS exit_close FROM (SELECT symbol, row_number() {_W} - 1 AS end_idx, close AS entry_close, coalesce(lead(close, 24) {_W}, last_value(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS exit_close FROM bars) WHERE end_idx >= 19 AND (end_idx - 19) % 5 = 0"),
    "prefix_selection": _feat(f"SELECT symbol, ts, {_r(*[c for c in FEATURES if c.startswith(('vol_', 'macd'))])} FROM base", _BASE),
    "numeric_selection": "SELECT CAST(sum(c_custkey) AS BIGINT) AS c_custkey, CAST(sum(c_acctbal) AS DOUBLE) AS c_acctbal FROM customer",
    "csv_round_trip": _bars(f"SELECT symbol, ts, {_OHLC} FROM bars"),
    "cached_table": _bars(f"SELECT symbol, ts, {_OHLC} FROM bars"),
    "json_payload": _bars("SELECT symbol, ts, CAST(n AS BIGINT) AS n_transactions, round(total / 1000000000.0::DOUBLE, 6) + 0.0 AS total_value, number AS block_number, 'number,transactions' AS keys FROM (SELECT symbol, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, count(*) AS n, CAST(sum(CAST(floor(volume * 1000000) AS BIGINT)) AS DOUBLE) AS total, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS number FROM bars GROUP BY symbol, date_trunc('day', ts))"),
    "stream_sessions": """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS "end", count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
FROM (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTES >= ts THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""",
    "stream_averages": _bars(f"SELECT symbol, ts, round(close, 6) + 0.0 AS close, CAST(least(20, row_number() {_W}) AS INTEGER) AS n_held, round({_roll('close', 20, 'avg', 1)}, 6) + 0.0 AS average FROM bars"),
    "volume_attach": _bars("SELECT b.symbol, b.ts, round(close, 6) + 0.0 AS close, v.volume FROM bars b ASOF LEFT JOIN (SELECT event_type AS symbol, CAST(time_bucket(INTERVAL 6 HOURS, ts) AS TIMESTAMP) AS ts, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2) v ON b.symbol = v.symbol AND b.ts >= v.ts"),
    "regime_labels": _feat(f"SELECT symbol, ts, CAST(CASE WHEN rv_20 < lo THEN 0 WHEN rv_20 >= hi THEN 2 ELSE 1 END AS INTEGER) AS regime FROM feat, (SELECT quantile_cont(rv_20, 0.33) AS lo, quantile_cont(rv_20, 0.66) AS hi FROM (SELECT *, row_number() {_W} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM feat) WHERE i < floor(n * 0.8::DOUBLE))"),
    "pool_union": _bars("SELECT symbol, count(*) AS n, round(avg(close), 6) + 0.0 AS avg_close FROM bars GROUP BY symbol"),
}


# --- thresholds of the rule -------------------------------------------------------------------

_TUNED = f"""tg AS (SELECT * FROM t), {_SCORES.replace('FROM base', 'FROM tg')},
sp AS (SELECT *, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, row_number() {_W} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM sc)),
rg(rise) AS (VALUES (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE), (1.25::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE))"""


def _ruled(source: str, name: str, key: str) -> str:
    """Signals of the rule on rows (..., rise) by a key."""
    buy, sell = "c1_zscore > rise AND confidence > 0.4 AND drift >= 0", "c1_zscore < -1.0 OR (c1_zscore > rise AND drift < 0)"
    return f"{name} AS (SELECT {key} AS symbol, ts, close, future_return, CASE WHEN {buy} THEN 'BUY' WHEN {sell} THEN 'SELL' ELSE 'HOLD' END AS signal, CASE WHEN {buy} THEN least(0.5, confidence * 0.5 * abs(c1_zscore) / 2.0) WHEN {sell} THEN -least(0.5, confidence * 0.5) ELSE 0.0 END::DOUBLE AS position_size FROM {source})"


_TRIED = ", ".join(
    [
        _backtest(False, _ruled("sp, rg WHERE split = 'val'", "mv", "sp.symbol || '@' || CAST(rise AS VARCHAR)"), "0.001::DOUBLE", "v"),
        _metrics("v", "0.001::DOUBLE", "mv"),
        "best AS (SELECT symbol, rise, val_sharpe FROM (SELECT split_part(symbol, '@', 1) AS symbol, CAST(split_part(symbol, '@', 2) AS DOUBLE) AS rise, sharpe_ratio AS val_sharpe, row_number() OVER (PARTITION BY split_part(symbol, '@', 1) ORDER BY sharpe_ratio DESC, CAST(split_part(symbol, '@', 2) AS DOUBLE)) AS place FROM mtv) WHERE place = 1)",
    ]
)
_COUNTS = "total_trades, winning_trades, losing_trades"

ORACLES |= {
    "rule_tuning": _feat(
        f"SELECT symbol, {_r('rise', 'val_sharpe')}, {_COUNTS}, {_r(*_METRIC_COLUMNS)} FROM mte JOIN best USING (symbol)",
        _BASE, _targets("base"), _TUNED, _TRIED,
        _backtest(False, _ruled("sp JOIN best USING (symbol) WHERE split = 'test'", "me", "symbol"), "0.001::DOUBLE", "e"), _metrics("e", "0.001::DOUBLE", "me"),
    ),
    "rule_across_symbols": _feat(
        f"SELECT symbol, {_COUNTS}, {_r(*_METRIC_COLUMNS)}, 'click' AS origin FROM mte",
        _BASE, _targets("base"), _TUNED, _TRIED,
        _backtest(False, _ruled("sp, (SELECT rise FROM best WHERE symbol = 'click') WHERE split = 'test' AND symbol <> 'click'", "me", "symbol"), "0.001::DOUBLE", "e"), _metrics("e", "0.001::DOUBLE", "me"),
    ),
    "rule_kfold": _feat(
        f"SELECT symbol, round(rise, 6) + 0.0 AS rise, n_signals, n_correct, round(coalesce(n_correct / nullif(n_signals, 0)::DOUBLE, 0.5), 6) + 0.0 AS direction_accuracy, round(CASE WHEN n_signals > 0 THEN {_P} ELSE 0.0 END, 6) + 0.0 AS share, round(CASE WHEN n_signals > 0 THEN greatest(0.0, {_MID} - {_SPREAD}) ELSE 0.0 END, 6) + 0.0 AS wilson_lower, round(CASE WHEN n_signals > 0 THEN least(1.0, {_MID} + {_SPREAD}) ELSE 0.0 END, 6) + 0.0 AS wilson_upper "
        "FROM (SELECT symbol, rise, count(*) FILTER (signal <> 'HOLD') AS n_signals, count(*) FILTER ((signal = 'BUY' AND future_return > 0) OR (signal = 'SELL' AND future_return < 0)) AS n_correct FROM mf JOIN best USING (symbol) GROUP BY 1, 2)",
        _BASE, _targets("base"), _TUNED, _TRIED, _KFOLD.replace("FROM bars", "FROM sc"),
        "fr AS (SELECT sp.*, fold FROM sp JOIN k ON sp.symbol = k.symbol WHERE k.n >= 55 AND split <> 'val' AND i >= train_end AND i < test_end)",
        _ruled("fr JOIN best USING (symbol)", "mf", "symbol"),
    ),
}


# --- Mapper graphs ----------------------------------------------------------------------------

_DIMS = ("total", "velocity", "avg_size", "max_to_avg", "counterparts", "suppliers")
_ENTITIES = f"""a AS (SELECT c_nationkey, sum(o_totalprice) AS total, count(*) / count(DISTINCT CAST(o_orderdate AS DATE))::DOUBLE AS velocity, avg(o_totalprice) AS avg_size, max(o_totalprice) / avg(o_totalprice) AS max_to_avg, count(DISTINCT c_custkey)::DOUBLE AS counterparts FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
s AS (SELECT c_nationkey, count(DISTINCT l_suppkey)::DOUBLE AS suppliers FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1),
z AS (SELECT c_nationkey AS id, {', '.join(f"(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 ELSE stddev_pop({c}) OVER () END) AS {c}" for c in _DIMS)} FROM a JOIN s USING (c_nationkey)),
zl AS (SELECT *, sqrt({' + '.join(f'{c} * {c}' for c in _DIMS)}) AS lens FROM z),
rr AS (SELECT min(lens) AS lo, (max(lens) - min(lens)) / 4 AS step FROM zl),
pt AS (SELECT i AS interval, zl.* FROM zl, rr, range(0, 4) g(i) WHERE lens >= lo + i * step - 0.25::DOUBLE * step AND lens <= lo + i * step - 0.25::DOUBLE * step + 1.5::DOUBLE * step),
nr AS (SELECT p.interval, p.id, q.id AS other FROM pt p JOIN pt q ON p.interval = q.interval AND {' + '.join(f'pow(p.{c} - q.{c}, 2)' for c in _DIMS)} <= 1.8::DOUBLE * 1.8::DOUBLE),
re(interval, id, other) AS (SELECT interval, id, other FROM nr UNION SELECT re.interval, re.id, nr.other FROM re JOIN nr ON re.interval = nr.interval AND re.other = nr.id),
cl AS (SELECT interval, id, min(other) AS root FROM re GROUP BY 1, 2 HAVING count(*) >= 2),
mb AS (SELECT interval, id, lens, lpad(CAST(interval AS VARCHAR), 4, '0') || '-' || lpad(CAST(dense_rank() OVER (PARTITION BY interval ORDER BY root) - 1 AS VARCHAR), 4, '0') AS node_id FROM cl JOIN pt USING (interval, id)),
nd AS (SELECT node_id, interval, count(*) AS size, avg(lens) AS lens_mean, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM mb GROUP BY 1, 2),
ed AS (SELECT x.node_id AS source, y.node_id AS target, count(*) AS weight FROM mb x JOIN mb y ON x.id = y.id AND x.node_id < y.node_id GROUP BY 1, 2),
nb AS (SELECT source AS v, target AS w FROM ed UNION SELECT target, source FROM ed),
gc(v, w) AS (SELECT node_id, node_id FROM nd UNION SELECT gc.v, nb.w FROM gc JOIN nb ON gc.w = nb.v),
co AS (SELECT v, min(w) AS component FROM gc GROUP BY 1)"""
#: Walks of each length between nodes; the shortest tell distances and numbers of paths.
_STEPS = 12
_PATHS = ", ".join(
    ["w1 AS (SELECT v AS s, w AS t, 1::DOUBLE AS c FROM nb)"]
    + [f"w{i} AS (SELECT s, w AS t, sum(c) AS c FROM w{i - 1} JOIN nb ON t = v GROUP BY 1, 2)" for i in range(2, _STEPS + 1)]
    + ["ww AS (" + " UNION ALL ".join(f"SELECT s, t, {i} AS d, c FROM w{i} WHERE s <> t" for i in range(1, _STEPS + 1)) + ")"]
    + ["sh AS (SELECT s, t, min(d) AS d, arg_min(c, d) AS c FROM ww GROUP BY 1, 2)"]
    + ["bw AS (SELECT node_id, coalesce(sum(a.c * b.c / x.c), 0.0) / CASE WHEN (SELECT count(*) FROM nd) > 2 THEN ((SELECT count(*) FROM nd) - 1) * ((SELECT count(*) FROM nd) - 2) ELSE 1 END AS betweenness FROM nd LEFT JOIN sh a ON a.t = node_id LEFT JOIN sh b ON b.s = node_id AND b.t <> a.s LEFT JOIN sh x ON x.s = a.s AND x.t = b.t AND x.d = a.d + b.d GROUP BY node_id)"]
)
_GRAPH_SUMS = "gs AS (SELECT * FROM (SELECT count(*) AS n_nodes, coalesce(avg(size), 0.0) AS avg_node_size, coalesce(max(size), 0) AS max_node_size FROM nd), (SELECT count(*) AS n_edges, coalesce(avg(weight), 0.0) AS avg_edge_weight FROM ed), (SELECT count(DISTINCT component) AS n_components FROM co))"


def _graph(select: str, *more: str) -> str:
    return f"WITH RECURSIVE {_ENTITIES}{''.join(', ' + m for m in more)} {select}"


ORACLES |= {
    "mapper_nodes": _graph("SELECT node_id, CAST(interval AS INTEGER) AS interval, size, round(lens_mean, 6) + 0.0 AS lens_mean, members FROM nd"),
    "mapper_edges": _graph("SELECT source, target, weight FROM ed"),
    "mapper_summary": _graph("SELECT n_nodes, round(avg_node_size, 6) + 0.0 AS avg_node_size, max_node_size, n_edges, round(avg_edge_weight, 6) + 0.0 AS avg_edge_weight FROM gs", _GRAPH_SUMS),
    "mapper_communities": _graph("SELECT CAST(row_number() OVER (ORDER BY size DESC, component) AS INTEGER) AS rank, component, size FROM (SELECT component, count(*) AS size FROM co GROUP BY 1)"),
    "mapper_ring_count": _graph("SELECT n_nodes, n_edges, n_components, n_edges - n_nodes + n_components AS n_rings FROM gs", _GRAPH_SUMS),
    "mapper_bottlenecks": _graph("SELECT node_id, round(betweenness, 6) + 0.0 AS betweenness FROM bw ORDER BY round(betweenness, 9) DESC, node_id LIMIT 3", _PATHS),
    "mapper_report": _graph(
        "SELECT n_nodes, round(avg_node_size, 6) + 0.0 AS avg_node_size, max_node_size, n_edges, round(avg_edge_weight, 6) + 0.0 AS avg_edge_weight, n_components AS n_communities, n_edges - n_nodes + n_components AS n_rings, "
        "(SELECT string_agg(node_id, ',' ORDER BY b DESC, node_id) FROM (SELECT node_id, round(betweenness, 9) AS b FROM bw ORDER BY b DESC, node_id LIMIT 3)) AS bottlenecks, (SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY n DESC) FROM (SELECT count(*) AS n FROM co GROUP BY component ORDER BY n DESC LIMIT 3)) AS largest_communities FROM gs",
        _GRAPH_SUMS, _PATHS,
    ),
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
