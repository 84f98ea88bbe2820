"""Queries over the trailing features: one per group, all of its columns."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import features as f
from ..functions.windows import rounded
from . import fixtures as fx
from .sqlkit import corr, flag, full, lag, last_n, prior_n, r, z

KEY = ["symbol", "bar_date"]
NAMES = {
    "price": [f"log_return_{k}d" for k in (1, 5, 10, 20)] + [f"realized_vol_{n}d" for n in (5, 20, 60)] + ["max_drawdown_20d"],
    "trend": "sma_ratio_5_20 sma_ratio_20_50 sma_ratio_50_200 ema_ratio_12_26 macd macd_signal macd_histogram adx_14 di_plus_14 di_minus_14 di_diff_14 price_to_sma200_ratio distance_from_52w_high aroon_up_25 aroon_down_25 aroon_oscillator_25".split(),
    "momentum": "rsi_7 rsi_14 rsi_21 rsi_28 rsi_overbought rsi_oversold stoch_k_14 stoch_d_14 roc_5 roc_20 williams_r_14 momentum_quality_60 macd_cross_up macd_cross_down cci_14 cci_20".split(),
    "volatility": "atr_7 atr_14 atr_21 atr_14_pct atr_ratio_7_21 bollinger_width_20 bollinger_pct_b_20 bb_squeeze keltner_width_20 keltner_pct_b_20 garman_klass_vol_20 parkinson_vol_20 hist_vol_pct_rank_252".split(),
    "volume": "volume_zscore_20 obv_slope_20 obv_zscore_20 vwap_deviation_20 vwap_above dollar_volume_zscore_20 volume_trend_60 mfi_14 cmf_20 force_index_13".split(),
    "microstructure": "close_location body_pct upper_wick_pct lower_wick_pct wick_ratio gap_pct".split(),
    "market_structure": ["hh_5", "hh_10", "ll_5", "ll_10"],
    "volume_profile": "poc_distance_50 value_area_high_50 value_area_low_50".split(),
    "swings": "dist_to_swing_high dist_to_swing_low swing_high_age swing_low_age swing_high_touch_count_50 swing_low_touch_count_50".split() + [f"fib_dist_{n}" for n in f.FIBS] + ["nearest_fib_dist"],
}
DIGITS = {"volume": 4}  # its force index is large


def columns(group: str) -> list[str]:
    return [f"{group}__{n}" for n in NAMES[group]]


def group_query(group: str):
    def query(spark, d):
        b = fx.bars(spark, d)
        out = f.GROUPS[group](f.prepared(b, [group])).select(*KEY, *columns(group))
        if group == "microstructure":  # a zero lower wick gives ratios of 1e9 and more: beyond a million in billions, as doubles are rounded for the comparison
            x = F.col("microstructure__wick_ratio")
            out = out.withColumn("microstructure__wick_ratio", F.when(F.abs(x) > 1e6, x / 1e9).otherwise(x))
        return rounded(out, DIGITS.get(group, 6))

    return query


def _ewm_step(y: str, x: str, a: float) -> str:
    """Next recursive mean where the input has no gaps after its first value."""
    return f"CASE WHEN x.{x} IS NULL THEN e.{y} WHEN e.{y} IS NULL THEN x.{x} ELSE (1 - {a!r}) * e.{y} + {a!r} * x.{x} END AS {y}"


_STATES = [("e12", "close", 2 / 13), ("e20", "close", 2 / 21), ("e26", "close", 2 / 27), ("fi", "fraw", 2 / 14)]
_STATES += [(f"g{n}", "gain", 1 / n) for n in (7, 14, 21, 28)] + [(f"l{n}", "loss", 1 / n) for n in (7, 14, 21, 28)]
_STATES += [(f"t{n}", "tr", 1 / n) for n in (7, 14, 21)] + [("pd", "pdm", 1 / 14), ("md", "mdm", 1 / 14)]
EWM_SQL = f"""
ex AS MATERIALIZED (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS gain, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS loss, (close - pc) * volume AS fraw,
  greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low)) AS tr,
  CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END AS pdm, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END AS mdm
  FROM (SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl, row_number() OVER w AS rn FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_date))),
e AS (SELECT symbol, rn, {", ".join(f"CAST({x} AS DOUBLE) AS {y}" for y, x, _ in _STATES)} FROM ex WHERE rn = 1
  UNION ALL SELECT x.symbol, x.rn, {", ".join(_ewm_step(*s) for s in _STATES)} FROM e JOIN ex x ON x.symbol = e.symbol AND x.rn = e.rn + 1),
e1 AS MATERIALIZED (SELECT *, CASE WHEN rn >= 26 THEN e12 - e26 END AS macd, CASE WHEN rn >= 14 THEN 100 * pd / t14 END AS di_plus, CASE WHEN rn >= 14 THEN 100 * md / t14 END AS di_minus FROM e),
e2 AS MATERIALIZED (SELECT *, 100 * abs(di_plus - di_minus) / nullif(di_plus + di_minus, 0) AS dx FROM e1),
s AS (SELECT symbol, rn, macd AS sig, dx AS adx, 1.0 AS wt, CAST(dx IS NOT NULL AS INT) AS n FROM e2 WHERE rn = 1
  UNION ALL SELECT x.symbol, x.rn, CASE WHEN s.sig IS NULL THEN x.macd ELSE 0.8 * s.sig + 0.2 * x.macd END,
    CASE WHEN x.dx IS NULL THEN s.adx WHEN s.adx IS NULL THEN x.dx ELSE (s.wt * (1 - 1/14.0::DOUBLE) * s.adx + (1/14.0::DOUBLE) * x.dx) / (s.wt * (1 - 1/14.0::DOUBLE) + 1/14.0::DOUBLE) END,
    CASE WHEN x.dx IS NOT NULL OR s.adx IS NULL THEN 1.0 ELSE s.wt * (1 - 1/14.0::DOUBLE) END, s.n + CAST(x.dx IS NOT NULL AS INT)
  FROM s JOIN e2 x ON x.symbol = s.symbol AND x.rn = s.rn + 1),
em AS MATERIALIZED (SELECT ex.*, CASE WHEN rn >= 12 THEN e12 END AS ema12, CASE WHEN rn >= 20 THEN e20 END AS ema20, CASE WHEN rn >= 26 THEN e26 END AS ema26, macd,
  CASE WHEN rn >= 34 THEN sig END AS macd_signal, di_plus, di_minus, CASE WHEN n >= 14 THEN adx END AS adx,
  {", ".join(f"CASE WHEN rn >= {n + 1} THEN 100 - 100 / (1 + g{n} / nullif(l{n}, 0)) END AS rsi_{n}" for n in (7, 14, 21, 28))},
  {", ".join(f"CASE WHEN rn >= {n} THEN t{n} END AS atr_{n}" for n in (7, 14, 21))}, CASE WHEN rn >= 14 THEN fi END AS force_13
  FROM ex JOIN e2 USING (symbol, rn) JOIN s USING (symbol, rn))"""


def ewm_sql(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",".join([fx.BARS_SQL, EWM_SQL, *more]) + "\n" + select


def _select(group: str, exprs: dict[str, str], source: str = "bars") -> str:
    return "SELECT symbol, bar_date, " + ", ".join(r(e, f"{group}__{n}", DIGITS.get(group, 6)) for n, e in exprs.items()) + f" FROM {source}"


PRICE_SQL = f"lr AS (SELECT *, {', '.join(f'ln(close) - {lag('ln(close)', k)} AS r{k}' for k in (1, 5, 10, 20))} FROM bars)"
_price = {f"log_return_{k}d": f"r{k}" for k in (1, 5, 10, 20)} | {f"realized_vol_{n}d": full("stddev_samp", "r1", n) for n in (5, 20, 60)} | {"max_drawdown_20d": f"close / {full('max', 'close', 20)} - 1"}


def _sma(n):
    return full("avg", "close", n)


def _aroon(x, pick):
    held = f"list({x}) OVER {last_n(25)}"
    return f"CASE WHEN count({x}) OVER {last_n(25)} = 25 THEN 100.0 * list_position({held}, list_{pick}({held})) / 25 END"


_trend = {f"sma_ratio_{a}_{b}": f"{_sma(a)} / {_sma(b)} - 1" for a, b in ((5, 20), (20, 50), (50, 200))} | {
    "ema_ratio_12_26": "ema12 / ema26 - 1", "macd": "macd", "macd_signal": "macd_signal", "macd_histogram": "macd - macd_signal", "adx_14": "adx", "di_plus_14": "di_plus",
    "di_minus_14": "di_minus", "di_diff_14": "di_plus - di_minus", "price_to_sma200_ratio": f"close / {_sma(200)} - 1", "distance_from_52w_high": f"close / {full('max', 'high', 252)} - 1",
    "aroon_up_25": _aroon("high", "max"), "aroon_down_25": _aroon("low", "min"), "aroon_oscillator_25": f"({_aroon('high', 'max')}) - ({_aroon('low', 'min')})",
}
_top, _low = full("max", "high", 14), full("min", "low", 14)
_mom = {f"rsi_{n}": f"rsi_{n}" for n in (7, 14, 21, 28)} | {
    "rsi_overbought": flag("rsi_14 > 70"), "rsi_oversold": flag("rsi_14 < 30"), "stoch_k_14": "k", "stoch_d_14": full("avg", "k", 3), "roc_5": f"100 * (close / {lag('close', 5)} - 1)",
    "roc_20": f"100 * (close / {lag('close', 20)} - 1)", "williams_r_14": f"-100 * ({_top} - close) / nullif({_top} - {_low}, 0)", "momentum_quality_60": corr("close", "rn", 60),
    "macd_cross_up": flag(f"gap > 0 AND {lag('gap')} <= 0"), "macd_cross_down": flag(f"gap < 0 AND {lag('gap')} >= 0"),
} | {f"cci_{n}": f"CASE WHEN count(tp) OVER {last_n(n)} = {n} THEN (tp - avg(tp) OVER {last_n(n)}) / (0.015 * nullif(list_avg(list_transform(h{n}, lambda x: abs(x - list_avg(h{n})))), 0)) END" for n in (14, 20)}
MOM_SQL = f"mm AS (SELECT *, 100 * (close - {_low}) / nullif({_top} - {_low}, 0) AS k, macd - macd_signal AS gap, (high + low + close) / 3 AS tp, list((high + low + close) / 3) OVER {last_n(14)} AS h14, list((high + low + close) / 3) OVER {last_n(20)} AS h20 FROM em)"
_std = full("stddev_samp", "close", 20)
VOL_SQL = f"v1 AS (SELECT *, ln(close) - {lag('ln(close)')} AS ret, 4 * {_std} / nullif({_sma(20)}, 0) AS width FROM em), v2 AS (SELECT *, {full('stddev_samp', 'ret', 20)} AS rv FROM v1), v3 AS (SELECT *, list(rv) FILTER (rv IS NOT NULL) OVER {prior_n(251)} AS rvs FROM v2)"
_gk = full("avg", f"(0.5 * pow(ln(high) - ln(low), 2) - {2 * math.log(2) - 1!r} * pow(ln(close) - ln(open), 2))", 20)


def _guard(x, v):
    return f"CASE WHEN count({x}) OVER {prior_n(251)} >= 99 AND {x} IS NOT NULL THEN {v} END"


_vol = {f"atr_{n}": f"atr_{n}" for n in (7, 14, 21)} | {
    "atr_14_pct": "atr_14 / close", "atr_ratio_7_21": "atr_7 / nullif(atr_21, 0)", "bollinger_width_20": "width", "bollinger_pct_b_20": f"(close - ({_sma(20)} - 2 * {_std})) / nullif(4 * {_std}, 0)",
    "bb_squeeze": _guard("width", f"CAST(width <= quantile_cont(width, 0.2) OVER {prior_n(251)} AS DOUBLE)"), "keltner_width_20": "4 * atr_14 / ema20", "keltner_pct_b_20": "(close - (ema20 - 2 * atr_14)) / nullif(4 * atr_14, 0)",
    "garman_klass_vol_20": f"CASE WHEN {_gk} IS NOT NULL THEN sqrt(greatest({_gk}, 0.0)) END", "parkinson_vol_20": f"sqrt({full('avg', '(pow(ln(high) - ln(low), 2))', 20)} / {4 * math.log(2)!r})",
    "hist_vol_pct_rank_252": _guard("rv", "len(list_filter(rvs, lambda y: y < rv)) / len(rvs)"),
}
VOLUME_SQL = f"o1 AS (SELECT *, sign(coalesce(close - {lag('close')}, 0)) * volume AS sv, (high + low + close) / 3 AS tp, close * volume AS dv, ((close - low) - (high - close)) / nullif(high - low, 0) * volume AS mv FROM em), o2 AS (SELECT *, sum(sv) OVER (PARTITION BY symbol ORDER BY bar_date ROWS UNBOUNDED PRECEDING) AS obv, sign(tp - {lag('tp')}) AS way FROM o1)"
_vwap = f"({full('sum', 'dv', 20)} / nullif({full('sum', 'volume', 20)}, 0))"
_up, _down = (full("sum", f"(CASE WHEN coalesce(way, 0) {c} 0 THEN tp * volume ELSE 0 END)", 14) for c in "><")
_volume = {
    "volume_zscore_20": z("volume", 20), "obv_slope_20": f"CASE WHEN count(obv) OVER {last_n(20)} = 20 THEN regr_slope(obv, rn) OVER {last_n(20)} END", "obv_zscore_20": z("obv", 20), "vwap_deviation_20": f"close / {_vwap} - 1",
    "vwap_above": flag(f"close > {_vwap}"), "dollar_volume_zscore_20": z("dv", 20), "volume_trend_60": corr("ln(volume)", "rn", 60), "mfi_14": f"100 - 100 / (1 + {_up} / nullif({_down}, 0))",
    "cmf_20": f"{full('sum', 'mv', 20)} / nullif({full('sum', 'volume', 20)}, 0)", "force_index_13": "force_13",
}
_rng = "(nullif(high - low, 0) + 1e-9)"
_micro = {
    "close_location": f"(close - low) / {_rng}", "body_pct": f"abs(close - open) / {_rng}", "upper_wick_pct": f"(high - greatest(close, open)) / {_rng}", "lower_wick_pct": f"(least(close, open) - low) / {_rng}",
    "wick_ratio": "CASE WHEN abs((high - greatest(close, open)) / (least(close, open) - low + 1e-9)) > 1e6 THEN (high - greatest(close, open)) / (least(close, open) - low + 1e-9) / 1e9 ELSE (high - greatest(close, open)) / (least(close, open) - low + 1e-9) END", "gap_pct": f"open / {lag('close')} - 1",
}
_mkt = {f"{k}_{n}": flag(f"count(1) OVER {prior_n(n)} = {n} AND {x} {op} {agg}({x}) OVER {prior_n(n)}") for k, x, op, agg in (("hh", "high", ">", "max"), ("ll", "low", "<", "min")) for n in (5, 10)}
_AROUND, _KNOWN = "(PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)", "(PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING)"
SWING_SQL = f"""
sw0 AS (SELECT *, {", ".join(f"CASE WHEN count(1) OVER {_AROUND} = 11 AND {x} = {g}({x}) OVER {_AROUND} THEN {{'rn': rn, 'x': {x}}} END AS s{x}, list({x}) OVER {last_n(50)} AS a{x}" for x, g in (("high", "max"), ("low", "min")))} FROM nb),
sw1 AS (SELECT *, last_value(shigh IGNORE NULLS) OVER {_KNOWN} AS hi, last_value(slow IGNORE NULLS) OVER {_KNOWN} AS lo FROM sw0),
sw2 AS (SELECT *, CASE WHEN hi.x > lo.x THEN hi.x - lo.x END AS span FROM sw1)"""
_fib = {n: f"(close - (lo.x + {v!r} * span)) / close" for n, v in f.FIBS.items()}
_swings = {
    "dist_to_swing_high": "(hi.x - close) / close", "dist_to_swing_low": "(close - lo.x) / close", "swing_high_age": "CAST(rn - hi.rn AS DOUBLE)", "swing_low_age": "CAST(rn - lo.rn AS DOUBLE)",
    "swing_high_touch_count_50": "CASE WHEN hi.x > 0 THEN CAST(len(list_filter(ahigh, lambda y: abs(y - hi.x) / hi.x <= 0.005)) AS DOUBLE) END",
    "swing_low_touch_count_50": "CASE WHEN lo.x > 0 THEN CAST(len(list_filter(alow, lambda y: abs(y - lo.x) / lo.x <= 0.005)) AS DOUBLE) END",
    **{f"fib_dist_{n}": e for n, e in _fib.items()}, "nearest_fib_dist": "least(" + ", ".join(f"abs({e})" for e in _fib.values()) + ")",
}

QUERIES = {f"f_{g}": group_query(g) for g in NAMES}
SQL = {
    "f_price": fx.sql(_select("price", _price, "lr"), PRICE_SQL), "f_trend": ewm_sql(_select("trend", _trend, "em")), "f_momentum": ewm_sql(_select("momentum", _mom, "mm"), MOM_SQL),
    "f_volatility": ewm_sql(_select("volatility", _vol, "v3"), VOL_SQL), "f_volume": ewm_sql(_select("volume", _volume, "o2"), VOLUME_SQL),
    "f_microstructure": fx.sql(_select("microstructure", _micro)), "f_market_structure": fx.sql(_select("market_structure", _mkt)),
    "f_swings": fx.sql(_select("swings", _swings, "sw2"), fx.NUMBERED_SQL, SWING_SQL),
}
