"""Trailing features of one symbol's daily bars.

Each group is ``group(bars) -> bars + columns`` named ``group__feature``.  Only
rows up to the current one are used.  Null marks a missing value: a window that
is not full yet, a zero denominator.  Flags are 0.0 or 1.0, 0.0 while unknown.
What needs a series' bars in order (recursive means, order statistics of
windows, swings, volume profiles) comes from one pass over blocks of each series
before the groups, ``sequential``; ``NEEDS`` names each group's columns of it.
A group is its windows over the bars alone (``WINDOWS``), which need no pass, and
what follows row by row from the pass (``BY_ROW``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .recursion import PROFILE, SWINGS
from .series import sequential
from .windows import flag, full, lag, nz, prior_n, symbol, zscore

EPS = 1e-9


def ohlcv() -> tuple[Column, ...]:
    return tuple(F.col(x) for x in ("open", "high", "low", "close", "volume"))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def price(b: DataFrame) -> DataFrame:
    """1, 5, 10 and 20 bar log returns, realised volatility, drawdown from the 20 bar peak."""
    O, H, L, C, V = ohlcv()  # noqa: E741
    x = ln(C)
    out = b.withColumns({f"price__log_return_{k}d": x - lag(x, k) for k in (1, 5, 10, 20)})
    r = F.col("price__log_return_1d")
    out = out.withColumns({f"price__realized_vol_{n}d": full(F.stddev_samp, r, n) for n in (5, 20, 60)})
    return out.withColumn("price__max_drawdown_20d", C / full(F.max, C, 20) - 1)


def true_range() -> Column:
    """Greatest of the three ranges; the first bar has only high - low."""
    O, H, L, C, V = ohlcv()  # noqa: E741
    before = lag(C)
    return F.greatest(H - L, F.abs(H - before), F.abs(L - before))


#: Columns of ``sequential`` that each group takes.
NEEDS = {
    "trend": "ema12 ema26 macd macd_signal adx di_plus di_minus aroon_up aroon_down mean_5 mean_20 mean_50 mean_200 top_252".split(), "momentum": "rsi_7 rsi_14 rsi_21 rsi_28 macd macd_signal distance_14 distance_20 typical_14 typical_20 high_14 low_14 stoch_d gap_before trend_60".split(),
    "volatility": "atr_7 atr_14 atr_21 ema20 squeeze vol_rank".split(), "volume": "force_13 volume_trend_60 dollar_z balance_z balance_slope vwap money_flow close_flow".split(), "volume_profile": PROFILE, "swings": SWINGS,
}


#: Columns that take fewer of the pass than their group.
ALONE = {"momentum__rsi_14": ["rsi_14"], "trend__macd_histogram": ["macd", "macd_signal"]}


def in_order(bars: DataFrame, groups=None) -> DataFrame:
    """``bars`` with what the named groups (all by default) take from the ordered pass."""
    want = passed(groups)
    return sequential(bars, want) if want else bars


def passed(groups=None) -> list[str]:
    """The columns of the pass that the named groups take."""
    return list(dict.fromkeys(n for g, names in NEEDS.items() if groups is None or g in groups for n in names))


def prepared(bars: DataFrame, groups=None) -> DataFrame:
    """``in_order`` by symbol."""
    out = in_order(bars, groups)
    return out.repartition(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol")  # windows take long for their bytes: as many tasks as there are partitions


def trend(b: DataFrame) -> DataFrame:
    """Moving-average ratios, MACD, directional movement, distance from long extremes, Aroon.  Needs ``prepared`` bars."""
    O, H, L, C, V = ohlcv()  # noqa: E741
    def sma(n):
        return F.col(f"mean_{n}")

    out = b.withColumns({f"trend__sma_ratio_{a}_{z}": sma(a) / nz(sma(z)) - 1 for a, z in ((5, 20), (20, 50), (50, 200))})
    out = out.withColumns(
        {
            "trend__ema_ratio_12_26": F.col("ema12") / nz(F.col("ema26")) - 1, "trend__macd": F.col("macd"), "trend__macd_signal": F.col("macd_signal"),
            "trend__macd_histogram": F.col("macd") - F.col("macd_signal"), "trend__adx_14": F.col("adx"), "trend__di_plus_14": F.col("di_plus"),
            "trend__di_minus_14": F.col("di_minus"), "trend__di_diff_14": F.col("di_plus") - F.col("di_minus"),
            "trend__price_to_sma200_ratio": C / nz(sma(200)) - 1, "trend__distance_from_52w_high": C / nz(F.col("top_252")) - 1,
            "trend__aroon_up_25": F.col("aroon_up"), "trend__aroon_down_25": F.col("aroon_down"), "trend__aroon_oscillator_25": F.col("aroon_up") - F.col("aroon_down"),
        }
    )
    return out


def rates(b: DataFrame) -> DataFrame:
    """Rates of change."""
    C = F.col("close")  # noqa: N806
    return b.withColumns({f"momentum__roc_{n}": 100 * (C / nz(lag(C, n)) - 1) for n in (5, 20)})


def momentum_by_row(b: DataFrame) -> DataFrame:
    O, H, L, C, V = ohlcv()  # noqa: E741
    rsi = F.col("rsi_14")
    top, low = F.col("high_14"), F.col("low_14")
    out = b.withColumns({f"momentum__rsi_{n}": F.col(f"rsi_{n}") for n in (7, 14, 21, 28)})
    out = out.withColumns(
        {
            "momentum__rsi_overbought": flag(rsi > 70), "momentum__rsi_oversold": flag(rsi < 30), "momentum__stoch_k_14": 100 * (C - low) / nz(top - low),
            "momentum__williams_r_14": -100 * (top - C) / nz(top - low),
            "_gap": F.col("macd") - F.col("macd_signal"), "_tp": (H + L + C) / 3,
        }
    )
    gap, before, tp = F.col("_gap"), F.col("gap_before"), F.col("_tp")
    out = out.withColumns(
        {
            "momentum__stoch_d_14": F.col("stoch_d"), "momentum__momentum_quality_60": F.col("trend_60"),
            "momentum__macd_cross_up": flag((gap > 0) & (before <= 0)), "momentum__macd_cross_down": flag((gap < 0) & (before >= 0)),
        }
    )
    cci = {f"momentum__cci_{n}": (tp - F.col(f"typical_{n}")) / (0.015 * nz(F.col(f"distance_{n}"))) for n in (14, 20)}
    return out.withColumns(cci).drop("_gap", "_tp")


def momentum(b: DataFrame) -> DataFrame:
    """RSI, stochastics, rates of change, Williams %R, trend quality, MACD crossings, CCI.  Needs ``prepared`` bars."""
    return momentum_by_row(rates(b))


def ranges(b: DataFrame) -> DataFrame:
    """Bollinger bands and range estimators."""
    O, H, L, C, V = ohlcv()  # noqa: E741
    mean, std = full(F.avg, C, 20), full(F.stddev_samp, C, 20)
    hl, co = F.pow(ln(H) - ln(L), F.lit(2.0)), F.pow(ln(C) - ln(O), F.lit(2.0))
    gk, pk = full(F.avg, 0.5 * hl - (2 * math.log(2) - 1) * co, 20), full(F.avg, hl, 20)
    return b.withColumns(
        {
            "volatility__bollinger_width_20": 4 * std / nz(mean), "volatility__bollinger_pct_b_20": (C - (mean - 2 * std)) / nz(4 * std),
            "volatility__garman_klass_vol_20": F.when(gk.isNotNull(), F.sqrt(F.greatest(gk, F.lit(0.0)))), "volatility__parkinson_vol_20": F.sqrt(pk / (4 * math.log(2))),
        }
    )


def volatility_by_row(b: DataFrame) -> DataFrame:
    C, atr, ema = F.col("close"), F.col("atr_14"), F.col("ema20")  # noqa: N806
    return b.withColumns(
        {
            **{f"volatility__atr_{n}": F.col(f"atr_{n}") for n in (7, 14, 21)}, "volatility__atr_14_pct": atr / nz(C), "volatility__atr_ratio_7_21": F.col("atr_7") / nz(F.col("atr_21")),
            "volatility__keltner_width_20": 4 * atr / nz(ema), "volatility__keltner_pct_b_20": (C - (ema - 2 * atr)) / nz(4 * atr),
            "volatility__bb_squeeze": F.col("squeeze"), "volatility__hist_vol_pct_rank_252": F.col("vol_rank"),
        }
    )


def volatility(b: DataFrame) -> DataFrame:
    """True ranges, Bollinger and Keltner bands, range estimators, rank of volatility.  Needs ``prepared`` bars."""
    return volatility_by_row(ranges(b))


def volumes(b: DataFrame) -> DataFrame:
    """The z-score of volume, and whether there was a volume for balances to begin with."""
    V = F.col("volume")  # noqa: N806
    # the panel ranks the z-score of volume unrounded, so that stays as other queries compute it
    return b.withColumns({"volume__volume_zscore_20": zscore(V, 20), "_known": F.count(V).over(symbol().rowsBetween(Window.unboundedPreceding, -19)) > 0})


def volume_by_row(b: DataFrame) -> DataFrame:
    C, known = F.col("close"), F.col("_known")  # noqa: N806
    return b.withColumns(
        {
            "volume__obv_slope_20": F.when(known, F.col("balance_slope")), "volume__obv_zscore_20": F.when(known, F.col("balance_z")),
            "volume__vwap_deviation_20": C / F.col("vwap") - 1, "volume__vwap_above": flag(C > F.col("vwap")), "volume__dollar_volume_zscore_20": F.col("dollar_z"),
            "volume__volume_trend_60": F.col("volume_trend_60"), "volume__mfi_14": F.col("money_flow"), "volume__cmf_20": F.col("close_flow"), "volume__force_index_13": F.col("force_13"),
        }
    ).drop("_known")


def volume(b: DataFrame) -> DataFrame:
    """Volume z-scores, on-balance volume, VWAP, volume trend, money flow, force index.  Needs ``prepared`` bars."""
    return volume_by_row(volumes(b))


def microstructure(b: DataFrame) -> DataFrame:
    """Where the bar's body and wicks lie in its range, and the gap from the bar before."""
    O, H, L, C, V = ohlcv()  # noqa: E741
    rng, top, low = nz(H - L) + EPS, H - F.greatest(C, O), F.least(C, O) - L
    return b.withColumns(
        {
            "microstructure__close_location": (C - L) / rng, "microstructure__body_pct": F.abs(C - O) / rng, "microstructure__upper_wick_pct": top / rng,
            "microstructure__lower_wick_pct": low / rng, "microstructure__wick_ratio": top / (low + EPS), "microstructure__gap_pct": O / nz(lag(C)) - 1,
        }
    )


def market_structure(b: DataFrame) -> DataFrame:
    """Whether a bar makes a higher high or lower low than the n bars before it."""
    O, H, L, C, V = ohlcv()  # noqa: E741
    out = b
    for n in (5, 10):
        past = prior_n(n)
        out = out.withColumn(f"market_structure__hh_{n}", flag((F.count(H).over(past) == n) & (H > F.max(H).over(past))))
        out = out.withColumn(f"market_structure__ll_{n}", flag((F.count(L).over(past) == n) & (L < F.min(L).over(past))))
    return out


FIBS = {"236": 0.236, "382": 0.382, "500": 0.5, "618": 0.618, "786": 0.786}


def swings(b: DataFrame) -> DataFrame:
    """Distance, age and touches of the last swing extreme confirmed five bars later; retracement levels between the last two.  Needs ``prepared`` bars."""
    C, hi, lo = F.col("close"), F.col("swing_high"), F.col("swing_low")  # noqa: N806
    span = F.when(hi > lo, hi - lo)
    out = b.withColumns(
        {
            "swings__dist_to_swing_high": (hi - C) / C, "swings__dist_to_swing_low": (C - lo) / C,
            **{f"swings__swing_{side}_{new}": F.col(f"swing_{side}_{old}") for side in ("high", "low") for new, old in (("age", "age"), ("touch_count_50", "touches"))},
            **{f"swings__fib_dist_{n}": (C - (lo + r * span)) / C for n, r in FIBS.items()},
        }
    )
    return out.withColumn("swings__nearest_fib_dist", F.least(*[F.abs(f"swings__fib_dist_{n}") for n in FIBS]))


def volume_profile(b: DataFrame) -> DataFrame:
    """Distance of the close from the price bin with most volume of 50 bars, and from the area around it that holds 70 %.  Needs ``prepared`` bars."""
    return b.withColumns({f"volume_profile__{n}": F.col(c) for n, c in zip(("poc_distance_50", "value_area_high_50", "value_area_low_50"), PROFILE, strict=True)})


GROUPS = {
    "price": price, "trend": trend, "momentum": momentum, "volatility": volatility, "volume": volume, "microstructure": microstructure,
    "market_structure": market_structure, "volume_profile": volume_profile, "swings": swings,
}
#: Groups' windows over the bars alone, by symbol, and what follows row by row from the bars, those and the pass.
WINDOWS = {"price": price, "momentum": rates, "volatility": ranges, "volume": volumes, "microstructure": microstructure, "market_structure": market_structure}
BY_ROW = {"trend": trend, "momentum": momentum_by_row, "volatility": volatility_by_row, "volume": volume_by_row, "volume_profile": volume_profile, "swings": swings}
