"""Features across symbols on a date, market regime, macro series, sector and interaction columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.shared import written
from .series import sequential
from .windows import by, full, lag, nz, pct_rank, prior_n

SERIES = ["vix", "vix9d", "vix3m", "vvix", "skew", "t10y", "t5y", "fx", "lqd", "hyg", "dxy", "gold", "copper"]
RANKED = {"log_return_5d": "price__log_return_5d", "log_return_20d": "price__log_return_20d", "rsi_14": "momentum__rsi_14", "volume_zscore_20": "volume__volume_zscore_20", "realized_vol_20d": "price__realized_vol_20d"}


def cross_sectional(panel: DataFrame) -> DataFrame:
    """Percentile ranks (average rank over the count of values) and the z-score of the 5-day return within each date."""
    x, day = F.col("price__log_return_5d"), Window.partitionBy("bar_date")
    out = panel.withColumns({f"cross_sectional__xs_rank_{n}": pct_rank(c, "bar_date") for n, c in RANKED.items()})
    return out.withColumn("cross_sectional__xs_zscore_log_return_5d", (x - F.avg(x).over(day)) / nz(F.stddev_samp(x).over(day)))


def regime_by_date(panel: DataFrame) -> DataFrame:
    """One row per date: mean return, share that advances, 5-day sum, 20-day volatility, dispersion of 20-day returns.

    The panel is aggregated to dates first; only that small table meets in one
    ordered window.
    """
    r = F.col("price__log_return_1d")
    days = panel.groupBy("bar_date").agg(
        F.avg(r).alias("regime__market_return_1d"), F.avg(F.coalesce(r > 0, F.lit(False)).cast("double")).alias("regime__market_breadth_advance_decline"),
        F.stddev_samp("price__log_return_20d").alias("regime__market_dispersion_20d"),
    )
    m, w = F.col("regime__market_return_1d"), Window.orderBy("bar_date")
    w5, w20 = w.rowsBetween(-4, 0), w.rowsBetween(-19, 0)
    return days.withColumns(
        {
            "regime__market_return_5d": F.when(F.count(m).over(w5) == 5, F.sum(m).over(w5)),
            "regime__market_realized_vol_20d": F.when(F.count(m).over(w20) == 20, F.stddev_samp(m).over(w20)),
        }
    )


def regime(panel: DataFrame) -> DataFrame:
    return panel.join(F.broadcast(regime_by_date(panel)), "bar_date", "left")  # a row a date: bounded by the calendar


def align_series(macro: DataFrame, series: list[str]) -> DataFrame:
    """One row per date of any series, each series carried forward."""
    w = Window.orderBy("macro_date").rowsBetween(Window.unboundedPreceding, 0)
    wide = macro.groupBy("macro_date").pivot("series", series).agg(F.first("value"))
    return wide.select("macro_date", *[F.last(s, True).over(w).alias(s) for s in series])


def trailing_z(x: Column, n: int, w=None) -> Column:
    """z against the n rows before; needs max(20, n // 4) of them."""
    past = prior_n(n, w)
    return F.when(F.count(x).over(past) >= max(20, n // 4), (x - F.avg(x).over(past)) / nz(F.stddev_samp(x).over(past)))


def macro_features(macro: DataFrame, series: list[str]) -> DataFrame:
    """Levels, changes and ratios of the aligned macro series; lags count rows of the macro calendar."""
    a, w = align_series(macro, series), Window.orderBy("macro_date")
    c = {s: F.col(s) for s in series}

    def step(x, k=5):
        return x - F.lag(x, k).over(w)

    out = {f"macro__{n}_z_252": trailing_z(x, 252, w) for n, x in {"vix_level": c["vix"], "treasury_10y": c["t10y"], "vvix": c["vvix"], "yield_curve_slope": c["t10y"] - c["t5y"], "credit_spread": c["lqd"] / nz(c["hyg"]), "gold_copper_ratio": c["gold"] / nz(c["copper"])}.items()}
    out |= {"macro__vix_chg_5d": step(c["vix"]), "macro__treasury_10y_chg_5d": step(c["t10y"]), "macro__skew_chg_5d": step(c["skew"]), "macro__credit_spread_chg_5d": step(c["lqd"] / nz(c["hyg"]))}
    out |= {"macro__fx_ret_5d": step(F.ln(c["fx"])), "macro__dxy_chg_5d": step(F.ln(c["dxy"])), "macro__vix9d_to_vix_ratio": c["vix9d"] / nz(c["vix"]), "macro__vix_to_vix3m_ratio": c["vix"] / nz(c["vix3m"]), "macro__skew_level": c["skew"]}
    return a.select(F.col("macro_date").alias("bar_date"), *[e.alias(n) for n, e in out.items()])


def with_macro(panel: DataFrame, by_date: DataFrame) -> DataFrame:
    """Exact-date left join of the date table onto every symbol."""
    return panel.join(F.broadcast(by_date), "bar_date", "left")  # a row a date: bounded by the calendar


PAIRS = {
    "rsi14_x_vix_z": ("momentum__rsi_14", "macro__vix_level_z_252"), "ret5_x_vix_z": ("price__log_return_5d", "macro__vix_level_z_252"), "ret20_x_credit_z": ("price__log_return_20d", "macro__credit_spread_z_252"),
    "rsi14_x_credit_z": ("momentum__rsi_14", "macro__credit_spread_z_252"), "rv20_x_vix_z": ("price__realized_vol_20d", "macro__vix_level_z_252"), "ret5_x_curve_z": ("price__log_return_5d", "macro__yield_curve_slope_z_252"),
    "macd_hist_x_dxy5": ("trend__macd_histogram", "macro__dxy_chg_5d"), "rsi14_x_t10_chg5": ("momentum__rsi_14", "macro__treasury_10y_chg_5d"),
}


def interactions(panel: DataFrame) -> DataFrame:
    """Products of pairs of columns; null where an input column is missing."""
    have = set(panel.columns)
    return panel.withColumns({f"interactions__{n}": F.col(a) * F.col(b) if {a, b} <= have else F.lit(None).cast("double") for n, (a, b) in PAIRS.items()})


#: Canonical sectors and other spellings of them (fixed values).
SECTORS = [
    "Communication Services", "Consumer Cyclical", "Consumer Defensive", "Energy", "Financial Services", "Healthcare", "Industrials", "Basic Materials", "Real Estate", "Technology", "Utilities", "Unknown",
]
SPELLINGS = {
    "Financials": "Financial Services", "Consumer Discretionary": "Consumer Cyclical", "Consumer Staples": "Consumer Defensive", "Materials": "Basic Materials",
    "Information Technology": "Technology", "Communications Services": "Communication Services",
}


def canonical_sector(label: Column) -> Column:
    """Canonical name of a sector label, without blanks around it; null and blank give ``Unknown``, other labels stay as they are."""
    known = F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])
    s = F.trim(label)
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("Unknown")).otherwise(F.coalesce(F.try_element_at(known, s), s))


def sector_bucket(label: Column) -> Column:
    """One of ``SECTORS``: labels that are none of them are ``Unknown``."""
    s = canonical_sector(label)
    return F.when(s.isin(SECTORS), s).otherwise(F.lit("Unknown"))


def sector_column(sector: str) -> str:
    return f"sector__is_{sector.lower().replace(' ', '_').replace('&', 'and')}"


def sector_flags(panel: DataFrame, dim: DataFrame) -> DataFrame:
    """One 0/1 column per canonical sector, from a (symbol, sector) table; symbols without a row are unknown."""
    out = panel.join(dim.select("symbol", F.col("sector").alias("_s")).hint("shuffle_hash"), "symbol", "left").withColumn("_s", sector_bucket(F.col("_s")))
    return out.withColumns({sector_column(s): (F.col("_s") == s).cast("double") for s in SECTORS}).drop("_s")


RESIDUALS = {"resid_log_return_5d": "price__log_return_5d", "resid_log_return_20d": "price__log_return_20d", "resid_realized_vol_20d": "price__realized_vol_20d", "resid_rsi_14_minus_sector": "momentum__rsi_14"}


#: Canonical sector -> benchmark fund (fixed values).
SECTOR_FUNDS = {
    "Technology": "XLK", "Financial Services": "XLF", "Energy": "XLE", "Healthcare": "XLV", "Consumer Cyclical": "XLY", "Consumer Defensive": "XLP",
    "Industrials": "XLI", "Utilities": "XLU", "Real Estate": "XLRE", "Basic Materials": "XLB", "Communication Services": "XLC",
}


def sector_benchmarks(sectors: DataFrame, funds: dict[str, str] | None = None) -> DataFrame:
    """(symbol, benchmark): the fund of each symbol's sector, null for unknown sectors."""
    known = F.create_map(*[F.lit(x) for kv in (funds or SECTOR_FUNDS).items() for x in kv])
    return sectors.select("symbol", F.try_element_at(known, canonical_sector(F.col("sector"))).alias("benchmark"))


def etf_features(bars: DataFrame, funds: list[str] | None = None) -> DataFrame:
    """(benchmark, bar_date, 5 and 20 bar log returns, 20 bar volatility, 14 bar RSI) of benchmark instruments; without ``funds`` of all in ``bars``."""
    rows = bars if funds is None else bars.filter(F.col("symbol").isin(funds))
    rows = sequential(rows.select("symbol", "bar_date", "close"), ["rsi_14"])
    x = F.when(F.col("close") > 0, F.ln("close"))
    rows = rows.withColumns({"_x": x, "_r": x - lag(x)})
    return rows.select(
        F.col("symbol").alias("benchmark"), "bar_date", (F.col("_x") - lag(F.col("_x"), 5)).alias("etf_log_return_5d"), (F.col("_x") - lag(F.col("_x"), 20)).alias("etf_log_return_20d"),
        full(F.stddev_samp, F.col("_r"), 20).alias("etf_realized_vol_20d"), F.col("rsi_14").alias("etf_rsi_14"),
    )


ETF = ["etf_log_return_5d", "etf_log_return_20d", "etf_realized_vol_20d", "etf_rsi_14"]


def sector_residual(panel: DataFrame, benchmark_of: DataFrame, funds: DataFrame | None = None) -> DataFrame:
    """Each symbol's features minus those of its sector's benchmark on the date, and the trailing z of the first.

    ``funds`` are the benchmarks' ``etf_features``; without it the benchmarks are symbols of the panel.
    Rows of symbols that are nobody's benchmark are left out before they meet the
    panel; the others are written, so that their size tells how to join them.
    """
    cols = list(RESIDUALS.values())
    own = panel.select(F.col("symbol").alias("benchmark"), "bar_date", *[F.col(c).alias(e) for c, e in zip(cols, ETF, strict=True)]) if funds is None else funds
    bench = own.select("benchmark", "bar_date", *[F.col(e).alias(f"_b_{c}") for c, e in zip(cols, ETF, strict=True)])
    bench = written(bench.join(benchmark_of.select("benchmark").distinct(), "benchmark", "left_semi"))
    out = panel.join(benchmark_of.hint("shuffle_hash"), "symbol", "left").join(bench, ["benchmark", "bar_date"], "left")
    out = out.withColumns({f"sector_residual__{n}": F.col(c) - F.col(f"_b_{c}") for n, c in RESIDUALS.items()})
    x, past = F.col("sector_residual__resid_log_return_5d"), prior_n(60, by("symbol"))
    z = F.when(F.count(x).over(past) >= 20, (x - F.avg(x).over(past)) / nz(F.stddev_samp(x).over(past)))
    return out.withColumn("sector_residual__resid_zscore_60d", z).drop("benchmark", *[f"_b_{c}" for c in cols])

