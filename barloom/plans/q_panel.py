"""Queries over cross-sectional, regime, macro, sector, as-of and fundamental features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as f
from ..functions import panel_features as pf
from ..functions.windows import pct_rank, rounded
from ..operators import asof
from . import fixtures as fx
from .q_features import EWM_SQL, PRICE_SQL
from .shared import by_rows, written
from .sqlkit import P, pct_rank as sql_rank, r, rs, z

KEY = ["symbol", "bar_date"]


def wide(spark, d):
    """Bars with the columns that panel features need."""
    b = f.sequential(fx.bars(spark, d), ["rsi_14", "macd", "macd_signal"])
    b = f.price(b).withColumn("momentum__rsi_14", F.col("rsi_14")).withColumn("trend__macd_histogram", F.col("macd") - F.col("macd_signal"))
    v = F.col("volume")
    return b.withColumn("volume__volume_zscore_20", f.zscore(v, 20)).select(*KEY, "close", "price__log_return_1d", "price__log_return_5d", "price__log_return_20d", "price__realized_vol_20d", "momentum__rsi_14", "trend__macd_histogram", "volume__volume_zscore_20")


WIDE_SQL = f"""wide AS MATERIALIZED (SELECT symbol, bar_date, close, r1, r5, r20, CASE WHEN count(r1) OVER w = 20 THEN stddev_samp(r1) OVER w END AS rv20, rsi_14, macd - macd_signal AS hist, vz FROM
  (SELECT lr.*, em.rsi_14, em.macd, em.macd_signal, em.vz FROM lr JOIN (SELECT symbol, bar_date, rsi_14, macd, macd_signal, {z("volume", 20)} AS vz FROM em) em USING (symbol, bar_date))
  WINDOW w AS ({P} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


def wide_sql(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",".join([fx.BARS_SQL, EWM_SQL, PRICE_SQL, WIDE_SQL, *more]) + "\n" + select


def xs_ranks(spark, d):
    out = pf.cross_sectional(by_rows(written(wide(spark, d).select(*KEY, *pf.RANKED.values())), "bar_date"))
    return rounded(out.select(*KEY, *[c for c in out.columns if c.startswith("cross_sectional__")]))


def rg_regime(spark, d):
    return rounded(pf.regime_by_date(f.price(fx.bars(spark, d))))


def mc1_align(spark, d):
    return rounded(pf.align_series(fx.macro(spark, d), fx.SERIES))


def mc_features(spark, d):
    return rounded(pf.macro_features(fx.macro(spark, d), fx.SERIES))


def mc10_broadcast(spark, d):
    m = pf.macro_features(fx.macro(spark, d), fx.SERIES).select("bar_date", "macro__skew_level", "macro__vix9d_to_vix_ratio")
    return rounded(pf.with_macro(fx.bars(spark, d).select(*KEY, "close"), m), 9)


def ix_interactions(spark, d):
    p = pf.with_macro(wide(spark, d), pf.macro_features(fx.macro(spark, d), fx.SERIES))
    out = pf.interactions(p)
    return rounded(out.select(*KEY, *[f"interactions__{n}" for n in pf.PAIRS]), 4)


_IX = {"momentum__rsi_14": "rsi_14", "price__log_return_5d": "r5", "price__log_return_20d": "r20", "price__realized_vol_20d": "rv20", "trend__macd_histogram": "hist"}


def _mz(x):
    past = "(ORDER BY macro_date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"
    return f"(CASE WHEN count({x}) OVER {past} >= 63 THEN ({x} - avg({x}) OVER {past}) / nullif(stddev_samp({x}) OVER {past}, 0) END)"


def _mstep(x):
    return f"({x} - lag({x}, 5) OVER (ORDER BY macro_date))"


MC_EXPR = {f"macro__{n}_z_252": _mz(x) for n, x in {"vix_level": "vix", "treasury_10y": "t10y", "vvix": "vvix", "yield_curve_slope": "(t10y - t5y)", "credit_spread": "(lqd / nullif(hyg, 0))", "gold_copper_ratio": "(gold / nullif(copper, 0))"}.items()}
MC_EXPR |= {"macro__vix_chg_5d": _mstep("vix"), "macro__treasury_10y_chg_5d": _mstep("t10y"), "macro__skew_chg_5d": _mstep("skew"), "macro__credit_spread_chg_5d": _mstep("(lqd / nullif(hyg, 0))"), "macro__fx_ret_5d": _mstep("ln(fx)"), "macro__dxy_chg_5d": _mstep("ln(dxy)")}
MC_EXPR |= {"macro__vix9d_to_vix_ratio": "vix9d / nullif(vix, 0)", "macro__vix_to_vix3m_ratio": "vix / nullif(vix3m, 0)", "macro__skew_level": "skew"}
ALIGN_SQL = f"""
mwide AS (SELECT macro_date, {", ".join(f"max(value) FILTER (series = '{s}') AS {s}" for s in fx.SERIES)} FROM macro GROUP BY 1),
aligned AS MATERIALIZED (SELECT macro_date, {", ".join(f"last_value({s} IGNORE NULLS) OVER (ORDER BY macro_date ROWS UNBOUNDED PRECEDING) AS {s}" for s in fx.SERIES)} FROM mwide),
mfeat AS MATERIALIZED (SELECT macro_date AS bar_date, {", ".join(f"{e} AS {n}" for n, e in MC_EXPR.items())} FROM aligned)"""


LABELS = ["Technology", "Information Technology", "Financials", "Financial Services", "Communications Services", " Consumer Staples ", "Consumer Discretionary", "Materials", "UNKNOWN", "", None, "Something else"]


def sectors(spark, d):
    """(symbol, sector): the label numbered by the brand among twelve: names, other spellings, blank, null, no sector at all."""
    n = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    return fx.table(spark, d, "part").select(fx.symbol_of_part().alias("symbol"), F.element_at(F.array(*[F.lit(x) for x in LABELS]), n % 12 + 1).alias("sector")).distinct()


SECTORS_SQL = f"""sectors AS (SELECT DISTINCT {fx.SYMBOL_SQL} AS symbol,
  ['Technology', 'Information Technology', 'Financials', 'Financial Services', 'Communications Services', ' Consumer Staples ', 'Consumer Discretionary', 'Materials', 'UNKNOWN', '', NULL, 'Something else'][CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 12 + 1] AS sector FROM part)"""
_CANON = """CASE coalesce(trim(sector), '') WHEN '' THEN 'Unknown' WHEN 'Financials' THEN 'Financial Services' WHEN 'Information Technology' THEN 'Technology'
  WHEN 'Communications Services' THEN 'Communication Services' WHEN 'Consumer Staples' THEN 'Consumer Defensive' WHEN 'Consumer Discretionary' THEN 'Consumer Cyclical' WHEN 'Materials' THEN 'Basic Materials' ELSE trim(sector) END"""
_COLUMNS = {
    "communication_services": "Communication Services", "consumer_cyclical": "Consumer Cyclical", "consumer_defensive": "Consumer Defensive", "energy": "Energy", "financial_services": "Financial Services",
    "healthcare": "Healthcare", "industrials": "Industrials", "basic_materials": "Basic Materials", "real_estate": "Real Estate", "technology": "Technology", "utilities": "Utilities",
}
_FLAGS = {f"sector__is_{c}": f"CAST({_CANON} = '{s}' AS DOUBLE)" for c, s in _COLUMNS.items()}
_FLAGS["sector__is_unknown"] = f"CAST({_CANON} NOT IN ({', '.join(repr(s) for s in _COLUMNS.values())}) AS DOUBLE)"


def se_flags(spark, d):
    return pf.sector_flags(fx.bars(spark, d).select(*KEY), sectors(spark, d))


def se2_canonical(spark, d):
    return sectors(spark, d).select("symbol", "sector", pf.canonical_sector(F.col("sector")).alias("canonical"))


def benchmarks(spark, d):
    n = F.regexp_extract("symbol", "([0-9]+)", 1).cast("int")
    return sectors(spark, d).select("symbol", F.concat(F.lit("Brand#"), (n % 5 + 1).cast("string")).alias("benchmark"))


def sr5_etf(spark, d):
    """Benchmark features of the first five brands, by the sectors' funds."""
    return rounded(pf.etf_features(fx.bars(spark, d), [f"Brand#{i}" for i in range(1, 6)]))


def sr_residual(spark, d):
    rows = written(wide(spark, d).select(*KEY, *pf.RESIDUALS.values()))  # read for the symbols and for their benchmarks
    out = pf.sector_residual(by_rows(rows, "symbol"), benchmarks(spark, d))
    return rounded(out.select(*KEY, *[c for c in out.columns if c.startswith("sector_residual__")]), 5)


def ea_features(spark, d):
    b = by_rows(fx.bars(spark, d), "symbol")
    out = asof.earnings_features(b.select(*KEY), fx.announcements(spark, d, b))
    return rounded(out)


def sv_features(spark, d):
    b = by_rows(fx.bars(spark, d), "symbol")
    return rounded(asof.filing_features(b.select(*KEY), fx.filings(spark, d, b)))


def fu1_annual(spark, d):
    return rounded(asof.fundamentals_annual(fx.bars(spark, d).select(*KEY), fx.fundamentals(spark, d)), 10)


def fu2_ttm(spark, d):
    return rounded(asof.trailing_year(fx.fundamentals(spark, d)), 6)


def fu3_latest(spark, d):
    return rounded(asof.latest_values(fx.bars(spark, d).select(*KEY), fx.fundamentals(spark, d), ["Equity"]).withColumnRenamed("Equity", "value"), 6)


def _ttm(spark, d):
    return asof.fundamentals_ttm(fx.bars(spark, d).select(*KEY), fx.fundamentals(spark, d))


def fu4_ratios(spark, d):
    return rounded(_ttm(spark, d), 10)


def fu5_ranks(spark, d):
    out = _ttm(spark, d)
    names = [c for c in out.columns if c not in KEY]
    out = by_rows(written(rounded(out, 10)), "bar_date")
    return rounded(out.select(*KEY, *[pct_rank(c, "bar_date").alias(f"{c}_xs_rank") for c in names]))


_FUTTM = """
fq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, concept, period_end ORDER BY filed_date DESC, value DESC) AS k FROM fundamentals WHERE fp = 'Q') WHERE k = 1),
ttm AS MATERIALIZED (SELECT symbol, concept, filed_date, period_end, CASE WHEN count(value) OVER w = 4 THEN sum(value) OVER w END AS value FROM fq WINDOW w AS (PARTITION BY symbol, concept ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""


def _pick(table: str, concept: str, where: str = "") -> str:
    """CTE of ranked facts of a concept, to be joined as-of: one row per symbol and filing date."""
    return f"""f_{table}_{concept} AS MATERIALIZED (SELECT symbol, filed_date, value FROM (SELECT *, row_number() OVER (PARTITION BY symbol, filed_date ORDER BY period_end DESC NULLS LAST, value DESC NULLS LAST) AS kk FROM {table} WHERE concept = '{concept}'{where}) WHERE kk = 1)"""


def _fund_sql(tables: dict[str, tuple[str, str]], prefix: str, suffix: str, debt: str) -> str:
    parts = [_pick(t, c, w) for c, (t, w) in tables.items()]
    joins = " ".join(f"ASOF LEFT JOIN f_{t}_{c} {c} ON b.symbol = {c}.symbol AND b.bar_date >= {c}.filed_date" for c, (t, _) in tables.items())

    def div(a, b):
        return f"CASE WHEN {b}.value > 0 THEN {a}.value / {b}.value END"

    cols = {f"roe{suffix}": div("NetIncome", "Equity"), debt: div("Debt", "Equity"), f"gross_margin{suffix}": div("GrossProfit", "Revenue"), f"net_margin{suffix}": div("NetIncome", "Revenue"), f"asset_turnover{suffix}": div("Revenue", "Assets")}
    body = "ratios AS (SELECT b.symbol, b.bar_date, " + ", ".join(r(e, f"{prefix}__{n}", 10) for n, e in cols.items()) + f" FROM bars b {joins})"
    return ",".join([*parts, body]), [f"{prefix}__{n}" for n in cols]


_FY, _FY_COLS = _fund_sql({c: ("fundamentals", " AND fp = 'FY'") for c in asof.CONCEPTS}, "sec_fundamentals", "", "debt_to_equity")
_TT, _TT_COLS = _fund_sql({c: ("ttm" if c in ("NetIncome", "Revenue", "GrossProfit") else "fundamentals", "") for c in asof.CONCEPTS}, "sec_fundamentals_v2", "_ttm", "debt_to_equity")

def _sides(spark, d):
    """Line items and orders by a key of which one value holds a third of the rows of either side."""
    k = F.when(F.col("p") % 3 == 0, F.lit(0)).otherwise(1 + F.col("q") % 50).alias("k")
    items = fx.table(spark, d, "lineitem").withColumns({"p": F.col("l_partkey"), "q": F.col("l_suppkey")}).select(k, "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"))
    orders = fx.table(spark, d, "orders").withColumns({"p": F.col("o_custkey"), "q": F.col("o_custkey")}).select(k, F.to_date("o_orderdate").alias("o_day"), "o_orderkey", "o_totalprice")
    return items, orders


def aj0(spark, d):
    return asof.asof_last(*_sides(spark, d), ["k"], "day", "o_day", order=["o_orderkey"])


def aj1(spark, d):
    return asof.asof_next(*_sides(spark, d), ["k"], "day", "o_day", order=["o_orderkey"])


QUERIES = {
    "aj0_asof_last": aj0, "aj1_asof_next": aj1,
    "xs_ranks": xs_ranks, "rg_regime": rg_regime, "mc1_align_series": mc1_align, "mc_macro_features": mc_features, "mc10_broadcast_macro": mc10_broadcast, "ix_interactions": ix_interactions,
    "se1_sector_flags": se_flags, "se2_canonical_sector": se2_canonical, "sr_sector_residual": sr_residual, "sr5_etf_features": sr5_etf, "ea_earnings": ea_features, "sv_filings": sv_features, "fu1_fundamentals_annual": fu1_annual,
    "fu2_ttm": fu2_ttm, "fu3_latest_value": fu3_latest, "fu4_fundamentals_ttm": fu4_ratios, "fu5_fundamentals_ranks": fu5_ranks,
}
_SQLNAME = {"log_return_5d": "r5", "log_return_20d": "r20", "rsi_14": "rsi_14", "volume_zscore_20": "vz", "realized_vol_20d": "rv20"}
_D = "(ORDER BY bar_date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
_EIGHT = "(PARTITION BY symbol ORDER BY announce_date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)"
_SR = {"resid_log_return_5d": "r5", "resid_log_return_20d": "r20", "resid_realized_vol_20d": "rv20", "resid_rsi_14_minus_sector": "rsi_14"}
_PAST60 = "(PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
_SV = {"days_since_last_8k": ("form_type = '8-K'", 90), "days_since_last_8k_2_02": ("form_type = '8-K' AND list_contains(string_split(items, ','), '2.02')", 90), "days_since_last_8k_5_02": ("form_type = '8-K' AND list_contains(string_split(items, ','), '5.02')", 90), "days_since_last_10q": ("form_type = '10-Q'", 120), "days_since_last_10k": ("form_type = '10-K'", 400)}
_AJ = """WITH i AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 1 + l_suppkey % 50 END AS k, l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day FROM lineitem),
  o AS (SELECT CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 1 + o_custkey % 50 END AS k, CAST(o_orderdate AS DATE) AS o_day, arg_{0}(o_orderkey, o_orderkey) AS o_orderkey, arg_{0}(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2)
  SELECT i.*, o.o_day, o.o_orderkey, o.o_totalprice FROM i ASOF LEFT JOIN o ON i.k = o.k AND i.day {1} o.o_day"""
SQL = {
    "aj0_asof_last": _AJ.format("max", ">="), "aj1_asof_next": _AJ.format("min", "<"),
    "xs_ranks": wide_sql("SELECT symbol, bar_date, " + ", ".join(r(sql_rank(c, "bar_date"), f"cross_sectional__xs_rank_{n}") for n, c in _SQLNAME.items()) + ", " + r("(r5 - avg(r5) OVER d) / nullif(stddev_samp(r5) OVER d, 0)", "cross_sectional__xs_zscore_log_return_5d") + " FROM wide WINDOW d AS (PARTITION BY bar_date)"),
    "rg_regime": fx.sql(f"""SELECT bar_date, {rs(["regime__market_return_1d", "regime__market_breadth_advance_decline", "regime__market_dispersion_20d"])},
      {r(f"CASE WHEN count(regime__market_return_1d) OVER {_D.format(n=4)} = 5 THEN sum(regime__market_return_1d) OVER {_D.format(n=4)} END", "regime__market_return_5d")},
      {r(f"CASE WHEN count(regime__market_return_1d) OVER {_D.format(n=19)} = 20 THEN stddev_samp(regime__market_return_1d) OVER {_D.format(n=19)} END", "regime__market_realized_vol_20d")}
      FROM (SELECT bar_date, avg(r1) AS regime__market_return_1d, avg(CAST(coalesce(r1 > 0, false) AS DOUBLE)) AS regime__market_breadth_advance_decline, stddev_samp(r20) AS regime__market_dispersion_20d FROM lr GROUP BY 1)""", PRICE_SQL),
    "mc1_align_series": fx.sql(f"SELECT macro_date, {rs(fx.SERIES)} FROM aligned", fx.MACRO_SQL, ALIGN_SQL),
    "mc_macro_features": fx.sql(f"SELECT bar_date, {rs(list(MC_EXPR))} FROM mfeat", fx.MACRO_SQL, ALIGN_SQL),
    "mc10_broadcast_macro": fx.sql(f"SELECT symbol, bar_date, {rs(['close', 'macro__skew_level', 'macro__vix9d_to_vix_ratio'], 9)} FROM bars LEFT JOIN mfeat USING (bar_date)", fx.MACRO_SQL, ALIGN_SQL),
    "ix_interactions": wide_sql("SELECT symbol, bar_date, " + ", ".join(r(f"{_IX[a]} * {b}", f"interactions__{n}", 4) for n, (a, b) in pf.PAIRS.items()) + " FROM wide LEFT JOIN mfeat USING (bar_date)", fx.MACRO_SQL, ALIGN_SQL),
    "se1_sector_flags": fx.sql("SELECT symbol, bar_date, " + ", ".join(f"{e} AS {n}" for n, e in _FLAGS.items()) + " FROM bars LEFT JOIN sectors USING (symbol)", SECTORS_SQL),
    "se2_canonical_sector": f"WITH {SECTORS_SQL} SELECT symbol, sector, {_CANON} AS canonical FROM sectors",
    "sr_sector_residual": wide_sql("SELECT symbol, bar_date, " + rs([f"sector_residual__{n}" for n in _SR], 5) + ", " + r(f"CASE WHEN count(sector_residual__resid_log_return_5d) OVER {_PAST60} >= 20 THEN (sector_residual__resid_log_return_5d - avg(sector_residual__resid_log_return_5d) OVER {_PAST60}) / nullif(stddev_samp(sector_residual__resid_log_return_5d) OVER {_PAST60}, 0) END", "sector_residual__resid_zscore_60d", 5) + " FROM res",
      "res AS (SELECT a.symbol, a.bar_date, " + ", ".join(f"a.{c} - b.{c} AS sector_residual__{n}" for n, c in _SR.items()) + " FROM wide a LEFT JOIN wide b ON b.symbol = 'Brand#' || (CAST(regexp_extract(a.symbol, '([0-9]+)', 1) AS INT) % 5 + 1) AND a.bar_date = b.bar_date)"),
    "sr5_etf_features": wide_sql("SELECT symbol AS benchmark, bar_date, " + ", ".join(r(c, n) for n, c in {"etf_log_return_5d": "r5", "etf_log_return_20d": "r20", "etf_realized_vol_20d": "rv20", "etf_rsi_14": "rsi_14"}.items()) + " FROM wide WHERE symbol IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5')"),
    "ea_earnings": fx.sql(f"""SELECT b.symbol, b.bar_date, CASE WHEN b.bar_date - p.announce_date <= 90 THEN CAST(b.bar_date - p.announce_date AS DOUBLE) END AS earnings__days_since_last_earnings,
      CASE WHEN n.announce_date - b.bar_date <= 60 THEN CAST(n.announce_date - b.bar_date AS DOUBLE) END AS earnings__days_to_next_earnings, {r("p.surprise_pct", "earnings__last_surprise_pct")}, {r("p.z", "earnings__last_surprise_z_252")}
      FROM bars b ASOF LEFT JOIN ev p ON b.symbol = p.symbol AND b.bar_date >= p.announce_date ASOF LEFT JOIN ev n ON b.symbol = n.symbol AND b.bar_date < n.announce_date""", fx.NUMBERED_SQL, fx.ANNOUNCE_SQL,
      f"ev AS MATERIALIZED (SELECT *, CASE WHEN count(surprise_pct) OVER {_EIGHT} >= 4 AND stddev_samp(surprise_pct) OVER {_EIGHT} > 0 THEN (surprise_pct - avg(surprise_pct) OVER {_EIGHT}) / stddev_samp(surprise_pct) OVER {_EIGHT} END AS z FROM announcements)"),
    "sv_filings": fx.sql("SELECT b.symbol, b.bar_date, " + ", ".join(f"CASE WHEN b.bar_date - {n}.filing_date <= {cap} THEN CAST(b.bar_date - {n}.filing_date AS DOUBLE) END AS sec_events__{n}" for n, (_, cap) in _SV.items()) + ", CAST((SELECT count(*) FROM filings x WHERE x.symbol = b.symbol AND x.form_type = '8-K' AND x.filing_date <= b.bar_date AND x.filing_date > b.bar_date - 30) AS DOUBLE) AS sec_events__count_8k_last_30d FROM bars b " + " ".join(f"ASOF LEFT JOIN (SELECT * FROM filings WHERE {w}) {n} ON b.symbol = {n}.symbol AND b.bar_date >= {n}.filing_date" for n, (w, _) in _SV.items()), fx.NUMBERED_SQL, fx.FILINGS_SQL),
    "fu1_fundamentals_annual": fx.sql("SELECT * FROM ratios", fx.FUNDAMENTALS_SQL, _FY),
    "fu2_ttm": fx.sql(f"SELECT symbol, concept, filed_date, period_end, {r('value', 'value')} FROM ttm", fx.FUNDAMENTALS_SQL, _FUTTM),
    "fu3_latest_value": fx.sql(f"SELECT b.symbol, b.bar_date, {r('q.value', 'value')} FROM bars b ASOF LEFT JOIN f_fundamentals_Equity q ON b.symbol = q.symbol AND b.bar_date >= q.filed_date", fx.FUNDAMENTALS_SQL, _pick("fundamentals", "Equity")),
    "fu4_fundamentals_ttm": fx.sql("SELECT * FROM ratios", fx.FUNDAMENTALS_SQL, _FUTTM, _TT),
    "fu5_fundamentals_ranks": fx.sql("SELECT symbol, bar_date, " + ", ".join(r(sql_rank(c, "bar_date"), f"{c}_xs_rank") for c in _TT_COLS) + " FROM ratios", fx.FUNDAMENTALS_SQL, _FUTTM, _TT),
}
