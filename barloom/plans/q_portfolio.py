"""Queries over portfolio analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import features as f
from ..functions.windows import rounded
from ..operators import portfolio as pf
from ..operators import predictions as pr
from . import fixtures as fx
from .q_features import PRICE_SQL, ewm_sql, full
from .shared import written
from .sqlkit import lag, last_n, r, rs

DAY = "1999-06-30"


def rets(spark, d):
    return f.price(fx.bars(spark, d)).groupBy("bar_date").agg((F.avg("price__log_return_1d") * 0.02).alias("ret"))


def equity(spark, d):
    return pf.equity_curve(rets(spark, d), start=1000.0)


def bench(spark, d):
    return fx.bars(spark, d).filter("symbol = 'Brand#1'")


def daily(spark, d):
    return pf.month_daily(equity(spark, d), bench(spark, d))


def years(spark, d):
    return pf.per_year(equity(spark, d))


def num():
    return F.regexp_extract("symbol", "([0-9]+)", 1).cast("int")


def lots(spark, d):
    """The best five of a date by conviction: (symbol, as_of, bar_date, score, weight, qty, price, side)."""
    w = Window.partitionBy("as_of").orderBy(F.desc("score"), "symbol")
    b = fx.bars(spark, d)
    p = fx.predictions(spark, d, b).withColumn("score", pr.conviction()).withColumn("k", F.row_number().over(w)).filter("k <= 5")
    b = b.select("symbol", F.col("bar_date").alias("as_of"), F.col("close").alias("price"))
    j = p.join(b, ["symbol", "as_of"]).withColumns({"weight": 1.0 / F.col("k"), "qty": (1 + num() % 4).cast("long"), "side": F.when(num() % 5 == 0, "short").otherwise("long"), "bar_date": F.col("as_of")})
    return j.select("symbol", "as_of", "bar_date", "score", "weight", "qty", "price", "side")


def open_lots(spark, d):
    x = lots(spark, d).filter("dayofmonth(as_of) % 3 = 0")
    return x.select("symbol", "side", "qty", F.col("price").alias("entry_price"), F.col("as_of").alias("entry_date"), F.when(F.col("qty") > 1, F.col("price") * 0.9).alias("stop"))


def trades(spark, d):
    """An opening row per lot, and a closing row nine days later for those of even days."""
    x = written(lots(spark, d).select(F.concat("symbol", F.lit("-"), F.date_format("as_of", "yyyyMMdd")).alias("lot_id"), "symbol", "as_of", "price", "qty"))  # read for openings, closings and their pairs
    o = x.select("lot_id", "symbol", F.lit("open").alias("kind"), F.col("as_of").alias("trade_date"), "price", F.lit(None).cast("double").alias("pnl"))
    c = x.filter("dayofmonth(as_of) % 2 = 0").select("lot_id", "symbol", F.lit("close").alias("kind"), F.date_add("as_of", 9).alias("trade_date"), (F.col("price") * 1.01).alias("price"), (F.col("price") * 0.01 * F.col("qty")).alias("pnl"))
    return o.unionByName(c)


def fills(spark, d):
    x = lots(spark, d).select(F.col("as_of").alias("trade_date"), "symbol", F.when(F.col("side") == "long", "buy").otherwise("sell").alias("side"), "price", "qty")
    return x.withColumns({"price": F.col("price") * (1 + (num() % 3 - 1) * 0.0005), "fee": F.col("qty") * 0.01}).filter(num() % 7 != 1), x.select("trade_date", "symbol", "side", "price")


def q(fn, digits=6):
    return lambda spark, d: rounded(fn(spark, d), digits)


def ratios(s, d):
    return rets(s, d).agg(pf.sharpe("ret").alias("sharpe"), pf.sortino("ret").alias("sortino"), pf.sortino_sample("ret").alias("sortino_sample"))


def pf38(s, d):
    return pf.retrain_pace(fx.table(s, d, "events").filter("event_type = 'signup'").select(F.to_date("ts").alias("done_at")).union(fx.table(s, d, "orders").select(F.to_date("o_orderdate"))))


def pf39(s, d):
    o = fx.table(s, d, "orders").withColumn("dec", F.when(F.col("o_orderstatus") == "F", "promote").otherwise("retain"))
    line = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" gate="), F.col("dec"), F.lit(" ic=0."), (F.col("o_orderkey") % 100 + 100).cast("string"), F.lit(" key "), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    return pf.gate_decisions(o.select(line.alias("line")))


def pf43(s, d):
    return pf.latest_snapshot(bench(s, d).select(F.trunc("bar_date", "month").alias("snapshot_at"), "bar_date", F.when(F.dayofmonth("bar_date") % 2 == 0, F.col("close")).alias("value")), "snapshot_at", "value")


def pf44(s, d):
    sig = lots(s, d).select("symbol", F.col("as_of").alias("signal_date"), F.when(F.col("qty") == 1, "CLOSED").otherwise("OPEN").alias("state"))
    o = fx.table(s, d, "orders").join(fx.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("signal_date"), F.when(F.col("o_orderstatus") == "F", "filled").otherwise("open").alias("status"), F.col("o_orderkey").alias("order_id"))
    return pf.close_filled_signals(sig, o)


QUERIES = {
    "pf1_long_short": q(lambda s, d: pf.long_short_returns(fx.predictions(s, d), least=5, share=0.2)), "pf2_forward_simple_return": q(lambda s, d: pf.forward_simple_return(bench(s, d)).select("symbol", "bar_date", "fwd")),
    "pf3_equity_curve": q(equity, 4), "pf4_5_ratios": q(ratios), "pf6_max_drawdown": q(lambda s, d: pf.drawdowns(equity(s, d)).agg(F.max("drawdown").alias("max_drawdown"))), "pf7_per_year_metrics": q(years),
    "pf8_10_benchmark_in_windows": q(lambda s, d: pf.benchmark_in_windows(bench(s, d), years(s, d)), 8), "pf9_benchmark_calendar_year": q(lambda s, d: pf.calendar_year(bench(s, d))), "pf11_monthly_excess": q(lambda s, d: pf.monthly_excess(equity(s, d), bench(s, d))),
    "pf12_month_daily": q(daily), "pf13_month_risk": q(lambda s, d: pf.month_risk(daily(s, d), equity(s, d))), "pf14_best_worst_days": q(lambda s, d: pf.best_worst_days(daily(s, d))), "pf15_top_holdings": q(lambda s, d: pf.top_holdings(lots(s, d))),
    "pf16_tax_annual": q(lambda s, d: pf.tax_annual(years(s, d), 0.25).select("year", "ret", "net", "equity")), "pf17_tax_deferred": q(lambda s, d: pf.tax_deferred(years(s, d), 0.25).select("year", "ret", "equity", "after_tax")),
    "pf18_tax_gain_only": q(lambda s, d: pf.tax_gain_only(years(s, d), 0.25).select("year", "ret", "net", "multiple")), "pf19_post_tax_curve": q(lambda s, d: pf.post_tax_curve(equity(s, d), years(s, d), 0.25).select("bar_date", "equity", "post_tax"), 4),
    "pf20_rebased_benchmark": q(lambda s, d: pf.rebased_benchmark(equity(s, d), bench(s, d)), 4), "pf21_outperformance": q(lambda s, d: pf.outperformance(pf.rebased_benchmark(equity(s, d), bench(s, d))), 4),
    "pf22_slice_weights": q(lambda s, d: pf.slice_weights(lots(s, d).drop("weight")).select("symbol", "as_of", "weight")), "pf23_prior_support": q(lambda s, d: pf.prior_support(fx.bars(s, d)).select("symbol", "bar_date", "stop"), 9),
    "pf24_simple_atr": q(lambda s, d: pf.simple_atr(fx.bars(s, d)).select("symbol", "bar_date", "simple_atr")), "pf25_seeded_atr": q(lambda s, d: f.sequential(fx.bars(s, d), ["seeded_atr"]).select("symbol", "bar_date", "seeded_atr")),
    "pf26_gap_support": q(lambda s, d: pf.bullish_gap_support(fx.bars(s, d)).select("symbol", "bar_date", "gap_support"), 9), "pf27_costs": q(lambda s, d: pf.cost_columns(lots(s, d)).select("symbol", "as_of", "flat_open", "flat_close", "capped_open", "capped_close"), 9),
    "pf28_lot_outcomes": q(lambda s, d: pf.lot_outcomes(lots(s, d).select("symbol", "as_of"), fx.bars(s, d)), 9), "pf29_overlapping_returns": q(lambda s, d: pf.overlapping_returns(lots(s, d).select("symbol", "as_of", "weight"), fx.bars(s, d))),
    "pf30_next_day_picks": q(lambda s, d: pf.next_day_picks(fx.predictions(s, d), fx.bars(s, d)), 9), "pf31_position_rollup": q(lambda s, d: pf.position_rollup(open_lots(s, d), pf.last_close(fx.bars(s, d), DAY)), 4),
    "pf32_realized_since_entry": q(lambda s, d: pf.realized_since_entry(trades(s, d), pf.position_rollup(open_lots(s, d), pf.last_close(fx.bars(s, d), DAY)).filter("side = 'long'")), 4),
    "pf33_planned_exit": lambda s, d: pf.planned_exit(open_lots(s, d).select("symbol", "entry_date"), bench(s, d), 5), "pf34_fill_slippage": q(lambda s, d: pf.fill_slippage(*fills(s, d)), 8), "pf35_slippage_summary": q(lambda s, d: pf.slippage_summary(rounded(pf.fill_slippage(*fills(s, d)), 4))),
    "pf36_regime_band_v1": q(lambda s, d: pf.regime_band_v1(fx.bars(s, d)).select("symbol", "bar_date", "z", "multiplier")), "pf37_regime_band_v2": lambda s, d: pf.regime_band_v2(fx.bars(s, d), fx.macro(s, d).filter("series = 'vix'"), 250000.0).select("symbol", "bar_date", "alarms", "multiplier"),
    "pf38_retrain_pace": q(pf38), "pf39_gate_decisions": pf39, "pf40_trade_pairs": q(lambda s, d: pf.trade_pairs(trades(s, d)), 8), "pf41_last_close": lambda s, d: pf.last_close(fx.bars(s, d), DAY), "pf42_strategy_summary": q(lambda s, d: pf.strategy_summary(equity(s, d), bench(s, d), 0.25)),
    "pf43_latest_snapshot": pf43, "pf44_close_filled_signals": pf44,
}

EQ = [PRICE_SQL, "rt AS (SELECT bar_date, avg(r1) * 0.02 AS ret FROM lr GROUP BY 1), eq AS MATERIALIZED (SELECT *, 1000 * exp(sum(ln(1 + coalesce(ret, 0))) OVER (ORDER BY bar_date)) AS equity FROM rt), bench AS (SELECT * FROM bars WHERE symbol = 'Brand#1')"]
SHARPE = "CASE WHEN count({0}) >= {1} THEN avg({0}) / nullif(stddev_samp({0}), 0) * sqrt(252) END"
YEARS = f"""ye AS (SELECT *, year(bar_date) AS year, equity / lag(equity) OVER (PARTITION BY year(bar_date) ORDER BY bar_date) - 1 AS dr, 1 - equity / max(equity) OVER (PARTITION BY year(bar_date) ORDER BY bar_date) AS dd FROM eq),
years AS MATERIALIZED (SELECT year, arg_max(equity, bar_date) / arg_min(equity, bar_date) - 1 AS ret, {SHARPE.format("dr", 5)} AS sharpe, max(dd) AS max_drawdown, count(*) AS n_days, min(bar_date) AS first_date, max(bar_date) AS last_date FROM ye GROUP BY 1),
gain AS (SELECT *, CASE WHEN month(last_date) = 12 AND day(last_date) >= 28 AND ret > 0 THEN ret * 0.75 ELSE ret END AS net FROM years), multi AS (SELECT *, exp(sum(ln(1 + net)) OVER (ORDER BY year)) AS multiple FROM gain)"""
DAILY = "dl AS MATERIALIZED (SELECT s.bar_date, strategy, benchmark, strategy - benchmark AS excess FROM (SELECT bar_date, equity / lag(equity) OVER (ORDER BY bar_date) - 1 AS strategy FROM eq) s LEFT JOIN (SELECT bar_date, close / lag(close) OVER (ORDER BY bar_date) - 1 AS benchmark FROM bench) b USING (bar_date))"
_N = "CAST(regexp_extract(symbol, '([0-9]+)', 1) AS INT)"
LOTS = f"""lots AS MATERIALIZED (SELECT p.symbol, as_of, as_of AS bar_date, score, 1.0::DOUBLE / k AS weight, CAST(1 + {_N.replace('symbol', 'p.symbol')} % 4 AS BIGINT) AS qty, close AS price, CASE WHEN {_N.replace('symbol', 'p.symbol')} % 5 = 0 THEN 'short' ELSE 'long' END AS side FROM
  (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY score DESC, symbol) AS k FROM (SELECT *, predicted_return * (1 + top_p - bot_p) AS score FROM predictions)) p JOIN bars b ON p.symbol = b.symbol AND p.as_of = b.bar_date WHERE k <= 5),
open_lots AS (SELECT symbol, side, qty, price AS entry_price, as_of AS entry_date, CASE WHEN qty > 1 THEN price * 0.9 END AS stop FROM lots WHERE day(as_of) % 3 = 0),
tr0 AS (SELECT symbol || '-' || strftime(as_of, '%Y%m%d') AS lot_id, symbol, as_of, price, qty FROM lots),
trade_log AS (SELECT lot_id, symbol, 'open' AS kind, as_of AS trade_date, price, CAST(NULL AS DOUBLE) AS pnl FROM tr0 UNION ALL SELECT lot_id, symbol, 'close', as_of + 9, price * 1.01, price * 0.01 * qty FROM tr0 WHERE day(as_of) % 2 = 0),
lc AS (SELECT symbol, arg_max(close, bar_date) AS close, max(bar_date) AS as_of FROM bars WHERE bar_date <= DATE '{DAY}' GROUP BY 1),
roll AS (SELECT g.*, lc.close AS last_close, CASE side WHEN 'long' THEN 1 ELSE -1 END * qty * (lc.close - entry) AS unrealised FROM (SELECT symbol, side, CAST(sum(qty) AS BIGINT) AS qty, sum(qty * entry_price) / sum(qty) AS entry, min(entry_date) AS first_entry, max(entry_date) AS last_entry, max(stop) AS stop, count(*) AS n_lots FROM open_lots GROUP BY 1, 2) g LEFT JOIN lc USING (symbol)),
sim AS (SELECT as_of AS trade_date, symbol, CASE side WHEN 'long' THEN 'buy' ELSE 'sell' END AS side, price AS sim_price, qty FROM lots),
slip AS (SELECT trade_date, symbol, side, price, qty, fee, sim_price, CASE side WHEN 'buy' THEN 1 ELSE -1 END * (price - sim_price) / sim_price * 1e4 AS slip_bps, fee / (price * qty) * 1e4 AS fee_bps FROM (SELECT *, sim_price * (1 + ({_N} % 3 - 1) * 0.0005::DOUBLE) AS price, qty * 0.01::DOUBLE AS fee FROM sim WHERE {_N} % 7 <> 1))"""
L = [fx.PREDICTIONS_SQL, LOTS]
STOP = "(min(low) OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) * 0.99)"
SUPPORT = f"sup AS MATERIALIZED (SELECT *, CASE WHEN {STOP} < open THEN {STOP} END AS stop, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) AS i FROM bars)"
TR = f"trs AS (SELECT *, CASE WHEN {lag('close')} IS NOT NULL THEN greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END AS t FROM bars), atr AS (SELECT *, avg(t) OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS simple_atr FROM trs)"
_Z = f"(close - {full('avg', 'close', 50)}) / nullif(close * {full('stddev_samp', 'r1', 20)} * sqrt(50), 0)"
SQL = {
    "pf1_long_short": fx.sql(f"""SELECT as_of, max(n) AS n, {r("avg(realized_return) FILTER (t <= k) - avg(realized_return) FILTER (b <= k)", "ret")} FROM (SELECT *, greatest(1, round_even(0.2 * n, 0)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY as_of) AS n,
      row_number() OVER (PARTITION BY as_of ORDER BY predicted_return DESC, symbol) AS t, row_number() OVER (PARTITION BY as_of ORDER BY predicted_return, symbol) AS b FROM predictions WHERE realized_return IS NOT NULL) WHERE n >= 5) GROUP BY 1""", fx.PREDICTIONS_SQL),
    "pf2_forward_simple_return": fx.sql(f"SELECT symbol, bar_date, {r('lead(close, 5) OVER (ORDER BY bar_date) / close - 1', 'fwd')} FROM bench", *EQ), "pf3_equity_curve": fx.sql(f"SELECT bar_date, {rs(['ret', 'equity'], 4)} FROM eq", *EQ),
    "pf4_5_ratios": fx.sql(f"SELECT {r(SHARPE.format('ret', 5), 'sharpe')}, {r('avg(ret) / sqrt(avg(pow(least(ret, 0), 2)) FILTER (ret IS NOT NULL)) * sqrt(252)', 'sortino')}, {r('avg(ret) / stddev_samp(ret) FILTER (ret < 0) * sqrt(252)', 'sortino_sample')} FROM rt", *EQ),
    "pf6_max_drawdown": fx.sql(f"SELECT {r('max(dd)', 'max_drawdown')} FROM (SELECT 1 - equity / max(equity) OVER (ORDER BY bar_date) AS dd FROM eq)", *EQ), "pf7_per_year_metrics": fx.sql(f"SELECT year, {rs(['ret', 'sharpe', 'max_drawdown'])}, n_days, first_date, last_date FROM years", *EQ, YEARS),
    "pf8_10_benchmark_in_windows": fx.sql(f"SELECT year, {r('arg_max(close, bar_date) / arg_min(close, bar_date) - 1', 'ret', 8)}, {r('max(dd)', 'max_drawdown', 8)}, {r('max(high)', 'peak', 8)} FROM (SELECT b.*, y.year, 1 - close / max(close) OVER (PARTITION BY y.year ORDER BY bar_date) AS dd FROM bench b JOIN years y ON year(b.bar_date) = y.year AND bar_date BETWEEN first_date AND last_date) GROUP BY 1", *EQ, YEARS),
    "pf9_benchmark_calendar_year": fx.sql(f"SELECT year(bar_date) AS year, {r('arg_max(close, bar_date) / arg_min(close, bar_date) - 1', 'ret')} FROM bench GROUP BY 1", *EQ),
    "pf11_monthly_excess": fx.sql(f"SELECT month, {rs(['strategy', 'benchmark'])}, {r('strategy - benchmark', 'excess')} FROM (SELECT CAST(date_trunc('month', bar_date) AS DATE) AS month, arg_max(equity, bar_date) / arg_min(equity, bar_date) - 1 AS strategy FROM eq GROUP BY 1) LEFT JOIN (SELECT CAST(date_trunc('month', bar_date) AS DATE) AS month, arg_max(close, bar_date) / arg_min(close, bar_date) - 1 AS benchmark FROM bench GROUP BY 1) USING (month)", *EQ),
    "pf12_month_daily": fx.sql(f"SELECT bar_date, {rs(['strategy', 'benchmark', 'excess'])} FROM dl", *EQ, DAILY),
    "pf13_month_risk": fx.sql(f"SELECT month, {r(SHARPE.format('strategy', 3), 'sharpe')}, {r('stddev_samp(strategy) * sqrt(252)', 'volatility')}, {r('max(dd)', 'max_drawdown')} FROM (SELECT CAST(date_trunc('month', bar_date) AS DATE) AS month, strategy, 1 - equity / max(equity) OVER (PARTITION BY date_trunc('month', bar_date) ORDER BY bar_date) AS dd FROM dl JOIN eq USING (bar_date)) GROUP BY 1", *EQ, DAILY),
    "pf14_best_worst_days": fx.sql(f"SELECT bar_date, {r('excess', 'excess')}, kind FROM ((SELECT *, 'best' AS kind FROM dl WHERE excess IS NOT NULL ORDER BY excess DESC, bar_date LIMIT 3) UNION ALL (SELECT *, 'worst' FROM dl WHERE excess IS NOT NULL ORDER BY excess, bar_date LIMIT 3))", *EQ, DAILY),
    "pf15_top_holdings": fx.sql(f"SELECT symbol, days_held, {r('w', 'avg_weight')} FROM (SELECT symbol, count(*) AS days_held, avg(w) AS w FROM (SELECT symbol, bar_date, sum(weight) AS w FROM lots GROUP BY 1, 2) GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10)", *L),
    "pf16_tax_annual": fx.sql(f"SELECT year, {r('ret', 'ret')}, {r('ret * 0.75', 'net')}, {r('exp(sum(ln(1 + ret * 0.75)) OVER (ORDER BY year))', 'equity')} FROM years", *EQ, YEARS),
    "pf17_tax_deferred": fx.sql(f"SELECT year, {r('ret', 'ret')}, {r('e', 'equity')}, {r('1 + (e - 1) * 0.75', 'after_tax')} FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY year)) AS e FROM years)", *EQ, YEARS),
    "pf18_tax_gain_only": fx.sql(f"SELECT year, {rs(['ret', 'net', 'multiple'])} FROM multi", *EQ, YEARS),
    "pf19_post_tax_curve": fx.sql(f"SELECT bar_date, {r('equity', 'equity', 4)}, {r('equity * f', 'post_tax', 4)} FROM eq JOIN (SELECT year, exp(coalesce(sum(ln((1 + net) / (1 + ret))) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS f FROM gain) ON year(bar_date) = year", *EQ, YEARS),
    **{k: fx.sql(s, *EQ, "fil AS (SELECT bar_date, equity, last_value(close IGNORE NULLS) OVER (ORDER BY bar_date) AS c FROM eq FULL JOIN (SELECT bar_date, close FROM bench) USING (bar_date)), c0 AS (SELECT arg_min(c, bar_date) AS c0, first(equity ORDER BY bar_date) AS e0 FROM fil WHERE equity IS NOT NULL), rb AS (SELECT bar_date, equity, c / c0 * e0 AS benchmark FROM fil, c0 WHERE equity IS NOT NULL)") for k, s in {
        "pf20_rebased_benchmark": f"SELECT bar_date, {rs(['equity', 'benchmark'], 4)} FROM rb", "pf21_outperformance": f"SELECT {r('e', 'strategy', 4)}, {r('b', 'benchmark', 4)}, {r('e / b', 'ratio', 4)} FROM (SELECT arg_max(equity, bar_date) AS e, last(benchmark ORDER BY bar_date) AS b FROM rb)"}.items()},
    "pf22_slice_weights": fx.sql(f"SELECT symbol, as_of, {r('CASE WHEN sum(greatest(score, 0)) OVER w > 0 THEN greatest(score, 0) / sum(greatest(score, 0)) OVER w ELSE 1 / count(*) OVER w END', 'weight')} FROM lots WINDOW w AS (PARTITION BY as_of)", *L),
    "pf23_prior_support": fx.sql(f"SELECT symbol, bar_date, {r('stop', 'stop', 9)} FROM sup", SUPPORT), "pf24_simple_atr": fx.sql(f"SELECT symbol, bar_date, {r('simple_atr', 'simple_atr')} FROM atr", TR),
    "pf25_seeded_atr": ewm_sql(f"SELECT ex.symbol, ex.bar_date, {r('y', 'seeded_atr')} FROM ex LEFT JOIN sd USING (symbol, rn)", "sd AS (SELECT symbol, CAST(14 AS BIGINT) AS rn, avg(tr) AS y FROM ex WHERE rn <= 14 GROUP BY 1 UNION ALL SELECT x.symbol, x.rn, (sd.y * 13 + x.tr) / 14 FROM sd JOIN ex x ON x.symbol = sd.symbol AND x.rn = sd.rn + 1)"),
    "pf26_gap_support": fx.sql(f"""SELECT b.symbol, b.bar_date, {r("(SELECT max(g.low) FROM gp g WHERE g.symbol = b.symbol AND g.rn BETWEEN b.rn - 19 AND b.rn AND g.bottom < g.low AND g.low <= b.close AND (b.close - g.low) / b.close <= 0.5 AND NOT EXISTS (SELECT 1 FROM gp t WHERE t.symbol = b.symbol AND t.rn > g.rn AND t.rn <= b.rn AND t.low <= g.low))", "gap_support", 9)} FROM gp b""", fx.NUMBERED_SQL, "gp AS MATERIALIZED (SELECT *, lag(high, 2) OVER (PARTITION BY symbol ORDER BY bar_date) AS bottom FROM nb)"),
    "pf27_costs": fx.sql(f"SELECT symbol, as_of, {r('qty * price * 5.0 / 1e4 + 1.0', 'flat_open', 9)}, {r('qty * price * 5.0 / 1e4 + 1.0', 'flat_close', 9)}, {r('least(qty * price * 5.0 / 1e4, 20.0)', 'capped_open', 9)}, {r('least(qty * price * 5.0 / 1e4, 20.0) + qty * price * 10.0 / 1e4', 'capped_close', 9)} FROM lots", *L),
    "pf28_lot_outcomes": fx.sql(f"""SELECT symbol, as_of, {r('entry', 'entry', 9)}, {r('stop', 'stop', 9)}, {r('coalesce(sc, ex)', 'exit', 9)}, CASE WHEN h IS NOT NULL THEN 'stop' ELSE 'expiry' END AS reason, CAST(coalesce(h, 5) AS INT) AS days, {r('coalesce(sc, ex) / entry - 1 - 0.002', 'ret', 9)} FROM
      (SELECT l.symbol, l.as_of, e.open AS entry, e.stop AS stop, x.open AS ex, (SELECT min(k.i - e.i) FROM sup k WHERE k.symbol = l.symbol AND k.i BETWEEN e.i AND e.i + 4 AND k.close <= e.stop) AS h,
      (SELECT arg_min(k.close, k.i) FROM sup k WHERE k.symbol = l.symbol AND k.i BETWEEN e.i AND e.i + 4 AND k.close <= e.stop) AS sc
      FROM lots l JOIN sup s ON s.symbol = l.symbol AND s.bar_date = l.as_of JOIN sup e ON e.symbol = l.symbol AND e.i = s.i + 1 JOIN sup x ON x.symbol = l.symbol AND x.i = s.i + 6)""", *L, SUPPORT),
    "pf29_overlapping_returns": fx.sql(f"SELECT b.bar_date, count(*) AS n_lots, {r('sum(weight * b.dr) / 5', 'ret')} FROM lots l JOIN rr s ON s.symbol = l.symbol AND s.bar_date = l.as_of JOIN rr b ON b.symbol = l.symbol AND b.rn BETWEEN s.rn + 1 AND s.rn + 5 GROUP BY 1", *L, fx.NUMBERED_SQL, f"rr AS (SELECT *, close / {lag('close')} - 1 AS dr FROM nb)"),
    "pf30_next_day_picks": fx.sql(f"""SELECT symbol, as_of, {r('score', 'score', 9)}, k, {r('close', 'close', 9)}, {r('stop', 'stop', 9)}, {r('simple_atr', 'simple_atr', 9)}, {r('weight', 'weight', 9)}, qty, {r('qty * close', 'notional', 9)}, coalesce(close < stop, false) AS broken_support FROM
      (SELECT *, CAST(greatest(1, floor(weight * 10000.0 / close)) AS BIGINT) AS qty FROM (SELECT *, CASE WHEN sum(w0) OVER w > 0 THEN w0 / sum(w0) OVER w ELSE 1 / count(*) OVER w END AS weight FROM (SELECT *, CASE WHEN simple_atr > 0 THEN greatest(score, 0) / simple_atr ELSE greatest(score, 0) END AS w0 FROM
      (SELECT l.symbol, l.as_of, score, CAST(row_number() OVER (PARTITION BY l.as_of ORDER BY score DESC, l.symbol) AS INT) AS k, s.close, s.stop, a.simple_atr FROM lots l JOIN sup s ON s.symbol = l.symbol AND s.bar_date = l.as_of JOIN atr a ON a.symbol = l.symbol AND a.bar_date = l.as_of)) WINDOW w AS (PARTITION BY as_of)))""", *L, SUPPORT, TR),
    "pf31_position_rollup": fx.sql(f"SELECT symbol, side, qty, {r('entry', 'entry', 4)}, first_entry, last_entry, {r('stop', 'stop', 4)}, n_lots, {r('last_close', 'last_close', 4)}, {r('unrealised', 'unrealised', 4)} FROM roll", *L),
    "pf32_realized_since_entry": fx.sql(f"SELECT p.symbol, {r('coalesce(sum(pnl) FILTER (trade_date >= first_entry), 0)', 'realized', 4)} FROM roll p LEFT JOIN (SELECT * FROM trade_log WHERE kind = 'close') t USING (symbol) WHERE side = 'long' GROUP BY 1", *L),
    "pf33_planned_exit": fx.sql("SELECT o.symbol, o.entry_date, planned_exit FROM open_lots o LEFT JOIN (SELECT bar_date, lead(bar_date, 5) OVER (ORDER BY bar_date) AS planned_exit FROM bars WHERE symbol = 'Brand#1') c ON c.bar_date = o.entry_date", *L),
    "pf34_fill_slippage": fx.sql(f"SELECT trade_date, symbol, side, {r('price', 'price', 8)}, qty, {r('fee', 'fee', 8)}, {r('sim_price', 'sim_price', 8)}, {r('slip_bps', 'slip_bps', 8)}, {r('fee_bps', 'fee_bps', 8)} FROM slip", *L),
    "pf35_slippage_summary": fx.sql(f"SELECT count(*) AS n, {r('avg(round(slip_bps, 4))', 'mean_bps')}, {r('quantile_disc(round(slip_bps, 4) + 0.0, 0.5 ORDER BY round(slip_bps, 4) DESC)', 'upper_median_bps')}, {r('sum(fee)', 'total_fee')} FROM slip", *L),
    "pf36_regime_band_v1": fx.sql(f"SELECT symbol, bar_date, {r('z', 'z')}, CASE WHEN z >= 0 THEN 1.0::DOUBLE WHEN z >= -0.5 THEN 0.75 WHEN z >= -1 THEN 0.5 WHEN z IS NOT NULL THEN 0.25 END AS multiplier FROM (SELECT *, {_Z} AS z FROM lr)", PRICE_SQL),
    "pf37_regime_band_v2": fx.sql(f"""SELECT symbol, bar_date, alarms, [1.0::DOUBLE, 0.75, 0.5, 0.25][alarms + 1] AS multiplier FROM (SELECT b.symbol, b.bar_date, CAST(coalesce(dd >= 0.1, false) AS INT) + CAST(coalesce(close < m, false) AS INT) + CAST(coalesce(v.value >= 250000, false) AS INT) AS alarms FROM
      (SELECT *, 1 - close / max(close) OVER {last_n(252)} AS dd, {full('avg', 'close', 200)} AS m FROM bars) b ASOF LEFT JOIN (SELECT * FROM macro WHERE series = 'vix') v ON b.bar_date >= v.macro_date)""", fx.MACRO_SQL),
    "pf38_retrain_pace": f"WITH m AS (SELECT date_trunc('month', d) AS month, max(d) AS done FROM (SELECT CAST(ts AS DATE) AS d FROM events WHERE event_type = 'signup' UNION ALL SELECT CAST(o_orderdate AS DATE) FROM orders) GROUP BY 1) SELECT count(*) AS months, {r('avg(gap) FILTER (k <= 5)', 'mean_gap_days')}, max(done) AS last_done FROM (SELECT *, done - lag(done) OVER (ORDER BY month) AS gap, row_number() OVER (ORDER BY month DESC) AS k FROM m)",
    "pf39_gate_decisions": "SELECT CAST(date_trunc('month', d) AS DATE) AS month, first(CASE o_orderstatus WHEN 'F' THEN 'promote' ELSE 'retain' END ORDER BY line DESC) AS decision, CAST(first('0.' || (o_orderkey % 100 + 100) ORDER BY line DESC) AS DOUBLE) AS ic FROM (SELECT *, CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y-%m-%d') || ' gate=' || CASE o_orderstatus WHEN 'F' THEN 'promote' ELSE 'retain' END || ' ic=0.' || (o_orderkey % 100 + 100) || ' key ' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS line FROM orders) GROUP BY 1",
    "pf40_trade_pairs": fx.sql(f"SELECT lot_id, symbol, kind, trade_date, {r('price', 'price', 8)}, {r('pnl', 'pnl', 8)}, entry_date, {r('entry_price', 'entry_price', 8)} FROM (SELECT t.*, CASE WHEN t.kind = 'close' THEN o.trade_date END AS entry_date, CASE WHEN t.kind = 'close' THEN o.price END AS entry_price FROM trade_log t LEFT JOIN (SELECT * FROM trade_log WHERE kind = 'open') o USING (lot_id, symbol) ORDER BY t.trade_date DESC, t.lot_id DESC, t.kind LIMIT 50)", *L),
    "pf41_last_close": fx.sql("SELECT * FROM lc", *L),
    "pf42_strategy_summary": fx.sql(f"SELECT {r('p', 'pre_tax')}, {r('m', 'post_tax')}, n AS n_years, {r('b', 'benchmark')}, {r('pow(p, 1.0 / n) - 1', 'annualised')}, {r('1 + (b - 1) * 0.75', 'benchmark_post_tax')} FROM (SELECT (SELECT arg_max(equity, bar_date) / arg_min(equity, bar_date) FROM eq) AS p, (SELECT arg_max(multiple, year) FROM multi) AS m, (SELECT count(*) FROM multi) AS n, (SELECT arg_max(close, bar_date) / arg_min(close, bar_date) FROM bench) AS b)", *EQ, YEARS),
    "pf43_latest_snapshot": fx.sql("SELECT * FROM (SELECT CAST(date_trunc('month', bar_date) AS DATE) AS snapshot_at, bar_date, CASE WHEN day(bar_date) % 2 = 0 THEN close END AS value FROM bars WHERE symbol = 'Brand#1') WHERE snapshot_at = (SELECT max(CAST(date_trunc('month', bar_date) AS DATE)) FROM bars WHERE symbol = 'Brand#1')"),
    "pf44_close_filled_signals": fx.sql("""SELECT s.symbol, s.signal_date, CASE WHEN o IS NOT NULL AND state = 'OPEN' THEN 'CLOSED' ELSE state END AS state, CASE WHEN o IS NOT NULL AND state = 'OPEN' THEN 'stop order ' || o END AS note FROM (SELECT symbol, as_of AS signal_date, CASE WHEN qty = 1 THEN 'CLOSED' ELSE 'OPEN' END AS state FROM lots) s
      LEFT JOIN (SELECT 'Brand#' || (o_custkey % 25 + 1) AS symbol, CAST(o_orderdate AS DATE) AS signal_date, max(o_orderkey) AS o FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1, 2) x ON x.symbol = s.symbol AND x.signal_date = s.signal_date""", *L),
}
