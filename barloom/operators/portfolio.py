"""Portfolio analytics on small date tables, lots and bars.

A daily return or equity table has one row per date, so the ordered windows over
it stay small however large the panel behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import nz

DATES = "bar_date"


def _all(order: str = DATES):
    return Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def long_short_returns(p: DataFrame, least: int = 10, share: float = 0.1) -> DataFrame:
    """(as_of, n, ret): mean realised return of the top minus the bottom share by prediction (half-to-even count, 1 at least)."""
    day = Window.partitionBy("as_of")
    r = p.filter("realized_return is not null").withColumn("_n", F.count("*").over(day)).filter(F.col("_n") >= least)
    k = F.greatest(F.lit(1.0), F.bround(share * F.col("_n"), 0))
    r = r.withColumns({"_k": k, "_t": F.row_number().over(day.orderBy(F.desc("predicted_return"), "symbol")), "_b": F.row_number().over(day.orderBy("predicted_return", "symbol"))})
    x = F.col("realized_return")
    return r.groupBy("as_of").agg(F.max("_n").alias("n"), (F.avg(F.when(F.col("_t") <= F.col("_k"), x)) - F.avg(F.when(F.col("_b") <= F.col("_k"), x))).alias("ret"))


def forward_simple_return(bars: DataFrame, h: int = 5) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(DATES)
    return bars.withColumn("fwd", F.lead("close", h).over(w) / nz(F.col("close")) - 1)


def equity_curve(returns: DataFrame, r: str = "ret", start: float = 1.0, order: str = DATES) -> DataFrame:
    """``returns`` with ``equity``: cumulative product, missing returns are 0; a loss of everything stays at 0."""
    x = F.coalesce(r, F.lit(0.0))
    ruin = F.max((x <= -1).cast("int")).over(_all(order))
    grow = F.exp(F.sum(F.when(x > -1, F.log1p(x)).otherwise(0.0)).over(_all(order)))
    return returns.withColumn("equity", F.when(ruin == 1, 0.0).otherwise(start * grow))


def sharpe(r: str, least: int = 5) -> Column:
    return F.when(F.count(r) >= least, F.avg(r) / nz(F.stddev_samp(r)) * F.sqrt(F.lit(252.0)))


def sortino(r: str, least: int = 5) -> Column:
    """Mean over the root mean square of losses (about zero)."""
    down = F.sqrt(F.avg(F.when(F.col(r).isNotNull(), F.pow(F.least(F.col(r), F.lit(0.0)), F.lit(2.0)))))
    return F.when(F.count(r) >= least, F.avg(r) / nz(down) * F.sqrt(F.lit(252.0)))


def sortino_sample(r: str) -> Column:
    """Mean over the sample deviation of negative returns."""
    return F.avg(r) / nz(F.stddev_samp(F.when(F.col(r) < 0, F.col(r)))) * F.sqrt(F.lit(252.0))


def drawdowns(equity: DataFrame, by: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(by or [])).orderBy(DATES).rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max("equity").over(w)
    return equity.withColumn("drawdown", (peak - F.col("equity")) / nz(peak))


def per_year(equity: DataFrame) -> DataFrame:
    """Per year: return (last over first), Sharpe of daily returns, drawdown, days, first and last date."""
    y = equity.withColumn("year", F.year(DATES))
    w = Window.partitionBy("year").orderBy(DATES)
    y = drawdowns(y.withColumn("_r", F.col("equity") / nz(F.lag("equity").over(w)) - 1), ["year"])
    return y.groupBy("year").agg(
        (F.max_by("equity", DATES) / nz(F.min_by("equity", DATES)) - 1).alias("ret"), sharpe("_r").alias("sharpe"), F.max("drawdown").alias("max_drawdown"), F.count("*").alias("n_days"),
        F.min(DATES).alias("first_date"), F.max(DATES).alias("last_date"),
    )


def benchmark_in_windows(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Per year window (year, first_date, last_date): the benchmark's return, drawdown and highest high inside it."""
    b = bars.withColumn("year", F.year(DATES)).join(F.broadcast(windows.select("year", "first_date", "last_date")), "year").filter(F.col(DATES).between(F.col("first_date"), F.col("last_date")))
    d = drawdowns(b.withColumn("equity", F.col("close")), ["year"])
    return d.groupBy("year").agg((F.max_by("close", DATES) / nz(F.min_by("close", DATES)) - 1).alias("ret"), F.max("drawdown").alias("max_drawdown"), F.max("high").alias("peak"))


def calendar_year(bars: DataFrame) -> DataFrame:
    return bars.groupBy(F.year(DATES).alias("year")).agg((F.max_by("close", DATES) / nz(F.min_by("close", DATES)) - 1).alias("ret"))


def monthly_excess(equity: DataFrame, bench: DataFrame) -> DataFrame:
    """Per month the strategy's and the benchmark's return (last over first) and their difference."""
    def month(df, x, name):
        return df.groupBy(F.trunc(DATES, "month").alias("month")).agg((F.max_by(x, DATES) / nz(F.min_by(x, DATES)) - 1).alias(name))

    return month(equity, "equity", "strategy").join(month(bench, "close", "benchmark"), "month", "left").withColumn("excess", F.col("strategy") - F.col("benchmark"))


def month_daily(equity: DataFrame, bench: DataFrame) -> DataFrame:
    """Daily strategy and benchmark returns and their difference."""
    w = Window.orderBy(DATES)
    s = equity.select(DATES, (F.col("equity") / nz(F.lag("equity").over(w)) - 1).alias("strategy"))
    b = bench.select(DATES, (F.col("close") / nz(F.lag("close").over(w)) - 1).alias("benchmark"))
    return s.join(b, DATES, "left").withColumn("excess", F.col("strategy") - F.col("benchmark"))


def month_risk(daily: DataFrame, equity: DataFrame) -> DataFrame:
    m = F.trunc(DATES, "month").alias("month")
    risk = daily.groupBy(m).agg(sharpe("strategy", 3).alias("sharpe"), (F.stddev_samp("strategy") * F.sqrt(F.lit(252.0))).alias("volatility"))
    dd = drawdowns(equity.withColumn("month", F.trunc(DATES, "month")), ["month"]).groupBy("month").agg(F.max("drawdown").alias("max_drawdown"))
    return risk.join(dd, "month")


def best_worst_days(daily: DataFrame, k: int = 3) -> DataFrame:
    d = daily.filter("excess is not null")
    best = d.orderBy(F.desc("excess"), DATES).limit(k).withColumn("kind", F.lit("best"))
    return best.unionByName(d.orderBy("excess", DATES).limit(k).withColumn("kind", F.lit("worst"))).select(DATES, "excess", "kind")


def top_holdings(lots: DataFrame, k: int = 10) -> DataFrame:
    """Weight per symbol and date summed over lots, averaged over days held; the k held longest, then heaviest."""
    days = lots.groupBy("symbol", DATES).agg(F.sum("weight").alias("w"))
    out = days.groupBy("symbol").agg(F.count("*").alias("days_held"), F.avg("w").alias("avg_weight"))
    return out.orderBy(F.desc("days_held"), F.desc("avg_weight"), "symbol").limit(k)


def tax_annual(years: DataFrame, rate: float, start: float = 1.0) -> DataFrame:
    """Yearly returns taxed each year, losses alike, compounded."""
    return equity_curve(years.withColumn("net", F.col("ret") * (1 - rate)), "net", start, "year")


def tax_deferred(years: DataFrame, rate: float, start: float = 1.0) -> DataFrame:
    """Compounded untaxed; value if sold then."""
    out = equity_curve(years, "ret", start, "year")
    return out.withColumn("after_tax", start + (F.col("equity") - start) * (1 - rate))


def tax_gain_only(years: DataFrame, rate: float) -> DataFrame:
    """Only gains of completed years (last date on or after 28 December) are taxed; cumulative multiple."""
    done = (F.month("last_date") == 12) & (F.dayofmonth("last_date") >= 28)
    net = F.when(done & (F.col("ret") > 0), F.col("ret") * (1 - rate)).otherwise(F.col("ret"))
    return equity_curve(years.withColumn("net", net), "net", 1.0, "year").withColumnRenamed("equity", "multiple")


def post_tax_curve(equity: DataFrame, years: DataFrame, rate: float) -> DataFrame:
    """Daily curve on the base that taxes of earlier completed years have reduced."""
    gross, net = F.col("ret"), F.col("net")
    y = tax_gain_only(years, rate).select("year", ((1 + net) / nz(1 + gross)).alias("ret"))
    factor = y.withColumn("f", F.exp(F.coalesce(F.sum(F.ln("ret")).over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))))
    return equity.withColumn("year", F.year(DATES)).join(F.broadcast(factor.select("year", "f")), "year").withColumn("post_tax", F.col("equity") * F.col("f")).drop("f")


def rebased_benchmark(equity: DataFrame, bench: DataFrame) -> DataFrame:
    """The benchmark's close carried forward to the strategy's dates, scaled to its first equity."""
    both = equity.select(DATES, "equity").join(bench.select(DATES, "close"), DATES, "full_outer")
    filled = both.withColumn("c", F.last("close", True).over(_all()))
    base = filled.filter("equity is not null").agg(F.min_by("equity", DATES).alias("e0"), F.min_by("c", F.when(F.col("c").isNotNull(), F.col(DATES))).alias("c0"))
    return filled.filter("equity is not null").crossJoin(F.broadcast(base)).select(DATES, "equity", (F.col("c") / nz(F.col("c0")) * F.col("e0")).alias("benchmark"))


def outperformance(rebased: DataFrame) -> DataFrame:
    return rebased.agg(F.max_by("equity", DATES).alias("strategy"), F.max_by("benchmark", DATES).alias("benchmark")).withColumn("ratio", F.col("strategy") / nz(F.col("benchmark")))


def slice_weights(picks: DataFrame, atr: str | None = None, day: str = "as_of") -> DataFrame:
    """Weights by positive conviction, over volatility where known; equal where they sum to zero."""
    raw = F.greatest(F.col("score"), F.lit(0.0))
    raw = raw if atr is None else F.when(F.col(atr) > 0, raw / F.col(atr)).otherwise(raw)
    w = Window.partitionBy(day)
    out = picks.withColumn("_w", raw)
    return out.withColumn("weight", F.when(F.sum("_w").over(w) > 0, F.col("_w") / F.sum("_w").over(w)).otherwise(1 / F.count("*").over(w))).drop("_w")


def prior_support(bars: DataFrame, n: int = 3, buffer: float = 0.01) -> DataFrame:
    """Stop under the lowest low of the n bars before (fewer at the start); null if not below the open."""
    w = Window.partitionBy("symbol").orderBy(DATES).rowsBetween(-n, -1)
    stop = F.min("low").over(w) * (1 - buffer)
    return bars.withColumn("stop", F.when(stop < F.col("open"), stop))


def simple_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Plain mean of the true ranges of the n bars before."""
    s = Window.partitionBy("symbol").orderBy(DATES)
    before = F.lag("close").over(s)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    out = bars.withColumn("_tr", F.when(before.isNotNull(), tr))
    return out.withColumn("simple_atr", F.avg("_tr").over(s.rowsBetween(-n, -1))).drop("_tr")


def bullish_gap_support(bars: DataFrame, lookback: int = 20, distance: float = 0.5) -> DataFrame:
    """Top of the nearest untouched three-bar gap (high two bars ago under this low) below the close, within ``distance``.

    Each bar looks at the lows and gaps of its own last ``lookback`` bars, held
    in one array, so there is no join of bars with bars.
    """
    w = Window.partitionBy("symbol").orderBy(DATES)
    g = bars.withColumn("_bottom", F.lag("high", 2).over(w))
    held = F.collect_list(F.struct(F.col("low").alias("low"), F.when(F.col("_bottom") < F.col("low"), F.col("_bottom")).alias("bottom"))).over(w.rowsBetween(-(lookback - 1), 0))
    g = g.withColumn("_a", held)
    touched = "exists(slice(_a, i + 2, size(_a)), y -> y.low <= x.low)"
    near = F.expr(f"filter(transform(_a, (x, i) -> case when x.bottom is not null and x.low <= close and (close - x.low) / close <= {distance} and not {touched} then x.low end), z -> z is not null)")
    return g.withColumn("gap_support", F.array_max(near)).drop("_a", "_bottom")


def cost_columns(lots: DataFrame, *, fee_bps: float = 5.0, per_order: float = 1.0, tax_bps: float = 10.0, cap: float = 20.0) -> DataFrame:
    """Opening and closing costs under two schedules: basis points plus a fee, and a capped share with a selling tax."""
    value = F.col("qty") * F.col("price")
    a = value * fee_bps / 1e4 + per_order
    b = F.least(value * fee_bps / 1e4, F.lit(cap))
    return lots.withColumns({"flat_open": a, "flat_close": a, "capped_open": b, "capped_close": b + value * tax_bps / 1e4})


def lot_outcomes(signals: DataFrame, bars: DataFrame, *, hold: int = 5, lag: int = 1, buffer: float = 0.01, cost_bps: float = 10.0) -> DataFrame:
    """Per signal: entry at the open ``lag`` bars later, exit at the first close at or under the stop, else at the open after ``hold`` bars.

    All later bars a lot can need are gathered beside its bar by one window, so
    signals meet bars in one equi-join.
    """
    w = Window.partitionBy("symbol").orderBy(DATES)
    b = prior_support(bars, 3, buffer)
    later = F.collect_list(F.struct("open", "close", DATES)).over(w.rowsBetween(lag, lag + hold))
    b = b.select("symbol", F.col(DATES).alias("as_of"), later.alias("_l"), F.lead("stop", lag).over(w).alias("stop"))
    j = signals.join(b, ["symbol", "as_of"]).filter(F.size("_l") > hold)
    hit = F.expr(f"array_min(transform(filter(transform(slice(_l, 1, {hold}), (x, i) -> struct(i as i, x.close as c)), y -> y.c <= stop), z -> z.i))")
    j = j.withColumns({"_hit": hit, "entry": F.col("_l")[0]["open"]})
    exit_ = F.when(F.col("_hit").isNotNull(), F.expr("_l[_hit].close")).otherwise(F.expr(f"_l[{hold}].open"))
    j = j.withColumns({"exit": exit_, "reason": F.when(F.col("_hit").isNotNull(), "stop").otherwise("expiry"), "days": F.coalesce("_hit", F.lit(hold))})
    return j.withColumn("ret", F.col("exit") / nz(F.col("entry")) - 1 - 2 * cost_bps / 1e4).select("symbol", "as_of", "entry", "stop", "exit", "reason", "days", "ret")


def overlapping_returns(lots: DataFrame, bars: DataFrame, hold: int = 5) -> DataFrame:
    """(bar_date, n_lots, ret): mean daily return over lots that are open, equal capital in each of ``hold`` slices."""
    w = Window.partitionBy("symbol").orderBy(DATES)
    b = bars.withColumns({"_r": F.col("close") / nz(F.lag("close").over(w)) - 1, "_i": F.row_number().over(w)}).select("symbol", DATES, "_r", "_i")
    start = lots.join(b.select("symbol", F.col(DATES).alias("as_of"), F.col("_i").alias("_s")), ["symbol", "as_of"])
    days = start.select("symbol", "as_of", "weight", F.explode(F.sequence(F.col("_s") + 1, F.col("_s") + hold)).alias("_i"))
    return days.join(b.hint("shuffle_hash"), ["symbol", "_i"]).groupBy(DATES).agg(F.count("*").alias("n_lots"), (F.sum(F.col("weight") * F.col("_r")) / hold).alias("ret"))


def next_day_picks(p: DataFrame, bars: DataFrame, capital: float = 10000.0, k: int = 5) -> DataFrame:
    """Per date the best k by conviction with ATR, stop, weight, quantity and notional."""
    from .predictions import conviction

    w = Window.partitionBy("as_of").orderBy(F.desc("score"), "symbol")
    best = p.withColumn("score", conviction()).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k).select("symbol", "as_of", "score", "k")
    b = simple_atr(prior_support(bars)).select("symbol", F.col(DATES).alias("as_of"), "close", "stop", "simple_atr")
    j = slice_weights(best.join(b, ["symbol", "as_of"]), "simple_atr")
    qty = F.greatest(F.lit(1), F.floor(F.col("weight") * capital / F.col("close"))).cast("long")
    return j.withColumn("qty", qty).withColumns({"notional": qty * F.col("close"), "broken_support": F.coalesce(F.col("close") < F.col("stop"), F.lit(False))})


def position_rollup(lots: DataFrame, closes: DataFrame) -> DataFrame:
    """Lots to (symbol, side): quantity, cost-weighted entry, dates, highest stop, lots, unrealised result at the last close."""
    g = lots.groupBy("symbol", "side").agg(
        F.sum("qty").alias("qty"), (F.sum(F.col("qty") * F.col("entry_price")) / nz(F.sum("qty").cast("double"))).alias("entry"), F.min("entry_date").alias("first_entry"), F.max("entry_date").alias("last_entry"),
        F.max("stop").alias("stop"), F.count("*").alias("n_lots"),
    )
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    return g.join(closes.select("symbol", F.col("close").alias("last_close")), "symbol", "left").withColumn("unrealised", sign * F.col("qty") * (F.col("last_close") - F.col("entry")))


def realized_since_entry(trades: DataFrame, positions: DataFrame) -> DataFrame:
    """Realised result of closes on or after the earliest open entry of the symbol."""
    j = positions.select("symbol", "first_entry").join(trades.filter("kind = 'close'"), "symbol", "left")
    ok = F.col("trade_date") >= F.col("first_entry")
    return j.groupBy("symbol").agg(F.coalesce(F.sum(F.when(ok, F.col("pnl"))), F.lit(0.0)).alias("realized"))


def planned_exit(entries: DataFrame, calendar: DataFrame, hold: int) -> DataFrame:
    """The ``hold``-th trading day after each entry date."""
    cal = calendar.select(DATES).distinct().withColumn("planned_exit", F.lead(DATES, hold).over(Window.orderBy(DATES)))
    return entries.join(F.broadcast(cal.withColumnRenamed(DATES, "entry_date")), "entry_date", "left")


def fill_slippage(fills: DataFrame, sim: DataFrame) -> DataFrame:
    """Signed basis points of each fill against the simulated one of its date, symbol and side (positive: worse)."""
    j = fills.join(sim.select("trade_date", "symbol", "side", F.col("price").alias("sim_price")), ["trade_date", "symbol", "side"], "left")
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    return j.withColumns({"slip_bps": sign * (F.col("price") - F.col("sim_price")) / nz(F.col("sim_price")) * 1e4, "fee_bps": F.col("fee") / nz(F.col("price") * F.col("qty")) * 1e4})


def slippage_summary(s: DataFrame) -> DataFrame:
    return s.filter("slip_bps is not null").agg(F.count("*").alias("n"), F.avg("slip_bps").alias("mean_bps"), F.expr("percentile_disc(0.5) within group (order by slip_bps desc)").alias("upper_median_bps"), F.sum("fee").alias("total_fee"))


def regime_band_v1(bars: DataFrame) -> DataFrame:
    """Multiplier by the distance of the close from its 50-bar mean in units of 20-bar volatility."""
    from ..functions.windows import full, lag

    c = F.col("close")
    out = bars.withColumn("_r", F.ln("close") - lag(F.ln("close")))
    z = (c - full(F.avg, c, 50)) / nz(c * full(F.stddev_samp, F.col("_r"), 20) * F.sqrt(F.lit(50.0)))
    out = out.withColumn("z", z)
    return out.withColumn("multiplier", F.when(F.col("z") >= 0, 1.0).when(F.col("z") >= -0.5, 0.75).when(F.col("z") >= -1.0, 0.5).when(F.col("z").isNotNull(), 0.25)).drop("_r")


def regime_band_v2(bars: DataFrame, vix: DataFrame, level: float) -> DataFrame:
    """Multiplier by how many of three alarms are on: drawdown of 10 %, close under its 200-bar mean, last VIX at ``level``."""
    from ..functions.windows import full, last_n

    c = F.col("close")
    out = bars.withColumns({"_dd": 1 - c / nz(F.max("close").over(last_n(252))), "_m": full(F.avg, c, 200)})
    out = _last_by_date(out, vix)
    alarms = F.coalesce((F.col("_dd") >= 0.1).cast("int"), F.lit(0)) + F.coalesce((c < F.col("_m")).cast("int"), F.lit(0)) + F.coalesce((F.col("_v") >= level).cast("int"), F.lit(0))
    return out.withColumn("alarms", alarms).withColumn("multiplier", F.element_at(F.array(F.lit(1.0), F.lit(0.75), F.lit(0.5), F.lit(0.25)), F.col("alarms") + 1)).drop("_dd", "_m", "_v")


def _last_by_date(bars: DataFrame, series: DataFrame) -> DataFrame:
    """The series' last value for each date of the bars, by way of the distinct dates."""
    dates = bars.select(DATES).distinct().join(series.select(F.col("macro_date").alias(DATES), "value"), DATES, "full_outer")
    return bars.join(dates.select(DATES, F.last("value", True).over(_all()).alias("_v")), DATES)


def retrain_pace(runs: DataFrame) -> DataFrame:
    """Months covered, mean of the last five gaps between completions in days, date when the next is due."""
    m = runs.groupBy(F.trunc("done_at", "month").alias("month")).agg(F.max("done_at").alias("done"))
    w = Window.orderBy("month")
    gaps = m.withColumns({"gap": F.datediff("done", F.lag("done").over(w)), "k": F.row_number().over(Window.orderBy(F.desc("month")))})
    return gaps.agg(F.count("*").alias("months"), F.avg(F.when(F.col("k") <= 5, F.col("gap"))).alias("mean_gap_days"), F.max("done").alias("last_done"))


def gate_decisions(lines: DataFrame) -> DataFrame:
    """(month, decision, ic) of log lines ``YYYY-MM-DD gate=<decision> ic=<number>``; the newest line of a month counts."""
    x = lines.select(F.to_date(F.regexp_extract("line", r"^(\d{4}-\d{2}-\d{2})", 1)).alias("d"), F.regexp_extract("line", r"gate=(\w+)", 1).alias("decision"), F.regexp_extract("line", r"ic=(-?[0-9.]+)", 1).cast("double").alias("ic"), "line")
    return x.groupBy(F.trunc("d", "month").alias("month")).agg(F.max_by(F.struct("decision", "ic"), F.struct("d", "line")).alias("x")).select("month", "x.decision", "x.ic")


def trade_pairs(trades: DataFrame, limit: int = 50) -> DataFrame:
    """Closing rows with date and price of their opening row; opening rows without; newest first."""
    opens = trades.filter("kind = 'open'").select("lot_id", "symbol", F.col("trade_date").alias("entry_date"), F.col("price").alias("entry_price"))
    j = trades.join(opens, ["lot_id", "symbol"], "left")
    for c in ("entry_date", "entry_price"):
        j = j.withColumn(c, F.when(F.col("kind") == "close", F.col(c)))
    return j.orderBy(F.desc("trade_date"), F.desc("lot_id"), "kind").limit(limit)


def last_close(bars: DataFrame, day) -> DataFrame:
    return bars.filter(F.col(DATES) <= F.lit(day).cast("date")).groupBy("symbol").agg(F.max_by("close", DATES).alias("close"), F.max(DATES).alias("as_of"))


def strategy_summary(equity: DataFrame, bench: DataFrame, rate: float) -> DataFrame:
    """Multiples before and after tax, annualised, beside the benchmark's (its gain taxed once)."""
    years = tax_gain_only(per_year(equity), rate)
    s = equity.agg((F.max_by("equity", DATES) / nz(F.min_by("equity", DATES))).alias("pre_tax"))
    t = years.agg(F.max_by("multiple", "year").alias("post_tax"), F.count("*").alias("n_years"))
    b = bench.agg((F.max_by("close", DATES) / nz(F.min_by("close", DATES))).alias("benchmark"))
    out = s.crossJoin(t).crossJoin(b)  # one row each
    return out.withColumns({"annualised": F.pow("pre_tax", 1 / F.col("n_years")) - 1, "benchmark_post_tax": 1 + (F.col("benchmark") - 1) * (1 - rate)})


def latest_snapshot(rows: DataFrame, at: str, value: str) -> DataFrame:
    newest = rows.agg(F.max(at).alias(at))
    return rows.join(F.broadcast(newest), at).orderBy(F.col(value).desc_nulls_last())


def close_filled_signals(signals: DataFrame, orders: DataFrame) -> DataFrame:
    """Open signals whose stop order was filled become CLOSED with a note."""
    o = orders.filter("status = 'filled'").groupBy("symbol", "signal_date").agg(F.max("order_id").alias("_o"))
    hit = F.col("_o").isNotNull() & (F.col("state") == "OPEN")
    j = signals.join(o, ["symbol", "signal_date"], "left")
    return j.withColumns({"note": F.when(hit, F.concat(F.lit("stop order "), F.col("_o").cast("string"))), "state": F.when(hit, "CLOSED").otherwise(F.col("state"))}).drop("_o")
