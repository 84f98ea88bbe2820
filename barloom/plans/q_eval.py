"""Queries over panels, labels, folds, evaluation, gates and the prediction log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as f
from ..functions import panel_features as pf
from ..functions.panel import batch_slice, build_panel, inference_slice
from ..functions.windows import rounded
from ..operators import asof
from ..operators import evaluate as ev
from ..operators import keyed
from ..operators import labels as lb
from ..operators import pit
from ..operators import predictions as pr
from . import fixtures as fx
from . import q_features as qf
from . import q_panel as qp
from .q_features import PRICE_SQL
from .shared import by_rows, shared_dir, written
from .sqlkit import r, rs

DAY = "1999-06-30"
X, Y = "predicted_return", "realized_return"


def preds(spark, d):
    return fx.predictions(spark, d)


def wide_dates(df, least=8, date="as_of"):
    """Rows of dates with at least so many rows (sparse small tables have many dates with one or two)."""
    return df.join(df.groupBy(date).agg(F.count("*").alias("_c")).filter(F.col("_c") >= least).select(date), date, "left_semi")


#: Digits that columns of a group are rounded to, six for others.
DIGITS = {"volume": 4, "interactions": 4, "sector_residual": 5, "sec_fundamentals": 10, "sec_fundamentals_v2": 10}


def panel(spark, d):
    """The panel of all groups over the derived tables, masked by membership."""
    bars = fx.bars(spark, d)
    rows = by_rows(bars, "symbol")
    tables = {
        "macro": fx.macro(spark, d), "sectors": qp.sectors(spark, d), "benchmarks": qp.benchmarks(spark, d), "benchmark_bars": bars,
        "announcements": fx.announcements(spark, d, rows), "filings": fx.filings(spark, d, rows), "fundamentals": written(fx.fundamentals(spark, d)),
    }
    return build_panel(bars, tables, membership=fx.membership(spark, d, bars), cut=lambda df: df if df is bars else written(df))  # bars are written already


def pn1(spark, d):
    """All columns that have a DuckDB twin: all but the volume profile's and the ranks of fundamentals."""
    p = panel(spark, d)
    wick = F.col("microstructure__wick_ratio")
    p = p.withColumn("microstructure__wick_ratio", F.when(F.abs(wick) > 1e6, wick / 1e9).otherwise(wick))
    cols = [F.round(c, DIGITS.get(c.split("__")[0], 6)) + F.lit(0.0) for c in PANEL_COLUMNS]
    return p.select("symbol", "bar_date", *[x.alias(c) for x, c in zip(cols, PANEL_COLUMNS, strict=True)])


def pn3(spark, d):
    p = f.price(fx.bars(spark, d))
    return rounded(inference_slice(p, fx.membership(spark, d), "US", DAY, ["price__log_return_5d", "price__log_return_1d"]))


def pn4(spark, d):
    p = f.price(fx.bars(spark, d))
    days = p.select("bar_date").filter(F.dayofmonth("bar_date") == 1)
    return rounded(batch_slice(p, fx.membership(spark, d), days, ["price__log_return_5d"]))


def lb1(spark, d):
    return rounded(lb.forward_return(fx.bars(spark, d)).select("symbol", "bar_date", "fwd_return_5d"))


def lb2(spark, d):
    p = lb.forward_return(fx.bars(spark, d)).select("symbol", "bar_date", "fwd_return_5d")
    return lb.quantile_label(p, fx.membership(spark, d), "fwd_return_5d").select("symbol", "bar_date", "quintile")


def _train(spark, d):
    b = fx.bars(spark, d)
    mem = fx.membership(spark, d, b)
    p = f.price(b).select("symbol", "bar_date", "price__log_return_5d")
    y = lb.quantile_label(lb.forward_return(b).select("symbol", "bar_date", "fwd_return_5d"), mem, "fwd_return_5d")
    return lb.training_set(p, y, mem)


def lb3(spark, d):
    return rounded(_train(spark, d))


def snk3(spark, d):
    """The training set by year in the shared folder; a year that is written again is replaced."""
    path, rows = shared_dir(spark), written(_train(spark, d).withColumn("year", F.year("bar_date")))
    keyed.write_training_panel(rows, path)
    keyed.write_training_panel(rows.filter("year = 1997"), path)
    return rounded(spark.read.parquet(path))


def lb4(spark, d):
    return rounded(lb.label_stats(lb.trainable_rows(_train(spark, d), "quintile"), "fwd_return_5d", "quintile"))


def lb5(spark, d):
    return rounded(lb.trainable_rows(_train(spark, d), "quintile"))


def lb6(spark, d):
    e = fx.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, float("inf")).otherwise(F.col("value")).alias("value"), F.get_json_object("props", "$.k").alias("k"), F.col("event_type"))
    return lb.clean_features(e, ["value", "k", "event_type"])


def _cal(spark, d):
    return fx.bars(spark, d).select("bar_date")


FOLD = dict(n=4, h=5, embargo=10, min_train=300)


def sp1(spark, d):
    return lb.purged_folds(_cal(spark, d), **FOLD)


def sp1_rows(spark, d):
    out = lb.assign_folds(fx.bars(spark, d).select("symbol", "bar_date"), lb.purged_folds(_cal(spark, d), **FOLD))
    return out.groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("bar_date").alias("first_date"), F.max("bar_date").alias("last_date"))


def sp2(spark, d):
    return lb.retrain_dates(_cal(spark, d))


def sp3(spark, d):
    done = _cal(spark, d).distinct().filter(F.month("bar_date") <= 6).select(F.last_day("bar_date").alias("last_day")).distinct()
    return lb.walk_forward_windows(_cal(spark, d), 730, done)


def sp4(spark, d):
    return lb.chronological_parts(fx.bars(spark, d).select("symbol", "bar_date"), DAY, holdout=300, calibration=150)


def ev1(spark, d):
    return rounded(ev.daily_ic(preds(spark, d), X, Y))


def ev2(spark, d):
    return rounded(ev.daily_rank_ic(preds(spark, d), X, Y))


def ev3(spark, d):
    p = preds(spark, d).filter(f"{Y} is not null")
    return rounded(p.groupBy("symbol").agg(ev.hit_rate(X, Y).alias("hit_rate"), F.avg((F.col(X) * F.col(Y) > 0).cast("double")).alias("product_rate")))


def ev4(spark, d):
    return rounded(ev.decile_spread(preds(spark, d), X, Y, n=5))


def ev5(spark, d):
    return rounded(ev.evaluate_predictions(preds(spark, d)))


def _probs(spark, d):
    p = preds(spark, d).withColumn("label", F.col("top_p") * 10 % 3)
    p = p.withColumn("label", F.floor("label").cast("int"))
    a, b = F.col("top_p") / 2, F.col("bot_p") / 2
    return p.withColumn("probs", F.array(a, b, F.lit(0.5)))


def ev6(spark, d):
    return rounded(ev.brier_skill(_probs(spark, d), "probs", "label", 3))


def ev7(spark, d):
    p = preds(spark, d).filter(f"{Y} is not null").withColumnRenamed("as_of", "bar_date")
    rows = lb.assign_folds(p, lb.purged_folds(_cal(spark, d), **FOLD)).filter("part = 'val'")
    return rounded(ev.fold_metrics(rows, X, Y))


def ev8(spark, d):
    return rounded(ev.monthly_summary(preds(spark, d)))


def _metrics(spark, d):
    return preds(spark, d).filter(f"{Y} is not null").groupBy("symbol").agg(ev._corr(X, Y).alias("m"))


def gt1(spark, d):
    m = _metrics(spark, d)
    n = F.regexp_extract("symbol", "([0-9]+)", 1).cast("int")
    m = m.select("symbol", F.when(n % 7 != 0, F.col("m")).alias("new_metric"), F.when(n % 5 != 0, F.lit(-0.5)).alias("base_metric"))
    return rounded(ev.promote_gate(m))


def _folds(spark, d):
    p = preds(spark, d).filter(f"{Y} is not null").withColumn("fold", F.year("as_of"))
    return p.groupBy(F.col("symbol").alias("trial"), "fold").agg(F.avg(Y).alias("metric"), F.count("*").alias("n_rows"), (F.count("*") * F.lit(3)).alias("train_rows"))


def gt2(spark, d):
    return rounded(ev.trial_objective(_folds(spark, d), least_rows=20, least_train=75, most_z=1.5))


def gt3(spark, d):
    p = preds(spark, d).filter(f"{Y} is not null")
    n = F.regexp_extract("symbol", "([0-9]+)", 1).cast("int")
    config = F.when(n % 4 == 0, "baseline").otherwise(F.concat(F.lit("c"), (n % 4).cast("string")))
    res = p.groupBy(config.alias("config"), (F.year("as_of") % 3).alias("seed")).agg(ev._corr(X, Y).alias("ic"), F.avg(Y).alias("spread"))
    return rounded(ev.group_verdict(res))


def gt4(spark, d):
    t = _folds(spark, d).select(F.expr("regexp_extract(trial, '([0-9]+)', 1) % 6").cast("int").alias("trial"), F.col("metric").alias("objective"), (F.col("n_rows") < 8).alias("rejected"))
    return rounded(ev.multi_seed_objective(t))


def dr1(spark, d):
    return rounded(ev.drift_check(preds(spark, d), DAY))


def pr1(spark, d):
    return rounded(preds(spark, d).select("symbol", "as_of", pr.conviction().alias("score")))


def pr2(spark, d):
    return rounded(pr.rank_predictions(preds(spark, d), 3, 0.9))


def _names(spark, d):
    return fx.table(spark, d, "part").groupBy(fx.symbol_of_part().alias("symbol")).agg(F.min("p_name").alias("company_name"))


def pr3(spark, d):
    return rounded(pr.top_picks(preds(spark, d).filter(f"{Y} is not null"), _names(spark, d)))


def pr4(spark, d):
    return rounded(pr.side_picks(preds(spark, d), 3))


def pr5(spark, d):
    return rounded(pr.symbol_history(preds(spark, d), "Brand#7", "1997-01-01"))


def pr6(spark, d):
    return rounded(pr.settle(preds(spark, d), fx.bars(spark, d), DAY))


def pr7(spark, d):
    return pr.settle_quintiles(preds(spark, d)).select("symbol", "as_of", "realized_quintile")


def _summary(spark, d):
    """The last year's summary; predictions of the last days have no return yet."""
    p = pr.settle_quintiles(preds(spark, d))
    late = F.col("as_of") > F.date_sub(F.lit(DAY).cast("date"), 10)
    return ev.performance_summary(p.withColumn("realized_return", F.when(~late, F.col("realized_return"))), DAY, written)


def pr8(spark, d):
    return rounded(_summary(spark, d).drop("calibration"))


def pr8_bins(spark, d):
    return rounded(_summary(spark, d).select(F.inline("calibration")))


def pr9(spark, d):
    return pr.missing_dates(_cal(spark, d), preds(spark, d).filter(F.dayofmonth("as_of") > 3))


def pr10(spark, d):
    p = preds(spark, d)
    return pr.shared_range(p.filter("symbol = 'Brand#1'"), p.filter("symbol = 'Brand#2'"))


def pr11(spark, d):
    return rounded(pr.trailing_returns(fx.bars(spark, d), DAY))


def ca1(spark, d):
    p = pr.settle_quintiles(preds(spark, d), 2)
    return rounded(pr.calibration_table(p, F.col("realized_quintile") == 4))


def ca2(spark, d):
    return rounded(ev.ic_timeseries(preds(spark, d)))


def ca3(spark, d):
    return rounded(pr.directional_accuracy(preds(spark, d)))


QUERIES = {
    "pn1_build_panel": pn1, "pn3_inference_slice": pn3, "pn4_batch_slice": pn4, "lb1_forward_return": lb1, "lb2_quantile_label": lb2, "lb3_training_set": lb3, "snk3_training_panel": snk3, "lb4_label_stats": lb4, "lb5_trainable_rows": lb5, "lb6_clean_features": lb6,
    "sp1_purged_folds": sp1, "sp1_fold_rows": sp1_rows, "sp2_retrain_dates": sp2, "sp3_walk_forward_windows": sp3, "sp4_chronological_parts": sp4, "ev1_daily_ic": ev1, "ev2_daily_rank_ic": ev2, "ev3_hit_rate": ev3, "ev4_spread": ev4,
    "ev5_evaluate_predictions": ev5, "ev6_brier_skill": ev6, "ev7_fold_metrics": ev7, "ev8_monthly_summary": ev8, "gt1_promote_gate": gt1, "gt2_trial_objective": gt2, "gt3_group_verdict": gt3, "gt4_multi_seed_objective": gt4, "dr1_drift_check": dr1,
    "pr1_conviction": pr1, "pr2_rank_predictions": pr2, "pr3_top_picks": pr3, "pr4_side_picks": pr4, "pr5_symbol_history": pr5, "pr6_settle": pr6, "pr7_settle_quintiles": pr7, "pr8_performance_summary": pr8, "pr8_calibration": pr8_bins, "pr9_missing_dates": pr9, "pr10_shared_range": pr10,
    "pr11_trailing_returns": pr11, "ca1_calibration_table": ca1, "ca2_ic_timeseries": ca2, "ca3_directional_accuracy": ca3,
}

_IN = "EXISTS (SELECT 1 FROM membership m WHERE m.symbol = b.symbol AND b.bar_date BETWEEN m.start_date AND coalesce(m.end_date, DATE '9999-12-31'))"
#: Queries whose twins make up the panel's: with symbol and date, or with the date alone.
_BY_SYMBOL = [f"f_{g}" for g in qf.NAMES if g != "volume_profile"] + ["xs_ranks", "ix_interactions", "se1_sector_flags", "sr_sector_residual", "ea_earnings", "sv_filings", "fu1_fundamentals_annual", "fu4_fundamentals_ttm"]
_BY_DATE = ["rg_regime", "mc_macro_features"]
PANEL_COLUMNS = [
    *(c for g in qf.NAMES if g != "volume_profile" for c in qf.columns(g)), *(f"cross_sectional__xs_rank_{n}" for n in pf.RANKED), "cross_sectional__xs_zscore_log_return_5d",
    *(f"regime__market_{n}" for n in ("return_1d", "breadth_advance_decline", "dispersion_20d", "return_5d", "realized_vol_20d")), *qp.MC_EXPR, *(f"interactions__{n}" for n in pf.PAIRS),
    *(pf.sector_column(s) for s in pf.SECTORS), *(f"sector_residual__{n}" for n in pf.RESIDUALS), "sector_residual__resid_zscore_60d",
    *(f"earnings__{n}" for n in ("days_since_last_earnings", "days_to_next_earnings", "last_surprise_pct", "last_surprise_z_252")), *(f"sec_events__{n}" for n in (*asof.SINCE, "count_8k_last_30d")), *qp._FY_COLS, *qp._TT_COLS,
]
_TWINS = qf.SQL | qp.SQL
PANEL_SQL = fx.sql(
    "SELECT symbol, bar_date, " + ", ".join(f"CASE WHEN inside THEN {c} END AS {c}" for c in PANEL_COLUMNS) + f" FROM (SELECT symbol, bar_date, {_IN} AS inside FROM bars b) "
    + " ".join(f"JOIN ({_TWINS[q]}) USING (symbol, bar_date)" for q in _BY_SYMBOL) + " " + " ".join(f"LEFT JOIN ({_TWINS[q]}) USING (bar_date)" for q in _BY_DATE), fx.MEMBERS_SQL
)
FWD = "fw AS (SELECT symbol, bar_date, ln(lead(close, 5) OVER (PARTITION BY symbol ORDER BY bar_date) / close) AS fwd FROM bars)"


def quint(source: str, x: str, by: str, n: int, out: str, least: int) -> str:
    """CTE ``q_<out>``: rows of ``source`` with the bucket of ``x``."""
    qs = ", ".join(str(i / n) for i in range(n + 1))
    return f"""e_{out} AS (SELECT {by}, list_sort(list_distinct(quantile_cont({x}, [{qs}]))) AS e FROM {source} GROUP BY 1 HAVING count({x}) >= {least}),
q_{out} AS (SELECT s.*, CASE WHEN {x} IS NOT NULL AND len(e) > 1 THEN greatest(0, len(list_filter(e, lambda v: v < {x})) - 1) END AS {out} FROM {source} s LEFT JOIN e_{out} USING ({by}))"""


_LB = [fx.MEMBERS_SQL, FWD, f"fm AS (SELECT *, CASE WHEN {_IN} THEN fwd END AS x FROM fw b)", quint("fm", "x", "bar_date", 5, "quintile", 5), PRICE_SQL,
       f"ts AS (SELECT b.symbol, b.bar_date, r5 AS price__log_return_5d, fwd AS fwd_return_5d, quintile, {_IN} AS in_universe FROM lr b LEFT JOIN q_quintile q USING (symbol, bar_date))"]
_TS = f"symbol, bar_date, {rs(['price__log_return_5d', 'fwd_return_5d'])}, quintile, in_universe"
_CAL = "cal AS (SELECT bar_date, row_number() OVER (ORDER BY bar_date) - 1 AS i FROM (SELECT DISTINCT bar_date FROM bars))"
_FOLDS = """fl AS (SELECT fold, 300 + fold * size AS v0, CASE WHEN fold = 3 THEN t - 1 ELSE 300 + fold * size + size - 1 END AS v1 FROM (SELECT count(*) AS t, (count(*) - 300) // 4 AS size FROM cal), range(4) r(fold) WHERE size > 0),
folds AS (SELECT CAST(fold AS INT) AS fold, (SELECT min(bar_date) FROM cal) AS train_start, (SELECT bar_date FROM cal WHERE i = v0 - 11) AS train_end, (SELECT bar_date FROM cal WHERE i = v0) AS val_start, (SELECT bar_date FROM cal WHERE i = v1) AS val_end FROM fl)"""
_BOTH = "pb AS MATERIALIZED (SELECT * FROM predictions WHERE predicted_return IS NOT NULL AND realized_return IS NOT NULL)"


def corr_(x, y):
    return f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"


def _ic(least=5):
    return f"SELECT as_of, count(*) AS n, CASE WHEN count(*) >= {least} THEN {corr_(X, Y)} END AS ic FROM pb GROUP BY 1"


def _rank(v):
    return f"CASE WHEN {v} IS NOT NULL THEN rank() OVER (PARTITION BY as_of ORDER BY {v} NULLS LAST) + (count(*) OVER (PARTITION BY as_of, {v}) - 1) / 2.0 END"


_RIC = f"SELECT as_of, count(*) AS n, CASE WHEN count(*) >= 5 THEN {corr_('x', 'y')} END AS rank_ic FROM (SELECT as_of, {_rank(X)} AS x, {_rank(Y)} AS y FROM pb) GROUP BY 1"


def _spread(n):
    return quint("pb", X, "as_of", n, f"b{n}", n) + f""", sp{n} AS (SELECT as_of, CASE WHEN count(*) > 1 THEN arg_max(m, b{n}) - arg_min(m, b{n}) END AS spread FROM (SELECT as_of, b{n}, avg(realized_return) AS m FROM q_b{n} WHERE b{n} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""


_EVAL = [fx.PREDICTIONS_SQL, _BOTH, _spread(10), f"days AS (SELECT i.*, q.rank_ic, s.spread, h, c FROM ({_ic()}) i JOIN ({_RIC}) q USING (as_of) LEFT JOIN sp10 s USING (as_of) JOIN (SELECT as_of, sum(CAST(sign(predicted_return) = sign(realized_return) AS DOUBLE)) AS h, count(*) AS c FROM pb GROUP BY 1) USING (as_of))"]
_EVCOLS = {"mean_ic": "avg(ic)", "std_ic": "stddev_samp(ic)", "t_ic": "avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic))", "mean_rank_ic": "avg(rank_ic)", "mean_spread": "avg(spread)", "hit_rate": "sum(h) / sum(c)"}


def _evals(names):
    return ", ".join(r(_EVCOLS[n], n) for n in names)


_SPAN = f"as_of >= DATE '{DAY}' - {(7 * 252 + 4) // 5 + 3} AND as_of <= DATE '{DAY}'"
#: The settled predictions of a year, in place of all of them; those of the last ten days count as open.
_YEAR = [
    fx.PREDICTIONS_SQL, f"n AS (SELECT count(*) AS n_predictions, count(*) FILTER (as_of <= DATE '{DAY}' - 10 AND realized_return IS NOT NULL) AS n_settled FROM predictions WHERE {_SPAN})",
    f"pb AS MATERIALIZED (SELECT *, 1 AS one FROM predictions WHERE realized_return IS NOT NULL AND {_SPAN} AND as_of <= DATE '{DAY}' - 10)", *_EVAL[2:],
    quint("pb", X, "one", 10, "pool", 10), quint("pb", Y, "as_of", 5, "realized_quintile", 5),
]
_NUM = "CAST(regexp_extract(symbol, '([0-9]+)', 1) AS INT)"
_FOLDROWS = "fr AS (SELECT symbol AS trial, year(as_of) AS fold, avg(realized_return) AS metric, count(*) AS n_rows, count(*) * 3 AS train_rows FROM pb GROUP BY 1, 2)"
_SCORE = "predicted_return * (1 + coalesce(top_p, 0) - coalesce(bot_p, 0))"
_P = [fx.PREDICTIONS_SQL]
SQL = {
    "pn1_build_panel": PANEL_SQL,
    "pn3_inference_slice": fx.sql(f"SELECT symbol, bar_date, {r('r5', 'price__log_return_5d')}, {r('r1', 'price__log_return_1d')} FROM lr WHERE bar_date = DATE '{DAY}' AND symbol IN (SELECT symbol FROM membership WHERE universe = 'US' AND DATE '{DAY}' BETWEEN start_date AND coalesce(end_date, DATE '9999-12-31'))", fx.MEMBERS_SQL, PRICE_SQL),
    "pn4_batch_slice": fx.sql(f"SELECT symbol, bar_date, {r('r5', 'price__log_return_5d')} FROM lr b WHERE day(bar_date) = 1 AND {_IN}", fx.MEMBERS_SQL, PRICE_SQL),
    "lb1_forward_return": fx.sql(f"SELECT symbol, bar_date, {r('fwd', 'fwd_return_5d')} FROM fw", FWD), "lb2_quantile_label": fx.sql("SELECT symbol, bar_date, quintile FROM q_quintile", *_LB),
    "lb3_training_set": fx.sql(f"SELECT {_TS} FROM ts", *_LB), "snk3_training_panel": fx.sql(f"SELECT {_TS}, CAST(year(bar_date) AS INT) AS year FROM ts", *_LB), "lb5_trainable_rows": fx.sql(f"SELECT {_TS} FROM ts WHERE in_universe AND quintile IS NOT NULL", *_LB),
    "lb4_label_stats": fx.sql(f"SELECT quintile, count(*) AS n, {r('avg(fwd_return_5d)', 'mean')}, {r('stddev_samp(fwd_return_5d)', 'std')}, {r('count(*) / sum(count(*)) OVER ()', 'share')} FROM ts WHERE in_universe AND quintile IS NOT NULL GROUP BY 1", *_LB),
    "lb6_clean_features": "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS event_type FROM events",
    "sp1_purged_folds": fx.sql("SELECT * FROM folds", _CAL, _FOLDS),
    "sp1_fold_rows": fx.sql("SELECT fold, part, count(*) AS n, min(bar_date) AS first_date, max(bar_date) AS last_date FROM (SELECT fold, b.bar_date, CASE WHEN b.bar_date BETWEEN train_start AND train_end THEN 'train' WHEN b.bar_date BETWEEN val_start AND val_end THEN 'val' END AS part FROM bars b, folds) WHERE part IS NOT NULL GROUP BY 1, 2", _CAL, _FOLDS),
    "sp2_retrain_dates": fx.sql("SELECT CAST(date_trunc('month', bar_date) AS DATE) AS month, min(bar_date) AS retrain_date FROM bars GROUP BY 1"),
    "sp3_walk_forward_windows": fx.sql("""SELECT rd - 730 AS train_start, rd AS train_end, rd AS predict_from, pt AS predict_to FROM (SELECT rd, coalesce(lead(rd) OVER (ORDER BY rd) - 1, (SELECT max(bar_date) FROM bars)) AS pt FROM (SELECT min(bar_date) AS rd FROM bars GROUP BY date_trunc('month', bar_date)))
      WHERE pt NOT IN (SELECT last_day(bar_date) FROM bars WHERE month(bar_date) <= 6)"""),
    "sp4_chronological_parts": fx.sql(f"SELECT symbol, bar_date, CASE WHEN bar_date > DATE '{DAY}' - 300 THEN 'holdout' WHEN bar_date > DATE '{DAY}' - 450 THEN 'calibration' ELSE 'train' END AS part FROM bars WHERE bar_date <= DATE '{DAY}'"),
    "ev1_daily_ic": fx.sql(f"SELECT as_of, n, {r('ic', 'ic')} FROM ({_ic()})", *_P, _BOTH), "ev2_daily_rank_ic": fx.sql(f"SELECT as_of, n, {r('rank_ic', 'rank_ic')} FROM ({_RIC})", *_P, _BOTH),
    "ev3_hit_rate": fx.sql(f"SELECT symbol, {r('avg(CAST(sign(predicted_return) = sign(realized_return) AS DOUBLE))', 'hit_rate')}, {r('avg(CAST(predicted_return * realized_return > 0 AS DOUBLE))', 'product_rate')} FROM pb GROUP BY 1", *_P, _BOTH),
    "ev4_spread": fx.sql(f"SELECT as_of, {r('spread', 'spread')} FROM sp5", *_P, _BOTH, _spread(5)),
    "ev5_evaluate_predictions": fx.sql(f"SELECT {_evals(_EVCOLS)}, count(ic) AS n_dates FROM days", *_EVAL),
    "ev6_brier_skill": fx.sql(f"SELECT {r('b', 'brier')}, {r(repr((1 - 1 / 3) ** 2 + 2 / 9), 'baseline')}, {r(f'1 - b / {(1 - 1 / 3) ** 2 + 2 / 9!r}', 'skill')} FROM (SELECT avg(pow(top_p / 2 - CAST(l = 0 AS INT), 2) + pow(bot_p / 2 - CAST(l = 1 AS INT), 2) + pow(0.5 - CAST(l = 2 AS INT), 2)) AS b FROM (SELECT *, floor(top_p * 10 % 3) AS l FROM predictions))", *_P),
    "ev7_fold_metrics": fx.sql(f"SELECT {r('avg(ic)', 'mean_ic')}, {r('stddev_pop(ic)', 'std_ic')}, {r('avg(hit)', 'mean_hit')}, {r('stddev_pop(hit)', 'std_hit')}, count(*) AS n_folds FROM (SELECT fold, {corr_(X, Y)} AS ic, avg(CAST(sign(predicted_return) = sign(realized_return) AS DOUBLE)) AS hit FROM pb, folds WHERE as_of BETWEEN val_start AND val_end GROUP BY 1)", *_P, _BOTH, _CAL, _FOLDS),
    "ev8_monthly_summary": fx.sql(f"SELECT CAST(date_trunc('month', as_of) AS DATE) AS month, {_evals(['mean_ic', 'mean_rank_ic', 'mean_spread', 'hit_rate'])}, count(ic) AS n_dates FROM days GROUP BY 1", *_EVAL),
    "gt1_promote_gate": fx.sql(f"SELECT symbol, {r('n', 'new_metric')}, {r('b', 'base_metric')}, CASE WHEN n IS NULL THEN 'retain' WHEN b IS NULL OR n >= 0.8 * b THEN 'promote' ELSE 'retain' END AS decision FROM (SELECT symbol, CASE WHEN {_NUM} % 7 <> 0 THEN {corr_(X, Y)} END AS n, CASE WHEN {_NUM} % 5 <> 0 THEN -0.5 END AS b FROM pb GROUP BY 1)", *_P, _BOTH),
    "gt2_trial_objective": fx.sql(f"""SELECT trial, {r('CASE WHEN NOT short AND NOT odd THEN o END', 'objective')}, short OR odd AS rejected FROM (SELECT trial, avg(metric) AS o, min(train_rows) < 75 AS short, coalesce(max((metric - m) / nullif(s, 0)) > 1.5, false) AS odd FROM
      (SELECT a.*, (SELECT avg(b.metric) FROM fr b WHERE b.trial = a.trial AND b.fold <> a.fold AND b.n_rows >= 20) AS m, (SELECT stddev_samp(b.metric) FROM fr b WHERE b.trial = a.trial AND b.fold <> a.fold AND b.n_rows >= 20) AS s FROM fr a WHERE n_rows >= 20) GROUP BY 1)""", *_P, _BOTH, _FOLDROWS),
    "gt3_group_verdict": fx.sql(f"""SELECT config, {r('avg(lift)', 'mean_lift')}, {r('min(lift)', 'worst_lift')}, CASE WHEN avg(lift) > 0 AND min(lift) > -0.005 AND sign(avg(spread)) = sign(avg(bs)) THEN 'SHIP' ELSE 'HOLD' END AS verdict FROM
      (SELECT a.config, a.ic - b.ic AS lift, a.spread, b.spread AS bs FROM rs a JOIN rs b ON a.seed = b.seed AND b.config = 'baseline' WHERE a.config <> 'baseline') GROUP BY 1""", *_P, _BOTH, f"rs AS (SELECT CASE WHEN {_NUM} % 4 = 0 THEN 'baseline' ELSE 'c' || ({_NUM} % 4) END AS config, year(as_of) % 3 AS seed, {corr_(X, Y)} AS ic, avg(realized_return) AS spread FROM pb GROUP BY 1, 2)"),
    "gt4_multi_seed_objective": fx.sql(f"SELECT CAST(regexp_extract(trial, '([0-9]+)', 1) AS INT) % 6 AS trial, {r('CASE WHEN NOT bool_or(n_rows < 8) THEN avg(metric) END', 'objective')} FROM fr GROUP BY 1", *_P, _BOTH, _FOLDROWS),
    "dr1_drift_check": fx.sql(f"SELECT {r('m', 'mean_rank_ic')}, run_below, n_days, coalesce(m < -0.005 OR (m < 0.005 AND run_below >= 10), false) AS drift FROM (SELECT avg(rank_ic) AS m, CAST(coalesce(min(k) FILTER (rank_ic >= 0.005) - 1, count(*)) AS INT) AS run_below, count(*) AS n_days FROM (SELECT *, row_number() OVER (ORDER BY as_of DESC) AS k FROM ({_RIC}) WHERE rank_ic IS NOT NULL AND as_of <= DATE '{DAY}' ORDER BY as_of DESC LIMIT 20))", *_P, _BOTH),
    "pr1_conviction": fx.sql(f"SELECT symbol, as_of, {r(_SCORE, 'score')} FROM predictions", *_P),
    "pr2_rank_predictions": fx.sql(f"""SELECT as_of, symbol, {r(X, X)}, unnest(list_filter([CASE WHEN t <= 3 THEN 'top' END, CASE WHEN b <= 3 THEN 'bottom' END, CASE WHEN top_p >= 0.9 THEN 'confident_long' END, CASE WHEN bot_p >= 0.9 THEN 'confident_short' END], lambda x: x IS NOT NULL)) AS list
      FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY predicted_return DESC, symbol) AS t, row_number() OVER (PARTITION BY as_of ORDER BY predicted_return, symbol) AS b FROM predictions)""", *_P),
    "pr3_top_picks": fx.sql(f"SELECT p.symbol, as_of, {rs([X, Y, 'top_p', 'bot_p', 'score'])}, company_name FROM (SELECT *, {_SCORE} AS score FROM pb WHERE as_of = (SELECT max(as_of) FROM pb) ORDER BY score DESC, symbol LIMIT 5) p LEFT JOIN (SELECT {fx.SYMBOL_SQL} AS symbol, min(p_name) AS company_name FROM part GROUP BY 1) USING (symbol)", *_P, _BOTH),
    "pr4_side_picks": fx.sql(f"""SELECT as_of, side, k, symbol, {r('score', 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY as_of, side ORDER BY abs(score) DESC, symbol) AS k FROM (SELECT *, CASE WHEN predicted_return > 0 AND score > 0 THEN 'long' WHEN predicted_return < 0 AND score < 0 THEN 'short' END AS side FROM
      (SELECT *, {_SCORE} AS score FROM predictions)) WHERE side IS NOT NULL) WHERE k <= 3""", *_P),
    "pr5_symbol_history": fx.sql(f"SELECT as_of, {rs([X, Y])} FROM predictions WHERE symbol = 'Brand#7' AND as_of >= '1997-01-01'", *_P),
    "pr6_settle": fx.sql(f"SELECT symbol, as_of, {r('z', 'realized')}, settled_at FROM predictions JOIN (SELECT symbol, bar_date AS as_of, lead(ln(close), 5) OVER w - ln(close) AS z, lead(bar_date, 5) OVER w AS settled_at FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)) USING (symbol, as_of) WHERE as_of <= DATE '{DAY}' - 5 AND settled_at <= DATE '{DAY}'", *_P),
    "pr7_settle_quintiles": fx.sql("SELECT symbol, as_of, realized_quintile FROM q_realized_quintile", *_P, _BOTH, quint("pb", Y, "as_of", 5, "realized_quintile", 5)),
    "pr8_performance_summary": fx.sql(f"""SELECT n_predictions, n_settled, {_evals(['mean_ic', 'std_ic', 't_ic', 'mean_rank_ic', 'hit_rate'])}, count(ic) AS n_dates,
      {r("(SELECT arg_max(m, pool) - arg_min(m, pool) FROM (SELECT pool, avg(realized_return) AS m FROM q_pool GROUP BY 1))", "decile_spread")} FROM days, n GROUP BY n_predictions, n_settled""", *_YEAR),
    "pr8_calibration": fx.sql(f"""SELECT CAST(CASE WHEN top_p > 0.8 THEN 4 WHEN top_p > 0.6 THEN 3 WHEN top_p > 0.4 THEN 2 WHEN top_p > 0.2 THEN 1 ELSE 0 END AS INT) AS bin, count(*) AS n,
      {r("avg(top_p)", "mean_proba")}, {r("avg(CAST(coalesce(realized_quintile = (SELECT max(realized_quintile) FROM q_realized_quintile), false) AS DOUBLE))", "observed_rate")}
      FROM q_realized_quintile GROUP BY 1""", *_YEAR),
    "pr9_missing_dates": fx.sql("SELECT DISTINCT bar_date AS as_of FROM bars WHERE bar_date NOT IN (SELECT as_of FROM predictions WHERE day(as_of) > 3)", *_P),
    "pr10_shared_range": fx.sql("SELECT count(*) AS n_dates, min(as_of) AS first_date, max(as_of) AS last_date FROM (SELECT as_of FROM predictions WHERE symbol = 'Brand#1' INTERSECT SELECT as_of FROM predictions WHERE symbol = 'Brand#2')", *_P),
    "pr11_trailing_returns": fx.sql(f"SELECT symbol, {r('max(ln(close)) FILTER (k = 1) - max(ln(close)) FILTER (k = 6)', 'ret_5')}, {r('max(ln(close)) FILTER (k = 1) - max(ln(close)) FILTER (k = 21)', 'ret_20')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) AS k FROM bars WHERE bar_date <= DATE '{DAY}') GROUP BY 1"),
    "ca1_calibration_table": fx.sql(f"SELECT CAST(greatest(ceil(top_p * 5) - 1, 0) AS INT) AS bin, count(*) AS n, {r('avg(top_p)', 'mean_p')}, {r('avg(CAST(realized_quintile = 4 AS DOUBLE))', 'observed')} FROM q_realized_quintile WHERE realized_quintile IS NOT NULL GROUP BY 1", *_P, _BOTH, quint("pb", Y, "as_of", 5, "realized_quintile", 2)),
    "ca2_ic_timeseries": fx.sql(f"SELECT as_of, n, {r('ic', 'ic')} FROM ({_ic(3)}) WHERE ic IS NOT NULL", *_P, _BOTH),
    "ca3_directional_accuracy": fx.sql(f"SELECT count(*) AS n, {r('avg(CAST(sign(predicted_return) = sign(realized_return) AS DOUBLE))', 'accuracy')} FROM pb WHERE abs(predicted_return) > 0.001", *_P, _BOTH),
}
