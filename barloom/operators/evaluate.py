"""Information coefficients, spreads, calibration, gates and drift, as aggregates by date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import average_rank
from .labels import bucket, quantile_bucket
from .ordered import Cut, quantiles


def _corr(x: str, y: str) -> Column:
    return F.covar_samp(x, y) / F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0))


def daily_ic(df: DataFrame, x: str, y: str, *, date: str = "as_of", least: int = 5) -> DataFrame:
    """(date, n, ic): Pearson correlation of rows that have both values; null without spread or with few rows."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both.groupBy(date).agg(F.count("*").alias("n"), _corr(x, y).alias("ic"))
    return out.withColumn("ic", F.when(F.col("n") >= least, F.col("ic")))


def daily_rank_ic(df: DataFrame, x: str, y: str, *, date: str = "as_of", least: int = 5) -> DataFrame:
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(date, x, y)
    ranked = both.withColumns({"_x": average_rank(x, date), "_y": average_rank(y, date)})
    return daily_ic(ranked, "_x", "_y", date=date, least=least).withColumnRenamed("ic", "rank_ic")


def hit_rate(x: str, y: str) -> Column:
    """Aggregate: share of equal signs; zero equals zero."""
    return F.avg((F.signum(x) == F.signum(y)).cast("double"))


def decile_spread(df: DataFrame, x: str, y: str, *, date: str = "as_of", n: int = 10) -> DataFrame:
    """(date, spread): mean y of the top bucket of x minus that of the bottom one; needs n rows and two buckets."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(date, x, y)
    b = quantile_bucket(both, x, [date], n, "_b").filter("_b is not null")
    top = b.groupBy(date, "_b").agg(F.sum(y).alias("s"), F.count(y).alias("c"))
    out = top.groupBy(date).agg(F.max_by(F.col("s") / F.col("c"), "_b").alias("hi"), F.min_by(F.col("s") / F.col("c"), "_b").alias("lo"), F.count("*").alias("k"))
    return out.select(date, F.when(F.col("k") > 1, F.col("hi") - F.col("lo")).alias("spread"))


def evaluate_predictions(df: DataFrame, x: str = "predicted_return", y: str = "realized_return", *, date: str = "as_of", by: list[Column] | None = None) -> DataFrame:
    """Mean, deviation and t of the daily IC, mean rank IC and spread, pooled hit rate, dates; over all dates or by ``by`` (columns of the date)."""
    days = daily_ic(df, x, y, date=date).join(daily_rank_ic(df, x, y, date=date).drop("n"), date).join(decile_spread(df, x, y, date=date), date, "left")
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    hits = both.groupBy(date).agg(F.sum((F.signum(x) == F.signum(y)).cast("double")).alias("_h"), F.count("*").alias("_c"))
    days = days.join(hits, date)
    keys = by or []
    n = F.count("ic")
    out = days.groupBy(*keys).agg(
        F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), (F.avg("ic") / F.nullif(F.stddev_samp("ic"), F.lit(0.0)) * F.sqrt(n)).alias("t_ic"), F.avg("rank_ic").alias("mean_rank_ic"),
        F.avg("spread").alias("mean_spread"), (F.sum("_h") / F.sum("_c")).alias("hit_rate"), n.alias("n_dates"),
    )
    return out


def monthly_summary(df: DataFrame, x: str = "predicted_return", y: str = "realized_return", *, date: str = "as_of") -> DataFrame:
    """By month of the date: mean IC, rank IC and spread, pooled hit rate, number of dates with an IC."""
    out = evaluate_predictions(df, x, y, date=date, by=[F.trunc(date, "month").alias("month")])
    return out.select("month", "mean_ic", "mean_rank_ic", "mean_spread", "hit_rate", "n_dates")


def pooled_spread(df: DataFrame, x: str, y: str, cut: Cut, n: int = 10) -> DataFrame:
    """One row (spread): mean y of the top one of ``n`` quantile buckets of x over all rows, minus that of the bottom one.

    Null with fewer than ``n`` rows or two buckets.  Bounds that coincide are one.
    """
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    bounds = quantiles(both, x, n, cut).select(F.array_distinct("bounds").alias("_e"))
    b = both.crossJoin(F.broadcast(bounds)).withColumn("_b", bucket(F.col(x), F.col("_e")))  # one row of n + 1 numbers
    means = b.groupBy("_b").agg(F.avg(y).alias("m"), F.count("*").alias("c"))
    return means.agg(F.when((F.sum("c") >= n) & (F.count("_b") > 1), F.max_by("m", "_b") - F.min_by("m", "_b")).alias("spread"))


def calibration_bins(df: DataFrame, p: str, hit: Column, edges: Sequence[float] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """(bin, n, mean_proba, observed_rate) by right-closed bins of a probability; bins without rows are missing, the lowest takes 0."""
    at = sum((F.col(p) > e).cast("int") for e in edges)
    rows = df.filter(F.col(p).between(0, 1))
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_proba"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("observed_rate"))


def performance_summary(
    df: DataFrame, as_of, cut: Cut, days: int = 252, x: str = "predicted_return", y: str = "realized_return", *, p: str = "top_p", quintile: str = "realized_quintile"
) -> DataFrame:
    """One row over the settled predictions of about ``days`` trading days up to ``as_of``.

    (n_predictions, n_settled, mean_ic, std_ic, t_ic, mean_rank_ic, hit_rate,
    n_dates, decile_spread, calibration): the spread pools all dates;
    ``calibration`` lists the bins of the probability ``p`` with their rows, mean
    probability and the share in the top class of ``quintile`` (the largest
    seen).  Seven calendar days count for five trading days, plus three for
    holidays.  Without settled rows the counts are 0, all else null or empty.
    """
    end = F.lit(as_of).cast("date")
    recent = df.filter((F.col("as_of") >= F.date_sub(end, (7 * days + 4) // 5 + 3)) & (F.col("as_of") <= end))
    settled = recent.filter(F.col(y).isNotNull())
    daily = evaluate_predictions(settled, x, y).drop("mean_spread")
    counts = recent.agg(F.count("*").alias("n_predictions"), F.count(y).alias("n_settled"))
    most = settled.agg(F.max(quintile).alias("_most"))
    bins = calibration_bins(settled.crossJoin(F.broadcast(most)), p, F.col(quintile) == F.col("_most"))
    table = bins.agg(F.sort_array(F.collect_list(F.struct("bin", "n", "mean_proba", "observed_rate"))).alias("calibration"))  # five bins
    out = counts
    for one in (daily, pooled_spread(settled, x, y, cut).withColumnRenamed("spread", "decile_spread"), table):
        out = out.crossJoin(F.broadcast(one))  # tables of one row
    return out


def ic_timeseries(df: DataFrame, x: str = "predicted_return", y: str = "realized_return", *, least: int = 3) -> DataFrame:
    """(as_of, n, ic) of the dates that have one."""
    return daily_ic(df, x, y, least=least).filter("ic is not null")


def brier(probs: str, label: str) -> Column:
    """Squared distance of a probability array to the one-hot of its label, per row."""
    return F.aggregate(F.transform(probs, lambda p, i: F.pow(p - (i == F.col(label)).cast("double"), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)


def brier_skill(df: DataFrame, probs: str, label: str, n: int) -> DataFrame:
    """Mean Brier score, that of the uniform forecast, and 1 - ratio."""
    base = (1 - 1 / n) ** 2 + (n - 1) / n**2
    return df.agg(F.avg(brier(probs, label)).alias("brier")).withColumn("baseline", F.lit(base)).withColumn("skill", 1 - F.col("brier") / base)


def fold_metrics(df: DataFrame, x: str, y: str) -> DataFrame:
    """Per fold IC and hit rate, with their mean and population deviation over folds."""
    f = df.groupBy("fold").agg(_corr(x, y).alias("ic"), hit_rate(x, y).alias("hit"))
    return f.agg(F.avg("ic").alias("mean_ic"), F.stddev_pop("ic").alias("std_ic"), F.avg("hit").alias("mean_hit"), F.stddev_pop("hit").alias("std_hit"), F.count("*").alias("n_folds"))


def promote_gate(metrics: DataFrame, share: float = 0.8) -> DataFrame:
    """(.., decision): promote at ``share`` of the baseline or without one; a missing new value keeps the old model."""
    d = F.when(F.col("new_metric").isNull(), "retain").when(F.col("base_metric").isNull() | (F.col("new_metric") >= share * F.col("base_metric")), "promote").otherwise("retain")
    return metrics.withColumn("decision", d)


def trial_objective(folds: DataFrame, *, least_rows: int, least_train: int, most_z: float = 2.5) -> DataFrame:
    """(trial, objective, rejected): mean metric of large folds; rejected if training was short or one fold lies over ``most_z`` deviations above the others."""
    big = folds.filter(F.col("n_rows") >= least_rows)
    w = Window.partitionBy("trial")
    n, s, q = F.count("metric").over(w), F.sum("metric").over(w), F.sum(F.col("metric") * F.col("metric")).over(w)
    m = (s - F.col("metric")) / F.nullif(n - 1, F.lit(0))
    var = (q - F.col("metric") * F.col("metric") - (n - 1) * m * m) / F.nullif(n - 2, F.lit(0))
    z = (F.col("metric") - m) / F.nullif(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0))
    out = big.withColumn("_z", z).groupBy("trial").agg(F.avg("metric").alias("objective"), (F.min("train_rows") < least_train).alias("_short"), F.coalesce(F.max("_z") > most_z, F.lit(False)).alias("_odd"))
    return out.select("trial", F.when(~F.col("_short") & ~F.col("_odd"), F.col("objective")).alias("objective"), (F.col("_short") | F.col("_odd")).alias("rejected"))


def group_verdict(results: DataFrame, worst: float = -0.005) -> DataFrame:
    """(config, mean_lift, worst_lift, verdict) of (config, seed, ic, spread) against the config ``baseline``."""
    base = results.filter("config = 'baseline'").select("seed", F.col("ic").alias("_i"), F.col("spread").alias("_s"))
    j = results.filter("config <> 'baseline'").join(base, "seed").withColumn("lift", F.col("ic") - F.col("_i"))
    g = j.groupBy("config").agg(F.avg("lift").alias("mean_lift"), F.min("lift").alias("worst_lift"), (F.signum(F.avg("spread")) == F.signum(F.avg("_s"))).alias("_same"))
    v = F.when((F.col("mean_lift") > 0) & (F.col("worst_lift") > worst) & F.col("_same"), "SHIP").otherwise("HOLD")
    return g.select("config", "mean_lift", "worst_lift", v.alias("verdict"))


def multi_seed_objective(trials: DataFrame) -> DataFrame:
    """Mean over seeds; null if any seed was rejected."""
    return trials.groupBy("trial").agg(F.when(~F.bool_or("rejected"), F.avg("objective")).alias("objective"))


def drift_check(df: DataFrame, as_of, *, window: int = 20, hard: float = -0.005, soft: float = 0.005, run: int = 10, x: str = "predicted_return", y: str = "realized_return") -> DataFrame:
    """(mean_rank_ic, run_below, n_days, drift) over the last ``window`` dates with a rank IC up to ``as_of``."""
    days = daily_rank_ic(df.filter(F.col("as_of") <= F.lit(as_of).cast("date")), x, y).filter("rank_ic is not null")
    recent = days.orderBy(F.desc("as_of")).limit(window)
    k = recent.withColumn("k", F.row_number().over(Window.orderBy(F.desc("as_of"))))
    a = k.agg(F.avg("rank_ic").alias("mean_rank_ic"), F.coalesce(F.min(F.when(F.col("rank_ic") >= soft, F.col("k"))) - 1, F.count("*").cast("int")).alias("run_below"), F.count("*").alias("n_days"))
    return a.withColumn("drift", F.coalesce((F.col("mean_rank_ic") < hard) | ((F.col("mean_rank_ic") < soft) & (F.col("run_below") >= run)), F.lit(False)))
