"""Forward returns, quantile labels, training sets, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pit import flag_members


def forward_return(bars: DataFrame, h: int = 5, name: str | None = None) -> DataFrame:
    """Log return over the next ``h`` bars; null on the last ``h``."""
    w = Window.partitionBy("symbol").orderBy("bar_date")
    return bars.withColumn(name or f"fwd_return_{h}d", F.ln(F.lead("close", h).over(w) / F.col("close")))


def edges(x: Column, n: int) -> Column:
    """Aggregate: distinct bounds of ``n`` linear quantiles."""
    return F.array_distinct(F.percentile(x, F.array(*[F.lit(i / n) for i in range(n + 1)])))


def bucket(x: Column, e: Column) -> Column:
    """Right-closed bucket of x among bounds, the lowest value in the first; null with fewer than two bounds."""
    return F.when(x.isNotNull() & (F.size(e) > 1), F.greatest(F.lit(0), F.size(F.filter(e, lambda v: v < x)) - 1))


def quantile_bucket(df: DataFrame, x: str, by: list[str], n: int, out: str, least: int | None = None) -> DataFrame:
    """``df`` with the bucket of ``x`` within ``by``; null where fewer than ``least`` (default n) values are there.

    Bounds are one small row per group, joined back on the group.
    """
    e = df.groupBy(*by).agg(edges(F.col(x), n).alias("_e"), F.count(x).alias("_n")).filter(F.col("_n") >= (least or n))
    return df.join(e.select(*by, "_e"), by, "left").withColumn(out, bucket(F.col(x), F.col("_e"))).drop("_e")


def quantile_label(panel: DataFrame, mem: DataFrame, x: str, n: int = 5, out: str = "quintile") -> DataFrame:
    """Buckets among members with a value on the date; null for others."""
    flagged = flag_members(panel, mem, "_in").withColumn("_x", F.when(F.col("_in"), F.col(x)))
    return quantile_bucket(flagged, "_x", ["bar_date"], n, out).drop("_x", "_in")


def training_set(panel: DataFrame, labels: DataFrame, mem: DataFrame) -> DataFrame:
    """Panel with labels by key and the membership flag."""
    return flag_members(panel.join(labels, ["symbol", "bar_date"], "left"), mem)


def label_stats(df: DataFrame, value: str, cls: str) -> DataFrame:
    """Per class: rows, share, mean and deviation of the value."""
    total = Window.partitionBy()
    out = df.groupBy(cls).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(total))  # one row per class


def trainable_rows(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col("in_universe") & F.col(label).isNotNull())


def clean_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers as doubles; what is no finite number becomes null."""
    def one(c):
        x = F.expr(f"try_cast({c} as double)")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)

    return df.withColumns({c: one(c) for c in columns})


def purged_folds(dates: DataFrame, *, n: int = 5, h: int = 5, embargo: int = 5, min_train: int = 504) -> DataFrame:
    """(fold, train_start, train_end, val_start, val_end) over the distinct dates: expanding training, a gap of max(h, embargo) dates, the last fold takes the remainder.

    The calendar is one row per date; numbering it is the only single ordered
    pass.  Too few dates give no folds.
    """
    cal = dates.select("bar_date").distinct().withColumn("i", F.row_number().over(Window.orderBy("bar_date")) - 1)
    total = cal.agg(F.count("*").alias("t"))
    size = F.floor((F.col("t") - min_train) / n)
    folds = total.filter(size > 0).select("t", size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("fold"))
    v0 = min_train + F.col("fold") * F.col("size")
    v1 = F.when(F.col("fold") == n - 1, F.col("t") - 1).otherwise(v0 + F.col("size") - 1)
    ends = folds.select("fold", (v0 - max(h, embargo) - 1).alias("te"), v0.alias("v0"), v1.alias("v1"))
    out = ends.select("fold", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("int").alias("i")) for k, c in (("train_end", "te"), ("val_start", "v0"), ("val_end", "v1"))])).alias("x")).select("fold", "x.k", "x.i")
    wide = cal.join(F.broadcast(out), "i").groupBy("fold").pivot("k", ["train_end", "val_start", "val_end"]).agg(F.first("bar_date"))
    first = cal.filter("i = 0").select(F.col("bar_date").alias("train_start"))
    return wide.crossJoin(F.broadcast(first)).select("fold", "train_start", "train_end", "val_start", "val_end")


def assign_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with fold and part (train or val), in place of columns of these names; the fold table has one row per fold."""
    d = F.col("bar_date")
    part = F.when(d.between(F.col("train_start"), F.col("train_end")), "train").when(d.between(F.col("val_start"), F.col("val_end")), "val")
    return df.drop("fold", "part").join(F.broadcast(folds), d <= F.col("val_end")).withColumn("part", part).filter("part is not null").drop("train_start", "train_end", "val_start", "val_end")


def retrain_dates(dates: DataFrame) -> DataFrame:
    """First trading day of each month."""
    return dates.groupBy(F.trunc("bar_date", "month").alias("month")).agg(F.min("bar_date").alias("retrain_date"))


def walk_forward_windows(dates: DataFrame, lookback_days: int, done: DataFrame) -> DataFrame:
    """(train_start, train_end, predict_from, predict_to): training up to each retrain date, predictions until the next; windows whose last day is in ``done`` are left out."""
    r = retrain_dates(dates)
    last = dates.agg(F.max("bar_date").alias("_last"))
    nxt = F.lead("retrain_date").over(Window.orderBy("retrain_date"))
    w = r.crossJoin(F.broadcast(last)).select(F.date_sub("retrain_date", lookback_days).alias("train_start"), F.col("retrain_date").alias("train_end"), F.col("retrain_date").alias("predict_from"), F.coalesce(F.date_sub(nxt, 1), "_last").alias("predict_to"))
    return w.join(done.select(F.col("last_day").alias("predict_to")), "predict_to", "left_anti").select("train_start", "train_end", "predict_from", "predict_to")


def chronological_parts(df: DataFrame, end, *, holdout: int = 60, calibration: int = 30) -> DataFrame:
    """Rows up to ``end`` with part: holdout (last days), calibration (days before it), train."""
    e = F.lit(end).cast("date")
    part = F.when(F.col("bar_date") > F.date_sub(e, holdout), "holdout").when(F.col("bar_date") > F.date_sub(e, holdout + calibration), "calibration").otherwise("train")
    return df.filter(F.col("bar_date") <= e).withColumn("part", part)
