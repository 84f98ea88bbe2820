"""Cleaning rules, source audits, health of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = {"NYSE": (5.0, 700.0), "NSE": (10.0, 900.0)}  # least volume and close in the queries


def broken(*, high="high", low="low", open_="open", close="close") -> Column:
    """OHLC rules: the high is the highest, the low the lowest."""
    h, lo, o, c = (F.col(x) for x in (high, low, open_, close))
    return F.coalesce((h < o) | (h < c) | (h < lo) | (lo > o) | (lo > c), F.lit(False))


def split_valid_bars(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    return bars.filter(~broken()), bars.filter(broken())


def big_move(hi: float, lo: float) -> Column:
    w = Window.partitionBy("symbol", "exchange").orderBy("bar_date", "ingested_at")
    ratio = F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0))
    return F.coalesce((ratio > hi) | (ratio < lo), F.lit(False))


def drop_big_moves(bars: DataFrame, hi: float = 1.5, lo: float = 0.67) -> DataFrame:
    return bars.withColumn("_b", big_move(hi, lo)).filter("not _b").drop("_b")


def below(kind: int, column: str, thresholds: dict = THRESHOLDS) -> Column:
    least = F.coalesce(*[F.when(F.col("exchange") == e, F.lit(v[kind])) for e, v in thresholds.items()])
    return F.coalesce(F.col(column) < least, F.lit(False))


def drop_illiquid(bars: DataFrame, thresholds: dict = THRESHOLDS) -> DataFrame:
    return bars.filter(~below(0, "volume", thresholds))


def drop_penny(bars: DataFrame, thresholds: dict = THRESHOLDS) -> DataFrame:
    return bars.filter(~below(1, "close", thresholds))


def cleaning_report(bars: DataFrame, hi: float = 1.5, lo: float = 0.67) -> DataFrame:
    """Rows before, removed by each rule in turn, and after, in one pass over the flagged rows."""
    good = bars.filter(~broken()).withColumn("_m", big_move(hi, lo))
    all_ = bars.withColumn("_bad", broken())
    flags = good.withColumns({"_i": ~F.col("_m") & below(0, "volume"), "_p": ~F.col("_m") & ~below(0, "volume") & below(1, "close")})
    one = all_.agg(F.count("*").alias("before"), F.count_if("_bad").alias("broken"))
    two = flags.agg(F.count_if("_m").alias("big_moves"), F.count_if("_i").alias("illiquid"), F.count_if("_p").alias("penny"), F.count_if(~F.col("_m") & ~F.col("_i") & ~F.col("_p")).alias("after"))
    return one.crossJoin(two)  # one row each


def drop_ghost_membership(mem: DataFrame, bars: DataFrame, denied: list[str]) -> DataFrame:
    """Members that are not denied and have a bar on their exchange."""
    return mem.filter(~F.col("symbol").isin(denied)).join(bars.select("symbol", "exchange").distinct(), ["symbol", "exchange"], "left_semi")


def symbol_sanity(bars: DataFrame, mem: DataFrame, *, least_bars: int = 100, most_move: float = 0.8, least_volume: float = 1000.0) -> DataFrame:
    """(symbol, n_bars, reason): why a symbol is rejected, or ``ok``; bars are matched to membership intervals."""
    w = Window.partitionBy("symbol").orderBy("bar_date")
    r = bars.withColumn("_r", F.abs(F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1))
    spans = mem.groupBy("symbol").agg(F.collect_list(F.struct("start_date", "end_date")).alias("_s"))
    r = r.join(spans, "symbol", "left").withColumn("_in", F.coalesce(F.exists("_s", lambda s: (F.col("bar_date") >= s.start_date) & (s.end_date.isNull() | (F.col("bar_date") <= s.end_date))), F.lit(False)))
    a = r.groupBy("symbol").agg(F.count("*").alias("n_bars"), F.max("_r").alias("_mv"), F.count_if("_in").alias("_n"), F.expr("percentile(volume, 0.5) filter (where _in)").alias("_vol"))
    reason = F.when(F.col("n_bars") < least_bars, "few_bars").when(F.col("_mv") > most_move, "big_move").when(F.col("_n") == 0, "outside_membership").when(F.col("_vol") < least_volume, "thin").otherwise("ok")
    return a.select("symbol", "n_bars", reason.alias("reason"))


def compare_sources(bars: DataFrame, tolerance_pct: float) -> DataFrame:
    """Closes of two sources on one date that differ by more than the tolerance, with the likely cause."""
    a = bars.select("symbol", "bar_date", *[F.col(c).alias(f"{c}_a") for c in ("source", "close", "close_unadj")])
    b = bars.select("symbol", "bar_date", *[F.col(c).alias(f"{c}_b") for c in ("source", "close", "close_unadj")])
    diff = 100 * F.abs(F.col("close_a") - F.col("close_b")) / F.nullif((F.col("close_a") + F.col("close_b")) / 2, F.lit(0.0))
    ratio = F.abs(F.col("close_unadj_a") / F.nullif(F.col("close_a"), F.lit(0.0)) - F.col("close_unadj_b") / F.nullif(F.col("close_b"), F.lit(0.0)))
    cause = F.when(F.col("diff_pct") > 30, "split").when(F.col("diff_pct").between(0.5, 5) & (ratio > 0.005), "dividend").otherwise("outlier")
    return a.join(b, ["symbol", "bar_date"]).filter("source_a < source_b").withColumn("diff_pct", diff).filter(F.col("diff_pct") > tolerance_pct).withColumn("cause", cause).select("symbol", "bar_date", "source_a", "source_b", "diff_pct", "cause")


def audit_sources(bars: DataFrame, members: DataFrame, *, as_of: str, lookback: int, tolerance_pct: float = 1.0) -> DataFrame:
    """Per member: number of differences before ``as_of``, the largest, the commonest cause (ties: first in the alphabet)."""
    day = F.lit(as_of).cast("date")
    d = compare_sources(bars.filter((F.col("bar_date") <= day) & (F.col("bar_date") > F.date_sub(day, lookback))).join(members.select("symbol").distinct(), "symbol", "left_semi"), tolerance_pct)
    by_cause = d.groupBy("symbol", "cause").agg(F.count("*").alias("n"), F.max("diff_pct").alias("m"))
    return by_cause.groupBy("symbol").agg(F.sum("n").alias("n_diffs"), F.max("m").alias("max_diff_pct"), F.min_by("cause", F.struct(-F.col("n"), F.col("cause"))).alias("modal_cause"))


def health_report(bars: DataFrame, mem: DataFrame, as_of: str) -> DataFrame:
    """Status of tables: GREEN, YELLOW or RED by row count and age of the newest bar."""
    day = F.lit(as_of).cast("date")
    one = bars.agg(F.lit("bars").alias("table_name"), F.count("*").alias("n_rows"), F.datediff(day, F.max("bar_date")).alias("age_days"))
    two = mem.filter("end_date is null").groupBy("universe").agg(F.count("*").alias("n_rows")).select(F.concat(F.lit("membership:"), "universe").alias("table_name"), "n_rows", F.lit(None).cast("int").alias("age_days"))
    status = F.when(F.col("n_rows") == 0, "RED").when(F.col("age_days").isNull() | (F.col("age_days") <= 5), "GREEN").when(F.col("age_days") <= 14, "YELLOW").otherwise("RED")
    return one.unionByName(two).withColumn("status", status)
