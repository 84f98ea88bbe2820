"""The prediction log: conviction, rankings, settlement, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labels import quantile_bucket


def conviction(ret: str = "predicted_return", top: str = "top_p", bot: str = "bot_p") -> Column:
    return F.col(ret) * (1 + F.coalesce(top, F.lit(0.0)) - F.coalesce(bot, F.lit(0.0)))


def rank_predictions(p: DataFrame, n: int, threshold: float = 0.5) -> DataFrame:
    """Rows in any of four lists per date: n best and worst by return, long and short by probability."""
    day = Window.partitionBy("as_of")
    out = p.withColumns({"_t": F.row_number().over(day.orderBy(F.desc("predicted_return"), "symbol")), "_b": F.row_number().over(day.orderBy("predicted_return", "symbol"))})
    lists = F.array_compact(F.array(F.when(F.col("_t") <= n, "top"), F.when(F.col("_b") <= n, "bottom"), F.when(F.col("top_p") >= threshold, "confident_long"), F.when(F.col("bot_p") >= threshold, "confident_short")))
    return out.withColumn("list", F.explode(lists)).select("as_of", "symbol", "predicted_return", "list")


def top_picks(p: DataFrame, names: DataFrame, *, direction: str = "long", limit: int = 5, as_of=None) -> DataFrame:
    """Best rows of a date (the latest by default) by conviction, ties by symbol, with names attached."""
    day = p.agg(F.max("as_of").alias("as_of")) if as_of is None else None
    rows = p.join(F.broadcast(day), "as_of") if day is not None else p.filter(F.col("as_of") == F.lit(as_of).cast("date"))
    rows = rows.withColumn("score", conviction())
    order = F.desc("score") if direction == "long" else F.asc("score")
    return rows.orderBy(order, "symbol").limit(limit).join(names, "symbol", "left")


def side_picks(p: DataFrame, n: int) -> DataFrame:
    """Per date the n strongest long rows (return and score positive) and short rows (both negative)."""
    s = p.withColumn("score", conviction())
    side = F.when((F.col("predicted_return") > 0) & (F.col("score") > 0), "long").when((F.col("predicted_return") < 0) & (F.col("score") < 0), "short")
    w = Window.partitionBy("as_of", "side").orderBy(F.desc(F.abs("score")), "symbol")
    return s.withColumn("side", side).filter("side is not null").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).select("as_of", "side", "k", "symbol", "score")


def symbol_history(p: DataFrame, symbol: str, since) -> DataFrame:
    return p.filter((F.col("symbol") == symbol) & (F.col("as_of") >= F.lit(since).cast("date"))).select("as_of", "predicted_return", "realized_return")


def settle(p: DataFrame, bars: DataFrame, as_of, h: int = 5) -> DataFrame:
    """Predictions old enough, with the log return at the h-th bar after their date; positive closes only, the bar of the date must exist."""
    w = Window.partitionBy("symbol").orderBy("bar_date")
    b = bars.filter("close > 0").select("symbol", F.col("bar_date").alias("as_of"), (F.ln(F.lead("close", h).over(w)) - F.ln("close")).alias("realized"), F.lead("bar_date", h).over(w).alias("settled_at"))
    due = p.filter(F.col("as_of") <= F.date_sub(F.lit(as_of).cast("date"), h))
    return due.join(b.filter(F.col("settled_at") <= F.lit(as_of).cast("date")), ["symbol", "as_of"]).select("symbol", "as_of", "realized", "settled_at")


def settle_quintiles(p: DataFrame, least: int = 5) -> DataFrame:
    return quantile_bucket(p.filter("realized_return is not null"), "realized_return", ["as_of"], 5, "realized_quintile", least)


def missing_dates(calendar: DataFrame, log: DataFrame) -> DataFrame:
    return calendar.select(F.col("bar_date").alias("as_of")).distinct().join(log.select("as_of").distinct(), "as_of", "left_anti")


def shared_range(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("as_of").intersect(b.select("as_of")).agg(F.count("*").alias("n_dates"), F.min("as_of").alias("first_date"), F.max("as_of").alias("last_date"))


def trailing_returns(bars: DataFrame, as_of) -> DataFrame:
    """(symbol, ret_5, ret_20): log returns over the last 5 and 20 bars up to a date; null with too few bars."""
    w = Window.partitionBy("symbol").orderBy(F.desc("bar_date"))
    b = bars.filter((F.col("bar_date") <= F.lit(as_of).cast("date")) & (F.col("close") > 0)).withColumn("k", F.row_number().over(w)).filter("k <= 21")

    def at(k):
        return F.max(F.when(F.col("k") == k, F.ln("close")))

    return b.groupBy("symbol").agg((at(1) - at(6)).alias("ret_5"), (at(1) - at(21)).alias("ret_20"))


def calibration_table(p: DataFrame, top: Column) -> DataFrame:
    """Bins of the top probability (right-closed, the lowest value included): rows, mean probability, observed rate."""
    b = F.greatest(F.ceil(F.col("top_p") * 5) - 1, F.lit(0)).cast("int")
    return p.filter(F.col("top_p").isNotNull() & top.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("top_p").alias("mean_p"), F.avg(top.cast("double")).alias("observed"))


def directional_accuracy(p: DataFrame, least: float = 0.001) -> DataFrame:
    r = p.filter((F.abs("predicted_return") > least) & F.col("realized_return").isNotNull())
    return r.agg(F.count("*").alias("n"), F.avg((F.signum("predicted_return") == F.signum("realized_return")).cast("double")).alias("accuracy"))
