"""Point-in-time membership: interval tables, interval joins, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN = "9999-12-31"


def _end() -> Column:
    return F.coalesce("end_date", F.lit(OPEN).cast("date"))


def members_on(mem: DataFrame, universe: str, day) -> DataFrame:
    return mem.filter((F.col("universe") == universe) & (F.col("start_date") <= F.lit(day).cast("date")) & (_end() >= F.lit(day).cast("date")))


def members_overlapping(mem: DataFrame, universe: str, start, end) -> DataFrame:
    return mem.filter((F.col("universe") == universe) & (F.col("start_date") <= F.lit(end).cast("date")) & (_end() >= F.lit(start).cast("date"))).select("symbol", "exchange").distinct()


def all_symbols_ever(mem: DataFrame, universe: str) -> DataFrame:
    return mem.filter(F.col("universe") == universe).select("symbol").distinct()


def universe_counts(mem: DataFrame) -> DataFrame:
    return mem.filter("end_date is null").groupBy("universe").agg(F.countDistinct("symbol").alias("n_members"))


def flag_members(panel: DataFrame, mem: DataFrame, flag: str = "in_universe") -> DataFrame:
    """Whether any interval of the symbol covers the date.

    Intervals are gathered to one short list per symbol, so the join adds no
    rows and needs no range condition.
    """
    spans = mem.groupBy("symbol").agg(F.collect_list(F.struct(F.col("start_date").alias("s"), _end().alias("e"))).alias("_spans"))
    hit = F.exists("_spans", lambda x: (F.col("bar_date") >= x.s) & (F.col("bar_date") <= x.e))
    return panel.join(spans, "symbol", "left").withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_spans")


def mask_non_members(panel: DataFrame, mem: DataFrame, columns: list[str]) -> DataFrame:
    """Features null outside membership; all rows stay."""
    out = flag_members(panel, mem, "_in")
    return out.withColumns({c: F.when(F.col("_in"), F.col(c)) for c in columns}).drop("_in")


def membership_timeline(current: DataFrame, changes: DataFrame, today, floor) -> DataFrame:
    """Intervals (symbol, start_date, end_date) from current names (symbol, date_added) and changes (symbol, change_date, action).

    Current names start at their latest add, else ``date_added``, else the
    floor, and stay open.  Of other names each add is paired with the next
    remove on or after it that no earlier add took; a remove without an add
    starts at the floor; an add without a remove ends today.
    """
    lo, now = F.lit(floor).cast("date"), F.lit(today).cast("date")
    adds = changes.filter("action = 'add'").groupBy("symbol").agg(F.max("change_date").alias("_a"))
    live = current.join(adds, "symbol", "left").select("symbol", F.coalesce("_a", "date_added", lo).alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    # greedy pairing: walking the events in order, a remove takes the oldest add still open
    w = Window.partitionBy("symbol").orderBy("change_date", F.when(F.col("action") == "add", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("action") == "add", 1).otherwise(-1)
    ev = changes.join(current.select("symbol"), "symbol", "left_anti").withColumn("_sum", F.sum(step).over(w))
    ev = ev.withColumn("_waste", F.greatest(-F.min("_sum").over(w), F.lit(0)))  # removes so far that found no open add
    seen = F.count_if(F.col("action") == "remove").over(w)
    ev = ev.withColumn("_k", F.when(F.col("action") == "add", F.count_if(F.col("action") == "add").over(w)).otherwise(seen - F.col("_waste")))
    ev = ev.withColumn("_lost", (F.col("action") == "remove") & (F.col("_waste") > F.coalesce(F.lag("_waste").over(Window.partitionBy("symbol").orderBy("change_date", F.when(F.col("action") == "add", 0).otherwise(1))), F.lit(0))))
    a = ev.filter("action = 'add'").select("symbol", "_k", F.col("change_date").alias("start_date"))
    r = ev.filter("action = 'remove' and not _lost").select("symbol", "_k", F.col("change_date").alias("_e"))
    paired = a.join(r, ["symbol", "_k"], "left").select("symbol", "start_date", F.coalesce("_e", now).alias("end_date"))
    lone = ev.filter("_lost").select("symbol", lo.alias("start_date"), F.col("change_date").alias("end_date"))
    return live.unionByName(paired).unionByName(lone)


def timeline_checks(timeline: DataFrame, low: int, high: int) -> DataFrame:
    n = timeline.agg(F.count_if(F.col("end_date").isNull()).alias("n_active"), F.count_if(F.col("end_date") < F.col("start_date")).alias("n_reversed"))
    return n.withColumn("ok", F.col("n_active").between(low, high) & (F.col("n_reversed") == 0))


def missing_history(members: DataFrame, bars: DataFrame) -> DataFrame:
    return members.select("symbol", "exchange").distinct().join(bars.select("symbol").distinct(), "symbol", "left_anti")


def update_plan(members: DataFrame, bars: DataFrame, today, *, overlap: int = 5, recent: int = 7, default: int = 60, strict: bool = False) -> DataFrame:
    """(symbol, fetch_from): where to fetch again; a symbol without bars gets ``default`` days."""
    now = F.lit(today).cast("date")
    last = bars.groupBy("symbol").agg(F.max("bar_date").alias("_last"))
    start = F.date_add("_last", 1) if strict else F.greatest(F.date_sub("_last", overlap), F.date_sub(now, recent))
    return members.select("symbol").distinct().join(last, "symbol", "left").select("symbol", F.when(F.col("_last").isNull(), F.date_sub(now, default)).otherwise(start).alias("fetch_from"))


def ingest_summary(results: DataFrame, *, full: float = 0.99, partial: float = 0.8) -> DataFrame:
    """Totals of (ok boolean, n_rows) and a code: 0 full coverage, 2 partial, 3 too little."""
    a = results.agg(F.count("*").alias("requested"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
    cover = F.when(F.col("requested") == 0, 1.0).otherwise(F.col("succeeded") / F.nullif(F.col("requested"), F.lit(0)))
    return a.withColumn("coverage", cover).withColumn("code", F.when(F.col("coverage") >= full, 0).when(F.col("coverage") >= partial, 2).otherwise(3))
