"""Inputs of the registered queries, derived by Spark from the given tables, with the same definitions in SQL.

Daily bars: a part's brand and its block of ``BLOCK`` parts are the symbol, so
symbols grow in number with the tables; the ship date is the bar date and price
per unit the price.  Everything else (membership, macro series, filings, ...) is
derived from the bars, orders or events by whole-number rules, so that a DuckDB
twin gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


#: Parts of one brand that share a symbol come from one block of so many part keys; the first block's symbol is the brand's name.
BLOCK = 4_000
SYMBOL_SQL = f"p_brand || CASE WHEN (p_partkey - 1) // {BLOCK} > 0 THEN '-' || CAST((p_partkey - 1) // {BLOCK} AS BIGINT) ELSE '' END"


def symbol_of_part() -> Column:
    block = F.floor((F.col("p_partkey") - 1) / BLOCK)
    return F.concat("p_brand", F.when(block > 0, F.concat(F.lit("-"), block.cast("string"))).otherwise(F.lit("")))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def trades(spark: SparkSession, d: str) -> DataFrame:
    """One row per line item: symbol, date, price, volume.  The part dimension is joined without a hint: its size decides."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), symbol_of_part().alias("symbol"), "p_retailprice", "p_type")
    return (
        table(spark, d, "lineitem").join(part, "l_partkey")
        .withColumn("bar_date", F.to_date("l_shipdate")).withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    )


def _ohlcv() -> list:
    key = F.struct(*ORDER)
    return [
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"),
        F.sum("l_quantity").alias("volume"),
    ]


def _place(check: int) -> Column:
    """Order key, line number and 23 bits of the price's hash in one whole number; null if they don't fit."""
    fits = F.col("l_orderkey").between(0, (1 << 34) - 1) & F.col("l_linenumber").between(0, 63)
    at = F.shiftleft(F.col("l_orderkey").cast("long"), 6) + F.col("l_linenumber")
    return F.when(fits, F.shiftleft(at, 23) + F.shiftright(F.xxhash64("price"), check).bitwiseAND(F.lit(MASK)))


MASK = (1 << 23) - 1


def bars_of(t: DataFrame) -> DataFrame:
    """(symbol, bar_date, open, high, low, close, volume) of trades, one row per symbol and date, written once.

    A struct to order by would have the aggregation sort all trades, on either
    side of the shuffle; a whole number is aggregated by hash.  It tells first
    and last price unless order key and line number are there twice with
    different prices, or don't fit: such dates, if any, are done over with the whole order.
    """
    t = t.withColumns({"_p0": _place(0), "_p1": _place(24)})
    flip = {c: F.col(c).bitwiseXOR(F.lit(MASK)) for c in ("_p0", "_p1")}
    checks = [agg(x) for c in flip for agg in (F.min, F.max) for x in (F.col(c), flip[c])]
    out = t.groupBy("symbol", "bar_date").agg(
        F.min_by("price", "_p0").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "_p0").alias("close"), F.sum("l_quantity").alias("volume"),
        F.count_if(F.col("_p0").isNull()).alias("_odd"), *[x.alias(f"_c{i}") for i, x in enumerate(checks)],
    )
    odd = F.col("_odd") > 0
    for i in range(0, len(checks), 2):  # one hash at the end means that the least number and the least flipped one are one row's
        odd = odd | (F.col(f"_c{i}") != F.col(f"_c{i + 1}").bitwiseXOR(F.lit(MASK)))
    out = written(out.select("symbol", "bar_date", "open", "high", "low", "close", "volume", odd.alias("_odd")))
    again = out.filter("_odd").select(F.col("symbol").alias("_s"), F.col("bar_date").alias("_d"))
    if again.isEmpty():
        return out.drop("_odd")
    those = t.join(again, F.col("symbol").eqNullSafe(F.col("_s")) & F.col("bar_date").eqNullSafe(F.col("_d")), "left_semi")
    return out.filter("not _odd").drop("_odd").unionByName(written(those.groupBy("symbol", "bar_date").agg(*_ohlcv())))


def bars(spark: SparkSession, d: str) -> DataFrame:
    """The bars of ``trades``."""
    return bars_of(trades(spark, d))


def bars_by_source(spark: SparkSession, d: str) -> DataFrame:
    """As ``bars`` for each return flag as the source, with an unadjusted close, exchange and load time."""
    out = trades(spark, d).groupBy("symbol", "bar_date", F.col("l_returnflag").alias("source")).agg(*_ohlcv(), F.avg("p_retailprice").alias("close_unadj"))
    n = F.regexp_extract("symbol", "([0-9]+)", 1).cast("int")
    return out.withColumn("exchange", F.when(n % 2 == 0, "NYSE").otherwise("NSE")).withColumn("ingested_at", F.date_add("bar_date", F.ascii("source") % 7))


def raw_bars(spark: SparkSession, d: str) -> DataFrame:
    """``bars`` with exchange, every 11th date's high below its low, and an older copy of every 7th date's rows."""
    day = F.datediff("bar_date", F.lit("1992-01-01").cast("date"))
    n = F.regexp_extract("symbol", "([0-9]+)", 1).cast("int")
    b = bars(spark, d).withColumn("exchange", F.when(n % 2 == 0, "NYSE").otherwise("NSE"))
    b = b.withColumn("high", F.when(day % 11 == 0, F.col("low") - 1).otherwise(F.col("high"))).withColumn("ingested_at", F.date_add("bar_date", 2))
    return b.unionByName(b.filter(day % 7 == 0).withColumn("close", F.col("close") + 5).withColumn("ingested_at", F.date_add("bar_date", 1)))


def membership(spark: SparkSession, d: str, b: DataFrame | None = None) -> DataFrame:
    """(universe, symbol, exchange, start_date, end_date), from the bars ``b`` if they are there; symbols with number % 3 = 0 leave after 900 days, and % 6 = 0 come back 300 days later."""
    n = F.regexp_extract("symbol", "([0-9]+)", 1).cast("int")
    first = (trades(spark, d) if b is None else b).agg(F.min("bar_date").alias("d0"))
    m = table(spark, d, "part").select(symbol_of_part().alias("symbol")).distinct().crossJoin(F.broadcast(first))
    m = m.select(
        F.when(n % 2 == 0, "US").otherwise("IN").alias("universe"), "symbol", F.when(n % 2 == 0, "NYSE").otherwise("NSE").alias("exchange"),
        F.date_add("d0", 60 * (n % 7)).alias("start_date"), n.alias("n"),
    )
    m = m.withColumn("end_date", F.when(F.col("n") % 3 == 0, F.date_add("start_date", 900)))
    back = m.filter("n % 6 = 0").withColumn("start_date", F.date_add("start_date", 1200)).withColumn("end_date", F.lit(None).cast("date"))
    return m.unionByName(back).drop("n")


SERIES = ["vix", "vix9d", "vix3m", "vvix", "skew", "t10y", "t5y", "fx", "lqd", "hyg", "dxy", "gold", "copper"]


def macro(spark: SparkSession, d: str) -> DataFrame:
    """(macro_date, series, value): each (priority, status) pair of orders, in order, is one of the named series."""
    o = table(spark, d, "orders").withColumn("macro_date", F.to_date("o_orderdate"))
    prio = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    code = prio * 3 + F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    named = F.element_at(F.array(*[F.lit(s) for s in SERIES]), code + 1)
    return o.filter(code < len(SERIES)).groupBy("macro_date", named.alias("series")).agg(F.avg("o_totalprice").alias("value"))


def numbered(b: DataFrame) -> DataFrame:
    return b.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("bar_date")))


def announcements(spark: SparkSession, d: str, b: DataFrame | None = None) -> DataFrame:
    """(symbol, announce_date, surprise_pct): every 60th bar, 100 x its five-bar log return."""
    w = Window.partitionBy("symbol").orderBy("bar_date")
    b = numbered(bars(spark, d) if b is None else b).withColumn("s", 100 * (F.ln("close") - F.lag(F.ln("close"), 5).over(w)))
    return b.filter("rn % 60 = 0").select("symbol", F.col("bar_date").alias("announce_date"), F.col("s").alias("surprise_pct"))


def filings(spark: SparkSession, d: str, b: DataFrame | None = None) -> DataFrame:
    """(symbol, filing_date, form_type, items, accession): every 9th bar."""
    b = numbered(bars(spark, d) if b is None else b).filter("rn % 9 = 0")
    k = F.col("rn") / 9
    form = F.when(F.col("rn") % 27 == 0, "8-K").when(F.col("rn") % 27 == 9, "10-Q").otherwise("10-K")
    items = F.when(F.col("rn") % 54 == 0, "2.02,9.01").when(F.col("rn") % 27 == 0, "5.02")
    return b.select("symbol", F.col("bar_date").alias("filing_date"), form.alias("form_type"), items.alias("items"), F.concat(F.col("symbol"), F.lit("-"), F.col("rn").cast("string")).alias("accession"), k.cast("int").alias("k"))


CONCEPTS = {"NetIncome": "sum(l_extendedprice * (1 - l_discount))", "Equity": "sum(l_quantity) * 1000", "Debt": "sum(l_tax) * 10000", "Revenue": "sum(l_extendedprice)", "GrossProfit": "sum(l_extendedprice * l_discount)", "Assets": "sum(l_extendedprice) * 2 - 100000"}


def fundamentals(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, concept, period_end, fp, value, filed_date): per brand and quarter; the 4th quarter also as FY; every third quarter is restated 30 days later."""
    t = trades(spark, d).withColumn("q", F.trunc("bar_date", "quarter"))
    wide = t.groupBy("symbol", "q").agg(*[F.expr(e).alias(c) for c, e in CONCEPTS.items()])
    long = wide.unpivot(["symbol", "q"], list(CONCEPTS), "concept", "value")
    end = F.date_sub(F.add_months("q", 3), 1)
    base = long.select("symbol", "concept", end.alias("period_end"), F.lit("Q").alias("fp"), "value", F.date_add(end, 40).alias("filed_date"))
    again = base.filter(F.month("period_end") == 9).withColumn("value", F.col("value") * 1.5).withColumn("filed_date", F.date_add("filed_date", 30))
    year = base.filter(F.month("period_end") == 12).withColumn("fp", F.lit("FY")).withColumn("value", F.col("value") * 4).withColumn("filed_date", F.date_add("filed_date", 5))
    return base.unionByName(again).unionByName(year)


def predictions(spark: SparkSession, d: str, b: DataFrame | None = None) -> DataFrame:
    """(symbol, as_of, predicted_return, top_p, bot_p, realized_return): minus the five-bar log return; probabilities from its rank on the date."""
    w = Window.partitionBy("symbol").orderBy("bar_date")
    day = Window.partitionBy("as_of")
    p = (bars(spark, d) if b is None else b).select(
        "symbol", F.col("bar_date").alias("as_of"), (F.lag(F.ln("close"), 5).over(w) - F.ln("close")).alias("predicted_return"),
        (F.lead(F.ln("close"), 5).over(w) - F.ln("close")).alias("realized_return"),
    ).filter("predicted_return is not null")
    share = F.row_number().over(day.orderBy("predicted_return", "symbol")) / F.count("*").over(day)
    return p.withColumn("top_p", F.round(share, 4)).withColumn("bot_p", F.round(1 - share, 4))


BARS_SQL = f"""
trades AS (SELECT {SYMBOL_SQL} AS symbol, CAST(l.l_shipdate AS DATE) AS bar_date, l.l_extendedprice / l.l_quantity AS price, p.p_retailprice, p.p_type, l.*
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
bars AS MATERIALIZED (SELECT symbol, bar_date,
  first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS close, sum(l_quantity) AS volume
  FROM trades GROUP BY 1, 2)"""
_N = "CAST(regexp_extract(symbol, '([0-9]+)', 1) AS INT)"
SOURCES_SQL = f"""
bars_by_source AS (SELECT *, CASE WHEN {_N} % 2 = 0 THEN 'NYSE' ELSE 'NSE' END AS exchange, CAST(bar_date + CAST(ascii(source) % 7 AS INT) AS DATE) AS ingested_at FROM
  (SELECT symbol, bar_date, l_returnflag AS source,
  first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS close, sum(l_quantity) AS volume, avg(p_retailprice) AS close_unadj
  FROM trades GROUP BY 1, 2, 3))"""
RAW_SQL = f"""
raw0 AS (SELECT symbol, bar_date, open, CASE WHEN (bar_date - DATE '1992-01-01') % 11 = 0 THEN low - 1 ELSE high END AS high, low, close, volume,
  CASE WHEN {_N} % 2 = 0 THEN 'NYSE' ELSE 'NSE' END AS exchange, bar_date + 2 AS ingested_at FROM bars),
raw_bars AS (SELECT * FROM raw0 UNION ALL SELECT symbol, bar_date, open, high, low, close + 5, volume, exchange, bar_date + 1 FROM raw0 WHERE (bar_date - DATE '1992-01-01') % 7 = 0)"""
MEMBERS_SQL = f"""
mem0 AS (SELECT CASE WHEN n % 2 = 0 THEN 'US' ELSE 'IN' END AS universe, symbol, CASE WHEN n % 2 = 0 THEN 'NYSE' ELSE 'NSE' END AS exchange, d0 + 60 * (n % 7) AS start_date, n
  FROM (SELECT symbol, {_N} AS n FROM (SELECT DISTINCT {SYMBOL_SQL} AS symbol FROM part)), (SELECT min(bar_date) AS d0 FROM trades)),
membership AS (SELECT universe, symbol, exchange, start_date, CASE WHEN n % 3 = 0 THEN start_date + 900 END AS end_date FROM mem0
  UNION ALL SELECT universe, symbol, exchange, start_date + 1200, NULL FROM mem0 WHERE n % 6 = 0)"""
MACRO_SQL = f"""
macro AS (SELECT CAST(o_orderdate AS DATE) AS macro_date, ['{"','".join(SERIES)}'][code + 1] AS series, avg(o_totalprice) AS value FROM
  (SELECT *, (CAST(substr(o_orderpriority, 1, 1) AS INT) - 1) * 3 + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS code FROM orders) WHERE code < {len(SERIES)} GROUP BY 1, 2)"""
NUMBERED_SQL = "nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) AS rn FROM bars)"
ANNOUNCE_SQL = """
announcements AS (SELECT symbol, bar_date AS announce_date, s AS surprise_pct FROM
  (SELECT *, 100 * (ln(close) - lag(ln(close), 5) OVER (PARTITION BY symbol ORDER BY bar_date)) AS s FROM nb) WHERE rn % 60 = 0)"""
FILINGS_SQL = """
filings AS (SELECT symbol, bar_date AS filing_date, CASE WHEN rn % 27 = 0 THEN '8-K' WHEN rn % 27 = 9 THEN '10-Q' ELSE '10-K' END AS form_type,
  CASE WHEN rn % 54 = 0 THEN '2.02,9.01' WHEN rn % 27 = 0 THEN '5.02' END AS items, symbol || '-' || rn AS accession FROM nb WHERE rn % 9 = 0)"""
FUNDAMENTALS_SQL = f"""
fwide AS (SELECT symbol, CAST(date_trunc('quarter', bar_date) AS DATE) AS q, {", ".join(f"{e} AS {c}" for c, e in CONCEPTS.items())} FROM trades GROUP BY 1, 2),
flong AS (UNPIVOT fwide ON {", ".join(CONCEPTS)} INTO NAME concept VALUE value),
fbase AS (SELECT symbol, concept, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, 'Q' AS fp, value, CAST(q + INTERVAL 3 MONTH + INTERVAL 39 DAY AS DATE) AS filed_date FROM flong),
fundamentals AS (SELECT * FROM fbase UNION ALL SELECT symbol, concept, period_end, fp, value * 1.5, filed_date + 30 FROM fbase WHERE month(period_end) = 9
  UNION ALL SELECT symbol, concept, period_end, 'FY', value * 4, filed_date + 5 FROM fbase WHERE month(period_end) = 12)"""
PREDICTIONS_SQL = """
pred0 AS (SELECT symbol, bar_date AS as_of, lag(ln(close), 5) OVER w - ln(close) AS predicted_return, lead(ln(close), 5) OVER w - ln(close) AS realized_return
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)),
pred1 AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY predicted_return, symbol) / count(*) OVER (PARTITION BY as_of) AS share FROM pred0 WHERE predicted_return IS NOT NULL),
predictions AS MATERIALIZED (SELECT symbol, as_of, predicted_return, realized_return, round(share, 4) AS top_p, round(1 - share, 4) AS bot_p FROM pred1)"""


def sql(select: str, *more: str) -> str:
    """A query over the bars and further inputs."""
    return "WITH " + ",".join([BARS_SQL, *more]) + "\n" + select
