"""Queries over sources, keyed merges, cleaning rules, membership and ingest bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import rounded
from ..operators import clean, keyed, pit
from ..operators.keyed_table import KeyedTable
from ..sources import bars as src
from . import fixtures as fx
from .q_panel import SECTORS_SQL, sectors
from .shared import shared_dir, written
from .sqlkit import r

FIRST, LAST = "1996-06-01", "1999-06-30"
BARCOLS = ["symbol", "exchange", "bar_date", "source", "open", "high", "low", "close", "volume", "ingested_at"]


def src1(spark, d):
    return src.read_bars(fx.bars_by_source(spark, d), start=FIRST, end=LAST).select(*BARCOLS)


def src2(spark, d):
    return src.read_universe_bars(fx.bars_by_source(spark, d), fx.membership(spark, d), "US", start=FIRST, end=LAST).select(*BARCOLS)


def src3(spark, d):
    return src.read_series(fx.macro(spark, d), "vix", FIRST, LAST)


def src4(spark, d):
    return src.read_events(fx.filings(spark, d), "filing_date", start=FIRST, form_type=["8-K", "10-K"]).drop("k")


def src5(spark, d):
    return src.panel_stats(fx.bars(spark, d), ["symbol", "bar_date"])


def src6(spark, d):
    day = F.datediff("bar_date", F.lit("1992-01-01").cast("date"))
    return src.normalise_vendor_bars(fx.bars(spark, d), fx.bars(spark, d).filter(day % 3 != 0), "NYSE")


def src7(spark, d):
    p = fx.table(spark, d, "part").select(fx.symbol_of_part().alias("symbol")).distinct()
    raw = F.concat(F.regexp_replace("symbol", "Brand#", "br"), F.lit(".b"))
    u = F.when(F.col("symbol").endswith("1"), "IN").otherwise("US")
    return p.select(raw.alias("raw"), u.alias("universe"), src.vendor_symbol(raw, u).alias("vendor_symbol"))


def _broken(json, filer):
    """Every 50th filer's document ends too early, every 51st one is null."""
    return F.when(filer % 51 == 0, F.lit(None)).when(filer % 50 == 0, F.expr("left(json, length(json) - 2)")).otherwise(json)


def src8(spark, d):
    """A customer's orders as one document of parallel arrays; every tenth date is bad."""
    o = fx.table(spark, d, "orders")
    parts = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority"))).alias("a"))

    def col(name, expr):
        return F.transform("a", expr).alias(name)

    js = F.to_json(
        F.struct(
            col("accessionNumber", lambda x: x.o_orderkey.cast("string")), col("filingDate", lambda x: F.when(x.o_orderkey % 10 == 3, "bad").otherwise(F.date_format(x.o_orderdate, "yyyy-MM-dd"))),
            col("form", lambda x: x.o_orderpriority), col("items", lambda x: F.when(x.o_orderstatus == "F", "").otherwise(x.o_orderstatus)),
        )
    )
    docs = parts.select(F.concat(F.lit("S"), "o_custkey").alias("symbol"), "o_custkey", js.alias("json"))
    return src.flatten_filings(docs.select("symbol", _broken(F.col("json"), F.col("o_custkey")).alias("json")))


FALLBACKS = {"Flow": ["P2", "P1"], "Stock": ["P3"]}


def src9(spark, d):
    """A customer's orders as one document: concept by priority, observations in dollars; every 7th has no value."""
    o = fx.table(spark, d, "orders").withColumn("name", F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)))
    fp = F.when(F.col("o_orderstatus") == "O", F.lit(None).cast("string")).otherwise(F.col("o_orderstatus"))
    ob = F.struct(
        F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("val"), F.date_format(F.trunc("o_orderdate", "quarter"), "yyyy-MM-dd").alias("end"), fp.alias("fp"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"), F.lit("10-K").alias("form"), F.col("o_orderkey").cast("string").alias("accn"),
    )
    g = o.groupBy("o_custkey", "name").agg(F.sort_array(F.collect_list(ob)).alias("a"))
    g = g.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct(F.create_map(F.lit("USD"), F.col("a")).alias("units"))))).alias("m"))
    docs = g.select(F.concat(F.lit("S"), "o_custkey").alias("symbol"), "o_custkey", F.to_json("m").alias("json"))
    return src.flatten_facts(docs.select("symbol", _broken(F.col("json"), F.col("o_custkey")).alias("json")), FALLBACKS)


def src10(spark, d):
    e = fx.table(spark, d, "events").select(F.concat(F.lit("U"), "user_id").alias("symbol"), F.col("ts").alias("announced_at"), F.col("value").cast("string").alias("eps_estimate"), F.col("event_type").alias("eps_actual"), F.get_json_object("props", "$.k").alias("surprise_pct"))
    return src.normalise_earnings(e)


def src11(spark, d):
    c = fx.table(spark, d, "customer").select(F.to_json(F.struct(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("-"), "c_custkey").alias("ticker"), F.col("c_custkey").alias("cik_str"))).alias("json"))
    return src.ticker_to_cik(c)


KEYS = ["symbol", "exchange", "bar_date"]


def snk1(spark, d):
    """All bars, then as a batch the same 200 days later with doubled closes: some keys are there already; the batch comes twice."""
    raw = written(fx.raw_bars(spark, d))
    table = KeyedTable(spark, shared_dir(spark), raw.schema, F.year("bar_date") * 12 + F.month("bar_date"))
    table.upsert(raw, 0, KEYS, ["ingested_at"])
    late = raw.withColumns({"bar_date": F.date_add("bar_date", 200), "close": F.col("close") * 2})
    for version in (1, 2):
        table.upsert(late, version, KEYS, ["ingested_at"])
    return table.read()


def snk2(spark, d):
    """Settled predictions from the tenth of each month on; new predictions of each month's first twenty days."""
    p = written(fx.predictions(spark, d))
    old = p.filter(F.dayofmonth("as_of") >= 10).select("symbol", "as_of", "predicted_return", "top_p", "realized_return")
    new = p.filter(F.dayofmonth("as_of") <= 20).select("symbol", "as_of", (-F.col("predicted_return")).alias("predicted_return"), "top_p")
    table = KeyedTable(spark, shared_dir(spark), old.schema, F.year("as_of") * 12 + F.month("as_of"))
    table.upsert(old, 0, ["symbol", "as_of"], ["predicted_return"])
    table.upsert_preserving(new, 1, ["symbol", "as_of"], ["predicted_return", "top_p"])
    return rounded(table.read())


def snk4(spark, d):
    return src.sector_distribution(sectors(spark, d))


def cln1_bad(spark, d):
    return clean.split_valid_bars(fx.raw_bars(spark, d))[1]


def cln1_good(spark, d):
    return clean.split_valid_bars(fx.raw_bars(spark, d))[0]


def cln2(spark, d):
    return clean.drop_big_moves(fx.raw_bars(spark, d))


def cln3(spark, d):
    return clean.drop_illiquid(fx.raw_bars(spark, d), {"NYSE": (20.0, 0), "NSE": (30.0, 0)})


def cln4(spark, d):
    return clean.drop_penny(fx.raw_bars(spark, d), {"NYSE": (0, 950.0), "NSE": (0, 1000.0)})


def cln5(spark, d):
    return clean.cleaning_report(fx.raw_bars(spark, d))


def cln6(spark, d):
    b = fx.raw_bars(spark, d).filter("close > 1000")
    return clean.drop_ghost_membership(fx.membership(spark, d), b, ["Brand#4", "Brand#9"])


def cln7(spark, d):
    return clean.symbol_sanity(fx.bars(spark, d), fx.membership(spark, d), least_bars=105, most_move=3.0, least_volume=26.0)


def cln8(spark, d):
    return rounded(clean.compare_sources(fx.bars_by_source(spark, d), 1.0))


def cln9(spark, d):
    return rounded(clean.audit_sources(fx.bars_by_source(spark, d), pit.members_on(fx.membership(spark, d), "US", LAST), as_of=LAST, lookback=700))


def pit1(spark, d):
    return pit.members_on(fx.membership(spark, d), "US", FIRST)


def pit2(spark, d):
    return pit.members_overlapping(fx.membership(spark, d), "IN", FIRST, LAST)


def pit3(spark, d):
    return pit.all_symbols_ever(fx.membership(spark, d), "IN")


def pit4(spark, d):
    return pit.universe_counts(fx.membership(spark, d))


def pit5(spark, d):
    return pit.flag_members(fx.bars(spark, d).select("symbol", "bar_date"), fx.membership(spark, d))


def pit6(spark, d):
    return pit.mask_non_members(fx.bars(spark, d).select("symbol", "bar_date", "close", "volume"), fx.membership(spark, d), ["close", "volume"])


def changes(spark, d):
    """Every 7th order of a customer is an add, the next 7th a remove, and so on; customers without a third of them start with a remove."""
    w = pit.Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = fx.table(spark, d, "orders").withColumn("n", F.row_number().over(w)).withColumn("change_date", F.to_date("o_orderdate"))
    act = F.when((F.col("n") + F.col("o_custkey") % 3) % 2 == 0, "add").otherwise("remove")
    o = o.select(F.concat(F.lit("C"), "o_custkey").alias("symbol"), "change_date", act.alias("action"), "n")
    return o.groupBy("symbol", "change_date").agg(F.min_by("action", "n").alias("action"))


def pit7(spark, d):
    cur = fx.table(spark, d, "customer").filter("c_custkey % 4 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("symbol"), F.when(F.col("c_custkey") % 8 == 0, F.lit("1995-01-01").cast("date")).alias("date_added"))
    return pit.membership_timeline(cur, changes(spark, d), "2001-01-01", "1990-01-01")


def pit8(spark, d):
    return pit.timeline_checks(pit7(spark, d), 10, 100000)


def pit9(spark, d):
    return pit.missing_history(fx.membership(spark, d), fx.bars(spark, d).filter("close > 1040 and volume > 140"))


def ing1(spark, d):
    b = fx.bars(spark, d).filter("close > 1040 and volume > 140")
    return pit.update_plan(fx.membership(spark, d), b, "1998-11-20")


def ing2(spark, d):
    return pit.ingest_summary(fx.bars(spark, d).groupBy("symbol").agg(F.count("*").alias("n_rows")).withColumn("ok", F.col("n_rows") % 5 != 0))


def ing3(spark, d):
    s = fx.bars_by_source(spark, d).select("symbol", "bar_date", "source", "close")
    return keyed.fallback_merge(s.filter("source = 'A'"), s.filter("source = 'R'"), ["symbol", "bar_date"])


def dq1(spark, d):
    return clean.health_report(fx.bars(spark, d), fx.membership(spark, d), "2001-12-10")


_B = ", ".join(BARCOLS)
_NEW = "QUALIFY row_number() OVER (PARTITION BY symbol, exchange, bar_date ORDER BY ingested_at DESC, source DESC) = 1"
_R = f"bar_date BETWEEN '{FIRST}' AND '{LAST}'"
_BROKEN = "(high < open OR high < close OR high < low OR low > open OR low > close)"
_MOVE = "coalesce(close / lag(close) OVER (PARTITION BY symbol, exchange ORDER BY bar_date, ingested_at) > 1.5 OR close / lag(close) OVER (PARTITION BY symbol, exchange ORDER BY bar_date, ingested_at) < 0.67, false)"
_DIFF = """diffs AS (SELECT *, CASE WHEN diff_pct > 30 THEN 'split' WHEN diff_pct BETWEEN 0.5 AND 5 AND ratio > 0.005 THEN 'dividend' ELSE 'outlier' END AS cause FROM
  (SELECT a.symbol, a.bar_date, a.source AS source_a, b.source AS source_b, 100 * abs(a.close - b.close) / ((a.close + b.close) / 2) AS diff_pct, abs(a.close_unadj / a.close - b.close_unadj / b.close) AS ratio
  FROM bars_by_source a JOIN bars_by_source b USING (symbol, bar_date) WHERE a.source < b.source) WHERE diff_pct > 1.0)"""
_IN = "EXISTS (SELECT 1 FROM membership m WHERE m.symbol = b.symbol AND b.bar_date BETWEEN m.start_date AND coalesce(m.end_date, DATE '9999-12-31'))"
_UP = "raw_bars WHERE (bar_date - DATE '1992-01-01') %"

QUERIES = {
    "src1_read_bars": src1, "src2_read_universe_bars": src2, "src3_read_series": src3, "src4_read_events": src4, "src5_panel_stats": src5, "src6_normalise_vendor_bars": src6, "src7_vendor_symbol": src7,
    "src8_flatten_filings": src8, "src9_flatten_facts": src9, "src10_normalise_earnings": src10, "src11_ticker_to_cik": src11, "snk1_upsert": snk1, "snk2_upsert_preserving": snk2, "snk4_sector_distribution": snk4,
    "cln1_bad_bars": cln1_bad, "cln1_valid_bars": cln1_good, "cln2_drop_big_moves": cln2, "cln3_drop_illiquid": cln3, "cln4_drop_penny": cln4, "cln5_cleaning_report": cln5, "cln6_drop_ghost_membership": cln6,
    "cln7_symbol_sanity": cln7, "cln8_compare_sources": cln8, "cln9_audit_sources": cln9, "pit1_members_on": pit1, "pit2_members_overlapping": pit2, "pit3_all_symbols_ever": pit3, "pit4_universe_counts": pit4,
    "pit5_flag_members": pit5, "pit6_mask_non_members": pit6, "pit7_membership_timeline": pit7, "pit8_timeline_checks": pit8, "pit9_missing_history": pit9, "ing1_update_plan": ing1, "ing2_ingest_summary": ing2, "ing3_fallback_merge": ing3, "dq1_health_report": dq1,
}
SQL = {
    "src1_read_bars": fx.sql(f"SELECT {_B} FROM bars_by_source WHERE {_R} {_NEW}", fx.SOURCES_SQL),
    "src2_read_universe_bars": fx.sql(f"SELECT {_B} FROM bars_by_source WHERE (symbol, exchange) IN (SELECT (symbol, exchange) FROM membership WHERE universe = 'US') AND {_R} {_NEW}", fx.SOURCES_SQL, fx.MEMBERS_SQL),
    "src3_read_series": fx.sql(f"SELECT * FROM macro WHERE series = 'vix' AND macro_date BETWEEN '{FIRST}' AND '{LAST}'", fx.MACRO_SQL),
    "src4_read_events": fx.sql(f"SELECT * FROM filings WHERE form_type IN ('8-K', '10-K') AND filing_date >= '{FIRST}'", fx.NUMBERED_SQL, fx.FILINGS_SQL),
    "src5_panel_stats": fx.sql("SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, min(bar_date) AS first_date, max(bar_date) AS last_date FROM bars"),
    "src6_normalise_vendor_bars": fx.sql("SELECT symbol, 'NYSE' AS exchange, bar_date, open, high, low, close, volume, CASE WHEN (bar_date - DATE '1992-01-01') % 3 <> 0 THEN close END AS close_unadj FROM bars"),
    "src7_vendor_symbol": "SELECT raw, universe, CASE WHEN universe = 'IN' THEN upper(raw) || '.NS' ELSE replace(upper(raw), '.', '-') END AS vendor_symbol FROM (SELECT DISTINCT replace(symbol, 'Brand#', 'br') || '.b' AS raw, CASE WHEN symbol LIKE '%1' THEN 'IN' ELSE 'US' END AS universe FROM (SELECT " + fx.SYMBOL_SQL + " AS symbol FROM part))",
    "src8_flatten_filings": """SELECT 'S' || o_custkey AS symbol, CAST(o_orderkey AS VARCHAR) AS accession, CAST(o_orderdate AS DATE) AS filing_date, o_orderpriority AS form_type, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS items
      FROM orders WHERE o_orderkey % 10 <> 3 AND o_custkey % 50 <> 0 AND o_custkey % 51 <> 0""",
    "src9_flatten_facts": """SELECT symbol, concept, period_end, fp, o_totalprice AS value, CAST(o_orderdate AS DATE) AS filed_date, '10-K' AS form, CAST(o_orderkey AS VARCHAR) AS accession FROM
      (SELECT *, 'S' || o_custkey AS symbol, CASE substr(o_orderpriority, 1, 1) WHEN '3' THEN 'Stock' ELSE 'Flow' END AS concept, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 ELSE 0 END AS p,
      CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_end, CASE WHEN o_orderstatus = 'O' THEN '?' ELSE o_orderstatus END AS fp FROM orders
      WHERE substr(o_orderpriority, 1, 1) IN ('1', '2', '3') AND o_orderkey % 7 <> 0 AND o_custkey % 50 <> 0 AND o_custkey % 51 <> 0)
      QUALIFY row_number() OVER (PARTITION BY symbol, concept, period_end, fp ORDER BY p DESC, o_orderkey DESC, o_totalprice DESC) = 1""",
    "src10_normalise_earnings": "SELECT 'U' || user_id AS symbol, CAST(ts AS DATE) AS announce_date, value AS eps_estimate, CAST(NULL AS DOUBLE) AS eps_actual, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS surprise_pct FROM events",
    "src11_ticker_to_cik": "SELECT upper(c_mktsegment) || '-' || c_custkey AS ticker, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer",
    "snk1_upsert": fx.sql("""SELECT symbol, bar_date, open, high, low, close, volume, exchange, ingested_at FROM
      (SELECT *, 0 AS side FROM raw_bars UNION ALL SELECT symbol, CAST(bar_date + 200 AS DATE), open, high, low, close * 2, volume, exchange, ingested_at, 1 FROM raw_bars)
      QUALIFY row_number() OVER (PARTITION BY symbol, exchange, bar_date ORDER BY side DESC, ingested_at DESC) = 1""", fx.RAW_SQL),
    "snk2_upsert_preserving": fx.sql(f"SELECT symbol, as_of, {r('CASE WHEN day(as_of) <= 20 THEN -predicted_return ELSE predicted_return END', 'predicted_return')}, {r('top_p', 'top_p')}, {r('CASE WHEN day(as_of) >= 10 THEN realized_return END', 'realized_return')} FROM predictions", fx.PREDICTIONS_SQL),
    "cln1_bad_bars": fx.sql(f"SELECT * FROM raw_bars WHERE {_BROKEN}", fx.RAW_SQL), "cln1_valid_bars": fx.sql(f"SELECT * FROM raw_bars WHERE NOT {_BROKEN}", fx.RAW_SQL),
    "cln2_drop_big_moves": fx.sql(f"SELECT * FROM raw_bars QUALIFY NOT {_MOVE}", fx.RAW_SQL),
    "cln3_drop_illiquid": fx.sql("SELECT * FROM raw_bars WHERE volume >= CASE exchange WHEN 'NYSE' THEN 20 ELSE 30 END", fx.RAW_SQL),
    "cln4_drop_penny": fx.sql("SELECT * FROM raw_bars WHERE close >= CASE exchange WHEN 'NYSE' THEN 950 ELSE 1000 END", fx.RAW_SQL),
    "cln5_cleaning_report": fx.sql("""SELECT (SELECT count(*) FROM raw_bars) AS before, (SELECT count(*) FROM raw_bars) - count(*) AS broken, count(*) FILTER (mv) AS big_moves, count(*) FILTER (NOT mv AND iq) AS illiquid,
      count(*) FILTER (NOT mv AND NOT iq AND pn) AS penny, count(*) FILTER (NOT mv AND NOT iq AND NOT pn) AS after FROM (SELECT """ + _MOVE + """ AS mv, volume < CASE exchange WHEN 'NYSE' THEN 5 ELSE 10 END AS iq,
      close < CASE exchange WHEN 'NYSE' THEN 700 ELSE 900 END AS pn FROM raw_bars WHERE NOT """ + _BROKEN + ")", fx.RAW_SQL),
    "cln6_drop_ghost_membership": fx.sql("SELECT symbol, exchange, universe, start_date, end_date FROM membership WHERE symbol NOT IN ('Brand#4', 'Brand#9') AND (symbol, exchange) IN (SELECT (symbol, exchange) FROM raw_bars WHERE close > 1000)", fx.RAW_SQL, fx.MEMBERS_SQL),
    "cln7_symbol_sanity": fx.sql(f"""SELECT symbol, n_bars, CASE WHEN n_bars < 105 THEN 'few_bars' WHEN mv > 3.0 THEN 'big_move' WHEN n = 0 THEN 'outside_membership' WHEN vol < 26 THEN 'thin' ELSE 'ok' END AS reason FROM
      (SELECT symbol, count(*) AS n_bars, max(mv) AS mv, count(*) FILTER (inside) AS n, quantile_cont(volume, 0.5) FILTER (inside) AS vol FROM
      (SELECT *, abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_date) - 1) AS mv, {_IN} AS inside FROM bars b) GROUP BY 1)""", fx.MEMBERS_SQL),
    "cln8_compare_sources": fx.sql(f"SELECT symbol, bar_date, source_a, source_b, {r('diff_pct', 'diff_pct')}, cause FROM diffs", fx.SOURCES_SQL, _DIFF),
    "cln9_audit_sources": fx.sql(f"""SELECT symbol, CAST(sum(n) AS BIGINT) AS n_diffs, {r('max(m)', 'max_diff_pct')}, first(cause ORDER BY n DESC, cause) AS modal_cause FROM (SELECT symbol, cause, count(*) AS n, max(diff_pct) AS m FROM diffs
      WHERE bar_date <= DATE '{LAST}' AND bar_date > DATE '{LAST}' - 700 AND symbol IN (SELECT symbol FROM membership WHERE universe = 'US' AND start_date <= DATE '{LAST}' AND coalesce(end_date, DATE '9999-12-31') >= DATE '{LAST}') GROUP BY 1, 2) GROUP BY 1""", fx.SOURCES_SQL, fx.MEMBERS_SQL, _DIFF),
    "pit1_members_on": fx.sql(f"SELECT * FROM membership WHERE universe = 'US' AND start_date <= '{FIRST}' AND coalesce(end_date, DATE '9999-12-31') >= '{FIRST}'", fx.MEMBERS_SQL),
    "pit2_members_overlapping": fx.sql(f"SELECT DISTINCT symbol, exchange FROM membership WHERE universe = 'IN' AND start_date <= '{LAST}' AND coalesce(end_date, DATE '9999-12-31') >= '{FIRST}'", fx.MEMBERS_SQL),
    "pit3_all_symbols_ever": fx.sql("SELECT DISTINCT symbol FROM membership WHERE universe = 'IN'", fx.MEMBERS_SQL),
    "pit4_universe_counts": fx.sql("SELECT universe, count(DISTINCT symbol) AS n_members FROM membership WHERE end_date IS NULL GROUP BY 1", fx.MEMBERS_SQL),
    "pit5_flag_members": fx.sql(f"SELECT symbol, bar_date, {_IN} AS in_universe FROM bars b", fx.MEMBERS_SQL),
    "pit6_mask_non_members": fx.sql(f"SELECT symbol, bar_date, CASE WHEN i THEN close END AS close, CASE WHEN i THEN volume END AS volume FROM (SELECT *, {_IN} AS i FROM bars b)", fx.MEMBERS_SQL),
    "pit9_missing_history": fx.sql("SELECT DISTINCT symbol, exchange FROM membership WHERE symbol NOT IN (SELECT symbol FROM bars WHERE close > 1040 AND volume > 140)", fx.MEMBERS_SQL),
    "ing1_update_plan": fx.sql("SELECT m.symbol, CASE WHEN l IS NULL THEN DATE '1998-11-20' - 60 ELSE greatest(l - 5, DATE '1998-11-20' - 7) END AS fetch_from FROM (SELECT DISTINCT symbol FROM membership) m LEFT JOIN (SELECT symbol, max(bar_date) AS l FROM bars WHERE close > 1040 AND volume > 140 GROUP BY 1) b USING (symbol)", fx.MEMBERS_SQL),
    "ing2_ingest_summary": fx.sql("SELECT *, succeeded / requested AS coverage, CASE WHEN succeeded / requested >= 0.99 THEN 0 WHEN succeeded / requested >= 0.8 THEN 2 ELSE 3 END AS code FROM (SELECT count(*) AS requested, count(*) FILTER (n % 5 <> 0) AS succeeded, count(*) FILTER (n % 5 = 0) AS failed, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY 1))"),
    "ing3_fallback_merge": fx.sql("SELECT symbol, bar_date, source, close FROM bars_by_source WHERE source = 'A' OR (source = 'R' AND (symbol, bar_date) NOT IN (SELECT (symbol, bar_date) FROM bars_by_source WHERE source = 'A'))", fx.SOURCES_SQL),
    "dq1_health_report": fx.sql("""SELECT *, CASE WHEN n_rows = 0 THEN 'RED' WHEN age_days IS NULL OR age_days <= 5 THEN 'GREEN' WHEN age_days <= 14 THEN 'YELLOW' ELSE 'RED' END AS status FROM
      (SELECT 'bars' AS table_name, count(*) AS n_rows, DATE '2001-12-10' - max(bar_date) AS age_days FROM bars UNION ALL SELECT 'membership:' || universe, count(*), NULL FROM membership WHERE end_date IS NULL GROUP BY universe)""", fx.MEMBERS_SQL),
}
SQL["snk4_sector_distribution"] = f"WITH {SECTORS_SQL} SELECT sector, count(*) AS n FROM sectors GROUP BY 1"
