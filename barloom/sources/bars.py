"""Reads of bars, series and events; vendor forms into canonical columns; JSON into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.keyed import newest


def _between(df: DataFrame, col: str, start, end) -> DataFrame:
    df = df if start is None else df.filter(F.col(col) >= F.lit(start))
    return df if end is None else df.filter(F.col(col) <= F.lit(end))


def read_bars(bars: DataFrame, *, symbols=None, start=None, end=None, source=None, exchange=None) -> DataFrame:
    """Filtered bars; of one (symbol, exchange, date) the row loaded last, then the last source."""
    df = _between(bars, "bar_date", start, end)
    for col, want in (("symbol", symbols), ("source", [source] if source else None), ("exchange", [exchange] if exchange else None)):
        df = df if want is None else df.filter(F.col(col).isin(want))
    return newest(df, ["symbol", "exchange", "bar_date"], ["ingested_at", "source"])


def read_universe_bars(bars: DataFrame, membership: DataFrame, universe: str, **options) -> DataFrame:
    """Bars of a universe's (symbol, exchange) pairs, so that equal tickers of two exchanges stay apart."""
    pairs = membership.filter(F.col("universe") == universe).select("symbol", "exchange").distinct()
    return read_bars(bars.join(pairs, ["symbol", "exchange"], "left_semi"), **options)


def read_series(macro: DataFrame, series: str, start=None, end=None) -> DataFrame:
    return _between(macro.filter(F.col("series") == series), "macro_date", start, end)


def read_events(events: DataFrame, date: str, *, start=None, end=None, **values) -> DataFrame:
    """Events in a range of dates; each further argument is a column and its allowed values."""
    df = _between(events, date, start, end)
    for col, want in values.items():
        df = df if want is None else df.filter(F.col(col).isin(want))
    return df


def panel_stats(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, symbols and date range of a column-pruned panel."""
    return panel.select(*columns).agg(F.count("*").alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"), F.min("bar_date").alias("first_date"), F.max("bar_date").alias("last_date"))


def normalise_vendor_bars(adjusted: DataFrame, unadjusted: DataFrame, exchange: str) -> DataFrame:
    """Adjusted bars with the unadjusted close of the same symbol and date, null where there is none."""
    raw = unadjusted.select("symbol", "bar_date", F.col("close").alias("close_unadj"))
    return adjusted.join(raw, ["symbol", "bar_date"], "left").select("symbol", F.lit(exchange).alias("exchange"), "bar_date", "open", "high", "low", "close", "volume", "close_unadj")


def vendor_symbol(symbol: Column, universe: Column) -> Column:
    """A vendor's spelling: dots become dashes, Indian symbols get ``.NS`` unless they have a suffix."""
    s = F.upper(F.trim(symbol))
    return F.when(universe == "IN", F.when(s.endswith(".NS"), s).otherwise(F.concat(s, F.lit(".NS")))).otherwise(F.regexp_replace(s, "\\.", "-"))


def _day(c: str) -> Column:
    return F.expr(f"try_to_timestamp({c}, 'yyyy-MM-dd')").cast("date")


def flatten_filings(df: DataFrame, json: str = "json") -> DataFrame:
    """Parallel arrays of a filer's document as rows (symbol, accession, filing_date, form_type, items).

    A document is parsed once, to VARIANT.  One that is null, no JSON or without
    these arrays gives no rows; an array that is shorter, or no array of
    strings, gives nulls.  Rows with a bad date go, empty items become null.
    """
    doc = df.select("symbol", F.try_parse_json(json).alias("_v"))
    lists = [F.try_variant_get("_v", f"$.{n}", "array<string>").alias(n) for n in ("accessionNumber", "filingDate", "form", "items")]
    rows = doc.select("symbol", *lists).filter("accessionNumber is not null")
    rows = rows.select("symbol", F.explode(F.arrays_zip("accessionNumber", *[F.coalesce(n, F.array().cast("array<string>")).alias(n) for n in ("filingDate", "form", "items")])).alias("_z"))
    out = rows.select("symbol", F.col("_z.accessionNumber").alias("accession"), _day("_z.filingDate").alias("filing_date"), F.col("_z.form").alias("form_type"), F.nullif("_z.items", F.lit("")).alias("items"))
    return out.filter("filing_date is not null")


def flatten_facts(df: DataFrame, fallbacks: dict[str, list[str]], json: str = "json") -> DataFrame:
    """USD observations of each concept, one per (symbol, period end, fp): the later name in its list wins, then the later observation.

    A document is an object of facts by name, parsed once to VARIANT and taken
    apart fact by fact; one that is null, no JSON or no object gives no rows,
    a fact without an array of dollars none either.  Rows without value, end or
    filing date go; null fp, form and accession become ``?``.
    """
    names = F.create_map(*[F.lit(x) for c, ns in fallbacks.items() for i, n in enumerate(ns) for x in (n, f"{i:04d}{c}")])
    doc = df.select("symbol", F.try_parse_json(json).alias("_v")).filter("startswith(schema_of_variant(_v), 'OBJECT')")
    facts = doc.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("_v").outer())).select("symbol", F.try_element_at(names, F.col("key")).alias("_c"), F.col("value").alias("_fact"))
    usd = F.try_variant_get("_fact", "$.units.USD", "array<variant>")
    rows = facts.filter("_c is not null").select("symbol", "_c", F.posexplode(usd).alias("pos", "_o"))

    def of(field: str, kind: str) -> Column:
        return F.try_variant_get("_o", f"$.{field}", kind).alias(field)

    rows = rows.select("symbol", "_c", "pos", of("val", "double"), *[of(x, "string") for x in ("end", "fp", "filed", "form", "accn")])
    out = rows.select(
        "symbol", F.expr("substring(_c, 5)").alias("concept"), F.expr("cast(substring(_c, 1, 4) as int)").alias("_p"), "pos", _day("end").alias("period_end"), F.coalesce("fp", F.lit("?")).alias("fp"),
        F.col("val").alias("value"), _day("filed").alias("filed_date"), F.coalesce("form", F.lit("?")).alias("form"), F.coalesce("accn", F.lit("?")).alias("accession"),
    ).filter("value is not null and period_end is not null and filed_date is not null")
    w = Window.partitionBy("symbol", "concept", "period_end", "fp").orderBy(F.desc("_p"), F.desc("pos"))
    return out.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_p", "pos")


def normalise_earnings(raw: DataFrame) -> DataFrame:
    """Local date of a time stamp, numbers where they parse."""
    return raw.select("symbol", F.to_date("announced_at").alias("announce_date"), *[F.expr(f"try_cast({c} as double)").alias(c) for c in ("eps_estimate", "eps_actual", "surprise_pct")])


def ticker_to_cik(df: DataFrame, json: str = "json") -> DataFrame:
    """Ticker in capitals and its ten-digit number."""
    one = df.select(F.from_json(json, "struct<ticker: string, cik_str: bigint>").alias("j"))
    return one.select(F.upper(F.trim("j.ticker")).alias("ticker"), F.lpad(F.col("j.cik_str").cast("string"), 10, "0").alias("cik")).filter("ticker is not null and cik is not null")


def sector_distribution(dim: DataFrame) -> DataFrame:
    return dim.groupBy("sector").agg(F.count("*").alias("n"))
