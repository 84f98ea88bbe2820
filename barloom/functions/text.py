"""Text and JSON operators over filings, news and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_html(html: Column, item: str = r"Item \d+\.\d{2}", after: int = 200) -> Column:
    """Tags, scripts and styles out, white space collapsed; cut to the first item heading if it starts after ``after`` characters."""
    x = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"[ \t\r\n\f]+", " "))
    at = F.regexp_instr(x, F.lit(item))
    return F.when(at > after, F.substring(x, at, F.length(x))).otherwise(x)


def truncate_body(df: DataFrame, text: str = "text", n: int = 8000) -> DataFrame:
    """The first n characters, and the length of the whole."""
    return df.withColumn("body_chars", F.length(text).cast("long")).withColumn("body", F.substring(text, 1, n))


def is_exhibit(name: Column) -> Column:
    """Names like ``ex99`` or ``ex-99`` that are no media or data files."""
    return name.rlike(r"(?i)ex.?99") & ~name.rlike(r"(?i)\.(jpg|jpeg|gif|png|pdf|zip|xsd|xml|css|js)$")


def recent_filings(filings: DataFrame, *, since, forms: list[str], k: int = 8) -> DataFrame:
    """The newest k filings of the given forms per symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("filing_date"), F.desc("accession"))
    rows = filings.filter(F.col("form_type").isin(forms) & (F.col("filing_date") >= F.lit(since).cast("date")))
    return rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k)


#: Item codes and their descriptions (fixed values).
ITEMS = {"1.01": "Entry into a material agreement", "2.02": "Results of operations", "5.02": "Change of directors or officers", "7.01": "Regulation FD disclosure", "8.01": "Other events", "9.01": "Financial statements and exhibits"}


def derive_title(form: Column, items: Column) -> Column:
    """Form and the descriptions of its items; unknown codes stay as they are."""
    known = F.create_map(*[F.lit(x) for kv in ITEMS.items() for x in kv])
    told = F.transform(F.split(items, ","), lambda c: F.coalesce(F.try_element_at(known, F.trim(c)), F.trim(c)))
    return F.when(items.isNull() | (items == ""), form).otherwise(F.concat(form, F.lit(": "), F.array_join(told, "; ")))


def source_digest(articles: DataFrame, by: str, order: str, text: str, *, k: int = 5, n: int = 200) -> DataFrame:
    """Per key the first k texts, numbered and cut to n characters, as one block."""
    w = Window.partitionBy(by).orderBy(order)
    top = articles.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k)
    line = F.concat(F.lit("["), F.col("k").cast("string"), F.lit("] "), F.substring(text, 1, n))
    held = F.array_sort(F.collect_list(F.struct(F.col("k").alias("k"), line.alias("line"))))
    return top.groupBy(by).agg(F.array_join(F.transform(held, lambda x: x.line), "\n\n").alias("digest"), F.count("*").alias("n_sources"))


def coerce_verdict(x: Column) -> Column:
    v = F.lower(F.trim(x))
    return F.when(v.contains("bull") | v.contains("positive") | v.contains("buy"), "bullish").when(v.contains("bear") | v.contains("negative") | v.contains("sell"), "bearish").otherwise("neutral")


def coerce_confidence(x: Column) -> Column:
    """Words, percentages and shares to [0, 1]; 0.5 if nothing fits."""
    v = F.lower(F.trim(x))
    number = F.regexp_replace(v, "%", "").try_cast("double")
    share = F.when(v.contains("%") | (number > 1), number / 100).otherwise(number)
    word = F.when(v == "high", 0.8).when(v == "medium", 0.5).when(v == "low", 0.3)
    return F.least(F.greatest(F.coalesce(share, word, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))


def coerce_list(x: Column, most: int = 10, chars: int = 200) -> Column:
    """A JSON list of texts, at most ``most`` of at most ``chars`` characters; empty if it does not parse."""
    return F.transform(F.slice(F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>")), 1, most), lambda y: F.substring(y, 1, chars))


def latest_verdicts(v: DataFrame) -> DataFrame:
    newest = v.agg(F.max("verdict_date").alias("verdict_date"))
    return v.join(F.broadcast(newest), "verdict_date").withColumn("reasons", coerce_list(F.col("reasons_json")))


def verdict_counts(v: DataFrame) -> DataFrame:
    return v.groupBy("verdict", "side").agg(F.count("*").alias("n"))
