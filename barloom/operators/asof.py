"""As-of joins without range blow-up: both sides in one ordered pass per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import pct_rank
from .ordered import Cut
from .shared import written


def _merged(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, order: list[str], right_side: int) -> tuple[DataFrame, list[str]]:
    """Rows of both sides: keys, date, side, the left row or the right row as a struct."""
    keys = [F.col(k) for k in by]
    one = left.select(*keys, F.col(left_on).alias("_on"), F.lit(1 - right_side).alias("_side"), F.struct(*left.columns).alias("_l"))
    two = right.select(*keys, F.col(right_on).alias("_on"), F.lit(right_side).alias("_side"), F.struct(*right.columns).alias("_r"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    return one.unionByName(two, allowMissingColumns=True), [f"_o{i}" for i in range(len(order))]


def _flat(out: DataFrame, left: DataFrame, right: DataFrame, by: list[str], prefix: str) -> DataFrame:
    return out.filter("_l is not null").select("_l.*", *[F.col(f"_m.{c}").alias(f"{prefix}{c}") for c in right.columns if c not in by])


def _carried(both: DataFrame, by: list[str], order: list[Column], cut: Cut) -> DataFrame:
    """``both`` with ``_m``: the last right row so far in the order given, within each key.

    Rows are dealt out by range of (key, order), so a hot key is as many tasks
    as it has ranges.  A second pass over one row a range, its last right row,
    gives each range what comes before it.
    """
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(k) for k in by], *order]
    placed = cut(both.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    inside = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    tails = placed.groupBy(*by, "_part").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_at"))).alias("_tail"))
    before = F.last("_tail", True).over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carry = cut(tails.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("_part").alias("_p"), before.alias("_before")).filter("_before is not null"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = placed.withColumn("_m", F.last("_r", True).over(inside)).join(carry, same, "left")
    return out.withColumn("_m", F.coalesce("_m", "_before"))


def asof_last(
    left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, *, order: list[str] = (), exact: bool = True, prefix: str = "", cut: Cut = written
) -> DataFrame:
    """Every left row with the latest right row at or before its date (before it, if not ``exact``).

    Right rows of one date rank by ``order``; the last wins.  A matched row may
    hold nulls: it is carried whole.  Left rows without a match get nulls; null
    keys or dates on the right match nothing.  One key may hold most rows of
    either side.
    """
    right = right.dropna(subset=[*by, right_on])
    both, ties = _merged(left, right, list(by), left_on, right_on, list(order), 0 if exact else 1)
    return _flat(_carried(both, list(by), [F.col(c).asc() for c in ("_on", "_side", *ties)], cut), left, right, list(by), prefix)


def asof_next(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, *, order: list[str] = (), prefix: str = "", cut: Cut = written) -> DataFrame:
    """Every left row with the earliest right row after its date.

    Both sides are walked from the last date back, left rows of a date before
    its right rows; of one date's right rows the first by ``order`` wins.  A left
    row without a date has no right row after it.
    """
    right = right.dropna(subset=[*by, right_on])
    both, ties = _merged(left, right, list(by), left_on, right_on, list(order), 1)
    back = [F.col("_on").desc_nulls_first(), F.col("_side").asc(), *[F.col(t).desc() for t in ties]]
    return _flat(_carried(both, list(by), back, cut), left, right, list(by), prefix)


def asof_picks(left: DataFrame, right: DataFrame, left_on: str, right_on: str, picks: dict[str, tuple[Column, str]], *, order: list[str] = (), by: str = "symbol", also=None) -> DataFrame:
    """Every left row with one value for each pick: that of the latest right row at or before its date which meets the pick's condition.

    ``picks`` maps a new name to (condition, column) on the right side.  Right
    rows of one date rank by ``order``; the last wins, nulls included.  However
    many picks, both sides are put in order once.  ``also`` gives further columns
    from the right row (struct ``_r``, null on left rows), for windows over keys and date ``_on``.
    """
    right = right.dropna(subset=[by, right_on])
    met = [F.when(c, F.struct(F.col(x).alias("v"))).alias(f"_p{i}") for i, (c, x) in enumerate(picks.values())]
    one = left.select(F.col(by), F.col(left_on).alias("_on"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    two = right.select(F.col(by), F.col(right_on).alias("_on"), F.lit(0).alias("_side"), *met, F.struct(*right.columns).alias("_r"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    both = one.unionByName(two, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("_on", "_side", *[f"_o{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    more = also or {}
    both = both.withColumns({**{f"_p{i}": F.last(f"_p{i}", True).over(w) for i in range(len(picks))}, **more})
    kept = [F.col(by if c == by else f"_l.`{c}`") for c in left.columns]  # the key itself, so that Spark knows how rows are dealt out
    return both.filter("_l is not null").select(*kept, *[F.col(f"_p{i}.v").alias(n) for i, n in enumerate(picks)], *more)


def within(days: Column, most: int) -> Column:
    """Days as a double, null beyond ``most``."""
    return F.when(days <= most, days.cast("double"))


def earnings_features(panel: DataFrame, events: DataFrame) -> DataFrame:
    """Days since and to announcements, the last surprise and its z against the eight before it (four at least)."""
    past = Window.partitionBy("symbol").orderBy("announce_date").rowsBetween(-8, -1)
    x = F.col("surprise_pct")
    std = F.stddev_samp(x).over(past)
    ev = events.withColumn("z", F.when((F.count(x).over(past) >= 4) & (std > 0), (x - F.avg(x).over(past)) / std))
    always = F.lit(True)
    back = Window.partitionBy("symbol").orderBy(F.desc("_on"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    picks = {"_date": (always, "announce_date"), "_surprise": (always, "surprise_pct"), "_z": (always, "z")}
    out = asof_picks(panel, ev, "bar_date", "announce_date", picks, also={"_next": F.last("_r.announce_date", True).over(back)})
    return out.withColumns(
        {
            "earnings__days_since_last_earnings": within(F.datediff("bar_date", "_date"), 90), "earnings__days_to_next_earnings": within(F.datediff("_next", "bar_date"), 60),
            "earnings__last_surprise_pct": F.col("_surprise"), "earnings__last_surprise_z_252": F.col("_z"),
        }
    ).drop("_date", "_surprise", "_z", "_next")


#: Form and item of the filings that each column counts the days since, and the most days.
SINCE = {"days_since_last_8k": ("8-K", None, 90), "days_since_last_8k_2_02": ("8-K", "2.02", 90), "days_since_last_8k_5_02": ("8-K", "5.02", 90), "days_since_last_10q": ("10-Q", None, 120), "days_since_last_10k": ("10-K", None, 400)}


def filing_features(panel: DataFrame, filings: DataFrame) -> DataFrame:
    """Days since filings by form and item, capped, and the number of 8-Ks of the last 30 days."""
    def of(form, item):
        own = F.col("form_type") == form
        return own & F.array_contains(F.split("items", ","), item) if item else own

    month = Window.partitionBy("symbol").orderBy(F.unix_date("_on")).rangeBetween(-29, 0)
    count = F.count(F.when(F.col("_r.form_type") == "8-K", 1)).over(month)
    out = asof_picks(panel, filings, "bar_date", "filing_date", {f"_{n}": (of(form, item), "filing_date") for n, (form, item, _) in SINCE.items()}, also={"_n": count})
    days = {f"sec_events__{n}": within(F.datediff("bar_date", f"_{n}"), cap) for n, (*_, cap) in SINCE.items()}
    return out.withColumns({**days, "sec_events__count_8k_last_30d": F.col("_n").cast("double")}).drop("_n", *[f"_{n}" for n in SINCE])


def safe_div(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d)


def _ratios(value) -> dict[str, Column]:
    return {
        "roe": safe_div(value("NetIncome"), value("Equity")), "debt_to_equity": safe_div(value("Debt"), value("Equity")), "gross_margin": safe_div(value("GrossProfit"), value("Revenue")),
        "net_margin": safe_div(value("NetIncome"), value("Revenue")), "asset_turnover": safe_div(value("Revenue"), value("Assets")),
    }


def latest_values(panel: DataFrame, facts: DataFrame, concepts: list[str], prefix: str = "") -> DataFrame:
    """``panel`` with each concept's value filed last at or before the date; of one date's filings that of the last period, then the largest."""
    rows = facts.select("symbol", "concept", "filed_date", "period_end", "value")
    return asof_picks(panel, rows, "bar_date", "filed_date", {prefix + c: (F.col("concept") == c, "value") for c in concepts}, order=["period_end", "value"])


CONCEPTS = ["NetIncome", "Equity", "Debt", "Revenue", "GrossProfit", "Assets"]


def fundamentals_annual(panel: DataFrame, facts: DataFrame) -> DataFrame:
    """Ratios of the latest annual values known on the date."""
    out = latest_values(panel, facts.filter("fp = 'FY'"), CONCEPTS, "_")
    ratios = {f"sec_fundamentals__{n}": e for n, e in _ratios(lambda c: F.col(f"_{c}")).items()}
    return out.withColumns(ratios).drop(*[f"_{c}" for c in CONCEPTS])


def trailing_year(facts: DataFrame) -> DataFrame:
    """(symbol, concept, filed_date, period_end, value): sum of four quarters, each its last filed value, from the last one's filing on."""
    last = Window.partitionBy("symbol", "concept", "period_end").orderBy(F.desc("filed_date"), F.desc("value"))
    q = facts.filter("fp = 'Q'").withColumn("_k", F.row_number().over(last)).filter("_k = 1")
    four = Window.partitionBy("symbol", "concept").orderBy("period_end").rowsBetween(-3, 0)
    return q.select("symbol", "concept", "filed_date", "period_end", F.when(F.count("value").over(four) == 4, F.sum("value").over(four)).alias("value"))


def fundamentals_ttm(panel: DataFrame, facts: DataFrame) -> DataFrame:
    """Ratios of trailing-year flows and latest stocks known on the date."""
    flow = F.col("concept").isin("NetIncome", "Revenue", "GrossProfit")
    flows = trailing_year(facts.filter(flow))
    out = latest_values(panel, flows.unionByName(facts.filter(~flow).select(*flows.columns)), CONCEPTS, "_")
    ratios = {f"sec_fundamentals_v2__{n}" + ("" if n == "debt_to_equity" else "_ttm"): e for n, e in _ratios(lambda c: F.col(f"_{c}")).items()}
    return out.withColumns(ratios).drop(*[f"_{c}" for c in CONCEPTS])


TTM = ["sec_fundamentals_v2__roe_ttm", "sec_fundamentals_v2__debt_to_equity", "sec_fundamentals_v2__gross_margin_ttm", "sec_fundamentals_v2__net_margin_ttm", "sec_fundamentals_v2__asset_turnover_ttm"]


def fundamentals_ranks(panel: DataFrame) -> DataFrame:
    """Each trailing ratio's percentile rank among the symbols of the date."""
    return panel.withColumns({f"{c}_xs_rank": pct_rank(c, "bar_date") for c in TTM if c in panel.columns})


def fundamentals_ttm_ranked(panel: DataFrame, facts: DataFrame) -> DataFrame:
    """``fundamentals_ttm`` with the ranks of its ratios."""
    return fundamentals_ranks(fundamentals_ttm(panel, facts))
