"""Hand-computed values, causality, idempotence."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import features as f
from barloom.functions import panel, recursion, series
from barloom.functions import panel_features as pf
from barloom.functions.windows import average_rank, pct_rank
from barloom.operators import asof, clean, evaluate, keyed, labels, models, pit
from barloom.operators.keyed_table import KeyedTable
from barloom.operators import portfolio as po
from barloom.operators.shared import by_rows, written
from barloom.plans.q_features import NAMES, columns
from barloom.sources import bars
from barloom.streaming import stream


def day(n):
    return dt.date(2011, 5, 17) + dt.timedelta(days=n)


def walk(symbols=2, n=290, seed=3):
    rng = np.random.default_rng(seed)
    parts = []
    for s in range(symbols):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        open_ = close * np.exp(rng.normal(0, 0.01, n))
        parts.append(pd.DataFrame({"symbol": f"S{s}", "bar_date": [day(i) for i in range(n)], "open": open_, "high": np.maximum(open_, close) * 1.01, "low": np.minimum(open_, close) * 0.99, "close": close, "volume": rng.integers(1000, 9000, n).astype(float)}))
    return pd.concat(parts)


def all_features(bars):
    out = f.prepared(bars)
    for group in f.GROUPS.values():
        out = group(out)
    return out


def test_counts_of_columns():
    assert {g: len(n) for g, n in NAMES.items()} == {"price": 8, "trend": 16, "momentum": 16, "volatility": 13, "volume": 10, "microstructure": 6, "market_structure": 4, "volume_profile": 3, "swings": 12}


def test_features_use_no_later_bars(spark):
    bars = walk()
    cut = day(263)
    broken = bars.copy()
    late = broken["bar_date"] > cut
    broken.loc[late, ["open", "high", "low", "close"]] *= [3.1, 4.7, 0.2, 2.3]
    broken.loc[late, "volume"] += 5e5
    names = [c for g in NAMES for c in columns(g)]
    a, b = (all_features(spark.createDataFrame(x)).filter(F.col("bar_date") <= F.lit(cut)).select("symbol", "bar_date", *names).toPandas().sort_values(["symbol", "bar_date"]).reset_index(drop=True) for x in (bars, broken))
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9)


def gappy(n, seed, symbols=1):
    """Bars with missing closes here and there, and some at the start."""
    bars = walk(symbols, n, seed)
    bars.loc[np.random.default_rng(seed).random(len(bars)) < 0.02, "close"] = np.nan
    bars.loc[bars["bar_date"] < day(3), "close"] = np.nan
    return bars


def plain_means(b):
    """The recursive means over a whole series at once."""
    h, lo, c, v = (b[x].reset_index(drop=True) for x in ("high", "low", "close", "volume"))

    def mean(x, alpha, least):
        return x.ewm(alpha=alpha, adjust=False, min_periods=least).mean()

    tr = pd.concat([h - lo, (h - c.shift(1)).abs(), (lo - c.shift(1)).abs()], axis=1).max(axis=1)
    up, down = h.diff(), -lo.diff()
    out = {f"ema{n}": mean(c, 2 / (n + 1), n) for n in (12, 20, 26)} | {f"atr_{n}": mean(tr, 1 / n, n) for n in (7, 14, 21)}
    out["macd"] = out["ema12"] - out["ema26"]
    out["macd_signal"] = mean(out["macd"], 0.2, 9)
    for name, x, y in (("di_plus", up, down), ("di_minus", down, up)):
        out[name] = 100 * mean(x.where((x > y) & (x > 0), 0.0), 1 / 14, 14) / out["atr_14"]
    both = (out["di_plus"] + out["di_minus"]).replace(0.0, np.nan)
    out["adx"] = mean(100 * (out["di_plus"] - out["di_minus"]).abs() / both, 1 / 14, 14)
    for n in (7, 14, 21, 28):
        out[f"rsi_{n}"] = 100 - 100 / (1 + mean(c.diff().clip(lower=0), 1 / n, n) / mean((-c.diff()).clip(lower=0), 1 / n, n).replace(0.0, np.nan))
    out["force_13"] = mean(c.diff() * v, 2 / 14, 13)
    y, seeded = tr[:14].mean(), [np.nan] * 13
    for i in range(13, len(tr)):
        y = y if i == 13 or np.isnan(tr[i]) else y * 13 / 14 + tr[i] / 14
        seeded.append(y)
    return pd.DataFrame(out | {"seeded_atr": seeded[: len(tr)]})


def close_to(a, b):
    """Equal but for rounding, which is that of the column's largest values."""
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in b.columns:
        if b[c].dtype == object:
            assert a[c].tolist() == b[c].tolist()
        else:
            np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=1e-9, atol=1e-10 * np.nanmax(np.abs(b[c].to_numpy(float)), initial=1e-9), err_msg=c)


def in_blocks(spark, bars, size, names=None):
    got = series.sequential(spark.createDataFrame(bars.sample(frac=1, random_state=1)).withColumn("close", F.nanvl("close", F.lit(None))), names, size=size)
    return got.toPandas().sort_values(["symbol", "bar_date"]).reset_index(drop=True)


def test_a_long_series_in_fifty_blocks_is_the_series_in_one(spark):
    bars = pd.concat([gappy(280 * 50 - 3, 5), gappy(600, 6).assign(symbol="T"), gappy(9, 7).assign(symbol="U")])
    cut, whole = in_blocks(spark, bars, 280), in_blocks(spark, bars, 10**6)
    close_to(cut, whole)
    for s in ("S0", "T", "U"):
        mine = plain_means(bars[bars["symbol"] == s])
        got = cut[cut["symbol"] == s][list(mine.columns)].reset_index(drop=True)
        close_to(got, mine)


def test_no_block_holds_a_hot_symbol(spark):
    rows = spark.createDataFrame(gappy(2000, 5)).withColumn("_rank", F.datediff("bar_date", F.lit(day(0))).cast("long")).withColumn("_total", F.lit(2000))
    sizes = series._blocks(rows, 400).groupBy("_block").agg(F.count("*").alias("n"), F.sum(F.col("_own").cast("int")).alias("own")).orderBy("_block").collect()
    assert [(r.n, r.own) for r in sizes] == [(400, 400)] + [(680, 400)] * 4


def test_order_statistics_by_plain_loops(spark):
    bars = gappy(420, 8)
    got = in_blocks(spark, bars, 280, ["aroon_up", "aroon_down", "distance_14", "squeeze", "vol_rank", *recursion.SWINGS])
    h, lo, c = (bars[x].reset_index(drop=True) for x in ("high", "low", "close"))
    width = 4 * c.rolling(20).std() / c.rolling(20).mean()
    vol = np.log(c).diff().rolling(20).std()
    last = {"high": (np.nan, np.nan), "low": (np.nan, np.nan)}
    for t in range(420):
        r = got.iloc[t]
        if t >= 24:
            assert r["aroon_up"] == 4 * (np.argmax(h[t - 24 : t + 1].to_numpy()) + 1) and r["aroon_down"] == 4 * (np.argmin(lo[t - 24 : t + 1].to_numpy()) + 1)
        tp = ((h + lo + c) / 3)[max(0, t - 13) : t + 1]
        assert r["distance_14"] == pytest.approx((tp - tp.mean()).abs().mean() if t >= 13 and tp.notna().all() else np.nan, nan_ok=True)
        for name, x in (("squeeze", width), ("vol_rank", vol)):
            past = x[max(0, t - 251) : t].dropna()
            want = np.nan if len(past) < 99 or np.isnan(x[t]) else float(x[t] <= past.quantile(0.2)) if name == "squeeze" else (past < x[t]).mean()
            assert r[name] == pytest.approx(want, nan_ok=True)
        for side, x, pick in (("high", h, max), ("low", lo, min)):
            if t >= 10 and x[t - 5] == pick(x[t - 10 : t + 1]):
                last[side] = (x[t - 5], t - 5)
            level, at = last[side]
            near = ((x[max(0, t - 49) : t + 1] - level).abs() / level <= 0.005).sum()
            assert [r[n] for n in (f"swing_{side}", f"swing_{side}_age", f"swing_{side}_touches")] == pytest.approx([level, t - at, near if level > 0 else np.nan], nan_ok=True)


def plain_profile(low, high, volume, close):
    """The volume profile of one window, bin by bin."""
    edges = np.linspace(low.min(), high.max(), 21)
    size = np.zeros(20)
    for a, z, v in zip(low, high, volume, strict=True):
        if z > a and v > 0:
            first, last = max(0, sum(e <= a for e in edges) - 1), min(19, sum(e < z for e in edges))
            size[first : last + 1] += v / (last - first + 1)
    size = np.round(size, 9)
    peak = int(np.argmax(size))
    lo = hi = peak
    while size[lo : hi + 1].sum() < 0.7 * size.sum() - 1e-9:
        below, above = (size[lo - 1] if lo else -1), (size[hi + 1] if hi < 19 else -1)
        lo, hi = (lo - 1, hi) if below >= above else (lo, hi + 1)
    return [(close - x) / close for x in ((edges[peak] + edges[peak + 1]) / 2, edges[hi + 1], edges[lo])]


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_volume_profile_by_bars(seed, monkeypatch):
    monkeypatch.setattr(recursion, "WINDOWS", 16)
    bars = walk(1, 120, seed)
    bars.loc[bars.index % 9 == 0, "volume"] = 0.0
    bars.loc[bars.index % 13 == 0, "high"] = bars["low"]
    h, lo, v, c = (bars[x].to_numpy(float) for x in ("high", "low", "volume", "close"))
    got = recursion.volume_profile(h, lo, c, v)
    assert np.isnan(got[:, :49]).all()
    for t in range(49, 120):
        w = slice(t - 49, t + 1)
        assert got[:, t].tolist() == pytest.approx(plain_profile(lo[w], h[w], v[w], c[t]))


def test_forward_return_and_quintiles(spark):
    bars = spark.createDataFrame([("A", day(i), float(100 + i)) for i in range(7)], "symbol string, bar_date date, close double")
    got = labels.forward_return(bars).orderBy("bar_date").toPandas()["fwd_return_5d"]
    assert got[0] == pytest.approx(np.log(105 / 100)) and got[2:].isna().all()
    panel = spark.createDataFrame([(f"S{i}", day(0), float(i)) for i in range(6)], "symbol string, bar_date date, x double")
    mem = spark.createDataFrame([("U", f"S{i}", "X", day(-5), day(-1) if i == 5 else None) for i in range(6)], "universe string, symbol string, exchange string, start_date date, end_date date")
    q = {r.symbol: r.quintile for r in labels.quantile_label(panel, mem, "x").collect()}
    assert [q[f"S{i}"] for i in range(6)] == [0, 1, 2, 3, 4, None]


def test_asof_matches_carry_nulls_and_ties(spark):
    left = spark.createDataFrame([("A", day(i)) for i in range(5)], "k string, d date")
    right = spark.createDataFrame([("A", day(1), 1, None), ("A", day(3), 1, 7.0), ("A", day(3), 2, 8.0), (None, day(0), 1, 5.0)], "k string, e date, o int, v double")
    got = {r.d: (r.r_e, r.r_v) for r in asof.asof_last(left, right, ["k"], "d", "e", order=["o"], prefix="r_").collect()}
    assert got == {day(0): (None, None), day(1): (day(1), None), day(2): (day(1), None), day(3): (day(3), 8.0), day(4): (day(3), 8.0)}
    nxt = {r.d: r.r_e for r in asof.asof_next(left, right, ["k"], "d", "e", order=["o"], prefix="r_").collect()}
    assert nxt == {day(0): day(1), day(1): day(3), day(2): day(3), day(3): None, day(4): None}


@pytest.mark.parametrize("parts", ["1", "7"])
def test_asof_over_ranges_is_that_of_each_key(spark, parts):
    rng = np.random.default_rng(int(parts))
    keys = lambda n: [int(k) if k else None for k in rng.choice([0, 1, 1, 1, 2, 3], n)]  # noqa: E731  a key with half of the rows, and rows without one
    ls = [(k, i, day(int(d)) if d < 190 else None) for i, (k, d) in enumerate(zip(keys(400), rng.integers(0, 200, 400), strict=True))]
    rs = [(k, day(int(d)) if d < 190 else None, i, None if i % 5 == 0 else float(i)) for i, (k, d) in enumerate(zip(keys(150), rng.integers(0, 200, 150), strict=True))]
    left, right = spark.createDataFrame(ls, "k int, i int, d date"), spark.createDataFrame(rs, "k int, e date, o int, v double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        last, strict, nxt = (
            {r.i: (r.e, r.o, r.v) for r in f(left, right, ["k"], "d", "e", order=["o"], **more).collect()} for f, more in ((asof.asof_last, {}), (asof.asof_last, {"exact": False}), (asof.asof_next, {}))
        )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for k, i, d in ls:
        own = sorted((e, o, v) for q, e, o, v in rs if q == k and None not in (q, e)) if None not in (k, d) else []
        at = lambda x: x[-1] if x else (None, None, None)
        assert last[i] == at([r for r in own if r[0] <= d]) and strict[i] == at([r for r in own if r[0] < d])
        after = [r for r in own if r[0] > d]
        assert nxt[i] == (after[0] if after else (None, None, None))
    assert len(last) == len(strict) == len(nxt) == 400


def test_surprise_z(spark):
    before = [-2.0, 0.5, 1.5, 6.0]
    ev = spark.createDataFrame([("A", day(45 * i), x) for i, x in enumerate([*before, -4.0])], "symbol string, announce_date date, surprise_pct double")
    panel = spark.createDataFrame([("A", day(190)), ("A", day(-3)), ("A", day(-61)), ("B", day(190))], "symbol string, bar_date date")
    got = {(r.symbol, r.bar_date): r for r in asof.earnings_features(panel, ev).collect()}
    r = got["A", day(190)]
    assert r.earnings__last_surprise_z_252 == pytest.approx((-4.0 - np.mean(before)) / np.std(before, ddof=1)) and r.earnings__days_since_last_earnings == 10.0
    assert r.earnings__days_to_next_earnings is None and r.earnings__last_surprise_pct == -4.0
    assert got["A", day(-3)].earnings__days_to_next_earnings == 3.0 and got["A", day(-61)].earnings__days_to_next_earnings is None
    assert got["B", day(190)].earnings__last_surprise_pct is None and len(got) == 4


def test_filings_and_facts_in_one_pass(spark):
    panel = spark.createDataFrame([("A", day(i)) for i in range(0, 130, 10)] + [("A", day(0))], "symbol string, bar_date date")
    fl = spark.createDataFrame([("A", day(5), "8-K", "2.02,9.01", "a"), ("A", day(5), "8-K", None, "b"), ("A", day(30), "10-Q", None, "c"), ("A", day(31), "8-K", "5.02", "d")], "symbol string, filing_date date, form_type string, items string, accession string")
    got = {r.bar_date: r for r in asof.filing_features(panel, fl).collect()}
    assert asof.filing_features(panel, fl).count() == 14  # a repeated row stays
    assert [got[day(i)].sec_events__count_8k_last_30d for i in (0, 10, 30, 40, 60, 70)] == [0, 2, 2, 1, 1, 0]
    assert got[day(40)].sec_events__days_since_last_8k == 9 and got[day(40)].sec_events__days_since_last_8k_2_02 == 35 and got[day(120)].sec_events__days_since_last_10q == 90
    facts = [("A", "Equity", day(0), "FY", 10.0, day(3)), ("A", "NetIncome", day(0), "FY", 2.0, day(3)), ("A", "Equity", day(50), "FY", 20.0, day(53)), ("A", "Equity", day(40), "FY", 99.0, day(53)), ("A", "NetIncome", day(50), "FY", None, day(60))]
    facts = spark.createDataFrame(facts, "symbol string, concept string, period_end date, fp string, value double, filed_date date")
    got = {r.bar_date: r.sec_fundamentals__roe for r in asof.fundamentals_annual(panel, facts).collect()}
    assert got[day(0)] is None and got[day(10)] == 0.2 and got[day(50)] == 0.2 and got[day(60)] is None


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, t int")
    once = keyed.upsert(old, new, ["k"], ["t"])
    twice = keyed.upsert(once, new, ["k"], ["t"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]


def test_timeline(spark):
    cur = spark.createDataFrame([("LIVE", None), ("OLD", day(0))], "symbol string, date_added date")
    ch = [("LIVE", day(10), "add"), ("GONE", day(1), "add"), ("GONE", day(5), "remove"), ("GONE", day(7), "add"), ("LONE", day(9), "remove")]
    got = pit.membership_timeline(cur, spark.createDataFrame(ch, "symbol string, change_date date, action string"), day(99), day(-100))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("LIVE", day(10), None), ("OLD", day(0), None), ("GONE", day(1), day(5)), ("GONE", day(7), day(99)), ("LONE", day(-100), day(9))], key=str)


def test_documents_that_are_not_what_they_should_be(spark):
    good = '{"accessionNumber": ["a", "b", "c"], "filingDate": ["2020-01-02", "bad", "2020-03-04"], "form": ["8-K", "10-Q"], "items": ["", "x", "2.02"]}'
    docs = spark.createDataFrame([("A", good), ("B", good[:-3]), ("C", None), ("D", "[1, 2]"), ("E", "{}"), ("F", '{"accessionNumber": "a"}'), ("G", "7"), ("H", "")], "symbol string, json string")
    got = sorted((r.symbol, r.accession, str(r.filing_date), r.form_type, r.items) for r in bars.flatten_filings(docs).collect())
    assert got == [("A", "a", "2020-01-02", "8-K", None), ("A", "c", "2020-03-04", None, "2.02")]
    ob = '{{"val": {}, "end": "2020-03-31", "filed": "{}", "fp": {}}}'
    x = '{"new": {"units": {"USD": [%s, %s]}}, "old": {"units": {"USD": [%s, {"val": "text", "end": "2020-06-30", "filed": "2020-07-01"}]}}, "other": {"units": {}}, "odd": 5}' % (
        ob.format(1.5, "2020-04-01", '"Q1"'), ob.format(2, "2020-05-01", "null"), ob.format(9, "2020-06-01", '"Q1"')
    )
    docs = spark.createDataFrame([("A", x), ("B", x[:-1]), ("C", None), ("D", "[]"), ("E", '"s"'), ("F", '{"new": null}')], "symbol string, json string")
    got = sorted((r.symbol, r.fp, r.value, str(r.filed_date)) for r in bars.flatten_facts(docs, {"X": ["new", "old", "other", "odd"]}).collect())
    assert got == [("A", "?", 2.0, "2020-05-01"), ("A", "Q1", 9.0, "2020-06-01")]  # the later name wins


def test_sector_labels(spark):
    rows = [("Communications Services", "Communication Services"), (" Financials", "Financial Services"), ("Financial Services", "Financial Services"), ("Materials", "Basic Materials"), ("", "Unknown"), (None, "Unknown"), ("Space", "Space"), ("UNKNOWN", "UNKNOWN")]
    got = spark.createDataFrame(rows, "label string, want string").select(pf.canonical_sector(F.col("label")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    dim = spark.createDataFrame([(f"S{i}", x) for i, (x, _) in enumerate(rows)], "symbol string, sector string")
    flags = {r.symbol: r.asDict() for r in pf.sector_flags(spark.createDataFrame([(f"S{i}",) for i in range(9)], "symbol string"), dim).collect()}
    names = {k for k in flags["S0"] if k.startswith("sector__is_")}
    assert len(names) == 12 and {"sector__is_financial_services", "sector__is_communication_services", "sector__is_unknown"} <= names
    assert all(sum(r[n] for n in names) == 1 for r in flags.values()) and all(flags[f"S{i}"]["sector__is_unknown"] == 1 for i in (4, 5, 6, 7, 8))


def test_summary_of_a_year(spark):
    rng = np.random.default_rng(6)
    rows = [(f"S{s}", day(-7 * d), float(x), None if d == 0 else float(0.3 * x + y), float(p)) for d in range(60) for s, (x, y, p) in enumerate(rng.normal(0, 1, (12, 3)) * [1, 1, 0] + [0, 0, 1] * rng.random((12, 1)))]
    p = spark.createDataFrame(rows, "symbol string, as_of date, predicted_return double, realized_return double, top_p double")
    p = p.withColumn("realized_quintile", F.when(F.col("realized_return").isNotNull(), F.pmod(F.xxhash64("symbol", "as_of"), F.lit(5)).cast("int")))
    r = evaluate.performance_summary(p, day(0), written, days=100).first()
    pdf = p.toPandas()
    pdf = pdf[pd.to_datetime(pdf["as_of"]) >= pd.Timestamp(day(0)) - pd.Timedelta(days=143)]
    done = pdf.dropna(subset=["realized_return"])
    assert (r.n_predictions, r.n_settled) == (len(pdf), len(done)) and r.n_dates == done["as_of"].nunique()
    b = pd.qcut(done["predicted_return"], 10, labels=False)
    assert r.decile_spread == pytest.approx(done["realized_return"][b == 9].mean() - done["realized_return"][b == 0].mean())
    cut = pd.cut(done["top_p"], [0, 0.2, 0.4, 0.6, 0.8, 1], include_lowest=True, labels=False)
    for c in r.calibration:
        own = done[cut == c.bin]
        assert c.n == len(own) and c.mean_proba == pytest.approx(own["top_p"].mean()) and c.observed_rate == pytest.approx((own["realized_quintile"] == 4).mean())
    none = evaluate.performance_summary(p, day(-5000), written).first()
    assert (none.n_predictions, none.n_settled, none.mean_ic, none.decile_spread, none.calibration) == (0, 0, None, None, [])


def test_models_name_what_they_lack(training):
    with pytest.raises(ValueError, match="no rows"):
        models.fit(training.filter("fold > 9"), ["a"], "y", "label")
    with pytest.raises(ValueError, match="b$"):
        models.fit(training.withColumn("b", F.lit(None).cast("double")), ["a", "b"], "y", "label")


def test_a_batch_touches_its_own_parts(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}", "k int, day date, v string, kept string", F.month("day"))
    rows = lambda x, s="k int, day date, v string, kept string": spark.createDataFrame(x, s)
    table.upsert(rows([(i, dt.date(2020, 1 + i % 12, 5), "old", f"k{i}") for i in range(120)]), 0, ["k", "day"], ["v"])
    before = table._paths(None)
    batch = rows([(1, dt.date(2020, 2, 5), "new"), (999, dt.date(2020, 2, 5), "new")], "k int, day date, v string")
    for version in (1, 2):  # the same again
        table.upsert_preserving(batch, version, ["k", "day"], ["v"])
        got = {(r.k, r.day): (r.v, r.kept) for r in table.read().collect()}
        assert len(got) == 121 and got[1, dt.date(2020, 2, 5)] == ("new", "k1") and got[999, dt.date(2020, 2, 5)] == ("new", None)
    assert [p for p, x in table._paths(None).items() if x != before[p]] == [2]


def test_source_causes(spark):
    rows = [("A", day(0), "x", 200.0, 1.0), ("A", day(0), "y", 100.0, 1.0), ("B", day(0), "x", 100.0, 90.0), ("B", day(0), "y", 102.0, 100.0), ("C", day(0), "x", 100.0, 1.0), ("C", day(0), "y", 100.1, 1.0)]
    got = clean.compare_sources(spark.createDataFrame(rows, "symbol string, bar_date date, source string, close double, close_unadj double"), 1.0)
    assert {r.symbol: r.cause for r in got.collect()} == {"A": "split", "B": "dividend"}


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "symbol string, bar_date date, open double, high double, low double, close double, volume double")
    assert all_features(e).count() == 0 and pf.regime_by_date(f.price(e)).count() == 0
    assert po.equity_curve(e.select("bar_date", F.lit(0.1).alias("ret"))).count() == 0
    assert labels.purged_folds(e.select("bar_date")).count() == 0


def test_folds_do_not_touch(spark):
    dates = spark.createDataFrame([(day(i),) for i in range(700)], "bar_date date")
    folds = sorted(labels.purged_folds(dates).collect(), key=lambda r: r.fold)
    assert len(folds) == 5 and folds[-1].val_end == day(699)
    for r in folds:
        assert (r.val_start - r.train_end).days > 5


def test_groups_are_replaced_skipped_and_gated(spark):
    bars = spark.createDataFrame(walk(2, 30))
    reg = panel.Registry()
    reg.register("symbol", "one", lambda b, t: b.withColumn("one__x", F.lit(1.0)))
    reg.register("symbol", "bad", lambda b, t: b.withColumn("bad__x", F.col("no such column")))
    reg.register("panel", "gated", lambda p, t: p.withColumn("gated__x", F.lit(len(t))), ("extra",))
    reg.register("symbol", "one", lambda b, t: b.withColumn("one__x", F.lit(2.0)))
    assert reg.names() == [("symbol", "one"), ("symbol", "bad"), ("panel", "gated")]
    with pytest.warns(UserWarning, match="symbol/bad left out"):
        out = panel.build_panel(bars, registry=reg)
    assert panel.feature_columns(out) == ["one__x"] and {r.one__x for r in out.collect()} == {2.0}
    with pytest.warns(UserWarning):
        assert panel.feature_columns(panel.build_panel(bars, {"extra": bars}, registry=reg)) == ["one__x", "gated__x"]
    reg.remove("symbol", "bad")
    with pytest.raises(ValueError):
        reg.register("other", "x", lambda b, t: b)


def test_groups_by_a_function_of_each_date(spark):
    bars = spark.createDataFrame(walk(3, 30))

    def own(rows):
        if rows["bar_date"][0].as_py() == day(7) and fail:
            raise ValueError("no such date")
        return {"own__share": rows["volume"].to_numpy() / rows["volume"].to_numpy().sum(), "own__first": np.arange(len(rows)) == 0}

    fail, kinds = False, {"own__share": "double", "own__first": "boolean"}
    reg = panel.Registry()
    reg.register("panel", "own", panel.date_group(own, {"own__x": "double"}))
    reg.register("panel", "own", panel.date_group(own, kinds))  # replaces the first
    out = panel.build_panel(bars, registry=reg)
    assert panel.feature_columns(out) == list(kinds)
    got = out.groupBy("bar_date").agg(F.sum("own__share").alias("s"), F.sum(F.col("own__first").cast("int")).alias("f")).collect()
    assert len(got) == 30 and all(r.s == pytest.approx(1) and r.f == 1 for r in got)
    fail = True
    reg.register("panel", "own", panel.date_group(own, kinds))
    with pytest.raises(Exception, match="no such date"):  # what fails in tasks fails the panel's job
        panel.build_panel(bars, registry=reg).collect()


def test_groups_of_the_library_fail_aloud(spark):
    reg = panel.default_registry()
    reg.register("panel", "sector", lambda p, t: p.select("no such column"), reads=(), strict=True)
    with pytest.raises(Exception, match="no such column"):
        panel.build_panel(spark.createDataFrame(walk(2, 30)), registry=reg)


def test_slices_of_a_panel(spark):
    bars = spark.createDataFrame(walk(3, 40))
    mem = spark.createDataFrame([("U", "S0", "X", day(0), day(25)), ("U", "S1", "X", day(20), None), ("V", "S2", "X", day(0), None)], "universe string, symbol string, exchange string, start_date date, end_date date")
    reg = panel.Registry()
    reg.register("symbol", "own", panel.pandas_group(lambda pdf: pdf.assign(own__age=np.arange(len(pdf), dtype=float)), ["own__age"]))
    p = panel.build_panel(bars, registry=reg, membership=mem)
    assert p.count() == 120 and p.filter("own__age is null").count() == 14 + 20
    at = lambda d: sorted((r.symbol, r.own__age, r.absent) for r in panel.inference_slice(p, mem, "U", day(d), ["own__age", "absent"]).collect())
    assert at(22) == [("S0", 22.0, None), ("S1", 22.0, None)] and at(30) == [("S1", 30.0, None)]
    days = spark.createDataFrame([(day(10),), (day(30),), (day(30),)], "bar_date date")
    assert sorted((r.symbol, r.own__age) for r in panel.batch_slice(p, mem, days, ["own__age"]).collect()) == [("S0", 10.0), ("S1", 30.0), ("S2", 10.0), ("S2", 30.0)]


def test_whole_panel_holds_all_groups(spark):
    bars = spark.createDataFrame(walk(2, 60))
    out = panel.build_panel(bars)
    names = {c.split("__")[0] for c in panel.feature_columns(out)}
    assert names == {*NAMES, "cross_sectional", "regime", "interactions"} and out.count() == 120


def test_benchmark_features(spark):
    bars = walk(3, 60)
    got = pf.etf_features(spark.createDataFrame(bars), ["S0", "S2"]).toPandas().sort_values(["benchmark", "bar_date"])
    assert sorted(set(got["benchmark"])) == ["S0", "S2"]
    c = np.log(bars[bars["symbol"] == "S2"]["close"].to_numpy())
    mine = got[got["benchmark"] == "S2"]
    assert mine["etf_log_return_5d"].to_numpy()[-1] == pytest.approx(c[-1] - c[-6]) and mine["etf_realized_vol_20d"].to_numpy()[-1] == pytest.approx(np.std(np.diff(c)[-20:], ddof=1))
    of = pf.sector_benchmarks(spark.createDataFrame([("a", "Information Technology"), ("b", None)], "symbol string, sector string"))
    assert {r.symbol: r.benchmark for r in of.collect()} == {"a": "XLK", "b": None}


def test_timeline_checks(spark):
    t = spark.createDataFrame([("A", day(0), None), ("B", day(3), day(1)), ("C", day(0), day(4))], "symbol string, start_date date, end_date date")
    assert tuple(pit.timeline_checks(t, 1, 2).first()) == (1, 1, False)
    assert tuple(pit.timeline_checks(t.filter("symbol <> 'B'"), 1, 2).first()) == (1, 0, True)
    assert not pit.timeline_checks(t.filter("symbol = 'C'"), 1, 2).first().ok


# ------------------------------------------------------------------ streams


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).parquet(f"{folder}/in")


def test_upserts_go_on_after_a_restart(spark, tmp_path):
    folder, schema = f"file://{tmp_path}", "k int, day date, t int, v string"

    def run(rows):
        source = arrive(spark, folder, rows, schema) if rows else spark.readStream.schema(schema).parquet(f"{folder}/in")
        table = KeyedTable(spark, f"{folder}/table", schema, F.month("day"))  # a new object, as in a new process
        return sorted(map(tuple, stream.stream_upsert(source, table, ["k", "day"], ["t"], f"{folder}/checkpoint").collect()), key=str)

    a, b, c = (1, day(0), 1, "a"), (2, day(0), 5, "b"), (1, day(40), 1, "c")
    assert run([a, b]) == sorted([a, b], key=str)
    assert run([c, (2, day(0), 4, "older"), (1, day(0), 2, "newer")]) == sorted([(1, day(0), 2, "newer"), b, c], key=str)
    assert len(run(None)) == 3  # nothing new
    assert run([(3, None, 1, "no date")]) == sorted([(1, day(0), 2, "newer"), b, c, (3, None, 1, "no date")], key=str)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    schema = "k int, t int"
    table = KeyedTable(spark, f"file://{tmp_path}", schema, F.col("k") % 2)
    take = lambda held, new: keyed.upsert(held, new, ["k"], ["t"])
    rows = lambda x: spark.createDataFrame(x, schema)
    table.merge(rows([(1, 1), (2, 1)]), 0, take)
    table.merge(rows([(1, 2), (3, 1)]), 1, take)
    first = sorted(map(tuple, table.read().collect()))
    table.merge(rows([(1, 2), (3, 1)]), 1, take)  # again, from the versions before it
    assert sorted(map(tuple, table.read().collect())) == first == [(1, 2), (2, 1), (3, 1)]
    assert sorted(map(tuple, table.read(before=1).collect())) == [(1, 1), (2, 1)]
    again = KeyedTable(spark, f"file://{tmp_path}", schema, F.col("k") % 2)
    paths = again._paths(None)
    again.merge(rows([(5, 9)]), 2, take)
    assert again._paths(None)[0] == paths[0] and again._paths(None)[1] != paths[1]  # the other part is left as it is


# ------------------------------------------------------------------ models


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(360, 2))
    y = 0.5 * x[:, 0] - 0.2 * x[:, 1] + rng.normal(0, 0.05, 360)
    pdf = pd.DataFrame({"symbol": [f"S{i % 6}" for i in range(360)], "bar_date": [day(i // 6) for i in range(360)], "a": x[:, 0], "b": x[:, 1], "y": y, "label": np.digitize(y, [-0.2, 0.2]).astype(float), "fold": np.arange(360) // 6 % 3})
    pdf.loc[5, "a"] = None
    df = spark.createDataFrame(pdf)
    return df.withColumn("a", F.when(~F.isnan("a"), F.col("a")))


def test_every_fold_is_predicted_by_the_others(training):
    many = training.withColumn("fold", F.when(F.col("fold") == 2, None).otherwise(F.col("fold")))
    got = models.fit_predict_folds(many, ["a", "b"], "y", "label").toPandas()
    assert sorted(set(got["fold"])) == [0, 1] and len(got) == 240
    assert np.corrcoef(got["predicted_return"], got["y"])[0, 1] > 0.8 and (got["predicted_class"] == got["label"]).mean() > 0.7
    assert all(abs(sum(p) - 1) < 1e-9 and len(p) == 3 for p in got["probabilities"])


def test_scores_of_frozen_models(spark, training):
    m = models.fit(training.filter("fold < 2"), ["a", "b"], "y", "label", version="v9")
    out = models.score(training, m).toPandas()
    for r in out.itertuples():
        assert r.predicted_class == int(np.argmax(r.probabilities)) and r.top_p == r.probabilities[2] and r.bot_p == r.probabilities[0] and r.regression_version == r.classes_version == "v9"
    assert models.score(training.drop("b"), m).filter("predicted_return is null").count() == 0  # a column that is not there counts as missing
    folds = labels.purged_folds(training.select("bar_date"), n=2, h=2, embargo=2, min_train=20)
    got = models.revalidate(training, m, folds, "y", "label").toPandas().sort_values("fold")
    parts = labels.assign_folds(models.score(training, m), folds).filter("part = 'val'").toPandas()
    assert got["n_rows"].tolist() == [int((parts["fold"] == k).sum()) for k in (0, 1)]
    for r in got.itertuples():
        mine = parts[parts["fold"] == r.fold]
        ic = mine.groupby("bar_date").apply(lambda g: g["predicted_return"].rank().corr(g["y"].rank()), include_groups=False)
        assert r.mean_rank_ic == pytest.approx(ic.mean()) and r.accuracy == pytest.approx((mine["predicted_class"] == mine["label"]).mean())


def test_calibration_is_monotone_and_adds_up(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(300):
        p = rng.dirichlet([1, 1, 1])
        rows.append((int(rng.choice(3, p=p**2 / (p**2).sum())), [float(x) for x in p]))
    got = models.calibrate(spark.createDataFrame(rows, "label int, probs array<double>"), "probs", "label", 3).collect()
    assert all(sum(r.calibrated) == pytest.approx(1) or sum(r.calibrated) == 0 for r in got) and all(0 <= x <= 1 for r in got for x in r.calibrated)
    one = spark.createDataFrame([(int(p > 0.3), [1 - p, p]) for p in np.linspace(0, 1, 50).tolist()], "label int, probs array<double>")
    rising = [r.calibrated[1] for r in sorted(models.calibrate(one, "probs", "label", 2).collect(), key=lambda r: r.probs[1])]
    assert rising == sorted(rising)


def test_importances_and_attributions(training):
    imp = {r.feature: r.importance for r in models.feature_importance(training, ["a", "b"], "y").collect()}
    assert sum(imp.values()) == pytest.approx(1) and imp["a"] > imp["b"]
    got = models.top_k_attribution(training, ["symbol", "bar_date"], ["a", "b"], "y", k=2)
    fitted = training.filter("a is not null").toPandas()
    slope, *_ = np.linalg.lstsq(np.column_stack((fitted[["a", "b"]], np.ones(len(fitted)))), fitted["y"], rcond=None)
    total = got.groupBy("symbol", "bar_date").agg(F.sum("contribution").alias("s"), F.count("*").alias("n")).toPandas().merge(fitted, on=["symbol", "bar_date"])
    assert (total["n"] == 2).all() and np.allclose(total["s"], total["a"] * slope[0] + total["b"] * slope[1], atol=0.01)
    assert all(r.sign == ("+" if r.contribution >= 0 else "-") for r in got.collect())


@pytest.fixture
def counted(spark):
    """A function that makes a table whose rows are counted whenever they are computed, and the counter."""
    seen = spark.sparkContext.accumulator(0)

    def count(df):
        def each(parts):
            for pdf in parts:
                seen.add(len(pdf))
                yield pdf

        return df.mapInPandas(each, df.schema)

    return count, seen


def test_models_compute_their_rows_once(training, counted):
    count, seen = counted
    models.fit(count(training), ["a", "b"], "y", "label")
    assert seen.value == 360
    assert models.fit_predict_folds(count(training), ["a", "b"], "y", "label").count() == 360 and seen.value == 720


def test_revalidation_scores_its_rows_once(training, counted):
    count, seen = counted
    m = models.fit(training, ["a", "b"], "y", "label")
    folds = labels.purged_folds(training.select("bar_date"), n=2, h=2, embargo=2, min_train=20)
    assert models.revalidate(count(training), m, folds, "y", "label").count() == 2 and seen.value == 360


def test_calibration_of_repeated_probabilities(spark, counted):
    from pyspark.ml.regression import IsotonicRegression

    count, seen = counted
    rng = np.random.default_rng(4)
    p = rng.integers(0, 9, 400) / 8
    df = spark.createDataFrame([(int(rng.random() < x), [1 - x, x]) for x in p.tolist()], "label int, probs array<double>")
    got = models.calibrate(count(df), "probs", "label", 2).collect()
    assert seen.value == 400
    plain = df.select(F.element_at("probs", 2).alias("x"), F.col("label").cast("double").alias("y"))
    want = {r.x: r.z for r in IsotonicRegression(featuresCol="x", labelCol="y", predictionCol="z").fit(plain).transform(plain).collect()}
    assert len(got) == 400 and all(r.calibrated[1] == pytest.approx(want[r.probs[1]]) for r in got)


def test_importances_compute_their_rows_once(training, counted):
    count, seen = counted
    models.feature_importance(count(training), ["a", "b"], "y")
    assert seen.value == 360


def test_attributions_compute_their_rows_once(training, counted):
    count, seen = counted
    assert models.top_k_attribution(count(training), ["symbol", "bar_date"], ["a", "b"], "y").count() == 720 and seen.value == 360


def test_ranks_take_one_order_a_column(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 1.0), (1, 3.0), (1, None), (1, float("nan")), (2, None)], "bar_date int, x double")
    out = df.select("bar_date", "x", pct_rank("x", "bar_date").alias("r"), average_rank("x", "bar_date").alias("a"))
    assert sorted((r.r, r.a) for r in out.collect() if r.r is not None) == [(0.25, 1.0), (0.625, 2.5), (0.625, 2.5), (1.0, 4.0)] and out.filter("r is null").count() == 2
    assert df.select(pct_rank("x", "bar_date"))._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


def test_rows_are_dealt_out_to_more_tasks_as_they_grow(spark):
    df = written(spark.range(1000).withColumn("bar_date", F.col("id") % 50))
    assert by_rows(df, "bar_date", rows=100).rdd.getNumPartitions() == 10 and by_rows(df, "bar_date").rdd.getNumPartitions() == 4
    assert by_rows(df, "bar_date", rows=100).count() == 1000


def test_a_batch_is_computed_once_and_its_parts_lie_together(spark, tmp_path, counted):
    count, seen = counted
    table = KeyedTable(spark, f"file://{tmp_path}", "k long, v long", F.col("k") % 3)
    rows = spark.range(600).select(F.col("id").alias("k"), F.col("id").alias("v")).repartition(4)
    table.upsert(count(rows), 0, ["k"], ["v"])
    assert seen.value == 600 and table.read().count() == 600
    assert len(list(tmp_path.glob("data/*/_part=*/*.parquet"))) == 3


def test_the_training_panel_is_computed_once(spark, counted, monkeypatch):
    from barloom.plans import q_eval

    count, seen = counted
    rows = spark.createDataFrame([(f"S{i}", dt.date(1996 + i % 3, 1, 1 + i), float(i)) for i in range(9)], "symbol string, bar_date date, x double")
    monkeypatch.setattr(q_eval, "_train", lambda s, d: count(rows))
    assert q_eval.snk3(spark, "").count() == 9 and seen.value == 9


def test_bars_by_hash_are_those_of_the_whole_order(spark):
    from barloom.plans import fixtures as fx

    rng = np.random.default_rng(8)
    big, rows = 1 << 40, []
    for i in range(400):  # few order keys and lines: many stand twice, with different prices
        key = [None, big, -1, *range(5)][rng.integers(0, 8)] if i % 4 == 0 else int(rng.integers(0, 5))
        rows.append((f"S{i % 3}" if i % 50 else None, day(i % 7), float(rng.integers(1, 90)), key, int(rng.integers(0, 90 if i % 9 == 0 else 3)), int(rng.integers(0, 3)), int(rng.integers(0, 3)), float(i), float(rng.integers(1, 5))))
    t = spark.createDataFrame(rows, "symbol string, bar_date date, price double, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double")
    want = t.groupBy("symbol", "bar_date").agg(*fx._ohlcv())
    got = fx.bars_of(t)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plain = t.filter("l_orderkey between 0 and 4").withColumn("l_orderkey", F.col("l_quantity").cast("long")).withColumn("l_linenumber", F.lit(1))
    assert sorted(map(str, fx.bars_of(plain).collect())) == sorted(map(str, plain.groupBy("symbol", "bar_date").agg(*fx._ohlcv()).collect()))


def test_lots_are_computed_once_for_all_trades(spark, counted, monkeypatch):
    from barloom.operators import portfolio
    from barloom.plans import q_portfolio

    count, seen = counted
    lots = spark.createDataFrame([(f"S{i}", day(i), 10.0 + i, i + 1) for i in range(9)], "symbol string, as_of date, price double, qty int")
    monkeypatch.setattr(q_portfolio, "lots", lambda s, d: count(lots))
    assert portfolio.trade_pairs(q_portfolio.trades(spark, "")).count() >= 9 and seen.value == 9


def test_volume_and_momentum_take_their_windows_from_the_blocks(spark):
    bars = spark.createDataFrame(walk(2, 60))
    for group in ("volume", "momentum"):
        plan = f.GROUPS[group](f.prepared(bars, [group]))._jdf.queryExecution().optimizedPlan().toString()
        assert "covar" not in plan and plan.count("stddev_samp(") <= 1 and "specifiedwindowframe(RowFrame, -13, currentrow" not in plan


def test_volume_by_plain_loops(spark):
    bars = walk(1, 70)
    got = f.volume(f.prepared(spark.createDataFrame(bars), ["volume"])).orderBy("bar_date").toPandas()
    c, v, h, lo = (bars[n].to_numpy(float) for n in ("close", "volume", "high", "low"))
    obv = np.cumsum(np.sign(np.diff(c, prepend=c[0])) * v)
    tp = (h + lo + c) / 3
    step = np.diff(tp, prepend=tp[0])
    for i in (18, 19, 40, 69):
        w, m = slice(i - 19, i + 1), slice(i - 13, i + 1)
        r = got.iloc[i]
        if i < 19:
            assert np.isnan(r.volume__obv_slope_20) and np.isnan(r.volume__volume_zscore_20)
            continue
        assert r.volume__obv_slope_20 == pytest.approx(np.polyfit(np.arange(20), obv[w], 1)[0])
        assert r.volume__obv_zscore_20 == pytest.approx((obv[i] - obv[w].mean()) / obv[w].std(ddof=1))
        assert r.volume__vwap_deviation_20 == pytest.approx(c[i] / ((c * v)[w].sum() / v[w].sum()) - 1)
        up, down = ((tp * v)[m][s].sum() for s in (step[m] > 0, step[m] < 0))
        assert r.volume__mfi_14 == pytest.approx(100 - 100 / (1 + up / down))


def test_importances_read_rows_in_even_tasks(training, monkeypatch):
    parts = []
    monkeypatch.setattr(models, "by_rows", lambda df: parts.append(1) or df.repartition(7))
    assert models.feature_importance(training, ["a", "b"], "y").count() == 2 and parts == [1]


def test_only_benchmarks_meet_the_panel(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(pf, "written", lambda df: rows.append(df) or written(df))
    p = spark.createDataFrame([(f"S{i}", day(d), float(i + d)) for i in range(4) for d in range(3)], "symbol string, bar_date date, x double")
    p = p.select("symbol", "bar_date", *[F.col("x").alias(c) for c in pf.RESIDUALS.values()])
    of = spark.createDataFrame([("S0", "S1"), ("S1", "S1"), ("S2", None), ("S3", "gone")], "symbol string, benchmark string")
    got = {(r.symbol, r.bar_date): r.sector_residual__resid_log_return_5d for r in pf.sector_residual(p, of).collect()}
    assert len(got) == 12 and got["S0", day(2)] == -1.0 and got["S1", day(0)] == 0.0 and got["S2", day(0)] is None and got["S3", day(0)] is None
    assert rows[0].select("benchmark").distinct().collect()[0].benchmark == "S1" and rows[0].count() == 3


def test_no_wide_panel_is_written(spark):
    seen = []

    def cut(df):
        seen.append(panel.feature_columns(df))
        return written(df)

    bars = spark.createDataFrame(walk(2, 60))
    reg = panel.default_registry()
    assert panel.build_panel(bars, registry=reg, cut=cut).count() == 120 and seen == [[]]
    reg.register("panel", "last", lambda p, t: p.withColumn("last__n", F.lit(1.0)))  # a user's group of the whole panel has it written
    out = panel.build_panel(bars, registry=reg, cut=cut)
    assert out.filter("last__n = 1").count() == 120 and len(seen) == 3 and "interactions__rsi14_x_vix_z" in seen[2]


def test_groups_read_what_groups_before_them_made(spark):
    bars = spark.createDataFrame(walk(2, 30))
    reg = panel.Registry()
    reg.register("panel", "a", lambda p, t: p.withColumn("a__x", F.col("close") * 2), reads=(), strict=True)
    reg.register("panel", "b", lambda p, t: p.withColumn("b__x", F.col("a__x") + 1), reads=("a__x",), strict=True)
    out = panel.build_panel(bars, registry=reg)
    assert panel.feature_columns(out) == ["a__x", "b__x"] and out.filter("b__x = 2 * close + 1").count() == 60


def test_queries_make_their_bars_once(spark, monkeypatch):
    from barloom.plans import fixtures as fx, q_eval, q_panel, q_portfolio, q_text

    calls, bars = [], fx.bars
    monkeypatch.setattr(fx, "bars", lambda s, d: calls.append(1) or bars(s, d))
    for query in (q_eval.lb3, q_panel.sv_features, q_panel.sr_residual, q_text.ml2, lambda s, d: q_portfolio.trades(s, d)):
        calls.clear()
        query(spark, "/root/testdata/sf0.001")
        assert len(calls) == 1


def some_groups():
    """A registry with the symbol groups that the panel groups read."""
    reg = panel.default_registry()
    for name in ("volatility", "microstructure", "market_structure", "volume_profile", "swings"):
        reg.remove("symbol", name)
    return reg


def test_only_narrow_rows_are_exchanged(spark):
    bars = spark.createDataFrame(walk(3, 60))
    mem = spark.createDataFrame([("U", "S0", "X", day(0), None)], "universe string, symbol string, exchange string, start_date date, end_date date")
    out = panel.build_panel(bars, registry=some_groups(), membership=mem)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"SortMergeJoin \[symbol#\d+, bar_date", plan)  # nothing is joined to the panel by symbol and date, for which Spark exchanges both sides by the two
    top = plan.split("FlatMapGroupsInArrow")[0]
    assert "FlatMapGroupsInArrow" in plan and "Exchange hashpartitioning(symbol" not in top
    got = out.select("symbol", "price__log_return_1d", "regime__market_return_1d", "cross_sectional__xs_rank_rsi_14").collect()
    assert len(got) == 180 and all((r.regime__market_return_1d is None) == (r.symbol != "S0" or r.price__log_return_1d is None) for r in got)
    assert sum(r.cross_sectional__xs_rank_rsi_14 is not None for r in got) == 60 - 14


def test_a_panel_is_the_same_by_all_ways(spark, monkeypatch):
    rows = walk(3, 60)
    rows.loc[(rows["symbol"] == "S1") & (rows["bar_date"] == day(40)), "volume"] = np.nan
    rows.loc[(rows["symbol"] == "S2") & (rows["bar_date"] == day(59)), "symbol"] = None
    bars = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "symbol string, bar_date date, open double, high double, low double, close double, volume double")
    reg = some_groups()
    reg.register("panel", "own", lambda p, t: p.withColumn("own__x", F.col("regime__market_return_1d") * F.col("close")), reads=("regime__market_return_1d",), strict=True)
    whole = panel.build_panel(bars, registry=reg)
    cols = panel.feature_columns(whole)
    found = lambda df: sorted(map(repr, df.select("symbol", "bar_date", *[F.round(c, 7).alias(c) for c in cols]).collect()))
    first = found(whole)
    lost = whole.filter("symbol is null").collect()[0]
    assert len(first) == 180 and whole.filter("own__x is not null").count() == 176 and lost.own__x is None and lost.regime__market_return_1d is None
    monkeypatch.setattr(series, "SIZE", 10)  # as if series were longer than a block
    assert found(panel.build_panel(bars, registry=reg)) == first
    reg.register("symbol", "theirs", lambda b, t: b.withColumn("theirs__x", F.lit(1.0)))  # a user's group
    assert found(panel.build_panel(bars, registry=reg)) == first


def test_pass_in_place(spark):
    rows = walk(2, 300)
    rows.loc[(rows["symbol"] == "S1") & (rows["bar_date"] < day(20)), "high"] = np.nan
    bars = spark.createDataFrame(rows.sample(frac=1, random_state=1)).withColumn("held", F.struct("close", "symbol"))
    bars = bars.withColumn("high", F.when(~F.isnan("high"), F.col("high")))
    here = series.in_place(bars.repartition(3, "symbol"), recursion.COLUMNS).toPandas().sort_values(["symbol", "bar_date"])
    there = series.sequential(bars.drop("held"), recursion.COLUMNS).toPandas().sort_values(["symbol", "bar_date"])
    assert [r.close for r in here["held"]] == list(here["close"])
    pd.testing.assert_frame_equal(here.drop(columns="held").reset_index(drop=True), there[[c for c in here.columns if c != "held"]].reset_index(drop=True))
    for _, one in here.groupby("symbol"):
        np.testing.assert_array_equal((one["macd"] - one["macd_signal"]).to_numpy()[:-1], one["gap_before"].to_numpy()[1:])
