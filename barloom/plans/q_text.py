"""Queries over text operators, streams, extension points and MLlib models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import features as f
from ..functions import text as tx
from ..functions.panel import Registry, build_panel, date_group, pandas_group
from ..functions.windows import rounded
from ..operators import labels as lb
from ..operators import models as ml
from ..streaming import stateful as sf
from ..streaming import stream as st
from . import fixtures as fx
from .shared import by_rows, shared_dir, written
from .sqlkit import r


def tx1(s, d):
    return fx.table(s, d, "pages").select("page_id", tx.clean_html(F.col("html")).alias("body"))


def tx2(s, d):
    return tx.truncate_body(fx.table(s, d, "documents").select("doc_id", "text")).drop("text")


def tx3(s, d):
    p = fx.table(s, d, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "EX-99").when(F.col("p_partkey") % 3 == 1, "ex99").otherwise("ex10"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 4 == 0, ".jpg").otherwise(".htm")).alias("name"))
    return p.filter(tx.is_exhibit(F.col("name")))


def tx4(s, d):
    return tx.recent_filings(fx.filings(s, d).withColumnRenamed("k", "i"), since="1996-01-01", forms=["8-K", "10-Q"], k=3).drop("i")


def tx5(s, d):
    return fx.filings(s, d).select("accession", tx.derive_title(F.col("form_type"), F.col("items")).alias("title"))


def tx6(s, d):
    return tx.source_digest(fx.table(s, d, "documents").filter("source is not null"), "source", "doc_id", "text")


def _events(s, d):
    e = fx.table(s, d, "events")
    conf = F.when(F.col("event_id") % 5 == 0, "high").when(F.col("event_id") % 5 == 1, F.concat((F.col("event_id") % 100).cast("string"), F.lit("%"))).when(F.col("event_id") % 5 == 2, "0.25").when(F.col("event_id") % 5 == 3, "what").otherwise("low")
    label = F.when(F.col("event_type") == "purchase", " Bullish!").when(F.col("event_type") == "error", "strong sell").otherwise("hold")
    lists = F.when(F.col("event_id") % 3 == 0, '["a", "b"]').when(F.col("event_id") % 3 == 1, "not json").otherwise("[]")
    return e.select("event_id", label.alias("label"), conf.alias("conf"), lists.alias("reasons_json"), F.to_date("ts").alias("verdict_date"), F.when(F.col("user_id") % 2 == 0, "long").otherwise("short").alias("side"))


def tx7(s, d):
    out = _events(s, d).select("event_id", tx.coerce_verdict(F.col("label")).alias("verdict"), tx.coerce_confidence(F.col("conf")).alias("confidence"), F.array_join(tx.coerce_list(F.col("reasons_json")), "|").alias("reasons"))
    return rounded(out)


def tx8(s, d):
    return tx.latest_verdicts(_events(s, d)).select("event_id", "verdict_date", "label", F.array_join("reasons", "|").alias("reasons"))


def tx9(s, d):
    return tx.verdict_counts(_events(s, d).withColumn("verdict", tx.coerce_verdict(F.col("label"))))


def arrivals(spark, df, part, path, n=4):
    """``df`` as a file stream that arrives in ``n`` parts, null parts first: a stream to run again after each; ``df`` is computed once."""
    df = written(df.withColumn("_part", F.coalesce(part, F.lit(0))))
    for k in range(n):
        df.filter(F.col("_part") == k).drop("_part").write.mode("append").parquet(f"{path}/in")
        yield spark.readStream.schema(df.drop("_part").schema).parquet(f"{path}/in")


def st1(s, d):
    e = fx.table(s, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    path = shared_dir(s)
    for source in arrivals(s, e, F.col("event_id") % 4, path):  # each run finds the table again, as after a restart
        table = st.KeyedTable(s, f"{path}/table", e.schema, F.year("day") * 12 + F.month("day"))
        out = st.stream_upsert(source, table, ["user_id", "day"], ["ts", "event_id"], f"{path}/checkpoint")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def st2(s, d):
    """Bars and predictions arrive year by year, each run a restart."""
    b, path = fx.bars(s, d), shared_dir(s)
    b, p = b.select("symbol", "bar_date", "close"), fx.predictions(s, d, b).select("symbol", "as_of")

    def years(c):
        return F.when(F.year(c) <= 1995, 0).when(F.year(c) <= 1996, 1).when(F.year(c) <= 1997, 2).otherwise(3)

    for bars, asked in zip(arrivals(s, b, years("bar_date"), f"{path}/bars"), arrivals(s, p, years("as_of"), f"{path}/asked"), strict=True):
        out = sf.stream_settle(bars, asked, f"{path}/settled", f"{path}/checkpoint")
    return rounded(out)


def st3(s, d):
    """Events as writes of a user's value of the day, in four parts one after the other."""
    e = fx.table(s, d, "events").select(F.col("user_id").alias("key"), F.to_date("ts").alias("as_of"), "value", F.struct("ts", "event_id").alias("n"), F.col("ts").cast("timestamp").alias("created_at"))
    one, path = e.groupBy("key", "as_of", "created_at").agg(F.max_by("value", "n").alias("value")), shared_dir(s)
    one = written(one)
    first, last = one.agg(F.min("created_at"), F.max("created_at")).first()
    share = (F.col("created_at").cast("double") - first.timestamp()) / (last.timestamp() - first.timestamp() + 1)
    for writes in arrivals(s, one, F.floor(share * 4), path):
        out = sf.stream_snapshots(writes, f"{path}/shown", f"{path}/checkpoint")
    return sf.newest_shown(out).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def ud1(s, d):
    """A user's own pandas function per symbol, registered as a group beside those of a panel: median of five closes."""
    def own(pdf):
        return pdf.assign(own__median5=pdf["close"].rolling(5, min_periods=5).median())

    reg = Registry()
    reg.register("symbol", "own", pandas_group(own, ["own__median5"]))
    reg.register("panel", "absent", lambda p, t: p, ("a table that is not there",))
    out = build_panel(fx.bars(s, d), registry=reg)
    return rounded(out.select("symbol", "bar_date", F.col("own__median5").alias("median5")), 9)


def ud2(s, d):
    """A user's own function of each date's rows as a panel group: the close against the date's median, and its rank from the top."""
    def own(rows):
        close = rows["close"].to_numpy()
        return {"own__gap": close - np.median(close), "own__place": len(close) - np.argsort(np.argsort(close, kind="stable"), kind="stable")}

    reg = Registry()
    reg.register("panel", "own", date_group(own, {"own__gap": "double", "own__place": "long"}))
    out = build_panel(fx.bars(s, d), registry=reg)
    return rounded(out.select("symbol", "bar_date", F.col("own__gap").alias("gap"), F.col("own__place").alias("place")), 9)


def _training(s, d):
    b = f.microstructure(f.price(by_rows(fx.bars(s, d), "symbol")))
    w = f.symbol()
    cols = ["price__log_return_1d", "price__log_return_5d", "microstructure__close_location", "microstructure__gap_pct"]
    y = F.ln(F.lead("close", 5).over(w) / F.col("close"))
    out = b.select("symbol", "bar_date", *cols, y.alias("y")).filter("y is not null and price__log_return_5d is not null")
    return out.withColumn("label", F.when(F.col("y") > 0.3, 2.0).when(F.col("y") < -0.3, 0.0).otherwise(1.0)).withColumn("fold", F.year("bar_date") % 3), cols


def ml1(s, d):
    rows, cols = _training(s, d)
    return ml.fit_predict_folds(rows, cols, "y", "label").select("symbol", "bar_date", "fold", "predicted_return", "predicted_class")


def ml2(s, d):
    p = fx.predictions(s, d, by_rows(fx.bars(s, d), "symbol")).filter("realized_return is not null").withColumn("label", F.when(F.col("realized_return") > 0.3, 2).when(F.col("realized_return") < -0.3, 0).otherwise(1))
    p = p.withColumn("probs", F.array(F.col("bot_p") / 2, F.lit(0.5), F.col("top_p") / 2))
    return ml.calibrate(p.select("symbol", "as_of", "label", "probs"), "probs", "label", 3)


def _split(s, d):
    rows, cols = _training(s, d)
    rows = written(rows)
    folds = written(lb.purged_folds(rows.select("bar_date"), n=4, h=5, embargo=10, min_train=300))
    first = folds.agg(F.min("train_end").alias("_end"))  # the first fold's training is in all others' too
    early = rows.crossJoin(F.broadcast(first)).filter(F.col("bar_date") <= F.col("_end")).drop("_end")
    return rows, folds, ml.fit(early, cols, "y", "label", version="early")


def ml3(s, d):
    rows, _, models = _split(s, d)
    return ml.score(rows, models).select("symbol", "bar_date", "predicted_return", "predicted_class", "top_p", "bot_p", "regression_version", "classes_version")


def ml6(s, d):
    rows, folds, models = _split(s, d)
    return ml.revalidate(rows, models, folds, "y", "label")


def ml4(s, d):
    rows, cols = _training(s, d)
    return ml.feature_importance(rows, cols, "y")


def ml5(s, d):
    rows, cols = _training(s, d)
    return ml.top_k_attribution(rows, ["symbol", "bar_date"], cols, "y", k=2)


QUERIES = {
    "tx1_clean_html": tx1, "tx2_truncate_body": tx2, "tx3_select_exhibits": tx3, "tx4_recent_filings": tx4, "tx5_titles": tx5, "tx6_source_digest": tx6, "tx7_coerce": tx7, "tx8_latest_verdicts": tx8, "tx9_verdict_counts": tx9,
    "st1_stream_upsert": st1, "st2_stream_settle": st2, "st3_preliminary_vs_final": st3, "ud1_custom_group": ud1, "ud2_date_group": ud2, "ml1_fit_predict_folds": ml1, "ml2_calibrate": ml2, "ml3_score": ml3, "ml6_revalidate": ml6, "ml4_feature_importance": ml4, "ml5_attribution": ml5,
}
_EV = """ev AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'bullish' WHEN 'error' THEN 'bearish' ELSE 'neutral' END AS verdict, CASE event_type WHEN 'purchase' THEN ' Bullish!' WHEN 'error' THEN 'strong sell' ELSE 'hold' END AS label,
  CASE event_id % 5 WHEN 0 THEN 0.8 WHEN 1 THEN (event_id % 100) / 100.0 WHEN 2 THEN 0.25 WHEN 3 THEN 0.5 ELSE 0.3 END AS confidence, CASE WHEN event_id % 3 = 0 THEN 'a|b' ELSE '' END AS reasons, CAST(ts AS DATE) AS verdict_date, CASE WHEN user_id % 2 = 0 THEN 'long' ELSE 'short' END AS side FROM events)"""
_HID = "|".join(rf"<{t}\b.*?</{t}\s*>" for t in ("script", "style", "noscript"))
SQL = {
    "tx1_clean_html": rf"""SELECT page_id, CASE WHEN item_at > 200 THEN substr(x, item_at) ELSE x END AS body FROM (SELECT page_id, x, CASE WHEN regexp_extract(x, 'Item \d+\.\d{{2}}') <> '' THEN instr(x, regexp_extract(x, 'Item \d+\.\d{{2}}')) ELSE 0 END AS item_at FROM
      (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is){_HID}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n\f]+', ' ', 'g')) AS x FROM pages))""",
    "tx2_truncate_body": "SELECT doc_id, length(text) AS body_chars, substr(text, 1, 8000) AS body FROM documents",
    "tx3_select_exhibits": "SELECT p_partkey, name FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'EX-99' WHEN 1 THEN 'ex99' ELSE 'ex10' END || p_size || CASE WHEN p_size % 4 = 0 THEN '.jpg' ELSE '.htm' END AS name FROM part) WHERE regexp_matches(name, 'ex.?99', 'i') AND name NOT LIKE '%.jpg'",
    "tx4_recent_filings": fx.sql("SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY filing_date DESC, accession DESC) AS INT) AS k FROM filings WHERE form_type IN ('8-K', '10-Q') AND filing_date >= '1996-01-01') WHERE k <= 3", fx.NUMBERED_SQL, fx.FILINGS_SQL),
    "tx5_titles": fx.sql("SELECT accession, CASE items WHEN '2.02,9.01' THEN form_type || ': Results of operations; Financial statements and exhibits' WHEN '5.02' THEN form_type || ': Change of directors or officers' ELSE form_type END AS title FROM filings", fx.NUMBERED_SQL, fx.FILINGS_SQL),
    "tx6_source_digest": "SELECT source, string_agg('[' || k || '] ' || substr(text, 1, 200), chr(10) || chr(10) ORDER BY k) AS digest, count(*) AS n_sources FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IS NOT NULL) WHERE k <= 5 GROUP BY 1",
    "tx7_coerce": f"WITH {_EV} SELECT event_id, verdict, {r('CAST(confidence AS DOUBLE)', 'confidence')}, reasons FROM ev", "tx8_latest_verdicts": f"WITH {_EV} SELECT event_id, verdict_date, label, reasons FROM ev WHERE verdict_date = (SELECT max(verdict_date) FROM ev)",
    "tx9_verdict_counts": f"WITH {_EV} SELECT verdict, side, count(*) AS n FROM ev GROUP BY 1, 2",
    "st1_stream_upsert": "SELECT user_id, CAST(ts AS DATE) AS day, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1",
    "st2_stream_settle": fx.sql(f"""SELECT symbol, as_of, {r('z', 'realized')}, settled_at FROM predictions JOIN (SELECT symbol, bar_date AS as_of, lead(ln(close), 5) OVER w - ln(close) AS z, lead(bar_date, 5) OVER w AS settled_at FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)) USING (symbol, as_of)
      WHERE settled_at <= least((SELECT max(bar_date) FROM bars), (SELECT max(as_of) FROM predictions)) - 7""", fx.PREDICTIONS_SQL),
    "st3_preliminary_vs_final": """SELECT user_id AS key, CAST(ts AS DATE) AS as_of, value, ts AS created_at, strftime(ts, '%H:%M:%S') >= '20:00:00' AS is_final FROM events WHERE CAST(ts AS DATE) + INTERVAL 20 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
      QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1""",
    "ud2_date_group": fx.sql(f"SELECT symbol, bar_date, {r('close - quantile_cont(close, 0.5) OVER (PARTITION BY bar_date)', 'gap', 9)}, row_number() OVER (PARTITION BY bar_date ORDER BY close DESC, symbol DESC) AS place FROM bars"),
    "ud1_custom_group": fx.sql(f"SELECT symbol, bar_date, {r('CASE WHEN count(close) OVER w = 5 THEN quantile_cont(close, 0.5) OVER w END', 'median5', 9)} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"),
}
