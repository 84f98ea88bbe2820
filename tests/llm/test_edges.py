"""Edges of the corpus operators: deep pages, long runs of digits, names of columns that clash or hold dots."""

import re
import time

import pytest
from pyspark.sql import functions as F

from barloom.llm import bloom_lm, exact_dedup, html_extract, language_id, pii, quality_rules, sentencepiece_nbest, source_mix

IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


@pytest.mark.parametrize("depth", [5, 100, 511, 512, 513, 600, 3000])
def test_comments_stay_comments_however_deep_the_page(depth):
    page = "<html><body><article><p>The main text of this page is here, in a sentence or two.</p></article><div class='comments'>"
    page += "<div>" * depth + "<p>First! <a href='x'>me</a>" + "</div>" * depth + "<p>A later comment by a reader, long enough to look like text.</p></div><p>After.</p></body></html>"
    blocks = {text: hints for _, hints, text, _ in html_extract.leaf_blocks(page)}
    assert "comments" in blocks["A later comment by a reader, long enough to look like text."] and "comments" not in blocks["After."]
    assert "comments" in blocks["First! me"]


def test_deep_elements_left_open_end_with_the_block_around_them():
    page = "<div>" * 511 + "<section class='side'>" + "<div><span><b>" * 40 + "x" + "</section><p>y</p>"
    blocks = {text: hints for _, hints, text, _ in html_extract.leaf_blocks(page)}
    assert "side" in blocks["x"] and "side" not in blocks["y"]


def test_ip_spans_are_those_of_the_pattern_and_linear():
    for text in ("1.2.3.4", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "1..2.3.4.5", "256.1.1.1.1.2.3", "01.002.3.4 a1.2.3.4b", "1.2.3", "1.2.3.4.", ".1.2.3.4", "1.2.3.999.1.2.3.4", "a.1.2.3.4.b.5.6.7.8", "٣.1.2.3.4"):
        want = [m.span() for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
        assert [(a, z) for k, a, z in pii.base_spans(text) if k == 1] == want, text
    for text in ("7" * 1_000_000, "7." * 500_000, "1.2.3" * 200_000):
        began = time.perf_counter()
        pii.base_spans(text)
        assert time.perf_counter() - began < 5


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "A text of some words here", "en", "s", 1.0), (2, None, None, None, None), (2, "Another text of words", "fr", "s", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, body string, lang string, source string, `a.b` double").withColumn("text", F.lit("not the text"))


def test_clashing_and_dotted_columns(odd):
    model, segments = bloom_lm.train(odd.select(F.col("body").alias("text")))
    scored = bloom_lm.score(odd, model, segments, text="body")
    assert scored.columns[:5] == ["doc_id", "lang", "source", "a.b", "text"] and sorted(r.n_tokens for r in scored.collect()) == [1, 5, 7]
    assert {r["text"] for r in scored.collect()} == {"not the text"}
    for out in (
        pii.find_pii(odd, text="body"), quality_rules.quality_rules(odd, text="body"),
        sentencepiece_nbest.encode(odd, text="body"), exact_dedup.exact_dedup(odd, text="body"), exact_dedup.one_of_each(odd, text="body"), source_mix.mix_sources(odd), source_mix.in_mixed_order(odd),
        language_id.identify(odd, language_id.fit(odd.select("doc_id", F.col("body").alias("text"), "lang")), text="body"), html_extract.extract(odd, html="body"),
    ):
        assert {r["a.b"] for r in out.collect()} == {1.0, 2.0, None}


def test_rows_without_ids_are_spread_over_buckets(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("hot").alias("source"), "id")
    out = source_mix.mix_sources(docs, bucket_rows=100)
    assert out.count() == 4000 and out.select("mix_slot", "mix_rank").distinct().count() == 4000
    before = [r.id for r in out.orderBy("mix_slot", "mix_rank").select("id").limit(50).collect()]
    assert before != sorted(before)
