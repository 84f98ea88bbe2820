"""Repetition and length rules, from rolling hashes in numpy.

Every Arrow slice of whole texts is handled as one byte array: word bounds, a
rolling hash of each word, of windows of several lengths and of each line, then
one sort per window length finds what repeats inside a text.  No shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, beside, freed, mix, schema_with, table, text_slices

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Share of a text's word characters that windows found before may cover, by window length in words.
NGRAM_LIMITS = {3: 0.50, 5: 0.35, 10: 0.30}
#: Share of word characters that may stand in lines equal to an earlier line.
LINE_LIMIT = 0.30
MIN_WORDS = 50
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_chars long, " + ", ".join(f"dup_chars_{k} long" for k in NGRAM_LIMITS)
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def _repeated(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found twice or more in its text, found earlier in its text) for hashes in order of position."""
    key = mix(h ^ (doc.astype(U64) * U64(0x9E3779B97F4A7C15)))
    any_, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    ranked = np.sort(key)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if len(twice):
        slot = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        hit = np.flatnonzero(twice[slot] == key)
        any_[hit] = later[hit] = True
        first = np.full(len(twice), len(key))
        np.minimum.at(first, slot[hit], hit)
        later[first] = False
    return any_, later


def measures(col: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text of a string column; null and empty texts give zeros."""
    w = Words(col, lower=False)
    n = len(w.off) - 1
    heads = (w.raw & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(heads)))
    size = chars[w.end] - chars[w.start]

    def by_doc(doc, weights=None):
        return np.bincount(doc, weights=weights, minlength=n).astype(np.int64)

    sym = np.concatenate(([0], np.cumsum(SYMBOL[w.raw])))
    out = {"n_words": by_doc(w.doc), "word_chars": by_doc(w.doc, size), "n_symbols": sym[w.off[1:]] - sym[w.off[:-1]]}
    h = w.hashes()
    for k in (3, *(k for k in NGRAM_LIMITS if k != 3)):
        at, hk = w.windows(h, k)
        twice, later = _repeated(w.doc[at], hk)
        for name, hit in (("n_repeat_words", twice), ("dup", later)):
            if name == "n_repeat_words" and k != 3:
                continue
            inside = np.zeros(len(h), bool)
            for j in range(k):
                inside[at[hit] + j] = True
            if name == "dup":
                out[f"dup_chars_{k}"] = by_doc(w.doc, size * inside)
            else:
                out[name] = by_doc(w.doc, inside)
    # lines: split at \n and at the ends of texts; only lines with a word count
    cut = np.flatnonzero(w.raw == 10)
    start = np.unique(np.concatenate((w.off[:-1][np.diff(w.off) > 0], cut + 1)))
    start = start[start < len(w.raw)]
    last = np.searchsorted(w.off, start, side="right") - 1
    nxt = np.searchsorted(cut, start)
    end = np.minimum(np.append(cut, len(w.raw))[nxt], w.off[last + 1])
    a, b = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    full = b > a
    start, end, last, a, b = start[full], end[full], last[full], a[full], b[full]
    _, later = _repeated(last, w.range_hash(start, end))
    run = np.concatenate(([0], np.cumsum(size)))
    out["n_dup_lines"] = by_doc(last, later)
    out["dup_line_chars"] = by_doc(last, (run[b] - run[a]) * later)
    return out


def quality_rules(docs: DataFrame, *, text: str = "text", min_words: int = MIN_WORDS, limits=None, line_limit: float = LINE_LIMIT, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the counts in ``SCHEMA``, ``base_failed`` and ``kept``.

    A row is rejected if it has fewer than ``min_words`` words, if over half of
    its words stand in repeated three-word windows, if windows found earlier in
    the text cover more than their limit of its word characters, or if repeated
    lines do.  Null text counts as no words.  Other columns pass through, or those
    named in ``keep``; a column named like a new one is replaced.
    """
    limits = NGRAM_LIMITS if limits is None else limits
    given, place, source = beside(docs, text, [*NAMES, "base_failed", "kept"], keep)

    @freed
    def run(batches):
        for part in text_slices(batches, place):
            found = measures(part.column(place))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(given)], *(pa.array(found[k]) for k in NAMES)], [*(f.name for f in given), *NAMES])

    out = source.mapInArrow(run, schema_with(given, SCHEMA))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    bad = F.col("dup_line_chars") > line_limit * F.col("word_chars")
    for k, share in limits.items():
        bad = bad | (F.col(f"dup_chars_{k}") > share * F.col("word_chars"))
    return out.withColumn("base_failed", base).withColumn("kept", ~base & ~bad)


def op6_quality_rules(spark, sf_dir) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
