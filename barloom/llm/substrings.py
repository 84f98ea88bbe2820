"""Repeated passages across documents: seed and extend.

A window is ``size`` consecutive words of one document; a word goes if it lies
in a window whose word sequence also starts in a document with a smaller id.

1. *Seeds.*  Of the ``size - k + 1`` k-word shingles of a window, the one with
   the smallest hash (the last, if several) is its anchor.  Equal windows have
   equal anchors at the same place, so documents that share a window meet when
   their anchors are joined.  The windows that hang on one anchor are
   consecutive; the words they cover are the anchor's *stretch*, which reaches
   up to ``size - k`` words to either side.
2. *Extend as a whole.*  An anchor in a single document is dropped.  Stretches
   with one anchor and one word sequence form a class; its smallest document
   stands for it, all others lose the whole stretch.
3. *Extend by length.*  Where an anchor has several classes, their
   representatives differ somewhere to the left or right.  Each extends window
   by window, and again the smallest document of a window keeps it.
4. *Maximal repeats* are the unions of the windows lost, word by word.

A document carries a row for each of its distinct stretches, never for a pair of
documents, and each step keeps minima only, which Spark combines before it
shuffles.  The joins back are of rows with one row a key, where Spark splits a
hot key's side; texts meet what was found for them by id.

Sequences count as equal if the 64-bit hashes of the anchor and of the whole
sequence (or window) both are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, freed, mix, powers, schema_with, table, text_slices, utf8, written

SIZE, K = 50, 8


class Stretches:
    """The windows of a slice of texts, their anchors and stretches, as arrays over words."""

    def __init__(self, col: pa.Array, size: int, k: int):
        self.words = w = Words(col, lower=False)
        self.size, n = size, len(w.start)
        up, self._down = powers(n + 1)
        self._sums = np.zeros(n + 1, U64)
        np.cumsum(w.hashes() * up[:n], out=self._sums[1:])
        last = n - size + 1
        if last <= 0:
            self.at = self.anchor = self.stretch = self.first = np.zeros(0, np.int64)
            return
        seed = self.sequence(np.arange(n - k + 1), k)
        anchor = np.arange(n - k + 1)
        low, reach, span = seed, 1, size - k + 1
        while reach < span:  # smallest of 2, 4, ... shingles, then of all
            step = min(reach, span - reach)
            right = low[step:] <= low[:-step]
            low, anchor = np.where(right, low[step:], low[:-step]), np.where(right, anchor[step:], anchor[:-step])
            reach += step
        self.at = np.flatnonzero(w.doc[:last] == w.doc[size - 1 :])  # windows within one text
        self.anchor = anchor[self.at]
        new = np.ones(len(self.at), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.at[1:] != self.at[:-1] + 1)
        self.first = np.flatnonzero(new)
        self.stretch = np.cumsum(new) - 1
        self.seed = seed[self.anchor[self.first]] if len(self.first) else np.zeros(0, U64)

    def sequence(self, at: np.ndarray, n) -> np.ndarray:
        """Hash of the ``n`` words from each place on."""
        return mix((self._sums[at + n] - self._sums[at]) * self._down[at] + np.asarray(n).astype(U64) * U64(0x9E3779B97F4A7C15))

    def whole(self) -> np.ndarray:
        """Hash of each stretch's words."""
        if not len(self.first):
            return np.zeros(0, U64)
        end = np.append(self.first[1:], len(self.at)) - 1
        return self.sequence(self.at[self.first], self.at[end] - self.at[self.first] + self.size)

    def doc(self) -> np.ndarray:
        """The text of each stretch."""
        return self.words.doc[self.at[self.first]] if len(self.first) else np.zeros(0, np.int64)


def _pair(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One value for (anchor, sequence) within a text."""
    return mix(a ^ mix(b + U64(1)) + mix(doc.astype(U64) + U64(7)))


def _distinct(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the first of equal (text, anchor, sequence)."""
    return np.sort(np.unique(_pair(a, b, doc), return_index=True)[1])


def _rows(ids: pa.Array, doc, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["doc", "seed", "words"])


def _given(col: pa.Array, doc: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, sequences) that came for one text."""
    pairs = col.slice(doc, 1).flatten()
    return (x.to_numpy(zero_copy_only=False).view(U64) for x in pairs.flatten()) if len(pairs) else (np.zeros(0, U64), np.zeros(0, U64))


def _marked(col: pa.Array, doc: np.ndarray, a: np.ndarray, b: np.ndarray, texts: int) -> np.ndarray:
    """Which (text, anchor, sequence) are among those that came for their text."""
    have = [np.zeros(0, U64)]
    for d in range(texts):
        if col[d].is_valid:
            x, y = _given(col, d)
            have.append(_pair(x, y, np.full(len(x), d)))
    return np.isin(_pair(a, b, doc), np.concatenate(have))


def stretches(docs: DataFrame, size: int, k: int) -> DataFrame:
    """(doc, seed, words): each text's distinct stretches.  ``docs`` has the columns doc and text."""

    def cut(batches):
        for b in text_slices(batches, 1):
            s = Stretches(b.column(1), size, k)
            doc, whole = s.doc(), s.whole()
            if len(doc):
                at = _distinct(doc, s.seed, whole)
                yield _rows(b.column(0), doc[at], s.seed[at], whole[at])

    return docs.filter(F.col("doc").isNotNull()).mapInArrow(freed(cut), schema_with([docs.schema["doc"]], "seed long, words long"))


def windows(docs: DataFrame, size: int, k: int) -> DataFrame:
    """(doc, seed, words): the distinct windows of the stretches named in ``found``.  ``docs`` has the columns doc, text and found."""

    def cut(batches):
        for b in text_slices(batches, 1):
            s = Stretches(b.column(1), size, k)
            doc = s.doc()
            if not len(doc):
                continue
            wanted = np.flatnonzero(_marked(b.column(2), doc, s.seed, s.whole(), b.num_rows)[s.stretch])
            seed, seq, doc = s.seed[s.stretch[wanted]], s.sequence(s.at[wanted], size), doc[s.stretch[wanted]]
            at = _distinct(doc, seed, seq)
            yield _rows(b.column(0), doc[at], seed[at], seq[at])

    return docs.mapInArrow(freed(cut), schema_with([docs.schema["doc"]], "seed long, words long"))


def _later(rows: DataFrame, least: DataFrame) -> DataFrame:
    """The rows whose sequence a smaller document has too; ``least`` has one row a sequence."""
    shared = least.filter(F.col("least") < F.col("most")).select("seed", "words", "least")
    return rows.join(shared.hint("shuffle_hash"), ["seed", "words"]).filter(F.col("doc") > F.col("least")).select("doc", "seed", "words")


def _by_doc(rows: DataFrame, name: str) -> DataFrame:
    """One row a document with all that was found for it; at most a few values for each of its words."""
    return rows.groupBy("doc").agg(F.collect_list(F.struct("seed", "words")).alias(name))


def lost(docs: DataFrame, *, size: int = SIZE, k: int = K) -> DataFrame:
    """(doc, gone_whole, gone_windows): what each document loses, as (anchor, sequence) of stretches and of windows."""
    seeds = written(stretches(docs, size, k), "seeds")
    anchors = seeds.groupBy("seed").agg(F.min("doc").alias("a"), F.max("doc").alias("z"), (F.min("words") < F.max("words")).alias("several")).filter("a < z").select("seed", "several")
    shared = written(seeds.join(written(anchors, "anchors").hint("shuffle_hash"), "seed"), "shared")
    classes = written(shared.groupBy("seed", "words").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.first("several").alias("several")), "classes")
    whole = _later(shared.drop("several"), classes)
    standing = classes.filter("several").select(F.col("least").alias("doc"), "seed", "words")
    apart = written(windows(docs.join(_by_doc(standing, "found").hint("shuffle_hash"), "doc").select("doc", "text", "found"), size, k), "windows")
    least = written(apart.groupBy("seed", "words").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most"), "least")
    parts = _later(apart, least)
    both = whole.select("doc", "seed", "words", F.lit(True).alias("whole")).unionByName(parts.select("doc", "seed", "words", F.lit(False).alias("whole")))
    pair = F.struct("seed", "words")
    return both.groupBy("doc").agg(F.collect_list(F.when(F.col("whole"), pair)).alias("gone_whole"), F.collect_list(F.when(~F.col("whole"), pair)).alias("gone_windows"))


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text) for every row of ``docs``.

    ``spans`` are the maximal repeats that go, as (start, end) in words; in
    ``kept_text`` the words that stay are joined by one space.  Null and empty
    texts have no words; texts under ``size`` words lose nothing.  A row without
    an id has no smaller or larger one: it loses nothing and takes nothing from
    others.  Rows with one id are judged alike and take nothing from each
    other.  Other columns are not read; an empty table gives an empty one.
    """
    if not 1 <= k <= size:
        raise ValueError("an anchor has from 1 to as many words as a window")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    have = rows.join(written(lost(rows, size=size, k=k), "lost").hint("shuffle_hash"), "doc", "left").select("doc", "text", "gone_whole", "gone_windows")

    def drop(batches):
        for b in text_slices(batches, 1):
            raw, off = utf8(b.column(1))
            raw = raw.tobytes()
            words = [raw[off[i] : off[i + 1]].split() for i in range(b.num_rows)]  # at 0x20 and 0x09-0x0D
            bounds = np.cumsum([0, *map(len, words)])
            gone = _gone(b, size, k) if b.column(2).null_count < b.num_rows else np.zeros(bounds[-1], bool)
            step = np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))
            start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            inner = bounds[(bounds > 0) & (bounds < bounds[-1])]
            cuts = np.unique(inner[gone[inner - 1] & gone[inner]])  # a repeat ends with its text
            start, end = np.sort(np.append(start, cuts)), np.sort(np.append(end, cuts))
            of = np.searchsorted(bounds, start, side="right") - 1
            spans = pa.StructArray.from_arrays([pa.array(start - bounds[of], pa.int32()), pa.array(end - bounds[of], pa.int32())], ["start", "end"])
            at = pa.array(np.searchsorted(of, np.arange(b.num_rows + 1)), pa.int32())
            n, left = np.diff(bounds), np.concatenate(([0], np.cumsum(gone)))[bounds]
            kept = [b" ".join(w if not m else [x for x, g in zip(w, gone[lo : lo + len(w)].tolist(), strict=True) if not g]) for w, m, lo in zip(words, np.diff(left), bounds, strict=False)]
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(np.diff(left), pa.int64()), pa.ListArray.from_arrays(at, spans), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n_words", "n_removed", "spans", "kept_text"])

    out = have.mapInArrow(freed(drop), schema_with([rows.schema["doc"]], "n_words long, n_removed long, spans array<struct<start int, end int>>, kept_text string"))
    return out.withColumnRenamed("doc", doc_id)


def _gone(b: pa.RecordBatch, size: int, k: int) -> np.ndarray:
    """Which words of a slice lie in a window that goes."""
    s = Stretches(b.column(1), size, k)
    n = len(s.words.start)
    if not len(s.first):
        return np.zeros(n, bool)
    doc = s.doc()
    bad = _marked(b.column(2), doc, s.seed, s.whole(), b.num_rows)[s.stretch]
    bad |= _marked(b.column(3), doc[s.stretch], s.seed[s.stretch], s.sequence(s.at, size), b.num_rows)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, s.at[bad], 1)
    np.add.at(cover, s.at[bad] + size, -1)
    return np.cumsum(cover)[:n] > 0


def op12_substrings(spark, sf_dir) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT rid, doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
hit AS (SELECT rid, i FROM win JOIN least USING (s) WHERE doc_id > least),
gone AS (SELECT DISTINCT rid, i + j AS p FROM hit, range(0, 50) t(j)),
all_words AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT a.rid, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM all_words a ANTI JOIN gone g ON g.rid = a.rid AND g.p = a.p GROUP BY a.rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.rid = d.rid
"""
