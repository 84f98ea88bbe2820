"""Language of a text by interpolated Kneser-Ney character models.

Counts of character 4-grams of a bounded sample of labelled rows become, per
language, probabilities by interpolated Kneser-Ney smoothing.  The models are
sorted arrays of n-gram hashes, with one column of discounted probabilities and
one of back-off weights for each language.  A text gets the language of the
lowest cross-entropy per character.  A logistic of how far that entropy lies
below the next one and of its own height, fitted on further labelled rows, gives
the score; below ``reject`` the row is marked as rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, beside, freed, mix, schema_with, table, text_slices

ORDER = 4
DISCOUNT = 0.75
#: About so many rows of each language give the counts, and so many more the calibration; chosen by hash of the id.
SAMPLE_ROWS, CALIBRATE_ROWS = 600, 200
MAX_LANGUAGES = 200
REJECT = 0.5
FLOOR = 1.0 / 0x110000  # of any character, before the first order
EDGE = 0x20
_KIND = np.zeros(0x110000, np.int8)  # 1 letter, 2 other, 0 not asked yet


def _letters(c: np.ndarray) -> np.ndarray:
    seen = np.unique(c)
    for x in seen[_KIND[seen] == 0].tolist():
        _KIND[x] = 1 if chr(x).isalpha() else 2
    return _KIND[c] == 1


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, bounds) of many texts: letters in lower case, any run of other characters as one separator."""
    raw = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    c = np.concatenate([np.zeros(0, np.uint32), *raw]).astype(np.int64)
    letter = _letters(c)
    head = np.zeros(len(c) + 1, bool)
    head[bounds] = True
    keep = letter | (~head[: len(c)] & np.concatenate(([False], letter))[: len(c)])
    return np.where(letter, c, EDGE)[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]


def contexts(c: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Hashes of the last n characters before each one, n = 0 .. ORDER - 1; a text starts behind separators."""
    begin = np.repeat(bounds[:-1], np.diff(bounds))
    where, h = np.arange(len(c)), np.zeros(len(c), U64)
    out = [h]
    for n in range(1, ORDER):
        x = np.where(where - n >= begin, c[np.maximum(where - n, 0)], EDGE).astype(U64)
        h = mix(h * U64(3) + x + U64(n))
        out.append(h)
    return out


def joined(ctx: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Hash of a context of n characters with the next one."""
    return mix(ctx ^ (c.astype(U64) * U64(0x9E3779B97F4A7C15)) + U64(n + 11))


class Models:
    """``keys[n]``: sorted hashes of (context of n, character) with ``prob[n]``; ``heads[n]``: of contexts with ``weight[n]``."""

    def __init__(self, languages, keys, prob, heads, weight, tilt=(0.0, 0.0, 0.0), reject=REJECT):
        self.languages, self.keys, self.prob, self.heads, self.weight, self.tilt, self.reject = languages, keys, prob, heads, weight, tilt, reject

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits per character under each language, number of characters with letters) of texts."""
        c, bounds = characters(texts)
        k = len(self.languages)
        if not len(c):
            return np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
        ctx = contexts(c, bounds)
        code, _ = pd.factorize(joined(ctx[-1], c, ORDER - 1))
        first = np.zeros(code.max() + 1, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]  # each different 4-gram is looked up once
        p = np.full((len(first), k), FLOOR)
        for n in range(ORDER):
            p = _get(self.keys[n], self.prob[n], joined(ctx[n][first], c[first], n), 0.0) + p * _get(self.heads[n], self.weight[n], ctx[n][first], 1.0)
        bits = -np.log2(p)
        size = np.diff(bounds)
        full = np.flatnonzero(size)
        out = np.zeros((len(texts), k))
        for j in range(k):
            out[full, j] = np.add.reduceat(bits[:, j][code], bounds[:-1][full]) / size[full]
        return out, size

    def score(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, calibrated probability that it is right)."""
        best = bits.argmin(1)
        return best, 1 / (1 + np.exp(-(_signals(bits) @ np.array(self.tilt))))


def _signals(bits: np.ndarray) -> np.ndarray:
    ranked = np.sort(bits, axis=1)
    gap = ranked[:, 1] - ranked[:, 0] if bits.shape[1] > 1 else np.ones(len(bits))
    return np.column_stack((np.ones(len(bits)), 4 * np.minimum(gap, 2.0), -ranked[:, 0] / 4))


def _get(keys: np.ndarray, values: np.ndarray, h: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(h), values.shape[1]), other)
    slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where((keys[slot] == h)[:, None], values[slot], other)


def kneser_ney(counts: pd.DataFrame, languages: list[str]) -> Models:
    """Models from rows (lang, context hashes c0.., gram hashes g0.., n): each different 4-gram of a language once."""
    keys, prob, heads, weight = [], [], [], []
    for n in range(ORDER):
        parts_p, parts_w = [], []
        for i in range(len(languages)):
            own = counts[counts["lang"] == i]
            if n == ORDER - 1:
                g = own[[f"c{n}", f"g{n}", "n"]].set_axis(["c", "g", "n"], axis=1)
            else:  # lower orders count the different characters before an n-gram
                g = own[[f"c{n}", f"g{n}", f"c{n + 1}"]].drop_duplicates().groupby([f"c{n}", f"g{n}"]).size().reset_index().set_axis(["c", "g", "n"], axis=1)
            total = g.groupby("c")["n"].agg(["sum", "size"])
            base = total["sum"].reindex(g["c"]).to_numpy()
            parts_p.append((g["g"].to_numpy(), i, (g["n"].to_numpy() - DISCOUNT) / base))
            parts_w.append((total.index.to_numpy(), i, (DISCOUNT * total["size"] / total["sum"]).to_numpy()))
        for parts, a, b, other in ((parts_p, keys, prob, 0.0), (parts_w, heads, weight, 1.0)):
            h = np.unique(np.concatenate([np.zeros(0, U64), *(p[0].astype(U64) for p in parts)]))
            v = np.full((len(h), len(languages)), other)
            for x, i, y in parts:
                v[np.searchsorted(h, x.astype(U64)), i] = y
            a.append(h)
            b.append(v)
    return Models(languages, keys, prob, heads, weight)


def fit(rows: DataFrame, *, sample_rows: int = SAMPLE_ROWS, calibrate_rows: int = CALIBRATE_ROWS, reject: float = REJECT) -> Models | None:
    """Models from labelled ``rows`` (doc_id, text, lang); null languages and texts teach nothing; None without any row."""
    rows = rows.filter("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return None
    languages = sorted(sizes)
    number = {x: i for i, x in enumerate(languages)}
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def share(of):
        return F.element_at(F.create_map(*[F.lit(y) for x in languages for y in (x, min(1.0, of / sizes[x]))]), F.col("lang"))

    a, b = share(sample_rows * (1.0)), share(sample_rows + calibrate_rows)
    part = F.when(draw < F.least(a, b * sample_rows / (sample_rows + calibrate_rows)), 0).when(draw < b, 1)
    chosen = rows.select("text", "lang", part.alias("part")).filter("part is not null")

    def count(batches):
        held: dict[int, list] = {}
        for batch in text_slices(batches):
            for lang in set(langs := batch.column(1).to_pylist()):
                c, bounds = characters([t for t, x in zip(batch.column(0).to_pylist(), langs, strict=True) if x == lang])
                ctx = contexts(c, bounds)
                frame = pd.DataFrame({f"{k}{n}": (ctx[n] if k == "c" else joined(ctx[n], c, n)).view(np.int64) for n in range(ORDER) for k in "cg"})
                last = [f"c{ORDER - 1}", f"g{ORDER - 1}"]
                held.setdefault(number[lang], []).append(frame.assign(n=frame.groupby(last)[last[1]].transform("size")).drop_duplicates(last))
        for i, frames in held.items():
            whole = pd.concat(frames)
            names = [x for x in whole.columns if x != "n"]
            yield pa.RecordBatch.from_pandas(whole.groupby(names, as_index=False)["n"].sum().assign(lang=i)[["lang", *names, "n"]], preserve_index=False)

    names = [f"{k}{n}" for n in range(ORDER) for k in "cg"]
    found = chosen.filter("part = 0").select("text", "lang").mapInArrow(count, "lang long, " + ", ".join(f"{x} long" for x in names) + ", n long")
    counts = found.groupBy("lang", *names).agg(F.sum("n").alias("n")).toPandas()
    for x in names:
        counts[x] = counts[x].to_numpy().view(U64)
    models = kneser_ney(counts, languages)
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def told(batches):
        for batch in text_slices(batches):
            bits, size = shared.value.entropy([t or "" for t in batch.column(0).to_pylist()])
            right = np.array([number[x] for x in batch.column(1).to_pylist()]) == bits.argmin(1)
            s = _signals(bits)[size > 0]
            yield pa.RecordBatch.from_arrays([pa.array(s[:, 1]), pa.array(s[:, 2]), pa.array(right[size > 0])], ["gap", "low", "good"])

    fitted = chosen.filter("part = 1").select("text", "lang").mapInArrow(told, "gap double, low double, good boolean").toPandas()
    x = np.column_stack((np.ones(len(fitted)), fitted["gap"], fitted["low"])) if len(fitted) else np.zeros((0, 3))
    y = fitted["good"].to_numpy().astype(float) if len(fitted) else np.zeros(0)
    tilt = np.array([0.0, 1.0, 0.0])
    for _ in range(25):  # Newton's steps, held near the start by a weak prior
        q = 1 / (1 + np.exp(-x @ tilt))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.eye(3), x.T @ (y - q) - (tilt - np.array([0.0, 1.0, 0.0])))
        tilt = tilt + np.clip(step, -1, 1)
    models.tilt, models.reject = tuple(tilt), reject
    return models


def identify(docs: DataFrame, models: Models | None, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``lang_rejected``.

    Null texts and texts without a letter get ``und`` with score 0, as does
    every text if there is no model.  Ties go to the language first in the
    alphabet.  Other columns pass through, or those named in ``keep``; one named
    like a new one is replaced.
    """
    given, place, source = beside(docs, text, ["lang_pred", "score", "lang_rejected"], keep)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @freed
    def run(batches):
        m = shared.value
        for part in text_slices(batches, place):
            texts = [t or "" for t in part.column(place).to_pylist()]
            if m is None:
                names, score = ["und"] * len(texts), np.zeros(len(texts))
            else:
                bits, size = m.entropy(texts)
                best, score = m.score(bits)
                score = np.where(size > 0, score, 0.0)
                names = [m.languages[b] if n else "und" for b, n in zip(best, size, strict=True)]
            low = score < (m.reject if m else 1.0)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[: len(given)], pa.array(names), pa.array(score), pa.array(low)], [*(f.name for f in given), "lang_pred", "score", "lang_rejected"]
            )

    return source.mapInArrow(run, schema_with(given, "lang_pred string, score double, lang_rejected boolean"))


def op7_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    models = fit(docs.filter(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), models, keep=["doc_id", "held_out"])
