"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs over the whole corpus are quantised to levels of
``BASE``; an item of level q is entered q times, once with each level up to q.
Probing level after level until one is missing gives the level back: never too
low, and too high only by false positives.  Each bucket of the hash space fills
its own segment, of ``ENTRY_BITS`` bits for each entry: every word and every pair
is in the filter, at the same rate of false positives whatever the corpus's size.
Words are told apart by hashes of 64 bits, pairs by hashes whose width follows
from the corpus's bytes, so that the share of pairs that meet another stays far
below the filter's own rate at every size.

The filter stays a table by bucket, as it grows with the corpus.  Texts are cut
into chunks; a chunk sends its distinct words and pairs to their buckets, which
probe them and send the levels back to the chunk, where pair probabilities are
smoothed.

Beside it, the plain unigram score is exact: counts of common words are known on
every worker (a list of bounded length), the others come back with the levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, freed, mix, schema_with, table, text_slices, written
from .packed_counts import bucket_of, by_bucket, count_hashes, frequent, layout, pack, pack_counts, unpack, unpack_counts

BASE = 1.5
PROBES = 3
ENTRY_BITS = 8  # of the filter for each entry; 3 / ln 2 would be full
CHUNK_BYTES = 1 << 22
COMMON_WORDS = 1 << 17
SLICE = 1 << 20  # hashes placed at a time
PAIR_WEIGHT, PAIR_SHRINK = 0.5, 10.0  # a pair counts up to PAIR_WEIGHT, less after rare words
END = U64(0x5DEECE66D1CE4E5B)


def tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, bounds): the words of each text in small letters A-Z, then one end."""
    w = Words(part.column(part.schema.get_field_index("text")), lower=True)
    bounds = w.bounds + np.arange(len(w.bounds))
    out = np.full(bounds[-1], END, U64)
    out[np.arange(len(w.start)) + w.doc] = w.hashes()
    return out, bounds


def pairs(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the token before each one, hash of both); an end stands before each text."""
    before = np.concatenate(([END], h[:-1])).astype(U64)[: len(h)]
    before[bounds[:-1]] = END
    return before, mix(mix(before) * U64(3) + h)


def _places(h: np.ndarray, level: int, size: int) -> list[np.ndarray]:
    x = mix(h + U64(level * 0x9E3779B97F4A7C15 % 2**64))
    out = []
    for _ in range(PROBES):
        out.append((x % U64(size)).astype(np.int64))
        x = mix(x + U64(1))
    return out


def level_of(counts: np.ndarray) -> np.ndarray:
    """Level of a count: 1 for 1, then one more for each factor ``BASE``."""
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def middle(level: np.ndarray) -> np.ndarray:
    """Count that stands for a level; 0 for level 0."""
    return np.where(level > 0, BASE ** (level - 0.5), 0.0)


class LogBloom:
    """One bit array of ``buckets`` equal segments."""

    def __init__(self, bits: np.ndarray, buckets: int, hash_bits: int):
        self.bits, self.buckets, self.hash_bits = bits, buckets, hash_bits
        self.size = len(bits) * 8 // buckets

    @staticmethod
    def segment(h: np.ndarray, counts: np.ndarray, size: int) -> bytes:
        """Bits of one segment with all its items entered; ``size`` is a multiple of 8."""
        on = np.zeros(size, bool)
        level = level_of(counts)
        for q in range(1, int(level.max(initial=0)) + 1):
            entered = h[level >= q]
            for i in range(0, len(entered), SLICE):
                for at in _places(entered[i : i + SLICE], q, size):
                    on[at] = True
        return np.packbits(on, bitorder="little").tobytes()

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Middle of the level found for each hash; 0 for what is not in the filter."""
        return middle(self.levels(h))

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Level found for each hash; 0 for what is not in the filter."""
        start = bucket_of(h, self.buckets, self.hash_bits) * self.size
        level, live, q = np.zeros(len(h), np.int64), np.arange(len(h)), 1
        while len(live):
            ok = np.ones(len(live), bool)
            for at in _places(h[live], q, self.size):
                place = start[live] + at
                ok &= (self.bits[place >> 3] >> (place & 7)) & 1 == 1
            live = live[ok]
            level[live] = q
            q += 1
        return level


class Scorer:
    """What every worker gets: the common words' exact counts, the totals, the number of buckets and the width of pair hashes."""

    def __init__(self, common: np.ndarray, exact: np.ndarray, n: int, v: int, buckets: int, pair_bits: int):
        self.common, self.exact, self.n, self.v, self.buckets, self.pair_bits = common, exact, n, v, buckets, pair_bits

    def known(self, h: np.ndarray) -> np.ndarray:
        """Exact count of each common word; 0 for others."""
        if not len(self.common):
            return np.zeros(len(h), np.int64)
        slot = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
        return np.where(self.common[slot] == h, self.exact[slot], 0)

    def log10(self, own: np.ndarray, head: np.ndarray, joint: np.ndarray) -> np.ndarray:
        """log10 probability of tokens after the ones before them, from the counts of the token, the one before and the pair."""
        p1 = (own + 1.0) / (self.n + self.v + 1.0)
        p2 = np.where(head > 0, joint / np.maximum(np.maximum(head, joint), 1.0), 0.0)
        share = PAIR_WEIGHT * head / (head + PAIR_SHRINK)
        return np.log10(share * p2 + (1 - share) * p1)


def train(docs: DataFrame, *, entry_bits: float = ENTRY_BITS, common_words: int = COMMON_WORDS) -> tuple[Scorer, DataFrame]:
    """(what to broadcast, table of the filter's segments and the other words' counts by bucket) from a column ``text``; null is empty."""
    buckets, pair_bits = layout(docs)

    def hashes(part):
        h, bounds = tokens(part)
        return {0: h, 1: pairs(h, bounds)[1]}

    packed = count_hashes(docs.select("text"), hashes, buckets=buckets, name="lm", bits={1: pair_bits})
    common, exact, floor = frequent(packed, 0, common_words)

    def fill(batches):
        for b in batches:
            for kind, bucket, h, c in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                h, c = unpack(h), unpack_counts(c)
                size = max(64, -int(-level_of(c).sum() * entry_bits // 8) * 8)
                rare = (c < floor) & (kind == 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([LogBloom.segment(h, c, size)], pa.binary()),
                        pa.array([pack(h[rare])], pa.binary()), pa.array([pack_counts(c[rare])], pa.binary()),
                    ],
                    ["kind", "bucket", "bits", "hashes", "counts"],
                )

    segments = written(packed.select("kind", "bucket", "hashes", "counts").mapInArrow(freed(fill), "kind int, bucket int, bits binary, hashes binary, counts binary"), "filter")

    def totals(batches):
        for b in batches:
            c = [unpack_counts(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(int(x.sum()) for x in c)]), pa.array([sum(map(len, c))])], ["n", "v"])

    single = packed.filter("kind = 0")
    n, v = single.select("counts").mapInArrow(totals, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    return Scorer(common, exact, n, v, buckets, pair_bits), segments


def _zip(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unzip(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, rows): about ``most`` bytes of text each, as an Arrow stream."""
    first, held, size, k = TaskContext.get().partitionId() << 32, [], 0, 0

    def row():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for part in held:
                out.write_batch(part)
        return pa.RecordBatch.from_arrays([pa.array([first + k], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

    for part in text_slices(batches):
        held.append(part)
        size += pc.sum(pc.binary_length(part.column(part.schema.get_field_index("text")))).as_py() or 0
        if size >= most:
            yield row()
            held, size, k = [], 0, k + 1
    if held:
        yield row()


def _opened(rows: bytes, pair_bits: int) -> tuple[list, dict[int, np.ndarray]]:
    """[(part, hashes, bounds)] of a chunk, and the distinct words and pairs (leading bits) in order."""
    parts = [(part, *tokens(part)) for part in pa.ipc.open_stream(rows)]
    both = [pairs(h, bounds)[1] >> U64(64 - pair_bits) for _, h, bounds in parts]
    return parts, {0: np.unique(np.concatenate([h for _, h, _ in parts])), 1: np.unique(np.concatenate(both))}


def score(docs: DataFrame, model: Scorer, segments: DataFrame, *, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` without their text, with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``base_score`` is the exact add-one unigram log10 probability, ``score`` the
    smoothed pair model's.  Null and empty texts are one end token.  Repeated
    rows each give a row.  Columns named like a new one are replaced.
    """
    spark = docs.sparkSession
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    named = [f.name for f in docs.schema.fields if f.name not in {text, *new}]
    source = docs.select(*[F.col(f"`{x}`").alias(f"c{i}") for i, x in enumerate(named)], F.col(f"`{text}`").alias("text"))
    given = source.schema.fields[:-1]
    shared, buckets, width = spark.sparkContext.broadcast(model), model.buckets, {0: 64, 1: model.pair_bits}
    chunks = written(source.mapInArrow(lambda batches: _chunks(batches, chunk_bytes), "chunk long, rows binary"), "chunks")

    def ask(batches):
        for b in batches:
            for chunk, rows in zip(b.column(0), b.column(1), strict=True):
                for kind, h in _opened(rows.as_py(), width[1])[1].items():
                    at, first, end = zip(*by_bucket(h, buckets, width[kind]), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([chunk.as_py()] * len(at), pa.int64()), pa.array([kind] * len(at), pa.int32()), pa.array(at, pa.int32()),
                            pa.array([_zip(pack(h[i:j])) for i, j in zip(first, end, strict=True)], pa.binary()),
                        ],
                        ["chunk", "kind", "bucket", "asked"],
                    )

    def answer(batches):
        at = None
        for b in batches:
            for chunk, kind, bucket, asked, bits, hashes, counts in zip(*b.columns, strict=True):
                key = kind.as_py(), bucket.as_py()
                if not chunk.is_valid:  # a bucket's segment stands before what is asked
                    at = key
                    held = LogBloom(np.frombuffer(bits.as_py(), np.uint8), 1, width[at[0]])
                    rare, c = unpack(hashes.as_py()), unpack_counts(counts.as_py())
                    continue
                h = unpack(_unzip(asked.as_py()))
                level, exact = np.zeros(len(h), np.uint8), np.zeros(len(h) if key[0] == 0 else 0, np.int64)
                if key == at:
                    level = np.minimum(held.levels(h), 255).astype(np.uint8)
                    if key[0] == 0 and len(rare):
                        slot = np.minimum(np.searchsorted(rare, h), len(rare) - 1)
                        exact = np.where(rare[slot] == h, c[slot], 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk.as_py()], pa.int64()), pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([_zip(level.tobytes())], pa.binary()), pa.array([_zip(exact.tobytes())], pa.binary())],
                    ["chunk", "kind", "bucket", "levels", "counts"],
                )

    none = F.lit(None)
    asked = chunks.mapInArrow(freed(ask), "chunk long, kind int, bucket int, asked binary")
    probed = segments.select(none.cast("long").alias("chunk"), "kind", "bucket", none.cast("binary").alias("asked"), "bits", "hashes", "counts").unionByName(asked, allowMissingColumns=True)
    probed = probed.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", F.col("chunk").asc_nulls_first())
    answers = probed.mapInArrow(freed(answer), "chunk long, kind int, bucket int, levels binary, counts binary")

    def grade(tab: pa.Table) -> pa.Table:
        m, got, rows = shared.value, {0: [], 1: []}, None
        for kind, bucket, levels, counts, payload in zip(*(tab[c].to_pylist() for c in ("kind", "bucket", "levels", "counts", "rows")), strict=True):
            if payload is not None:
                rows = payload
            else:
                got[kind].append((bucket, np.frombuffer(_unzip(levels), np.uint8), np.frombuffer(_unzip(counts), np.int64)))
        parts, distinct = _opened(rows, width[1])
        single, joint = (middle(np.concatenate([x[1] for x in sorted(got[k], key=lambda x: x[0])]).astype(np.int64)) for k in (0, 1))
        exact = np.concatenate([x[2] for x in sorted(got[0], key=lambda x: x[0])])
        exact = np.maximum(exact, m.known(distinct[0]))
        out = []
        for part, h, bounds in parts:
            before, pair = pairs(h, bounds)
            own, head = (np.searchsorted(distinct[0], x) for x in (h, before))
            both = np.searchsorted(distinct[1], pair >> U64(64 - width[1]))
            c, n = exact[own], np.diff(bounds)
            sums = [np.add.reduceat(x, bounds[:-1]) for x in ((c > 0).astype(np.int64), np.log10(c + 1.0), m.log10(single[own], single[head], joint[both]))]
            base = sums[1] - n * np.log10(m.n + m.v + 1.0)
            out.append(pa.Table.from_arrays([*(part.column(i) for i in range(len(given))), *map(pa.array, (n, sums[0], np.full(len(n), m.n), base, sums[2]))], [*(f.name for f in given), *new]))
        return pa.concat_tables(out)

    whole = answers.unionByName(chunks, allowMissingColumns=True)
    graded = whole.groupBy("chunk").applyInArrow(grade, schema_with(given, "n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    return graded.toDF(*named, *new)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def op9_bloom_lm(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, segments = train(docs.filter(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return score(rows, model, segments)
