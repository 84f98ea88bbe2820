"""Counts of hashed items over a whole corpus, shuffled as packed numpy arrays.

Each task folds what it reads into sorted (hash, count) arrays and sends one
binary row per bucket of the hash space; a bucket's rows are merged into one row
again.  The shuffle carries about 12 bytes for each distinct item of a task, and
buckets grow in number with the session's shuffle partitions, not in size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, freed, text_slices, written

def pack(h: np.ndarray) -> bytes:
    """Rising hashes as differences, byte plane by byte plane: the empty planes vanish in the shuffle's compression."""
    gaps = np.diff(h, prepend=U64(0))
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel(), dtype=U64)


def pack_counts(c: np.ndarray) -> bytes:
    """Counts byte plane by byte plane."""
    return np.ascontiguousarray(c.astype(U64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


#: Bytes of text whose items share a bucket, about.
BUCKET_BYTES = 8 << 20


class Layout(NamedTuple):
    """How many buckets a corpus of so many bytes gets, and the width of hashes at which one in some thousand items at most meets another."""

    buckets: int
    bits: int


def layout(docs: DataFrame, column: str = "text") -> Layout:
    """From the bytes of the texts: a bucket for each ``BUCKET_BYTES``, hashes 2**10 times as many as there are bytes."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
    least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Layout(max(least, -(-size // BUCKET_BYTES)), min(64, max(40, size.bit_length() + 10)))


def bucket_of(h: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Which of equal ranges of the hash space (32 bits or more) a hash is in; rises with the hash."""
    return (((h >> U64(bits - 32)) * U64(buckets)) >> U64(32)).astype(np.int64)


def by_bucket(h: np.ndarray, buckets: int, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of each bucket that has some of the rising hashes."""
    if not len(h):
        return []
    b = bucket_of(h, buckets, bits)
    first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    return list(zip(b[first].tolist(), first.tolist(), [*first[1:].tolist(), len(h)], strict=True))


PACKED = "kind int, bucket int, hashes binary, counts binary"
FLUSH = 1_200_000


def fold(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the sum of their counts (1 each if not given)."""
    if counts is None:
        ranked = np.sort(hashes)
        new = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
        return ranked[new], np.diff(np.append(new, len(ranked)))
    order = np.argsort(hashes)
    ranked, counts = hashes[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
    return ranked[new], np.add.reduceat(counts, new) if len(new) else counts[:0]


def count_hashes(docs: DataFrame, hashes_of: Callable[[pa.RecordBatch], dict[int, np.ndarray]], *, buckets: int, name: str, bits: dict[int, int] | None = None) -> DataFrame:
    """A written table in ``PACKED`` form: per kind and bucket all hashes, in order, with their counts.

    ``hashes_of`` gives the hashes of each kind in a slice of rows; ``docs``
    needs a column ``text``.  Of a kind named in ``bits`` only so many leading
    bits of a hash count.
    """
    bits = bits or {}

    def local(batches: Iterator[pa.RecordBatch]):
        held: dict[int, list] = {}
        size = 0

        def out():
            for kind, parts in held.items():
                h, c = fold(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                for b, lo, hi in by_bucket(h, buckets, bits.get(kind, 64)):
                    yield kind, b, pack(h[lo:hi]), pack_counts(c[lo:hi])

        def rows(found):
            found = list(found)
            if found:
                k, b, h, c = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(h, pa.binary()), pa.array(c, pa.binary())],
                    ["kind", "bucket", "hashes", "counts"],
                )

        for part in text_slices(batches):
            for kind, h in hashes_of(part).items():
                held.setdefault(kind, []).append(fold(h >> U64(64 - bits.get(kind, 64))))
                size += len(held[kind][-1][0])
            if size > FLUSH:
                for kind, parts in held.items():
                    held[kind] = [fold(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
                size = sum(len(p[0][0]) for p in held.values())
                if size > FLUSH * 0.7:
                    yield from rows(out())
                    held, size = {}, 0
        yield from rows(out())

    def merge(tab: pa.Table) -> pa.Table:
        h = np.concatenate([unpack(x) for x in tab["hashes"].to_pylist()])
        c = np.concatenate([unpack_counts(x) for x in tab["counts"].to_pylist()])
        h, c = fold(h, c)
        return pa.table(
            {
                "kind": pa.array([tab["kind"][0].as_py()], pa.int32()), "bucket": pa.array([tab["bucket"][0].as_py()], pa.int32()),
                "hashes": pa.array([pack(h)], pa.binary()), "counts": pa.array([pack_counts(c)], pa.binary()),
            }
        )

    return written(docs.mapInArrow(freed(local), PACKED).groupBy("kind", "bucket").applyInArrow(merge, PACKED), name)


def tallies(packed: DataFrame, kind: int) -> np.ndarray:
    """Number of items of one kind by the whole part of log2 of their count (64 numbers)."""

    def levels(batches):
        for b in batches:
            tally = np.zeros(64, np.int64)
            for x in b.column(b.schema.get_field_index("counts")).to_pylist():
                tally += np.bincount(np.log2(unpack_counts(x)).astype(int), minlength=64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array(tally)], ["level", "n"])

    tally = np.zeros(64, np.int64)
    counts = packed.filter(F.col("kind") == kind).select("counts")
    for r in counts.mapInArrow(levels, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        tally[r.level] = r.n
    return tally


def frequent(packed: DataFrame, kind: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The items of one kind that occur at least ``floor`` times, in order of hash, their counts, and ``floor``.

    ``floor`` is the smallest power of two, from 2, that at most ``most`` items
    reach, so what comes to the driver has a fixed bound; rarer items stay in
    the table.
    """
    of_kind = packed.filter(F.col("kind") == kind)
    above = np.cumsum(tallies(packed, kind)[::-1])[::-1]
    level = int(np.argmax(above <= most)) if (above <= most).any() else 63
    floor = 1 << max(1, level)

    def top(batches):
        for b in batches:
            for h, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = unpack_counts(c)
                yield pa.RecordBatch.from_arrays([pa.array([unpack(h)[c >= floor].tobytes()], pa.binary()), pa.array([c[c >= floor].tobytes()], pa.binary())], ["h", "c"])

    rows = of_kind.select("hashes", "counts").mapInArrow(top, "h binary, c binary").collect()
    h = np.concatenate([np.zeros(0, U64), *(np.frombuffer(r.h, U64) for r in rows)])
    c = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r.c, np.int64) for r in rows)])
    order = np.argsort(h)
    return h[order], c[order], floor
