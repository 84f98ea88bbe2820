"""Shared helpers: tables in the shared folder, Arrow batches, byte-level word kernels.

Words everywhere are maximal runs of bytes other than space and 0x09-0x0D.  All
of those are ASCII, so splitting the UTF-8 bytes gives the same words as
splitting code points.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset in a local session, as in tests, a folder of this
    machine stands in for it; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='barloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, in folders ``by`` columns, read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows_each: int, n_rows: int) -> int:
    """A number of partitions for ``n_rows`` rows: never under the session's shuffle setting."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-n_rows // rows_each))


def schema_with(given: list[T.StructField], more: str) -> T.StructType:
    """The fields that pass through, then those of a DDL string."""
    return T.StructType([*given, *T.StructType.fromDDL(more).fields])


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names`` for columns of our own, with marks added until no column has one of them (letter case aside)."""
    taken, mark = {c.lower() for c in columns}, "_"
    while any(mark + x in taken for x in names):
        mark += "_"
    return [mark + x for x in names]


def beside(docs: DataFrame, text: str, new: list[str], keep: list[str] | None = None) -> tuple[list[T.StructField], int, DataFrame]:
    """(fields that pass through, place of the text, rows to read): the text comes once, after the fields if it isn't one of them.

    The rows' columns have names of their own, c0, c1, ..: batches go by place,
    and a name with a dot can't be read there.
    """
    given = [f for f in docs.schema.fields if f.name not in new and (keep is None or f.name in keep)]
    names = [f.name for f in given]
    source = [F.col(f"`{x}`").alias(f"c{i}") for i, x in enumerate(names)]
    if text in names:
        return given, names.index(text), docs.select(*source)
    return given, len(given), docs.select(*source, F.col(f"`{text}`").alias(f"c{len(given)}"))


# ---------------------------------------------------------------- Arrow batches


def text_slices(batches: Iterator[pa.RecordBatch], column: str | int = "text", most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice's text takes about ``most`` bytes (one long row may exceed it).

    ``column`` is a name, or a place where the caller's columns may have any name.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(column)
        ends = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), dtype=np.float64)))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0.0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def freed(run):
    """``run`` over batches, giving the memory it leaves in the worker back at its end, as workers outlive their tasks."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


# ---------------------------------------------------------------- word kernels

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64 (fixed values), elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hash's base, and of its inverse, up to ``n``."""
    if not _POWERS or len(_POWERS["up"]) <= n:
        size = 1 << max(20, int(n).bit_length())
        for key, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """The words of a slice of texts: ``start``, ``end`` (bytes), ``doc``, and bounds of each text's words."""

    def __init__(self, col: pa.Array, lower: bool):
        self.raw, self.off = utf8(col)
        if lower:
            self.raw = LOWER[self.raw]
        n = len(self.raw)
        ink = ~SPACE[self.raw]
        first = np.zeros(n + 1, bool)
        first[self.off] = True
        before = np.concatenate(([False], ink[:-1])) if n else ink
        self.start = np.flatnonzero(ink & (~before | first[:n]))
        after = np.concatenate((ink[1:], [False])) if n else ink
        self.end = np.flatnonzero(ink & (~after | first[1:])) + 1
        self.bounds = np.searchsorted(self.start, self.off)
        self.doc = np.repeat(np.arange(len(self.off) - 1), np.diff(self.bounds))

    def prefix(self) -> np.ndarray:
        """Running sums from which the hash of any byte range follows."""
        if not hasattr(self, "_prefix"):
            up, _ = powers(len(self.raw) + 1)
            self._prefix = np.zeros(len(self.raw) + 1, U64)
            np.cumsum(BYTE_CODE[self.raw] * up[: len(self.raw)], out=self._prefix[1:])
        return self._prefix

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rolling hash of byte ranges, the same wherever the bytes stand."""
        sums, (_, down) = self.prefix(), powers(len(self.raw) + 1)
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))

    def hashes(self) -> np.ndarray:
        return self.range_hash(self.start, self.end)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every window of ``k`` words inside a text."""
        m = len(hashes) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])
        h = np.zeros(len(at), U64)
        for j in range(k):
            h = mix(h * U64(3) + hashes[at + j] + U64(j + 1))
        return at, h


def lower_az(col):
    """Lower-case A-Z only, as a column."""
    return F.translate(col, A_Z, a_z)
