"""A keyed table in parts: merges read and rewrite only the parts that hold incoming keys."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .keyed import newest, upsert, upsert_preserving

LOG = "part int, version long, attempt long, path string"


class KeyedTable:
    """A table in a shared folder, cut into parts, that batches update and restarts find again.

    Every write of a part goes to a fresh path; a row of the log names it, and is
    added only when all its files are there.  Version n is what batch n wrote; of
    one part the last version counts, of one version the last attempt.  So a
    batch that runs again after a failure starts from the versions before its
    own, whatever its first attempt left.  A batch rewrites the parts it touches
    and no others; ``part`` is a whole-number expression of the row, such as its
    month, that follows from its key: a row's key then always meets its own part.
    """

    def __init__(self, spark: SparkSession, path: str, schema, part: Column):
        self.spark, self.path, self.part = spark, path.rstrip("/"), part.cast("int")
        self.schema = spark.createDataFrame([], schema).schema
        spark.createDataFrame([], LOG).write.mode("append").json(f"{self.path}/log")

    def _paths(self, before: int | None) -> dict[int, str]:
        """Where each part's rows are: one short string a part."""
        log = self.spark.read.schema(LOG).json(f"{self.path}/log")
        log = log if before is None else log.filter(F.col("version") < before)
        return {r.part: r.path for r in log.groupBy("part").agg(F.max_by("path", F.struct("version", "attempt")).alias("path")).collect()}

    def _load(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, or those of the versions before one."""
        return self._load(list(self._paths(before).values()))

    def merge(self, batch: DataFrame, version: int, how: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the parts that ``batch`` touches by ``how(their rows, batch)``."""
        have = set(batch.columns)
        batch = batch.withColumns({f.name: F.lit(None).cast(f.dataType) for f in self.schema if f.name not in have})
        out = f"{self.path}/data/{version}-{uuid.uuid4().hex}"
        batch.select(*self.schema.names).write.parquet(f"{out}-batch")  # it is read for its parts and for its rows
        batch = self._load([f"{out}-batch"])
        touched = [r[0] for r in batch.select(self.part.alias("_part")).distinct().collect()]
        if not touched:
            return
        paths = self._paths(version)
        held = self._load([paths[p] for p in touched if p in paths])
        # a part's rows come together before they are written, large parts in several tasks: else every task has a file in every part
        how(held, batch).withColumn("_part", F.coalesce(self.part, F.lit(-1))).hint("rebalance", F.col("_part")).write.partitionBy("_part").parquet(out)
        rows = [(p, version, time.time_ns(), f"{out}/_part={-1 if p is None else p}") for p in touched]
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")

    def upsert(self, batch: DataFrame, version: int, keys: Sequence[str], order: Sequence[str]) -> None:
        """Merge rows: an incoming row replaces the one with its key, of several incoming ones the newest by ``order`` counts."""
        self.merge(newest(batch, keys, order), version, lambda held, new: upsert(held, new, keys, order))

    def upsert_preserving(self, batch: DataFrame, version: int, keys: Sequence[str], update: Sequence[str]) -> None:
        """Merge rows with one row a key: of rows that exist only the ``update`` columns change; what the batch has not is null in new rows."""
        have = batch.columns
        self.merge(batch, version, lambda held, new: upsert_preserving(held, new.select(*[c for c in new.columns if c in have]), keys, update))
