"""Numbering rows in order without a task that sees a whole key, and blocks of such rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Cut = Callable[[DataFrame], DataFrame]


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], cut: Cut, *, rank: str = "_rank", total: str = "_total") -> DataFrame:
    """``df`` with each row's number from 0 within its keys, in order, and the key's number of rows."""
    return with_sizes(df, keys, order, cut, rank=rank, total=total)[0]


def with_sizes(df: DataFrame, keys: Sequence[str], order: Sequence[str], cut: Cut, *, rank: str = "_rank", total: str = "_total") -> tuple[DataFrame, DataFrame]:
    """The same, and the small table of ranges, which has every key's number of rows.

    Rows are dealt out by range of (keys, order) and numbered where they lie; a
    small table with one row for each (keys, range) adds the ranges before.  So
    a hot key is as many tasks as it has ranges.  ``cut`` writes a table and
    reads it back: the ranges must not be dealt anew in between.  Ties in
    ``order`` are numbered in any order; without keys all rows are one series.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order]
    placed = cut(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))  # Spark numbers the rows of a range from 2**33 times its own number on
    ranges = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row a range, or a key if keys are small; without keys that is one short table
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = cut(ranges.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_first", before.alias("_before"), F.sum("_n").over(whole).alias(total)))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = placed.join(ranges, same).withColumn(rank, F.col("_at") - F.col("_first") + F.col("_before"))
    return out.select(*df.columns, rank, total), ranges


def quantiles(df: DataFrame, x: str, n: int, cut: Cut) -> DataFrame:
    """One row with ``bounds``: the n + 1 linear quantiles of a column's values over all rows, exactly; null values count for nothing.

    The values are put in order in ranges; of them only the few at the
    quantiles' places meet in one aggregate.
    """
    r = ranked(df.select(x).filter(F.col(x).isNotNull()), [], [x], cut)
    at = [(F.col("_total") - 1) * F.lit(i / n) for i in range(n + 1)]
    near = F.lit(False)
    for a in at:
        near = near | (F.col("_rank") == F.floor(a)) | (F.col("_rank") == F.ceil(a))
    few = r.filter(near)
    low = [F.max(F.when(F.col("_rank") == F.floor(a), F.col(x))) for a in at]
    top = [F.max(F.when(F.col("_rank") == F.ceil(a), F.col(x))) for a in at]
    share = [F.max(a - F.floor(a)) for a in at]
    return few.agg(F.array(*[lo + (hi - lo) * s for lo, hi, s in zip(low, top, share, strict=True)]).alias("bounds"))
