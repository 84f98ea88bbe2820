"""Columns that need a symbol's bars in order, as jobs over blocks of its series.

A series is cut into blocks of ``SIZE`` bars, each with the ``HALO`` bars before
it, so that a long series is many tasks.  For the few means that reach back
without end, and for swings, a first pass sums up each block of a long series
(for means of means a second one), the summaries are composed per symbol, and
each block starts from the carry before it.  Series of one block need none of that:
``in_place`` takes them where they lie, if rows are dealt out by symbol.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import with_sizes
from ..operators.shared import written
from .recursion import ALL, COLUMNS, FIRST, HALO, MADE_OF, NEEDS, NO_SWINGS, SECOND, SWINGS, Block, Carry, Summary, after, columns, last_swings, means_of, summaries

SIZE = 4096


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Each row in its block (``_own``) and, near its end, in the next block's halo."""
    block = F.floor(F.col("_rank") / size)
    halo = (F.col("_rank") % size >= size - HALO) & ((block + 1) * size < F.col("_total"))
    both = F.when(halo, F.array(block, block + 1)).otherwise(F.array(block))
    out = rows.withColumn("_block", F.explode(both))
    return out.withColumn("_own", F.col("_block") == block)


def _carries(means: list[str], row: Sequence[float]) -> dict[str, Carry]:
    return {m: Carry(row[3 * i], int(row[3 * i + 1]), int(row[3 * i + 2])) for i, m in enumerate(means)}


def _scan(sums: DataFrame, means: list[str], swings: bool) -> DataFrame:
    """(symbol, _block, carry): what each block starts from, from the summaries of all blocks of a symbol in order."""
    width = len(Summary._fields)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        state, last, out = {m: Carry() for m in means}, np.array(NO_SWINGS), []
        for x in pdf["sums"]:
            out.append([v for m in means for v in state[m]] + (last.tolist() if swings else []))
            for i, m in enumerate(means):
                lead, first, slope, shift, tail, seen, size = x[width * i : width * (i + 1)]
                state[m] = after(state[m], Summary(int(lead), first, slope, shift, int(tail), int(seen), int(size)), ALL[m].alpha)
            if swings:
                new = np.array(x[width * len(means) :])
                last = np.where(np.isnan(new), last, new)
        return pd.DataFrame({"symbol": pdf["symbol"], "_block": pdf["_block"], "carry": out})

    return sums.groupBy("symbol").applyInPandas(one, T.StructType([sums.schema["symbol"], *T.StructType.fromDDL("_block long, carry array<double>").fields]))


def _grouped(blocks: DataFrame, carry: DataFrame | None, each, schema) -> DataFrame:
    """``each(block, carry row or None)`` for every block."""
    if carry is None:
        return blocks.groupBy("symbol", "_block").applyInPandas(lambda pdf: each(Block(pdf), None), schema)

    names = schema.names

    def both(pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:  # a carry for a block that is not asked for
            return pd.DataFrame({n: pd.Series(dtype=object) for n in names})
        return each(Block(pdf), None if at.empty else at["carry"].iloc[0])

    return blocks.groupBy("symbol", "_block").cogroup(carry.groupBy("symbol", "_block")).applyInPandas(both, schema)


def sequential(bars: DataFrame, names: Sequence[str] | None = None, *, size: int = SIZE) -> DataFrame:
    """``bars`` (one row per symbol and date) with the named columns of ``COLUMNS``, all of them by default.

    A column named like a new one is replaced.  Bars without a symbol are a
    series of their own.  An empty table gives an empty one.
    """
    names = list(COLUMNS if names is None else names)
    if size < HALO:
        raise ValueError(f"a block has at least {HALO} bars")
    given = bars.drop(*names)
    means, swings = means_of(names), any(n in SWINGS for n in names)
    low, high = [m for m in means if m in FIRST], [m for m in means if m in SECOND]
    rows, sizes = with_sizes(given, ["symbol"], ["bar_date"], written)
    long = (sizes.agg(F.max("_total")).first()[0] or 0) > size and (means or swings)
    kinds = [*T.StructType.fromDDL("_block long, sums array<double>").fields]
    summed = T.StructType([given.schema["symbol"], *kinds])
    blocks = _blocks(rows, size)
    need = sorted({c for n in names if n in MADE_OF or n in SWINGS for c in NEEDS.get(n, ["high", "low", "close"])})

    def sums_of(second: bool, carried: list[str]):
        def each(b: Block, row) -> pd.DataFrame:
            held = {} if row is None else _carries(carried, row)
            flat = [v for s in summaries(b, means, held, second) for v in s] + (last_swings(b) if swings and not second else [])
            return pd.DataFrame({"symbol": b.frame["symbol"].iloc[:1], "_block": b.frame["_block"].iloc[:1], "sums": [flat]})

        return each

    carry, carried = None, []
    if long:
        # the last block of a series has no successor to sum up for
        those = blocks.filter((F.col("_total") > size) & ((F.col("_block") + 1) * size < F.col("_total"))).select("symbol", *need, "_rank", "_block", "_own")
        tops = blocks.filter((F.col("_total") > size) & F.col("_own")).groupBy("symbol").agg(F.max("_block").alias("_block"))
        empty = F.array(*[F.lit(float(v)) for m in low for v in Summary(0, np.nan, 1.0, 0.0, 0, 0, 0)], *([F.lit(float("nan"))] * 4 if swings else []))

        def scanned(sums, of, with_swings, blank):
            return written(_scan(sums.unionByName(tops.select("symbol", "_block", blank.cast("array<double>").alias("sums"))), of, with_swings))

        carry, carried = scanned(_grouped(those, None, sums_of(False, []), summed), low, swings, empty), low
        if high:
            blank = F.array(*[F.lit(float(v)) for m in high for v in Summary(0, np.nan, 1.0, 0.0, 0, 0, 0)])
            second = scanned(_grouped(those, carry, sums_of(True, low), summed), high, False, blank)
            second = second.select(F.col("symbol").alias("_s"), F.col("_block").alias("_b"), F.col("carry").alias("_more"))
            carry = carry.join(second.hint("shuffle_hash"), F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
            n = 3 * len(low)
            carry = carry.select("symbol", "_block", F.concat(F.slice("carry", 1, n), "_more", F.slice("carry", n + 1, 4)).alias("carry"))
            carried = low + high

    def finish(b: Block, row) -> pd.DataFrame:
        held = {} if row is None else _carries(carried, row)
        last = NO_SWINGS if row is None or not swings else tuple(row[-4:])
        return b.frame.assign(**columns(b, names, held, last))[out.names]

    out = T.StructType([*given.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    done = _grouped(blocks, carry, finish, out)
    return done.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def longest(bars: DataFrame) -> int:
    """Bars of the longest series."""
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def in_place(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """What ``sequential`` gives, for series that are a block each and rows that are dealt out by symbol: they are not exchanged.

    Columns that the pass doesn't read go through as they are, however many.
    """
    given = rows.drop(*names)
    bars = [c for c in ("open", "high", "low", "close", "volume") if c in given.columns]

    def finish(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[("bar_date", "ascending")], null_placement="at_start").to_numpy()
        if (order[1:] < order[:-1]).any():
            table = table.take(order)
        made = columns(Block(table.select(bars).to_pandas().assign(_rank=np.arange(len(table)), _own=True)), list(names), {})
        for n in names:
            table = table.append_column(n, pa.array(made[n], mask=np.isnan(made[n])))
        return table

    return given.groupBy("symbol").applyInArrow(finish, T.StructType([*given.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]))
