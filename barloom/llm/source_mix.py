"""Mixing sources to target weights by Pfair scheduling.

A source's rows form blocks of ``block_rows``.  With a share w of all slots its
block k may be released at slot floor(k / w) and is due by ceil((k + 1) / w);
giving each slot to the released block that is due earliest keeps every source
within one block of its share at every moment, however long the schedule.  The
shares are exact fractions and do not add up to whole numbers in any period, so
the schedule is one chain of steps, one for each block.  A task makes it, holding
two numbers a source, and writes it out as a table as it goes; neither it nor the
driver holds the whole.  The rows find their slots by a join on their block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, table, written

SLOTS = 1024
BLOCK_ROWS = 64
#: So many sources, or blocks of the schedule, are broadcast at most; more are joined by a shuffle.
MOST_SENT = 1 << 20
BUCKET_ROWS = 2_000


def _checked(weights: list[float]) -> None:
    if weights and (min(weights) <= 0 or not all(map(math.isfinite, weights))):
        raise ValueError("weights must be positive and finite")


def quotas(weights: list[float], slots: int = SLOTS) -> list[int]:
    """Whole shares of ``slots`` by largest remainder, at least 1 each."""
    if not weights:
        return []
    if len(weights) > slots:
        raise ValueError(f"{len(weights)} sources need at least as many slots, not {slots}")
    _checked(weights)
    spare, total = slots - len(weights), sum(weights)
    exact = [spare * w / total for w in weights]
    out = [1 + math.floor(x) for x in exact]
    for i in sorted(range(len(weights)), key=lambda i: (math.floor(exact[i]) - exact[i], i))[: slots - sum(out)]:
        out[i] += 1
    return out


def steps(weights: list[float], blocks: list[int]) -> Iterator[tuple[int, int, int]]:
    """(source, its block, slot) of all ``blocks`` of each source, in order of slot, earliest deadline first among released ones.

    Of blocks due at the same slot that of the source first in the list goes first.
    """
    _checked(weights)
    exact = [Fraction(w) for w in weights]
    unit = math.lcm(*(x.denominator for x in exact))
    share = [int(x * unit) for x in exact]
    total, slot = sum(share), 0
    ready, future = [], [(0, s, 0) for s, b in enumerate(blocks) if b]
    while ready or future:
        if not ready and future[0][0] > slot:
            slot = future[0][0]  # slots of sources that have run out stay empty
        while future and future[0][0] <= slot:
            _, s, k = heapq.heappop(future)
            heapq.heappush(ready, (-(-(k + 1) * total // share[s]), s, k))
        due, s, k = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        yield s, k, slot
        if k + 1 < blocks[s]:
            heapq.heappush(future, ((k + 1) * total // share[s], s, k + 1))
        slot += 1


def period(shares: list[int], slots: int = SLOTS) -> list[tuple[int, int, int]]:
    """(source, its block, slot) of the ``slots`` slots of whole shares."""
    if sum(shares) != slots:
        raise ValueError("shares must sum to the slots")
    return list(steps(shares, shares))


def schedule(spark: SparkSession, weights: list[float], blocks: list[int], names: tuple[str, str, str]) -> DataFrame:
    """The steps as a written table of (source, its block, slot): made by a task in batches, as many rows as there are blocks."""
    _checked(weights)

    def run(_):
        left = steps(weights, blocks)
        while part := list(islice(left, 1 << 16)):
            s, k, slot = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(k, pa.int64()), pa.array(slot, pa.int64())], list(names))

    made = spark.range(1, numPartitions=1).mapInArrow(run, f"{names[0]} int, {names[1]} long, {names[2]} long")
    return written(made, "mix-schedule")


def mix_sources(
    docs: DataFrame,
    *,
    source: str = "source",
    order: str = "doc_id",
    weights: dict | None = None,
    temperature: float = 0.5,
    slots: int = SLOTS,
    block_rows: int = BLOCK_ROWS,
    bucket_rows: int = BUCKET_ROWS,
    seed: int = 17,
) -> DataFrame:
    """``docs`` with ``mix_slot``, ``mix_rank`` (place within the slot's block), ``mix_block`` and ``mix_quota``.

    Every row is placed exactly once; reading by (mix_slot, mix_rank) gives the
    mixture.  ``block_rows`` is the same however many rows there are.  ``weights`` maps sources to target weights; without it a weight is
    the source's row count to the power ``temperature``.  A null source is a
    source of its own; one missing from ``weights`` is an error.  While all
    sources still have blocks, each one's blocks among the first t slots differ
    from its share of t by less than one; ``mix_quota`` is the exact share of
    ``slots`` slots.  Slots of a source that has run out may stay empty.
    Rows of a source are shuffled by a seeded hash of ``order`` and all columns,
    so that rows without an id, or with one id, are spread like others; equal
    rows are interchangeable.  Other columns, maps too, pass
    through; one named like a new one is replaced.
    """
    spark = docs.sparkSession
    new = ["mix_slot", "mix_rank", "mix_block", "mix_quota"]
    given = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    counts = docs.groupBy(F.col(source).alias("s")).agg(F.count("*").alias("n")).collect()
    counts.sort(key=lambda r: (r.s is None, r.s))
    goal = [float(weights[r.s]) if weights is not None else r.n**temperature for r in counts]
    total = math.fsum(goal)
    blocks = [-(-r.n // block_rows) for r in counts]

    name, src, h, every, bucket, rank, start, n = fresh([*docs.columns, *new], "name", "src", "h", "all", "bucket", "rank", "start", "n")
    kind = docs.schema[source].dataType.simpleString()
    # a source's buckets hold about ``bucket_rows`` rows each, so tasks are alike whatever the sources
    named = spark.createDataFrame([(r.s, i, max(1, r.n // bucket_rows), slots * w / total) for i, (r, w) in enumerate(zip(counts, goal, strict=True))], f"{name} {kind}, {src} int, {n} long, mix_quota double")
    named = named.hint("broadcast" if len(counts) <= MOST_SENT else "shuffle_hash")
    slot_of = schedule(spark, goal, blocks, (src, "mix_block", "mix_slot"))

    def hashable(f):
        text = f.dataType.simpleString()
        return F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in text or "variant" in text else F.col(f"`{f.name}`")

    def dealt(rows):
        """Rows with their source's number and their bucket."""
        out = rows.withColumn(h, F.xxhash64(F.lit(seed), F.col(order), F.col(every))).join(named, F.col(source).eqNullSafe(F.col(name)))
        return out.withColumn(bucket, F.pmod(F.shiftright(h, 16), F.col(n))).drop(name)

    whole = docs.select(*given, F.xxhash64(*map(hashable, docs.schema.fields)).alias(every))
    sizes = dealt(whole.select(source, *([order] if order != source else []), every)).groupBy(src, bucket).agg(F.count("*").alias(n))
    before = Window.partitionBy(src).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(src, bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(src, bucket).orderBy(h, order, every)
    ranked = dealt(whole).withColumn(rank, F.row_number().over(within) - 1).join(starts.hint("shuffle_hash"), [src, bucket])
    place = F.col(start) + F.col(rank)
    placed = ranked.withColumns({"mix_block": F.floor(place / F.lit(block_rows)).cast("long"), "mix_rank": F.pmod(place, F.lit(block_rows)).cast("long")})
    return placed.join(slot_of.hint("broadcast" if sum(blocks) <= MOST_SENT else "shuffle_hash"), [src, "mix_block"]).select(*given, *new)


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in order of the mixture, with the columns of ``docs``."""
    mixed = mix_sources(docs, **options)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(n, "mix_slot", "mix_rank").sortWithinPartitions("mix_slot", "mix_rank").select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_source_mix(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs)
