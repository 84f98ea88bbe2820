"""Exact duplicates, with DataFrame functions only.

Three combining steps, each of which groups by the whole normalised text beside
its digest, so that two texts meet only if they are equal byte for byte:

1. *local*: Spark's partial aggregate folds equal texts inside each task;
2. *salted*: the survivors of a digest meet within one of ``salts`` shards, so a
   text that fills a third of the corpus is folded by many tasks;
3. *global*: the at most ``salts`` shard winners of a text are combined.

Every row then finds its winner by (digest, salt): a hot text's rows stay spread
over ``salts`` keys, those without an id over the input's partitions.  Two texts
with one SHA-256 digest are taken to be impossible in that last join; with
another digest it is asked whether two texts share one, and if so the join takes
the text into its key as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lower_az, table

SALTS = 32


def exact_dedup(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    normalise=lower_az,
    digest=None,
    salts: int = SALTS,
) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Null text counts as empty.  Of equal texts the row with the largest id
    stays; null ids lose to any id.  Rows that tie on id and text (repeated rows)
    are all counted and all marked kept; ``one_of_each`` leaves one of them.
    Other columns pass through; a column named like a new one is replaced.  An
    empty table gives an empty one.  ``digest`` stands in for SHA-256 as the key.
    """
    if not 1 <= salts <= 61:
        raise ValueError("salts must be from 1 to 61")
    new = ["keep_id", "group_size", "kept", "text_sha256"]
    d, t, s, i, n, mask = fresh([*docs.columns, *new], "digest", "norm", "salt", "id", "n", "mask")
    norm = normalise(F.coalesce(F.col(text), F.lit("")))
    key = F.sha2(norm, 256) if digest is None else digest(norm)
    # rows without an id have the salt after all others; for the way back it is dealt out by partition
    salt = F.when(F.col(doc_id).isNull(), F.lit(salts)).otherwise(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(salts))).cast("int")
    back = F.when(F.col(doc_id).isNull(), salts + F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(salt).cast("int")
    rows = docs.select(key.alias(d), norm.alias(t), salt.alias(s), F.col(doc_id).alias(i))
    sharded = rows.groupBy(d, t, s).agg(F.max(i).alias(i), F.count(F.lit(1)).alias(n))
    winners = sharded.groupBy(d, t).agg(F.max(i).alias("keep_id"), F.sum(n).alias("group_size"), F.expr(f"bit_or(shiftleft(1L, {s}))").alias(mask))
    clash = digest is not None and _has_clash(docs, norm, key)
    keep = [d, t] if clash else [d]
    shards = winners.select(
        *keep, "keep_id", "group_size",
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(2 * salts - 1)), lambda x: F.getbit(F.col(mask), F.least(x, F.lit(salts))) == 1)).alias(s),
    )
    given = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    left = docs.select(*given, key.alias(d), back.alias(s), *([norm.alias(t)] if clash or digest is not None else []))
    out = left.join(shards.hint("shuffle_hash"), [*keep, s])
    kept = F.coalesce(F.col(doc_id) == F.col("keep_id"), F.col("keep_id").isNull())
    sha = F.col(d) if digest is None else F.sha2(F.col(t), 256)
    return out.select(*given, "keep_id", "group_size", kept.alias("kept"), sha.alias("text_sha256"))


def _has_clash(docs: DataFrame, norm: Column, key: Column) -> bool:
    """Whether a digest gives two texts one value."""
    seen = docs.select(key.alias("d"), F.sha2(norm, 256).alias("x")).groupBy("d").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return not seen.filter("a <> b").isEmpty()


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with the columns of ``docs``; repeated rows that tie keep one copy.

    Rows of one id and text become one where they lie, before they are dealt
    out by id and digest; the winners come to them there, so a hot text's rows
    are spread by their ids and the rows travel once.  Texts that only rows
    without an id have are left to a branch of their own, which is planned if
    there are such rows.
    """
    given = [F.col(f"`{c}`") for c in docs.columns]
    d, t, s, i, own = fresh(docs.columns, "digest", "norm", "salt", "id", "own")
    norm = lower_az(F.coalesce(F.col(text), F.lit("")))
    whole = docs.select(*given, F.sha2(norm, 256).alias(d))
    some = whole.filter(F.col(doc_id).isNotNull())
    salt = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(salts)).cast("int")
    keys = docs.filter(F.col(doc_id).isNotNull()).select(F.sha2(norm, 256).alias(own), norm.alias(t), salt.alias(s), F.col(doc_id).alias(i))
    best = keys.groupBy(own, t, s).agg(F.max(i).alias(i)).groupBy(own, t).agg(F.max(i).alias(i)).select(own, i)
    out = some.dropDuplicates([doc_id, d]).join(best.hint("shuffle_hash"), (F.col(doc_id) == F.col(i)) & (F.col(d) == F.col(own))).select(*given)
    none = whole.filter(F.col(doc_id).isNull())
    if none.isEmpty():
        return out
    lone = none.withColumn(t, norm).dropDuplicates([d, t]).join(some.select(d).distinct().hint("shuffle_hash"), d, "left_anti")
    return out.unionByName(lone.select(*given))


def op2_exact_dedup(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, coalesce(n.doc_id = g.keep_id, g.keep_id IS NULL) AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
