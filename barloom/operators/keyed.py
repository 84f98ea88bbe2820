"""Idempotent keyed merges, reads that keep the newest version, and fallback between sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order`` (descending, nulls last); give a total order for stable results."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All keys of both sides; an incoming row replaces an existing one, of several incoming rows the newest counts.

    Running it twice with the same rows changes nothing.
    """
    both = existing.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return newest(both, keys, ["_side", *order]).drop("_side")


def upsert_preserving(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """Merge that takes ``update`` columns from incoming rows and keeps all others of rows that exist."""
    old, new = existing.alias("o"), incoming.alias("n")
    cond = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    joined = old.withColumn("_o", F.lit(1)).alias("o").join(new.withColumn("_n", F.lit(1)).alias("n"), cond, "full_outer")
    cols = []
    for c in existing.columns:
        if c in keys:
            cols.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
        elif c in update:
            cols.append(F.when(F.col("_n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.col(f"o.{c}").alias(c) if c not in incoming.columns else F.when(F.col("_o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return joined.select(*cols)


def fallback_merge(primary: DataFrame, secondary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``primary``, and rows of ``secondary`` for keys that the primary has not."""
    return primary.unionByName(secondary.join(primary.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def write_training_panel(df: DataFrame, path: str, by: Sequence[str] = ("year",)) -> None:
    """Parquet sink that replaces only the partitions ``df`` touches."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
