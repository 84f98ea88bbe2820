"""The folder that the driver and all executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in ``spark.checkpoint.dir``; in a local session without one, in a temporary folder of the machine.

    All paths of an application are in one folder with its id: results may read
    them as long as it runs, afterwards the folder can go.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='barloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: what follows is planned from there."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_of(df: DataFrame, rows: int = 200_000) -> int:
    """How many tasks of about so many rows ``df`` makes, the session's shuffle partitions at least.  The rows are counted, so it should be a table that was written."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def by_rows(df: DataFrame, *keys: str, rows: int = 200_000) -> DataFrame:
    """``df``, a table that was written, dealt out by ``keys`` to tasks of about so many rows: a larger table has more tasks, not larger ones."""
    return df.repartition(parts_of(df, rows), *keys)
