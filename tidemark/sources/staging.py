"""Tables that are written once and read again: what several passes need is computed once, and lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task where rows are dealt by a key.
TASK_ROWS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where it is unset, a temporary one on a local master, whose executors are the driver; an error elsewhere.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; any executor may be lost afterwards.

    A join of two such tables reads both straight from its shuffles, so that adaptive execution can
    split a hot key's partition; it can't where one side is still aggregated in the same stage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """In how many tasks to deal rows, about ``rows`` in each, so that a task needs no more memory as the table grows.

    Such numbers hold: adaptive execution puts tasks together by their compressed bytes, of which few are many rows.
    """
    return max(1, -(-df.count() // rows))
