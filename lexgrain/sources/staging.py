"""Tables between steps, written once and read several times."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_dir() -> str:
    """Used on one machine only, as in tests."""
    return tempfile.mkdtemp(prefix="spark-")


def new_path(spark: SparkSession, label: str) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a session on one machine; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(found or _own_dir()).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """df written to a new folder and read back: the plan is cut there."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
