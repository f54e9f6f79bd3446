"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A key is hot from so many rows on, and from this share of all rows; so there are 10,000 hot keys at most.
HOT_ROWS, HOT_SHARE = 100, 1 / 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a session on one machine; on a cluster each machine would see its
    own, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or _own_dir()).rstrip("/")


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more; others are left alone."""
    for table in tables:
        spark = table.sparkSession
        folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        own = shared_dir(spark).split(":", 1)[-1].strip("/")
        for folder in folders:
            if folder.split(":", 1)[-1].strip("/").startswith(f"{own}/"):
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hot_from(rows: int) -> int:
    """The rows of a key from which on it is hot, of so many rows in all."""
    return max(HOT_ROWS, int(rows * HOT_SHARE))


def join_by_heat(rows: DataFrame, keyed: DataFrame, key: str, heat: str, hot: int) -> DataFrame:
    """rows joined to keyed on key; keyed has one row for each key, and in column heat how many of rows have it.

    Keys beyond `hot` rows are broadcast, so their rows stay where they are; with hot_from() there are 10,000 of
    them at most. The rows of all other keys meet theirs by shuffle, and none of those is large.
    """
    broad = F.broadcast(keyed.where(F.col(heat) > hot).drop(heat))
    calm = rows.join(F.broadcast(broad.select(key)), key, "left_anti").join(keyed.where(F.col(heat) <= hot).drop(heat), key)
    return rows.join(broad, key).unionByName(calm)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: a lambda variable, which the optimizer never inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pack(df: DataFrame) -> DataFrame:
    """df as one struct column _row, so that added columns can't clash with its own."""
    return df.select(F.struct("*").alias("_row"))


def unpack(df: DataFrame, names: list[str], **added: Column) -> DataFrame:
    """The columns of _row, with the added ones behind; an added one replaces one of the same name."""
    kept = [F.col("_row").getField(c).alias(c) for c in names if c.lower() not in {a.lower() for a in added}]
    return df.select(*kept, *(v.alias(k) for k, v in added.items()))
