"""Incremental annotation of a stream of norms by content hash. The batch semantics are those of the reuse predicate;
the streaming form is an extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def changed(norms: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("abk", "norm_id")) -> DataFrame:
    """Norms whose text_hash isn't known yet: an anti-join on key and hash."""
    return norms.join(known.select(*keys, "text_hash").distinct(), [*keys, "text_hash"], "left_anti")


def annotate_stream(norms: DataFrame, known_path: str, checkpoint: str, annotate: Callable[[DataFrame], DataFrame], schema: str) -> StreamingQuery:
    """Annotate what is new or changed and append it to the table at known_path; ends when the input is read.

    norms: a stream of (abk, norm_id, text_hash, ...); annotate gives rows that hold at least these three. A batch that is
    run again finds its own rows in the table and adds none.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        known = batch.sparkSession.read.schema(schema).parquet(known_path)
        fresh = changed(batch.dropDuplicates(["abk", "norm_id", "text_hash"]), known)
        annotate(fresh).write.mode("append").parquet(known_path)

    return norms.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_schema(rows: DataFrame, keys: list[str]) -> StructType:
    return StructType([rows.schema[k] for k in keys]).add("ms", "long").add("frisch", "boolean")


def keep_fresh(rows: DataFrame, path: str, checkpoint: str, keys: list[str], date: str, days: int) -> StreamingQuery:
    """FLT-3 over a stream (an extension): a row (keys, ms, frisch) whenever a key becomes fresh or stale, appended as a log to the table at path.

    All input at hand is read; the next run goes on from there. What is kept from batch to batch is a table of a row a key
    with its newest date, and who is stale by the newest date of all leaves it with the next batch; a batch is grouped by key
    natively. Two folders take turns, and each batch has its own part of the log, so one that is run again writes the same.
    Dates count in milliseconds. A row without a date is never fresh; null keys are a key of their own. No key may be called
    ms, frisch, lauf, alt or _neueste.
    """
    kept = StructType([rows.schema[k] for k in keys]).add("ms", "long").add("alt", "long")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        here, before = (f"{checkpoint}/newest/{n % 2}" for n in (batch_id, batch_id - 1))

        def with_newest(path: str) -> DataFrame:
            state = spark.read.schema(kept).parquet(path)
            return state.crossJoin(F.broadcast(state.agg((F.max("ms") - days * 86_400_000).alias("_neueste"))))

        fresh = F.col("ms") > F.col("_neueste")
        dates = batch.select(*keys, "ms", F.lit(None).cast("long").alias("alt"))
        if batch_id:
            dates = dates.unionByName(with_newest(before).where(fresh).select(*keys, "ms", F.col("ms").alias("alt")))
        dates.groupBy(*keys).agg(F.max("ms").alias("ms"), F.max("alt").alias("alt")).write.mode("overwrite").parquet(here)
        told = F.when(fresh, F.col("alt").isNull() | (F.col("ms") > F.col("alt"))).otherwise(F.col("alt").isNotNull())
        with_newest(here).where(told).select(*keys, "ms", fresh.alias("frisch")).write.mode("overwrite").parquet(f"{path}/lauf={batch_id}")

    dated = rows.select(*keys, F.unix_millis(F.col(date).cast("timestamp")).alias("ms")).where("ms IS NOT NULL")
    return dated.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def still_fresh(log: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that are fresh by a log of keep_fresh(), with their newest date in milliseconds."""
    last = log.groupBy(*keys).agg(F.max(F.struct("ms", (~F.col("frisch")).alias("alt"))).alias("_l"))
    return last.where("NOT _l.alt").select(*keys, "_l.ms")
