"""Published tables in immutable versions, and the partial state of a run that was cut short (SNK-2, SNK-3).

A publish writes a new version beside the others and then a new manifest, which names the version of each key (a
statute). Readers follow the newest manifest that is complete, so a publish that fails, or is still under way, leaves
the last good state as it is. A run keeps what it has done as parts, each valid once its writer has committed; the next
run takes them up and does only what is left.

Defined results: before the first publish the table is empty. A key that a publish doesn't hold keeps its version; null
is a key like any other. Two publishes at once: the later one fails, for its manifest is there already. A part that
was cut short isn't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DONE = "_SUCCESS"


class Folder:
    """A folder of any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str = ""):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, name: str = "") -> list[str]:
        where, files = self._at(name)
        return sorted(x.getPath().getName() for x in files.listStatus(where)) if files.exists(where) else []

    def complete(self, name: str) -> list[str]:
        """Folders below that a writer has committed."""
        return [x for x in self.names(name) if self.exists(f"{name}/{x}/{DONE}")]

    def exists(self, name: str) -> bool:
        where, files = self._at(name)
        return files.exists(where)

    def remove(self, name: str) -> None:
        where, files = self._at(name)
        files.delete(where, True)


class Published:
    """A table (schema in DDL) published by key at a path: data/version=v/, manifest/n/, partial/."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str = "abk"):
        self.spark, self.folder, self.by = spark, Folder(spark, path), by
        self.schema = spark.createDataFrame([], schema).schema
        self.entries = f"schluessel {self.schema[by].dataType.simpleString()}, version string"

    def _number(self) -> int:
        return max((int(x) for x in self.folder.complete("manifest")), default=0)

    def manifest(self) -> DataFrame:
        """(schluessel, version) of the newest complete manifest."""
        n = self._number()
        return self.spark.read.schema(self.entries).parquet(f"{self.folder.path}/manifest/{n}") if n else self.spark.createDataFrame([], self.entries)

    def read(self) -> DataFrame:
        """What is published now: of each key the version that the manifest names, other versions are never opened."""
        manifest = self.manifest()
        versions = [r["version"] for r in manifest.select("version").distinct().collect()]
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        each = []
        for v in versions:
            rows = self.spark.read.schema(self.schema).json(f"{self.folder.path}/data/version={v}").select(*self.schema.names)
            keys = manifest.where(F.col("version") == v).select("schluessel")
            each.append(rows.join(keys, rows[self.by].eqNullSafe(keys["schluessel"]), "left_semi"))
        return reduce(DataFrame.unionByName, each)

    def publish(self, table: DataFrame) -> None:
        """Replace the keys that table holds; nobody sees any of it before the manifest is there."""
        version, number = uuid.uuid4().hex, self._number()
        path = f"{self.folder.path}/data/version={version}"
        # the key stands in the files too: text read from a folder's name would lose its type
        table.select(*self.schema.names).withColumn("_key", F.col(self.by)).write.partitionBy("_key").option("ignoreNullFields", "false").json(path)
        new = self.spark.read.schema(self.schema).json(path).select(F.col(self.by).alias("schluessel")).distinct()
        old = self.manifest()
        kept = old.join(new.withColumnRenamed("schluessel", "_neu"), old["schluessel"].eqNullSafe(F.col("_neu")), "left_anti")
        self._commit(kept.unionByName(new.withColumn("version", F.lit(version))), number + 1)

    def _commit(self, entries: DataFrame, number: int) -> None:
        if self.folder.exists(f"manifest/{number}/{DONE}"):
            raise RuntimeError("another publish came first")
        self.folder.remove(f"manifest/{number}")  # what a writer without an end left there
        entries.write.mode("errorifexists").parquet(f"{self.folder.path}/manifest/{number}")

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the newest manifests, and the versions that none of those names."""
        numbers = sorted(int(x) for x in self.folder.complete("manifest"))
        used = set()
        for n in numbers[-keep:]:
            used |= {f"version={r['version']}" for r in self.spark.read.schema(self.entries).parquet(f"{self.folder.path}/manifest/{n}").select("version").distinct().collect()}
        for n in numbers[:-keep]:
            self.folder.remove(f"manifest/{n}")
        for name in self.folder.names("data"):
            if name not in used:
                self.folder.remove(f"data/{name}")

    def partial(self) -> DataFrame:
        """The parts of a run that hasn't been published."""
        parts = [f"{self.folder.path}/partial/{x}" for x in self.folder.complete("partial")]
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def add_part(self, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.parquet(f"{self.folder.path}/partial/{uuid.uuid4().hex}")

    def drop_partial(self) -> None:
        self.folder.remove("partial")


def run(norms: DataFrame, annotate: Callable[[DataFrame], DataFrame], store: Published, waves: int = 4, keys: tuple[str, ...] = ("norm_id",), budget: int | None = None, order: tuple[str, ...] = ()) -> bool:
    """SNK-2, SNK-3, BUD-1: annotate what is new or changed, wave by wave, and publish all of it when nothing is left.

    norms has the store's key, `keys` and text_hash, and so has what annotate gives. A norm is done if the partial state
    or the published one has it under the same hash; the partial state comes first. If a wave fails, those before it
    stay as parts, and what is published stays as it was. Norms that norms doesn't hold any more leave their statute.

    budget: at most so many norms are annotated, the first by order and then by key. What is over stays for the next
    run, with what is done as parts, and True is returned; so runs of a budget give what one run of their sum gives.
    """
    on = [store.by, *keys, "text_hash"]
    done = store.partial().select(*on).unionByName(store.read().select(*on)).distinct()
    left = norms.join(done, on, "left_anti")
    over = False
    if budget is not None:
        place = [*order, *(c for c in on if c not in order)]
        first = left.orderBy(*place).limit(budget + 1).select(*on).collect()  # a budget is what a run may ask of a provider
        over = len(first) > budget
        chosen = norms.sparkSession.createDataFrame(first[:budget], left.select(*on).schema)
        left = left.join(F.broadcast(chosen), on, "left_semi")
    wave = F.pmod(F.xxhash64(*on), F.lit(waves))
    for k in range(waves):
        store.add_part(annotate(left.where(wave == k)))
    if over:
        return True
    rank = store.partial().withColumn("_r", F.lit(0)).unionByName(store.read().withColumn("_r", F.lit(1)))
    best = rank.groupBy(*on).agg(F.min_by(F.struct(*store.schema.names), "_r").alias("_x")).select("_x.*")
    store.publish(best.join(norms.select(*on).distinct(), on, "left_semi"))
    store.drop_partial()
    return False


def publish_with_report(records: DataFrame, store: Published) -> dict[str, int]:
    """SNK-5: publish records (markierbar, abgelehnt, ...) and report on them, by metrics that the writing job observes.

    normen, markierbar and abgelehnt (an array or a number) are counted while the rows are written: nothing is computed twice.
    """
    kind = dict(records.dtypes)["abgelehnt"]
    rejected = F.size("abgelehnt") if kind.startswith("array") else F.col("abgelehnt")
    seen = Observation()
    totals = [F.count(F.lit(1)).alias("normen"), F.count_if("markierbar").alias("markierbar"), F.coalesce(F.sum(rejected), F.lit(0)).alias("abgelehnt")]
    store.publish(records.observe(seen, *totals))
    return dict(seen.get)
