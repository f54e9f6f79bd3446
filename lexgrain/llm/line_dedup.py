"""Dropping of lines that many documents share, by levelled sorted runs of line hashes.

A run is a table of (h, n): the MD5 of a line's key and in how many documents it was seen, bucketed and sorted by h, so
runs are merged and joined bucket by bucket without a shuffle. Each batch of documents anti-joins the runs (a line that
one of them already has in enough documents is settled and isn't counted again) and adds a run of its own at level 0. A
level that reaches `fanout` runs is merged into one run of the next level. Only DataFrame functions are used.

A line's key is the line without white space at both ends, A-Z lower-cased; empty keys are never dropped.

Defined results: a null or empty text is one empty line. Each row is a document of its own, repeated rows too, whatever
its id (null as well). A text whose lines all go becomes empty. An empty table gives no rows. Columns of the input
stay, but for those that are added (n_lines, n_dropped).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, hot_from, join_by_heat, let, materialize, new_path, pack, unpack

# White space at the ends of a line, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes for id and text; equal rows share them, and their lines."""
    return F.unhex(F.md5(F.concat_ws(":", doc_id.isNull().cast("string"), doc_id.cast("string"), text.isNull().cast("string"), text)))


def line_table(docs: DataFrame, batches: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, pos, h, first, batch) of each line with a key; first: the key's first place in its document."""
    text, doc_id = F.col("_row").getField(text_col), F.col("_row").getField(id_col)
    hashed = F.transform(split_lines(F.translate(text, UPPER, LOWER)), lambda line: let(F.btrim(line, F.lit(SPACE)), lambda k: F.when(k != "", F.unhex(F.md5(k)))))
    placed = F.array_sort(F.filter(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("pos"))), lambda x: x["h"].isNotNull()))
    marked = let(placed, lambda a: F.transform(a, lambda x, i: F.struct(x["pos"].alias("pos"), x["h"].alias("h"), ((i == 0) | (F.get(a, i - 1)["h"] != x["h"])).alias("first"))))
    lines = pack(docs).select(row_key(doc_id, text).alias("row"), F.inline(marked))
    return lines.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int"))


class LineRuns:
    """The runs in a folder, level by level; they outlive the session, and a manifest written last names those that count."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = 10, fanout: int = 2, buckets: int | None = None):
        self.spark, self.path, self.min_docs, self.fanout = spark, path or new_path(spark, "line-runs"), min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.levels = 0, {}
        self._open()

    def _files(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _open(self) -> None:
        where, files = self._files()
        names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        done = [int(x.split("-")[1]) for x in names if x.startswith("manifest-") and files.exists(jpath(where, f"{x}/_SUCCESS"))]
        if done:
            self.version = max(done)
            for r in self.spark.read.schema("level int, seq int, name string, buckets int").json(f"{self.path}/manifest-{self.version}").orderBy("level", "seq").collect():
                self.buckets = r["buckets"]
                self.spark.sql(f"CREATE TABLE IF NOT EXISTS {r['name']} (h BINARY, n BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {r['buckets']} BUCKETS LOCATION '{self.path}/{r['name']}'")
                self.levels.setdefault(r["level"], []).append(r["name"])

    def _commit(self) -> None:
        self.version += 1
        rows = [(level, k, name, self.buckets) for level, names in self.levels.items() for k, name in enumerate(names)]
        self.spark.createDataFrame(rows, "level int, seq int, name string, buckets int").coalesce(1).write.json(f"{self.path}/manifest-{self.version}")

    def _write(self, counts: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        counts.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in sorted(self.levels) for name in self.levels[level]]

    def merged(self, names: list[str] | None = None) -> DataFrame:
        """(h, n) over runs, all by default: a merge join of sorted runs. Two of them need no shuffle."""
        tables = self.runs() if names is None else [self.spark.table(x) for x in names]
        added = (F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n")
        merge = lambda a, b: a.withColumnRenamed("n", "n_a").hint("merge").join(b.withColumnRenamed("n", "n_b"), "h", "full_outer").select("h", added)
        return reduce(merge, tables) if tables else self.spark.createDataFrame([], "h binary, n long")

    def add(self, lines: DataFrame) -> None:
        """A batch of line_table rows: anti-joined to the runs, added as a run, levels compacted."""
        counts = lines.where("first").groupBy("h").agg(F.count("*").alias("n"))
        for run in self.runs():
            counts = counts.join(run.where(F.col("n") >= self.min_docs).select("h"), "h", "left_anti")
        self.levels.setdefault(0, []).append(self._write(counts))
        gone, level = [], 0
        while len(self.levels.get(level, [])) >= self.fanout:
            gone += self.levels[level]
            merged = self._write(self.merged(self.levels[level]))
            self.levels[level] = []
            level += 1
            self.levels.setdefault(level, []).append(merged)
        self._commit()
        self._remove(gone)

    def compact(self) -> None:
        """All runs into one, at the highest level."""
        gone = [x for level in self.levels for x in self.levels[level]]
        if len(gone) > 1:
            self.levels = {max(self.levels): [self._write(self.merged())]}
            self._commit()
            self._remove(gone)

    def _remove(self, names: list[str]) -> None:
        for name in names:
            discard(self.spark.table(name))
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def frequent(self) -> DataFrame:
        """(h, n) of the lines in min_docs documents or more; a settled line's n may stop growing."""
        return self.merged().where(F.col("n") >= self.min_docs)


def drop_lines(docs: DataFrame, lines: DataFrame, frequent: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines whose hash is frequent; adds n_lines and n_dropped.

    lines is the line_table of docs. Lines of hot hashes meet theirs by broadcast, the rest by shuffle; a document's
    text moves once, to the places of its dropped lines, and is cut there in one pass.
    """
    heat = materialize(lines.groupBy("h").agg(F.count("*").alias("heat")).join(frequent.select("h"), "h", "left_semi"), "frequent-lines")
    met = join_by_heat(lines.select("row", "pos", "h"), heat, "h", "heat", hot_from(lines.count()))
    dropped = met.groupBy("row").agg(F.sort_array(F.collect_set("pos")).alias("_gone"))
    text, doc_id = F.col("_row").getField(text_col), F.col("_row").getField(id_col)
    joined = pack(docs).withColumn("row", row_key(doc_id, text)).join(dropped, "row", "left")
    gone, every = F.coalesce("_gone", F.array().cast("array<int>")), split_lines(text)

    def cut(all_lines: Column) -> Column:
        start = lambda i: F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
        end = lambda i: F.coalesce(F.get(gone, i), F.size(all_lines))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(all_lines, start(i) + 1, end(i) - start(i))))

    kept = let(every, lambda a: F.struct(F.array_join(cut(a), "\n").alias("text"), F.size(a).cast("long").alias("n_lines")))
    done = joined.select("_row", kept.alias("_kept"), F.size(gone).cast("long").alias("_dropped"))
    return unpack(done, docs.columns, **{text_col: F.col("_kept.text"), "n_lines": F.col("_kept.n_lines"), "n_dropped": F.col("_dropped")})


def dedup_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines that are in min_docs documents or more: batch after batch into the runs, then cut."""
    spark = docs.sparkSession
    path = new_path(spark, "lines")
    made = line_table(docs, batches, id_col, text_col)
    made.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(made.schema).parquet(path)
    runs = LineRuns(spark, min_docs=min_docs, fanout=fanout)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k))
    runs.compact()
    return drop_lines(docs, lines, runs.frequent(), id_col, text_col)


def admit(docs: DataFrame, runs: LineRuns, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The batch docs without the lines that `runs` has in min_docs documents before it; then adds the batch to runs.

    The result is cut before the batch is added, so it is written here and read back.
    """
    lines = materialize(line_table(docs, 1, id_col, text_col), "lines")
    cut = materialize(drop_lines(docs, lines, runs.frequent(), id_col, text_col), "admitted")
    runs.add(lines)
    discard(lines)
    return cut
