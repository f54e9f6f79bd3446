"""Order-dependent table operators: windows, keyed unions, priorities and selections (WN-*, SET-*, JN-5, JN-6, JN-12, FLT-*)."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.text import short_key


def forward_fill(rows: DataFrame, column: str, by: list[str], order: list[str]) -> DataFrame:
    """WN-1: nulls and empty texts take the last value before them, within a group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(F.nullif(F.col(column), F.lit("")), ignorenulls=True).over(w))


def sessions(rows: DataFrame, starts: Column, by: list[str], order: list[str], name: str = "sitzung") -> DataFrame:
    """WN-2: rows numbered by the boundaries at or before them, from 0 before the first."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(starts.cast("int")).over(w))


def ordinals(rows: DataFrame, key: list[str], order: list[str], name: str = "n") -> DataFrame:
    """WN-3: 1, 2, ... for the rows of a key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def extents(rows: DataFrame, start: str, length: str, by: list[str]) -> DataFrame:
    """WN-5: each marker reaches to the next one, the last to the end."""
    return rows.withColumn("ende", F.coalesce(F.lead(start).over(Window.partitionBy(*by).orderBy(start)), F.col(length)))


def neighbours(rows: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """WN-7: previous and next value, null at the ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumns({"vorige": F.lag(value).over(w), "naechste": F.lead(value).over(w)})


def first_by_key(rows: DataFrame, key: list[str], values: list[str], order: str) -> DataFrame:
    """AG-11, SET-4: the values of the first row of each key. Aggregated before the shuffle, so hot keys stay cheap."""
    first = F.min_by(F.struct(*values), order).alias("_erste")
    return rows.groupBy(*key).agg(first).select(*key, *[F.col(f"_erste.{v}").alias(v) for v in values])


def longest_by_key(rows: DataFrame, key: list[str], text: str, order: str) -> DataFrame:
    """SET-2: the longest text of each key; the first on ties."""
    best = F.max_by(F.struct(text, order), F.struct(F.length(text), -F.col(order)))
    return rows.groupBy(*key).agg(best.alias("_beste")).select(*key, F.col(f"_beste.{text}").alias(text), F.col(f"_beste.{order}").alias(order))


def prefer(candidates: list[DataFrame], key: list[str]) -> DataFrame:
    """JN-5, JN-6: of several tables of one schema, the row of the first that has the key."""
    ranked = None
    for k, table in enumerate(candidates):
        table = table.withColumn("_rang", F.lit(k))
        ranked = table if ranked is None else ranked.unionByName(table)
    return ranked.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]).agg(F.min_by(F.struct(*ranked.columns), "_rang").alias("_x")).select("_x.*").drop("_rang")


def carry_over(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """JN-12: new rows, and the old rows of keys that weren't visited."""
    return new.unionByName(old.join(new.select(*key).distinct(), key, "left_anti"))


def select_by_name(rows: DataFrame, columns: list[str], wanted: list[str]) -> DataFrame:
    """FLT-1: rows of which one of the columns is wanted, spelling aside; all rows if nothing is named."""
    keys = [k for k in ("".join(ch for ch in w.lower().removesuffix(".json") if ch.isascii() and ch.isalnum()) for w in wanted) if k]
    if not keys:
        return rows
    test = F.lit(False)
    for c in columns:
        test = test | short_key(F.col(c)).isin(*keys)
    return rows.where(test)


def fresh(date: Column, now: Column, days: int) -> Column:
    """FLT-3: there is a date, and it is less than that many days ago."""
    return F.coalesce(F.timestamp_diff("SECOND", date, now) < days * 86_400, F.lit(False))


def within_budget(rows: DataFrame, wanted: Column, order: list[str], most: int, by: list[str] | None = None) -> DataFrame:
    """FLT-6, BUD-1: of the wanted rows the first `most`, in order; deterministic, as a plain limit isn't.

    Without by, the rows are sorted and the first taken by a distributed top-k, so no task sees all of them.
    """
    if by:
        return rows.where(wanted).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
    return rows.where(wanted).orderBy(*order).limit(most)


def reusable(annotation: DataFrame, format_wanted: int, models: list[str], runs: int, with_models: bool, upgrade: bool = False, cross_check: bool = True) -> DataFrame:
    """FLT-4: adds wiederverwendbar. annotation: (text_hash, neuer_hash, format, verfahren, laeufe, modelle, status, belegquote, beleg_da)."""
    method = F.coalesce("verfahren", F.lit(""))
    same = (F.col("text_hash") == F.col("neuer_hash")) & (F.col("format") == format_wanted)
    multi = F.contains(method, F.lit("mehrfachlauf"))
    good = F.lit(True)
    if with_models:
        if upgrade:
            good = multi & (F.coalesce("status", F.lit("")) != "uneinheitlich") & ~(F.col("beleg_da") & (F.coalesce("belegquote", F.lit(0.0)) == 0))
        good = good & multi & (F.coalesce("laeufe", F.lit(0)) >= runs)
        if cross_check:
            good = good & F.contains(method, F.lit("gegenprobe"))
        good = good & (F.size(F.array_except(F.lit(models), F.coalesce("modelle", F.array().cast("array<string>")))) == 0)
    return annotation.withColumn("wiederverwendbar", F.coalesce(same & good, F.lit(False)))


def bundles(rows: DataFrame, key: list[str], entry: str, width: int) -> DataFrame:
    """AG-14: (key, teil, eintraege, n): the entries of a key in order, in bundles of an entry range of that width."""
    return rows.groupBy(*key, F.floor(F.col(entry) / width).cast("long").alias("teil")).agg(F.sort_array(F.collect_list(entry)).alias("eintraege"), F.count("*").alias("n"))


#: Characters of items without a word to meet on that an automaton holds at a time.
BLOCK_CHARS = 2_000_000


def _held(items: list[tuple[int, str]]) -> Column:
    """A function of a text column: the numbers of the items that stand in it, by an automaton that reads a text once."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for number, text in items:
            automaton.add_word(text, number)
        automaton.make_automaton()
        for texts in batches:
            yield pd.Series([sorted({k for _, k in automaton.iter(t)}) if t else [] for t in texts], dtype=object)

    return find


def containment(texts: DataFrame, items: DataFrame, text_id: str, item_id: str) -> DataFrame:
    """(text_id, item_id): items (item_id, text) that stand in a text, case aside. Null and empty items stand in none.

    An item and a text meet on the item's rarest word, of those that stand within it, so that the text has them as
    words too. Items without such a word are a query set: an automaton of a bounded block of them reads all texts.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\P{L}+"), lambda w: F.length(w) >= 4))
    own = items.select(item_id, F.lower("text").alias("_b")).where("length(_b) > 0")
    own = own.withColumn("_ws", words(F.regexp_replace("_b", r"\A\p{L}+|\p{L}+\z", "")))
    rows = texts.select(text_id, F.lower("text").alias("_t"))
    spelled = rows.select(text_id, F.explode(words(F.col("_t"))).alias("_w"))
    inner = own.select(item_id, "_b", F.explode("_ws").alias("_w")).join(spelled.groupBy("_w").agg(F.count("*").alias("_n")), "_w", "left").fillna({"_n": 0})
    rare = inner.groupBy(item_id).agg(F.min_by(F.struct("_w", "_b"), F.struct("_n", "_w")).alias("_x")).select(item_id, "_x._w", "_x._b")
    found = rows.join(spelled.join(rare, "_w"), text_id).where(F.contains("_t", "_b")).select(text_id, item_id)
    weak = own.where(F.size("_ws") == 0).select(item_id, "_b").distinct()
    spelled_once = weak.select("_b").distinct()
    n_blocks = -(-(spelled_once.agg(F.sum(F.length("_b"))).first()[0] or 0) // BLOCK_CHARS)
    for k in range(n_blocks):
        block = sorted(r["_b"] for r in spelled_once.where(F.pmod(F.xxhash64("_b"), F.lit(n_blocks)) == k).collect())
        if block:
            numbers = items.sparkSession.createDataFrame(list(enumerate(block)), "_i int, _b string")
            owners = weak.join(F.broadcast(numbers), "_b").select("_i", item_id)  # as many characters as a block holds
            met = rows.select(text_id, F.explode(_held(list(enumerate(block)))(F.col("_t"))).alias("_i"))
            found = found.unionByName(met.join(owners, "_i").select(text_id, item_id))
    return found.distinct()
