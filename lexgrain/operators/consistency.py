"""Phrases that are labelled inconsistently across a corpus (AG-1, AG-2, ST-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import phrase_key, settled

COUNTED = ("tb", "rf", "ausn")


def with_keys(spans: DataFrame) -> DataFrame:
    """spans (text, art, seq, ...) that have a comparable phrase, with its key."""
    return settled(spans.withColumn("schluessel", phrase_key(F.col("text"))), "schluessel").where("schluessel is not null")


def phrase_table(keyed: DataFrame) -> DataFrame:
    """AG-1: for each phrase its counts by kind (sonst: kinds that aren't counted), the least confidence of each kind, and its first example.

    seq orders the document: a number or a struct such as (document, line, clause). All is pre-aggregated before the one
    shuffle, and no list of places is gathered, so a phrase of very many places is one row from each task.
    """
    of = {a: F.col("art") == a for a in COUNTED} | {"sonst": ~F.col("art").isin(*COUNTED)}
    counts = [F.count_if(test).alias(a) for a, test in of.items()]
    least = [F.min(F.when(test, F.col("konfidenz"))).alias(f"min_{a}") for a, test in of.items()]
    return keyed.groupBy("schluessel").agg(*counts, *least, F.min_by("text", "seq").alias("wendung"))


def phrase_counts(keyed: DataFrame) -> DataFrame:
    """AG-1: what phrase_table() has, but for other kinds and confidences."""
    return phrase_table(keyed).select("schluessel", *COUNTED, "wendung")


def _total() -> Column:
    return F.col("tb") + F.col("rf") + F.col("ausn")


def _most() -> Column:
    return F.greatest("tb", "rf", "ausn")


def is_finding(least: int = 4, share: float = 0.8) -> Column:
    """AG-2 over phrase_table(): a majority of at least that share that isn't unanimous, among least spans or more."""
    return (_total() >= least) & (_most() < _total()) & (_most() / _total() >= share)


def n_outliers() -> Column:
    """Spans of a phrase that aren't of its majority, other kinds included."""
    return _total() - _most() + F.col("sonst")


def findings(counts: DataFrame, least: int = 4, share: float = 0.8) -> DataFrame:
    """AG-2: phrases with a majority of at least that share that isn't unanimous. Ties go to the earlier of tb, rf, ausn.

    Only the counted kinds make up the total; spans of other kinds still show up as outliers.
    """
    majority = F.when(F.col("tb") == _most(), "tb").when(F.col("rf") == _most(), "rf").otherwise("ausn")
    return counts.withColumn("gesamt", _total()).where(is_finding(least, share)).withColumn("mehrheit", majority)


def outliers(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """The spans of a finding that aren't of its majority; findings are few, so Spark may broadcast them at run time."""
    return keyed.join(found.select("schluessel", "mehrheit"), "schluessel").where("art <> mehrheit")


def report(spans: DataFrame, least: int = 4, share: float = 0.8) -> DataFrame:
    """One row for each finding, with the number of its outliers and their least confidence; ordered as in the report.

    One pass over the spans and one shuffle, of a row a phrase from each task.
    """
    found = findings(phrase_table(with_keys(spans)), least, share)
    weakest = F.least(*[F.when(F.col("mehrheit") != a, F.col(f"min_{a}")) for a in (*COUNTED, "sonst")])
    rows = found.select("schluessel", *COUNTED, "wendung", "gesamt", "mehrheit", n_outliers().alias("ausreisser"), weakest.alias("min_konfidenz"))
    return rows.orderBy(F.desc("ausreisser"), F.collate("wendung", "de"), "schluessel")
