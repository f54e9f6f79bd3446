"""Queries register themselves here, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: White space of ECMAScript in the dialect of the SQL engine.
S = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def query(sql: str | None = None, name: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by key where it has fewer files than there are cores; on large tables nothing is moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def trim(c: str) -> str:
    return f"regexp_replace({c}, '\\A{S}+|{S}+\\z', '', 'g')"


def squash(c: str) -> str:
    return f"regexp_replace({c}, '{S}+', ' ', 'g')"


def tidy(c: str) -> str:
    return f"regexp_replace({c}, '{S}+([,.:;!?])', '\\1', 'g')"


def span_text(c: str) -> str:
    return trim(f"regexp_replace(regexp_replace({tidy(squash(c))}, '\\A(?:{S}|[,;:])+', ''), '(?:{S}|[,;:.])+\\z', '')")


#: The lines of the documents, numbered from 0; empty ones are left out.
LINES = """
  SELECT doc_id, lang, source, seq - 1 AS seq, line FROM (
    SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS seq FROM documents
  ) WHERE line <> ''"""
