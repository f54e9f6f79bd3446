"""Search over documents read as norms (SRCH-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search
from ..sources.staging import new_path
from .registry import query, spread, table

_WORDS = r"SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents"
_POSTINGS = f"SELECT doc_id, lang, unnest(ws) AS wort, generate_subscripts(ws, 1) - 1 AS pos FROM ({_WORDS})"
_HITS = f"""WITH p AS ({_POSTINGS}), q AS (SELECT doc_id AS q_id, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS wort, len(a) AS n FROM (SELECT doc_id, ws[3:5] AS a FROM ({_WORDS}) WHERE doc_id % 20 = 0))
  SELECT q_id, lang AS abk, p.doc_id::VARCHAR AS norm_id, p.pos - i AS pos, n FROM q JOIN p USING (wort) GROUP BY ALL HAVING count(*) = n"""


def _norms(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id").select(F.col("lang").alias("abk"), F.col("doc_id").cast("string").alias("norm_id"), "text")


def _asked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The third to fifth word of every twentieth document as phrases, and the index of all documents in which they are sought."""
    asked = table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("q_id"), F.array_join(F.slice(search.words(F.col("text")), 3, 3), " ").alias("anfrage"))
    return asked, search.build_index(_norms(spark, sf_dir), new_path(spark, "index"))


@query(f"SELECT q_id, abk, norm_id, pos, n FROM ({_HITS})")
def srch01_phrases(spark, sf_dir):
    """Every place of every phrase."""
    return search.phrase_hits(*_asked(spark, sf_dir)).select("q_id", "abk", "norm_id", F.col("pos").cast("long").alias("pos"), F.col("n").cast("long").alias("n"))


@query(f"SELECT q_id, abk, count(*) AS treffer, count(DISTINCT norm_id) AS normen FROM ({_HITS}) GROUP BY 1, 2")
def srch01_counts(spark, sf_dir):
    """Hits of every phrase by language."""
    return search.phrase_counts(*_asked(spark, sf_dir))


_ASKED = "CASE o_orderkey % 5 WHEN 0 THEN o_orderkey % 30 || ' ' || lower(n_name) WHEN 1 THEN '§ ' || o_orderkey % 30 || 'a  ' || n_name WHEN 2 THEN lower(n_name) || ' ' || o_orderkey % 30 WHEN 3 THEN n_name || ' § ' || o_orderkey % 30 ELSE 'nach ' || n_name || ' ' || o_orderkey % 30 END"
_FROM = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name NOT LIKE '% %'"


@query(
    f"""SELECT q_id, abk, norm_id FROM (SELECT o_orderkey AS q_id, n_name AS abk, CASE o_orderkey % 5 WHEN 1 THEN o_orderkey % 30 || 'a' ELSE o_orderkey % 30 || '' END AS norm_id, o_orderkey % 5 AS art FROM {_FROM}) q
    WHERE art <> 4 AND norm_id IN (SELECT CASE c_custkey % 2 WHEN 0 THEN c_custkey % 40 || '' ELSE c_custkey % 40 || 'a' END FROM customer c2 JOIN nation n2 ON c2.c_nationkey = n2.n_nationkey WHERE n2.n_name = q.abk)"""
)
def srch01_addresses(spark, sf_dir):
    """Orders asking for norms by number and statute, in four forms; a fifth is no address."""
    for name in ("orders", "customer", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"srch_{name}")
    asked = spark.sql(f"SELECT o_orderkey AS q_id, {_ASKED} AS anfrage FROM " + _FROM.replace("orders", "srch_orders orders").replace("JOIN customer", "JOIN srch_customer").replace("JOIN nation", "JOIN srch_nation"))
    norms = spark.sql("SELECT DISTINCT n_name AS abk, CASE c_custkey % 2 WHEN 0 THEN c_custkey % 40 || '' ELSE c_custkey % 40 || 'a' END AS norm_id FROM srch_customer JOIN srch_nation ON c_nationkey = n_nationkey")
    return search.addressed(asked, norms)
