"""Sections of handbook pages that are read again only where a page has changed (SRC-7).

The store is a published table in parts by the hash of the address. A page is unchanged if its etag is that on record,
or else if its content is. Only changed pages are cut into sections, and only the parts that hold one are written.

Defined results: a page without etag is told by its content; null content is an empty page. A page that isn't offered
stays as it is on record. Of an address that is offered twice, the row with the greatest content counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence
from .staging import staged
from .versions import Published

SCHEMA = "teil int, url string, etag string, hash string, abschnitte array<struct<titel:string,text:string>>"
PARTS = 64


def open_store(spark: SparkSession, path: str) -> Published:
    return Published(spark, path, SCHEMA, by="teil")


def changed(pages: DataFrame, store: Published) -> DataFrame:
    """(url, etag, html, hash) of pages (url, etag, html) that the store doesn't have as they are."""
    html = F.coalesce("html", F.lit(""))
    once = pages.where("url is not null").select("url", "etag", html.alias("html"), F.sha2(html, 256).alias("hash")).groupBy("url").agg(F.max(F.struct("html", "etag", "hash")).alias("x")).select("url", "x.*")
    known = store.read().select("url", F.col("etag").alias("_etag"), F.col("hash").alias("_hash"))
    same = F.coalesce(F.col("etag") == F.col("_etag"), F.lit(False)) | (F.col("hash") == F.col("_hash"))
    return once.join(known, "url", "left").where(F.col("_hash").isNull() | ~same).select("url", "etag", "html", "hash")


def refresh(pages: DataFrame, store: Published, parts: int = PARTS) -> int:
    """Bring the store up to date with pages (url, etag, html); gives the number of parts that were written.

    What changed is staged once: it decides which parts are touched, and is cut into sections then.
    """
    part = F.pmod(F.xxhash64("url"), F.lit(parts)).cast("int")
    new = staged(changed(pages, store).withColumn("teil", part), "changed-pages")
    touched = new.select("teil").distinct()
    n = touched.count()  # as many as the store has parts, at most
    if n:
        cut = evidence.sections(new.select("teil", "url", "etag", "hash", "html")).drop("html")
        kept = store.read().join(touched, "teil", "left_semi").join(new.select("url"), "url", "left_anti")
        names = store.schema.names
        store.publish(kept.select(*names).unionByName(cut.select(*names)))
    return n
