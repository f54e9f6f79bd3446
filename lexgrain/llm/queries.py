"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, licenses, line_dedup, line_dedup_sql, mixing, quality, quality_sql, shards, simhash, spelling, token_counts, toxicity, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item that a document holds, with the edits and the place in the document's plain form."""
    found = decontaminate.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "edits", F.col("start").alias("plain_start"), F.col("end").alias("plain_end"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document (-1: the whole), crossing tokens going to the line of their first byte."""
    found = token_counts.token_counts(_table(spark, sf_dir, "documents"), rule="first")
    return found.select(F.col("id").alias("doc_id"), "section", F.col("start").alias("char_start"), F.col("end").alias("char_end"), F.col("tokens").cast("long").alias("n_tokens"), F.col("crossing").alias("n_crossing"))


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes."""
    dealt = shards.shard(_table(spark, sf_dir, "documents"), n_shards=16)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return dealt.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place of a license template in a document, with the matched coverage and the span."""
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "license", "matched", "words", "coverage", F.col("start").alias("char_start"), F.col("end").alias("char_end"))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back: its payload's size and digest, and what it refers to."""
    read = warc.round_trip(_table(spark, sf_dir, "pages"))
    size = F.coalesce(F.octet_length("payload").cast("long"), F.col("stated_bytes"))
    digest = F.coalesce(F.sha2("payload", 256), F.regexp_replace("digest", "^sha256:", ""))
    return read.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", "problem")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts, sources weighing the root of their rows, in a global random order."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), power=0.5, seed=17)
    return mixed.select("doc_id", "source", "rate", "copies", "copy", "shuffle_key", F.coalesce(F.octet_length("text"), F.lit(0)).alias("text_bytes"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from the labels outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    weights, bias = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, weights, bias).select("doc_id", "held_out", "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of every document, and whether its histograms are near a language reference."""
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 4-word shingles, 64 bits, links at 4 differing bits or fewer."""
    groups = simhash.near_duplicate_groups(_table(spark, sf_dir, "documents"), width=4, bits=64, radius=4)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("rep_id").alias("component_id"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 leading whitened components of every usable embedding; deviation is null only where a long can't hold it."""
    white = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=32, scale=64, offset=1_000_000)
    deviation = whitening.as_long(F.col("deviation"))
    return white.select(F.col("id").alias("vec_id"), "component", "n", deviation.alias("deviation"), "whitened", "explained", "identity_error")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus, some of its runs a letter short, with its form, root and number of near words."""
    words = spelling.count_words(_table(spark, sf_dir, "documents"), min_length=5, min_count=3, change=spelling.drop_a_letter)
    return spelling.variant_groups(words, times=2)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more share."""
    cut = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), min_docs=10)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_benchmark_decontamination, op2_token_counts, op3_histogram_shards, op4_license_scan, op5_html_main_text, op6_warc_round_trip, op7_source_mixing, op8_toxicity, op9_quality_rules, op10_simhash_near_dedup,
        op11_embedding_whitening, op12_spelling_variants, op13_line_dedup,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op9_quality_rules": quality_sql.QUALITY_SQL, "op13_line_dedup": line_dedup_sql.LINES_SQL}
