"""Groups of spelling variants: words one edit apart, found by a rare-first q-gram prefix filter.

One edit destroys at most two bigrams of a word. Bigrams are ordered by how many places of the word list have them,
rarest first (ties: by their text). Of two words one edit apart, take the one whose third-rarest bigram comes first: one
of its three rarest survives in the other, where it is among the three rarest too, if bigrams equal to the third count
in. So words need only meet on those. The edit is right of the surviving bigram or left of it: all on the other side
of the bigram, itself included, is equal, and of the part with the edit either the first half is equal or the second.
That is the join's key; it fixes the bigram's place from the start or from the end. What meets is verified.

Defined results: a null text has no words, a null id counts as empty text. Repeated rows count each. Ties of the form
go to the smallest word in code-point order. An empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize

# Letters of a word, and the letters that are lower-cased.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shorter words have too few bigrams for the filter.
SHORTEST = 4


def drop_a_letter(doc_id: Column, run: Column, one_in: int = 97) -> Column:
    """The run, or for one in so many of (id, run) the run without one letter: h picks both, the CRC-32 of `<id>:<run>`."""
    hashed = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))

    def without(h: Column) -> Column:
        at = (h % F.length(run)).cast("int")
        return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)

    return without(hashed)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, change: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lower-cased, as change(id, run) makes them; counted before the shuffle."""
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(LETTERS), F.lit(0))
    found = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run")).where(F.length("run") >= min_length)
    words = found.select((change(F.col("id"), F.col("run")) if change else F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """Rank of each bigram, the rarest first; as many rows as the alphabet has pairs, at most."""
    places = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    counted = places.groupBy("gram").agg(F.count("*").alias("n")).collect()
    return {r["gram"]: k for k, r in enumerate(sorted(counted, key=lambda r: (r["n"], r["gram"])))}


def rarest(word: str, rank: dict[str, int]) -> list[int]:
    """Places of the word's three rarest bigrams, and of those equal to the third."""
    ranks = [rank[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(ranks)[2]
    return [i for i, r in enumerate(ranks) if r <= last]


def keys(word: str, places: list[int]) -> Iterator[tuple[bool, str]]:
    """(longer, key): what the word must share with one that an edit beyond a bigram made of it.

    longer: as the one with a letter more. Read from the start for edits right of the bigram, from the end for others.
    """
    for side, text, starts in (("<", word, places), (">", word[::-1], [len(word) - 2 - p for p in places])):
        for p in starts:
            for longer in (False, True):
                rest = len(text) - p - 2 - longer
                if rest >= 0:
                    half, same = rest // 2, text[: p + 2]
                    yield longer, f"{side}1{rest} {text[: p + 2 + half]}"
                    yield longer, f"{side}2{rest} {same} {text[len(text) - (rest - half) :]}"


def bigram_keys(words: DataFrame) -> DataFrame:
    """(key, longer, word, n) of each word of (word, n): written, for both sides of the join read it.

    Each word stands there once, with SHORTEST letters or more.
    """
    rank = bigram_order(words)
    words = words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")  # a word list has few files, and each word many keys

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(key, longer, word, n) for word, n in zip(batch["word"], batch["n"]) for longer, key in keys(word, rarest(word, rank))]
            yield pd.DataFrame(out, columns=["key", "longer", "word", "n"])

    keyed = words.mapInPandas(emit, "key string, longer boolean, word string, n long").withColumn("key", F.xxhash64("key"))
    return materialize(keyed, "bigram-keys")


def near_pairs(keyed: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of words exactly one inserted, deleted or replaced letter apart, each once, by their bigram_keys()."""
    a = keyed.where("not longer").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = keyed.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("n_b"))
    apart = (F.col("longer") & (F.length("b") == F.length("a") + 1)) | (~F.col("longer") & (F.col("a") < F.col("b")) & (F.length("b") == F.length("a")))
    return a.join(b, (a["key"] == b["key"]) & apart).where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def forms(words: DataFrame, pairs: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n): the form is the near word of largest n, if that is `times` the word's n or more."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    return words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """(word, root): the last of each word that has a form, by doubling steps.

    A form has at least twice the word's n, so there is no circle, and six rounds reach the end of the longest chain.
    """
    step = materialize(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(step.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(step)
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        step = moved.select("word", "root")


def variant_groups(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of (word, n)."""
    words = materialize(words, "words")
    shortest = words.agg(F.min(F.length("word"))).first()[0]
    if shortest is not None and shortest < SHORTEST:
        raise ValueError(f"words need {SHORTEST} letters or more: a shorter one has fewer than three bigrams")
    keyed = bigram_keys(words)
    found = materialize(forms(words, near_pairs(keyed), times), "forms")
    discard(keyed, words)
    return found.join(roots(found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
