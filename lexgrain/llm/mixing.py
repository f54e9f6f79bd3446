"""Mixing of sources to target weights by Poisson replication."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, pack, unpack


def poisson_cdf(rate: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ... until what is left is below the grain of the uniform numbers.

    The last entry is 1, so inversion always ends. In logarithms, so that large rates don't underflow.
    """
    if rate <= 0:
        return [1.0]
    k = np.arange(math.ceil(rate + 12 * math.sqrt(rate) + 40))
    log_factorial = np.r_[0.0, np.cumsum(np.log(k[1:]))]
    cdf = np.minimum(1.0, np.cumsum(np.exp(k * math.log(rate) - rate - log_factorial)))
    cdf = cdf[: int(np.argmax(cdf > 1 - 2.0**-54)) + 1] if (cdf > 1 - 2.0**-54).any() else cdf
    cdf[-1] = 1.0
    return cdf.tolist()


def source_rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, power: float = 0.5, total: int | None = None) -> DataFrame:
    """(source, n, rate): how often each document of a source is wanted on average.

    A source gets its weight's share of `total` rows (as many as there are, if None). Without weights, a source
    weighs its row count to the given power (1 keeps the natural mix, 0 gives all sources the same share). With
    weights, sources that they don't name weigh nothing. A null source is a source of its own, named "" in weights.
    """
    n = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("weight", F.pow("n", F.lit(float(power))))
    else:
        session = docs.sparkSession
        given = session.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        n = n.join(given, F.coalesce("source", F.lit("")) == given["name"], "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    n = materialize(n, "sources")
    sums = n.agg(F.sum("weight").alias("w"), F.sum("n").alias("rows")).first()
    if not sums["w"]:
        return n.select("source", "n", F.lit(0.0).alias("rate"))
    wanted = sums["rows"] if total is None else total
    return n.select("source", "n", (F.col("weight") / F.lit(float(sums["w"])) * F.lit(float(wanted)) / F.col("n")).alias("rate"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, power: float = 0.5, total: int | None = None, seed: int = 17
) -> DataFrame:
    """docs with each row repeated by a Poisson count of its source's rate, in a global random order.

    Adds rate, copies (the row's count), copy (1 to copies) and shuffle_key; rows of count zero go. The count
    inverts the Poisson distribution at a uniform number hashed from seed, id and text, so runs and retried tasks
    agree, and repeated rows get equal counts. Null ids, sources and texts are values like any other. An empty
    table gives an empty one. Columns of docs that have the name of an added one are replaced.

    Rates are joined by source: a small rate table is broadcast at run time, and a large one meets documents in
    a join whose hot sources Spark splits. Copies are dealt by the hash of the shuffle key and sorted by it within
    each partition, which is a random permutation of the corpus that is cut into files.
    """

    @F.pandas_udf("array<double>")
    def cdf(rates: pd.Series) -> pd.Series:
        return pd.Series([poisson_cdf(r) for r in rates], dtype=object)

    rates = source_rates(docs, source_col, weights, power, total)
    rates = materialize(rates.select(F.col("source").alias("_source"), "rate", cdf("rate").alias("cdf")), "rates")
    row = F.col("_row")
    keyed = pack(docs).withColumn("hash", F.xxhash64(F.lit(seed), row.getField(id_col), F.xxhash64(row.getField(text_col))))
    keyed = keyed.withColumn("uniform", F.shiftrightunsigned("hash", 11) / F.lit(2.0**53))
    joined = keyed.join(rates, row.getField(source_col).eqNullSafe(F.col("_source")))
    counted = joined.select("_row", "hash", "rate", F.size(F.filter("cdf", lambda c: c <= F.col("uniform"))).alias("copies")).where("copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    copies = copies.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "hash", "copy"))
    dealt = copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return unpack(dealt, docs.columns, **{c: F.col(c) for c in ("rate", "copies", "copy", "shuffle_key")})
