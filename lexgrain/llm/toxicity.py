"""Toxicity by non-negative positive-unlabelled learning of a linear classifier on word presence."""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, pack, unpack

WORD = re.compile(r"\w+")
#: Words are hashed to so many columns.
COLUMNS = 1 << 18


@dataclass(frozen=True)
class Plan:
    """The fit takes max_positive confirmed rows and max_unlabelled others at most; its bound doesn't grow with the corpus.

    Columns are left out whose shares of the positive and of the unlabelled rows differ by less than min_z standard
    errors, as are those that fewer than five positive rows have. beta and gamma are those of the estimator: how
    negative the corrected risk may get, and how strongly it is driven back.
    """

    max_positive: int = 4000
    max_unlabelled: int = 12000
    min_z: float = 4.0
    rounds: int = 400
    rate: float = 0.05
    decay: float = 1e-4
    beta: float = 0.0
    gamma: float = 1.0


def word_columns(text: str | None) -> np.ndarray:
    """The columns of the words of a whole text, each once."""
    return np.array(sorted({crc32(w.encode("utf-8", "surrogatepass")) % COLUMNS for w in set(WORD.findall((text or "").lower()))}), np.int64)


def fold(id_col: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Rows:
    """Sparse rows of ones."""

    def __init__(self, rows: list[np.ndarray], keep: np.ndarray):
        rows = [r[np.isin(r, keep)] for r in rows]
        self.n, self.width = len(rows), len(keep)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.column = np.searchsorted(keep, np.concatenate([*rows, np.empty(0, np.int64)]))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n)

    def gradient(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, g[self.row], self.width)


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, plan: Plan = Plan()) -> tuple[np.ndarray, float]:
    """Weights of the COLUMNS and a bias, by minimizing the non-negative PU risk with logistic loss.

    The risk is prior * R(positive as 1) + max(0, R(unlabelled as 0) - prior * R(positive as 0)): the second part
    estimates the risk of the true negatives, which can't be negative; where it falls below -beta, the step
    undoes it instead. Without positive or unlabelled rows, all weights are zero and the score is the prior.
    """
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    weights, bias = np.zeros(COLUMNS), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return weights, bias
    np_rows, nu_rows = len(positive), len(unlabelled)
    seen, usual = (np.bincount(np.concatenate(x), minlength=COLUMNS) for x in (positive, unlabelled))
    pooled = (seen + usual + 1) / (np_rows + nu_rows + 2)
    z = (seen / np_rows - usual / nu_rows) / np.sqrt(pooled * (1 - pooled) * (1 / np_rows + 1 / nu_rows))
    keep = np.flatnonzero((np.abs(z) >= plan.min_z) & (seen >= 5))
    p, u = Rows(positive, keep), Rows(unlabelled, keep)
    w = np.zeros(len(keep) + 1)
    w[-1] = bias
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, plan.rounds + 1):
        sp, su = sigmoid(p.dot(w[:-1]) + w[-1]), sigmoid(u.dot(w[:-1]) + w[-1])

        def both(x: Rows, g: np.ndarray) -> np.ndarray:
            return np.r_[x.gradient(g), g.sum()]

        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        of_negative = both(u, su / u.n) - prior * both(p, sp / p.n)
        if negative < -plan.beta:
            g = -plan.gamma * of_negative
        else:
            g = prior * both(p, (sp - 1) / p.n) + of_negative
        g[:-1] += plan.decay * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= plan.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights[keep] = w[:-1]
    return weights, float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", plan: Plan = Plan()) -> tuple[np.ndarray, float]:
    """Fit on the folds that aren't held out.

    Confirmed rows are those with label 1; the unlabelled ones are drawn from all training rows with their labels
    hidden, as the estimator asks for. The prior is the share of label 1 among all labelled training rows. Rows are
    drawn by the hash of the id, and what the driver gets of a row is the columns of its words.
    """
    confirmed = labels.where(fold(id_col) != 0).where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("label"))
    prior = confirmed.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    train = docs.where(fold(id_col) != 0).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))

    @F.pandas_udf("array<int>")
    def columns(texts: pd.Series) -> pd.Series:
        return pd.Series([word_columns(t).astype(np.int32) for t in texts], dtype=object)

    def draw(rows: DataFrame, most: int, seed: int) -> DataFrame:
        return rows.select("_id", F.xxhash64("_id", F.lit(seed)).alias("draw")).orderBy("draw", "_id").limit(most).select("_id").distinct()

    # ids are drawn first, and their texts are read in one pass; the broadcast has 16,000 ids at most
    toxic = train.select("_id").join(confirmed.where("label = 1"), "_id", "left_semi")
    drawn = draw(toxic, plan.max_positive, 1).withColumn("seed", F.lit(1)).unionByName(draw(train.select("_id"), plan.max_unlabelled, 2).withColumn("seed", F.lit(2)))
    texts = train.join(F.broadcast(drawn), "_id").select("seed", F.xxhash64("_id", "seed").alias("draw"), F.xxhash64("text").alias("hash"), columns("text").alias("columns"))
    texts = materialize(texts, "drawn")

    def rows(seed: int, most: int) -> list[np.ndarray]:
        taken = texts.where(F.col("seed") == seed).orderBy("draw", "hash").limit(most)
        return [np.asarray(r["columns"], np.int64) for r in taken.select("columns").collect()]

    fitted = fit_nnpu(rows(1, plan.max_positive), rows(2, plan.max_unlabelled), prior or 0.0, plan)
    discard(texts)
    return fitted


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with held_out, score (0 to 1; higher: label 1 is likelier) and predicted (1 from a score of 0.5 on).

    Whole texts are scored, each row for itself: no shuffle. Null and empty texts get the score of the bias alone;
    rows with a null id are held out. Repeated rows give repeated rows, an empty table gives an empty one. Columns
    of docs that have the name of an added one are replaced.
    """

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(sigmoid(np.array([weights[word_columns(t)].sum() for t in texts]) + bias))

    row = F.col("_row")
    scored = pack(docs).select("_row", scores(row.getField(text_col)).alias("_score"), (F.coalesce(F.crc32(row.getField(id_col).cast("string").cast("binary")) % 5, F.lit(0)) == 0).alias("_held"))
    return unpack(scored, docs.columns, held_out=F.col("_held"), score=F.col("_score"), predicted=(F.col("_score") >= 0.5).cast("int"))
