"""Quality scores by a regularised quadratic discriminant over statistics of documents.

Each class gets the mean and the covariance of the transformed statistics, drawn towards the pooled covariance
(``toward_pooled``) and then towards a multiple of the identity (``toward_round``). A score is the posterior of label 1:
the difference of the classes' log-densities, each a squared Mahalanobis distance solved with the class's Cholesky
factor, which is computed once and sent with the model. Only sums are gathered for a fit, first of values, then of products around
their mean: one row of moments for each class and place, whatever the number of labelled rows.

Defined cases: a null text counts as empty and gets the score of an empty text; equal rows are each scored; a null
doc_id is scored and never learned from; labels other than 0 and 1 or without a doc_id are left out; of several labels of
one document the least counts; with no labels of a class the score is the share of label 1 (0.5 with none at all); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.labelled import held_out, usable
from tessera.llm.text_stats import shares, with_stats

CUT = 0.3


@dataclass(frozen=True)
class Discriminant:
    prior: float
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: np.ndarray | None = None
    factors: np.ndarray | None = None  # the inverses of the Cholesky factors, one a class
    offsets: np.ndarray | None = None  # log prior less half the log determinant

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        z = (x - self.center) / self.scale
        logs = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -700, 700)))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and ``x``: the transformed statistics as an array of doubles."""
    return with_stats(docs.select("doc_id", text), text).select("doc_id", F.array(*shares(F.col("stats")).values()).alias("x"))


def _sums(rows: DataFrame, center: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """For each label the sums of (1, x - center), and with a center those of all its products.

    Rows of a task are added in the order of their ids, and tasks' sums as decimals, so that the order of tasks does not matter.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for label, group in pdf.groupby("label"):
                x = np.array(group["x"].tolist())
                x = np.column_stack([np.ones(len(x)), x if center is None else x - center])
                sums[label] = sums.get(label, 0) + (x.sum(0, keepdims=True) if center is None else x.T @ x)
        for label, s in sums.items():
            yield pd.DataFrame({"label": label, "at": np.arange(s.size), "value": s.ravel()})

    parts = rows.select("label", "x").mapInPandas(moments, "label int, at int, value double")
    added = parts.groupBy("label", "at").agg(F.sum(F.col("value").cast("decimal(38,12)")).cast("double").alias("value"))
    out: dict[int, dict[int, float]] = {}
    for r in added.collect():  # (d + 1) ** 2 numbers for each of two classes
        out.setdefault(r["label"], {})[r["at"]] = r["value"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def fit(rows: DataFrame, *, toward_pooled: float = 0.1, toward_round: float = 0.01) -> Discriminant:
    """``rows``: ``doc_id``, ``x`` and ``label``. Sums are made in the tasks and added by Spark, first for the mean, then around it."""
    rows = written(rows.select("doc_id", "x", "label"), "labelled").repartition("doc_id").sortWithinPartitions("doc_id", "label", "x")
    first = _sums(rows)
    n = {k: float(first[k][0]) if k in first else 0.0 for k in (0, 1)}
    if min(n.values()) < 2:
        return Discriminant(n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5)
    total = n[0] + n[1]
    center = (first[0][1:] + first[1][1:]) / total
    sums = {k: v.reshape(len(center) + 1, -1) for k, v in _sums(rows, center).items()}
    scale = np.sqrt(np.maximum(np.diag(sums[0] + sums[1])[1:] / total, 0)) + 1e-9
    means = np.array([sums[k][0, 1:] / n[k] for k in (0, 1)])
    covariances = [(sums[k][1:, 1:] / n[k] - np.outer(m, m)) / np.outer(scale, scale) for k, m in enumerate(means)]
    means = means / scale
    pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / total
    factors, offsets = [], []
    for k in (0, 1):
        c = (1 - toward_pooled) * covariances[k] + toward_pooled * pooled
        c = (1 - toward_round) * c + (toward_round * np.trace(c) / len(c) + 1e-9) * np.eye(len(c))
        cholesky = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(cholesky))
        offsets.append(np.log(n[k] / total) - np.log(np.diag(cholesky)).sum())
    return Discriminant(n[1] / total, center, scale, means, np.array(factors), np.array(offsets))


def score(x: Column, model: Discriminant) -> Column:
    @F.pandas_udf("double")
    def scored(values: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(values.tolist()).reshape(len(values), -1)))

    return scored(x)


def scored_documents(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "quality", **settings) -> DataFrame:
    """``doc_id, held_out, score`` for every row; statistics are made once, written, and used to learn and to score."""
    x = written(features(docs, text), "features")
    model = fit(x.join(usable(labels, label), "doc_id"), **settings)
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("x"), model).alias("score"))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    scored = scored_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))
