"""Scoring with tree ensembles and support vectors, in whole Arrow batches.

Artifacts are small and read by the driver; a model is flat arrays that every task gets. All rows of a
batch go down all trees together.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Trees:
    """``feature`` is -1 at leaves. ``strict``: left is x < threshold, else x <= threshold. ``missing_left``: where NaN goes, by node."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    strict: bool
    base: float = 0.0
    logistic: bool = False
    mean: bool = False

    def margins(self, x: np.ndarray) -> np.ndarray:
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                break
            v = x[rows, np.maximum(f, 0)]
            left = v < self.threshold[node] if self.strict else v <= self.threshold[node]
            left = np.where(np.isfinite(v), left, self.missing_left[node])
            node = np.where(inner, np.where(left, self.left[node], self.right[node]), node)
        leaves = self.value[node]
        return self.base + (leaves.mean(axis=1) if self.mean else leaves.sum(axis=1))

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.margins(x)
        return 1 / (1 + np.exp(-np.clip(m, -700, 700))) if self.logistic else m


def _stacked(trees: list[dict], **kind) -> Trees:
    roots, at = [], 0
    parts: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "missing_left", "value")}
    for t in trees:
        roots.append(at)
        for k in parts:
            v = np.asarray(t[k])
            parts[k].append(v + at if k in ("left", "right") else v)
        at += len(t["feature"])
    joined = {k: np.concatenate(v) for k, v in parts.items()}
    return Trees(np.array(roots), joined["feature"].astype(int), joined["threshold"].astype(float), joined["left"].astype(int), joined["right"].astype(int), joined["missing_left"].astype(bool), joined["value"].astype(float), **kind)


def xgboost_json(text: str) -> Trees:
    """A saved booster in JSON: missing values go by ``default_left``."""
    learner = json.loads(text)["learner"]
    raw = learner["gradient_booster"]["model"]["trees"]
    logistic = "logistic" in learner.get("objective", {}).get("name", "")
    base = float(str(learner["learner_model_param"]["base_score"]).strip("[]"))
    trees = []
    for t in raw:
        left = np.asarray(t["left_children"])
        cond = np.asarray(t["split_conditions"], dtype=float)
        leaf = left < 0
        trees.append({
            "feature": np.where(leaf, -1, t["split_indices"]), "threshold": cond, "left": np.maximum(left, 0), "right": np.maximum(t["right_children"], 0),
            "missing_left": np.asarray(t["default_left"]), "value": np.where(leaf, cond, 0.0),
        })
    margin = float(np.log(base / (1 - base))) if logistic and 0 < base < 1 else base
    return _stacked(trees, strict=True, base=margin, logistic=logistic)


def lightgbm_text(text: str, logistic: bool = True) -> Trees:
    """A saved model in text: children below 0 are leaves, values that are no finite numbers go left."""
    trees = []
    for block in text.split("Tree=")[1:]:
        field = dict(line.split("=", 1) for line in block.splitlines() if "=" in line)
        leaves = np.array(field["leaf_value"].split(), dtype=float)
        if "split_feature" not in field or not field["split_feature"].strip():
            trees.append({"feature": [-1], "threshold": [0.0], "left": [0], "right": [0], "missing_left": [True], "value": leaves[:1]})
            continue
        get = lambda k, t: np.array(field[k].split(), dtype=t)
        n = len(get("split_feature", int))
        child = lambda c: np.where(c < 0, n - c - 1, c)
        pad = np.zeros(len(leaves), int)
        trees.append({
            "feature": np.concatenate([get("split_feature", int), pad - 1]), "threshold": np.concatenate([get("threshold", float), pad]),
            "left": np.concatenate([child(get("left_child", int)), pad]), "right": np.concatenate([child(get("right_child", int)), pad]),
            "missing_left": np.ones(n + len(leaves), bool), "value": np.concatenate([np.zeros(n), leaves]),
        })
    return _stacked(trees, strict=False, logistic=logistic)


def forest_json(text: str) -> Trees:
    """Averaged trees in JSON: ``trees`` with ``feature``, ``threshold``, ``children_left``, ``children_right`` and the class-1 ``value`` of each node."""
    trees = []
    for t in json.loads(text)["trees"]:
        left = np.asarray(t["children_left"])
        trees.append({
            "feature": np.where(left < 0, -1, t["feature"]), "threshold": t["threshold"], "left": np.maximum(left, 0),
            "right": np.maximum(t["children_right"], 0), "missing_left": np.ones(len(left), bool), "value": t["value"],
        })
    return _stacked(trees, strict=False, mean=True)


@dataclass
class OneClassSvm:
    """Novelty by radial support vectors: the greater, the less like what was learnt."""

    vectors: np.ndarray
    weights: np.ndarray
    intercept: float
    gamma: float

    def score(self, x: np.ndarray) -> np.ndarray:
        square = (x**2).sum(1)[:, None] + (self.vectors**2).sum(1)[None, :] - 2 * x @ self.vectors.T
        raw = -(self.intercept + np.exp(-self.gamma * np.maximum(square, 0)) @ self.weights)
        return 100 / (1 + np.exp(-np.clip(raw, -700, 700)))


def score_with(model, features: list[str]) -> Column:
    """A model's score of the feature columns; nulls are missing values. Without a model the score is null."""
    if model is None:
        return F.lit(None).cast("double")

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])))

    return run(*(F.col(c).cast("double") for c in features))


def clusters(df: DataFrame, features: list[str], k: int = 4, seed: int = 42) -> DataFrame:
    """Adds ``cluster``: k-means over standardised features; nulls count as 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="_raw").transform(df.fillna(0, features))
    scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(rows).transform(rows)
    out = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(scaled).transform(scaled)
    return out.drop("_raw", "_x")


def cluster_means(df: DataFrame, features: list[str]) -> DataFrame:
    return df.groupBy("cluster").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in features))


def impute_medians(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with nulls in ``columns`` replaced by the medians of ``train``, 0 where it has no value."""
    medians = train.agg(*(F.percentile(F.col(c), F.lit(0.5)).alias(c) for c in columns)).first()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c] or 0.0))) for c in columns})


def one_hot(train: DataFrame, df: DataFrame, column: str, most: int = 2_000) -> DataFrame:
    """Adds ``<column>_<value>``, 1.0 or 0.0, for each value in ``train``; a value that it lacks has no column.

    More than ``most`` values are an error: no plan holds a column for each of very many, and none is left out unsaid.
    """
    found = train.where(F.col(column).isNotNull()).select(F.col(column).alias("v")).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values: encode it by a vocabulary, or raise the bound")
    values = sorted(r.v for r in found)
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in values})


def train_classifier(df: DataFrame, features: list[str], label: str, kind: str = "gbt", seed: int = 42, **settings):
    """A fitted Spark pipeline for 0/1 (``gbt``) or several (``forest``) classes; nulls count as 0. ``settings`` go to the learner."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler

    filled = [f"_{c}" for c in features]
    learner = {"gbt": GBTClassifier, "forest": RandomForestClassifier}[kind](featuresCol="_x", labelCol=label, seed=seed, **settings)
    numbers = df.withColumns({c: F.col(c).cast("double") for c in features}).withColumn(label, F.col(label).cast("double"))
    stages = [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_x", handleInvalid="keep"), learner]
    return Pipeline(stages=stages).fit(numbers)


def predict_with(model, df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with ``prediction`` and, where there are two classes, ``score``, the probability of class 1 on a scale to 100."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df.withColumns({c: F.col(c).cast("double") for c in features}))
    score = F.get(vector_to_array("probability"), F.lit(1)) * 100
    return out.withColumn("score", score).drop("_x", "rawPrediction", "probability", *(f"_{c}" for c in features))
