"""A bounded sample of labelled documents, which the classifiers are fitted to."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, texts


def sample_of(labels: DataFrame, id_col: str, label_col: str, folds: int, held: int, per_class: int) -> tuple[list, dict[int, int]]:
    """Ids of at most per_class labelled rows of each class, the first by a hash, of the training folds; and all training rows by class."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    rows = rows.filter(fold_of("id", folds) != held).groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    ids = []
    for label in (0, 1):
        ids += rows.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(per_class).collect()
    return ids, counts


def sampled_texts(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, ids: list) -> DataFrame:
    """_label, _half and the whole text of each sampled id; an id that df repeats has its text of the least hash.

    No more rows than ids, which per_class bounds; so does the broadcast.
    """
    kind = labels.schema[label_id].dataType.simpleString()
    chosen = df.sparkSession.createDataFrame([(r["id"], r["label"], i % 2) for i, r in enumerate(ids)], f"_k {kind}, _label int, _half int")
    found = texts(df, id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("_k"))
    first = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text")))
    return found.groupBy("_k", "_label", "_half").agg(first.alias("text")).select("_label", "_half", "text")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * weight.sum() * w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + (ridge * weight.sum() + 1e-9) * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def calibrated(values: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset that turn a value into the probability of label 1, where share is that of label 1 among all labels."""
    scale = float(values.std()) or 1.0
    ones = max(int((labels == 1).sum()), 1)
    weight = np.where(labels == 1, share / ones, (1 - share) / max(len(labels) - ones, 1)) * len(labels)
    slope, offset = logistic(np.stack([values / scale, np.ones_like(values)], 1), labels, weight, 1e-4).tolist()
    return slope / scale, offset
