"""Logistic regression by iteratively reweighted least squares, all folds of a cross-validation at once.

An iteration is one pass: each task sums its rows' weighted products, Spark adds these sums up by model, and
one small matrix a model comes to the driver, where a step is solved. No row ever does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.shared import kept

#: Rounds at most, and the step below which a fit is done.
ROUNDS, SMALL = 50, 1e-9
#: Distinct categories that become columns, at most; a table with more raises an error.
MOST_CATEGORIES = 200


def ready(rows: DataFrame, numbers: list[str], category: str | None, fold: Column, label: str, key: str) -> tuple[DataFrame, list[str]]:
    """key, y, fold and x (numbers, then a 0 or 1 for each category but the first), and names of the columns of x.

    Null numbers are 0; a null category has all its columns 0, as the first one has.
    """
    names = [r["c"] for r in rows.select(F.col(category).alias("c")).where("c IS NOT NULL").distinct().orderBy("c").limit(MOST_CATEGORIES + 1).collect()] if category else []
    if len(names) > MOST_CATEGORIES:
        raise ValueError(f"{category} has more than {MOST_CATEGORIES} values")
    value = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers]
    value += [F.coalesce((F.col(category) == F.lit(c)).cast("double"), F.lit(0.0)) for c in names[1:]]
    x = F.array(*value) if value else F.array().cast("array<double>")
    return rows.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"), fold.cast("int").alias("fold"), x.alias("x")), [*numbers, *names[1:]]


def stored(data: DataFrame) -> DataFrame:
    """The figures written once in the shared folder, since each iteration reads them."""
    return kept(data, "figures")


def moments(data: DataFrame, folds: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and deviation of each column, and rows of either label, for the rows outside each fold and for all rows (last)."""
    sums = [F.sum(F.element_at("x", i + 1)).alias(f"s{i}") for i in range(p)] + [F.sum(F.element_at("x", i + 1) ** 2).alias(f"q{i}") for i in range(p)]
    found = data.where("y IS NOT NULL").groupBy("fold", "y").agg(F.count("*").alias("n"), *sums).collect()
    every, labels, one = np.zeros((folds, 1 + 2 * p)), np.zeros((folds, 2)), np.zeros(1 + 2 * p)
    for r in found:
        one = np.array([r["n"], *(r[f"s{i}"] for i in range(p)), *(r[f"q{i}"] for i in range(p))], float)
        every[r["fold"]] += one
        labels[r["fold"], r["y"]] += r["n"]
    outside = np.vstack([every.sum(0) - every, every.sum(0)])
    n = np.maximum(outside[:, :1], 1)
    mean = outside[:, 1 : p + 1] / n
    spread = np.sqrt(np.maximum(outside[:, p + 1 :] / n - mean**2, 0))
    return mean, np.where(spread > 1e-12, spread, 1), np.vstack([labels.sum(0) - labels, labels.sum(0)])


def fitted(data: DataFrame, p: int, folds: int, *, penalty: float = 1.0, balanced: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (intercept last) of ``folds`` models, each of the rows outside its fold, and of one of all rows; with the means and deviations by which columns are standardised.

    Minimises the weighted log loss plus half of ``penalty`` times the squared coefficients, the intercept
    left out. ``balanced`` weighs labels so that both count alike. A model whose rows have one label has zeros.
    """
    mean, spread, labels = moments(data, folds, p)
    weight = labels.sum(1, keepdims=True) / (2 * np.maximum(labels, 1)) if balanced else np.ones_like(labels)
    beta, models, done = np.zeros((folds + 1, p + 1)), folds + 1, (labels == 0).any(1)
    for _ in range(ROUNDS):
        if done.all():
            break
        now, open_ = beta.copy(), np.flatnonzero(~done)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((models, (p + 1) * (p + 2)))
            for b in batches:
                y, fold = b.column(0).to_numpy(), b.column(1).to_numpy()
                x = b.column(2).flatten().to_numpy().reshape(len(y), p)
                for m in open_:
                    own = fold != m
                    z = np.concatenate([(x[own] - mean[m]) / spread[m], np.ones((own.sum(), 1))], 1)
                    w = weight[m][y[own]]
                    chance = 1 / (1 + np.exp(-np.clip(z @ now[m], -700, 700)))
                    sums[m] += np.concatenate([(z.T * (w * chance * (1 - chance))) @ z, (z.T @ (w * (y[own] - chance)))[None]]).ravel()
            i, j = np.indices(sums.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(sums.ravel())], ["model", "place", "value"])

        found = np.zeros((models, (p + 1) * (p + 2)))
        for r in data.where("y IS NOT NULL").select("y", "fold", "x").mapInArrow(run, "model int, place int, value double").groupBy("model", "place").agg(F.sum("value").alias("value")).collect():
            found[r["model"], r["place"]] = r["value"]
        for m in open_:
            part = found[m].reshape(p + 2, p + 1)
            ridge = np.append(np.full(p, penalty), 0.0)
            step = np.linalg.solve(part[:-1] + np.diag(ridge + 1e-12), part[-1] - ridge * beta[m])
            beta[m] += step
            done[m] = np.abs(step).max() < SMALL
    return beta, mean, spread


def out_of_fold(data: DataFrame, beta: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> DataFrame:
    """key, y, fold, score of each row, by the model that hasn't seen its fold. Rows without a label are scored too."""
    raw = beta[:, :-1] / spread
    base = beta[:, -1] - (raw * mean).sum(1)
    lines = F.array(*[F.array(*map(F.lit, map(float, r))) for r in raw]) if raw.shape[1] else F.array(*[F.array().cast("array<double>") for _ in raw])
    dot = F.aggregate(F.zip_with("x", F.get(lines, F.col("fold")), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return data.select("key", "y", "fold", (1 / (1 + F.exp(-(dot + F.get(F.array(*map(F.lit, map(float, base))), F.col("fold")))))).alias("score"))
