"""Logistic regression by Newton rounds: each round is one aggregation over the samples, the step a tiny solve."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.session import cut_lineage


@dataclass(frozen=True)
class LinearModel:
    coefficients: tuple[float, ...]
    intercept: float


def _sums(rows: DataFrame, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian summed over (x, y, w); a task sends one row per cell, whatever the number of samples."""
    size = len(beta)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope, bend = 0.0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = np.ones((batch.num_rows, size))
            x[:, :-1] = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size - 1)
            y, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            margin = x @ beta
            p = 0.5 * (1 + np.tanh(margin / 2))
            loss += float(w @ (np.logaddexp(0, margin) - y * margin))
            slope += x.T @ (w * (p - y))
            bend += x.T @ (x * (w * p * (1 - p))[:, None])
        cells = np.concatenate([[loss], slope, bend.ravel()])
        yield pa.record_batch([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "value"])

    total = rows.mapInArrow(add, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).orderBy("cell").toArrow()
    cells = total["value"].to_numpy()
    return cells[0], cells[1:size + 1], cells[size + 1:].reshape(size, size)


def fit(samples: DataFrame, features: Column, label: str, balanced: bool = True, c: float = 1.0, max_rounds: int = 100,
        tolerance: float = 1e-10, single_class: bool = False) -> LinearModel:
    """Minimum of c * sum(weight * log loss) + |coefficients|^2 / 2, the intercept unpenalised.

    ``balanced`` weighs the classes alike. The samples are written once; a round that does not lower
    the loss halves its step. Samples with a NULL label or feature are not allowed in ``features``;
    no sample raises, and so does a single class unless ``single_class`` is set: the loss then has no
    minimum but falls towards coefficients of 0 and an infinite intercept, and this limit is returned.
    """
    rows = cut_lineage(samples.select(features.cast("array<double>").alias("x"), F.col(label).cast("double").alias("y")))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if single_class and len(counts) == 1 and set(counts) < {0.0, 1.0}:
        width = rows.select(F.max(F.size("x"))).first()[0]
        return LinearModel((0.0,) * width, math.inf if 1.0 in counts else -math.inf)
    if set(counts) != {0.0, 1.0}:
        raise ValueError(f"two classes are needed, the samples hold {sorted(counts, key=str)}")
    weight = F.when(F.col("y") == 1, total / (2 * counts[1.0])).otherwise(total / (2 * counts[0.0])) if balanced else F.lit(1.0)
    rows = rows.withColumn("w", c * weight)
    size = rows.select(F.max(F.size("x"))).first()[0] + 1
    penalty = np.r_[np.ones(size - 1), 0.0]

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, slope, bend = _sums(rows, beta)
        return loss + 0.5 * float(penalty @ (beta * beta)), slope + penalty * beta, bend + np.diag(penalty)

    beta = np.zeros(size)
    loss, slope, bend = at(beta)
    for _ in range(max_rounds):
        step = np.linalg.solve(bend, slope)
        if slope @ step <= tolerance * max(1.0, abs(loss)):  # the next round would move less than this one by far
            beta = beta - step
            break
        for _ in range(40):
            tried = at(beta - step)
            if tried[0] <= loss * (1 + 1e-12):
                break
            step = step / 2
        beta, (loss, slope, bend) = beta - step, tried
    else:
        raise ValueError(f"the fit has not settled in {max_rounds} rounds")
    return LinearModel(tuple(float(v) for v in beta[:-1]), float(beta[-1]))
