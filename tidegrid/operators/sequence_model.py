"""A forecaster over sequences: one causal convolution, then a dense layer.

It stands where deeper sequence networks would: a convolution over the last ``kernel`` steps at each step, rectified, and one
dense layer over all its outputs. It is trained with Adam on the Huber loss; each step is one Arrow pass in which every task adds up the
gradients of its own rows, and the sums, as many numbers as the model has, are grouped by place. So the driver gets one number a
weight and step, whatever the number of rows, and the result doesn't depend on how rows are dealt (but for the order of sums).
Rows are written once, so a lost executor repeats one task of one step.

Defined results: rows with a null label, a null sequence or a sequence of another length aren't learned from, and predict null (labels aside);
null and NaN steps count as 0; without rows to learn from the model predicts 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.sources.io import remove, scratch

#: Rows that one numpy step takes.
_ROWS = 4096


@dataclass
class SequenceModel:
    """``weights``: the convolution's (kernel x inputs x filters) and its biases, then the dense layer's and its bias."""

    steps: int
    inputs: int
    filters: int
    kernel: int
    weights: np.ndarray
    losses: list[tuple[float, float]] = field(default_factory=list)

    @classmethod
    def start(cls, steps: int, inputs: int, filters: int, kernel: int, seed: int) -> SequenceModel:
        rng = np.random.default_rng(seed)
        conv = rng.normal(0, (2 / (kernel * inputs)) ** 0.5, kernel * inputs * filters)
        dense = rng.normal(0, (1 / (steps * filters)) ** 0.5, steps * filters)
        return cls(steps, inputs, filters, kernel, np.concatenate([conv, np.zeros(filters), dense, [0.0]]))

    def _parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        n = self.kernel * self.inputs * self.filters
        conv, bias, dense = np.split(self.weights[:-1], [n, n + self.filters])
        return conv.reshape(self.kernel * self.inputs, self.filters), bias, dense, float(self.weights[-1])

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each step sees, the rectified convolution, and predictions; nothing sees a later step."""
        conv, bias, dense, last = self._parts()
        x = np.concatenate([np.zeros((len(x), self.kernel - 1, self.inputs)), np.nan_to_num(x)], axis=1)
        seen = np.concatenate([x[:, k : k + self.steps] for k in range(self.kernel)], axis=2)
        out = np.maximum(seen @ conv + bias, 0.0)
        return seen, out, out.reshape(len(x), self.steps * self.filters) @ dense + last

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[2]

    def gradient(self, x: np.ndarray, y: np.ndarray, delta: float) -> tuple[float, np.ndarray]:
        """The rows' summed Huber loss and its gradient by each weight."""
        conv, _, dense, _ = self._parts()
        seen, out, got = self._forward(x)
        error = got - y
        slope = np.clip(error, -delta, delta)
        loss = float((slope * (error - slope / 2)).sum())
        back = (slope[:, None] * dense).reshape(out.shape) * (out > 0)
        grads = [np.einsum("nti,ntf->if", seen, back).ravel(), back.sum(axis=(0, 1)), slope @ out.reshape(len(x), self.steps * self.filters), [slope.sum()]]
        return loss, np.concatenate(grads)


def step_sums(rows: DataFrame, model: SequenceModel, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """(loss, rows) of the rows that are learned from and of those held out, and the gradient of the former, over all rows."""
    size = len(model.weights)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 4)
        for batch in batches:
            model, y, held = sent.value, batch.column("label").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)
            for i in range(0, batch.num_rows, _ROWS):
                part = slice(i, i + _ROWS)
                xs = batch.column("sequence").slice(i, _ROWS).flatten().to_numpy(zero_copy_only=False).reshape(len(y[part]), model.steps, model.inputs)
                for which in (False, True):
                    own = held[part] == which
                    loss, grad = model.gradient(xs[own], y[part][own], delta)
                    total[size + 2 * which : size + 2 * which + 2] += loss, own.sum()
                    if not which:
                        total[:size] += grad
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    found = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")
    sent.destroy()
    total = found["v"].to_numpy() if len(found) else np.zeros(size + 4)
    return total[size:].reshape(2, 2), total[:size]


def fit(
    df: DataFrame, sequence: str, label: str, held: str, steps: int, inputs: int, filters: int = 16, kernel: int = 3, epochs: int = 50, rate: float = 0.01, delta: float = 1.0, patience: int = 5, seed: int = 42
) -> SequenceModel:
    """Train on the rows where ``held`` is false; the weights of the lowest held-out loss stay, and ``patience`` steps without a lower one end it.

    ``sequence`` holds ``steps`` x ``inputs`` numbers, step after step.
    """
    spark, size = df.sparkSession, steps * inputs
    clean = F.transform(F.col(sequence), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    rows = df.where(F.col(label).isNotNull() & (F.size(sequence) == size)).select(clean.alias("sequence"), F.col(label).cast("double").alias("label"), F.coalesce(F.col(held), F.lit(False)).alias("held"))
    path = scratch(spark, "sequence-rows")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    model = SequenceModel.start(steps, inputs, filters, kernel, seed)
    first, second, best, since = np.zeros(len(model.weights)), np.zeros(len(model.weights)), (np.inf, model.weights), 0
    try:
        for t in range(1, epochs + 1):
            sums, grad = step_sums(rows, model, delta)
            if not sums[0, 1]:
                model.weights = np.zeros(len(model.weights))
                return model
            losses = tuple(float(loss / n) if n else float("nan") for loss, n in sums)
            model.losses.append(losses)
            judged = losses[1] if sums[1, 1] else losses[0]
            best, since = ((judged, model.weights), 0) if judged < best[0] else (best, since + 1)
            if since >= patience:
                break
            grad = grad / sums[0, 1]
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
            model.weights = model.weights - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    finally:
        remove(spark, path)
    model.weights = best[1]
    return model


def predict(df: DataFrame, model: SequenceModel, sequence: str, out: str = "prediction") -> DataFrame:
    sent, size = df.sparkSession.sparkContext.broadcast(model), model.steps * model.inputs

    @F.pandas_udf("double")
    def run(column: pd.Series) -> pd.Series:
        ok = column.map(lambda v: v is not None and len(v) == size).to_numpy(bool)
        got = np.full(len(column), np.nan)
        if ok.any():
            got[ok] = sent.value.predict(np.stack([np.asarray(v, float) for v in column[ok]]).reshape(-1, model.steps, model.inputs))
        return pd.Series(got)

    value = run(F.transform(F.col(sequence), lambda v: v.cast("double")))
    return df.withColumn(out, F.when(F.size(sequence) == size, value))
