"""Pair classifier with hidden tanh layers (STN-05), trained data-parallel.

Examples are dealt into parts by a hash of their id, a number fixed by their
count, and lie in id order within a part.  A round broadcasts the weights
(their number is set by the layers, not by the data), every task sums the
gradient of each of its parts, and the parts' sums are merged in part order by
a tree of fan 16; only the root, one row, reaches the driver, which makes one
Adam step.  The order of all sums is fixed by the examples, so a rerun, a
repeated task or another cluster gives the same weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN, ROWS_PER_PART = 16, 4096
Layers = list[tuple[np.ndarray, np.ndarray]]


def first_layers(sizes: list[int], seed: int) -> Layers:
    rng = np.random.default_rng(seed)
    return [(rng.normal(0, np.sqrt(1.0 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]


def flat(layers: Layers) -> np.ndarray:
    return np.concatenate([np.concatenate([w.ravel(), b]) for w, b in layers])


def unflat(values: np.ndarray, sizes: list[int]) -> Layers:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((values[at:at + a * b].reshape(a, b), values[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def forward(x: np.ndarray, layers: Layers) -> list[np.ndarray]:
    """The input, each hidden layer's values and the logits."""
    values = [x]
    for w, b in layers[:-1]:
        values.append(np.tanh(values[-1] @ w + b))
    return [*values, values[-1] @ layers[-1][0] + layers[-1][1]]


def loss_gradient(x: np.ndarray, y: np.ndarray, layers: Layers) -> tuple[float, np.ndarray]:
    """Sums of the cross-entropy and its gradient over the rows."""
    values = forward(x, layers)
    z = values[-1] - values[-1].max(axis=1, keepdims=True)
    log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    back = np.exp(log_p)
    back[np.arange(len(y)), y] -= 1
    grads = []
    for (w, _), h in zip(reversed(layers), reversed(values[:-1])):
        grads.append((h.T @ back, back.sum(axis=0)))
        back = (back @ w.T) * (1 - h * h)
    return float(-log_p[np.arange(len(y)), y].sum()), flat(grads[::-1])


def _part_sums(data: DataFrame, layers: Layers) -> DataFrame:
    """(part, loss, grad) of the dealt examples."""
    shared = data.sparkSession.sparkContext.broadcast(layers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = None, []

        def done():
            pdf = pd.concat(held)
            loss, grad = loss_gradient(np.stack(pdf["features"].to_list()), pdf["label"].to_numpy(np.int64), shared.value)
            return pd.DataFrame({"part": [part], "loss": [loss], "grad": [grad.tobytes()]})

        for pdf in batches:
            for p, rows in pdf.groupby("part", sort=True):  # parts come in order, one may go on
                if p != part and held:
                    yield done()
                    held = []
                part = p
                held.append(rows)
        if held:
            yield done()

    return data.select("part", "features", "label").mapInPandas(run, "part bigint, loss double, grad binary")


def _merged(sums: DataFrame, parts: int) -> tuple[float, np.ndarray]:
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        grad = np.sum([np.frombuffer(g) for g in pdf["grad"]], axis=0)
        return pd.DataFrame({"part": [pdf["part"].iloc[0] // FAN], "loss": [pdf["loss"].sum()], "grad": [grad.tobytes()]})

    while True:
        sums = sums.groupBy(F.expr(f"part div {FAN}")).applyInPandas(add, "part bigint, loss double, grad binary")
        parts = -(-parts // FAN)
        if parts <= 1:
            row = sums.collect()[0]
            return row["loss"], np.frombuffer(row["grad"])


def fit(train: DataFrame, *, id_col: str, features: str = "features", label: str = "label", hidden=(32, 32, 32),
        classes: int = 3, rounds: int = 30, rate: float = 0.01, seed: int = 42) -> Layers:
    """Full-batch Adam on the mean cross-entropy; ``train`` holds an array
    of doubles and a class code per example.  No example gives the first
    layers unchanged."""
    rows = train.select(F.col(id_col).alias("id"), F.col(features).alias("features"), F.col(label).alias("label"))
    n = rows.count()
    if not n:
        return []
    parts = -(-n // ROWS_PER_PART)
    data = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))) \
        .repartition("part").sortWithinPartitions("part", "id").persist(StorageLevel.MEMORY_AND_DISK)
    sizes = [len(data.first()["features"]), *hidden, classes]
    values = flat(first_layers(sizes, seed))
    m, v = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, rounds + 1):
        _, grad = _merged(_part_sums(data, unflat(values, sizes)), parts)
        grad = grad / n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        values = values - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    data.unpersist()
    return unflat(values, sizes)


def logits_column(spark, features: Column, layers: Layers) -> Column:
    """The class logits of a feature array."""
    shared = spark.sparkContext.broadcast(layers)

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(forward(np.stack(x.to_list()), shared.value)[-1])) if len(x) else pd.Series([], dtype=object)

    return run(features)
