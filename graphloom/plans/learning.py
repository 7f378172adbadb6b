"""A softmax classifier on fixed features: trained per node, scored in batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import ModelMismatch
from graphloom.functions.scalar import argmax, softmax

WEIGHTS = "map<string,array<float>>"


class Learner(Protocol):
    """What a learning algorithm offers to the rounds."""

    def train(self, data: DataFrame, weights: dict[str, list[float]] | DataFrame | None, round_no: int) -> DataFrame: ...

    def predict(self, data: DataFrame, weights: dict[str, list[float]] | DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class SoftmaxRegression:
    """Linear layer and softmax by batch gradient descent; data has node, features and category."""

    categories: Sequence[str]
    epochs: int = 50
    rate: float = 0.1

    def train(self, data: DataFrame, weights: dict[str, list[float]] | DataFrame | None, round_no: int) -> DataFrame:
        """node, weights and round; a node's rows are trained on together, rows of unknown categories are left out.

        Weights are one model for all nodes or a table of node and weights; nodes that it lacks start from none.
        """
        place = {c: i for i, c in enumerate(self.categories)}
        epochs, rate, k = self.epochs, self.rate, len(self.categories)

        def fit(rows: pd.DataFrame, weights: dict[str, list[float]] | None) -> pd.DataFrame:
            x = np.stack(rows["features"].to_numpy()).astype("f8")
            y = np.eye(k)[rows["category"].map(place).to_numpy()]
            w = np.zeros((x.shape[1], k)) if weights is None else np.array(weights["weight"], "f8").reshape(-1, k)
            b = np.zeros(k) if weights is None else np.array(weights["bias"], "f8")
            for _ in range(epochs):
                z = x @ w + b
                p = np.exp(z - z.max(1, keepdims=True))
                g = (p / p.sum(1, keepdims=True) - y) / len(x)
                w -= rate * (x.T @ g)
                b -= rate * g.sum(0)
            layers = {"weight": w.ravel().astype("f4").tolist(), "bias": b.astype("f4").tolist()}
            return pd.DataFrame({"node": [rows["node"].iloc[0]], "weights": [layers], "round": [round_no]})

        node = dict(data.dtypes)["node"]
        known = data.where(F.col("category").isin(list(self.categories)) & F.col("features").isNotNull())
        rows, schema = known.select("node", "features", "category").groupBy("node"), f"node {node}, weights {WEIGHTS}, round bigint"
        if not isinstance(weights, DataFrame):
            return rows.applyInPandas(lambda rows: fit(rows, weights), schema)

        def fit_own(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if rows.empty:
                return pd.DataFrame({"node": [], "weights": [], "round": []})
            return fit(rows, None if own.empty else dict(zip(own["layer"], own["values"], strict=True)))

        layers = weights.select("node", F.explode("weights").alias("layer", "values"))
        return rows.cogroup(layers.groupBy("node")).applyInPandas(fit_own, schema)

    def logits(self, features: Column, weights: dict[str, list[float]]) -> Column:
        """The classes' logits as expressions: one dot product each, so scoring stays in the JVM."""
        k = len(self.categories)
        w = np.array(weights["weight"], "f8").reshape(-1, k)

        def dot(column: np.ndarray, bias: float) -> Column:
            pairs = F.zip_with(features, F.lit(column.tolist()), lambda a, c: a.cast("double") * c)
            return F.aggregate(pairs, F.lit(float(bias)), lambda acc, v: acc + v)

        return F.array(*[dot(w[:, i], weights["bias"][i]) for i in range(k)])

    def own_logits(self, features: Column, weights: Column) -> Column:
        """The classes' logits by the weights of each row."""
        k, w = len(self.categories), weights["weight"]

        def dot(i: int) -> Column:
            pairs = F.transform(features, lambda a, j: a.cast("double") * F.get(w, j * k + i))
            return F.aggregate(pairs, F.get(weights["bias"], F.lit(i)).cast("double"), lambda acc, v: acc + v)

        return F.array(*[dot(i) for i in range(k)])

    def predict(self, data: DataFrame, weights: dict[str, list[float]] | DataFrame) -> DataFrame:
        """data with predicted and prob, where any class has a probability above 0; by one model, or by a table of node and weights."""
        if isinstance(weights, DataFrame):
            joined = data.join(weights.select("node", F.col("weights").alias("_w")), "node")
            scored = joined.withColumn("_p", softmax(self.own_logits(F.col("features"), F.col("_w"))))
        else:
            scored = data.withColumn("_p", softmax(self.logits(F.col("features"), weights)))
        named = F.get(F.lit(list(self.categories)), argmax(F.col("_p")).cast("int"))
        return scored.select(*data.columns, named.alias("predicted"), F.array_max("_p").alias("prob")).where("prob > 0")

    def evaluate(self, data: DataFrame, weights: dict[str, list[float]] | DataFrame) -> DataFrame:
        """node, value (accuracy) and size of each node's data."""
        return self.predict(data, weights).groupBy("node").agg(
            F.avg((F.col("predicted") == F.col("category")).cast("double")).alias("value"), F.count(F.lit(1)).alias("size")
        )


LEARNERS: dict[str, Callable[..., Learner]] = {"softmax": SoftmaxRegression}


def as_layers(weights: DataFrame) -> dict[str, list[float]]:
    """The one model of a table, an error if its models differ; a model is a few layers, so it may come to the driver."""
    if weights.select(F.to_json("weights")).distinct().limit(2).count() > 1:
        raise ModelMismatch("more than one model")
    return {k: list(v) for k, v in weights.select("weights").first()["weights"].items()}


def save_model(weights: DataFrame, path: str, task: str, round_no: int) -> None:
    """One row in the task's and round's folder, in place of an earlier one."""
    long = weights.select(F.explode("weights").alias("layer", "values"))
    long.write.mode("overwrite").parquet(f"{path}/task={task}/round={round_no}")


def load_model(df: DataFrame) -> dict[str, list[float]]:
    return {r["layer"]: list(r["values"]) for r in df.select("layer", "values").toLocalIterator()}
