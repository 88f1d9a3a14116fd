"""Networks whose synapses are a table (``src``, ``dst``, ``w``): no biases, ReLU between layers, linear output."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from triplewright.storage import small_rows


def forward(synapses: DataFrame, inputs: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """Activations (``sample``, ``node``, ``value``) of the last layer, by one join and one aggregation a layer.

    ``inputs`` has the first layer's (``sample``, ``node``, ``value``);
    ``layers`` the nodes (``node``) of the others.  A node without synapses
    from the layer before is 0 for every sample.
    """
    now, samples = inputs, inputs.select("sample").distinct()
    for k, layer in enumerate(layers):
        into = synapses.join(layer.select(F.col("node").alias("dst")), "dst", "left_semi")
        sums = now.join(into, now["node"] == into["src"]).groupBy("sample", "dst").agg(F.sum(F.col("value") * F.col("w")).alias("value"))
        every = samples.crossJoin(layer.select(F.col("node").alias("dst")).distinct())
        now = every.join(sums, ["sample", "dst"], "left").select("sample", F.col("dst").alias("node"), F.coalesce("value", F.lit(0.0)).alias("value"))
        if k + 1 < len(layers):
            now = now.withColumn("value", F.greatest("value", F.lit(0.0)))
    return now


def connect(spark: SparkSession, synapses: DataFrame, sources: list[str], targets: list[str], scale: float = 0.5, seed: int = 0) -> DataFrame:
    """All missing synapses between two layers, with seeded weights in ``[-scale, scale]``; those that exist stay."""
    rng = np.random.default_rng(seed)
    wanted = [(a, b, float(rng.uniform(-scale, scale))) for a in sources for b in targets]
    new = small_rows(spark, wanted, "src string, dst string, w double")
    return synapses.unionByName(new.join(synapses.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "w"))


def set_weight(synapses: DataFrame, src: str, dst: str, w: float) -> DataFrame:
    one = small_rows(synapses.sparkSession, [(src, dst, float(w))], "src string, dst string, w double")
    return synapses.where(~((F.col("src") == src) & (F.col("dst") == dst))).unionByName(one)


def weight(synapses: DataFrame, src: str, dst: str) -> float | None:
    r = synapses.where((F.col("src") == src) & (F.col("dst") == dst)).select("w").first()
    return r["w"] if r else None


class Compiled:
    """A network as masked matrices, for training; layers are lists of nodes, taken in order."""

    def __init__(self, synapses: DataFrame, layers: list[list[str]]):
        self.layers = [sorted(x) for x in layers]
        at = [{n: k for k, n in enumerate(x)} for x in self.layers]
        self.weights = [np.zeros((len(a), len(b))) for a, b in zip(self.layers, self.layers[1:])]
        self.masks = [np.zeros_like(w) for w in self.weights]
        names = sorted({n for x in self.layers for n in x})
        for r in synapses.where(F.col("src").isin(names) & F.col("dst").isin(names)).collect():
            for k, (a, b) in enumerate(zip(at, at[1:])):
                if r["src"] in a and r["dst"] in b:
                    self.weights[k][a[r["src"]], b[r["dst"]]] = r["w"]
                    self.masks[k][a[r["src"]], b[r["dst"]]] = 1

    def evaluate(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for k, w in enumerate(self.weights):
            z = out[-1] @ w
            out.append(np.maximum(z, 0) if k + 1 < len(self.weights) else z)
        return out

    def train(self, x: np.ndarray, y: np.ndarray, rate: float) -> float:
        """One step for one sample; half the squared error before it.  Only existing synapses change."""
        out = self.evaluate(x)
        error = out[-1] - y
        delta = error
        for k in range(len(self.weights) - 1, -1, -1):
            grad = np.outer(out[k], delta) * self.masks[k]
            delta = (self.weights[k] @ delta) * (out[k] > 0)
            self.weights[k] -= rate * grad
        return float(0.5 * (error**2).sum())

    def one_hot(self, layer: int, node: str) -> np.ndarray:
        return (np.array(self.layers[layer]) == node).astype(float)

    def train_nodes(self, source: str, target: str, rate: float) -> float:
        return self.train(self.one_hot(0, source), self.one_hot(-1, target), rate)

    def best(self, source: str, k: int) -> list[tuple[str, float]]:
        """The ``k`` nodes of the last layer with the highest value for an input node."""
        values = self.evaluate(self.one_hot(0, source))[-1]
        order = sorted(range(len(values)), key=lambda i: (-values[i], self.layers[-1][i]))[:k]
        return [(self.layers[-1][i], float(values[i])) for i in order]

    def synapses(self, spark: SparkSession) -> DataFrame:
        """The weights as a table."""
        rows = [(a, b, float(w[i, j])) for x, y, w, m in zip(self.layers, self.layers[1:], self.weights, self.masks) for i, a in enumerate(x) for j, b in enumerate(y) if m[i, j]]
        return small_rows(spark, rows, "src string, dst string, w double")

    def scores(self, spark: SparkSession) -> DataFrame:
        """(``s``, ``o``, ``score``) of every input node and output node, for conditions on the network in rules."""
        rows = [(a, b, float(np.clip(v, 0, 1))) for a in self.layers[0] for b, v in zip(self.layers[-1], self.evaluate(self.one_hot(0, a))[-1])]
        return small_rows(spark, rows, "s string, o string, score double")


def link_predictor(spark: SparkSession, edges: DataFrame, hidden: int = 8, epochs: int = 150, rate: float = 0.2, seed: int = 0, most: int = 100_000) -> tuple[Compiled, float]:
    """A network from subjects to objects of one predicate, trained on its edges; and the last epoch's mean loss.

    Steps follow each other, so edges are trained on the driver; more than
    ``most`` raise.
    """
    rows = edges.select("s", "o").distinct().orderBy("s", "o").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges")
    sources, targets = sorted({r["s"] for r in rows}), sorted({r["o"] for r in rows})
    middle = [f"hidden/{k:04d}" for k in range(hidden)]
    table = small_rows(spark, [], "src string, dst string, w double")
    table = connect(spark, connect(spark, table, sources, middle, seed=seed), middle, targets, seed=seed + 1)
    net, loss, rng = Compiled(table, [sources, middle, targets]), 0.0, np.random.default_rng(seed)
    for _ in range(epochs):
        loss = float(np.mean([net.train_nodes(rows[k]["s"], rows[k]["o"], rate) for k in rng.permutation(len(rows))])) if rows else 0.0
    return net, loss
