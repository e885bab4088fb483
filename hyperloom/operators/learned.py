"""A learned code-length model: a small network predicts an edge's symbol from its features.

The symbol is the predicate's stable bucket; the probabilities that the network
gives are what the code would cost. Training is mini-batch gradient descent with
adaptive moments: a batch is a share of the rows by hash, its gradient is added
up over partitions and vectors of sums go up a tree, so rows never leave their
tasks. Weights (about 110,000 numbers) are the only thing sent.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entropy
from ..model import checkpoint

#: Symbols, features, and layers between them.
SYMBOLS, FEATURES, HIDDEN = 256, 64, (128, 256, 128)
DROPOUT, RATE, FAN_IN = 0.1, 1e-3, 64
#: The optimiser's decay rates and its least divisor.
BETA1, BETA2, LEAST = 0.9, 0.999, 1e-8


def examples(edges: DataFrame, symbols: int = SYMBOLS, features: int = FEATURES) -> DataFrame:
    """edge_id, x, y: eight structural features, then hashed attribute types as indicators; the predicate's bucket."""
    have = F.transform(F.col("attr_types"), lambda a: entropy.stable_bucket(a, features - 8))
    hashed = F.transform(F.sequence(F.lit(0), F.lit(features - 9)), lambda k: F.when(F.array_contains(have, k), 1.0).otherwise(0.0))
    return edges.select("edge_id", F.concat(entropy.edge_features(), hashed).alias("x"), entropy.stable_bucket(F.col("predicate"), symbols).alias("y"))


class Network:
    """Layers with rectifiers between them and probabilities at the end; dropout while it learns."""

    def __init__(self, sizes: tuple[int, ...] = (FEATURES, *HIDDEN, SYMBOLS), temperature: float = 1.0, seed: int = 42):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.sizes, self.temperature = sizes, temperature
        self.weights = [x for a, b in zip(sizes[:-1], sizes[1:], strict=True) for x in (rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b))]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.reshape(-1) for w in self.weights])

    def load(self, flat: np.ndarray) -> None:
        at, out = 0, []
        for w in self.weights:
            out.append(flat[at : at + w.size].reshape(w.shape))
            at += w.size
        self.weights = out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x, None)[0]

    def _forward(self, x: np.ndarray, rng: np.random.Generator | None) -> tuple[np.ndarray, list]:
        kept = []
        for k in range(0, len(self.weights), 2):
            kept.append(x)
            x = x @ self.weights[k] + self.weights[k + 1]
            if k + 2 < len(self.weights):
                x = np.maximum(x, 0)
                if rng is not None:
                    x = x * (rng.random(x.shape) >= DROPOUT) / (1 - DROPOUT)
        z = x / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), kept

    def gradient(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator | None = None) -> tuple[float, np.ndarray]:
        """Sum of the code lengths (natural log) and of their gradients over rows."""
        p, kept = self._forward(x, rng)
        loss = float(-np.log(p[np.arange(len(y)), y] + 1e-10).sum())
        back, out = p.copy(), []
        back[np.arange(len(y)), y] -= 1
        back /= self.temperature
        for k in range(len(self.weights) - 2, -1, -2):
            below = kept[k // 2]
            out[:0] = [below.T @ back, back.sum(axis=0)]
            if k:
                back = (back @ self.weights[k].T) * (below > 0)
                if rng is not None:
                    back /= 1 - DROPOUT
        return loss, np.concatenate([g.reshape(-1) for g in out])


class Compressor:
    """The network with its optimiser and the loss of every epoch."""

    def __init__(self, network: Network | None = None, rate: float = RATE):
        self.network, self.rate, self.steps = network or Network(), rate, 0
        self.mean, self.spread = np.zeros(len(self.network.flat())), np.zeros(len(self.network.flat()))
        self.loss_history: list[float] = []

    def _rows(self, edges: DataFrame) -> DataFrame:
        return examples(edges, self.network.sizes[-1], self.network.sizes[0])

    def step(self, rows: DataFrame, tasks: int = 1 << 30) -> float:
        """One step on rows(x, y): their mean code length before it. No rows: nothing happens."""
        net = rows.sparkSession.sparkContext.broadcast((self.network, self.steps))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            network, turn = net.value
            rng, total = np.random.Generator(np.random.PCG64(turn)), None
            for batch in batches:
                if batch.num_rows:
                    x = np.asarray(batch.column("x").flatten(), float).reshape(batch.num_rows, -1)
                    loss, grad = network.gradient(x, np.asarray(batch.column("y")), rng)
                    own = np.concatenate(([batch.num_rows, loss], grad))
                    total = own if total is None else total + own
            if total is not None:
                yield _row(total)

        got = rows.mapInArrow(run, "v binary")
        n = min(tasks, rows.rdd.getNumPartitions())
        while n > FAN_IN:
            n = -(-n // FAN_IN)
            got = got.repartition(n).mapInArrow(_add, "v binary")
        parts = [np.frombuffer(r["v"]) for r in got.collect()]  # FAN_IN rows at most
        net.destroy()
        if not parts:
            return 0.0
        total = sum(parts)
        grad = total[2:] / total[0]
        self.steps += 1
        self.mean = BETA1 * self.mean + (1 - BETA1) * grad
        self.spread = BETA2 * self.spread + (1 - BETA2) * grad**2
        move = self.mean / (1 - BETA1**self.steps) / (np.sqrt(self.spread / (1 - BETA2**self.steps)) + LEAST)
        self.network.load(self.network.flat() - self.rate * move)
        return float(total[1] / total[0])

    def train(self, edges: DataFrame, epochs: int = 1, batches: int = 8) -> list[float]:
        """Mean loss of each epoch; an epoch is a step on each of ``batches`` shares of the rows by hash of their id."""
        rows = checkpoint(self._rows(edges).withColumn("batch", F.pmod(F.xxhash64("edge_id"), F.lit(batches))))
        out = []
        for _ in range(epochs):
            losses = [self.step(rows.filter(F.col("batch") == b).select("x", "y")) for b in range(batches)]
            out.append(sum(losses) / max(1, len(losses)))
        self.loss_history += out
        return out

    def costs(self, edges: DataFrame) -> DataFrame:
        """edge_id, expected_bits, bits: what the model expects, and what the edge's symbol costs."""
        net = edges.sparkSession.sparkContext.broadcast(self.network)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.asarray(batch.column("x").flatten(), float).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, net.value.sizes[0]))
                p = net.value.probabilities(x)
                expected = -(p * np.log2(p + 1e-10)).sum(axis=1)
                own = -np.log2(p[np.arange(len(p)), np.asarray(batch.column("y"))] + 1e-10)
                yield pa.RecordBatch.from_arrays([batch.column("edge_id"), pa.array(expected), pa.array(own)], names=["edge_id", "expected_bits", "bits"])

        return self._rows(edges).mapInArrow(run, "edge_id string, expected_bits double, bits double")

    def evaluate(self, edges: DataFrame) -> DataFrame:
        return evaluate(self.costs(edges))

    def report(self, edges: DataFrame) -> str:
        r = self.evaluate(edges).first()
        last = ", ".join(f"{x:.4f}" for x in self.loss_history[-5:])
        return "\n".join(["Learned code lengths", f"  edges: {r['edges']}", f"  bits a symbol: {r['avg_bits'] or 0:.4f}", f"  ratio against 8 bits: {r['ratio'] or 0:.2f}x", f"  last losses: [{last}]"])


def _row(v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v.astype(float).tobytes()], pa.binary())], names=["v"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column("v"):
            own = np.frombuffer(x.as_buffer())
            total = own if total is None else total + own
    if total is not None:
        yield _row(total)


def fit(edges: DataFrame, epochs: int = 3, batches: int = 8, sizes: tuple[int, ...] = (FEATURES, *HIDDEN, SYMBOLS), rate: float = RATE, seed: int = 42) -> Compressor:
    c = Compressor(Network(sizes, seed=seed), rate)
    c.train(edges, epochs, batches)
    return c


def evaluate(costs: DataFrame) -> DataFrame:
    """edges, avg_bits, min_bits, max_bits, ratio against 8 bits."""
    b = F.avg("bits")
    return costs.agg(F.count("*").alias("edges"), b.alias("avg_bits"), F.min("bits").alias("min_bits"), F.max("bits").alias("max_bits"), entropy.expected_ratio(b).alias("ratio"))


def save(c: Compressor, spark: SparkSession, path: str) -> None:
    """Weights, optimiser state and losses as one row of Parquet."""
    out = io.BytesIO()
    np.savez(out, sizes=np.array(c.network.sizes), flat=c.network.flat(), mean=c.mean, spread=c.spread, other=np.array([c.network.temperature, c.rate, c.steps]), losses=np.array(c.loss_history))
    spark.createDataFrame([(bytearray(out.getvalue()),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Compressor:
    x = np.load(io.BytesIO(spark.read.parquet(path).first()["model"]))
    c = Compressor(Network(tuple(x["sizes"].tolist()), float(x["other"][0])), float(x["other"][1]))
    c.network.load(x["flat"])
    c.mean, c.spread, c.steps, c.loss_history = x["mean"], x["spread"], int(x["other"][2]), x["losses"].tolist()
    return c
