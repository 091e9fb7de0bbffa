"""What the trained operators share: the follow-the-regularised-leader learner and the bounded
sample of labelled rows it learns from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Ftrl:
    """Per-coordinate follow-the-regularised-leader (proximal) over a fixed number of weights, none under least."""

    def __init__(self, size: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0, least: float = -np.inf):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2, self.least = alpha, beta, l1, l2, least

    def weights(self, idx: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.maximum(np.where(np.abs(z) <= self.l1, 0.0, w), self.least)

    def update(self, idx: np.ndarray, grad: np.ndarray, w: np.ndarray) -> None:
        """idx has no repeats; w are the weights that made grad."""
        n = self.n[idx]
        more = n + grad * grad
        self.z[idx] += grad - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[idx] = more


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int) -> DataFrame:
    """text and label (0 or 1) of at most per_class rows of each class, chosen and ordered by a hash
    of doc_id, in one partition.

    usable is a condition on doc_id: rows that it rejects are never read as examples. Only the
    chosen identifiers, at most twice per_class rows, are broadcast. Of rows with equal
    identifiers the smallest text is taken, so that training can be repeated.
    """
    h = F.xxhash64(F.col("doc_id").cast("string"))
    own = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.max((F.col(label) != 0).cast("int")).alias("y"))
        .withColumn("h", h)
    )
    chosen = own.where("y = 0").orderBy("h").limit(per_class).unionAll(own.where("y = 1").orderBy("h").limit(per_class))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "h", "y").agg(F.min("text").alias("text"))
    return texts.select("h", "text", "y").coalesce(1).sortWithinPartitions("h", "text")
