"""Bounded samples of labelled texts, and the optimiser that the small models share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int, max_chars: int = 20_000, seed: str = "sample") -> list[tuple[str, str]]:
    """At most 2 * per_label texts of each label, as (label, text), for fitting on the driver.

    labels: (doc_id, label). All labels are learned; which rows are taken depends on a hash of their id alone. Texts of
    more than max_chars characters are not learned from, only scored, so that the sample is bounded in bytes too. A
    document with several labels has the largest; an id that stands on several texts teaches by one, that of the smallest
    hash.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = one.groupBy("label").agg(F.count("*").alias("size"))
    n_labels = sizes.count()
    if not n_labels:
        return []
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(1_000_000))
    chosen = one.join(sizes, "label").where(unit < F.floor(1_000_000 * F.least(F.lit(1.0), per_label / F.col("size"))))
    some = chosen.select("doc_id", "label").limit(2 * per_label * n_labels)
    # the sample's size is a parameter, so it may be broadcast
    texts = docs.select(F.col("doc_id").alias("_d"), "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    found = texts.join(F.broadcast(some), F.col("_d") == F.col("doc_id")).groupBy("doc_id", F.col("label").cast("string").alias("label"))
    # the first by hash, taken in each task before anything moves
    found = found.agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
    return [(r["label"], r["first"]["text"]) for r in sorted(found.collect(), key=lambda r: r["doc_id"])]


class Adam:
    """Adam over a dict of arrays, updated in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01, decay: float = 1e-5):
        self.params, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            g = g + self.decay * self.params[k]
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            fast = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
            self.params[k] -= (fast * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(self.params[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
