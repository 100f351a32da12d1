"""Fitting on a bounded sample of labelled rows.

The sample is at most ``limit`` rows, the same share of it for each class, chosen by a hash of
doc_id: reruns agree. Only its hashed features, never the corpus, come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.textmap import SCALE, SLOTS, WordTable, hashed_ngrams, map_text

SAMPLE = 3000
#: Entries of the sample that a step computes with at a time.
PART = 1 << 18


def labelled(docs: DataFrame, labels: DataFrame, classes: int, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y, weight) of a bounded sample; ``labels`` has (doc_id, y) with y from 0 to
    ``classes`` - 1. A class of the sample weighs as many rows as it has labels. Of several rows of a
    doc_id, the text with the smallest hash counts; of several labels, the largest."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = known.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    each = limit // classes
    chosen = None
    for k in range(classes):
        some = known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        chosen = some if chosen is None else chosen.unionByName(some)
    weighted = chosen.join(F.broadcast(counts), "y").withColumn(
        "weight", F.greatest(F.lit(1.0), F.col("n") / F.lit(float(each)))
    )
    # at most `limit` rows of three numbers: small enough to send to every task
    rows = docs.select("doc_id", "text").join(F.broadcast(weighted), "doc_id")
    one = rows.groupBy("doc_id", "y", "weight").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.select("doc_id", "text", "y", "weight")


class Sample:
    """Hashed features of labelled rows as a sparse matrix; rows sorted by doc_id."""

    def __init__(self, rows: DataFrame):
        fields = [T.StructField("slots", T.BinaryType()), T.StructField("values", T.BinaryType())]

        def factory():
            table = WordTable()

            def compute(texts):
                slots, values = [], []
                for text in texts:
                    parts = [np.unique(x, return_counts=True) for x in hashed_ngrams(text, table)]
                    slots.append(np.concatenate([p[0] for p in parts]).astype("<i4").tobytes())
                    scaled = [SCALE * p[1] / max(1, p[1].sum()) for p in parts]
                    values.append(np.concatenate(scaled).astype("<f4").tobytes())
                return [pa.array(slots, pa.binary()), pa.array(values, pa.binary())]

            return compute

        found = map_text(rows, ["doc_id", "y", "weight"], fields, factory).select("doc.*", "slots", "values")
        got = sorted(found.collect(), key=lambda r: (r["doc_id"], r["y"], bytes(r["slots"])))
        self.doc_id = np.array([r["doc_id"] for r in got], np.int64)
        self.y = np.array([r["y"] for r in got], np.int64)
        self.weight = np.array([r["weight"] for r in got], float)
        self.slots = np.concatenate([np.empty(0, "<i4"), *(np.frombuffer(r["slots"], "<i4") for r in got)])
        self.values = np.concatenate([np.empty(0, "<f4"), *(np.frombuffer(r["values"], "<f4") for r in got)])
        self.row = np.repeat(np.arange(len(got), dtype=np.int32), [len(r["slots"]) // 4 for r in got])

    def _parts(self):
        """The entries in parts: numbers of 64 bits for all of them at once would multiply the driver's memory."""
        for at in range(0, len(self.row), PART):
            part = slice(at, at + PART)
            yield self.row[part], self.slots[part], self.values[part]

    def margins(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.y))
        for row, slots, values in self._parts():
            first = row[0]
            sums = np.bincount(row - first, w[slots] * values)
            out[first : first + len(sums)] += sums
        return out

    def gradient(self, per_row: np.ndarray) -> np.ndarray:
        out = np.zeros(2 * SLOTS)
        for row, slots, values in self._parts():
            out += np.bincount(slots, per_row[row] * values, 2 * SLOTS)
        return out


def adam(parameters: np.ndarray, gradient, steps: int = 120, rate: float = 0.05) -> np.ndarray:
    """Minimises by full-batch Adam; every run gives the same result."""
    m, v = np.zeros_like(parameters), np.zeros_like(parameters)
    for t in range(1, steps + 1):
        g = gradient(parameters)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        parameters = parameters - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return parameters


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) such that sigmoid(a * z + b) is the chance of y = 1; Newton steps, a little ridge."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = sigmoid(a * z + b)
        r, s = weight * (p - y), weight * p * (1 - p) + 1e-9
        g = np.array([(r * z).sum() + 1e-2 * (a - 1), r.sum() + 1e-2 * b])
        h = np.array([[(s * z * z).sum() + 1e-2, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return a, b
