"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades come from the labels: 0 low quality, 1 good but toxic, 2 good. One weight vector over hashed
n-grams is shared by all grades; ordered thresholds part them: P(grade >= k) = sigmoid(margin -
threshold k). The model learns from a bounded sample of labelled rows outside the held-out fifth.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.shared import held_out
from sparkloom.llm.textmap import SLOTS, WordTable, map_text, margin
from sparkloom.llm.training import SAMPLE, Sample, adam, labelled, sigmoid

GRADES = 3
#: A text is selected whose chance of grade 1 or more is at least this.
SELECT = 0.3


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, y) with the grade of each fully labelled row."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", grade.alias("y"))


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds); thresholds rise. Without labels all grades are equally likely."""
    learn = grades(labels).where(~held_out(F.col("doc_id")))
    sample = Sample(labelled(docs, learn, GRADES, limit))
    if not len(sample.y):
        return np.zeros(2 * SLOTS, np.float32), np.log([0.5, 2.0])
    weight = sample.weight / sample.weight.sum()

    def thresholds(p):
        return np.cumsum(np.append(p[0], np.exp(p[1:])))

    def gradient(p):
        z, cut = sample.margins(p[: 2 * SLOTS]), thresholds(p[2 * SLOTS :])
        over = sigmoid(z[:, None] - np.concatenate([[-60], cut, [60]]))
        k = np.arange(len(z))
        low, high = over[k, sample.y], over[k, sample.y + 1]
        chance = np.maximum(low - high, 1e-9)
        dz = -weight * (1 - low - high)
        dcut = np.zeros(GRADES - 1)
        np.add.at(dcut, np.clip(sample.y - 1, 0, None), np.where(sample.y > 0, weight * low * (1 - low) / chance, 0))
        np.add.at(dcut, np.clip(sample.y, None, GRADES - 2), np.where(sample.y < GRADES - 1, -weight * high * (1 - high) / chance, 0))
        back = np.cumsum(dcut[::-1])[::-1].copy()
        back[1:] *= np.exp(p[2 * SLOTS + 1 :])
        return np.append(sample.gradient(dz) + 1e-6 * p[: 2 * SLOTS], back)

    p = adam(np.append(np.zeros(2 * SLOTS), [-2.0, 0.5]), gradient)
    return p[: 2 * SLOTS].astype(np.float32), thresholds(p[2 * SLOTS :])


FIELDS = [
    T.StructField("expected_grade", T.DoubleType()),
    T.StructField("tail_probability", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
]


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, limit: int = SAMPLE) -> DataFrame:
    """``docs`` (columns ``keep`` as the struct ``doc``) with the expected grade, the chance of grade
    1 or more, and whether that selects the text. Null and empty texts score as texts without n-grams, equal texts,
    repeated rows among them, alike. Works on empty tables of documents or labels."""
    weights, cut = train(docs, labels, limit)

    def factory():
        table = WordTable()

        def compute(texts):
            z = np.array([margin(weights, t, table) for t in texts], float)
            over = sigmoid(z[:, None] - cut)
            return [over.sum(axis=1), over[:, 0], over[:, 0] >= SELECT]

        return compute

    return map_text(docs, keep or docs.columns, FIELDS, factory)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = classify(docs, labels, ["doc_id"])
    return found.select(
        "doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "expected_grade", "tail_probability", "kept"
    )
