"""Quality rules: base counts, and a calibrated logistic regression over hashed n-grams.

The regression learns the labels' quality from a bounded sample (``limit`` rows) of hashed word
and character n-grams; a fifth of the sample is kept apart and calibrates its probabilities
(Platt). Texts are scored in Arrow batches against the fixed threshold ``KEEP``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.textmap import SLOTS, WordTable, map_text, margin, windows
from sparkloom.llm.training import SAMPLE, Sample, adam, labelled, platt, sigmoid

LEAST_WORDS, MOST_REPEATED = 50, 50
#: A text stays whose chance of being good is at least this.
KEEP = 0.2
SYMBOLS = b"#*$%&|<>"


def base_counts(text: str | None, table: WordTable) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text; null has no words.

    A line repeats when it has a word and equals an earlier line. A word repeats when it stands
    in a run of three words that the text holds more than once; runs are compared by a 64-bit hash.
    """
    raw = (text or "").encode()
    words = raw.split()
    chars = len(raw) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    if not raw.isascii():
        b = np.frombuffer(raw, np.uint8)
        chars -= int(((b & 0xC0) == 0x80).sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > 3:
        runs = windows(table.of(words), 3)
        _, back, n = np.unique(runs, return_inverse=True, return_counts=True)
        twice = (n > 1)[back]
        if twice.any():
            marked = np.zeros(len(words), bool)
            for k in range(3):
                marked[k : len(runs) + k] |= twice
            repeated = int(marked.sum())
    return len(words), chars, sum(raw.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[np.ndarray, float, float] | None:
    """(weights, a, b): sigmoid(a * margin + b) is the chance of quality 1. None where the labels
    do not show both classes: then only the base rules decide."""
    sample = Sample(labelled(docs, labels.select("doc_id", F.col("quality").alias("y")), 2, limit))
    part = sample.doc_id % 5 == 0
    if len(set(sample.y[~part])) < 2 or len(set(sample.y[part])) < 2:
        return None
    weight = np.where(part, 0, sample.weight) / sample.weight[~part].sum()

    def gradient(w):
        error = weight * (sigmoid(sample.margins(w[:-1]) + w[-1]) - sample.y)
        return np.append(sample.gradient(error) + 1e-6 * w[:-1], error.sum())

    w = adam(np.zeros(2 * SLOTS + 1), gradient)
    z = sample.margins(w[:-1]) + w[-1]
    a, b = platt(z[part], sample.y[part], sample.weight[part])
    return w[:-1].astype(np.float32), a, a * w[-1] + b


FIELDS = [
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("p_good", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
]


def apply_rules(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, limit: int = SAMPLE) -> DataFrame:
    """``docs`` (columns ``keep`` as the struct ``doc``) with the counts, p_good and the verdict.

    Null and empty texts have no words and fail the base rules. Repeated rows and rows of equal text
    get equal verdicts. Works on empty tables; without labels of both classes the base rules decide.
    """
    model = train(docs, labels, limit)

    def factory():
        table = WordTable()

        def compute(texts):
            base = np.array([base_counts(t, table) for t in texts], np.int64).reshape(-1, 5)
            failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
            if model is None:
                good = np.ones(len(texts))
            else:
                w, a, b = model
                good = sigmoid(a * np.array([margin(w, t, table) for t in texts], float) + b)
            return [*base.T, failed, good, ~failed & (good >= KEEP)]

        return compute

    return map_text(docs, keep or docs.columns, FIELDS, factory)


def passing(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    return apply_rules(docs, labels, None, limit).where("kept").select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    found = apply_rules(docs, labels, ["doc_id"])
    return found.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )
