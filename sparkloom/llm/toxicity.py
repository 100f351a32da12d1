"""Toxicity: gradient-boosted trees over dense features of a text, isotonically calibrated.

Features: densities of a lexicon, proximity of its words to second-person words, capitals,
punctuation, obfuscated words. The lexicon is learned: the words whose log-odds between toxic and
other training texts are high. Trees and calibration learn from two parts of a bounded sample of
labelled rows outside the held-out fifth; neither label, lang, source nor doc_id is a feature.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.shared import held_out
from sparkloom.llm.textmap import WordTable, map_text
from sparkloom.llm.training import labelled, sigmoid

SAMPLE = 8000
LEXICON_WORDS, STRONG = 200, 40
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
NEAR = 5
#: Words of a block; a feature counts the blocks with a strong word.
BLOCK = 20

#: Words of address in the corpus's languages.
SECOND_PERSON = frozenset(
    "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre vos tú ti usted ustedes tus su".split()
)
#: What stands for a letter in obfuscated words.
LEET = str.maketrans("013457@$!", "oieastasi")
EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?[]^_`{|}~¡¿«»…“”’"
OBFUSCATED = re.compile(r"[^\W\d_][@$!*013457]+[^\W\d_]")


def plain(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(EDGES)


def undone(word: str) -> str:
    """An obfuscated word with its stand-ins turned back."""
    return word.translate(LEET).replace("*", "").replace(".", "").replace("-", "")


def lexicon(rows: DataFrame, size: int = LEXICON_WORDS) -> dict[str, float]:
    """The ``size`` words with the highest smoothed log-odds of standing in a toxic text.

    Counted over the bounded sample; each text counts a word once."""
    words = F.transform(
        F.array_distinct(F.split(F.lower(F.col("text")), r"[^\p{L}]+")), lambda w: F.when(F.length(w) >= 3, w)
    )
    seen = rows.select("y", F.explode(words).alias("word")).where("word IS NOT NULL")
    total = rows.agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, n = total["t"] or 0, total["n"]
    if not toxic or toxic == n:
        return {}
    counts = seen.groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where("a >= 3")
    odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 0.5) / (n - toxic + 1.0))
    best = counts.withColumn("odds", odds).where("odds > 0.7").orderBy(F.desc(F.col("odds") * F.sqrt("a")), "word").limit(size)
    return {r["word"]: float(r["odds"]) for r in best.collect()}


#: Bits of what a word is: 0-1 lexicon tier, 2 second person, 3 obfuscated, 4 all capitals.
TIER, SECOND, HIDDEN, SHOUTED = 3, 4, 8, 16
FEATURES = 13


def coder(odds: dict[str, float]):
    ranked = sorted(odds, key=lambda w: -odds[w])
    tier = {w: 2 if k < STRONG else 1 for k, w in enumerate(ranked)}

    def code(word: bytes) -> int:
        text = plain(word)
        bare = undone(text)
        out = max(tier.get(text, 0), tier.get(bare, 0))
        if text in SECOND_PERSON:
            out |= SECOND
        if OBFUSCATED.search(text):
            out |= HIDDEN
        letters = word.decode("utf-8", "replace")
        if len(letters) > 2 and letters.isupper():
            out |= SHOUTED
        return out

    return code


def dense(text: str | None, table: WordTable) -> list[float]:
    """The features of a whole text; a null or empty one has zeros."""
    raw = (text or "").encode()
    codes = table.of(raw.split())
    n = max(1, len(codes))
    tier = codes & TIER
    hits, strong = tier > 0, tier == 2
    second = (codes & SECOND) > 0
    near = 0
    if hits.any() and second.any():
        reach = np.convolve(second, np.ones(2 * NEAR + 1), "full")[NEAR : NEAR + len(codes)] > 0
        near = int((hits & reach).sum())
    hidden = (codes & HIDDEN) > 0
    size = max(1, len(raw))
    upper = sum(c.isupper() for c in text) if text and not text.islower() else 0
    return [
        hits.sum() / n, strong.sum() / n, float(hits.sum()), float(strong.sum()),
        float(len(np.unique(np.flatnonzero(strong) // BLOCK))), near / n, second.sum() / n,
        upper / size, ((codes & SHOUTED) > 0).sum() / n, (raw.count(b"!") + raw.count(b"?")) / size,
        (raw.count(b".") + raw.count(b",")) / size, hidden.sum() / n, float(np.log1p(len(codes))),
    ]


def boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """(cuts, trees): histogram trees of depth ``DEPTH`` on the logistic loss. A tree is an array of
    (feature, bin) for its inner nodes, level by level, and its leaves' values."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    b = binned(x, cuts)
    z, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = sigmoid(z)
        g, h = weight * (p - y), weight * p * (1 - p)
        node, inner = np.zeros(len(y), np.int64), []
        for level in range(DEPTH):
            count = 1 << level
            score = np.full((count, x.shape[1], BINS), -np.inf)
            for f in range(x.shape[1]):
                at = node * BINS + b[:, f]
                gs = np.bincount(at, g, count * BINS).reshape(count, BINS)
                hs = np.bincount(at, h, count * BINS).reshape(count, BINS)
                gl, hl, gt, ht = gs.cumsum(1), hs.cumsum(1), gs.sum(1)[:, None], hs.sum(1)[:, None]
                score[:, f] = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1)
            best = score.reshape(count, -1).argmax(1)
            split = np.stack([best // BINS, best % BINS], 1)
            inner.append(split)
            node = 2 * node + (b[np.arange(len(y)), split[node, 0]] > split[node, 1])
        leaf = -RATE * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + 1)
        z += leaf[node]
        trees.append((inner, leaf))
    return cuts, trees


def binned(x: np.ndarray, cuts) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)], 1)


def raw_scores(x: np.ndarray, model) -> np.ndarray:
    cuts, trees = model
    b, rows = binned(x, cuts), np.arange(len(x))
    z = np.zeros(len(x))
    for inner, leaf in trees:
        node = np.zeros(len(x), np.int64)
        for split in inner:
            node = 2 * node + (b[rows, split[node, 0]] > split[node, 1])
        z += leaf[node]
    return z


def isotonic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y (pool adjacent violators)."""
    order = np.lexsort((y, z))
    blocks: list[list[float]] = []
    for a, b, w in zip(z[order], y[order], weight[order], strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE):
    """(lexicon, trees, knots) or None where the training labels don't show both classes. A quarter of
    the sample, chosen by a hash of doc_id, calibrates; lexicon and trees don't see it."""
    learn = labels.select("doc_id", F.col("toxic").alias("y")).where(~held_out(F.col("doc_id")))
    apart = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(4)) == 0
    rows = labelled(docs, learn, 2, limit).withColumn("apart", apart).cache()  # a bounded sample that two passes read
    odds = lexicon(rows.where("NOT apart"))
    fields = [T.StructField("x", T.ArrayType(T.DoubleType()))]

    def factory():
        table = WordTable(coder(odds), np.int64)
        return lambda texts: [[dense(t, table) for t in texts]]

    got = map_text(rows, ["doc_id", "y", "weight", "apart"], fields, factory).select("doc.*", "x").collect()
    rows.unpersist()
    got = sorted(got, key=lambda r: (r["doc_id"], r["x"]))
    if len({r["y"] for r in got}) < 2:
        return None
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)
    weight = np.array([r["weight"] for r in got], float)
    part = np.array([r["apart"] for r in got])
    if len(set(y[part])) < 2 or len(set(y[~part])) < 2:  # too few rows to set some apart
        order = np.argsort(y, kind="stable")
        part = np.zeros(len(y), bool)
        part[order[::2]] = True
        if len(set(y[part])) < 2 or len(set(y[~part])) < 2:
            model = boosted(x, y, weight / weight.mean())
            return odds, model, isotonic(raw_scores(x, model), y, weight)
    weight /= weight.mean()
    model = boosted(x[~part], y[~part], weight[~part])
    return odds, model, isotonic(raw_scores(x[part], model), y[part], weight[part])


FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def score(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, limit: int = SAMPLE) -> DataFrame:
    """``docs`` (columns ``keep`` as the struct ``doc``) with the calibrated chance of toxicity and
    whether it is at least 0.5. Null and empty texts get the score of texts without words, equal texts
    equal scores, whatever their other columns. Without labels of both classes all scores are 0. Works
    on empty tables."""
    trained = train(docs, labels, limit)

    def factory():
        table = WordTable(coder(trained[0]) if trained else lambda w: 0, np.int64)

        def compute(texts):
            if trained is None or not texts:
                p = np.zeros(len(texts))
            else:
                z = raw_scores(np.array([dense(t, table) for t in texts]), trained[1])
                # a trace of the margin keeps the order of texts that share a step
                p = np.clip(0.98 * np.interp(z, *trained[2]) + 0.02 * sigmoid(z), 0, 1)
            return [p, (p >= 0.5).astype(np.int32)]

        return compute

    return map_text(docs, keep or docs.columns, FIELDS, factory)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    found = score(docs, labels, ["doc_id"])
    return found.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "score", "predicted")
