"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from training texts, lower-cased as all
texts are. A text is compressed whole, in blocks of ``BLOCK`` bytes, with each dictionary; the smallest sum wins, and
ties go to the first language in code point order. ``score`` grows from 0 with the margin to the
next language, relative to the text's size; below ``NARROW`` the prediction is marked rejected.

Texts for the dictionaries are a bounded choice by a hash of doc_id, ``PER_LANG`` a language,
outside the held-out fifth. Of a long one, ``PIECES`` stretches of ``PIECE`` characters, spread evenly
over the whole text, go into the dictionary, of a shorter one all: every chosen text counts alike, and
a dictionary has ``PER_LANG`` * ``PIECES`` * ``PIECE`` characters at most. Languages are whatever the training rows name, and are few: their
number is checked against ``MOST_LANGUAGES``.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.shared import held_out, written
from sparkloom.llm.textmap import map_text

PER_LANG, PIECES, PIECE = 120, 6, 100
BLOCK = 1 << 14
NARROW = 0.01
MOST_LANGUAGES = 400
UNKNOWN = "und"


def _pieces(text):
    """The stretches of a text, in order, one after the other."""
    room = F.length(text) - PIECE
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.substring(text, (F.floor(k * room / (PIECES - 1)) + 1).cast("int"), F.lit(PIECE))
    )
    return F.lower(F.when(F.length(text) <= PIECES * PIECE, text).otherwise(F.array_join(spread, "\n")))


def dictionaries(docs: DataFrame, per_lang: int = PER_LANG) -> dict[str, bytes]:
    """Language to the content of its dictionary, from at most ``per_lang`` training texts each.

    Ids are chosen first, each task's ``per_lang`` of a language, then those of 256 groups of tasks, then
    all; only the chosen texts are read again. Rows without doc_id are not learned from; of several rows
    of a doc_id, the text with the smallest hash counts."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    ids = learn.select("lang", "doc_id", F.xxhash64("doc_id").alias("turn"), F.pmod(F.spark_partition_id(), F.lit(256)).alias("part"))
    local = Window.partitionBy("lang", "part").orderBy("turn", "doc_id")
    overall = Window.partitionBy("lang").orderBy("turn", "doc_id")
    chosen = (
        ids.withColumn("rank", F.row_number().over(local)).where(F.col("rank") <= per_lang)
        .withColumn("rank", F.row_number().over(overall)).where(F.col("rank") <= per_lang)
        .select("lang", "doc_id", "rank").limit(per_lang * MOST_LANGUAGES + 1)
    )
    chosen = written(chosen, "language-chosen")
    if chosen.select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    # at most per_lang * MOST_LANGUAGES rows of a name and two numbers
    texts = learn.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "rank").agg(F.min_by(_pieces(F.col("text")), F.xxhash64("text")).alias("piece"))
    found = texts.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "piece"))).alias("pieces"))
    rows = found.select("lang", F.array_join("pieces.piece", "\n").alias("content")).orderBy("lang").collect()
    return {r["lang"]: r["content"].encode() for r in rows}


def compressors(contents: dict[str, bytes]) -> list[zstandard.ZstdCompressor]:
    parameters = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=16, chain_log=16, search_log=3, min_match=4, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    out = []
    for content in contents.values():
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=parameters)
        out.append(zstandard.ZstdCompressor(dict_data=known, compression_params=parameters))
    return out


FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("rejected", T.BooleanType()),
]


def identify(docs: DataFrame, contents: dict[str, bytes], keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep`` as the struct ``doc``) with lang_pred, score and rejected.

    ``und`` with score 0, rejected, where the text is null or has no letter, or no language was
    learned. Equal texts, repeated rows among them, get equal predictions; ties between languages go to
    the first in code point order. Works on empty tables."""
    names = list(contents)

    def factory():
        by_lang = compressors(contents)

        def judge(text: str | None):
            if not names or text is None or not any(map(str.isalpha, text)):
                return UNKNOWN, 0.0, True
            raw = text.lower().encode()
            blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
            sizes = [sum(len(c.compress(b)) for b in blocks) for c in by_lang]
            best = int(np.argmin(sizes))
            rest = [s for k, s in enumerate(sizes) if k != best]
            gap = (min(rest) - sizes[best]) / max(1, sizes[best]) if rest else 1.0
            return names[best], float(1 - np.exp(-20 * gap)), gap < NARROW

        def compute(texts):
            found = [judge(t) for t in texts]
            return [[x[k] for x in found] for k in range(3)]

        return compute

    return map_text(docs, keep or docs.columns, FIELDS, factory)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), dictionaries(docs), ["doc_id"])
    return found.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
