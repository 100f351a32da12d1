"""Exact dedup by skew-safe combining.

Texts are equal when identical after lower-casing A-Z only. Copies are combined in three
steps, each of which groups by the digest *and* the whole normalised text, so that content is
compared every time:

1. locally, by the map-side half of the first aggregate: a task emits one row a distinct text;
2. among salted digest groups: the salt is the task's number modulo ``salts``, so the rows of
   one text, even if it is a third of all rows, meet in ``salts`` reducers;
3. globally, where the at most ``salts`` winners of a text meet.

The winners, without texts, are written to the shared folder; documents find theirs by digest
in a join that adaptive execution may split. Two contents under one SHA-256 digest would stop
the job with an error instead of merging them.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.shared import small, written

SALTS = 16


def normalised(text):
    """Null counts as empty; only A-Z change."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def winners(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, keep_id, group_size), one row a distinct text; written to the shared folder."""
    norm = normalised(F.col("text"))
    local = docs.select(
        "doc_id", norm.alias("content"), F.sha2(norm, 256).alias("digest"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
    )
    salted = local.groupBy("digest", "content", "salt").agg(
        F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n")
    )
    merged = salted.groupBy("digest", "content").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    by_digest = merged.groupBy("digest").agg(
        F.max("top").alias("top"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("contents")
    )
    clash = F.raise_error(F.lit("two contents have one SHA-256 digest")).cast("long")
    return written(
        by_digest.select(
            "digest", F.when(F.col("contents") == 1, F.col("top")).otherwise(clash).alias("keep_id"), "group_size"
        ),
        "exact-winners",
    )


def _members(docs: DataFrame, keep: list[str]) -> DataFrame:
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"),
        F.col("doc_id").alias("id"), F.sha2(normalised(F.col("text")), 256).alias("digest"),
    )


def exact_duplicates(docs: DataFrame, keep: list[str] | None = None, salts: int = SALTS) -> DataFrame:
    """All rows of ``docs``, their ``keep`` columns as the struct ``doc``, with keep_id, group_size,
    kept and text_sha256.

    Of equal texts the row with the largest doc_id stays; a null doc_id counts as the smallest,
    and of several rows with that doc_id exactly one stays. Null and empty texts are one group.
    Works on empty tables; other columns, whatever their names, ride inside ``doc``.
    """
    found = winners(docs.select("doc_id", "text"), salts)
    rank = F.row_number().over(Window.partitionBy("id", "digest").orderBy("tag"))
    rows = _members(docs, keep or docs.columns).withColumn("tag", F.monotonically_increasing_id()).withColumn("rank", rank)
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("rank") == 1)
    return rows.join(found, "digest").select(
        "doc", "keep_id", "group_size", stays.alias("kept"), F.col("digest").alias("text_sha256")
    )


def deduplicate(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns, by the rules of ``exact_duplicates``.

    Only texts of several rows take part in a join: the others stay as they are. Where these texts are
    few, no whole document is shuffled but those that stay for them."""
    several = winners(docs.select("doc_id", "text"), salts).where("group_size > 1").select("digest", "keep_id")
    several = small(several)
    rows = _members(docs, docs.columns)
    single = rows.join(several.select("digest"), "digest", "left_anti").select("doc")
    top = (rows["digest"] == several["digest"]) & rows["id"].eqNullSafe(several["keep_id"])
    # rows that repeat text and doc_id are combined in the tasks first
    best = rows.join(several, top).groupBy(several["digest"].alias("of")).agg(F.first("doc").alias("doc")).select("doc")
    return single.unionByName(best).select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_duplicates(docs, ["doc_id"]).select("doc.doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY content) AS keep_id,
       CAST(count(*) OVER (PARTITION BY content) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY content) AS kept, sha256(content) AS text_sha256
FROM d
"""
