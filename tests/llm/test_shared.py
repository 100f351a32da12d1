import pyarrow as pa

from sparkloom.llm import jaccard_join, shared


def test_batches_to_python_workers_are_bounded_by_bytes(spark):
    """Ten thousand long texts are not one batch; a number that the session sets itself stays."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    texts = spark.range(2000).selectExpr("id", "repeat('words of ten kilobytes ', 450) AS text").coalesce(1)
    try:
        spark.conf.unset(shared.BATCH_KEY)
        got = jaccard_join._over(texts, sizes, "n long, bytes long").collect()
        assert sum(r.n for r in got) == 2000 and max(r.bytes for r in got) < 2 * shared.BATCH_BYTES
        spark.conf.set(shared.BATCH_KEY, "1m")
        jaccard_join._over(texts, sizes, "n long, bytes long")
        assert spark.conf.get(shared.BATCH_KEY) == "1m"
    finally:
        spark.conf.unset(shared.BATCH_KEY)
