"""What the operators of this folder have in common: the shared folder, folds, words."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local
    session without one a new temporary folder, set as the checkpoint folder too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sparkloom-"))
    return context.getCheckpointDir().rstrip("/")


#: Folders for tables that are removed when their work is done, the innermost last.
_scratch: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``written`` writes meanwhile is removed at the end, but for tables that ``outlive`` it."""
    folder = f"{(_scratch.get() or (shared_folder(spark),))[-1]}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set((*_scratch.get(), folder))
    try:
        yield
    finally:
        _scratch.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, so that a lost
    executor costs no recomputation, and what is nondeterministic in it is fixed. Inside ``scratch``
    the table goes when that ends, or with ``outlive`` when the ``scratch`` around it does."""
    folders = (shared_folder(df.sparkSession), *_scratch.get())
    path = f"{folders[-2 if outlive and len(folders) > 1 else -1]}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a broadcast side, at most. They have under 150 bytes each in memory, so 60 MB.
MOST_BROADCAST = 400_000


def few(df: DataFrame) -> bool:
    """Whether ``df``, of narrow rows, may be broadcast; it is counted as far as needed. Joins with what may
    not be are sort-merge joins, whose partitions adaptive execution splits at hot keys."""
    return df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if few(df) else df


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that no model learns from; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fraction(*parts: Column) -> Column:
    """A reproducible draw from [0, 1) for the given values."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


#: Bytes of a batch that goes to a Python worker, unless the session sets its own number. Spark's default of 64 MB
#: stands beside the heap several times: in growing buffers of the executor, and in the worker as received and as objects.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Bounds the batches of the session's Python workers, and sends the package's sources to the executors, once
    an application: their Python workers need not have it installed."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="sparkloom-code-")) / "sparkloom-code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
