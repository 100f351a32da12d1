"""Arrow-batched passes over texts, and the hashed n-grams that several operators use."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.shared import ship

#: Entries that a worker's word table holds before it starts anew: bounds its memory.
WORDS_KEPT = 300_000


class WordTable(dict):
    """Word (bytes) to a number, remembered for ``WORDS_KEPT`` short words at a time."""

    def __init__(self, number: Callable[[bytes], int] = xxhash.xxh64_intdigest, dtype=np.uint64):
        super().__init__()
        self.number, self.dtype = number, dtype

    def __missing__(self, word: bytes) -> int:
        value = self.number(word)
        if len(word) <= 64:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), self.dtype, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones((2, 1), np.uint64)
#: Bytes that are hashed at a time, up to the next white space.
BLOCK = 1 << 16
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _powers_to(n: int) -> np.ndarray:
    """Powers of an odd base and of its inverse modulo 2**64."""
    global _powers
    if _powers.shape[1] < n:
        base = np.array([[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64)
        _powers = np.cumprod(np.concatenate([np.ones((2, 1), np.uint64), np.repeat(base, n - 1, 1)], 1), 1, dtype=np.uint64)
    return _powers


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each run of anything but ASCII white space, in order: differences of running sums
    of byte values times powers, so no word becomes an object."""
    if len(raw) > BLOCK:
        out, at = [], 0
        while at < len(raw):
            gap = _GAP.search(raw, min(len(raw), at + BLOCK - 1))
            end = gap.end() if gap else len(raw)
            out.append(_block_hashes(raw[at:end]))
            at = end
        return np.concatenate(out)
    return _block_hashes(raw)


def _block_hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    space = np.ones(len(b) + 2, np.int8)
    space[1:-1] = _SPACE[b]
    edge = np.diff(space)
    first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    powers = _powers_to(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * powers[0, : len(b)], out=sums[1:])
    return mixed((sums[end] - sums[first]) * powers[1, first] + (end - first).astype(np.uint64))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` numbers; empty when there are fewer."""
    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : len(h) - n + 1 + k]
    return mixed(out)


def sliced(batches, rows: int = 1000):
    """The batches in parts of at most ``rows`` rows: what a step holds at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_text(docs: DataFrame, keep: list[str], fields: list[T.StructField], factory: Callable) -> DataFrame:
    """``docs`` with the ``keep`` columns as the struct ``doc`` and ``fields`` computed from text.

    ``factory()`` runs once a task and gives a function from a list of texts (or None) to one
    list or array a field. Columns keep their names inside ``doc``, so none can clash.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col("text").alias("text"))
    schema = T.StructType([rows.schema["doc"], *fields])

    def run(batches):
        compute = factory()
        for batch in sliced(batches):
            columns = compute(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)],
                names=["doc", *(f.name for f in fields)],
            )

    return rows.mapInArrow(run, schema)


#: Slots of the hash table of word n-grams, and as many of character n-grams behind them.
SLOTS = 1 << 16
CHARS = 4


def hashed_ngrams(text: str | None, table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words and word pairs, and of the runs of ``CHARS`` bytes, of a whole text."""
    raw = (text or "").encode()
    h = table.of(raw.split())
    words = (np.concatenate([mixed(h), windows(h, 2)]) % np.uint64(SLOTS)).astype(np.int64)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < CHARS:
        return words, np.empty(0, np.int64)
    grams = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
    chars = ((grams * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) % SLOTS + SLOTS
    return words, chars


SCALE = 30.0


def margin(weights: np.ndarray, text: str | None, table: WordTable) -> float:
    """Mean weight of the word n-grams plus mean weight of the character n-grams, scaled."""
    return float(sum(SCALE * weights[slots].mean() for slots in hashed_ngrams(text, table) if len(slots)))
