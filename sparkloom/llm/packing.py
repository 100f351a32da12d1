"""Packing along a space-filling curve.

Each document becomes token ids and, from them, a hashed count vector that a fixed random matrix
projects to ``DIMS`` coordinates. The coordinates' cell on a Hilbert curve is the sort key:
documents that are near in the vector space are near on the curve. In that order the documents'
ids form one stream that is cut every ``capacity`` ids, so only the very last sequence is not full.

Three steps keep tokens from moving more than once: documents are tokenized and written with their
keys; the keys alone are range-sorted and summed, each range by itself, and the ranges' sums (a row
a range) give every document its place in the stream; places and tokens meet in a join, where
documents are cut. Ties on the curve, copies for one, are ordered by doc_id and split over ranges.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from operator import itemgetter

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sparkloom.llm.shared import written
from sparkloom.llm.textmap import map_text

CAPACITY = 4096
END_ID = 2
DIMS, BITS = 4, 15
BUCKETS = 1024
#: Words after which a worker forgets those that it hasn't met since as many words before.
WORDS_KEPT = 150_000
#: Words that the tokenizer gets at a time, and characters of the texts whose unknown words it gets together.
AT_ONCE, BLOCK = 2000, 1 << 18

#: Texts of other characters go to the tokenizer whole.
UNUSUAL = re.compile(r"[^\t-\r\x20-\x7e¡-ɏ]")


def _pieces() -> re.Pattern:
    """What the tokenizer's own splitting rule (fixed in its file) cuts normalised texts of usual characters into."""
    usual = [chr(k) for k in range(0x250) if not UNUSUAL.match(chr(k))]
    found = {c: unicodedata.category(c)[0] for x in usual for c in unicodedata.normalize("NFC", x).lower()}
    letters, digits = (re.escape("".join(sorted(c for c, kind in found.items() if kind == k))) for k in "LN")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\t-\r {letters}{digits}]+")


PIECES = _pieces()


class Encoder:
    """Ids of texts by a tokenizer whose words don't depend on each other: what stands between two
    spaces is encoded once and remembered. ``tests/llm`` holds it against the tokenizer itself."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores
        self.tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            ends[k] = token.endswith("</w>")
        self.ends = ends
        self.known: dict[str, bytes] = {}  # what stands between two spaces, and its pieces by the splitting rule
        self.older: dict[str, bytes] = {}  # what was known before; what is met again moves back

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: list[str]) -> None:
        """Encodes unknown pieces together; a piece's ids end where a token ends a word."""
        ids = self.plain(" ".join(words))
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            self.known.update((w, self.plain(w).tobytes()) for w in words)
            return
        raw, begin = ids.tobytes(), 0
        for word, stop in zip(words, (4 * stops).tolist(), strict=True):
            self.known[word] = raw[begin:stop]
            begin = stop

    def _unknown(self, words: set[str]) -> set[str]:
        fresh = words.difference(self.known)
        again = {w: self.older[w] for w in fresh if w in self.older}
        self.known.update(again)
        return fresh.difference(again)

    def prepare(self, chunks: set[str]) -> None:
        """Sees to it that all ``chunks`` are known."""
        if len(self.known) > WORDS_KEPT:
            self.known, self.older = {}, self.known
        fresh = self._unknown(chunks)
        several = {c: PIECES.findall(c) for c in fresh if not c.isalpha()}  # letters alone are one piece
        unknown = fresh.difference(several)
        unknown = [*unknown, *self._unknown({w for p in several.values() for w in p}.difference(unknown))]
        tokenize = self.tokenizer.model.tokenize
        for w in unknown:
            if w.isascii():  # stands for itself in the model's alphabet of bytes
                self.known[w] = array("I", [t.id for t in tokenize(w)]).tobytes()
        unknown = [w for w in unknown if not w.isascii()]
        for k in range(0, len(unknown), AT_ONCE):
            self.learn(unknown[k : k + AT_ONCE])
        for chunk, own in several.items():
            self.known[chunk] = b"".join(map(self.known.__getitem__, own))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; texts are taken together up to ``BLOCK`` characters."""
        out, held, size = [], [], 0
        for text in texts:
            if held and size + len(text) > BLOCK:
                out += self._block(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        return out + self._block(held)

    def _block(self, texts: list[str]) -> list[bytes]:
        cut = [None if "<|" in t or UNUSUAL.search(t) else unicodedata.normalize("NFC", t).lower().split() for t in texts]
        self.prepare(set().union(*(c for c in cut if c)))
        known = self.known
        return [
            self.plain(t).tobytes() if c is None else b"".join(itemgetter(*c)(known)) if len(c) > 1 else b"".join(known[x] for x in c)
            for t, c in zip(texts, cut, strict=True)
        ]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process: its remembered words outlive a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def projection(dims: int = DIMS) -> np.ndarray:
    """The fixed random matrix from hashed counts to coordinates."""
    return np.random.default_rng(11).standard_normal((BUCKETS, dims))


def coordinates(ids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    slots = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)
    counts = np.bincount(slots.astype(np.int64), minlength=BUCKETS).astype(float)
    return counts @ matrix / max(1.0, float(np.sqrt((counts**2).sum())))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on a Hilbert curve of each row of cell numbers below 2**bits.

    Per dimension from the top bit down, the lower bits of the first axis are inverted or exchanged
    so that neighbouring cells of the curve share a face; the transposed bits, Gray-decoded and
    interleaved, are the key."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def keyed(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, row, key, n, ids) of every document, written: ``row`` tells repeated rows apart."""
    matrix = projection()
    fields = [T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())]

    def factory():
        encode, end = encoder(path).encode_all, np.array([end_id], "<u4").tobytes()

        def compute(texts):
            ids = [x + end for x in encode([t or "" for t in texts])]
            at = [coordinates(np.frombuffer(x, "<u4"), matrix) for x in ids]
            at = np.array(at).reshape(-1, DIMS)
            cells = np.clip((at / 8 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
            return [hilbert(cells), np.array([len(x) // 4 for x in ids], np.int64), pa.array(ids, pa.binary())]

        return compute

    found = map_text(docs, ["doc_id"], fields, factory)
    return written(found.select("doc.doc_id", F.monotonically_increasing_id().alias("row"), "key", "n", "ids"), "pack-tokens")


def places(tokens: DataFrame) -> DataFrame:
    """(row, place): the ids before each document in the stream along the curve."""
    keys = tokens.select("key", "doc_id", "row", "n")
    ranges = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", F.col("doc_id").asc_nulls_last(), "row"]
    ranged = keys.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("n", "row")

    def running(batches):
        before = 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n"), pa.array(before + n.cumsum() - n)], ["row", "n", "at"])
            before += int(n.sum())

    local = ranged.mapInArrow(running, "row long, n long, at long").withColumn("range", F.spark_partition_id())
    local = written(local, "pack-ranges")
    # a row a range, as many as shuffle partitions
    sums = local.groupBy("range").agg(F.sum("n").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("range", F.coalesce(before, F.lit(0)).alias("before"))
    return local.join(F.broadcast(starts), "range").select("row", (F.col("before") + F.col("at")).alias("place"))


PIECE_FIELDS = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``ids`` (little-endian unsigned 32-bit) is null unless ``with_ids``. A null or empty text is its
    end id alone. Sequences are numbered along the curve; sequence_id * capacity + offset is a
    piece's place in the stream. Repeated rows are packed each; an empty table has no pieces."""
    tokens = keyed(docs, path or public_tokenizers.path("word_bpe_49k.json"), end_id)
    placed = tokens.select("doc_id", "row", "ids").join(places(tokens), "row").select("doc_id", "place", "ids")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            rows, out = [], [[] for _ in range(7)]
            for k, (place, raw) in enumerate(zip(batch.column("place").to_pylist(), batch.column("ids").to_pylist(), strict=True)):
                n, start = len(raw) // 4, 0
                while start < n:
                    sequence, offset = divmod(place + start, capacity)
                    length = min(n - start, capacity - offset)
                    piece = raw[4 * start : 4 * (start + length)]
                    rows.append(k)
                    for column, value in zip(out, (start, length, zlib.crc32(piece), n, sequence, offset, piece if with_ids else None), strict=True):
                        column.append(value)
                    start += length
            arrays = [batch.column("doc_id").take(pa.array(rows, pa.int64()))]
            arrays += [pa.array(c, pa.int64()) for c in out[:6]] + [pa.array(out[6], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(cut, PIECE_FIELDS.format(id=id_type))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, with_ids=False).drop("ids")
