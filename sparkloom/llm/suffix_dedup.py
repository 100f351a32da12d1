"""Suffix-array dedup: passages of 50 bytes that also start in a document with a smaller doc_id go.

A distributed, common-prefix-aware merge sort of suffixes, as in communication-efficient string
sorting, over a sparse suffix array:

1. *Suffixes.* Of each 50-byte window the ``CORE`` bytes with the smallest hash, the leftmost if
   several, are its anchor. Equal windows have their anchor at the same place, so only suffixes
   that start at anchors (about one byte in 17) are sorted. Exact copies of a text don't take
   part: all but the smallest doc_id of them are removed whole.
2. *Which suffixes need sorting.* Tasks exchange the anchors' hashes; suffixes whose first bytes, with
   16 more on neither side, start in no other document are out.
3. *Sorted runs.* Each task sorts its remaining suffixes, keeps of equal ones (with equal left
   context) the smallest document and sends front-coded runs: the length of the prefix shared with
   the suffix before, and the rest. Suffixes with equal cores meet in one part.
4. *Merge.* A part's runs are merged by a loser tree that carries each head's common prefix with the last
   winner: unequal prefix lengths decide without looking at bytes, equal ones compare from there on.
   The merge yields the suffixes' order and the common prefix of neighbours.
5. *Windows.* For each distance from window to anchor, neighbours whose common prefix spans the right part
   and whose left parts are equal (by a 64-bit hash) are one window; it repeats in every document
   but the smallest. Removed stretches go back to their documents.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import shared
from sparkloom.llm.shared import ship, small, written
from sparkloom.llm.textmap import mixed

WINDOW, CORE, SIDE = 50, 18, 16
REACH = WINDOW - CORE
#: Windows that are hashed at a time.
CHUNK = 1 << 18
#: Anchors a task holds before it sends them; suffixes a task sorts at a time.
HELD, SORTED = 1_000_000, 150_000

_C = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_C, n, 1 << 64))


def anchors(raw: bytes):
    """(place, lo, hi, hash, left, right) of a text's anchors: windows lo to hi (inclusive) have theirs
    at ``place``; left and right are 8-bit hashes of the ``SIDE`` bytes before and after the core."""
    out, n = [], len(raw) - WINDOW + 1
    low = np.uint64((1 << 20) - 1)
    for begin in range(0, max(n, 0), CHUNK):
        end = min(n, begin + CHUNK)
        back = min(begin, SIDE)
        ahead = min(len(raw), end + WINDOW - 1 + SIDE)
        b = np.frombuffer(raw, np.uint8, ahead - begin + back, begin - back).astype(np.uint64)
        h2 = b[:-1] * _power(1) + b[1:]
        h4 = h2[:-2] * _power(2) + h2[2:]
        h8 = h4[:-4] * _power(4) + h4[4:]
        h16 = h8[:-8] * _power(8) + h8[8:]
        core = mixed(h16[:-2] * _power(2) + h2[16:])[back : back + end - begin + REACH]
        m = (core & ~low) | np.arange(len(core), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, 1):
            m = np.minimum(m[:-step], m[step:])
        at = (m & low).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], end - begin) - 1
        place = at[first]
        sides = (mixed(h16) >> np.uint64(56)).astype(np.uint8)
        left = np.where(place + back >= SIDE, sides[np.maximum(place + back - SIDE, 0)], 0)
        right_at = place + back + CORE
        right = np.where(right_at < len(sides), sides[np.minimum(right_at, len(sides) - 1)], 0)
        # the smallest of many hashes are small: hashed again, they spread evenly
        out.append((place + begin, first + begin, last + begin, mixed(core[place]), left.astype(np.uint8), right.astype(np.uint8)))
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint8, np.uint8))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _cut(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of equal values."""
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return at, np.append(at[1:], len(key))[: len(at)]


def _in_several(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows' keys stand in two documents or more."""
    order = np.lexsort((doc, key))
    at, end = _cut(key[order])
    several = doc[order][at] != doc[order][end - 1] if len(at) else np.empty(0, bool)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(several, end - at)
    return out


def repeated_anchors(texts: DataFrame, bits: int) -> DataFrame:
    """(mark, ids): the anchors of each text that may begin a repeated passage, by the first 32 + ``bits``
    bits of their hashes. The first ``bits`` bits are the range in which hashes meet; ``mark`` is a
    64-bit hash of the text's key, and texts that share one only get anchors too many."""

    def offer(batches):
        marks, held, size = [], [], 0

        def flush():
            own = np.array(marks, "<i8")
            doc = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x[0]) for x in held])
            ids, left, right = (np.concatenate([x[k] for x in held]) for k in range(3))
            order = np.argsort(ids)
            ids, doc, left, right = ids[order], doc[order], left[order], right[order]
            at, end = _cut(ids >> np.uint64(32))
            columns = [[], [], [], [], [], []]
            for i, j in zip(at, end, strict=True):
                used, back = np.unique(doc[i:j], return_inverse=True)
                small = (ids[i:j] & np.uint64(0xFFFFFFFF)).astype("<u4")
                row = (int(ids[i] >> np.uint64(32)), small.tobytes(), back.astype("<u4").tobytes(), left[i:j].tobytes(), right[i:j].tobytes(), own[used].tobytes())
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            types = [pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["range", "ids", "docs", "lefts", "rights", "marks"])

        for batch in batches:
            for mark, text in zip(batch.column("mark").to_pylist(), batch.column("text"), strict=True):
                _, _, _, h, left, right = anchors(text.as_buffer().to_pybytes())
                marks.append(mark)
                held.append((h >> np.uint64(32 - bits), left, right))
                size += len(h)
                if size > HELD:
                    yield flush()
                    marks, held, size = [], [], 0
        if size:
            yield flush()

    def meet(key, rows):
        columns = (rows.column(c).to_pylist() for c in ("ids", "docs", "lefts", "rights", "marks"))
        ids, docs, lefts, rights = [], [], [], []
        for small, doc, left, right, marks in zip(*columns, strict=True):
            ids.append(np.frombuffer(small, "<u4"))
            docs.append(np.frombuffer(marks, "<i8")[np.frombuffer(doc, "<u4")])
            lefts.append(np.frombuffer(left, np.uint8))
            rights.append(np.frombuffer(right, np.uint8))
        ids, docs, lefts, rights = map(np.concatenate, (ids, docs, lefts, rights))
        some = _in_several(ids, docs)
        ids, docs, lefts, rights = ids[some].astype(np.int64), docs[some], lefts[some], rights[some]
        some = _in_several(ids << 8 | lefts, docs) | _in_several(ids << 8 | rights, docs)
        ids, docs = ids[some], docs[some]
        order = np.argsort(docs, kind="stable")
        full = (ids[order].astype(np.uint64)) | np.uint64(key[0].as_py() << 32)
        at, end = _cut(docs[order])
        return pa.table(
            {
                "mark": pa.array(docs[order][at], pa.int64()),
                "ids": pa.array([full[i:j].tobytes() for i, j in zip(at, end, strict=True)], pa.binary()),
            }
        )

    ship(texts.sparkSession)
    offered = texts.select(F.xxhash64("key").alias("mark"), F.col("text").cast("binary").alias("text")).mapInArrow(
        offer, "range long, ids binary, docs binary, lefts binary, rights binary, marks binary"
    )
    met = offered.groupBy("range").applyInArrow(meet, "mark long, ids binary")
    return written(met.groupBy("mark").agg(F.collect_list("ids").alias("ids")), "suffix-anchors")


def front_coded(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(shared prefix lengths, lengths of the rests, rests) of sorted strings of under 256 bytes."""
    shared, rests, last = bytearray(), [], b""
    for s in strings:
        k = common(last, s, 0)
        shared.append(k)
        rests.append(s[k:])
        last = s
    return bytes(shared), bytes(map(len, rests)), b"".join(rests)


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no comparison."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    x = int.from_bytes(a[known:most]) ^ int.from_bytes(b[known:most])
    return most - (x.bit_length() + 7) // 8


def decoded(shared: bytes, lengths: bytes, rests: bytes):
    """(string, prefix shared with the string before), one after the other."""
    last, at = b"", 0
    for k, n in zip(shared, lengths, strict=True):
        last = last[:k] + rests[at : at + n]
        at += n
        yield last, k


def merged(runs: list):
    """(run, common prefix with the string before) of all strings in order. ``runs`` are iterators of
    (string, prefix shared with the run's string before).

    A loser tree: inner node k holds the loser of the match below it. All heads' prefix lengths are
    against the last winner, so of two heads the one with the longer prefix is smaller."""
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    heads: list[bytes | None] = [None] * size
    lcp = [0] * size
    for k, run in enumerate(runs):
        heads[k], lcp[k] = next(run, (None, 0))
        lcp[k] = 0

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix length becomes the one it shares with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        k = common(x, y, lcp[a])
        if k == len(x) or (k < len(y) and x[k] < y[k]):
            lcp[b] = k
            return a, b
        lcp[a] = k
        return b, a

    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = match(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    while heads[best] is not None:
        yield best, lcp[best]
        heads[best], lcp[best] = next(runs[best], (None, 0))
        node = (best + size) // 2
        while node:
            best, losers[node] = match(best, losers[node])
            node //= 2


def repeated_windows(lcp: np.ndarray, right: np.ndarray, left: np.ndarray, before: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For suffixes in order: bit k is set if the window that starts k bytes before the anchor stands in a
    smaller document too. ``right`` and ``left`` are the context's lengths, ``before`` has the bytes before
    the anchor, nearest first."""
    flags = np.zeros(len(doc), np.uint64)
    h = np.zeros(len(doc), np.uint64)
    for k in range(REACH + 1):
        if k:
            h = mixed(h * np.uint64(_C) + before[:, k - 1] + np.uint64(1))
        mine = np.flatnonzero((left >= k) & (right >= WINDOW - k))
        group = np.cumsum(lcp < WINDOW - k).astype(np.uint64)[mine]
        key = mixed(group * np.uint64(_C) + h[mine])
        order = np.argsort(key)
        at, end = _cut(key[order])
        if not len(at):
            continue
        least = np.minimum.reduceat(doc[mine][order], at)
        again = mine[order][doc[mine][order] > np.repeat(least, end - at)]
        flags[again] |= np.uint64(1 << k)
    return flags


def stretches(starts: np.ndarray) -> np.ndarray:
    """Begin and end, in turn, of the bytes covered by windows with these sorted starts."""
    at = np.flatnonzero(np.append(True, starts[1:] > starts[:-1] + WINDOW))
    return np.stack([starts[at], starts[np.append(at[1:], len(starts)) - 1] + WINDOW], 1).reshape(-1)


RUN = "part long, shared binary, lengths binary, rests binary, lefts binary, left_lengths binary, ids binary, docs binary, places binary, keys binary, spans array<long>"


def sorted_runs(texts: DataFrame, bits: int, parts: int) -> DataFrame:
    """Front-coded sorted runs, one row a part and flush, and rows (part, keys, spans) of stretches that
    repeat within the task: their suffixes are not sent."""

    def run(batches):
        held, keys = [], []

        def flush():
            held.sort()
            by_part: dict[int, list] = {}
            local: dict[int, list[int]] = {}
            last = None
            for item in held:
                part, right, left, doc_id, doc, place = item
                if last and last[:3] == item[:3] and doc_id > last[3]:
                    local.setdefault(doc, []).extend(range(place - len(left), place + len(right) - WINDOW + 1))
                    continue
                if not last or last[:3] != item[:3]:
                    last = item
                by_part.setdefault(part, []).append(item)
            rows = []
            for part, items in by_part.items():
                used = {d: k for k, d in enumerate(dict.fromkeys(x[4] for x in items))}
                rows.append(
                    (
                        part, *front_coded([x[1] for x in items]), b"".join(x[2] for x in items), bytes(len(x[2]) for x in items),
                        np.array([x[3] for x in items], "<i8").tobytes(), np.array([used[x[4]] for x in items], "<u4").tobytes(),
                        np.array([x[5] for x in items], "<i8").tobytes(), b"".join(keys[d] for d in used), None,
                    )
                )
            for doc, starts in local.items():
                part = int.from_bytes(keys[doc][:6]) % parts
                rows.append((part, *[None] * 8, keys[doc], stretches(np.unique(np.array(starts))).tolist()))
            types = [pa.int64(), *[pa.binary()] * 9, pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        for batch in batches:
            columns = (batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("ids"))
            for key, doc_id, text, ids in zip(*columns, strict=True):
                raw = text.as_buffer().to_pybytes()
                place, lo, hi, h, _, _ = anchors(raw)
                some = np.flatnonzero(np.isin(h >> np.uint64(32 - bits), np.concatenate([np.frombuffer(x, "<u8") for x in ids.as_py()])))
                part = (h[some] >> np.uint64(8)) % np.uint64(parts)
                for p, a, b, k in zip(place[some].tolist(), lo[some].tolist(), hi[some].tolist(), part.tolist(), strict=True):
                    held.append((k, raw[p : b + WINDOW], raw[a:p][::-1], doc_id, len(keys), p))
                keys.append(key)
                if len(held) > SORTED:
                    yield flush()
                    held, keys = [], []
        if held:
            yield flush()

    names = [x.split()[0] for x in RUN.split(", ")]
    return texts.mapInArrow(run, RUN)


def merged_parts(runs: DataFrame) -> DataFrame:
    """(key, spans): the stretches that go, from the merge of each part's runs."""

    def merge(key, rows):
        out_keys, out_spans, heads, keys = [], [], [], []
        lefts, left_lengths, ids, docs, places, base = [], [], [], [], [], []
        for r in rows.to_pylist():
            if r["spans"] is not None:
                out_keys.append(r["keys"])
                out_spans.append(r["spans"])
                continue
            heads.append(decoded(r["shared"], r["lengths"], r["rests"]))
            lefts.append(np.frombuffer(r["lefts"], np.uint8))
            left_lengths.append(np.frombuffer(r["left_lengths"], np.uint8))
            ids.append(np.frombuffer(r["ids"], "<i8"))
            docs.append(np.frombuffer(r["docs"], "<u4").astype(np.int64) + len(keys))
            places.append(np.frombuffer(r["places"], "<i8"))
            base.append((len(r["shared"]), np.frombuffer(r["shared"], np.uint8), np.frombuffer(r["lengths"], np.uint8)))
            keys += [r["keys"][k : k + 32] for k in range(0, len(r["keys"]), 32)]
        if heads:
            run, lcp = (np.array(x) for x in zip(*merged(heads), strict=True))
            left, doc_ids, doc, place = map(np.concatenate, (left_lengths, ids, docs, places))
            right = np.concatenate([s.astype(np.int64) + n for _, s, n in base])
            before = np.zeros((len(doc), REACH), np.uint8)
            before[np.arange(REACH) < left[:, None]] = np.concatenate(lefts)
            # the j-th string that a run has given is its j-th element
            order = np.empty(len(run), np.int64)
            by_run = np.argsort(run, kind="stable")
            order[by_run] = np.arange(len(run))
            flags = repeated_windows(lcp, right[order], left[order].astype(np.int64), before[order], doc_ids[order])
            element, back = np.nonzero((flags[:, None] >> np.arange(REACH + 1, dtype=np.uint64)) & np.uint64(1))
            doc, start = doc[order][element], place[order][element] - back
            by_doc = np.lexsort((start, doc))
            doc, start = doc[by_doc], start[by_doc]
            for i, j in zip(*_cut(doc), strict=True):
                out_keys.append(keys[doc[i]])
                out_spans.append(stretches(start[i:j]).tolist())
        return pa.table({"key": pa.array(out_keys, pa.binary()), "spans": pa.array(out_spans, pa.list_(pa.int64()))})

    found = runs.groupBy("part").applyInArrow(merge, "key binary, spans array<long>")
    return written(found.groupBy("key").agg(F.collect_list("spans").alias("spans")), "suffix-spans")


def remaining(raw: bytes, spans: list[list[int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs) for stretches in any order."""
    pieces, at, runs, removed = [], 0, 0, 0
    for a, b in sorted((x[k], x[k + 1]) for x in spans for k in range(0, len(x), 2)):
        if b <= at:
            continue
        if a > at or not runs:
            pieces.append(raw[at:a])
            runs += 1
        removed += b - max(a, at)
        at = b
    return b"".join([*pieces, raw[at:]]), removed, runs


def spans_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, first) of the texts that several rows have, (key, spans) of the texts that lose a part)."""
    rows = _rows(docs)
    groups = rows.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    copied = written(groups.where("n > 1").select("key", "first"), "suffix-copied")
    first = F.coalesce("first", "doc_id")
    texts = rows.join(small(copied), "key", "left").where((F.col("doc_id") == first) & (F.octet_length("text") >= WINDOW))
    texts = texts.select("key", "doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(24, max(6, math.ceil(math.log2(size / 17 / HELD + 1))))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // 17 // 300_000)
    wanted = repeated_anchors(texts, bits)
    asked = texts.select("key", "doc_id", F.col("text").cast("binary").alias("text"))
    asked = asked.withColumn("mark", F.xxhash64("key")).join(wanted, "mark")
    return copied, merged_parts(sorted_runs(asked, bits, parts))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("key", F.unhex(F.sha2("text", 256)))


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``kept``, the bytes that are
    left, is null unless ``with_text``.

    Texts are judged as UTF-8 bytes on the input; null texts count as empty. A null doc_id is neither
    smaller nor larger than another: such rows lose nothing and cost others nothing. Repeated rows have
    equal ids, so neither loses to the other. Works on empty tables; only doc_id and text are read."""
    copied, cuts = spans_of(docs)
    stretch_count = cuts.agg(F.sum(F.aggregate("spans", F.lit(0), lambda s, x: s + F.size(x)))).first()[0] or 0
    rows = _rows(docs).join(small(copied), "key", "left").join(F.broadcast(cuts) if stretch_count <= shared.MOST_BROADCAST else cuts, "key", "left")
    n = F.octet_length("text").cast("long")
    whole = (F.col("doc_id") > F.col("first")) & (n >= WINDOW)
    cut = F.col("spans").isNotNull() & F.col("doc_id").isNotNull() & ~F.coalesce(whole, F.lit(False))
    content = F.when(cut | F.lit(with_text), F.col("text").cast("binary"))
    marked = rows.select(
        "doc_id", n.alias("n_bytes"), "key", F.coalesce(whole, F.lit(False)).alias("whole"), F.when(cut, F.col("spans")).alias("spans"), content.alias("text")
    )
    none = hashlib.sha256(b"").hexdigest()

    def finish(batches):
        for batch in batches:
            out = [[], [], [], []]
            for r in batch.select(["n_bytes", "key", "whole", "spans", "text"]).to_pylist():
                if r["whole"]:
                    row = r["n_bytes"], 1, none, b""
                elif r["spans"]:
                    left, removed, runs = remaining(r["text"], r["spans"])
                    row = removed, runs, hashlib.sha256(left).hexdigest(), left
                else:
                    row = 0, 0, r["key"].hex(), r["text"]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            arrays.append(pa.array(out[3] if with_text else [None] * batch.num_rows, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, with_text=False).drop("kept")
