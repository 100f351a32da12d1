"""N-gram Jaccard join by token-combination prefixes.

A document's set holds its distinct shingles of five words, as 64-bit hashes. Documents link when
their sets' Jaccard similarity is at least 0.8. Equal sets are one *node*; only nodes are joined.

1. Shingles fall into classes by the number of nodes that hold them: rare ones (class 1), frequent
   ones (2), very frequent ones (3). All shingles of all nodes are counted; the classes go to the
   tasks as two bit tables that grow with the number of shingles, to ``MOST_SLOTS`` bits. A shingle
   whose bit another one set is taken for a frequent one, which costs index entries and loses nothing.
2. A node's shingles, ordered by class and hash, are indexed from the start of that order: rare
   ones one by one, those of class k as all combinations of k within a bucket of the class. The
   prefix is extended until no n - ceil(0.8 n) missing shingles can hit all its entries: a shingle
   alone counts 1, a bucket of m shingles m - k + 1. Two nodes that link thus share an entry.
   Buckets depend on a size label; sizes that can link share a label.
3. Nodes that share an entry are candidates. Round by round, an entry's nodes are compared with
   one pivot, the one with the smallest share of rare shingles; whatever is linked already needs no
   comparison. What is left in different components is joined by entry and band of sizes, so no
   link that joins two components is lost, and groups of near copies aren't expanded into pairs. A
   node with over a ninth of rare shingles can, at an entry of frequent ones, link only with smaller
   nodes that have less, so two such nodes never meet.
4. Candidates are checked first by whole parity bit maps, which bound the sets' difference from below,
   then exactly, by sorted sets that meet at the pivot, salted for pivots with many candidates.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.components import components
from sparkloom.llm.shared import few, scratch, ship, small, written
from sparkloom.llm.textmap import map_text, mixed, sliced, windows, word_hashes

WORDS, PERCENT = 5, 80
#: Shingles in more nodes than these are of class 2 and of class 3.
FREQUENT, VERY_FREQUENT = 8, 256
#: Bits of a class table, at most: 128 MB.
MOST_SLOTS = 1 << 30
#: Comparisons that meet with one copy of a pivot's set.
PER_PIVOT = 500
LABEL_BASE = 1.26
#: Kinds of entries in each round; an entry's pivot depends on its kind, so groups that share many
#: entries meet as many pivots in a round. Only entries with many comparisons left go on to the next one.
KINDS = (1, 4, 16, 64)
#: Sizes of one band differ by less than this factor.
BAND = 1.03
#: Comparisons a row of an entry, up to which it goes to the last join without more rounds.
FEW = 4
#: A node's smallest entries, by which a pair that shares many entries is told at one of them.
FIRSTS = 4


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of a text's shingles; a text of fewer words is one shingle, one without words none."""
    h = word_hashes((text or "").encode().lower())
    if len(h) == 0:
        return h
    if len(h) < WORDS:
        return windows(np.append(h, np.uint64(len(h))), len(h) + 1)
    return np.unique(windows(h, WORDS))


def difference(n: int) -> int:
    """Shingles of a set of ``n`` that a linked set may lack."""
    return n - -(-PERCENT * n // 100)


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bit map with a bit for the parity of each residue, 1 to 2 bits a shingle and 256 at least, as 64-bit numbers."""
    bits = max(256, 1 << math.ceil(math.log2(max(1, len(tokens)))))
    odd = np.bincount((mixed(tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


SET_FIELDS = [
    T.StructField("n", T.LongType()),
    T.StructField("digest", T.BinaryType()),
    T.StructField("bits", T.ArrayType(T.LongType())),
    T.StructField("mask", T.ArrayType(T.LongType())),
]


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, digest, bits, mask) of every row, written; ``key`` is the text's, ``digest`` the set's,
    ``mask`` the parity bit map ``bits`` folded to 256 bits."""
    rows = docs.select("doc_id", "text").withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))

    def factory():
        def compute(texts):
            found = [shingles(t) for t in texts]
            digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in found]
            maps = [parity(x) for x in found]
            return [
                np.array([len(x) for x in found], np.int64), pa.array(digests, pa.binary()),
                pa.array(maps, pa.list_(pa.int64())),
                pa.array([np.bitwise_xor.reduce(x.reshape(-1, 4), 0) for x in maps], pa.list_(pa.int64())),
            ]

        return compute

    return written(map_text(rows, ["doc_id", "key"], SET_FIELDS, factory).select("doc.*", "n", "digest", "bits", "mask"), "join-sets")


def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, digest, n, bits, mask, first, key): one row a distinct non-empty set, with the row that stands for it."""
    by_set = rows.where("n > 0").groupBy("digest").agg(
        F.min(F.struct("doc_id", "key")).alias("row"), F.min("doc_id").alias("first"),
        F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("mask").alias("mask"),
    )
    found = by_set.select("digest", "n", "bits", "mask", "first", F.col("row.doc_id").alias("row_id"), F.col("row.key").alias("key"))
    return written(found.withColumn("node", F.monotonically_increasing_id()), "join-nodes")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the rows that stand for ``nodes``, as often as these are repeated; where ``nodes`` are too many to be broadcast,
    written, as several passes read them."""
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = nodes.select("node", "row_id", F.col("key").alias("md5"))
    same = (F.unhex(F.md5("text")) == F.col("md5")) & F.col("id").eqNullSafe(F.col("row_id"))
    if few(asked):
        return rows.join(F.broadcast(asked), same).select("node", "text")
    return written(rows.join(asked, same).select("node", "text"), "join-texts")


def _over(texts: DataFrame, run, schema: str) -> DataFrame:
    ship(texts.sparkSession)
    return texts.mapInArrow(run, schema)


def class_tables(texts: DataFrame, shingle_count: int) -> tuple[bytes, bytes]:
    """The bit tables of frequent and of very frequent shingles; a shingle's slot is its first bits.

    Tasks send runs of distinct hashes with counts, cut at ranges of the first bits; of a hash, the
    32 bits behind those of its range travel. A range's runs, about a quarter million hashes, meet
    in one task, which returns its part of the tables."""
    size = max(16, min(MOST_SLOTS.bit_length() - 1, math.ceil(math.log2(max(2, shingle_count / 2)))))
    cut = max(4, min(size - 3, 22, math.ceil(math.log2(shingle_count / 250_000 + 1))))

    def count(batches):
        held, n_held = [], 0

        def flush():
            hashes, n = np.unique(np.concatenate(held), return_counts=True)
            first = (hashes >> np.uint64(64 - cut)).astype(np.int64)
            rest, n = (hashes >> np.uint64(32 - cut)).astype("<u4"), np.minimum(n, 255).astype(np.uint8)
            at = np.flatnonzero(np.diff(first, prepend=-1))
            ends = np.append(at[1:], len(hashes))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(first[at]),
                    pa.array([rest[i:j].tobytes() for i, j in zip(at, ends, strict=True)], pa.binary()),
                    pa.array([n[i:j].tobytes() for i, j in zip(at, ends, strict=True)], pa.binary()),
                ],
                ["range", "hashes", "counts"],
            )

        for batch in sliced(batches):
            for text in batch.column("text").to_pylist():
                held.append(shingles(text))
                n_held += len(held[-1])
                if n_held > 500_000:
                    yield flush()
                    held, n_held = [], 0
        if n_held:
            yield flush()

    def mark(key, runs):
        hashes = np.concatenate([np.frombuffer(x, "<u4") for x in runs.column("hashes").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in runs.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        at = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
        total = np.add.reduceat(counts, at)
        slots = (hashes[at] >> np.uint32(32 - (size - cut))).astype(np.int64)
        out = []
        for most in (FREQUENT, VERY_FREQUENT):
            bits = np.zeros(1 << (size - cut), np.uint8)
            bits[slots[total > most]] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
        return pa.table({"range": [key[0].as_py()], "frequent": [out[0]], "very": [out[1]]}, schema=pa.schema([("range", pa.int64()), ("frequent", pa.binary()), ("very", pa.binary())]))

    runs = _over(texts, count, "range long, hashes binary, counts binary")
    parts = runs.groupBy("range").applyInArrow(mark, "range long, frequent binary, very binary").collect()  # MOST_SLOTS / 4 bytes at most
    tables = bytearray(1 << (size - 3)), bytearray(1 << (size - 3))
    width = 1 << (size - cut - 3)
    for row in parts:
        at = row["range"] * width
        tables[0][at : at + width] = row["frequent"]
        tables[1][at : at + width] = row["very"]
    return bytes(tables[0]), bytes(tables[1])


def _combinations(tokens: np.ndarray, bucket: np.ndarray, k: int, salt: np.uint64) -> list[np.ndarray]:
    """Hashes of all combinations of ``k`` tokens of equal ``bucket``; buckets are contiguous."""
    out, m = [], len(tokens)
    for i in range(1, m):
        same = bucket[i:] == bucket[:-i]
        if not same.any():
            break
        a = np.flatnonzero(same)
        pair = mixed(tokens[a] * np.uint64(0x9E3779B97F4A7C15) + tokens[a + i] + salt)
        if k == 2:
            out.append(pair)
            continue
        for j in range(i + 1, m):
            third = a[a + j < m]
            third = third[bucket[third + j] == bucket[third]]
            if not len(third):
                break
            out.append(mixed(pair[np.searchsorted(a, third)] * np.uint64(0x9E3779B97F4A7C15) + tokens[third + j]))
    return out


def entries(tokens: np.ndarray, frequent: np.ndarray, very: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the index entries of a sorted set, most shingles that it can share with a set met there).

    Sets that share a rare shingle of their prefixes meet at its entry. At an entry of frequent ones it is
    enough to find those that share no rare shingle; they share n less the rare ones at most. Sets of fewer
    than 4 link with equal sets only."""
    n = len(tokens)
    if n < 4:
        return tokens[:0], np.empty(0, np.int64)
    need = difference(n) + 1
    slot = (tokens >> np.uint64(62 - len(frequent).bit_length())).astype(np.int64)  # a table has a power of two bytes
    bit = (slot & 7).astype(np.uint8)
    level = 1 + ((frequent[slot >> 3] >> bit) & 1) + ((very[slot >> 3] >> bit) & 1)
    rare = tokens[level == 1]
    if len(rare) >= need:
        return rare[:need], np.full(need, n)
    out = [rare]
    rest = np.concatenate([tokens[level == 2], tokens[level == 3]])
    level = np.sort(level[level > 1])
    own = math.floor(math.log(n) / math.log(LABEL_BASE))
    for label in (own, own + 1):
        size = LABEL_BASE**label
        two, three = max(1, int(0.15 * size)), max(1, int(0.1 * size))
        salt = np.uint64(0x5851F42D4C957F2D * (label + 1) & 0xFFFFFFFFFFFFFFFF)
        spread = mixed(rest ^ salt)
        bucket = np.where(level == 2, spread % np.uint64(two), np.uint64(two) + spread % np.uint64(three)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], bucket[order])
        rank = np.empty(len(rest), np.int64)
        rank[order] = np.arange(len(rest)) - first
        covered = len(rare) + np.cumsum(rank >= level - 1)
        end = int(np.searchsorted(covered, need)) + 1
        order = order[order < end]
        for k in (2, 3):
            mine = order[level[order] == k]
            out += _combinations(rest[mine], bucket[mine], k, salt)
    found, first = np.unique(np.concatenate(out), return_index=True)
    return found, np.where(first < len(rare), n, n - len(rare))


def shared_entries(texts: DataFrame, tables: tuple[bytes, bytes]) -> DataFrame:
    """(entry, node, n, most) of the entries with two nodes or more, written."""
    sent = texts.sparkSession.sparkContext.broadcast(tables)

    def emit(batches):
        frequent, very = (np.frombuffer(x, np.uint8) for x in sent.value)
        for batch in sliced(batches):
            hashed = [shingles(t) for t in batch.column("text").to_pylist()]
            found = [entries(x, frequent, very) for x in hashed]
            counts = [len(x) for x, _ in found]
            columns = [
                np.concatenate([x for x, _ in found]).view(np.int64), np.repeat(batch.column("node").to_numpy(), counts),
                np.repeat(np.array([len(x) for x in hashed], np.int64), counts), np.concatenate([m for _, m in found]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    names = ["entry", "node", "n", "most"]
    with scratch(texts.sparkSession):
        index = written(_over(texts, emit, "entry long, node long, n long, most long"), "join-index")
        several = index.groupBy("entry").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("entry")
        # a sort-merge join, whose partitions adaptive execution splits at an entry of many nodes
        return written(index.join(several.hint("merge"), "entry"), "join-entries", outlive=True)


def _may_link(na, ma, nb, mb):
    """Whether sets of these sizes can share enough, given the most that each can share at their entry."""
    return 180 * F.least(ma, mb) >= 80 * (na + nb)


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) that sizes and parity bit maps leave possible. The longer of two maps
    is folded onto the shorter one; the bits that differ are at most as many as shingles do."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("la"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("lb"))
    met = pairs.join(b, "b").join(a, "a").where("100 * least(na, nb) >= 80 * greatest(na, nb)")

    def folded(x, other):
        half = F.floor(F.size(x) / 2).cast("int")
        fold = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > F.size(other), fold).otherwise(x)

    unlike = F.aggregate(
        F.zip_with(folded(F.col("la"), F.col("lb")), folded(F.col("lb"), F.col("la")), lambda p, q: F.bit_count(p.bitwiseXOR(q))),
        F.lit(0), lambda s, x: s + x,
    )
    # overlap o links when 100 o >= 80 (na + nb - o); the difference is na + nb - 2 o
    return met.where(180 * unlike <= 20 * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")


def linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, written."""
    with scratch(docs.sparkSession):
        return written(_verified(pairs, nodes, docs), "join-linked", outlive=True)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    maybe = written(_possible(pairs, nodes), "join-maybe")
    if maybe.isEmpty():
        return maybe.select("a", "b")
    involved = maybe.select(F.col("a").alias("node")).union(maybe.select("b")).distinct()
    wanted = nodes.select("node", "row_id", "key").join(involved, "node", "left_semi")

    def hash_sets(batches):
        for batch in sliced(batches):
            found = [shingles(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "set"])

    hashed = written(_over(_texts(docs, written(wanted, "join-wanted")), hash_sets, "node long, set binary"), "join-hashed")
    loads = maybe.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_PIVOT).alias("salts"))
    pivots = hashed.join(loads, hashed["node"] == loads["a"]).select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(-1).cast("long").alias("b"), "set"
    )
    members = maybe.join(loads, "a").join(hashed, F.col("b") == F.col("node")).select(
        "a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b", "set"
    )

    def compare(batches):
        """A pivot's row stands before those of its candidates."""
        pivot, held = np.empty(0, np.uint64), None
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b")), batch.column("set"), strict=True)
            for a, b, raw in rows:
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                if b < 0:
                    held, pivot = a, own
                    continue
                assert held == a
                both = len(np.intersect1d(pivot, own, assume_unique=True))
                if 100 * both >= PERCENT * (len(pivot) + len(own) - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    met = pivots.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")
    return _over(met, compare, "a long, b long")


def _band(n):
    return F.floor(F.log(n) / F.lit(math.log(BAND))).cast("int")


def _apart(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """``groups`` with what the join of nodes in different components needs: the bit map ``m0`` to ``m3``
    and the node's ``firsts``, by which a pair that shares many entries is told at one of them."""
    masks = nodes.select("node", *[F.col("mask")[k].alias(f"m{k}") for k in range(4)])
    firsts = groups.groupBy("node", "most").agg(F.slice(F.array_sort(F.collect_set("entry")), 1, FIRSTS).alias("firsts"))
    return groups.join(firsts, ["node", "most"]).join(small(masks), "node")


def _met(rows: DataFrame) -> DataFrame:
    """The pairs of rows (a, b) of one entry that may link, with different components; ``a`` is the larger.

    ``b`` has to reach its own size or more, and at a ``busy`` entry ``a`` looks for it in the bands of the
    sizes that both allow."""
    low, high = F.ceil(80 * F.col("n") / 100), F.least("n", "high")
    bands = F.when(F.col("busy"), F.sequence(_band(low), _band(high))).otherwise(F.array(F.lit(0)))
    a = rows.where(high >= low).withColumn("band", F.explode(bands)).alias("a")
    b = rows.where("high >= n").withColumn("band", F.when(F.col("busy"), _band(F.col("n"))).otherwise(0)).alias("b")
    unlike = sum(F.bit_count(F.col(f"a.m{k}").bitwiseXOR(F.col(f"b.m{k}"))) for k in range(4))
    told = F.arrays_overlap(F.filter("a.firsts", lambda x: x < F.col("a.entry")), "b.firsts")
    return a.join(
        b,
        (F.col("a.entry") == F.col("b.entry")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.component") != F.col("b.component"))
        & ((F.col("a.n") > F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.node") < F.col("b.node"))))
        & _may_link(F.col("a.n"), F.col("a.most"), F.col("b.n"), F.col("b.most"))
        & (180 * unlike <= 20 * (F.col("a.n") + F.col("b.n"))) & ~told,
    )


def node_components(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) of the nodes with links. Nodes of one component are joined by links that were
    found; links within a component beyond those are not looked for."""
    total = nodes.agg(F.sum("n")).first()[0] or 0
    texts = _texts(docs, nodes)
    groups = shared_entries(texts, class_tables(texts, total)).withColumn("component", F.col("node"))
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    seen, rest = links, []
    # the largest size that a partner of the node's can have at the entry; below n, only smaller nodes link
    high = F.floor((180 * F.col("most") - 80 * F.col("n")) / 80)
    for turn, kinds in enumerate(KINDS):
        order = F.struct(
            F.floor(20 * (F.col("n") - F.col("most")) / F.col("n")).alias("rare"),
            F.xxhash64(F.lit(turn), F.pmod("entry", F.lit(kinds)), "node").alias("o"), "node", "component", "n", "most",
        )
        pivot = groups.groupBy("entry").agg(F.min(order).alias("p"))
        star = groups.join(pivot, "entry").where("component != p.component")
        star = star.where(_may_link(F.col("n"), F.col("most"), F.col("p.n"), F.col("p.most")))
        pairs = star.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
        pairs = written(pairs.join(seen, ["a", "b"], "left_anti"), "join-pairs")
        links = links.union(linked(pairs, nodes, docs))
        seen = seen.union(pairs)
        labels = _relabelled(groups, components(links))
        own = labels.groupBy("entry", "component").agg(F.count(F.lit(1)).alias("m"), F.count_if(high >= F.col("n")).alias("s"))
        each = own.groupBy("entry").agg(*[f(c).alias(f"{c}{n}") for c in "ms" for n, f in (("", F.sum), ("_top", F.max))], F.count(F.lit(1)).alias("k"))
        each = each.where("k > 1 AND m > 2")  # two nodes have been compared
        # nodes that reach their own size meet those of other components, the others all of them
        busy = F.col("s") * (F.col("s") - F.col("s_top")) + (F.col("m") - F.col("s")) * F.col("s") > FEW * F.col("m")
        still = written(labels.join(each.select("entry", busy.alias("busy")), "entry"), "join-open")
        rest.append(still.where("NOT busy"))
        groups = still.where("busy").drop("busy")
        if groups.isEmpty():
            break
    rest.append(groups.withColumn("busy", F.lit(True)))
    left = _relabelled(reduce(DataFrame.unionByName, rest), components(links)).withColumn("high", high)
    ids = F.col("a.node"), F.col("b.node")
    pairs = _met(written(_apart(left, nodes), "join-apart")).select(F.least(*ids).alias("a"), F.greatest(*ids).alias("b")).distinct()
    pairs = written(pairs.join(seen, ["a", "b"], "left_anti"), "join-pairs")
    return components(links.union(linked(pairs, nodes, docs)))


def _relabelled(groups: DataFrame, found: DataFrame) -> DataFrame:
    """``groups`` with the components of ``found``; nodes that it lacks keep theirs."""
    new = found.withColumnRenamed("component", "new")
    return groups.join(small(new), "node", "left").withColumn("component", F.coalesce("new", "component")).drop("new")


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_shingles, component_id) of every row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach, the row's own included; null ids do
    not count as smallest, and a component without any id has null. Null and empty texts, and texts
    without words, have no shingles and are linked with nothing. Repeated rows get equal results.
    Works on empty tables; only doc_id and text are read."""
    rows = sets(docs)
    with scratch(docs.sparkSession):
        nodes = nodes_of(rows)
        found = node_components(docs, nodes)
        labelled = nodes.join(found, "node", "left").select("digest", "first", F.coalesce("component", "node").alias("component"))
        firsts = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
        named = written(labelled.join(firsts, "component").select("digest", "component_id"), "join-named", outlive=True)
    out = rows.join(named, "digest", "left")
    return out.select(
        "doc_id", "key", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each component the row with the smallest
    doc_id (of several such rows the one with the smallest text key, of equal rows one); rows without
    shingles all stay."""
    with scratch(docs.sparkSession):
        labels = written(join(docs), "join-labels")
        own = F.when(F.col("component_id").isNull(), F.col("key")).alias("own")
        alike = labels.where("n_shingles > 0").groupBy("component_id", own, "doc_id", "key").agg(F.count(F.lit(1)).alias("m"))
        best = alike.groupBy("component_id", "own").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "m")).alias("t"))
        best = best.select(F.col("t.doc_id").alias("kept_id"), F.col("t.key").alias("kept_key"), (F.col("t.m") > 1).alias("several"))
        bare = labels.where("n_shingles = 0").select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key")).distinct()
        stay = best.unionByName(bare.withColumn("several", F.lit(False)))
        stay = written(stay, "join-stay", outlive=True)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("id"),
        F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("md5"),
    )
    met = rows.join(small(stay), (F.col("md5") == F.col("kept_key")) & F.col("id").eqNullSafe(F.col("kept_id")))
    # only rows that repeat doc_id and text are shuffled
    one = met.where("several").dropDuplicates(["kept_key", "kept_id"]).select("doc.*")
    return met.where("NOT several").select("doc.*").unionByName(one)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join(docs).select("doc_id", "n_shingles", "component_id")
