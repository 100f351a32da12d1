import hashlib
import random
from collections import Counter

from sparkloom.llm import shared
from sparkloom.llm import suffix_dedup as sd


def brute(rows):
    first = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - 49) if doc_id is not None else ():
            w = raw[k : k + 50]
            first[w] = min(first.get(w, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if doc_id is not None and first[raw[k : k + 50]] < doc_id:
                gone[k : k + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def check(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sd.remove_repeats(docs).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(brute(rows))
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    return got


def passages():
    draw = random.Random(8)
    pool = ["".join(draw.choice("abcde é") for _ in range(draw.randrange(30, 140))) for _ in range(30)]
    rows = []
    for k in range(120):
        parts = [draw.choice(pool) if draw.random() < 0.5 else "".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(80))) for _ in range(draw.randrange(8))]
        rows.append((draw.randrange(200), "".join(parts)))
    rows += [(500, "ab" * 400), (501, "ba" * 300), (502, "\0" * 120), (503, "x" + "\0" * 60 + "y"), (504, "z" * 49), (505, "z" * 50), (506, "z" * 51)]
    return rows + rows[:10] + [(900 + k, rows[3][1]) for k in range(5)]


def test_agrees_with_brute_force_on_odd_rows(odd):
    check(odd)


def test_agrees_with_brute_force_on_passages(spark, monkeypatch):
    monkeypatch.setattr(sd, "SORTED", 200)
    monkeypatch.setattr(sd, "HELD", 300)
    monkeypatch.setattr(sd, "CHUNK", 97)
    docs = spark.createDataFrame(passages(), "doc_id long, text string").repartition(5)
    got = check(docs)
    assert sum(r.n_removed > 0 for r in got) > 50 and any(0 < r.n_removed < r.n_bytes for r in got)


def test_agrees_with_brute_force_on_documents(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"))


def test_merge_gives_order_and_common_prefixes():
    draw = random.Random(2)
    for k in (0, 1, 2, 5, 9):
        runs = [sorted(bytes(draw.choice(b"ab\0") for _ in range(draw.randrange(9))) for _ in range(draw.randrange(20))) for _ in range(k)]
        coded = [sd.decoded(*sd.front_coded(r)) for r in runs]
        given = [iter(r) for r in runs]
        last, out = b"", []
        for run, shared in sd.merged(coded):
            s = next(given[run])
            assert shared == sd.common(last, s, 0)
            out.append(s)
            last = s
        assert out == sorted(x for r in runs for x in r)


def test_nothing(none):
    assert sd.remove_repeats(none).count() == 0


def test_large_branches_and_a_passage_in_all_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(shared, "MOST_BROADCAST", 0)
    check(odd)
    draw = random.Random(6)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(120))
    rows = [(k, passage) for k in range(60)]
    rows += [(100 + k, f"{draw.random()} {passage} {draw.random()}") for k in range(120)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
