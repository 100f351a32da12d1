import random
import re

import numpy as np
import pytest

from sparkloom.llm import jaccard_join as jj
from sparkloom.llm import shared
from sparkloom.llm.textmap import word_hashes


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def brute(rows):
    """{(doc_id, text): (n, component)} by comparing all pairs."""
    items = list({(r.doc_id, r.text) for r in rows})
    found = [shingle_set(t) for _, t in items]
    root = list(range(len(items)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    holders = {}
    for k, s in enumerate(found):
        for x in s:
            holders.setdefault(x, []).append(k)
    pairs = {(i, j) for h in holders.values() for i in h for j in h if i < j}
    for i, j in pairs:
        both = len(found[i] & found[j])
        if 100 * both >= 80 * len(found[i] | found[j]):
            root[top(i)] = top(j)
    least = {}
    for k, (d, _) in enumerate(items):
        if d is not None:
            least[top(k)] = min(least.get(top(k), d), d)
    return {item: (len(found[k]), least.get(top(k)) if found[k] else item[0]) for k, item in enumerate(items)}


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    want = brute(rows)
    import hashlib

    keys = {(d, hashlib.md5((t or "").encode()).digest()): v for (d, t), v in want.items()}
    out = jj.join(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_shingles, r.component_id) == keys[r.doc_id, bytes(r.key)]
    return want


def near_copies(n=120, words=60, seed=5):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(500)}" for _ in range(words)]
    rows = []
    for k in range(n):
        text = list(base)
        for _ in range(draw.randrange(3)):
            text[draw.randrange(words)] = f"x{draw.randrange(10**6)}"
        if draw.random() < 0.2:
            text = text[: words - draw.randrange(12)]
        rows.append((1000 + k, " ".join(text)))
    passage = " ".join(f"p{k}" for k in range(40))
    rows += [(2000 + k, passage + " " + " ".join(f"y{draw.randrange(10**6)}" for _ in range(draw.randrange(1, 30)))) for k in range(60)]
    return rows


def test_join_agrees_with_brute_force_on_odd_rows(odd):
    check(odd)


@pytest.mark.parametrize("frequent", [(8, 256), (2, 5)])
def test_join_agrees_with_brute_force_on_near_copies(spark, monkeypatch, frequent):
    monkeypatch.setattr(jj, "FREQUENT", frequent[0])
    monkeypatch.setattr(jj, "VERY_FREQUENT", frequent[1])
    monkeypatch.setattr(jj, "PER_PIVOT", 7)
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string").repartition(4)
    want = check(docs)
    assert len({c for _, c in want.values()}) < len(want) - 50


def test_join_agrees_with_brute_force_on_documents(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"))


def test_entries_meet_for_every_link():
    draw = np.random.default_rng(1)
    size = 1 << 17  # bytes of a class table
    levels = (np.zeros(size, np.uint8), np.full(size, 255, np.uint8), draw.integers(0, 256, size, dtype=np.uint8))
    for n in [*range(4, 40), 77, 300]:
        for _ in range(12):
            x = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
            lost = int(draw.integers(0, jj.difference(n) + 1))
            y = np.delete(x, draw.choice(len(x), lost, replace=False))
            room = len(y) * 100 // 80 - len(x)
            if room > 0:
                y = np.unique(np.append(y, draw.integers(0, 2**64, int(draw.integers(0, room + 1)), dtype=np.uint64)))
            both = len(np.intersect1d(x, y))
            if 100 * both < 80 * (len(x) + len(y) - both):
                continue
            for a in levels:
                for b in levels:
                    (mine, most), (other, there) = jj.entries(x, a, a & b), jj.entries(y, a, a & b)
                    _, i, j = np.intersect1d(mine, other, return_indices=True)
                    assert (180 * np.minimum(most[i], there[j]) >= 80 * (len(x) + len(y))).any(), (n, len(y))


def test_short_texts_are_one_shingle():
    assert [len(jj.shingles(t)) for t in (None, "", " \n", "a", "a b c d", "a b c d e", "A b c d e f")] == [0, 0, 0, 1, 1, 1, 2]


def test_deduplicate_keeps_one_of_each_component(spark, odd):
    docs = spark.createDataFrame(near_copies(40), "doc_id long, text string")
    want = brute(docs.collect())
    kept = [r.doc_id for r in jj.deduplicate(docs).collect()]
    assert sorted(kept) == sorted({c for _, c in want.values()})
    stay = jj.deduplicate(odd)
    assert stay.columns == odd.columns
    want = brute(odd.collect())
    bare = sum(not shingle_set(r.text) for r in odd.collect())
    groups = {(c, None if c is not None else shingle_set(t)) for (_, t), (n, c) in want.items() if n}
    assert stay.count() == bare + len(groups)


def test_join_of_nothing(none):
    assert jj.join(none).count() == 0
    assert jj.deduplicate(none).count() == 0


def test_word_hashes_follow_the_words(odd):
    for text in [*(r.text or "" for r in odd.collect()), "a" * 200_000 + " b " + "c d " * 40_000, "\x1c a\x0bb\x85"]:
        raw = text.encode()
        h, words = word_hashes(raw), raw.split()
        assert len(h) == len(words)
        assert len(set(h.tolist())) == len(set(words)) == len(set(zip(h.tolist(), words, strict=True)))


def test_large_branches_agree_with_brute_force(spark, odd, monkeypatch):
    monkeypatch.setattr(shared, "MOST_BROADCAST", 0)
    check(odd)
    docs = spark.createDataFrame(near_copies(60), "doc_id long, text string").repartition(4)
    check(docs)
    assert jj.deduplicate(docs).count() == len({c for _, c in brute(docs.collect()).values()})


def test_one_text_and_one_passage_in_a_third_of_the_rows(spark):
    draw = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(80))
    rows = [(k, passage) for k in range(300)]
    rows += [(1000 + k, passage + " " + " ".join(f"y{draw.randrange(10**6)}" for _ in range(15))) for k in range(300)]
    rows += [(2000 + k, " ".join(f"z{draw.randrange(10**6)}" for _ in range(60))) for k in range(300)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_a_boilerplate_in_long_documents_makes_few_pairs(spark, monkeypatch):
    """What meets in the last join grows with the rows, not with their square."""
    draw = random.Random(4)
    passage = " ".join(f"q{k}" for k in range(300))
    made = []

    def pairs_of(n):
        rows = [(k, passage + " " + " ".join(f"y{draw.randrange(10**6)}" for _ in range(draw.randrange(5, 300)))) for k in range(n)]
        made.clear()
        jj.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).count()
        return sum(made)

    whole = jj._met

    def counted(rows):
        out = whole(rows)
        made.append(out.count())
        return out

    monkeypatch.setattr(jj, "_met", counted)
    few, many = pairs_of(500), pairs_of(2000)
    assert many <= 6 * max(few, 100)
