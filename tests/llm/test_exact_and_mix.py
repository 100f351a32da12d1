import hashlib
import re
from collections import Counter, defaultdict

import pytest

from sparkloom.llm import exact_dedup, mixing, shared


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_dedup_agrees_with_brute_force(odd):
    rows = odd.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r.text)].append(-1 if r.doc_id is None else r.doc_id)
    out = exact_dedup.exact_duplicates(odd).collect()
    assert len(out) == len(rows)
    for r in out:
        members = groups[lowered(r.doc.text)]
        assert r.group_size == len(members)
        assert (-1 if r.keep_id is None else r.keep_id) == max(members)
        assert r.text_sha256 == hashlib.sha256(lowered(r.doc.text).encode()).hexdigest()
    assert Counter(r.text_sha256 for r in out if r.kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    stay = exact_dedup.deduplicate(odd)
    assert stay.columns == odd.columns
    assert Counter(lowered(r.text) for r in stay.collect()) == Counter(groups.keys())


def test_exact_dedup_of_nothing(none):
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.deduplicate(none).columns == none.columns


def filled(sizes, most=3.0, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: share * weight[s] for s in free}
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return target


def test_targets_and_taken_words(spark, odd):
    out = mixing.copies(mixing.items_of(odd)).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in out:
        sizes[r.source] += r.size * r.m
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.copies <= 3 * r.m
    assert sum(r.m for r in out) == odd.count()
    target = filled(sizes)
    for r in out:
        assert r.target == pytest.approx(target[r.source])
        assert r.source_size == sizes[r.source]
    for source in sizes:
        assert abs(taken[source] - target[source]) <= largest[source]


def test_mix_reruns_agree_and_keep_columns(odd):
    a, b = mixing.mix(odd), mixing.mix(odd.repartition(7))
    assert a.columns == odd.columns
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))
    expected = {(r.source, r.doc_id, r.size): r.copies for r in mixing.copies(mixing.items_of(odd)).collect()}
    assert a.count() == sum(expected.values())


def test_rounding_keeps_words_and_expectations(spark):
    items = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 5) END AS source", "id AS doc_id",
        "1 + pmod(hash(id), 50) AS size", "1L AS m",
    ).selectExpr("source", "doc_id", "CAST(size AS BIGINT) AS size", "m")
    rows = mixing.copies(items, fan_in=8).collect()
    taken, target, mean = Counter(), {}, defaultdict(list)
    for r in rows:
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        mean[r.source].append(r.copies - r.target / r.source_size)
    assert all(abs(taken[s] - target[s]) <= 25.001 for s in target)
    assert all(abs(sum(x) / len(x)) < 0.05 for x in mean.values())


def test_mix_of_nothing(none):
    assert mixing.mix(none).count() == 0


def test_exact_dedup_with_one_text_in_a_third_of_the_rows(spark, odd, monkeypatch):
    rows = [(k, "Hot Text" if k % 3 == 0 else f"text {k // 2}") for k in range(300)] + [(297, "hot text")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    best = {}
    for d, t in rows:
        best[t.lower()] = max(best.get(t.lower(), -1), d)
    for most in (shared.MOST_BROADCAST, 0):
        monkeypatch.setattr(shared, "MOST_BROADCAST", most)
        stay = exact_dedup.deduplicate(docs).collect()
        assert Counter((r.doc_id, r.text.lower()) for r in stay) == Counter((d, t) for t, d in best.items())
        assert exact_dedup.deduplicate(odd).count() == len({lowered(r.text) for r in odd.collect()})
