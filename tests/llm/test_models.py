import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import language_id, quality_classifier, quality_rules, toxicity
from sparkloom.llm.shared import held_out
from sparkloom.llm.textmap import WordTable
from sparkloom.llm.training import labelled


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    marked = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def test_base_counts_agree_with_brute_force(odd):
    table = WordTable()
    texts = [r.text for r in odd.collect()]
    texts += ["a b c a b c", "a\x0bb\x0c c\r\nd\n\n \na b\na b\n", "é\x85ü\xa0x #*$%&|<>", "x " * 300, "a b c d\na b c\nx", "\x1c\x1d a"]
    for text in texts:
        assert quality_rules.base_counts(text, table) == base(text)


def test_quality_rules_on_odd_rows(odd, labels, none):
    rows = quality_rules.apply_rules(odd, labels).collect()
    assert len(rows) == odd.count()
    for r in rows:
        n = base(r.doc.text)
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.kept and r.base_failed) and 0 <= r.p_good <= 1
    assert quality_rules.passing(odd, labels).columns == odd.columns
    assert quality_rules.apply_rules(none, labels).count() == 0
    assert quality_rules.apply_rules(odd, labels.limit(0)).count() == odd.count()


def area(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    rank = np.array([rank[np.array(score) == s].mean() for s in score])
    ones = y == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() - 1) / 2) / (ones.sum() * (~ones).sum())


SF = "/root/testdata/sf0.01"


def test_quality_rules_separate_the_labels(spark):
    rows = {r.doc_id: r for r in quality_rules.query(spark, SF).collect()}
    known = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    y = np.array([q for r, q in known if not r.base_failed])
    p = [r.p_good for r, q in known if not r.base_failed]
    assert area(p, y) > 0.9
    kept = np.array([r.kept for r, _ in known])
    assert kept[np.array([q for _, q in known]) == 1].mean() > 0.9


def test_quality_classifier(spark, odd, labels, none):
    rows = [r for r in quality_classifier.query(spark, SF).collect()]
    grade = {r.doc_id: r.y for r in quality_classifier.grades(spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    kept = [r for r in rows if r.held_out and r.doc_id in grade]
    assert area([r.tail_probability for r in kept], np.array([int(grade[r.doc_id] > 0) for r in kept])) > 0.85
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in rows)
    assert quality_classifier.classify(odd, labels).count() == odd.count()
    assert quality_classifier.classify(none, labels).count() == 0


def test_toxicity(spark, odd, labels, none):
    SF = "/root/testdata/sf0.1"  # at sf0.01 the held-out rows have six toxic ones
    rows = toxicity.query(spark, SF).collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert area([r.score for r in kept], np.array([toxic[r.doc_id] for r in kept])) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    out = toxicity.score(odd, labels).collect()
    assert len(out) == odd.count() and len({r.score for r in out if not (r.doc.text or "").strip()}) == 1
    assert toxicity.score(none, labels).count() == 0
    assert {r.score for r in toxicity.score(odd, labels.limit(0)).collect()} == {0.0}


def test_language_id(spark, odd, none):
    rows = language_id.query(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in kept]) > 0.97
    contents = language_id.dictionaries(odd)
    out = language_id.identify(odd, contents).collect()
    assert len(out) == odd.count()
    for r in out:
        letters = r.doc.text is not None and any(map(str.isalpha, r.doc.text))
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert language_id.identify(none, contents).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, {}).collect()} == {"und"}


def test_held_out_labels_and_languages_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = held_out(F.col("doc_id"))
    flipped = labels.select("doc_id", *[F.when(out, 1 - F.col(c)).otherwise(F.col(c)).cast(labels.schema[c].dataType).alias(c) for c in ("quality", "toxic")])
    assert labels.exceptAll(flipped).count() > 0
    (weights, cut), (other, there) = (quality_classifier.train(docs, x, 600) for x in (labels, flipped))
    assert (weights == other).all() and (cut == there).all()
    a, b = (toxicity.train(docs, x.select("doc_id", "toxic"), 600) for x in (labels, flipped))
    assert a[0] == b[0] and all((x == y).all() for x, y in zip(a[2], b[2], strict=True))
    moved = docs.withColumn("lang", F.when(out, "xx").otherwise(F.col("lang")))
    found = language_id.dictionaries(docs)
    assert found == language_id.dictionaries(moved) and "xx" not in found


def test_a_sample_is_bounded_by_rows_when_rows_repeat(spark):
    docs = spark.createDataFrame([(k % 3, f"text {k}") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (2, 0), (9, 1)], "doc_id long, y int")
    rows = labelled(docs, labels, 2, 4).collect()
    assert sorted((r.doc_id, r.y) for r in rows) == [(0, 0), (1, 1), (2, 1)]


def test_dictionaries_spread_over_whole_texts(spark):
    long = " ".join(f"w{k}" for k in range(5000))
    docs = spark.createDataFrame([(1, long, "en"), (2, "short text", "en"), (2, "another", "en"), (None, "nobody", "en")], "doc_id long, text string, lang string")
    content = language_id.dictionaries(docs)["en"].decode()
    assert "w0 " in content and "w4999" in content and "nobody" not in content
    assert ("short text" in content) != ("another" in content)


def test_strong_words_count_wherever_they_stand():
    table = WordTable(toxicity.coder({"bad": 2.0}), np.int64)
    near, far = ("bad " * 60 + "x " * 2000, "bad " * 60 + "x " * 1900 + "bad " * 100)
    assert toxicity.dense(far, table)[4] > toxicity.dense(near, table)[4]
