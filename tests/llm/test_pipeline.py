import re
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import mixing, quality_rules

from .test_jaccard_join import brute


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    steps, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, small)
        if name != "pack":
            assert out.columns == docs.columns
        at = spark.createDataFrame(out.collect(), out.schema)
        steps[name] = at.collect()
    verdicts = {r.doc.doc_id: r.kept for r in quality_rules.apply_rules(docs, labels).collect()}
    assert {r.doc_id for r in steps["quality"]} == {d for d, kept in verdicts.items() if kept}
    top = {}
    for r in steps["quality"]:
        top[lowered(r.text)] = max(top.get(lowered(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in steps["exact"]) == sorted(top.values())
    groups = brute(steps["exact"])
    assert sorted(r.doc_id for r in steps["near"]) == sorted({c for _, c in groups.values()})
    near = spark.createDataFrame(steps["near"], docs.schema)
    expected = {r.doc_id: r.copies for r in mixing.copies(mixing.items_of(near)).collect()}
    taken = Counter(r.doc_id for r in steps["mix"])
    assert taken == Counter({d: n for d, n in expected.items() if n}) and max(taken.values()) <= 3
    known = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: known.encode(r.text, add_special_tokens=False).ids + [2] for r in steps["mix"]}
    whole = Counter()
    for p in steps["pack"]:
        whole[p.doc_id] += p.length
        assert np.frombuffer(p.ids, "<u4").tolist() == texts[p.doc_id][p.start : p.start + p.length]
    assert whole == Counter({d: n * len(texts[d]) for d, n in taken.items()})


def test_run_gives_the_last_stage(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0


def test_stages_on_odd_rows_and_on_nothing(spark, odd, none, tmp_path):
    """Nulls, ties, repeated rows and clashing names go through all stages; an empty table stays empty."""
    quality = [(k, 1, 0) for k in range(0, 12)] + [(k, 0, 1) for k in range(12, 18)] + [(None, 1, None), (3, None, None)]
    spark.createDataFrame(quality, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, none):
        at, n = docs, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, str(tmp_path))
            if name == "pack":
                assert (out.count() == 0) == (n == 0)
                break
            assert out.columns == docs.columns
            at = spark.createDataFrame(out.collect(), out.schema)
            if name != "mix":
                assert at.count() <= n
                n = at.count()
        assert (n == 0) == (docs is none)
