import hashlib
import random
import re

from pyspark.sql import functions as F

from sparkloom.llm import secret_scan, shared
from sparkloom.llm.secret_scan import RULES, trigram_query

BASE = [
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(?ai:", "(?i:"), re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def brute(text):
    out = []
    for rank, (kind, regex, group, least) in enumerate(BASE):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in regex.finditer(text) if len(m[group]) >= least]
    return sorted(out)


def test_base_spans_agree_with_brute_force(spark, odd, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    more = ["é🙂 api_key: 'abcdef' Token=xyz token: token: abcdefgh", "passwordpasswd==aaaaaaa", "0123456789abcdef" * 2 + "AKIA" + "AKIA" * 5]
    extra = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(more)], "doc_id long, text string")
    docs = docs.unionByName(odd.select("doc_id", "text")).unionByName(extra)
    base = [r.kind for r in RULES if r.base]
    found = secret_scan.scan(docs, ["doc_id", "text"]).withColumn(
        "base", secret_scan.listed(F.filter("found", lambda x: x["kind"].isin(*base)))
    )
    rows = found.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.base == ",".join(x[2] for x in brute(r.doc.text or ""))
    assert any(r.base for r in rows)


def test_query_columns(spark, small):
    rows = secret_scan.query(spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in rows:
        spans = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(x[2] for x in spans).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in spans) for k in range(3))


def test_added_rules_and_their_queries(spark):
    text = "k -----BEGIN RSA PRIVATE KEY----- ghp_" + "a1B2" * 9 + " xoxb-1234567890-ab sk_live_" + "A" * 20
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    kinds = [x["kind"] for x in secret_scan.scan(docs).first().found]
    assert kinds == ["private_key", "forge_token", "chat_token", "payment_key"]
    for rule in RULES:
        asked = trigram_query(rule.regex)
        assert bool(asked) == (rule.kind != "hex")


def test_a_query_never_misses_a_match():
    rule = RULES[0]
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        low = f'{word}"= abcdef'
        assert any(all(t in low for t in a) for a in trigram_query(rule.regex))


def test_scan_of_nothing(none):
    assert secret_scan.scan(none).count() == 0


def test_added_rules_agree_with_brute_force(spark, odd, monkeypatch):
    """On both branches of the join, with one text in a third of all rows."""
    draw = random.Random(5)
    parts = [
        "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----BEGIN rsa PRIVATE KEY-----", "eyJ" + "a" * 9, ".", "eyJ", "x1_-Z" * 2,
        "ghp_" + "aB1" * 12, "ghs_" + "b" * 35, "ghx_", "xoxb-" + "1a" * 6, "xoxz-1234567890", "sk_live_" + "A" * 16, "rk_live_" + "B" * 15, " ", "é", "🙂",
    ]
    rows = [(1000 + k, "".join(draw.choice(parts) for _ in range(draw.randrange(12)))) for k in range(300)]
    rows += [(3000 + k, parts[0] + " " + parts[7]) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    added = [(rank, r.kind, re.compile(r.regex)) for rank, r in enumerate(RULES) if not r.base]
    for most in (shared.MOST_BROADCAST, 0):
        monkeypatch.setattr(shared, "MOST_BROADCAST", most)
        some = 0
        for r in secret_scan.scan(docs, ["doc_id", "text"]).collect():
            want = sorted((m.start(), rank, kind, m.end()) for rank, kind, x in added for m in x.finditer(r.doc.text or ""))
            got = [(x["start"], x["rank"], x["kind"], x["end"]) for x in r.found if x["rank"] >= 3]
            assert got == want
            some += bool(want)
        assert some > 200
